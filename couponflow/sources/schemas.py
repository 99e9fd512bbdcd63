"""Explicit schemas of the three source tables; nothing is inferred."""

from __future__ import annotations

from pyspark.sql import types as T

_LONG, _INT, _TEXT, _DATE = T.LongType(), T.IntegerType(), T.StringType(), T.DateType()

OFFLINE = T.StructType(
    [
        T.StructField("user_id", _LONG),
        T.StructField("merchant_id", _LONG),
        T.StructField("coupon_id", _LONG),
        T.StructField("discount_rate_text", _TEXT),
        T.StructField("distance", _INT),
        T.StructField("date_received", _DATE),
        T.StructField("date", _DATE),
    ]
)

# The batch to score has no consumption date.
OFFLINE_BATCH = T.StructType(OFFLINE.fields[:-1])

# Online coupon ids mix digits and the word ``fixed``, so they stay text.
ONLINE = T.StructType(
    [
        T.StructField("user_id", _LONG),
        T.StructField("merchant_id", _LONG),
        T.StructField("action", _INT),
        T.StructField("coupon_id", _TEXT),
        T.StructField("discount_rate_text", _TEXT),
        T.StructField("date_received", _DATE),
        T.StructField("date", _DATE),
    ]
)
