"""Cleaned forms of the source tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from couponflow.functions import discount

# Known distances run from 0 to 10.
UNKNOWN_DISTANCE = 11
NO_COUPON = 0


def clean_offline(events: DataFrame) -> DataFrame:
    """Fill distance and coupon, and parse the discount; dates stay missing where they are."""
    return events.withColumns(
        {
            "distance": F.coalesce("distance", F.lit(UNKNOWN_DISTANCE)).cast("int"),
            "coupon_id": F.coalesce("coupon_id", F.lit(NO_COUPON)).cast("bigint"),
            "discount_rate_x": discount.spend(),
            "discount_rate_y": discount.off(),
            "discount_rate": discount.paid_share(),
        }
    )


def clean_online(events: DataFrame) -> DataFrame:
    """Fill the (text) coupon id and parse the discount."""
    return events.withColumns(
        {
            "coupon_id": F.coalesce("coupon_id", F.lit(str(NO_COUPON))),
            "discount_rate": discount.online_paid_share(),
        }
    )
