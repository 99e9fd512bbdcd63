"""Features of the batch itself: what else its users, merchants and coupons do in it.

They see the whole batch, so they are not available for live scoring; ``matrix`` keeps them
behind a flag. Rows are first counted at fine grains; distinct partners are then row counts of
a finer grain. The previous/next windows run over one row per key and day, so the largest
window partition has as many rows as the label window has days, however hot the key is.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from couponflow.functions.basic import mean_gap
from couponflow.plans.history import (
    COUPON,
    MERCHANT,
    MERCHANT_COUPON,
    USER,
    USER_COUPON,
    USER_MERCHANT,
)

DAY = "date_received"
USER_DAY = [*USER, DAY]
USER_COUPON_DAY = [*USER_COUPON, DAY]
MERCHANT_DAY = [*MERCHANT, DAY]
COUPON_DAY = [*COUPON, DAY]


def _count(rows: DataFrame, keys: list[str], name: str) -> DataFrame:
    return rows.groupBy(*keys).agg(F.count(F.lit(1)).alias(name))


def user_merchant(batch: DataFrame) -> DataFrame:
    """o8, with the day range to roll up."""
    return batch.groupBy(*USER_MERCHANT).agg(
        F.count(F.lit(1)).alias("o8"), F.min(DAY).alias("first"), F.max(DAY).alias("last")
    )


def user_coupon(batch: DataFrame) -> DataFrame:
    """o2."""
    return _count(batch, USER_COUPON, "o2")


def merchant_coupon(batch: DataFrame) -> DataFrame:
    """o14."""
    return _count(batch, MERCHANT_COUPON, "o14")


def user(batch_user_merchant: DataFrame, batch_user_coupon: DataFrame) -> DataFrame:
    """o1, o7, o9 and o12."""
    coupons = _count(batch_user_coupon, USER, "o12")
    return (
        batch_user_merchant.groupBy(*USER)
        .agg(
            F.sum("o8").alias("o1"),
            F.count(F.lit(1)).alias("o9"),
            F.min("first").alias("first"),
            F.max("last").alias("last"),
        )
        .withColumn("o7", mean_gap("first", "last", "o1"))
        .drop("first", "last")
        .join(coupons, USER, "left")
    )


def merchant(batch_user_merchant: DataFrame, batch_merchant_coupon: DataFrame) -> DataFrame:
    """o13, o15 and o16."""
    coupons = _count(batch_merchant_coupon, MERCHANT, "o16")
    return (
        batch_user_merchant.groupBy(*MERCHANT)
        .agg(F.sum("o8").alias("o13"), F.count(F.lit(1)).alias("o15"))
        .join(coupons, MERCHANT, "left")
    )


def merchant_day(batch: DataFrame) -> DataFrame:
    """m5 and m6."""
    per_user = _count(batch, [*MERCHANT_DAY, "user_id"], "n")
    return per_user.groupBy(*MERCHANT_DAY).agg(
        F.sum("n").alias("m5"), F.count(F.lit(1)).alias("m6")
    )


def coupon_day(batch: DataFrame) -> DataFrame:
    """c5."""
    return _count(batch, COUPON_DAY, "c5")


def user_day(batch: DataFrame) -> DataFrame:
    """o10, and o3, o4, o17, o18: rows before and after the day, and days to the nearest."""
    days = _count(batch, USER_DAY, "o10")
    ordered = Window.partitionBy(*USER).orderBy(DAY)
    gap_back = F.datediff(DAY, F.lag(DAY).over(ordered))
    gap_ahead = F.datediff(F.lead(DAY).over(ordered), DAY)
    return _before_after(days, USER, "o10", "o3", "o4").withColumns(
        {
            "o17": F.coalesce(gap_back, F.lit(-1)),
            "o18": F.coalesce(gap_ahead, F.lit(-1)),
        }
    )


def user_coupon_day(batch: DataFrame) -> DataFrame:
    """o11, and o5, o6: rows of the same coupon before and after the day."""
    return _before_after(_count(batch, USER_COUPON_DAY, "o11"), USER_COUPON, "o11", "o5", "o6")


def _before_after(days: DataFrame, keys: list[str], n: str, before: str, after: str) -> DataFrame:
    """Rows on strictly earlier and strictly later days, from one running total."""
    per_key = Window.partitionBy(*keys)
    so_far = F.sum(n).over(
        per_key.orderBy(DAY).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    )
    total = F.sum(n).over(per_key)
    return days.withColumns({before: so_far - F.col(n), after: total - so_far})
