"""Exploratory reports and data-quality checks; each is one pass over the events."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from couponflow.functions.basic import ratio
from couponflow.plans.history import is_plain, is_unused, is_used

SEGMENTS = ["used", "unused", "plain"]


def distance_conversion(offline: DataFrame) -> DataFrame:
    """Per distance with any redemption: rows, redemptions and their share."""
    return (
        offline.groupBy("distance")
        .agg(
            F.count(F.lit(1)).alias("receive_count"),
            F.count_if(is_used()).alias("consume_count"),
        )
        .where(F.col("consume_count") > 0)
        .withColumn("consume_rate", ratio("consume_count", "receive_count"))
    )


def segment_totals(offline: DataFrame) -> DataFrame:
    """One row: rows with and without a receipt, with and without a purchase."""
    received, bought = F.col("date_received").isNotNull(), F.col("date").isNotNull()
    return offline.agg(
        F.count_if(received & bought).alias("coupon_purchase"),
        F.count_if(~received & bought).alias("plain_purchase"),
        F.count_if(received & ~bought).alias("coupon_unused"),
        F.count_if(~received & ~bought).alias("neither"),
    )


def distinct_values(offline: DataFrame) -> DataFrame:
    """Distinct discount texts and distances."""
    texts = offline.select(F.lit("discount_rate_text").alias("kind"), F.col("discount_rate_text").alias("value"))
    distances = offline.select(F.lit("distance").alias("kind"), F.col("distance").cast("string").alias("value"))
    return texts.distinct().unionByName(distances.distinct())


def date_ranges(offline: DataFrame) -> DataFrame:
    return offline.agg(
        F.min("date_received").alias("first_received"),
        F.max("date_received").alias("last_received"),
        F.min("date").alias("first_bought"),
        F.max("date").alias("last_bought"),
    )


def daily_redemption(offline: DataFrame) -> DataFrame:
    """Per receipt day: receipts, redemptions and their share."""
    return (
        offline.where(F.col("date_received").isNotNull())
        .groupBy("date_received")
        .agg(F.count(F.lit(1)).alias("received"), F.count("date").alias("used"))
        .withColumn("used_share", ratio("used", "received"))
    )


def segment(offline: DataFrame) -> DataFrame:
    """Each row with its segment: used, unused or plain."""
    name = F.when(is_used(), "used").when(is_unused(), "unused").when(is_plain(), "plain")
    return offline.withColumn("segment", name)


def daily_pivot(offline: DataFrame) -> DataFrame:
    """Purchases per day, one column per purchase segment."""
    return (
        segment(offline)
        .where(F.col("date").isNotNull())
        .groupBy("date")
        .pivot("segment", ["used", "plain"])
        .count()
    )


def label_balance(rows: DataFrame) -> DataFrame:
    """Per fold: rows, positives and their share."""
    return (
        rows.groupBy("fold")
        .agg(F.count(F.lit(1)).alias("rows"), F.sum("label").alias("positives"))
        .withColumn("positive_share", ratio("positives", "rows"))
    )


def fixed_check(online: DataFrame) -> DataFrame:
    """One row: ``fixed`` rows, with and without purchase, and with purchase on another day."""
    used = F.col("date").isNotNull()
    return online.where(F.col("coupon_id") == "fixed").agg(
        F.count(F.lit(1)).alias("fixed_rows"),
        F.count_if(used).alias("fixed_used"),
        F.count_if(~used).alias("fixed_unused"),
        F.count_if(F.col("date_received") != F.col("date")).alias("fixed_other_day"),
    )


def missing_keys(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """Keys of ``left`` that never occur in ``right``."""
    return left.select(key).distinct().join(right.select(key).distinct(), key, "left_anti")


def head_sample(rows: DataFrame, n: int) -> DataFrame:
    """First ``n`` rows in the order of all columns."""
    return rows.orderBy(*[F.col(c).asc_nulls_first() for c in rows.columns]).limit(n)
