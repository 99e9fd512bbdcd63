"""Coupon tables expressed as views over ``orders``, ``lineitem`` and ``events``."""

from __future__ import annotations

from datetime import date

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from couponflow.operators.folds import Fold

# Fixed value: discount text by ``coupon_id % 8``.
DISCOUNTS = ["30:5", "100:10", "50:20", "20:1", "200:30", "0.9", "0.95", "0.5"]

FOLDS = [
    Fold(1, date(1999, 1, 1), date(1999, 12, 31), None, date(1998, 6, 30), None, date(1998, 12, 31)),
    Fold(
        2,
        date(2000, 1, 1),
        date(2000, 12, 31),
        date(1996, 1, 1),
        date(1999, 6, 30),
        date(1996, 1, 1),
        date(1999, 12, 31),
    ),
]

PREDICT_START = date(1998, 1, 1)
PREDICT_FOLD = Fold(
    0,
    date(2001, 1, 1),
    date(2001, 12, 31),
    PREDICT_START,
    date(2000, 12, 31),
    PREDICT_START,
    date(2000, 12, 31),
)


def offline(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Store events: one row per line item."""
    orders = spark.read.parquet(f"{sf_dir}/orders.parquet").select(
        F.col("o_orderkey").alias("l_orderkey"), "o_custkey", F.to_date("o_orderdate").alias("day")
    )
    items = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    coupon = F.when(
        F.col("l_returnflag") != "N", F.col("l_suppkey") * 10 + F.col("l_partkey") % 5 + 1
    )
    distance = (F.col("l_orderkey") * 7 + F.col("l_suppkey")) % 12
    text = F.element_at(
        F.array(*[F.lit(d) for d in DISCOUNTS]), (F.col("coupon_id") % 8 + 1).cast("int")
    )
    used_on = F.date_add("day", (F.col("l_quantity").cast("int") % 31))
    return (
        items.join(orders, "l_orderkey")
        .withColumn("coupon_id", coupon)
        .select(
            F.col("o_custkey").alias("user_id"),
            F.col("l_suppkey").alias("merchant_id"),
            "coupon_id",
            F.when(F.col("coupon_id").isNotNull(), text).alias("discount_rate_text"),
            F.when(distance != 11, distance).cast("int").alias("distance"),
            F.when(F.col("coupon_id").isNotNull(), F.col("day")).alias("date_received"),
            F.when(F.col("coupon_id").isNull(), F.col("day"))
            .when(F.col("l_linestatus") == "F", used_on)
            .alias("date"),
        )
    )


def offline_batch(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Receipts of the prediction window, without the consumption date."""
    return (
        offline(spark, sf_dir)
        .where(F.col("date_received").between(PREDICT_FOLD.label_from, PREDICT_FOLD.label_to))
        .drop("date")
    )


def online(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Web actions: one row per event."""
    kind, number = F.col("event_type"), F.col("event_id")
    numbered = (number % 50 + 1).cast("string")
    day = F.date_add(
        F.lit(date(1995, 1, 1)),
        F.datediff(F.to_date("ts"), F.lit(date(2024, 1, 1))) * 80,
    )
    coupon = (
        F.when(kind == "signup", numbered)
        .when((kind == "purchase") & (number % 4 == 0), F.lit("fixed"))
        .when((kind == "purchase") & (number % 4 == 1), numbered)
    )
    text = (
        F.when(F.col("coupon_id") == "fixed", F.lit("fixed"))
        .when(F.col("coupon_id").isNotNull() & (number % 2 == 0), F.lit("30:5"))
        .when(F.col("coupon_id").isNotNull(), F.lit("0.9"))
    )
    return (
        spark.read.parquet(f"{sf_dir}/events.parquet")
        .withColumn("coupon_id", coupon)
        .withColumn("day", day)
        .select(
            "user_id",
            (number % 100).alias("merchant_id"),
            F.when(kind == "purchase", 1).when(kind == "signup", 2).otherwise(0).alias("action"),
            "coupon_id",
            text.alias("discount_rate_text"),
            F.when(F.col("coupon_id").isNotNull(), F.col("day")).alias("date_received"),
            F.when(kind != "signup", F.col("day")).alias("date"),
        )
    )
