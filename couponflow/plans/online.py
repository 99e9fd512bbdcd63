"""Features from the web history, per user and per discount text."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from couponflow.functions.basic import ratio, some
from couponflow.operators.spread import HotKeys, matching
from couponflow.plans.history import DISCOUNT, USER, exact_rate

CLICK, PURCHASE = 0, 1


def _held():
    return F.col("coupon_id") != "0"


def user_features(history: DataFrame) -> DataFrame:
    """on_u1 to on_u10."""
    return (
        history.groupBy(*USER)
        .agg(
            F.count(F.lit(1)).alias("on_u1"),
            some(F.count_if(F.col("action") == CLICK)).alias("on_u2"),
            some(F.count_if(F.col("action") == PURCHASE)).alias("on_u4"),
            some(F.count_if(_held())).alias("on_u6"),
            some(F.count_if(_held() & F.col("date").isNull())).alias("on_u8"),
            some(F.count_if(_held() & F.col("date").isNotNull())).alias("on_u9"),
        )
        .withColumns(
            {
                "on_u3": ratio("on_u2", "on_u1"),
                "on_u5": ratio("on_u4", "on_u1"),
                "on_u7": ratio("on_u6", "on_u1"),
                "on_u10": ratio("on_u9", "on_u6"),
            }
        )
    )


def offline_share():
    """on_u11 to on_u13: the store side's share of both sides' activity."""
    return {
        "on_u11": ratio("u3", F.col("on_u8") + F.col("u3")),
        "on_u12": ratio("u2", F.col("on_u9") + F.col("u2")),
        "on_u13": ratio("u1", F.col("on_u6") + F.col("u1")),
    }


def rate_features(history: DataFrame) -> DataFrame:
    """Per user: mean, lowest and highest rate over redeemed web coupons."""
    used = _held() & F.col("date").isNotNull()
    return (
        history.where(used)
        .groupBy(*USER)
        .agg(
            ratio(F.sum(exact_rate()), F.count("discount_rate")).alias("ou14"),
            F.min("discount_rate").alias("ou15"),
            F.max("discount_rate").alias("ou16"),
        )
    )


def discount_features(history: DataFrame) -> DataFrame:
    """Per discount text: oc1 to oc4."""
    return (
        history.where(F.col("discount_rate_text").isNotNull())
        .groupBy(*DISCOUNT)
        .agg(
            F.count(F.lit(1)).alias("oc1"),
            some(F.count_if(_held() & F.col("date").isNotNull())).alias("oc2"),
            some(F.count_if(_held() & F.col("date").isNull())).alias("oc3"),
        )
        .withColumn("oc4", ratio("oc2", "oc1"))
    )


def known_users(online_events: DataFrame, offline_events: DataFrame) -> DataFrame:
    """Web events of users that also appear in the stores."""
    users = offline_events.select("user_id").distinct()
    hot = HotKeys(online_events).of(["user_id"])
    return matching(online_events, users, ["user_id"], hot, online_events.columns)
