"""Features from the history window, one table per key grain and fold.

Each grain is one hash aggregate with partial results before the shuffle, so a hot key sends
one row per task. Wide statistics are taken directly at the coarse grains (user, merchant,
coupon), where the partial results are small. Distinct partners come from narrow counts per
pair: every pair row stands for one partner, so no distinct aggregate is needed.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from couponflow.functions import discount
from couponflow.functions.basic import mean_gap, ratio, some, zero_if_missing
from couponflow.functions.cleaning import NO_COUPON, UNKNOWN_DISTANCE
from couponflow.functions.dates import REDEEM_DAYS
from couponflow.operators.spread import HotKeys, attach

USER = ["fold", "user_id"]
MERCHANT = ["fold", "merchant_id"]
COUPON = ["fold", "coupon_id"]
DISCOUNT = ["fold", "discount_rate_text"]
USER_MERCHANT = ["fold", "user_id", "merchant_id"]
USER_COUPON = ["fold", "user_id", "coupon_id"]
USER_DISCOUNT = ["fold", "user_id", "discount_rate_text"]
USER_MERCHANT_DAY = ["fold", "user_id", "merchant_id", "date_received"]
MERCHANT_COUPON = ["fold", "merchant_id", "coupon_id"]


def _held() -> Column:
    return F.col("coupon_id") != NO_COUPON


def is_used() -> Column:
    """Coupon row that was redeemed."""
    return _held() & F.col("date").isNotNull()


def is_unused() -> Column:
    """Coupon row that was not redeemed."""
    return _held() & F.col("date").isNull()


def is_plain() -> Column:
    """Purchase without a coupon."""
    return ~_held() & F.col("date").isNotNull()


def is_received() -> Column:
    return F.col("date_received").isNotNull()


def _delay() -> Column:
    return F.datediff("date", "date_received")


def exact_rate() -> Column:
    """The rate as a decimal: its sums do not depend on the order of rows and tasks."""
    return F.col("discount_rate").cast("decimal(14,10)")


def stats(history: DataFrame, keys: list[str]) -> DataFrame:
    """All additive statistics of the history rows per key."""
    used, plain = is_used(), is_plain()
    near = used & (F.col("distance") != UNKNOWN_DISTANCE)
    return history.groupBy(*keys).agg(
        F.count_if(_held()).alias("held"),
        F.count_if(used).alias("used"),
        F.count_if(is_unused()).alias("unused"),
        F.count_if(plain).alias("plain"),
        F.count_if(is_received()).alias("received"),
        F.count_if(F.col("date").isNotNull()).alias("bought"),
        F.min(F.when(used, F.col("date"))).alias("used_first"),
        F.max(F.when(used, F.col("date"))).alias("used_last"),
        F.min(F.when(plain, F.col("date"))).alias("plain_first"),
        F.max(F.when(plain, F.col("date"))).alias("plain_last"),
        F.sum(F.when(used, _delay())).alias("delay_sum"),
        F.count_if(used & (_delay() <= REDEEM_DAYS)).alias("used_in_time"),
        F.count(F.when(used, F.col("discount_rate"))).alias("rate_n"),
        F.sum(F.when(used, exact_rate())).alias("rate_sum"),
        F.min(F.when(used, F.col("discount_rate"))).alias("rate_min"),
        F.max(F.when(used, F.col("discount_rate"))).alias("rate_max"),
        F.count(F.when(near, F.col("distance"))).alias("near_n"),
        F.sum(F.when(near, F.col("distance"))).alias("near_sum"),
        F.min(F.when(near, F.col("distance"))).alias("near_min"),
        F.max(F.when(near, F.col("distance"))).alias("near_max"),
        F.count_if(discount.is_threshold()).alias("threshold_rows"),
        F.count_if(discount.is_decimal()).alias("decimal_rows"),
    )


def user_merchant_counts(history: DataFrame) -> DataFrame:
    """Narrow counts per (user, merchant); read by three feature tables, so worth staging."""
    return history.groupBy(*USER_MERCHANT).agg(
        F.count_if(_held()).alias("held"),
        F.count_if(is_used()).alias("used"),
        F.count_if(is_unused()).alias("unused"),
        F.count_if(is_plain()).alias("plain"),
        F.count_if(F.col("date").isNotNull()).alias("bought"),
        F.count_if(is_received()).alias("received"),
    )


def user_coupon_counts(history: DataFrame) -> DataFrame:
    return history.groupBy(*USER_COUPON).agg(
        F.count_if(is_received()).alias("received"), F.count_if(is_used()).alias("used")
    )


def merchant_coupon_counts(history: DataFrame) -> DataFrame:
    return history.groupBy(*MERCHANT_COUPON).agg(
        F.count_if(is_received()).alias("received"), F.count_if(is_used()).alias("used")
    )


def user_features(
    history: DataFrame, user_merchant: DataFrame, user_coupon: DataFrame
) -> DataFrame:
    """Per user: u1-u11, u19-u25, u27, u28, u32, u35-u37, u45, u48, u49 and um9-um12."""
    return user_features_of(stats(history, USER), user_merchant, user_coupon)


def user_features_of(
    statistics: DataFrame, user_merchant: DataFrame, user_coupon: DataFrame
) -> DataFrame:
    """As :func:`user_features`, from the :func:`stats` of each user."""
    coupons = user_coupon.groupBy(*USER).agg(some(F.count_if(F.col("used") > 0)).alias("u32"))
    merchants = user_merchant.groupBy(*USER).agg(
        F.count(F.lit(1)).alias("um9"), some(F.count_if(F.col("used") > 0)).alias("um10")
    )
    per_user = (
        statistics.withColumns(
            {
                "u1": F.col("used") + F.col("unused"),
                "u2": some("used"),
                "u3": some("unused"),
                "u5": some("plain"),
                "u6": mean_gap("plain_first", "plain_last", "plain"),
                "u7": mean_gap("used_first", "used_last", "used"),
                "u10": ratio("delay_sum", "used"),
                "u21": some("used_in_time"),
                "u25": some("used") + some("plain"),
            }
        )
        .select(
            *USER,
            "u1",
            "u2",
            "u3",
            ratio("u2", "u1").alias("u4"),
            "u5",
            "u6",
            "u7",
            (F.col("u6") / REDEEM_DAYS).alias("u8"),
            (F.col("u7") / REDEEM_DAYS).alias("u9"),
            "u10",
            (F.col("u10") / REDEEM_DAYS).alias("u11"),
            ratio("u2", "u3").alias("u19"),
            ratio("u2", "u25").alias("u20"),
            "u21",
            ratio("u21", "u2").alias("u22"),
            ratio("u21", "u3").alias("u23"),
            ratio("u21", "u1").alias("u24"),
            "u25",
            F.col("rate_min").alias("u27"),
            F.col("rate_max").alias("u28"),
            ratio("near_sum", "near_n").alias("u35"),
            F.col("near_min").alias("u36"),
            F.col("near_max").alias("u37"),
            ratio("rate_sum", "rate_n").alias("u45"),
            some("threshold_rows").alias("u48"),
            some("decimal_rows").alias("u49"),
        )
    )
    return (
        per_user.join(merchants, USER, "left")
        .join(coupons, USER, "left")
        .withColumns({"um11": ratio("um10", "um9"), "um12": ratio("u2", "um9")})
    )


def merchant_features(
    history: DataFrame, user_merchant: DataFrame, merchant_coupon: DataFrame
) -> DataFrame:
    """Per merchant: m0-m4, m7-m15 and m18-m23. m9 is the highest and m10 the lowest rate."""
    return merchant_features_of(stats(history, MERCHANT), user_merchant, merchant_coupon)


def merchant_features_of(
    statistics: DataFrame, user_merchant: DataFrame, merchant_coupon: DataFrame
) -> DataFrame:
    """As :func:`merchant_features`, from the :func:`stats` of each merchant."""
    coupons = merchant_coupon.groupBy(*MERCHANT).agg(
        some(F.count_if(F.col("used") > 0)).alias("m15"),
        some(F.count_if(F.col("received") > 0)).alias("m18"),
    )
    users = user_merchant.groupBy(*MERCHANT).agg(
        some(F.count_if(F.col("used") > 0)).alias("m11"),
        some(F.count_if(F.col("received") > 0)).alias("m12"),
    )
    per_merchant = statistics.select(
        *MERCHANT,
        some("bought").alias("m0"),
        some("used").alias("m1"),
        (F.col("bought") - F.col("used")).alias("m2"),
        some("received").alias("m3"),
        ratio(some("used"), "received").alias("m4"),
        some("unused").alias("m7"),
        ratio("rate_sum", "rate_n").alias("m8"),
        F.col("rate_max").alias("m9"),
        F.col("rate_min").alias("m10"),
        mean_gap("used_first", "used_last", "used").alias("m20"),
        ratio("near_sum", "near_n").alias("m21"),
        F.col("near_min").alias("m22"),
        F.col("near_max").alias("m23"),
    )
    return (
        per_merchant.join(users, MERCHANT, "left")
        .join(coupons, MERCHANT, "left")
        .withColumns(
            {
                "m13": ratio("m11", "m12"),
                "m14": ratio("m1", "m12"),
                "m19": ratio("m15", "m18"),
            }
        )
    )


def coupon_features(history: DataFrame) -> DataFrame:
    """Per coupon: c1-c4 and c12. c4 is missing for a coupon that was never used."""
    return coupon_features_of(stats(history.where(_held()), COUPON))


def coupon_features_of(statistics: DataFrame) -> DataFrame:
    """As :func:`coupon_features`, from the :func:`stats` of each coupon."""
    return statistics.select(
        *COUPON,
        some("held").alias("c1"),
        some("used").alias("c2"),
        ratio(some("used"), "held").alias("c3"),
        (F.col("held") - some("used")).alias("c4"),
        mean_gap("used_first", "used_last", "used").alias("c12"),
    )


def discount_features(history: DataFrame) -> DataFrame:
    """Per discount text: c8-c11."""
    return (
        history.where(F.col("discount_rate_text").isNotNull())
        .groupBy(*DISCOUNT)
        .agg(
            F.count(F.lit(1)).alias("c8"),
            some(F.count_if(is_used())).alias("c9"),
            some(F.count_if(is_unused())).alias("c10"),
        )
        .withColumn("c11", ratio("c9", "c8"))
    )


def user_discount_features(history: DataFrame) -> DataFrame:
    """Per user and discount text: u41-u44."""
    return (
        history.where(F.col("discount_rate_text").isNotNull())
        .groupBy(*USER_DISCOUNT)
        .agg(
            F.count(F.lit(1)).alias("u41"),
            some(F.count_if(is_used())).alias("u42"),
            some(F.count_if(is_unused())).alias("u43"),
        )
        .withColumn("u44", ratio("u42", "u41"))
    )


def user_coupon_features(user_coupon: DataFrame) -> DataFrame:
    """Per user and coupon: u47, the receipts of that coupon."""
    return user_coupon.where(F.col("received") > 0).select(
        *USER_COUPON, F.col("received").alias("u47")
    )


def user_merchant_features(user_merchant: DataFrame) -> DataFrame:
    """Per user and merchant: um1-um4, um6 and um7."""
    return user_merchant.select(
        *USER_MERCHANT,
        some("held").alias("um1"),
        some("unused").alias("um2"),
        some("used").alias("um3"),
        ratio(some("used"), "held").alias("um4"),
        some("bought").alias("um6"),
        some("plain").alias("um7"),
    )


def user_merchant_day_features(history: DataFrame) -> DataFrame:
    """Per user, merchant and receipt day: um8."""
    return (
        history.where(is_received())
        .groupBy(*USER_MERCHANT_DAY)
        .agg(F.count(F.lit(1)).alias("um8"))
    )


def distance_features(history: DataFrame) -> DataFrame:
    """Per distance: redeemed, not redeemed, both together and the redeemed share."""
    return (
        history.where(_held())
        .groupBy("fold", "distance")
        .agg(
            some(F.count_if(is_used())).alias("distance_0"),
            some(F.count_if(is_unused())).alias("distance_1"),
        )
        .withColumn("distance_2", F.col("distance_0") + F.col("distance_1"))
        .withColumn("distance_3", ratio("distance_0", "distance_2"))
    )


def mean_known_distance(history: DataFrame) -> DataFrame:
    """Per fold: mean known distance of redeemed coupons."""
    near = is_used() & (F.col("distance") != UNKNOWN_DISTANCE)
    return history.where(near).groupBy("fold").agg(F.avg("distance").alias("d4"))


def spend_tier_features(history: DataFrame) -> DataFrame:
    """Per user: redeemed share of threshold coupons by spend tier, and tier share of uses."""
    spend = discount.spend()
    counts = [F.count_if(is_used()).alias("used")]
    for name, above, up_to in discount.SPEND_TIERS:
        inside = _held() & (spend > above) & (spend <= up_to)
        counts.append(F.count_if(inside).alias(f"held_{name}"))
        counts.append(F.count_if(inside & is_used()).alias(f"used_{name}"))
    per_user = history.groupBy(*USER).agg(*counts)
    tiers = [name for name, _, _ in discount.SPEND_TIERS]
    return per_user.select(
        *USER,
        *[ratio(f"used_{t}", f"held_{t}").alias(f"tier_rate_{t}") for t in tiers],
        *[ratio(f"used_{t}", "used").alias(f"tier_share_{t}") for t in tiers],
    )


def user_per_merchant(users: DataFrame) -> DataFrame:
    """Per user: mean redemptions per merchant redeemed at."""
    return users.select(*USER, ratio("u2", "um10").alias("used_per_merchant"))


def merchant_per_coupon(merchants: DataFrame) -> DataFrame:
    """Per merchant: redemptions per distinct redeemed coupon."""
    return merchants.select(*MERCHANT, ratio("m1", "m15").alias("used_per_coupon"))


def user_merchant_share(user_merchant: DataFrame) -> DataFrame:
    """Share of the user's and of the merchant's (un)redeemed coupons that the pair holds.

    ``user_merchant`` should be a staged table: it is read several times.
    """
    users = user_merchant.groupBy(*USER).agg(
        F.sum("used").alias("user_used"), F.sum("unused").alias("user_unused")
    )
    merchants = user_merchant.groupBy(*MERCHANT).agg(
        F.sum("used").alias("merchant_used"), F.sum("unused").alias("merchant_unused")
    )
    hot = HotKeys(user_merchant)
    out = attach(user_merchant, users, USER, hot.of(USER), USER_MERCHANT)
    out = attach(out, merchants, MERCHANT, hot.of(MERCHANT), USER_MERCHANT)
    return out.select(
        *USER_MERCHANT,
        ratio(some("unused"), "user_unused").alias("um5"),
        ratio(some("used"), "user_used").alias("share_of_user_used"),
        ratio(some("unused"), "merchant_unused").alias("share_of_merchant_unused"),
        ratio(some("used"), "merchant_used").alias("share_of_merchant_used"),
    )


def user_coupon_history(user_coupon: DataFrame) -> DataFrame:
    """Per user and coupon: received, redeemed and the share."""
    return user_coupon.where(_held()).select(
        *USER_COUPON,
        "received",
        "used",
        ratio("used", "received").alias("used_share"),
    )


def fill_after_join(rows: DataFrame) -> DataFrame:
    """u1 is 0, not missing, for users without history."""
    return rows.withColumn("u1", zero_if_missing("u1"))
