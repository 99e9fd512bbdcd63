"""Labels and calendar parts."""

from __future__ import annotations

from datetime import date

from pyspark.sql import Column
from pyspark.sql import functions as F

REDEEM_DAYS = 15
# Fixed value: the day that stands for "no date" in the compatible history window.
NO_DATE = date(1970, 1, 1)


def redeemed_in_time(days: int = REDEEM_DAYS) -> Column:
    """1 if used at most ``days`` days after receipt, else 0."""
    return F.when(F.datediff("date", "date_received") <= days, 1).otherwise(0)


def three_way_label(days: int = REDEEM_DAYS) -> Column:
    """-1 without a receipt, otherwise as :func:`redeemed_in_time`."""
    return F.when(F.col("date_received").isNull(), -1).otherwise(redeemed_in_time(days))


def weekday0(day: str = "date_received") -> Column:
    """Monday 0 .. Sunday 6."""
    return F.weekday(day)


def weekday1(day: str = "date_received") -> Column:
    """Monday 1 .. Sunday 7."""
    return F.weekday(day) + 1


def is_weekend(day: str = "date_received") -> Column:
    return F.coalesce(F.weekday(day) >= 5, F.lit(False)).cast("int")


def weekday_flags(day: str = "date_received") -> list[Column]:
    """``weekday_1`` .. ``weekday_7``, all 0 for a missing date."""
    return [
        F.coalesce(weekday1(day) == n, F.lit(False)).cast("int").alias(f"weekday_{n}")
        for n in range(1, 8)
    ]


def filled(day: str) -> Column:
    """The date with the stand-in day for missing ones."""
    return F.coalesce(F.col(day), F.lit(NO_DATE))
