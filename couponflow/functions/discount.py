"""Parsing of the discount text: ``spend:off``, a decimal rate, ``fixed`` or missing."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

# The known discount texts; the position is the ordinal code.
DISCOUNT_TYPES = [
    "0.2", "0.5", "0.6", "0.7", "0.75", "0.8", "0.85", "0.9", "0.95", "30:20", "50:30", "10:5",
    "20:10", "100:50", "200:100", "50:20", "30:10", "150:50", "100:30", "20:5", "200:50", "5:1",
    "50:10", "100:20", "150:30", "30:5", "300:50", "200:30", "150:20", "10:1", "50:5", "100:10",
    "200:20", "300:30", "150:10", "300:20", "500:30", "20:1", "100:5", "200:10", "30:1", "150:5",
    "300:10", "200:5", "50:1", "100:1",
]

# Spend tiers of threshold coupons: (label, above, up to).
SPEND_TIERS = [("0_50", 0, 50), ("50_200", 50, 200), ("200_500", 200, 500)]


def is_threshold(text: str = "discount_rate_text") -> Column:
    """Text has a ``:``; false for missing text."""
    return F.coalesce(F.contains(F.col(text), F.lit(":")), F.lit(False))


def is_decimal(text: str = "discount_rate_text") -> Column:
    """Text has a ``.``; false for missing text."""
    return F.coalesce(F.contains(F.col(text), F.lit(".")), F.lit(False))


def spend(text: str = "discount_rate_text") -> Column:
    return _part(text, 1)


def off(text: str = "discount_rate_text") -> Column:
    return _part(text, 2)


def paid_share(text: str = "discount_rate_text") -> Column:
    """``1 - off/spend`` for threshold coupons, else the decimal itself; missing stays missing."""
    share = 1 - F.try_divide(off(text).cast("double"), spend(text).cast("double"))
    return F.when(is_threshold(text), share).otherwise(F.col(text).try_cast("double"))


def type_code(text: str = "discount_rate_text") -> Column:
    """Ordinal of the text in ``DISCOUNT_TYPES``, -1 when it is not there."""
    known = F.array(*[F.lit(t) for t in DISCOUNT_TYPES])
    return F.coalesce(F.array_position(known, F.col(text)) - 1, F.lit(-1)).cast("int")


def alt_paid_share(text: str = "discount_rate_text") -> Column:
    """Baseline variant: missing is 1, every text without a threshold (``fixed`` too) is 0."""
    return (
        F.when(F.col(text).isNull(), 1.0)
        .when(is_threshold(text), paid_share(text))
        .otherwise(0.0)
    )


def alt_spend(text: str = "discount_rate_text") -> Column:
    return F.coalesce(spend(text), F.lit(0))


def alt_off(text: str = "discount_rate_text") -> Column:
    return F.coalesce(off(text), F.lit(0))


def alt_class(text: str = "discount_rate_text") -> Column:
    """1 threshold, 0 any other text, missing when there is none."""
    return F.when(F.col(text).isNotNull(), is_threshold(text).cast("int"))


def online_paid_share(text: str = "discount_rate_text") -> Column:
    """As :func:`paid_share`, with ``fixed`` (always redeemed) as 0."""
    return F.when(F.col(text) == "fixed", 0.0).otherwise(paid_share(text))


def bin_of(rate: Column, edges: Sequence[float]) -> Column:
    """Number of inner edges at or below the rate: bin 0 .. len(edges)."""
    total = F.lit(0)
    for edge in edges:
        total = total + (rate >= F.lit(float(edge))).cast("int")
    return total


def _part(text: str, position: int) -> Column:
    piece = F.try_element_at(F.split(F.col(text), ":"), F.lit(position))
    return F.when(is_threshold(text), piece.try_cast("int"))
