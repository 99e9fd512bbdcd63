"""Null algebra shared by all features.

A count over no rows is *missing*, not 0, until the final fill: sums and ratios built on it
must go missing too. ANSI mode stays on, so divisions go through ``try_divide``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def ratio(top: Column | str, bottom: Column | str) -> Column:
    """Quotient as double; missing when a side is missing or the divisor is 0."""
    return F.try_divide(_column(top).cast("double"), _column(bottom).cast("double"))


def some(count: Column | str) -> Column:
    """A count with 0 turned into missing."""
    return F.nullif(_column(count), F.lit(0))


def zero_if_missing(value: Column | str) -> Column:
    return F.coalesce(_column(value), F.lit(0))


def mean_gap(first: str, last: str, n: str) -> Column:
    """Days between the first and last event over the number of gaps; missing for one event."""
    return ratio(F.datediff(last, first), F.col(n) - 1)


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    """Round every double column, for comparing results across engines."""
    return df.selectExpr(
        *[f"round(`{c}`, {digits}) AS `{c}`" if t == "double" else f"`{c}`" for c, t in df.dtypes]
    )


def _column(value: Column | str) -> Column:
    return F.col(value) if isinstance(value, str) else value
