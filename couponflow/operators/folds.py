"""Time windows: a label window and the history that may be used to describe it.

All folds are cut in one scan. Each event gets the (short, literal) list of windows it falls
into, and ``explode`` emits one row per window, so no join against a fold table is needed.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from datetime import date, timedelta
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from couponflow.functions import dates


@dataclass(frozen=True)
class Fold:
    """Closed windows; ``None`` leaves a side open."""

    fold: int
    label_from: date | None
    label_to: date | None
    recv_from: date | None
    recv_to: date | None
    buy_from: date | None
    buy_to: date | None


# The two training folds over the 2016 tables.
FOLDS_2016 = [
    Fold(1, date(2016, 4, 16), date(2016, 5, 15), None, date(2016, 3, 31), None, date(2016, 4, 15)),
    Fold(
        2,
        date(2016, 5, 16),
        None,
        date(2016, 2, 1),
        date(2016, 4, 30),
        date(2016, 2, 1),
        date(2016, 5, 15),
    ),
]
# Fixed value: first day of the history used for scoring.
PREDICT_FROM_2016 = date(2016, 3, 16)


def sliding_folds(
    first: date, last: date, step: int, label_days: int, gap_days: int, history_days: int
) -> list[Fold]:
    """Label windows of ``label_days`` every ``step`` days.

    Receipts must be ``gap_days`` old at the window start, so that their outcome is known;
    ordinary purchases count up to the day before it.
    """
    folds, start, number = [], first, 1
    while start + timedelta(label_days - 1) <= last:
        buy_to = start - timedelta(1)
        begin = start - timedelta(history_days)
        folds.append(
            Fold(
                number,
                start,
                start + timedelta(label_days - 1),
                begin,
                buy_to - timedelta(gap_days),
                begin,
                buy_to,
            )
        )
        start, number = start + timedelta(step), number + 1
    return folds


def label_rows(events: DataFrame, folds: Sequence[Fold]) -> DataFrame:
    """Receipts inside the label windows, once per fold."""
    return _expand(
        events,
        [(f.fold, within(F.col("date_received"), f.label_from, f.label_to)) for f in folds],
    )


def history_rows(
    events: DataFrame, folds: Sequence[Fold], compat_sentinel: bool = False
) -> DataFrame:
    """Bag union, per fold, of coupon receipts and ordinary purchases of the history windows.

    ``compat_sentinel`` treats a missing date as 1970-01-01. A receipt window that is open at
    the start then also takes every row without a receipt date, so that ordinary purchases
    come in twice and later ones leak in.
    """
    if compat_sentinel:
        received, bought = dates.filled("date_received"), dates.filled("date")
    else:
        received, bought = F.col("date_received"), F.col("date")
    windows = []
    for f in folds:
        windows.append((f.fold, within(received, f.recv_from, f.recv_to)))
        windows.append((f.fold, no_coupon(events) & within(bought, f.buy_from, f.buy_to)))
    return _expand(events, windows)


def scoring_history(events: DataFrame, start: date, until: date | None = None) -> DataFrame:
    """History for scoring: each purchase or receipt since ``start``, once."""
    purchase = no_coupon(events) & within(F.col("date"), start, until)
    receipt = within(F.col("date_received"), start, until)
    return events.where(purchase | receipt)


def no_coupon(events: DataFrame) -> Column:
    """Coupon id is the "none" value, for numeric (offline) and text (online) ids."""
    is_text = dict(events.dtypes)["coupon_id"] == "string"
    return F.col("coupon_id") == (F.lit("0") if is_text else F.lit(0))


def within(day: Column, start: date | None, end: date | None) -> Column:
    """Whether ``day`` is there and inside a closed window."""
    inside = day.isNotNull()
    if start is not None:
        inside = inside & (day >= F.lit(start))
    if end is not None:
        inside = inside & (day <= F.lit(end))
    return inside


def _expand(events: DataFrame, windows: list[tuple[int, Column]]) -> DataFrame:
    # The same conditions as a filter, so that they can reach the scan.
    wanted = reduce(lambda a, b: a | b, [inside for _, inside in windows])
    hits = F.array(*[F.when(inside, F.lit(fold)) for fold, inside in windows])
    expanded = events.where(wanted).select(F.explode(hits).alias("fold"), *events.columns)
    return expanded.where(F.col("fold").isNotNull())
