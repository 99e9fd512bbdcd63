"""History statistics of many overlapping windows from one pass over the events.

A pane is what the events of one key and day add to a window's statistics: counts, decimal sums, first and last days,
lowest and highest values. An event is in the pane of its receipt day, if it has one, and, if it is a purchase without a
coupon, in that of its purchase day, since windows take receipts and purchases by different days. A window is the merge of
its panes, so each event is read and aggregated once, whatever the number of windows, and only panes are repeated.

Distinct partners come from panes of pairs, merged to one row for each window and pair. Panes of grains with the user are kept in
buckets by user: merging the days of a pair, counting the pairs of a user and joining both need no shuffle.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import cached_property, reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from couponflow.operators.folds import Fold, no_coupon, within
from couponflow.operators.spread import ROWS_PER_TASK, HotKeys, UserLayout, attach
from couponflow.plans import history as past
from couponflow.session import CO_LOCATED, settings, stage, stage_by_key

RECEIPT, PURCHASE = "r", "p"
_MERGE = {"first": F.min, "last": F.max, "min": F.min, "max": F.max}


def merged(column: str) -> Column:
    """How the parts of a statistic (see :func:`history.stats`) become that of all of them together."""
    return _MERGE.get(column.rsplit("_", 1)[-1], F.sum)(column).alias(column)


def dated(events: DataFrame) -> DataFrame:
    """Each event with the ``kind`` and ``day`` of its panes: one row for almost every event, two at most."""
    receipt = F.when(F.col("date_received").isNotNull(), F.struct(F.lit(RECEIPT).alias("kind"), F.col("date_received").alias("day")))
    purchase = F.when(
        no_coupon(events) & F.col("date").isNotNull(), F.struct(F.lit(PURCHASE).alias("kind"), F.col("date").alias("day"))
    )
    both = F.filter(F.array(receipt, purchase), lambda pane: pane.isNotNull())
    return events.select("*", F.inline(both))


def panes(dated_events: DataFrame, keys: Sequence[str]) -> DataFrame:
    """One row for each key, kind and day."""
    return past.stats(dated_events, [*keys, "kind", "day"])


def merge(found: DataFrame, folds: Sequence[Fold], keys: Sequence[str]) -> DataFrame:
    """Statistics for each fold and key, as :func:`history.stats` makes them of the fold's history rows."""
    receipt, purchase = F.col("kind") == RECEIPT, F.col("kind") == PURCHASE
    inside = [
        (receipt & within(F.col("day"), f.recv_from, f.recv_to)) | (purchase & within(F.col("day"), f.buy_from, f.buy_to))
        for f in folds
    ]
    # The same conditions as a filter, so that they can reach the scan.
    wanted = reduce(lambda a, b: a | b, inside)
    hits = F.filter(F.array(*[F.when(i, F.lit(f.fold)) for f, i in zip(folds, inside, strict=True)]), lambda n: n.isNotNull())
    parts = [c for c in found.columns if c not in {*keys, "kind", "day"}]
    rows = found.where(wanted).select(F.explode(hits).alias("fold"), *keys, *parts)
    return rows.groupBy("fold", *keys).agg(*[merged(p) for p in parts])


class SlidingHistory:
    """The history tables of all ``folds``, over cleaned store ``events``; each grain's panes are written once.

    Users with more events than one task should take have no place in the buckets: their panes are merged by shuffles
    on the finer keys.
    """

    def __init__(self, events: DataFrame, folds: Sequence[Fold], rows_per_task: int = ROWS_PER_TASK):
        self.folds, self.spark = folds, events.sparkSession
        self.events = stage(events, "events")
        layout = UserLayout.of(self.events, rows_per_task)
        self.groups = [(dated(layout.usual(self.events)), layout.buckets)]
        if layout.hot_users is not None:
            self.groups.append((dated(layout.hot(self.events)), None))

    def _write(self, df: DataFrame, name: str, buckets: int | None) -> DataFrame:
        return stage(df, name) if buckets is None else stage_by_key(df, name, "user_id", buckets)

    def _by_user(self, group: int, *keys: str) -> DataFrame:
        rows, buckets = self.groups[group]
        kept = self._write(panes(rows, ["user_id", *keys]), "panes", buckets)
        return merge(kept, self.folds, ["user_id", *keys])

    def _by(self, *keys: str) -> DataFrame:
        return merge(stage(panes(dated(self.events), keys), "panes"), self.folds, keys)

    @cached_property
    def _pairs(self) -> list[DataFrame]:
        counts = ("held", "used", "unused", "plain", "bought", "received")
        with settings(self.spark, CO_LOCATED):
            return [
                self._write(self._by_user(n, "merchant_id").select(*past.USER_MERCHANT, *counts), "pairs", buckets)
                for n, (_, buckets) in enumerate(self.groups)
            ]

    @property
    def pairs(self) -> DataFrame:
        return reduce(DataFrame.unionByName, self._pairs)

    def users(self) -> DataFrame:
        """As :func:`history.user_features`; written, with its joins on the buckets."""
        parts = []
        with settings(self.spark, CO_LOCATED):
            for n, pairs in enumerate(self._pairs):
                coupons = self._by_user(n, "coupon_id").select(*past.USER_COUPON, "received", "used")
                parts.append(stage(past.user_features_of(self._by_user(n), pairs, coupons), "sliding-users"))
        return reduce(DataFrame.unionByName, parts)

    def merchants(self) -> DataFrame:
        coupons = self._by("merchant_id", "coupon_id").select(*past.MERCHANT_COUPON, "received", "used")
        return past.merchant_features_of(self._by("merchant_id"), self.pairs, coupons)

    def coupons(self) -> DataFrame:
        return past.coupon_features_of(self._by("coupon_id").where(F.col("held") > 0))

    def user_merchants(self) -> DataFrame:
        return past.user_merchant_features(self.pairs)

    def training_rows(self, rows: DataFrame, rows_per_task: int = ROWS_PER_TASK) -> DataFrame:
        """``rows`` (written label rows of the same folds, with ``row_id``) with the features of their user, merchant, coupon and pair."""
        hot = HotKeys(rows, rows_per_task)
        tables = [
            (self.user_merchants(), past.USER_MERCHANT),
            (self.users(), past.USER),
            (stage(self.merchants(), "sliding-merchants"), past.MERCHANT),
            (stage(self.coupons(), "sliding-coupons"), past.COUPON),
        ]
        for features, keys in tables:
            rows = attach(rows, features, keys, hot.of(keys))
        return past.fill_after_join(rows)
