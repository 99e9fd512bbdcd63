"""Joins and row numbers that survive hot keys.

A key is hot when it has more rows than one task should take. The limit is the same for all tables: a
table of n rows has at most n / ``ROWS_PER_TASK`` hot keys (2 million for 10^13 rows), which bounds
every broadcast here. Results are whole: hot keys are only spread over more tasks.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce
from math import ceil

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ROWS_PER_TASK = 5_000_000
#: Rows of a bucket. With the wide tables that are made of them, a bucket is sorted in the memory that a task has.
ROWS_PER_BUCKET = 1_000_000
SALT = "_salt"
PIECES = "_pieces"


def legal_buckets(wanted: int, most: int) -> int:
    """Buckets to write: what is wanted, and never more than the engine's setting allows."""
    return max(1, min(wanted, most))


def hot_keys(rows: DataFrame, keys: Sequence[str], limit: int) -> DataFrame:
    """Hot keys and the number of pieces to cut each into."""
    return (
        rows.groupBy(*keys)
        .agg(F.count(F.lit(1)).alias("_rows"))
        .where(F.col("_rows") > limit)
        .select(*keys, F.ceil(F.col("_rows") / limit).cast("int").alias(PIECES))
    )


def attach(
    rows: DataFrame,
    features: DataFrame,
    keys: Sequence[str],
    hot: DataFrame | None = None,
    spread_by: Sequence[str] = ("row_id",),
) -> DataFrame:
    """Left join of ``rows`` with one feature row per key.

    With ``hot`` (from :func:`hot_keys`), the rows of a hot key are spread over its pieces by
    the hash of ``spread_by`` (stable, so a retried task sends the same rows to the same
    place), and its one feature row is repeated once per piece.
    """
    keys = list(keys)
    if hot is None:
        return rows.join(features, keys, "left")
    piece = F.pmod(F.xxhash64(*spread_by), F.coalesce(PIECES, F.lit(1)))
    salted = _null_safe(rows, hot, keys, "left").withColumn(SALT, piece.cast("int")).drop(PIECES)
    copies = F.explode(F.sequence(F.lit(0), F.coalesce(PIECES, F.lit(1)) - 1))
    repeated = _null_safe(features, hot, keys, "left").withColumn(SALT, copies).drop(PIECES)
    return salted.join(repeated, [*keys, SALT], "left").drop(SALT)


def _null_safe(rows: DataFrame, hot: DataFrame, keys: Sequence[str], how: str) -> DataFrame:
    """Join with a list of hot keys, in which a missing key counts as a key."""
    marks = hot.withColumnsRenamed({k: f"_hot_{k}" for k in keys})
    same = reduce(Column.__and__, [F.col(k).eqNullSafe(F.col(f"_hot_{k}")) for k in keys])
    return rows.join(F.broadcast(marks), same, how).drop(*[f"_hot_{k}" for k in keys])


class HotKeys:
    """Looks up the hot keys of one (staged) table, by the same search for every size."""

    def __init__(self, rows: DataFrame, rows_per_task: int = ROWS_PER_TASK):
        self.rows = rows
        self.limit = max(rows_per_task, 1)
        self._found: dict[tuple[str, ...], DataFrame | None] = {}

    def of(self, keys: Sequence[str]) -> DataFrame | None:
        """Hot combinations of ``keys``; ``None`` when there are none.

        ``keys`` starts with the fold and one id. A combination can only be hot if that id is,
        so wider keys are counted over the rows of hot ids alone.
        """
        keys = tuple(keys)
        if keys not in self._found:
            self._found[keys] = self._search(keys)
        return self._found[keys]

    def _search(self, keys: tuple[str, ...]) -> DataFrame | None:
        rows = self.rows
        if len(keys) > 2:
            leading = self.of(keys[:2])
            if leading is None:
                return None
            rows = _null_safe(rows, leading, keys[:2], "left_semi")
        found = hot_keys(rows, keys, self.limit)
        return None if found.isEmpty() else found


@dataclass(frozen=True)
class UserLayout:
    """How the rows of a table are spread by user.

    Most users are small, so their rows can share buckets by user: all per-user work is then
    local. Users above the limit are hot; their rows are kept apart and shuffled by finer keys.
    Tables of all sizes are laid out like this; only the number of buckets follows the rows.
    """

    buckets: int
    limit: int
    hot_users: DataFrame | None

    @staticmethod
    def of(rows: DataFrame, rows_per_task: int = ROWS_PER_TASK) -> UserLayout:
        total = rows.count()
        shuffles = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
        limit = max(rows_per_task, 1)
        most = int(rows.sparkSession.conf.get("spark.sql.sources.bucketing.maxBuckets"))
        found = hot_keys(rows, ["user_id"], limit).select("user_id")
        found = None if found.isEmpty() else found
        wanted = max(shuffles, ceil(total / min(limit, ROWS_PER_BUCKET)))
        return UserLayout(legal_buckets(wanted, most), limit, found)

    def usual(self, rows: DataFrame) -> DataFrame:
        """Rows of users that are not hot."""
        if self.hot_users is None:
            return rows
        return _null_safe(rows, self.hot_users, ["user_id"], "left_anti")

    def hot(self, rows: DataFrame) -> DataFrame:
        return _null_safe(rows, self.hot_users, ["user_id"], "left_semi")


def matching(
    rows: DataFrame,
    wanted: DataFrame,
    keys: Sequence[str],
    hot: DataFrame | None = None,
    spread_by: Sequence[str] = ("row_id",),
    keep: bool = True,
) -> DataFrame:
    """Rows whose key is (``keep=False``: is not) in ``wanted``, which has each key once."""
    if hot is None:
        return rows.join(wanted, list(keys), "left_semi" if keep else "left_anti")
    marked = attach(rows, wanted.withColumn("_found", F.lit(True)), keys, hot, spread_by)
    found = F.col("_found").isNotNull()
    return marked.where(found if keep else ~found).drop("_found")


def number_copies(rows: DataFrame, rows_per_task: int | None = ROWS_PER_TASK) -> DataFrame:
    """Add ``copy_no`` (1, 2, ..) to equal rows, giving every row an identity.

    Equal rows are counted (with partial counts before the shuffle) and laid out again from
    the count, so no window sorts a big group of copies. The copies of a very frequent row are
    laid out in chunks that are spread over tasks; ``None`` says that there are no such rows,
    and keeps the rows where they are.
    """
    columns = rows.columns
    counted = rows.groupBy(*columns).agg(F.count(F.lit(1)).alias("_n"))
    copies = F.explode(F.sequence(F.lit(1).cast("bigint"), F.col("_n"))).alias("copy_no")
    if rows_per_task is None:
        return counted.select(*columns, copies)
    few = counted.where(F.col("_n") <= rows_per_task).select(*columns, copies)
    chunk = F.lit(rows_per_task).cast("bigint")
    last = F.least(F.col("_start") + chunk - 1, F.col("_n"))
    many = (
        counted.where(F.col("_n") > rows_per_task)
        .withColumn("_start", F.explode(F.sequence(F.lit(1).cast("bigint"), F.col("_n"), chunk)))
        .repartition(*columns, "_start")
        .select(*columns, F.explode(F.sequence(F.col("_start"), last)).alias("copy_no"))
    )
    return few.unionByName(many)


def row_id(columns: Sequence[str], copy_no: str = "copy_no"):
    """MD5 text over the row's values and its copy number."""
    parts = [F.coalesce(F.col(c).cast("string"), F.lit("~")) for c in columns]
    return F.md5(F.concat_ws("|", *parts, F.col(copy_no).cast("string")))


def with_row_ids(
    rows: DataFrame, columns: Sequence[str], rows_per_task: int | None = ROWS_PER_TASK
) -> DataFrame:
    """Rows of ``columns`` with a distinct, reproducible ``row_id``."""
    numbered = number_copies(rows.select(*columns), rows_per_task)
    return numbered.withColumn("row_id", row_id(columns)).drop("copy_no")
