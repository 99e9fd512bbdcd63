"""Positions of rows in their groups when a group may be larger than one task should take.

Rows go to ranges of (group, order), so a large group spans many ranges. A row's position is the rows of its
group in earlier ranges plus its place in its own range; only one row per range and group is summed up.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from couponflow.llm.tables import small_side
from couponflow.session import stage

ROWS_PER_RANGE = 50_000
_ROW_BITS = (1 << 33) - 1


def ranges_for(rows: int) -> int:
    """Number of ranges: of ``ROWS_PER_RANGE`` rows, and of more rows where that makes over 5,000."""
    return 1 + min(rows // ROWS_PER_RANGE, max(5_000, rows // (100 * ROWS_PER_RANGE)))


def placed(df: DataFrame, group: str, order: list[str], ranges: int) -> DataFrame:
    """``df`` with ``place`` (from 0, in its group) and ``members`` (rows of its group), both long.

    ``df`` must be a written table, so that every reader meets the same rows. Rows equal in ``group`` and ``order``
    are placed next to each other in any order.
    """
    spread = df.repartitionByRange(ranges, group, *order, "_tie") if "_tie" in df.columns else (
        df.repartitionByRange(ranges, group, *order)
    )
    numbered = spread.sortWithinPartitions(group, *order).select(
        *df.columns,
        F.spark_partition_id().alias("_range"),
        F.monotonically_increasing_id().bitwiseAND(F.lit(_ROW_BITS)).alias("_row"),
    )
    rows = stage(numbered, "ranges")
    pieces = rows.groupBy("_range", group).agg(F.min("_row").alias("_first"), F.count(F.lit(1)).alias("_n"))
    whole = Window.partitionBy(group)
    earlier = F.sum("_n").over(whole.orderBy("_range")) - F.col("_n")
    starts = pieces.select("_range", group, (earlier - F.col("_first")).alias("_shift"), F.sum("_n").over(whole).alias("members"))
    return rows.join(small_side(starts), ["_range", group]).select(
        *df.columns, (F.col("_row") + F.col("_shift")).alias("place"), "members"
    )
