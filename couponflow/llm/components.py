"""Connected components of a graph given as a table of links, by alternating stars.

Each round points every node at the smallest node it knows of: first all larger neighbours of a node
(large star), then the smaller ones (small star). A round is two aggregates and joins on the node, so a
node with a very large number of links is only pre-aggregated and its join split by adaptive
execution. Nothing but a count and a sum per round comes to the driver; every round is a written table.

Cases: equal and self links are dropped; null ends link nothing; an empty table has no components.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from couponflow.session import stage


def _smallest(links: DataFrame) -> DataFrame:
    return links.groupBy("a").agg(F.min("b").alias("m"))


def _large_star(links: DataFrame) -> DataFrame:
    """``links`` has a > b. Larger neighbours of each node go to its smallest neighbour."""
    both = links.select("a", "b").unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
    lowest = _smallest(both).select("a", F.least("a", "m").alias("m"))
    larger = links.select(F.col("b").alias("a"), F.col("a").alias("b"))
    return larger.join(lowest, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))


def _small_star(links: DataFrame) -> DataFrame:
    """``links`` has a > b. Smaller neighbours of each node, and itself, go to the smallest one."""
    lowest = _smallest(links)
    moved = links.join(lowest, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return moved.unionByName(lowest.select("a", F.col("m").alias("b")))


def _state(links: DataFrame) -> tuple:
    return tuple(
        links.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
    )


def components(links: DataFrame) -> DataFrame:
    """``node, root`` for every node with a link; ``root`` is the smallest node it can reach.

    ``links``: ``a, b`` (long), in any direction.
    """
    links = (
        links.where("a != b")
        .select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
        .distinct()
    )
    links = stage(links, "links")
    before = _state(links)
    while before[0]:
        large = _large_star(links).where("a != b").distinct()
        links = stage(_small_star(large).where("a != b").distinct(), "links")
        now = _state(links)
        if now == before:
            break
        before = now
    # Now every link points at its component's smallest node.
    leaves = links.select(F.col("a").alias("node"), F.col("b").alias("root"))
    roots = links.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct()
    return leaves.unionByName(roots)
