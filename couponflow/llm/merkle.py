"""A hash tree over all documents, with a proof of each document made by pointer jumping.

1. Leaves: the digest of a document's fields. Texts are read once; only digests move on.
2. Places: a leaf's position in its source, by ranges of (source, id), so a large source is spread.
3. Levels: 16 consecutive nodes become one, level by level, until each source has one node; the same again for
   the sources. A level is one aggregate over a sixteenth of the rows of the level below.
4. Proofs: each node starts with the segment of its siblings (what stands left and right of it in its run) and a
   pointer to its parent. A self-join of the nodes appends the segments of the node pointed to and takes over
   its pointer, so the distance covered doubles; rounds end when all pointers have reached the root. The leaves
   of a run share all of their proof but the first segment, so they are kept together, in rows of 16, and take
   over the path of their parent when it has reached the root.

In the join of a round, an ancestor at distance d is met by at most 16 ** d nodes. Ancestors that are few are broadcast
(at most 64 MB of segments, counted before); where they are more, d is small, so that no key is large.

Cases: a null field is ``-``; a null id comes first and a null source is a source, also first; equal ids are ordered
by their leaves and equal rows are interchangeable leaves; an empty table has no leaves and no root; a lone
leaf is its source's subroot, and a lone subroot is the root. Columns that are not asked for are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from couponflow.llm.ranges import placed, ranges_for
from couponflow.llm.tables import at_most
from couponflow.session import stage

FIELDS = ["doc_id", "source", "lang", "n_chars", "text"]
RUN = 16
#: Segments (of up to 1 KB) on the broadcast side of a self-join.
BROADCAST_SEGMENTS = 65_536
#: The tree over the subroots. Trees of sources are named ``s`` and the source, or ``n`` for null.
TOP = "t"
_SEGMENTS = "array<struct<left:string,right:string,top:boolean>>"


def digest(*parts: Column) -> Column:
    """Lowercase hex SHA-256 of the parts' UTF-8 bytes one after the other."""
    return F.sha2(F.concat(*parts), 256)


def record(fields: dict[str, Column]) -> Column:
    """Digest of named values, each with its length before it."""
    parts = []
    for value in fields.values():
        text = value.cast("string")
        size = F.octet_length(text).cast("string")
        parts.append(F.when(text.isNull(), F.lit("-")).otherwise(F.concat(size, F.lit(":"), text)))
    return digest(*parts)


@dataclass
class Manifest:
    #: Rows of up to 16 leaves with the same parent: ``tree, idx, members, digest, kids``.
    runs: DataFrame
    #: ``tree, level, idx, path``: segments from each node below the root up to the root.
    nodes: DataFrame
    #: None for an empty table.
    root: str | None


def _join(digests: Column) -> Column:
    return F.array_join(digests, "")


def _segment(digests: Column, place: Column, top: Column) -> Column:
    """What stands left and right of the digest at ``place`` (from 0) in its run."""
    return F.struct(
        _join(F.slice(digests, F.lit(1), place)).alias("left"),
        _join(F.slice(digests, place + 2, F.lit(RUN))).alias("right"),
        top.alias("top"),
    )


def fold(start: Column, path: Column) -> Column:
    """The digest reached from ``start`` by hashing it with the segments of ``path``, one after the other."""
    return F.aggregate(path, start, lambda done, s: digest(s["left"], done, s["right"]))


def _leaf_runs(docs: DataFrame, claim: dict[str, Column], ranges: int | None) -> DataFrame:
    own = {name: F.col(name) for name in FIELDS}
    leaves = stage(
        docs.select(
            F.when(F.col("source").isNull(), F.lit("n")).otherwise(F.concat(F.lit("s"), "source")).alias("tree"),
            "doc_id",
            record(own).alias("leaf"),
            record(own | claim).alias("claimed"),
            # Spreads equal rows over ranges.
            F.monotonically_increasing_id().alias("_tie"),
        ),
        "leaves",
    )
    rows = placed(leaves, "tree", ["doc_id", "leaf"], ranges or ranges_for(leaves.count()))
    kids = F.sort_array(F.collect_list(F.struct("place", "doc_id", "leaf", "claimed")))
    runs = rows.groupBy("tree", F.floor(F.col("place") / RUN).alias("idx")).agg(
        F.max("members").alias("members"), kids.alias("kids")
    )
    joined = digest(_join(F.col("kids.leaf")))
    lone = F.element_at("kids.leaf", 1)
    return stage(
        runs.select("tree", "idx", "members", "kids", F.when(F.col("members") == 1, lone).otherwise(joined).alias("digest")),
        "leaf-runs",
    )


def _climb(nodes: DataFrame, most: int) -> tuple[list[DataFrame], DataFrame]:
    """Levels above ``nodes`` (``tree, level, idx, digest, members``), and the one node on top of each tree.

    ``members``: nodes of the tree on that level; ``most``: of the largest tree. A level is a table of runs: the
    parent's ``tree, level, idx, digest, members`` and its ``kids`` (``place, tree, level, idx, digest``).
    """
    tops, levels = [nodes.where("members = 1")], []
    while most > 1:
        kid = F.struct(F.col("idx").alias("place"), "tree", "level", "idx", "digest")
        runs = (
            nodes.where("members > 1")
            .groupBy("tree", F.floor(F.col("idx") / RUN).alias("idx"))
            .agg(
                F.max("level").alias("level"),
                F.ceil(F.max("members") / RUN).alias("members"),
                F.sort_array(F.collect_list(kid)).alias("kids"),
            )
            .select(
                "tree", (F.col("level") + 1).alias("level"), "idx", "members", "kids", digest(_join(F.col("kids.digest"))).alias("digest")
            )
        )
        levels.append(stage(runs, "levels"))
        nodes = levels[-1].drop("kids")
        tops.append(nodes.where("members = 1"))
        most = -(-most // RUN)
    found = tops[0]
    for top in tops[1:]:
        found = found.unionByName(top)
    return levels, found


def _links(level: DataFrame, top: bool) -> DataFrame:
    """Each node below a run's parent: its name, its segment as a path, and the pointer to the parent."""
    place = F.col("place")
    return level.select("tree", "level", "idx", "kids", F.posexplode("kids").alias("place", "kid")).select(
        F.col("kid.tree").alias("tree"),
        F.col("kid.level").alias("level"),
        F.col("kid.idx").alias("idx"),
        F.array(_segment(F.col("kids.digest"), place, F.lit(top))).cast(_SEGMENTS).alias("path"),
        F.struct("tree", "level", "idx").alias("up"),
    )


def _jump(nodes: DataFrame, broadcast_segments: int) -> DataFrame:
    """Paths to the root by doubling. ``up`` is null where a path has arrived."""
    distance = 1
    while not at_most(nodes.where("up IS NOT NULL"), 0):
        # A node whose distance to a descendant is ``distance`` or more; levels start with 1.
        far = nodes.where((F.col("level") > distance) | (F.col("tree") == TOP)).select(
            F.struct("tree", "level", "idx").alias("up"), F.col("path").alias("rest"), F.col("up").alias("next")
        )
        if at_most(far, broadcast_segments // distance):
            far = F.broadcast(far)
        moved = nodes.where("up IS NOT NULL").join(far, "up")
        moved = moved.select("tree", "level", "idx", F.concat("path", "rest").alias("path"), F.col("next").alias("up"))
        nodes = stage(nodes.where("up IS NULL").unionByName(moved), "paths")
        distance *= 2
    return nodes.drop("up")


def build(
    docs: DataFrame,
    claim: dict[str, Column] | None = None,
    ranges: int | None = None,
    broadcast_segments: int = BROADCAST_SEGMENTS,
) -> Manifest:
    """The tree over ``docs``. ``claim``: fields as someone else holds them, whose digest is kept beside the leaf."""
    spark = docs.sparkSession
    runs = _leaf_runs(docs, claim or {}, ranges)
    largest = runs.agg(F.max("members")).first()[0]
    empty = spark.createDataFrame([], f"tree string, level long, idx long, path {_SEGMENTS}")
    if largest is None:
        return Manifest(runs, empty, None)
    first = runs.select(
        "tree", F.lit(1).cast("long").alias("level"), "idx", "digest", F.ceil(F.col("members") / RUN).alias("members")
    )
    levels, subroots = _climb(first, -(-largest // RUN))
    # The subroots, in order of their sources, are the lowest level of the tree on top.
    subroots = stage(subroots.select("tree", "level", "idx", "digest", F.lit(TOP).alias("over")), "subroots")
    trees = subroots.count()
    if trees == 1:
        root, top_levels = subroots.first(), []
    else:
        ranked = placed(subroots, "over", ["tree"], ranges or ranges_for(trees))
        lowest = F.struct("place", "tree", "level", "idx", "digest")
        level0 = stage(
            ranked.groupBy(F.lit(TOP).alias("tree"), F.floor(F.col("place") / RUN).alias("idx"))
            .agg(F.ceil(F.max("members") / RUN).alias("members"), F.sort_array(F.collect_list(lowest)).alias("kids"))
            .select("tree", F.lit(1).cast("long").alias("level"), "idx", "members", "kids", digest(_join(F.col("kids.digest"))).alias("digest")),
            "levels",
        )
        above, tops = _climb(level0.drop("kids"), -(-trees // RUN))
        root, top_levels = tops.first(), [level0, *above]
    links = [_links(level, False) for level in levels] + [_links(level, True) for level in top_levels]
    if not links:
        return Manifest(runs, empty, root["digest"])
    nodes = links[0]
    for more in links[1:]:
        nodes = nodes.unionByName(more)
    up = F.col("up")
    arrived = (up["tree"] == root["tree"]) & (up["level"] == root["level"]) & (up["idx"] == root["idx"])
    nodes = stage(nodes.withColumn("up", F.when(~arrived, up)), "paths")
    return Manifest(runs, _jump(nodes, broadcast_segments), root["digest"])


def proofs(manifest: Manifest) -> DataFrame:
    """``doc_id, leaf, claimed, subroot, root, path`` of every leaf; ``path``: segments from the leaf to the root."""
    parents = manifest.nodes.where("level = 1").withColumnRenamed("path", "above").drop("level").where(F.col("tree") != TOP)
    runs = manifest.runs.join(parents, ["tree", "idx"], "left")
    above = F.coalesce("above", F.array().cast(_SEGMENTS))
    inside = F.filter("above", lambda s: ~s["top"])
    rows = runs.select(
        "kids", "members", above.alias("above"), "digest"
    ).select("kids", "members", "above", fold(F.col("digest"), inside).alias("subroot"), F.posexplode("kids").alias("place", "kid"))
    own = F.when(
        F.col("members") > 1, F.array(_segment(F.col("kids.leaf"), F.col("place"), F.lit(False)))
    ).otherwise(F.array()).cast(_SEGMENTS)
    return rows.select(
        "kid.doc_id", "kid.leaf", "kid.claimed", "subroot", F.lit(manifest.root).alias("root"), F.concat(own, "above").alias("path")
    )


def verify(found: DataFrame) -> DataFrame:
    """``found`` (see :func:`proofs`) with ``proof_sha256``, ``folded_root`` of the claimed leaf, and ``verified``."""
    siblings = _join(F.transform("path", lambda s: F.concat(s["left"], s["right"])))
    folded = found.select(
        "doc_id", "leaf", "subroot", "root", F.sha2(siblings, 256).alias("proof_sha256"), fold(F.col("claimed"), F.col("path")).alias("folded_root")
    )
    return folded.withColumn("verified", F.col("folded_root") == F.col("root"))
