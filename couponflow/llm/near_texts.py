"""Near-duplicate texts: five-word Jaccard similarity of at least 0.8, checked exactly.

A text's set is the XXH64 hashes of its ``SHINGLE``-word shingles (words and hashes as in
:mod:`couponflow.llm.simhash`). Two texts are linked if their sets' similarity is ``SIMILAR`` or more.
64-bit fingerprints cannot find such pairs: they differ in up to about 16 bits, where tiles skip nothing.

1. Texts with one set are one node from here on.
2. Candidates: ``BANDS`` keys a set, each of ``BAND_ROWS`` minima under keyed orders of the hashes. A pair of
   similarity s shares a key with probability 1 - (1 - s ** 7) ** 40: 0.99992 at 0.8, 0.27 at 0.5.
3. Leaders. Each node is compared in full with the smallest node of each of its keys, so a group of near copies costs
   one comparison a node.
4. Tiles. Where a key still has nodes of several components, its nodes are dealt into blocks of about ``BLOCK_NODES`` by
   hash, with their sets, and every two blocks of a key meet in one row. All intersections of a tile come from one
   product of a small matrix over the hashes that occur twice in it; pairs of one component are left out, as they are
   linked already. No pair becomes a row unless it is a link.
5. Components of the links (see :mod:`couponflow.llm.components`). With a ``radius``, texts whose fingerprints (see
   :mod:`couponflow.llm.simhash`) differ in so many bits or fewer are linked as well, found by the tiles of that module: these
   are texts that say the same most of the time, whatever the sets of their shingles.

Cases: null, empty and wordless texts are one group; fewer than five words form one shingle; equal rows get
equal rows; an empty table gives no rows. Tiles of a key grow with the square of its blocks, where its texts are not
similar to its leader.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from couponflow.llm import simhash
from couponflow.llm.components import components
from couponflow.llm.simhash import SEED, one_of_each, shingle_hashes
from couponflow.llm.tables import slices, small_side
from couponflow.session import settings, stage

SHINGLE = 5
#: The least similarity of a link, as a fraction.
SIMILAR = (4, 5)
BANDS = 40
BAND_ROWS = 7
#: Hashes whose minima are taken at a time.
MIN_BLOCK = 512
#: Pairs of texts a Python task holds at a time.
CHECK_ROWS = 500
#: Nodes and hashes of a block (about), hashes of a tile that are compared at a time, and tiles a Python task holds at a time.
BLOCK_NODES = 200
BLOCK_HASHES = 1 << 17
MATRIX_COLUMNS = 1 << 14
TILES_AT_ONCE = 16
#: Odd factors of the orders, and of the minima in a key.
_FACTORS = np.random.default_rng(SEED).integers(0, 1 << 63, (2, BANDS * BAND_ROWS), dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def shingle_set(text: str | None) -> np.ndarray:
    """Sorted distinct hashes of a text's shingles."""
    blocks = list(shingle_hashes(text, SHINGLE))
    return np.unique(np.concatenate(blocks)) if blocks else np.empty(0, np.uint64)


def node(hashes: np.ndarray) -> int:
    """Unsigned digest of a set; 0 for the empty one."""
    return xxhash.xxh64_intdigest(hashes.tobytes(), SEED) if len(hashes) else 0


def keys(hashes: np.ndarray) -> np.ndarray:
    """The band keys of a set; none for the empty one."""
    if not len(hashes):
        return np.empty(0, np.uint64)
    least = np.full(BANDS * BAND_ROWS, np.iinfo(np.uint64).max, dtype=np.uint64)
    for at in range(0, len(hashes), MIN_BLOCK):
        np.minimum(least, (_FACTORS[0][:, None] * hashes[None, at : at + MIN_BLOCK]).min(axis=1), out=least)
    return (least * _FACTORS[1]).reshape(BANDS, BAND_ROWS).sum(axis=1, dtype=np.uint64)


def similar(a: np.ndarray, b: np.ndarray) -> bool:
    """Whether the sets' Jaccard similarity is at least ``SIMILAR``."""
    times, of = SIMILAR
    if of * min(len(a), len(b)) < times * max(len(a), len(b)):
        return False
    shared = len(np.intersect1d(a, b, assume_unique=True))
    return of * shared >= times * (len(a) + len(b) - shared)


def sets(docs: DataFrame, *keep: str) -> DataFrame:
    """The columns ``keep``, ``node`` (the set's digest as a signed long), its size ``n`` and its ``keys``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            found = []
            for text in batch.column("text"):
                hashes = shingle_set(text.as_py())
                found.append((node(hashes), len(hashes), keys(hashes).view(np.int64)))
            nodes, sizes, bands = zip(*found, strict=True) if found else ((), (), ())
            made = [
                pa.array(np.array(nodes, dtype=np.uint64).view(np.int64)),
                pa.array(sizes, pa.int64()),
                pa.array(bands, pa.list_(pa.int64())),
            ]
            others = [c for c in batch.schema.names if c != "text"]
            columns = [batch.column(c) for c in others]
            yield pa.record_batch([*columns, *made], names=[*others, "node", "n", "keys"])

    rows = docs.select("text", *keep)
    kinds = [f"{f.name} {f.dataType.simpleString()}" for f in rows.schema if f.name != "text"]
    return rows.mapInArrow(run, ", ".join([*kinds, "node long", "n long", "keys array<long>"]))


def _check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    known = lru_cache(16)(shingle_set)
    for batch in slices(batches):
        ends = zip(batch.column("text_a"), batch.column("text_b"), strict=True)
        linked = pa.array([similar(known(a.as_py()), known(b.as_py())) for a, b in ends], pa.bool_())
        yield batch.select(["a", "b"]).filter(linked)


def _near_in_size(a: Column, b: Column) -> Column:
    """Whether sets of these sizes can be similar."""
    times, of = SIMILAR
    return of * F.least(a, b) >= times * F.greatest(a, b)


def checked(pairs: DataFrame, texts: DataFrame, name: str) -> DataFrame:
    """The pairs ``a, b`` of nodes that are similar; ``texts``: ``node, text`` of all of them."""
    for end in ("b", "a"):
        pairs = pairs.join(texts.select(F.col("node").alias(end), F.col("text").alias(f"text_{end}")), end)
    linked = pairs.select("a", "b", "text_a", "text_b").mapInArrow(_check, "a long, b long")
    # Two whole texts a row, so fewer rows at a time.
    with settings(pairs.sparkSession, {"spark.sql.execution.arrow.maxRecordsPerBatch": str(CHECK_ROWS)}):
        return stage(linked, name)


def links(docs: DataFrame, rows: DataFrame) -> DataFrame:
    """``a, b``: links that connect all nodes that share a key and are similar.

    ``docs``: ``_id, _row, text``. ``rows``: ``_id, _row, node, n, keys``.
    """
    members = rows.select("node", "n", "keys").dropDuplicates(["node"])
    members = members.select("node", "n", F.explode("keys").alias("key"))
    shared = members.groupBy("key").agg(F.min("node").alias("leader"), F.max("node").alias("_last"))
    shared = stage(shared.where("leader < _last").drop("_last"), "shared-keys")
    inside = stage(members.join(shared, "key"), "key-members")

    wanted = inside.select("node").distinct()
    rank = F.min(F.struct("_id", "_row")).alias("at")
    places = rows.join(wanted, "node", "left_semi").groupBy("node", "n").agg(rank).select("node", "n", "at.*")
    places = stage(places, "near-places")
    texts = docs.select("_id", "_row", "text").join(small_side(places.drop("n")), ["_id", "_row"])
    texts = stage(texts.select("node", "text").dropDuplicates(["node"]), "near-texts")

    first = inside.where("node != leader").select(F.col("leader").alias("a"), F.col("node").alias("b"), "n").distinct()
    leaders = places.select(F.col("node").alias("a"), F.col("n").alias("n_a"))
    first = first.join(leaders, "a").where(_near_in_size(F.col("n_a"), F.col("n"))).select("a", "b")
    first = stage(first, "first-pairs")
    found = checked(first, texts, "first-links")
    roots = stage(components(found), "first-groups")
    placed = inside.join(roots, "node", "left").select("key", "node", "n", F.coalesce("root", "node").alias("root"))
    placed = stage(placed, "placed-members")
    mixed = placed.groupBy("key").agg(
        F.min("root").alias("_low"),
        F.max("root").alias("_high"),
        F.greatest(F.ceil(F.count(F.lit(1)) / BLOCK_NODES), F.ceil(F.sum("n") / BLOCK_HASHES)).alias("_blocks"),
    )
    mixed = mixed.where("_low < _high").select("key", "_blocks")
    left = stage(placed.join(mixed, "key"), "mixed-members")
    return found.unionByName(tiled(left, hash_sets(texts.join(left.select("node").distinct(), "node", "left_semi"))))


def hash_sets(texts: DataFrame) -> DataFrame:
    """``node, hashes`` (a set's sorted hashes as bytes)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            found = [shingle_set(text.as_py()).tobytes() for text in batch.column("text")]
            yield pa.record_batch([batch.column("node"), pa.array(found, pa.binary())], names=["node", "hashes"])

    return stage(texts.select("node", "text").mapInArrow(run, "node long, hashes binary"), "hash-sets")


def intersections(left: list[np.ndarray], right: list[np.ndarray]) -> np.ndarray:
    """Sizes of the intersections of every set of ``left`` with every one of ``right``."""
    sizes = np.array([len(x) for x in (*left, *right)])
    owners = np.repeat(np.arange(len(sizes)), sizes)
    order = np.argsort(values := np.concatenate([*left, *right]), kind="stable")
    values, owners = values[order], owners[order]
    new = np.flatnonzero(np.concatenate([[True], values[1:] != values[:-1]])) if len(values) else np.empty(0, int)
    ends = np.append(new[1:], len(values))
    # Hashes of one set only are in no intersection.
    shared = ends - new > 1
    column = np.repeat(np.cumsum(shared) - 1, ends - new)
    kept = np.repeat(shared, ends - new)
    column, owners = column[kept], owners[kept]
    total = np.zeros((len(left), len(right)), dtype=np.int64)
    for start in range(0, int(shared.sum()), MATRIX_COLUMNS):
        inside = (column >= start) & (column < start + MATRIX_COLUMNS)
        matrix = np.zeros((len(sizes), MATRIX_COLUMNS), dtype=np.float32)
        matrix[owners[inside], column[inside] - start] = 1
        total += (matrix[: len(left)] @ matrix[len(left) :].T).astype(np.int64)
    return total


def tiled(members: DataFrame, sets: DataFrame) -> DataFrame:
    """``a, b``: all links inside a key between nodes of different components.

    ``members``: ``key, node, root, _blocks``; ``sets``: ``node, hashes``.
    """
    block = F.pmod(F.xxhash64("node", "key"), F.col("_blocks")).alias("block")
    dealt = members.select("key", "node", "root", "_blocks", block).join(sets, "node")
    inside = F.collect_list(F.struct("node", "root", "hashes"))
    blocks = stage(dealt.groupBy("key", "block").agg(F.first("_blocks").alias("_blocks"), inside.alias("inside")), "blocks")
    # By the second block, so that the tiles of a large key are spread.
    first = blocks.select("key", F.explode(F.sequence("block", F.col("_blocks") - 1)).alias("other"), "inside")
    second = blocks.select("key", F.col("block").alias("other"), F.col("inside").alias("theirs"))
    tiles = first.join(second, ["key", "other"]).select("inside", "theirs")
    times, of = SIMILAR

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            for ours, theirs in zip(batch.column("inside"), batch.column("theirs"), strict=True):
                a, b = ours.as_py(), theirs.as_py()
                left, right = ([np.frombuffer(x["hashes"], np.uint64) for x in side] for side in (a, b))
                shared = intersections(left, right)
                total = np.array([len(x) for x in left])[:, None] + np.array([len(x) for x in right])[None, :]
                apart = np.array([x["root"] for x in a])[:, None] != np.array([x["root"] for x in b])[None, :]
                rows, columns = np.nonzero(apart & (of * shared >= times * (total - shared)))
                ends = [pa.array([side[i]["node"] for i in at], pa.int64()) for side, at in ((a, rows), (b, columns))]
                yield pa.record_batch(ends, names=["a", "b"])

    with settings(members.sparkSession, {"spark.sql.execution.arrow.maxRecordsPerBatch": str(TILES_AT_ONCE)}):
        return stage(tiles.mapInArrow(run, "a long, b long"), "tile-links")


def fingerprint_links(marked: DataFrame, rows: DataFrame, radius: int) -> DataFrame:
    """``a, b``: links that connect all nodes with fingerprints within ``radius``; ``rows``: ``_id, _row, node``."""
    fps = stage(simhash.fingerprints(marked, "_id", "_row").drop("doc_id").dropDuplicates(["_id", "_row"]), "fingerprints")
    placed = stage(rows.select("_id", "_row", "node").join(fps, ["_id", "_row"]).select("fp", "node").distinct(), "fingerprint-nodes")
    first = stage(placed.groupBy("fp").agg(F.min("node").alias("first")), "fingerprint-firsts")
    same = placed.join(first, "fp").select(F.col("first").alias("a"), F.col("node").alias("b"))
    near = stage(simhash.links(first.select("fp"), radius), "fingerprint-links")
    for end in ("a", "b"):
        near = near.join(first.select(F.col("fp").alias(end), F.col("first").alias(f"node_{end}")), end)
    return same.unionByName(near.select(F.col("node_a").alias("a"), F.col("node_b").alias("b")))


def deduplicate(docs: DataFrame, radius: int | None = None) -> DataFrame:
    """One document of each component, with all its columns, chosen as in :func:`simhash.deduplicate`.

    With ``radius``, links of fingerprints count as well as those of shingle sets.
    """

    def groups(marked: DataFrame) -> tuple[DataFrame, DataFrame]:
        rows = stage(sets(marked, "doc_id", "_id", "_row"), "shingle-sets")
        ends = links(marked, rows)
        found = components(ends if radius is None else ends.unionByName(fingerprint_links(marked, rows, radius)))
        nodes = rows.select("node").distinct().join(found, "node", "left")
        return rows.drop("keys"), nodes.select("node", F.coalesce("root", "node").alias("group"))

    return one_of_each(docs, groups, "node")
