"""SimHash near-duplicates: exact tiled comparison of fingerprints.

A fingerprint has bit i set if bit i is set in over half of the XXH64 hashes of the text's 3-word
shingles. Texts are linked if their fingerprints differ in at most ``RADIUS`` bits.

1. Fingerprints of all texts, one text at a time; equal ones are grouped, so that a group of copies is
   one fingerprint from here on.
2. Tiles. A fingerprint's tile is the population counts of its four 16-bit parts. The sum of the
   parts' count differences is never above the number of differing bits, so only tiles whose
   counts differ by at most the radius can hold a link; all other tile pairs are skipped (a finer
   form of comparing the total counts). Tiles are cut into chunks of about ``CHUNK`` fingerprints.
3. Each pair of chunks left is one row: two arrays, compared in numpy by exclusive or and bit counts,
   a block of rows at a time. A pair returns a spanning forest of its links, never all of them.
4. Components of the links (see :mod:`couponflow.llm.components`).

Cases: a null, empty or wordless text has fingerprint 0 and links like any other; fewer than three
words form one shingle; equal rows get equal rows; null ids are never a component's id unless it has no
other; an empty table gives no rows. Extra columns are ignored by :func:`duplicates` and kept by
:func:`deduplicate`.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from couponflow.llm.components import components
from couponflow.session import stage

RADIUS = 2
SHINGLE = 3
SEED = 42
CHUNK = 4096
PARTS = 4
PART_BITS = 64 // PARTS
#: Shingles whose bits are counted at a time, and fingerprints compared with a chunk at a time.
COUNT_BLOCK = 1 << 15
COMPARE_BLOCK = 256


def shingle_hashes(text: str | None, length: int = SHINGLE) -> Iterator[np.ndarray]:
    """XXH64 of each run of ``length`` words, in order, a block at a time; none for a wordless text."""
    found = text.encode().lower().split() if text else []
    if not found:
        return
    joined = b" ".join(found)
    if len(found) <= length:
        starts, ends = [0], [len(joined)]
    else:
        blanks = np.flatnonzero(np.frombuffer(joined, np.uint8) == 32)
        starts = [0, *(blanks[: len(blanks) + 1 - length] + 1).tolist()]
        ends = [*blanks[length - 1 :].tolist(), len(joined)]
    digest = xxhash.xxh64_intdigest
    for at in range(0, len(starts), COUNT_BLOCK):
        pieces = zip(starts[at : at + COUNT_BLOCK], ends[at : at + COUNT_BLOCK], strict=True)
        yield np.array([digest(joined[s:e], SEED) for s, e in pieces], dtype="<u8")


def fingerprint(text: str | None) -> int:
    """Unsigned fingerprint of a text."""
    ones, n = np.zeros(64, dtype=np.int64), 0
    for hashes in shingle_hashes(text):
        bits = np.unpackbits(hashes.view(np.uint8), bitorder="little").reshape(-1, 64)
        ones += bits.sum(axis=0, dtype=np.int64)
        n += len(hashes)
    over_half = 2 * ones > n
    return int(np.packbits(over_half, bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, *keep: str) -> DataFrame:
    """``doc_id``, the columns ``keep``, and ``fp`` (the fingerprint's 64 bits as a signed long)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps = np.array([fingerprint(t) for t in batch.column("text").to_pylist()], dtype=np.uint64)
            others = [c for c in batch.schema.names if c != "text"]
            columns = [batch.column(c) for c in others]
            yield pa.record_batch([*columns, pa.array(fps.view(np.int64))], names=[*others, "fp"])

    rows = docs.select(F.col("doc_id").cast("long"), "text", *keep)
    kinds = [f"{f.name} {f.dataType.simpleString()}" for f in rows.schema if f.name != "text"]
    return rows.mapInArrow(run, ", ".join([*kinds, "fp long"]))


def _part_counts(fp: str = "fp"):
    mask = (1 << PART_BITS) - 1
    return [
        F.bit_count(F.shiftrightunsigned(F.col(fp), PART_BITS * i).bitwiseAND(F.lit(mask))).cast("int")
        for i in range(PARTS)
    ]


def _tile(counts) -> F.Column:
    """One number for the counts; ordered like them."""
    key = F.lit(0)
    for c in counts:
        key = key * (PART_BITS + 1) + c
    return key.cast("int")


def neighbours(radius: int) -> list[tuple[int, ...]]:
    """Count differences of total size up to ``radius``, each pair of directions once (and zero)."""
    found = [()]
    for _ in range(PARTS):
        found = [(*f, d) for f in found for d in range(-radius, radius + 1)]
    return [f for f in found if sum(map(abs, f)) <= radius and f >= (0,) * PARTS]


def linked(a: np.ndarray, b: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """A forest over the links between ``a`` and ``b`` (unsigned): same components, fewer links."""
    ends: list[np.ndarray] = []
    for at in range(0, len(a), COMPARE_BLOCK):
        block = a[at : at + COMPARE_BLOCK]
        close = np.bitwise_count(block[:, None] ^ b[None, :]) <= radius
        rows, cols = np.nonzero(close)
        if not len(rows):
            continue
        # Every column a row links is joined to the row's first column; equal ones once.
        first = cols[np.searchsorted(rows, rows)]
        pairs = np.unique(first * len(b) + cols)
        ends.append(np.stack([b[pairs // len(b)], b[pairs % len(b)]]))
        own, where = np.unique(rows, return_index=True)
        ends.append(np.stack([block[own], b[cols[where]]]))
    if not ends:
        return np.empty(0, np.uint64), np.empty(0, np.uint64)
    u, v = np.concatenate(ends, axis=1)
    return _forest(u[u != v], v[u != v])


def _forest(u: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each node and the smallest node of its component, for those that are not it."""
    nodes, places = np.unique(np.concatenate([u, v]), return_inverse=True)
    left, right = places[: len(u)], places[len(u) :]
    root = np.arange(len(nodes))
    while len(left):
        low = np.minimum(root[left], root[right])
        before = root.copy()
        np.minimum.at(root, root[left], low)
        np.minimum.at(root, root[right], low)
        root = root[root]
        if np.array_equal(root, before):
            break
    moved = root != np.arange(len(nodes))
    return nodes[moved], nodes[root[moved]]


def _compare(radius: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b in zip(batch.column("left"), batch.column("right"), strict=True):
                a, b = (np.asarray(x.values).view(np.uint64) for x in (a, b))
                u, v = linked(a, b, radius)
                if len(u):
                    yield pa.record_batch(
                        [pa.array(u.view(np.int64)), pa.array(v.view(np.int64))], names=["a", "b"]
                    )

    return run


def links(fps: DataFrame, radius: int = RADIUS, chunk: int = CHUNK) -> DataFrame:
    """``a, b``: links that connect all fingerprints within ``radius`` of each other.

    ``fps``: distinct ``fp`` (long).
    """
    tiled = fps.select("fp", _tile(_part_counts()).alias("tile"))
    # At most (PART_BITS + 1) ** PARTS = 83,521 rows, whatever the input.
    sizes = stage(
        tiled.groupBy("tile").agg(F.ceil(F.count(F.lit(1)) / chunk).cast("int").alias("chunks")), "tiles"
    )
    placed = tiled.join(F.broadcast(sizes), "tile").withColumn(
        "chunk", F.pmod(F.xxhash64("fp"), F.col("chunks")).cast("int")
    )
    chunks = stage(
        placed.groupBy("tile", "chunk").agg(F.collect_list("fp").alias("fps")), "tile-chunks"
    )
    steps = F.array(
        *[F.struct(*[F.lit(d).alias(f"d{i}") for i, d in enumerate(n)]) for n in neighbours(radius)]
    )
    counts = _part_counts("_one")
    moved = [c + F.col(f"_step.d{i}") for i, c in enumerate(counts)]
    inside = [(c >= 0) & (c <= PART_BITS) for c in moved]
    allowed = inside[0]
    for more in inside[1:]:
        allowed = allowed & more
    wanted = (
        chunks.withColumn("_one", F.get("fps", F.lit(0)))
        .withColumn("_step", F.explode(steps))
        .where(allowed)
        .select(
            F.col("tile").alias("own_tile"),
            F.col("chunk").alias("own_chunk"),
            F.col("fps").alias("left"),
            _tile(moved).alias("tile"),
        )
        .join(F.broadcast(sizes), "tile")
        # One row per chunk of the other tile; a pair inside one tile is taken once.
        .withColumn("chunk", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)))
        .where((F.col("tile") != F.col("own_tile")) | (F.col("chunk") >= F.col("own_chunk")))
    )
    others = chunks.select("tile", "chunk", F.col("fps").alias("right"))
    pairs = wanted.select("tile", "chunk", "left").join(others, ["tile", "chunk"])
    return pairs.select("left", "right").mapInArrow(_compare(radius), "a long, b long")


def groups(rows: DataFrame, radius: int = RADIUS) -> DataFrame:
    """``fp, group`` for every distinct fingerprint of ``rows``: the group's smallest fingerprint."""
    fps = stage(rows.select("fp").distinct(), "fingerprints")
    found = components(links(fps, radius))
    return fps.join(found, fps.fp == found.node, "left").select("fp", F.coalesce("root", "fp").alias("group"))


def duplicates(docs: DataFrame, radius: int = RADIUS) -> DataFrame:
    """``doc_id, fp, component_id`` of every document; the id is the smallest of its component."""
    rows = stage(fingerprints(docs), "simhash")
    by_fp = rows.groupBy("fp").agg(F.min("doc_id").alias("first"))
    members = stage(groups(rows, radius).join(by_fp, "fp"), "simhash-groups")
    named = members.groupBy("group").agg(F.min("first").alias("component_id"))
    names = members.join(named, "group").select("fp", "component_id")
    return rows.join(names, "fp").select("doc_id", "fp", "component_id")


def one_of_each(docs: DataFrame, groups_of: Callable[[DataFrame], tuple[DataFrame, DataFrame]], node: str) -> DataFrame:
    """The document with the smallest id of each group, with all its columns.

    Among rows with that id the one with the smallest row hash stays, and equal rows stay once.
    ``groups_of`` takes the documents with ``_id`` and ``_row`` and returns a table with ``doc_id``, ``_id``,
    ``_row`` and ``node`` of each, and one with ``node`` and ``group``.
    """
    row_hash = F.xxhash64(*[F.col(f"`{c}`") for c in docs.columns])
    marked = docs.withColumns({"_row": row_hash, "_id": F.coalesce("doc_id", F.lit(0)).cast("long")})
    rows, found = groups_of(marked)
    # Null ids last.
    rank = F.struct(F.col("doc_id").isNull().alias("no_id"), "_id", "_row")
    by_node = rows.groupBy(node).agg(F.min(rank).alias("first"))
    chosen = found.join(by_node, node).groupBy("group").agg(F.min("first").alias("first"))
    chosen = stage(chosen.select("first._id", "first._row"), "kept-documents")
    # The join leaves equal rows together, so that dropping repeats moves nothing again.
    kept = marked.join(chosen, ["_id", "_row"]).dropDuplicates(["_id", "_row"])
    return kept.select(*[docs[c] for c in docs.columns])


def deduplicate(docs: DataFrame, radius: int = RADIUS) -> DataFrame:
    """One document of each component of links (see :func:`one_of_each`)."""

    def found(marked: DataFrame) -> tuple[DataFrame, DataFrame]:
        rows = stage(fingerprints(marked, "_id", "_row"), "simhash")
        return rows, groups(rows, radius)

    return one_of_each(docs, found, "fp")
