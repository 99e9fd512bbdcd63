"""Cross-entropy difference: how much better a target model predicts a document than a background one.

Both models are word bigram models with the same orders, smoothing and vocabulary: every distinct word of the
corpus (lower-cased), and one more for words never seen. The background model counts all documents, the
target model those where a condition holds. Counts are exact and have no cap: they grow with the corpus and
so are never collected or broadcast.

1. Blocks. Each task packs its documents into blocks of about ``BLOCK_WORDS`` words: the block's
   distinct words as 64-bit hashes, and each document as numbers into them. A document is never split.
2. Ask. A block's distinct words and pairs (its cells) with their counts, sorted by hash, are cut at the borders
   of equal hash ranges. There is one range for every ``RANGE_WORDS`` words of the corpus.
3. Count. Each range adds up the counts of its cells and answers every block, in the order in which it asked.
   A cell is in a range at most once for a block, however often it occurs: a word that is everywhere has
   16 million entries (some hundred MB) for 100 TB of text.
4. Score. A block meets its answers, which are bounded by its own words, and scores its documents in numpy.

Sorted hashes are sent as differences, and all numbers as planes of bytes, compressed.

A word has the loss -log(PAIR * pair share + (1 - PAIR) * word share). The pair share is the part of the first
word's occurrences that this word follows; it is left out (PAIR = 0) for the first word of a document and
after a word the model has never seen. The word share is (1 - EQUAL) * part of all words + EQUAL / size
of the vocabulary. The score of a document is the mean over its words of (loss under the target model -
loss under the background model), in nats; below zero it is nearer to the target.

Cells are told apart by 64-bit hashes; two of n cells share one with a chance of about n * n / 2 ** 64.

Cases: a null or wordless text has no words and score 0; texts of any length are read whole; equal rows
count each; without target rows the target model gives all words an equal share; a null condition
is false; an empty table gives no rows. Extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from couponflow.session import stage

#: Weight of the pair's share, and of the equal share inside the word's share.
PAIR = 0.5
EQUAL = 0.1
BLOCK_WORDS = 1 << 20
RANGE_WORDS = 1 << 20
_MIX = (np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F), np.uint64(0xFF51AFD7ED558CCD))

_BLOCK = {
    "block": pa.int64(),
    "size": pa.int64(),
    "target_size": pa.int64(),
    "doc_ids": pa.list_(pa.int64()),
    "lengths": pa.list_(pa.int64()),
    "targets": pa.list_(pa.bool_()),
    "hashes": pa.binary(),
    "numbers": pa.binary(),
}
_BLOCK_SCHEMA = (
    "block long, size long, target_size long, doc_ids array<long>, lengths array<long>, targets array<boolean>, "
    "hashes binary, numbers binary"
)


def _planes(values: np.ndarray) -> bytes:
    """All first bytes, then all second ones, and so on, compressed."""
    return zstandard.compress(values.view(np.uint8).reshape(-1, values.itemsize).T.tobytes(), 1)


def _unplaned(data: bytes, kind: type) -> np.ndarray:
    planes = np.frombuffer(zstandard.decompress(data), np.uint8).reshape(np.dtype(kind).itemsize, -1)
    return np.ascontiguousarray(planes.T).view(kind).ravel()


def pack(docs: DataFrame, target: Column) -> DataFrame:
    """Blocks of documents (see ``_BLOCK_SCHEMA``): lengths and targets per document, the numbers of all.

    ``size`` and ``target_size``: words of the block, and of its target documents.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block = TaskContext.get().partitionId() << 32
        size = 0
        index: dict[bytes, int] = {}
        ids, lengths, targets, numbers = [], [], [], []

        def packed() -> pa.RecordBatch:
            # Words have even hashes, pairs odd ones.
            hashes = np.fromiter(map(xxhash.xxh64_intdigest, index), np.uint64, len(index)) & ~np.uint64(1)
            good = sum(n for n, is_target in zip(lengths, targets, strict=True) if is_target)
            number = _planes(np.concatenate(numbers))
            row = (block, sum(lengths), good, ids, lengths, targets, hashes.tobytes(), number)
            columns = [pa.array([v], k) for v, k in zip(row, _BLOCK.values(), strict=True)]
            return pa.record_batch(columns, names=[*_BLOCK])

        for batch in batches:
            texts = batch.column("text").cast(pa.binary())
            rows = zip(batch.column("doc_id").to_pylist(), texts, batch.column("target").to_pylist(), strict=True)
            for doc_id, text, is_target in rows:
                found = (text.as_py() or b"").lower().split()
                own = np.fromiter((index.setdefault(w, len(index)) for w in found), np.uint32, len(found))
                ids.append(doc_id)
                lengths.append(len(found))
                targets.append(is_target)
                numbers.append(own)
                # Documents without words take room, too.
                size += len(found) + 1
                if size >= BLOCK_WORDS:
                    yield packed()
                    block, size, index = block + 1, 0, {}
                    ids, lengths, targets, numbers = [], [], [], []
        if ids:
            yield packed()

    rows = docs.select(
        F.col("doc_id").cast("long"), "text", F.coalesce(target, F.lit(False)).alias("target")
    )
    return rows.mapInArrow(run, _BLOCK_SCHEMA)


@dataclass
class Cells:
    """The words and pairs of one block, with their counts in the block.

    ``cell``, ``target`` and ``every`` list the words by number, then the distinct pairs; ``number`` is the
    word at each place of the block, ``pair`` the cell of the pair that ends there (-1 at the start of a
    document), ``doc`` the document it is in, ``order`` sorts the cells.
    """

    cell: np.ndarray
    target: np.ndarray
    every: np.ndarray
    number: np.ndarray
    pair: np.ndarray
    doc: np.ndarray
    order: np.ndarray

    @staticmethod
    def of(row: dict) -> Cells:
        words = np.frombuffer(row["hashes"], np.uint64)
        number = _unplaned(row["numbers"], np.uint32)
        doc = np.repeat(np.arange(len(row["lengths"]), dtype=np.uint32), row["lengths"])
        good = np.array(row["targets"], dtype=bool)[doc]
        inside = np.flatnonzero(doc[1:] == doc[:-1]) + 1
        code = number[inside - 1] * np.int64(len(words)) + number[inside]
        distinct, which = np.unique(code, return_inverse=True)
        del code
        pair = np.full(len(number), -1, dtype=np.int32)
        pair[inside] = len(words) + which
        first, second = (words[i] for i in np.divmod(distinct, max(len(words), 1)))
        mixed = first * _MIX[0] + second * _MIX[1]
        mixed = (mixed ^ (mixed >> np.uint64(32))) * _MIX[2]
        mixed = (mixed ^ (mixed >> np.uint64(29))) | np.uint64(1)
        sizes = len(words), len(distinct)
        every = np.bincount(number, minlength=sizes[0]), np.bincount(which, minlength=sizes[1])
        of_target = number[good], which[good[inside]]
        target = [np.bincount(v, minlength=n) for v, n in zip(of_target, sizes, strict=True)]
        cell = np.concatenate((words, mixed))
        counts = (np.concatenate(v).astype(np.int64) for v in (target, every))
        return Cells(cell, *counts, number, pair, doc, np.argsort(cell, kind="stable"))

    def losses(self, counts: np.ndarray, total: int, vocabulary: int) -> np.ndarray:
        """Loss of every word under the model of ``counts``, one for each cell."""
        share = counts[self.number] / total if total else np.full(len(self.number), 1 / vocabulary)
        share = (1 - EQUAL) * share + EQUAL / vocabulary
        before = np.concatenate(([0], counts[self.number[:-1]]))
        paired = (self.pair >= 0) & (before > 0)
        by_pair = np.where(paired, counts[self.pair] / np.maximum(before, 1), share)
        return -np.log(PAIR * by_pair + (1 - PAIR) * share)


def ask(blocks: DataFrame, ranges: int) -> DataFrame:
    """``range, block, cells, target, every``: cells of a block in a hash range, and their counts there."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                own = Cells.of({name: batch.column(name)[i].as_py() for name in _BLOCK})
                cell, target, every = (v[own.order] for v in (own.cell, own.target, own.every))
                place = (cell >> np.uint64(32)) * np.uint64(ranges) >> np.uint64(32)
                used, starts = np.unique(place, return_index=True)
                ends = np.append(starts, len(cell))[1:]
                block = batch.column("block")[i].as_py()
                for number, at, end in zip(used.tolist(), starts, ends, strict=True):
                    steps = np.diff(cell[at:end], prepend=np.uint64(0))
                    parts = [_planes(v) for v in (steps, target[at:end], every[at:end])]
                    row = [[number], [block], *([p] for p in parts)]
                    yield pa.record_batch(row, names=["range", "block", "cells", "target", "every"])

    return blocks.mapInArrow(run, "range long, block long, cells binary, target binary, every binary")


def _answer(asked: pa.Table) -> pa.Table:
    """Counts of the whole corpus for the cells each block asked for, and the range's words (in one row)."""
    cells = [np.cumsum(_unplaned(c, np.uint64), dtype=np.uint64) for c in asked.column("cells").to_pylist()]
    ends = np.cumsum([len(c) for c in cells])
    distinct, which = np.unique(np.concatenate(cells), return_inverse=True)
    # Words have even hashes.
    n_words = int((distinct & np.uint64(1) == 0).sum())
    table = {
        "block": asked.column("block"),
        "range": asked.column("range"),
        "n_words": pa.array([n_words] + [0] * (len(cells) - 1), pa.int64()),
    }
    for name in ("target", "every"):
        own = np.concatenate([_unplaned(c, np.int64) for c in asked.column(name).to_pylist()])
        total = np.zeros(len(distinct), dtype=np.int64)
        np.add.at(total, which, own)
        table[name] = pa.array([_planes(v) for v in np.split(total[which], ends[:-1])], pa.binary())
    return pa.table(table)


def score(docs: DataFrame, target: Column) -> DataFrame:
    """``doc_id, n_words, target_loss, background_loss, difference`` of every document.

    ``target``: the documents the target model learns from. All documents make the background.
    """
    blocks = stage(pack(docs, target), "lm-blocks")
    of_target, of_all = blocks.agg(
        F.coalesce(F.sum("target_size"), F.lit(0)), F.coalesce(F.sum("size"), F.lit(0))
    ).first()
    ranges = -(-of_all // RANGE_WORDS) or 1
    answers = ask(blocks, ranges).groupBy("range").applyInArrow(
        _answer, "block long, range long, n_words long, target binary, every binary"
    )
    answers = stage(answers, "lm-answers")
    vocabulary = answers.agg(F.coalesce(F.sum("n_words"), F.lit(0))).first()[0] + 1

    def run(block: pa.Table, answer: pa.Table) -> pa.Table:
        results = {name: [] for name in ("doc_id", "n_words", "target_loss", "background_loss")}
        answer = answer.sort_by("range")
        for row in block.to_pylist():
            own = Cells.of(row)
            results["doc_id"] += row["doc_ids"]
            results["n_words"] += row["lengths"]
            for name, total in (("target", of_target), ("every", of_all)):
                counts = np.zeros(len(own.cell), dtype=np.int64)
                if len(own.cell):
                    known = [_unplaned(c, np.int64) for c in answer.column(name).to_pylist()]
                    counts[own.order] = np.concatenate(known)
                losses = own.losses(counts, total, vocabulary) if len(own.number) else np.empty(0)
                mean = np.bincount(own.doc, losses, minlength=len(row["lengths"])) / np.maximum(row["lengths"], 1)
                results["target_loss" if name == "target" else "background_loss"] += mean.tolist()
        kinds = (pa.int64(), pa.int64(), pa.float64(), pa.float64())
        return pa.table({n: pa.array(v, k) for (n, v), k in zip(results.items(), kinds, strict=True)})

    schema = "doc_id long, n_words long, target_loss double, background_loss double"
    needed = blocks.select("block", "doc_ids", "lengths", "targets", "hashes", "numbers")
    known = answers.select("block", "range", "target", "every")
    scored = needed.groupBy("block").cogroup(known.groupBy("block")).applyInArrow(run, schema)
    return scored.withColumn("difference", F.col("target_loss") - F.col("background_loss"))
