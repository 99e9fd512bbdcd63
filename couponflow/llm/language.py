"""Language identification: multinomial naive Bayes over hashed character n-grams.

A text is lower-cased; every run of letters is framed by blanks, and the 1- to 3-grams of code points
are hashed into ``BUCKETS`` slots. Counting runs over all training documents in tasks (a dense
table for each of at most ``TABLES`` languages at a time, sent on as its non-zero cells) and is summed by Spark. The
log-probabilities, ``BUCKETS`` x languages, go to the tasks. Texts are scored in batches: the n-grams of about
``BLOCK`` code points of many texts are one sparse matrix of texts by slots (an entry an n-gram, sorted by text),
and its product with the log-probabilities is a gather and a sum over the entries of each text. Log-probabilities are
whole multiples of 2**-28, so sums do not depend on how texts share a batch.

Cases: a null text or one without letters gets ``und`` and score 0; equal scores go to the first
language by code point; texts of any length are read whole, a block at a time; without training
rows everything is ``und``. Rows with a null language are never learned from; equal rows count each.
Extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from couponflow.llm.tables import slices

UNKNOWN = "und"
#: Hash slots. With 8 bytes a cell the matrix takes 512 KB a language.
BUCKETS = 1 << 16
ORDERS = (1, 2, 3)
SMOOTHING = 0.5
FOLDS = 5
#: Code points handled at a time.
BLOCK = 1 << 19
#: Languages a counting task holds a table for before it sends them on.
TABLES = 64
#: Log-probabilities are stored as multiples of its inverse.
SCALE = 1 << 28
#: Odd multipliers that mix the code points of an n-gram.
MULTIPLIERS = (0x9E3779B1, 0x85EBCA77, 0xC2B2AE3D)


def held_out(doc_id: Column | str) -> Column:
    """Rows of fold 0 by the crc32 of the id as text; a null id counts as fold 0."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % FOLDS == 0, F.lit(True))


@cache
def letters() -> np.ndarray:
    """Whether each code point is a letter."""
    return np.fromiter((chr(c).isalpha() for c in range(0x110000)), bool, 0x110000)


def _parts(texts: list[str | None]) -> Iterator[tuple[list[int], list[str], int]]:
    """Framed texts in groups of about ``BLOCK`` code points: their places, and how much of a part was seen before.

    A text of more than a block is cut into groups of its own, which overlap by two code points, so that no n-gram is
    lost at their border.
    """
    places: list[int] = []
    parts: list[str] = []
    size = 0
    for place, text in enumerate(texts):
        if not text:
            continue
        low = f" {text.lower()} "
        if len(low) > BLOCK:
            for start in range(0, len(low), BLOCK):
                yield [place], [low[max(start - 2, 0) : start + BLOCK]], min(start, 2)
            continue
        if size + len(low) > BLOCK:
            yield places, parts, 0
            places, parts, size = [], [], 0
        places.append(place)
        parts.append(low)
        size += len(low)
    if parts:
        yield places, parts, 0


def entries(texts: list[str | None]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Rows (places of texts, ascending) and slots of the sparse matrix of all n-grams, some at a time."""
    for places, parts, seen in _parts(texts):
        points = np.frombuffer("".join(parts).encode("utf-32-le"), dtype=np.uint32)
        owner = np.repeat(np.array(places), [len(p) for p in parts])
        letter = letters()[points]
        points = np.where(letter, points, np.uint32(32))
        mixed = np.zeros(len(points), dtype=np.uint32)
        for order in ORDERS:
            # mixed[i] covers the ``order`` code points from i on.
            shifted = points[order - 1 :] * np.uint32(MULTIPLIERS[order - 1])
            mixed = mixed[: len(shifted)] + shifted
            if not len(mixed):
                break
            inside = letter[order - 1 :] | letter[: len(mixed)]
            # No n-gram spans two texts.
            inside &= owner[order - 1 :] == owner[: len(mixed)]
            # N-grams that end inside the overlap were taken with the block before.
            inside[: max(seen - order + 1, 0)] = False
            h = mixed[inside]
            h = (h ^ (h >> np.uint32(15))) * np.uint32(0x2C1B3C6D)
            h = (h ^ (h >> np.uint32(16))) & np.uint32(BUCKETS - 1)
            if len(h):
                yield owner[: len(mixed)][inside], h


def slots(text: str) -> np.ndarray:
    """How often each slot is hit by the n-grams of ``text`` (all 0 if it has no letters)."""
    hit = np.zeros(BUCKETS, dtype=np.int64)
    for _, h in entries([text]):
        hit += np.bincount(h, minlength=BUCKETS)
    return hit


@dataclass(frozen=True)
class Model:
    languages: list[str]
    log_prior: np.ndarray  # multiples of 1 / SCALE
    log_prob: np.ndarray  # languages x BUCKETS, the same

    def predict_all(self, texts: list[str | None]) -> list[tuple[str, float]]:
        """Language and its posterior probability of each text."""
        totals = np.zeros((len(texts), len(self.languages)), dtype=np.int64)
        known = np.zeros(len(texts), dtype=bool)
        for row, slot in entries(texts) if self.languages else ():
            starts = np.flatnonzero(np.diff(row, prepend=-1))
            rows = row[starts]
            known[rows] = True
            for column, log_prob in enumerate(self.log_prob):
                totals[rows, column] += np.add.reduceat(log_prob[slot], starts)
        found = [(UNKNOWN, 0.0)] * len(texts)
        if known.any():
            total = totals[known] + self.log_prior
            best = total.argmax(axis=1)
            short = total - total.max(axis=1, keepdims=True)
            score = 1 / np.exp(short / SCALE).sum(axis=1)
            for place, b, p in zip(np.flatnonzero(known).tolist(), best.tolist(), score.tolist(), strict=True):
                found[place] = (self.languages[b], p)
        return found

    def predict(self, text: str | None) -> tuple[str, float]:
        return self.predict_all([text])[0]


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Per language of a task: number of documents (slot -1) and n-grams by slot."""
    totals: dict[str, np.ndarray] = {}
    documents: dict[str, int] = {}

    def sent() -> Iterator[pa.RecordBatch]:
        for lang in sorted(totals):
            used = np.flatnonzero(totals[lang])
            slot = np.concatenate(([-1], used))
            hits = np.concatenate(([documents[lang]], totals[lang][used]))
            yield pa.record_batch(
                [pa.array([lang] * len(slot)), pa.array(slot), pa.array(hits)], names=["lang", "slot", "hits"]
            )
        totals.clear()
        documents.clear()

    for batch in slices(batches):
        texts: dict[str, list[str | None]] = {}
        for text, lang in zip(batch.column("text").to_pylist(), batch.column("lang").to_pylist(), strict=True):
            texts.setdefault(lang, []).append(text)
        for lang, own in texts.items():
            if lang not in totals and len(totals) >= TABLES:
                yield from sent()
            total = totals.setdefault(lang, np.zeros(BUCKETS, dtype=np.int64))
            documents[lang] = documents.get(lang, 0) + len(own)
            for _, slot in entries(own):
                total += np.bincount(slot, minlength=BUCKETS)
    yield from sent()


def _scaled(logs: np.ndarray) -> np.ndarray:
    return np.rint(logs * SCALE).astype(np.int64)


def train(docs: DataFrame) -> Model:
    """Model of all rows of ``docs`` that have a language.

    The driver gets one row per language and slot: at most (``BUCKETS`` + 1) a language.
    """
    rows = docs.where("lang is not null").select("text", "lang")
    counts = (
        rows.mapInArrow(_counted, "lang string, slot long, hits long")
        .groupBy("lang", "slot")
        .agg(F.sum("hits").alias("hits"))
        .toPandas()
    )
    languages = sorted(set(counts["lang"]))
    place = {lang: i for i, lang in enumerate(languages)}
    hits = np.zeros((BUCKETS, len(languages)))
    documents = np.zeros(len(languages))
    column = counts["lang"].map(place).to_numpy(dtype=np.int64)
    slot = counts["slot"].to_numpy(dtype=np.int64)
    value = counts["hits"].to_numpy(dtype=float)
    documents[column[slot < 0]] = value[slot < 0]
    hits[slot[slot >= 0], column[slot >= 0]] = value[slot >= 0]
    smooth = hits + SMOOTHING
    log_prob = np.log(smooth / smooth.sum(axis=0))
    log_prior = np.log(documents / max(documents.sum(), 1))
    return Model(languages, _scaled(log_prior), _scaled(np.ascontiguousarray(log_prob.T)))


def predict(docs: DataFrame, model: Model) -> DataFrame:
    """``doc_id, lang_pred, score`` of every row; reads the text only."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = shared.value
        for batch in slices(batches):
            found = known.predict_all(batch.column("text").to_pylist())
            langs = pa.array([f[0] for f in found], pa.string())
            scores = pa.array([f[1] for f in found], pa.float64())
            yield pa.record_batch([batch.column("doc_id"), langs, scores], names=["doc_id", "lang_pred", "score"])

    rows = docs.select(F.col("doc_id").cast("long"), "text")
    return rows.mapInArrow(run, "doc_id long, lang_pred string, score double")
