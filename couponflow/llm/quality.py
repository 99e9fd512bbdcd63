"""Quality rules: statistics of a document, and gradient-boosted trees over them.

The trees are fitted by second-order boosting on binned statistics, with monotonic constraints: more
symbols, repeated lines, repeated phrases or shouting can never raise a score. They are flattened
into node arrays (feature, threshold, left, right, value) that score a whole batch in numpy.

Statistics of all documents are computed in tasks, one text at a time. The classifier is fitted on
the driver on at most ``FIT_ROWS`` labelled rows (those with the smallest hash of ``doc_id``); this
bound is the only sample here.

Cases: a null or empty text has all counts 0 and fails the base rule; texts of any length are read
whole; ties in the sample are broken by ``doc_id``, and documents with one id count as the one with the
smallest statistics; equal rows get equal rows; with no labelled rows, or
labels of one class only, the model keeps what passes the base rule. Extra columns are ignored by
:func:`score` and kept by :func:`keep`.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from couponflow.llm import words as text_words
from couponflow.llm.tables import slices

FIT_ROWS = 20_000
MIN_WORDS = 50
MAX_REPEAT_PERCENT = 50
KEEP_FROM = 0.5
SYMBOLS = "#*$%&|<>"
COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
#: Statistics given to the trees, and the direction in which each may move the score.
FEATURES = {
    "log_words": 0,
    "mean_word": 0,
    "symbols_per_word": -1,
    "dup_line_share": -1,
    "repeat_share": -1,
    "top_word_share": -1,
    "capital_share": -1,
    "marks_per_word": -1,
    "distinct_share": 0,
    "digit_share": 0,
}


def repeated(codes: np.ndarray, distinct: int) -> int:
    """Words inside 3-word windows that occur at least twice. ``codes``: word numbers."""
    n = len(codes)
    if n < 4:
        return 0
    pairs = codes[:-1] * distinct + codes[1:]
    # Renumber the pairs, so that a pair and a word fit 64 bits however many words there are.
    _, pairs = np.unique(pairs, return_inverse=True)
    _, which, times = np.unique(
        pairs[:-1] * distinct + codes[2:], return_inverse=True, return_counts=True
    )
    again = times[which] > 1
    covered = np.zeros(n, dtype=bool)
    for shift in range(3):
        covered[shift : n - 2 + shift] |= again
    return int(covered.sum())


def statistics(text: str | None) -> tuple[list[int], list[float]]:
    """The base counts and the tree features of one text."""
    if not text:
        return [0] * len(COUNTS), [0.0] * len(FEATURES)
    found = text_words.split(text)
    n = len(found)
    word_chars = len(text) - sum(map(text.count, text_words.SPACES))
    symbols = sum(map(text.count, SYMBOLS))
    index: dict[bytes, int] = {}
    codes = np.fromiter((index.setdefault(w, len(index)) for w in found), np.int64, n)
    repeats = repeated(codes, len(index))
    seen: set[str] = set()
    lines = same = 0
    for line in text.split("\n"):
        if line in seen:
            same += 1
            lines += 1
        elif line.strip(text_words.SPACES):
            seen.add(line)
            lines += 1
    counts = [n, word_chars, symbols, same, repeats]
    if not n:
        return counts, [0.0] * len(FEATURES)
    raw = np.frombuffer(text.encode(), np.uint8)
    by_byte = np.bincount(raw, minlength=256)
    capitals = int(by_byte[65:91].sum())
    small = int(by_byte[97:123].sum())
    digits = int(by_byte[48:58].sum())
    ascii_chars = int(by_byte[33:127].sum())
    features = [
        math.log1p(n),
        word_chars / n,
        symbols / n,
        same / max(lines, 1),
        repeats / n,
        int(np.bincount(codes).max()) / n,
        capitals / max(capitals + small, 1),
        (ascii_chars - capitals - small - digits) / n,
        len(index) / n,
        digits / max(word_chars, 1),
    ]
    return counts, features


def base_failed(counts: np.ndarray) -> np.ndarray:
    """Rule on an array of the base counts, one row per document."""
    return (counts[:, 0] < MIN_WORDS) | (100 * counts[:, 4] > MAX_REPEAT_PERCENT * counts[:, 0])


@dataclass(frozen=True)
class Trees:
    """All trees, flattened: a node's children and value are at the same place of each array.

    Leaves are their own children, so ``depth`` steps from the roots end at the leaves.
    """

    roots: np.ndarray
    feature: np.ndarray
    threshold: np.ndarray
    left: np.ndarray
    right: np.ndarray
    value: np.ndarray
    start: float
    depth: int

    def probability(self, x: np.ndarray) -> np.ndarray:
        """Score of each row of ``x``: all trees of all rows take one step at a time."""
        at = np.broadcast_to(self.roots, (len(x), len(self.roots)))
        rows = np.arange(len(x))[:, None]
        for _ in range(self.depth):
            goes_left = x[rows, self.feature[at]] <= self.threshold[at]
            at = np.where(goes_left, self.left[at], self.right[at])
        margin = self.start + self.value[at].sum(axis=1)
        return 1 / (1 + np.exp(-margin))


class _Growing:
    """One boosting run over binned features."""

    def __init__(self, x, y, signs, depth, rate, bins, min_weight, l2):
        self.x, self.y, self.signs = x, y, signs
        self.depth, self.rate, self.min_weight, self.l2 = depth, rate, min_weight, l2
        self.edges = [np.unique(np.quantile(col, np.linspace(0, 1, bins + 1)[1:-1])) for col in x.T]
        self.width = max(len(e) for e in self.edges) + 1
        # Bin b holds edges[b - 1] < value <= edges[b].
        self.bins = np.stack(
            [np.searchsorted(e, col, side="left") for e, col in zip(self.edges, x.T, strict=True)], axis=1
        )
        self.nodes: dict[str, list] = {k: [] for k in ("feature", "threshold", "left", "right", "value")}

    def add(self, feature=0, threshold=0.0, value=0.0) -> int:
        at = len(self.nodes["value"])
        for name, v in zip(self.nodes, (feature, threshold, at, at, value), strict=True):
            self.nodes[name].append(v)
        return at

    def best_split(self, rows, g, h, low, high):
        """Best allowed (gain, feature, bin, left value, right value), or None."""
        n_features = self.x.shape[1]
        slot = (self.bins[rows] + np.arange(n_features) * self.width).ravel()
        size = n_features * self.width
        shape = (n_features, self.width)
        gl = np.bincount(slot, np.repeat(g[rows], n_features), size).reshape(shape).cumsum(1)[:, :-1]
        hl = np.bincount(slot, np.repeat(h[rows], n_features), size).reshape(shape).cumsum(1)[:, :-1]
        total_g, total_h = g[rows].sum(), h[rows].sum()
        gr, hr = total_g - gl, total_h - hl
        left = np.clip(-gl / (hl + self.l2), low, high)
        right = np.clip(-gr / (hr + self.l2), low, high)
        own = np.clip(-total_g / (total_h + self.l2), low, high)

        def loss(v, gs, hs):
            return gs * v + 0.5 * (hs + self.l2) * v * v

        gain = loss(own, total_g, total_h) - loss(left, gl, hl) - loss(right, gr, hr)
        signs = np.array(self.signs)[:, None]
        allowed = (hl >= self.min_weight) & (hr >= self.min_weight) & (signs * (right - left) >= 0)
        exists = np.arange(self.width - 1)[None, :] < np.array([len(e) for e in self.edges])[:, None]
        gain = np.where(allowed & exists, gain, -np.inf)
        f, b = np.unravel_index(np.argmax(gain), gain.shape)
        if not gain[f, b] > 1e-9:
            return None
        return f, b, left[f, b], right[f, b]

    def grow(self, rows, g, h, depth, low, high, value) -> int:
        split = self.best_split(rows, g, h, low, high) if depth else None
        if split is None:
            return self.add(value=self.rate * value)
        f, b, lv, rv = split
        node = self.add(int(f), float(self.edges[f][b]))
        goes_left = self.bins[rows, f] <= b
        # Below a constrained split, no value may cross the middle of the two sides.
        middle = (lv + rv) / 2
        bounds = {1: ((low, middle), (middle, high)), -1: ((middle, high), (low, middle))}
        lb, rb = bounds.get(self.signs[f], ((low, high), (low, high)))
        self.nodes["left"][node] = self.grow(rows[goes_left], g, h, depth - 1, *lb, lv)
        self.nodes["right"][node] = self.grow(rows[~goes_left], g, h, depth - 1, *rb, rv)
        return node


def fit(
    x: np.ndarray,
    y: np.ndarray,
    signs: tuple[int, ...] = tuple(FEATURES.values()),
    trees: int = 60,
    depth: int = 3,
    rate: float = 0.2,
    bins: int = 64,
    min_weight: float = 1.0,
    l2: float = 1.0,
) -> Trees | None:
    """Boosted trees for P(y = 1); None if ``y`` does not have both classes."""
    if len(y) == 0 or y.min() == y.max():
        return None
    run = _Growing(x, y, signs, depth, rate, bins, min_weight, l2)
    start = math.log(y.mean() / (1 - y.mean()))
    margin = np.full(len(y), start)
    roots = []
    everything = np.arange(len(y))
    for _ in range(trees):
        p = 1 / (1 + np.exp(-margin))
        roots.append(run.grow(everything, p - y, p * (1 - p), depth, -np.inf, np.inf, 0.0))
        one = _arrays(run, [roots[-1]], 0.0, depth)
        at = np.full(len(y), roots[-1])
        for _ in range(depth):
            goes_left = x[everything, one.feature[at]] <= one.threshold[at]
            at = np.where(goes_left, one.left[at], one.right[at])
        margin = margin + one.value[at]
    return _arrays(run, roots, start, depth)


def _arrays(run: _Growing, roots: list[int], start: float, depth: int) -> Trees:
    kinds = {"feature": np.int32, "threshold": float, "left": np.int32, "right": np.int32, "value": float}
    arrays = {name: np.array(run.nodes[name], dtype=kind) for name, kind in kinds.items()}
    return Trees(roots=np.array(roots, dtype=np.int32), **arrays, start=start, depth=depth)


def _features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in slices(batches):
        rows = [statistics(t)[1] for t in batch.column("text").to_pylist()]
        kind = pa.list_(pa.float64())
        yield pa.record_batch(
            [batch.column("doc_id"), pa.array(rows, kind), batch.column("good")],
            names=["doc_id", "features", "good"],
        )


def train(docs: DataFrame, labels: DataFrame, fit_rows: int = FIT_ROWS, **settings) -> Trees | None:
    """Trees fitted on at most ``fit_rows`` labelled documents."""
    order = F.md5(F.col("doc_id").cast("string"))
    chosen = (
        labels.where("doc_id is not null and quality is not null")
        .groupBy("doc_id")
        .agg(F.max("quality").cast("int").alias("good"))
        .orderBy(order, "doc_id")
        .limit(fit_rows)
    )
    # Bounded by ``fit_rows``.
    rows = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id")
    found = rows.mapInArrow(_features, "doc_id long, features array<double>, good int")
    # One row an id, however many documents share it.
    found = found.groupBy("doc_id").agg(F.min("features").alias("features"), F.max("good").alias("good"))
    sample = found.toPandas().sort_values("doc_id", ignore_index=True)
    if sample.empty:
        return None
    return fit(np.array(sample["features"].tolist(), dtype=float), sample["good"].to_numpy(float), **settings)


def verdicts(texts: list[str | None], trees: Trees | None):
    """Base counts, base failures and verdicts of a batch."""
    rows = [statistics(t) for t in texts]
    counts = np.array([r[0] for r in rows], dtype=np.int64).reshape(-1, len(COUNTS))
    failed = base_failed(counts)
    kept = ~failed
    score = np.ones(len(rows))
    if trees is not None and len(rows):
        score = trees.probability(np.array([r[1] for r in rows], dtype=float))
        kept &= score >= KEEP_FROM
    return counts, failed, score, kept


def score(docs: DataFrame, trees: Trees | None) -> DataFrame:
    """``doc_id``, the base counts, ``base_failed``, ``score`` and ``kept`` of every document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            counts, failed, p, kept = verdicts(batch.column("text").to_pylist(), trees)
            columns = [batch.column("doc_id"), *map(pa.array, counts.T), *map(pa.array, (failed, p, kept))]
            yield pa.record_batch(columns, names=["doc_id", *COUNTS, "base_failed", "score", "kept"])

    kinds = ", ".join(f"{c} long" for c in COUNTS)
    schema = f"doc_id long, {kinds}, base_failed boolean, score double, kept boolean"
    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, schema)


def keep(docs: DataFrame, trees: Trees | None) -> DataFrame:
    """Documents that pass, with all their columns."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            *_, kept = verdicts(batch.column("text").to_pylist(), trees)
            yield batch.filter(pa.array(kept, pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
