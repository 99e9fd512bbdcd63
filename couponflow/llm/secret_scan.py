"""Secret scan: all rules in one pass of a combined automaton over the bytes.

The automaton (see :mod:`couponflow.llm.automaton`) tells which rules end in which stretch of the text.
Only there, the rule's own expression is applied to find the exact span: from the last byte before
that no rule can hold to the first one after, so a span is never cut. Spans of one rule are leftmost
and do not overlap; those shorter than the rule asks for are dropped.

Cases: a null or empty text has no spans; texts of any length are read whole; spans of different rules
may overlap and are all kept, sorted by start, then rule; equal rows get equal rows; an empty table gives
no rows. Positions are code points, ends exclusive. Extra columns are ignored by :func:`spans` and
kept by :func:`redact`.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from couponflow.llm.automaton import Automaton

#: Bytes of text scanned at a time (whole texts; a longer one is scanned alone).
BUFFER = 8 << 20


@dataclass(frozen=True)
class Rule:
    """``scan`` is what the automaton looks for: the rule itself, or a head that every match has where
    counting on would only multiply states. ``span`` gives the exact match, of which group ``group``
    must have ``least`` characters."""

    kind: str
    scan: str
    span: str
    group: int = 0
    least: int = 1


def _either_case(words: str) -> str:
    return "".join(f"[{c}{c.upper()}]" if c.isalpha() else c for c in words)


_NAMES = "password|passwd|secret|token|api_?key"
_SET_TO = r"""["']?\x20*[:=]\x20*["']?"""
_VALUE = r"[A-Za-z0-9+/_.=-]"
#: In the order in which spans with one start are listed.
RULES = (
    Rule(
        "assign",
        f"({_either_case(_NAMES)}){_SET_TO}{_VALUE}{{6,}}",
        f"({_either_case(_NAMES)}){_SET_TO}({_VALUE}+)",
        group=2,
        least=6,
    ),
    Rule("access", "AKIA[A-Z0-9]{16,}", "AKIA[A-Z0-9]+", least=20),
    Rule("hex", "[0-9a-f]{24,}", "[0-9a-f]+", least=24),
    Rule("code_host", "gh[pousr]_[A-Za-z0-9]{4}", "gh[pousr]_[A-Za-z0-9]+", least=40),
    Rule("chat", "xox[abprs]-[A-Za-z0-9-]", "xox[abprs]-[A-Za-z0-9-]+", least=15),
    Rule("payment", "[rs]k_live_[0-9A-Za-z]{4}", "[rs]k_live_[0-9A-Za-z]+", least=24),
    Rule(
        "web_token",
        r"eyJ[A-Za-z0-9_-]",
        r"eyJ[A-Za-z0-9_-]+\.eyJ[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+",
    ),
    Rule(
        "private_key",
        "-----BEGIN ([A-Z]+ )*PRIVATE KEY-----",
        "-----BEGIN (?:[A-Z]+ )*PRIVATE KEY-----",
    ),
    Rule(
        "url_login",
        "[a-z]://[A-Za-z0-9._~+-]+:[A-Za-z0-9._~+-]+@",
        "[a-z]+://[A-Za-z0-9._~+-]+:[A-Za-z0-9._~+-]+@",
    ),
)
BASE_KINDS = ("assign", "access", "hex")


@cache
def automaton(rules: tuple[Rule, ...] = RULES) -> Automaton:
    return Automaton.compile([r.scan for r in rules])


def _code_points(data: bytes) -> np.ndarray | None:
    """Code point number of every byte of a text (and its end); None if they are the same."""
    if data.isascii():
        return None
    starts = (np.frombuffer(data, np.uint8) & 0xC0) != 0x80
    return np.concatenate(([0], np.cumsum(starts)))


def find(
    texts: list[bytes], machine: Automaton, rules: tuple[Rule, ...] = RULES
) -> list[list[tuple[int, int, int]]]:
    """Spans of each text: (start, rule number, end) in code points, sorted."""
    data = b"\n".join(texts) + b"\n"
    raw = np.frombuffer(data, np.uint8)
    begins, ends, bits = machine.scan(raw)
    found: list[list[tuple[int, int, int]]] = [[] for _ in texts]
    if not len(begins):
        return found
    resets = np.flatnonzero(machine.resets.take(raw))
    from_ = np.concatenate(([0], resets + 1))[np.searchsorted(resets, begins)]
    to = np.concatenate((resets, [len(raw)]))[np.searchsorted(resets, ends)]
    text_starts = np.concatenate(([0], np.cumsum([len(t) + 1 for t in texts])))
    points: dict[int, np.ndarray | None] = {}
    for number, rule in enumerate(rules):
        expression = re.compile(rule.span.encode())
        done = 0
        for lane in np.flatnonzero(bits >> number & 1):
            for m in expression.finditer(data, max(int(from_[lane]), done), int(to[lane])):
                if m.end(rule.group) - m.start(rule.group) < rule.least:
                    continue
                text = int(np.searchsorted(text_starts, m.start(), side="right")) - 1
                start, end = m.start() - int(text_starts[text]), m.end() - int(text_starts[text])
                if text not in points:
                    points[text] = _code_points(texts[text])
                if (numbers := points[text]) is not None:
                    start, end = int(numbers[start]), int(numbers[end])
                found[text].append((start, number, end))
            done = int(to[lane])
    return [sorted(spans) for spans in found]


def _groups(texts: list[bytes]) -> Iterator[tuple[int, int]]:
    """Ranges of texts of about ``BUFFER`` bytes."""
    begin = size = 0
    for i, text in enumerate(texts):
        if i > begin and size + len(text) > BUFFER:
            yield begin, i
            begin, size = i, 0
        size += len(text)
    if texts:
        yield begin, len(texts)


def spans(docs: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """``doc_id, spans`` of every document; a span has ``kind, start, end, place`` (rule number)."""
    shared = docs.sparkSession.sparkContext.broadcast(automaton(rules))
    kind = pa.list_(
        pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("place", pa.int32())])
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        machine = shared.value
        for batch in batches:
            texts = [t or b"" for t in batch.column("text").cast(pa.binary()).to_pylist()]
            rows = []
            for begin, end in _groups(texts):
                for found in find(texts[begin:end], machine, rules):
                    rows.append([{"kind": rules[n].kind, "start": s, "end": e, "place": n} for s, n, e in found])
            yield pa.record_batch([batch.column("doc_id"), pa.array(rows, kind)], names=["doc_id", "spans"])

    schema = "doc_id long, spans array<struct<kind: string, start: long, end: long, place: int>>"
    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, schema)


def redact(docs: DataFrame, mask: str = "[{kind}]", rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """All documents, every span (overlapping ones as one, named by the first) replaced by ``mask``."""
    shared = docs.sparkSession.sparkContext.broadcast(automaton(rules))
    place = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        machine = shared.value
        for batch in batches:
            texts = batch.column(place).to_pylist()
            raw = [(t or "").encode() for t in texts]
            for begin, end in _groups(raw):
                for i, found in enumerate(find(raw[begin:end], machine, rules), begin):
                    pieces, at = [], 0
                    for start, number, stop in found:
                        if start >= at:
                            pieces += [texts[i][at:start], mask.format(kind=rules[number].kind)]
                        at = max(at, stop)
                    if found:
                        texts[i] = "".join([*pieces, texts[i][at:]])
            yield batch.set_column(place, batch.schema.field(place), pa.array(texts, batch.schema.field(place).type))

    return docs.mapInArrow(run, docs.schema)
