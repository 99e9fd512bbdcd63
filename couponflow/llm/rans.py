"""Static range asymmetric numeral system coder for token ids, in numpy.

All blocks share one table of frequencies that add up to ``1 << bits``. Ids of a block are dealt to lanes in
turn (id i goes to lane i mod lanes); each lane is a 64-bit coder that sheds 32-bit words, and the words
of all lanes are interleaved in the order in which a decoder needs them. Every ``SEGMENT`` steps a
checkpoint keeps the lanes' states and the place in the words, so any segment can be decoded alone,
and a block's segments are decoded side by side. A block ends with a checksum of its ids.
"""

from __future__ import annotations

import struct
import zlib
from dataclasses import dataclass

import numpy as np

MAGIC = b"RNS1"
HEADER = struct.Struct("<4sIIQIQI")  # magic, bits, lanes, ids, segments, words, crc32 of the ids
LANES = 1024
SEGMENT = 128
#: Lanes have at least so many ids each, as far as there is more than one lane.
LEAST_PER_LANE = 128
LOW = np.uint64(1 << 31)
WORD = np.uint64(32)


class Damaged(ValueError):
    """A block whose bytes are not what was written."""


@dataclass(frozen=True)
class Frequencies:
    bits: int
    frequency: np.ndarray  # uint64, by id; 0 for ids that do not occur
    start: np.ndarray  # uint64, sum of the frequencies of smaller ids
    symbol: np.ndarray  # uint32, by slot

    @staticmethod
    def of(counts: np.ndarray, bits: int = 20) -> Frequencies:
        """Table for counts by id. Every id that occurs gets a frequency of at least 1."""
        used = np.flatnonzero(counts)
        while len(used) * 4 > 1 << bits:
            bits += 1
        size = 1 << bits
        frequency = np.zeros(len(counts), dtype=np.int64)
        if len(used):
            share = counts[used].astype(float) * (size / counts[used].sum())
            fixed = np.maximum(1, np.floor(share)).astype(np.int64)
            # What rounding left over or took too much is settled by the largest ones.
            by_size = np.argsort(-fixed, kind="stable")
            off = size - int(fixed.sum())
            if off > 0:
                fixed[by_size[0]] += off
            for i in by_size:
                if off >= 0:
                    break
                give = min(int(fixed[i]) - 1, -off)
                fixed[i] -= give
                off += give
            frequency[used] = fixed
        start = np.cumsum(frequency) - frequency
        symbol = np.repeat(np.arange(len(counts), dtype=np.uint32), frequency)
        return Frequencies(bits, frequency.astype(np.uint64), start.astype(np.uint64), symbol)


def encode(ids: np.ndarray, table: Frequencies) -> bytes:
    """One block."""
    n = len(ids)
    lanes = int(min(LANES, max(1, n // LEAST_PER_LANE)))
    steps = -(-n // lanes)
    bits = np.uint64(table.bits)
    shed_from = np.uint64(63 - table.bits)
    state = np.full(lanes, LOW, dtype=np.uint64)
    shed: list[np.ndarray] = [np.empty(0, np.uint32)] * steps
    states: dict[int, np.ndarray] = {}
    frequency, start = table.frequency[ids], table.start[ids]
    for step in range(steps - 1, -1, -1):
        f = frequency[step * lanes : (step + 1) * lanes]
        c = start[step * lanes : (step + 1) * lanes]
        x = state[: len(f)]
        full = x >= (f << shed_from)
        if full.any():
            shed[step] = x[full].astype(np.uint32)
            x = np.where(full, x >> WORD, x)
        whole = x // f
        state[: len(f)] = (whole << bits) + (x - whole * f) + c
        if step % SEGMENT == 0:
            states[step] = state.copy()
    places = np.concatenate(([0], np.cumsum([len(w) for w in shed]))).astype(np.uint64)
    marks = [places[s].tobytes() + states[s].tobytes() for s in sorted(states)]
    words = np.concatenate(shed) if shed else np.empty(0, np.uint32)
    check = zlib.crc32(np.ascontiguousarray(ids, "<u4").tobytes())
    header = HEADER.pack(MAGIC, table.bits, lanes, n, len(marks), len(words), check)
    return b"".join([header, *marks, words.tobytes()])


def decode(block: bytes, table: Frequencies, first: int = 0, last: int | None = None) -> np.ndarray:
    """Ids (uint32) of segments ``first`` to ``last`` (all by default, and then checked)."""
    if len(block) < HEADER.size:
        raise Damaged("short block")
    magic, bits, lanes, n, segments, n_words, check = HEADER.unpack_from(block)
    mark = 8 * (lanes + 1)
    if magic != MAGIC or bits != table.bits or len(block) != HEADER.size + mark * segments + 4 * n_words:
        raise Damaged("not a block of this table")
    marks = np.frombuffer(block, "<u8", segments * (lanes + 1), HEADER.size).reshape(segments, lanes + 1)
    words = np.frombuffer(block, "<u4", n_words, HEADER.size + mark * segments)
    whole = first == 0 and (last is None or last >= segments)
    last = segments if last is None else min(last, segments)
    begin, end = min(first * SEGMENT * lanes, n), min(last * SEGMENT * lanes, n)
    if begin >= end:
        ids = np.empty(0, np.uint32)
    else:
        at = marks[first:last, 0].astype(np.int64)
        state = marks[first:last, 1:].copy()
        ids = _run(state, at, words, table, lanes, end - begin)
    if whole and zlib.crc32(ids.astype("<u4").tobytes()) != check:
        raise Damaged("checksum differs")
    return ids


def _run(state, at, words, table: Frequencies, lanes: int, n: int) -> np.ndarray:
    """Decode segments side by side; ``state`` has a row and ``at`` a place in the words for each."""
    mask = np.uint64((1 << table.bits) - 1)
    bits = np.uint64(table.bits)
    rows = len(state)
    out = np.zeros((rows, SEGMENT, lanes), dtype=np.uint32)
    in_last = n - (rows - 1) * SEGMENT * lanes
    for step in range(min(SEGMENT, -(-in_last // lanes)) if rows == 1 else SEGMENT):
        # Only the last row can be shorter than a segment, and its last step narrower.
        live = rows if step * lanes < in_last else rows - 1
        x = state[:live].ravel()
        slot = x & mask
        ids = table.symbol.take(slot.view(np.int64))
        x >>= bits
        x *= table.frequency.take(ids)
        x += slot
        x -= table.start.take(ids)
        out[:live, step] = ids.reshape(live, lanes)
        low = x < LOW
        if live == rows and (step + 1) * lanes > in_last:
            low[(rows - 1) * lanes + in_last - step * lanes :] = False
        # Lanes that ran low take the next words of their row, in order.
        short = np.flatnonzero(low)
        taken = np.count_nonzero(low.reshape(live, lanes), axis=1)
        place = np.arange(len(short)) + np.repeat(at[:live] - (np.cumsum(taken) - taken), taken)
        x[short] = (x[short] << WORD) | words[place]
        at[:live] += taken
        state[:live] = x.reshape(live, lanes)
    return out.reshape(-1)[:n]
