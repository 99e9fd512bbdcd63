"""Packing documents into sequences of at most ``CAPACITY`` tokens, with as few sequences as can be.

1. Pieces: each whole text is tokenised and closed by the end id. Only a document longer than a sequence is cut:
   its first piece takes what is left over, all others are full. Every task numbers its pieces of each length.
2. Lengths: pieces are counted by length and task. There are ``CAPACITY`` lengths at most, so the table of counts
   that is planned on does not grow with the documents.
3. Plan, over lengths and counts only (see :func:`plan`): exact complements first. From the longest length down, the
   available singles, pairs and triples whose sum is exactly its gap are looked up by that sum and used up, as often as
   the counts allow. What is left is packed best-fit, longest first.
4. Places: a piece's number among all of its length is its number in its task plus the counts of the tasks before;
   the plan gives each run of numbers a sequence and an offset. Pieces are looked up in it, they do not move.

The tokens are those of the ``tokenizers`` file; ``tiktoken`` computes them from the same vocabulary, several times
faster, with the ids of special tokens in texts as ``tokenizers`` has them by default (a test compares the two over all
characters). A text it can't take goes to ``tokenizers``.

Cases: a null or empty text is just the end id; null and equal ids are documents like others, and equal rows are packed
each on its own; an empty table has no pieces; a very long text is cut like any other. Other columns are ignored.
"""

from __future__ import annotations

import base64
import os
import zlib
from collections import defaultdict
from collections.abc import Iterator
from functools import cache

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from couponflow.llm.tables import small_side
from couponflow.session import stage

TOKENIZER = "byte_bpe_50k.json"
RANKS = "byte_bpe_50k.tiktoken"
SPECIAL = {"<|endoftext|>": 50256}
END_ID = 2
CAPACITY = 1024
#: Pieces after which a task hands over what it has.
_FLUSH = 10_000


class Encoder:
    """Ids of a text as the file for ``tokenizers`` gives them."""

    def __init__(self, path: str, ranks: str):
        import tiktoken

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        with open(ranks, "rb") as lines:
            known = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
        self.fast = tiktoken.Encoding(
            "byte-bpe", pat_str=public_tokenizers.PATTERN, mergeable_ranks=known, special_tokens=SPECIAL
        )
        self.path, self.whole = path, None

    def ids(self, text: str) -> np.ndarray:
        try:
            return np.array(self.fast.encode(text, allowed_special="all"), dtype="<u4")
        except (KeyboardInterrupt, SystemExit):
            raise
        except BaseException:  # the library's panics are no Exception
            if self.whole is None:
                from tokenizers import Tokenizer

                self.whole = Tokenizer.from_file(self.path)
            return np.array(self.whole.encode(text, add_special_tokens=False).ids, dtype="<u4")


@cache
def encoder(path: str, ranks: str) -> Encoder:
    """One a worker."""
    return Encoder(path, ranks)


def pieces(docs: DataFrame, capacity: int = CAPACITY, end_id: int = END_ID, with_ids: bool = False) -> DataFrame:
    """``doc_id, piece, start, length, ids_crc32`` of every piece, and ``task, number``: its place among those of its length.

    ``with_ids`` adds the ids (little-endian unsigned 32-bit bytes). Write the table before use: places are numbered by task.
    """
    path, ranks = public_tokenizers.path(TOKENIZER), public_tokenizers.path(RANKS)
    columns = [
        ("doc_id", pa.int64()),
        ("piece", pa.int32()),
        ("start", pa.int64()),
        ("length", pa.int64()),
        ("ids_crc32", pa.int64()),
        ("task", pa.int32()),
        ("number", pa.int64()),
    ]
    schema = pa.schema(columns + [("ids", pa.binary())] * with_ids)
    declared = "doc_id long, piece int, start long, length long, ids_crc32 long, task int, number long"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, task = encoder(path, ranks), TaskContext.get().partitionId()
        seen: dict[int, int] = defaultdict(int)
        for batch in batches:
            rows = []
            for doc_id, text in zip(batch.column("doc_id").to_pylist(), batch.column("text"), strict=True):
                ids = np.append(encode.ids(text.as_py() or ""), np.uint32(end_id)).astype("<u4")
                first = len(ids) % capacity or capacity
                ends = [0, *range(first, len(ids) + 1, capacity)]
                for piece, (start, end) in enumerate(zip(ends, ends[1:])):
                    own, size = ids[start:end].tobytes(), end - start
                    row = (doc_id, piece, start, size, zlib.crc32(own), task, seen[size])
                    rows.append((*row, own) if with_ids else row)
                    seen[size] += 1
                if len(rows) >= _FLUSH:
                    yield pa.RecordBatch.from_arrays([pa.array(v, f.type) for v, f in zip(zip(*rows), schema)], schema=schema)
                    rows = []
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(v, f.type) for v, f in zip(zip(*rows), schema)], schema=schema)

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(
        run, declared + ", ids binary" * with_ids
    )


Plan = list[tuple[dict[int, int], int]]


def _fill_exactly(left: np.ndarray, capacity: int, most: int) -> Plan:
    """Use up combinations of a length and up to ``most`` (3) others that fill its gap exactly. Changes ``left``.

    Each use is as often as the counts allow and so exhausts a length, or leaves one too few for its second use in
    the same combination; there are fewer uses than twice the lengths.
    """
    used: Plan = []

    def use(lengths: tuple[int, ...]) -> None:
        combination: dict[int, int] = defaultdict(int)
        for length in lengths:
            combination[length] += 1
        times = min(int(left[x]) // n for x, n in combination.items())
        for x, n in combination.items():
            left[x] -= n * times
        used.append((dict(combination), times))

    def possible(*lengths: int) -> bool:
        return all(left[x] >= lengths.count(x) for x in lengths)

    def pair(total: int, *held: int) -> tuple[int, int] | None:
        """Two available lengths with the sum ``total`` beside those held, the most even ones first."""
        a = np.arange((total + 1) // 2, total)
        for x in a[(left[a] > 0) & (left[total - a] > 0)]:
            if possible(*held, int(x), total - int(x)):
                return int(x), total - int(x)
        return None

    for longest in range(capacity - 1, 0, -1):
        gap = capacity - longest
        if left[longest] and possible(longest, gap):
            use((longest, gap))
        while most > 1 and left[longest] and (found := pair(gap, longest)):
            use((longest, *found))
        # Triples: a first length, and a pair with the sum it leaves.
        for a in range((gap + 2) // 3, min(gap - 1, longest + 1)) if most > 2 else ():
            while left[longest] and left[a] and (found := pair(gap - a, longest, a)):
                use((longest, a, *found))
            if not left[longest]:
                break
    return used


def _best_fit(left: np.ndarray, capacity: int) -> Plan:
    """Pack the rest, longest first, each where the least room is left. Bins with equal contents are kept as one entry."""
    room: dict[int, list[tuple[dict[int, int], int]]] = defaultdict(list)
    for length in range(capacity, 0, -1):
        count = int(left[length])
        while count:
            gap = next((g for g in range(length, capacity) if room[g]), None)
            if gap is None:
                fits = capacity // length
                full, rest = divmod(count, fits)
                if full:
                    room[capacity - fits * length].append(({length: fits}, full))
                if rest:
                    room[capacity - rest * length].append(({length: rest}, 1))
                break
            contents, times = room[gap].pop()
            fits = gap // length
            taken = min(times, count // fits) if count >= fits else 0
            if taken:
                filled = contents | {length: contents.get(length, 0) + fits}
                room[gap - fits * length].append((filled, taken))
                count -= taken * fits
            else:
                room[gap - count * length].append((contents | {length: contents.get(length, 0) + count}, 1))
                taken, count = 1, 0
            if times > taken:
                room[gap].append((contents, times - taken))
        left[length] = 0
    return [entry for entries in room.values() for entry in entries]


def plan(counts: dict[int, int], capacity: int = CAPACITY) -> Plan:
    """How often to use which contents (pieces by length) of a sequence; all counts are used up.

    Where short pieces are few, filling gaps with two or three of them costs more later than it saves; so singles only,
    up to pairs, and up to triples are planned, and the plan with the fewest sequences is kept.
    """
    plans = []
    for most in (3, 2, 1):
        left = np.zeros(capacity + 1, dtype=np.int64)
        for length, count in counts.items():
            left[length] = count
        full = [({capacity: 1}, int(left[capacity]))] if left[capacity] else []
        left[capacity] = 0
        exact = _fill_exactly(left, capacity, most)
        plans.append([*full, *exact, *_best_fit(left, capacity)])
    return min(plans, key=lambda made: sum(times for _, times in made))


class Slots:
    """The plan as runs of piece numbers, for each length in ascending order."""

    def __init__(self, made: Plan, capacity: int):
        runs: dict[int, list[tuple[int, int, int, int]]] = defaultdict(list)
        taken: dict[int, int] = defaultdict(int)
        sequence = 0
        for contents, times in made:
            offset = 0
            for length in sorted(contents, reverse=True):
                copies = contents[length]
                # First number of the run, its copies in a sequence, the first sequence, and the first copy's offset.
                runs[length].append((taken[length], copies, sequence, offset))
                taken[length] += copies * times
                offset += copies * length
            sequence += times
        self.runs = {length: np.array(rows, dtype=np.int64).T for length, rows in runs.items()}
        self.sequences = sequence

    def find(self, lengths: np.ndarray, numbers: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Sequence and offset of pieces given by length and number."""
        sequence, offset = np.zeros_like(numbers), np.zeros_like(numbers)
        for length in np.unique(lengths):
            own = lengths == length
            first, copies, start, place = self.runs[int(length)]
            run = np.searchsorted(first, numbers[own], side="right") - 1
            inside = numbers[own] - first[run]
            sequence[own] = start[run] + inside // copies[run]
            offset[own] = place[run] + inside % copies[run] * length
        return sequence, offset


def pack(found: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """``found`` (written :func:`pieces`) with ``sequence_id`` and ``offset`` for ``task`` and ``number``."""
    spark = found.sparkSession
    by_task = stage(found.groupBy("task", "length").agg(F.count(F.lit(1)).alias("n")), "lengths")
    # A row a length, so at most ``capacity`` rows.
    counts = {r["length"]: r["n"] for r in by_task.groupBy("length").agg(F.sum("n").alias("n")).collect()}
    slots = spark.sparkContext.broadcast(Slots(plan(counts, capacity), capacity))
    earlier = F.sum("n").over(Window.partitionBy("length").orderBy("task")) - F.col("n")
    numbered = found.join(small_side(by_task.select("task", "length", earlier.alias("_before"))), ["task", "length"])
    kept = [c for c in found.columns if c not in ("task", "number")]
    rows = numbered.select(*kept, (F.col("number") + F.col("_before")).alias("_number"))
    fields = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in found.select(*kept).schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lengths, numbers = (batch.column(n).to_numpy() for n in ("length", "_number"))
            sequence, offset = slots.value.find(lengths, numbers)
            columns = [batch.column(n) for n in kept]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(sequence), pa.array(offset)], names=[*kept, "sequence_id", "offset"])

    return rows.mapInArrow(run, f"{fields}, sequence_id long, offset long")


def sequences(packed: DataFrame) -> DataFrame:
    """``sequence_id, length, ids, doc_ids, lengths``: the sequences themselves, of pieces packed with their ids.

    ``ids``: little-endian unsigned 32-bit, at most ``CAPACITY`` of them; ``doc_ids`` and ``lengths``: of their pieces in order.
    """
    inside = F.sort_array(F.collect_list(F.struct("offset", "doc_id", "length", "ids")))
    found = packed.groupBy("sequence_id").agg(inside.alias("inside"))
    joined = F.aggregate("inside.ids", F.lit(b""), lambda done, ids: F.concat(done, ids))
    return found.select(
        "sequence_id",
        (F.octet_length(joined) / 4).cast("int").alias("length"),
        joined.alias("ids"),
        F.col("inside.doc_id").alias("doc_ids"),
        F.col("inside.length").alias("lengths"),
    )
