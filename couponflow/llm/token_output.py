"""Token ids of all documents, written as range-coded blocks and read back.

1. Tokenise: each whole text, with the end id appended; ids are staged as bytes.
2. Count all ids (partial counts per task) and make the one table of frequencies all blocks share.
   Its size is bounded by the vocabulary.
3. Order by document id: rows go to ranges of ids, so shard k holds what comes before shard k + 1; no
   shard is sorted as a whole table. Each task codes its documents into blocks (see
   :mod:`couponflow.llm.rans`) of about ``BLOCK`` ids; a document is never split.
4. Read: every block is decoded on its own and checked against its checksum. A document's place in the
   whole is the sum of the shards before plus its place in the shard.

The files are a Parquet table ``blocks`` (shard, block, first: ids of the shard before it, documents and
their lengths, payload: the coded block) and one ``frequencies`` (id, frequency). So Spark's
committer sees to it that a lost or repeated task leaves exactly one copy of each block.

Words are looked up in a bounded cache of a worker. A word of letters and marks only is one or two
pieces for the tokenizer's model; any other goes through the whole tokenizer. Both give the ids that
encoding the text as a whole gives, since the tokenizer never joins characters across white space.

Cases: a null or empty text is just the end id; null ids come first; equal ids are ordered by their
tokens, and equal rows are interchangeable; an empty table writes no blocks. Extra columns are ignored.
"""

from __future__ import annotations

import os
import re
import zlib
from array import array
from collections.abc import Iterator
from functools import cache

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from couponflow.llm import rans
from couponflow.llm.tables import slices, small_side
from couponflow.session import table_path

TOKENIZER = "word_bpe_49k.json"
END_ID = 1
BLOCK = 1 << 19
IDS_PER_SHARD = 1 << 24
MAX_SHARDS = 100_000
#: Words kept by a worker; beyond it the cache starts anew.
CACHE_WORDS = 500_000

#: Letters that are one piece each way: A-Z, a-z and the Latin-1 letters; then marks, no apostrophe.
_PLAIN = re.compile(
    rb"((?:[A-Za-z]|\xc3[\x80-\x96\x98-\xb6\xb8-\xbf])*)([!-&(-/:-@\[-`{-~]*)", re.DOTALL
)


@cache
def _byte_letters() -> list[str]:
    """Printable stand-in of every byte: itself where it is printable, else one from 256 on."""
    printable = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    others = [b for b in range(256) if b not in printable]
    return [chr(b if b in printable else 256 + others.index(b)) for b in range(256)]


class WordIds(dict):
    """Ids of words as bytes, found on first use.

    When ``CACHE_WORDS`` are known, they become the older half of the cache and a new half begins; a word
    that is met again moves over, so frequent words stay.
    """

    def __init__(self, path: str):
        super().__init__()
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.model = self.tokenizer.model
        self.kind = id_type(self.tokenizer.get_vocab_size())
        self.code = "H" if self.kind.itemsize == 2 else "I"
        self.older: dict[bytes, bytes] = {}

    def _pieces(self, word: bytes) -> bytes:
        plain = _PLAIN.fullmatch(word)
        if not plain:
            ids = self.tokenizer.encode(word.decode(), add_special_tokens=False).ids
            return array(self.code, ids).tobytes()
        letters, marks = plain.groups()
        if letters and marks:
            return self[letters] + self[marks]
        if not marks:
            low = word.decode().lower()
            if low.isascii():
                text = low
            else:
                text = "".join(map(_byte_letters().__getitem__, low.encode()))
        else:
            text = word.decode()
        return array(self.code, [t.id for t in self.model.tokenize(text)]).tobytes()

    def __missing__(self, word: bytes) -> bytes:
        ids = self.older.get(word)
        if ids is None:
            ids = self._pieces(word)
        if len(self) >= CACHE_WORDS:
            self.older = dict(self)
            self.clear()
        self[word] = ids
        return ids

    def of(self, text: bytes) -> bytes:
        return b"".join(map(self.__getitem__, text.split()))


@cache
def word_ids(path: str) -> WordIds:
    """One cache per worker and tokenizer."""
    return WordIds(path)


def id_type(vocabulary: int) -> np.dtype:
    return np.dtype("<u2" if vocabulary <= 1 << 16 else "<u4")


def tokens(docs: DataFrame, path: str, end_id: int = END_ID) -> DataFrame:
    """``doc_id, ids`` (bytes, see :func:`id_type`) of every document, end id included."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = word_ids(path)
        end = np.array([end_id], dtype=words.kind).tobytes()
        for batch in slices(batches):
            texts = batch.column("text").cast(pa.binary()).to_pylist()
            ids = pa.array([words.of(t or b"") + end for t in texts], pa.binary())
            yield pa.record_batch([batch.column("doc_id"), ids], names=["doc_id", "ids"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "doc_id long, ids binary")


def count_ids(rows: DataFrame, kind: np.dtype, vocabulary: int) -> np.ndarray:
    """How often each id occurs. The driver gets at most ``vocabulary`` rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(vocabulary, dtype=np.int64)
        for batch in slices(batches):
            joined = b"".join(batch.column("ids").to_pylist())
            total += np.bincount(np.frombuffer(joined, kind), minlength=vocabulary)
        used = np.flatnonzero(total)
        yield pa.record_batch([pa.array(used), pa.array(total[used])], names=["id", "times"])

    counts = (
        rows.select("ids").mapInArrow(run, "id long, times long").groupBy("id").agg(F.sum("times").alias("times"))
    ).toPandas()
    found = np.zeros(vocabulary, dtype=np.int64)
    found[counts["id"].to_numpy(dtype=np.int64)] = counts["times"].to_numpy(dtype=np.int64)
    return found


def _blocks(rows: DataFrame, table: rans.Frequencies, kind: np.dtype) -> DataFrame:
    """Coded blocks of rows that are already dealt out and sorted."""
    shared = rows.sparkSession.sparkContext.broadcast(table)

    def block(shard, number, first, ids, names, lengths):
        joined = np.frombuffer(b"".join(ids), kind)
        row = {
            "shard": [shard],
            "block": [number],
            "first": [first],
            "n_ids": [len(joined)],
            "doc_ids": [names],
            "lengths": [lengths],
            "payload": [rans.encode(joined, shared.value)],
        }
        kinds = [pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.binary()]
        return pa.record_batch([pa.array(v, k) for v, k in zip(row.values(), kinds, strict=True)], names=[*row])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard = TaskContext.get().partitionId()
        number = first = size = 0
        ids, names, lengths = [], [], []
        for batch in slices(batches):
            for doc_id, own in zip(batch.column("doc_id").to_pylist(), batch.column("ids").to_pylist(), strict=True):
                ids.append(own)
                names.append(doc_id)
                lengths.append(len(own) // kind.itemsize)
                size += lengths[-1]
                if size >= BLOCK:
                    yield block(shard, number, first, ids, names, lengths)
                    number, first, size = number + 1, first + size, 0
                    ids, names, lengths = [], [], []
        if ids:
            yield block(shard, number, first, ids, names, lengths)

    return rows.mapInArrow(
        run,
        "shard int, block long, first long, n_ids long, doc_ids array<long>, lengths array<long>, payload binary",
    )


def write(docs: DataFrame, path: str, tokenizer: str | None = None, end_id: int = END_ID) -> None:
    """Encode ``docs`` into the files under ``path``. ``tokenizer``: path of a tokenizer's file."""
    spark = docs.sparkSession
    tokenizer = tokenizer or public_tokenizers.path(TOKENIZER)
    vocabulary = word_ids(tokenizer).tokenizer.get_vocab_size()
    kind = id_type(vocabulary)
    staged = table_path(spark, "token-ids")
    tokens(docs, tokenizer, end_id).write.option("compression", "zstd").parquet(staged)
    rows = spark.read.schema("doc_id long, ids binary").parquet(staged)
    counts = count_ids(rows, kind, vocabulary)
    table = rans.Frequencies.of(counts)
    used = [(int(i), int(table.frequency[i])) for i in np.flatnonzero(table.frequency)]
    spark.createDataFrame(used, "id int, frequency long").coalesce(1).write.parquet(f"{path}/frequencies")
    shards = min(max(1, -(-int(counts.sum()) // IDS_PER_SHARD)), MAX_SHARDS)
    keys = ["doc_id", "_tie"]
    dealt = (
        rows.withColumn("_tie", F.xxhash64("ids"))
        .repartitionByRange(shards, *keys)
        .sortWithinPartitions(*keys)
        .select("doc_id", "ids")
    )
    # Small row groups, so that a file can be decoded by several tasks.
    _blocks(dealt, table, kind).write.option("parquet.block.size", 16 << 20).parquet(f"{path}/blocks")


def _table(spark: SparkSession, path: str) -> rans.Frequencies:
    # One row per id of the vocabulary at most.
    rows = spark.read.schema("id int, frequency long").parquet(f"{path}/frequencies").toPandas()
    counts = np.zeros(int(rows["id"].max()) + 1 if len(rows) else 0, dtype=np.int64)
    counts[rows["id"].to_numpy()] = rows["frequency"].to_numpy()
    # The frequencies add up to a power of two and so are kept as they are.
    return rans.Frequencies.of(counts, max(int(counts.sum()) - 1, 1).bit_length())


def read(spark: SparkSession, path: str) -> DataFrame:
    """``doc_id, start, ids`` (array of long) of every document in the files, end id included."""
    return _decoded(spark, path, "ids array<long>", lambda ids: ids.tolist(), pa.list_(pa.int64()))


def digests(spark: SparkSession, path: str) -> DataFrame:
    """``doc_id, start, n_tokens, ids_crc32`` of every document in the files."""
    return _decoded(
        spark, path, "ids_crc32 long", lambda ids: zlib.crc32(ids.astype("<u4").tobytes()), pa.int64()
    )


def _decoded(spark: SparkSession, path: str, column: str, value, kind: pa.DataType) -> DataFrame:
    schema = "shard int, block long, first long, n_ids long, doc_ids array<long>, lengths array<long>, payload binary"
    blocks = spark.read.schema(schema).parquet(f"{path}/blocks")
    # Per shard: the ids of all shards before it.
    sums = blocks.groupBy("shard").agg(F.sum("n_ids").alias("n_ids"))
    before = F.sum("n_ids").over(Window.orderBy("shard")) - F.col("n_ids")
    offsets = small_side(sums.select("shard", before.alias("before")))
    shared = spark.sparkContext.broadcast(_table(spark, path))
    name = column.split()[0]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                shard, first, names, lengths, payload = (
                    batch.column(c)[i].as_py() for c in ("shard", "first", "doc_ids", "lengths", "payload")
                )
                ids = rans.decode(payload, shared.value)
                ends = np.cumsum(lengths)
                starts = ends - lengths
                values = [value(ids[s:e]) for s, e in zip(starts, ends, strict=True)]
                yield pa.record_batch(
                    [
                        pa.array([shard] * len(names), pa.int32()),
                        pa.array(names, pa.int64()),
                        pa.array(starts + first, pa.int64()),
                        pa.array(lengths, pa.int64()),
                        pa.array(values, kind),
                    ],
                    names=["shard", "doc_id", "place", "n_tokens", name],
                )

    columns = blocks.select("shard", "first", "doc_ids", "lengths", "payload")
    found = columns.mapInArrow(run, f"shard int, doc_id long, place long, n_tokens long, {column}")
    return found.join(offsets, "shard").select(
        "doc_id", (F.col("before") + F.col("place")).alias("start"), "n_tokens", name
    )
