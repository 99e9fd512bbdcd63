"""Benchmark decontamination with built-in functions only.

Benchmark items and documents are cut into normalised words: A-Z lower-cased, a word is a run of
digits, a-z and non-ASCII characters. A window is ``WINDOW`` consecutive words of an item; an item
of fewer words is one window. Words of a document inside any occurrence of a window are hit.

1. Scan. Every occurrence of a window of m words covers a gram of k = (m + 1) // 2 words that starts
   at a multiple of k. So a document is scanned at every k-th word only, and each gram's hash is
   looked up in the hash set of all k-word grams of the benchmark's m-word windows. The set goes to
   the tasks with the plan, behind a check of its size; beyond ``SET_LIMIT`` grams the scan is left
   out and every document goes to step 2, whose join Spark then shuffles. Both give the same rows.
2. Verify. The documents found (their texts kept in the staged scan) are cut into all windows, which
   are joined with the benchmark's windows as text, so a hash collision cannot become a hit.
3. Merge hits to covered words per text. Equal texts share one key (the digest of the text), so
   a group of copies is verified once.

Cases: a null, empty or wordless text has no words and is never hit; a null or wordless item has no
windows; equal items count by ``item_id``, null ids as ``null``; equal documents get equal rows; an
empty benchmark hits nothing. Extra columns are ignored by :func:`report` and kept by
:func:`remove_documents` and :func:`remove_spans`.
"""

from __future__ import annotations

from string import ascii_lowercase, ascii_uppercase

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from couponflow.llm.tables import at_most, small_side
from couponflow.session import stage

WINDOW = 10
#: Grams up to which the hash set is sent with the plan (8 bytes each).
SET_LIMIT = 100_000
SEPARATOR_CODES = [*range(0x00, 0x30), *range(0x3A, 0x41), *range(0x5B, 0x61), *range(0x7B, 0x80)]
SEPARATORS = "".join(map(chr, SEPARATOR_CODES))
WORD_CLASS = r"0-9A-Za-z\x{80}-\x{10FFFF}"


def word_array(text: Column | str) -> Column:
    """Normalised words of a text; null for a text without words."""
    text = F.col(text) if isinstance(text, str) else text
    spaced = F.translate(
        text, ascii_uppercase + SEPARATORS, ascii_lowercase + " " * len(SEPARATORS)
    )
    spaced = F.trim(spaced)
    return F.when(spaced != "", F.split(spaced, " +"))


def gram(words: Column, start: Column, length: int) -> Column:
    """Text of ``length`` words from position ``start`` (0-based)."""
    return F.concat_ws(" ", *[F.get(words, start + i) for i in range(length)])


def gram_hash(words: Column, start: Column, length: int) -> Column:
    return F.xxhash64(*[F.get(words, start + i) for i in range(length)])


def grams(words: Column, n: Column, length: int) -> Column:
    """Texts of all grams of ``length`` words, in order."""
    return F.transform(starts(n, length), lambda i: gram(words, i, length))


def gram_hashes(words: Column, n: Column, length: int, step: int = 1) -> Column:
    return F.transform(starts(n, length, step), lambda i: gram_hash(words, i, length))


def starts(n: Column, length: int, step: int = 1) -> Column:
    """Positions 0, step, .. of grams of ``length`` words among ``n``; null if there are none."""
    return F.when(n >= length, F.sequence(F.lit(0), n - length, F.lit(step)))


def benchmark_windows(benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """``length, window, items``: each distinct window text with the ids that have it."""
    items = benchmark.select(
        F.coalesce(F.col("item_id").cast("string"), F.lit("null")).alias("item"),
        word_array("text").alias("w"),
    ).where("w is not null")
    n = F.size("w")
    cut = []
    for length in range(1, window + 1):
        own = items.where(n >= length if length == window else n == length)
        own = own.select("item", F.explode(grams(F.col("w"), n, length)).alias("window"))
        cut.append(own.select(F.lit(length).alias("length"), "item", "window"))
    windows = cut[0]
    for more in cut[1:]:
        windows = windows.unionByName(more)
    return windows.groupBy("length", "window").agg(F.collect_set("item").alias("items"))


def _anchors(windows: DataFrame, lengths: list[int]) -> dict[int, DataFrame]:
    """Hashes of all half-length grams of the windows, by window length."""
    found = {}
    for length in lengths:
        k = (length + 1) // 2
        own = windows.where(F.col("length") == length).select(F.split("window", " ").alias("w"))
        hashes = gram_hashes(F.col("w"), F.lit(length), k)
        found[length] = own.select(F.explode(hashes).alias("h")).distinct()
    return found


def scan(docs: DataFrame, windows: DataFrame, lengths: list[int]) -> DataFrame:
    """``doc_id, key, n_words, text`` of every document, staged.

    ``text`` is kept only where a gram of the set is found; all others cannot hold a window.
    """
    w = F.col("_w")
    n = F.coalesce(F.size(w), F.lit(0))
    rows = docs.select("doc_id", "text", word_array("text").alias("_w"))
    maybe = [F.lit(False)]
    for length, hashes in _anchors(windows, lengths).items():
        k = (length + 1) // 2
        if not at_most(hashes, SET_LIMIT):
            maybe.append(n >= length)
            continue
        at = f"_grams_{length}"
        rows = rows.withColumn(at, gram_hashes(w, n, k, k))
        known = ", ".join(f"{row.h}L" for row in hashes.collect())
        maybe.append(F.expr(f"coalesce(exists({at}, h -> h in ({known})), false)"))
    found = maybe[0]
    for more in maybe[1:]:
        found = found | more
    return stage(
        rows.select(
            "doc_id",
            F.md5("text").alias("key"),
            n.cast("long").alias("n_words"),
            F.when(found, F.col("text")).alias("text"),
        ),
        "benchmark-scan",
    )


def verify(found: DataFrame, windows: DataFrame, lengths: list[int]) -> DataFrame:
    """``key, words, items`` of every text with a hit: hit word positions and item ids, sorted."""
    texts = (
        found.where("text is not null")
        .dropDuplicates(["key"])
        .select("key", word_array("text").alias("_w"))
        .where("_w is not null")
    )
    n = F.size("_w")
    known = small_side(windows, SET_LIMIT)
    cut = []
    for length in lengths:
        own = texts.select("key", F.posexplode(grams(F.col("_w"), n, length)).alias("at", "window"))
        cut.append(own.select(F.lit(length).alias("length"), "key", "at", "window"))
    if not cut:
        return texts.select("key", F.array().cast("array<int>").alias("words"), F.array().cast("array<string>").alias("items")).limit(0)
    every = cut[0]
    for more in cut[1:]:
        every = every.unionByName(more)
    hits = every.join(known, ["length", "window"]).groupBy("key")
    covered = F.transform(
        F.collect_list(F.struct("at", "length")),
        lambda hit: F.sequence(hit["at"], hit["at"] + hit["length"] - 1),
    )
    return hits.agg(
        F.array_sort(F.array_distinct(F.flatten(covered))).alias("words"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"),
    )


def hits(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW) -> tuple[DataFrame, DataFrame]:
    """The staged scan of the documents, and the verified hits per text key."""
    windows = stage(benchmark_windows(benchmark, window), "benchmark-windows")
    # At most ``window`` different lengths.
    lengths = sorted(row.length for row in windows.select("length").distinct().collect())
    found = scan(docs, windows, lengths)
    return found, stage(verify(found, windows, lengths), "benchmark-hits")


def report(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """``doc_id, n_words, words, items`` for every document; the arrays are empty without a hit."""
    found, known = hits(docs, benchmark, window)
    return found.select("doc_id", "key", "n_words").join(known, "key", "left").select(
        "doc_id",
        "n_words",
        F.coalesce("words", F.array().cast("array<int>")).alias("words"),
        F.coalesce("items", F.array().cast("array<string>")).alias("items"),
    )


def remove_documents(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """Documents without any hit word."""
    _, known = hits(docs, benchmark, window)
    keys = small_side(known.select(F.col("key").alias("_key")))
    return docs.join(keys, F.md5(docs["text"]) == F.col("_key"), "left_anti")


def remove_spans(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """All documents, hit words (each with the separators before it) cut from the texts."""
    found, known = hits(docs, benchmark, window)
    texts = found.join(known.select("key"), "key", "left_semi").dropDuplicates(["key"])
    piece = f"[^{WORD_CLASS}]*[{WORD_CLASS}]+"
    pieces = texts.select("key", F.posexplode(F.regexp_extract_all("text", F.lit(piece), 0)).alias("at", "piece"))
    dropped = known.select("key", F.explode("words").alias("at"))
    left = (
        pieces.join(dropped, ["key", "at"], "left_anti")
        .groupBy("key")
        .agg(F.array_sort(F.collect_list(F.struct("at", "piece"))).alias("pieces"))
        .select("key", F.array_join(F.col("pieces.piece"), "").alias("body"))
    )
    tail = F.regexp_extract("text", f"([^{WORD_CLASS}]*)$", 1)
    cleaned = texts.join(left, "key", "left").select(
        F.col("key").alias("_key"),
        F.concat(F.coalesce("body", F.lit("")), tail).alias("_clean"),
    )
    others = [F.coalesce("_clean", F.col("text")).alias(c) if c == "text" else F.col(f"`{c}`") for c in docs.columns]
    return docs.join(cleaned, F.md5(docs["text"]) == F.col("_key"), "left").select(*others)
