"""One query per operator, over its whole table, and SQL for those that SQL can express."""

from __future__ import annotations

import string
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from couponflow.llm import (
    decontamination,
    digests_sql,
    html_text,
    language,
    lm_scoring,
    merkle,
    mixing,
    packing,
    pii,
    prefix_trie,
    quality,
    secret_scan,
    simhash,
    token_output,
)
from couponflow.llm.tables import read, small_side
from couponflow.session import stage, table_path

Query = Callable[[SparkSession, str], DataFrame]


def op1_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    return quality.score(docs, quality.train(docs, read(spark, sf_dir, "labels")))


def op2_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    mix = mixing.shares(read(spark, sf_dir, "documents"))
    return mix.select(
        "doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken")
    )


def op3_pii_surrogates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.report(read(spark, sf_dir, "documents"))


def op4_token_output(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = table_path(spark, "token-files")
    token_output.write(read(spark, sf_dir, "documents"), files)
    return token_output.digests(spark, files)


def op5_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Target: documents labelled as good."""
    docs = read(spark, sf_dir, "documents")
    good = (
        read(spark, sf_dir, "labels")
        .where("quality = 1 and toxic = 0")
        .select("doc_id", F.lit(True).alias("is_target"))
        .distinct()
    )
    marked = docs.select("doc_id", "text").join(small_side(good), "doc_id", "left")
    return lm_scoring.score(marked, F.col("is_target"))


def op6_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontamination.report(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))
    n_hit = F.size("words").cast("long")
    return found.select(
        "doc_id",
        "n_words",
        n_hit.alias("n_hit"),
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
        (n_hit > 0).alias("contaminated"),
    )


def op7_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.extract(read(spark, sf_dir, "pages"))


def op8_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secret_scan.spans(read(spark, sf_dir, "documents"))
    base = F.filter("spans", lambda s: s["kind"].isin(*secret_scan.BASE_KINDS))

    def listed(spans):
        parts = F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"]))
        return F.array_join(parts, ",")

    counts = [
        (F.size("spans") - F.size(F.array_remove("spans.kind", kind))).cast("long").alias(f"n_{kind}")
        for kind in secret_scan.BASE_KINDS
    ]
    return found.select(
        "doc_id", *counts, F.sha2(listed(base), 256).alias("base_sha256"), listed(F.col("spans")).alias("spans")
    )


def op9_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.duplicates(read(spark, sf_dir, "documents"))
    digits = F.lower(F.lpad(F.hex("fp"), 16, "0"))
    return found.select("doc_id", digits.alias("fingerprint"), "component_id")


def op10_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").withColumn("held_out", language.held_out("doc_id"))
    model = language.train(docs.where(~F.col("held_out")))
    return language.predict(docs, model).select(
        "doc_id", language.held_out("doc_id").alias("held_out"), "lang_pred", "score"
    )


def op11_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each document whose id's checksum is divisible by five is checked as a copy in lower case."""
    tampered = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0
    lowered = F.translate("text", string.ascii_uppercase, string.ascii_lowercase)
    claim = {"text": F.when(tampered, lowered).otherwise(F.col("text"))}
    return merkle.verify(merkle.proofs(merkle.build(read(spark, sf_dir, "documents"), claim)))


def op12_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = stage(packing.pieces(read(spark, sf_dir, "documents")), "pieces")
    return packing.pack(found).select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")


def op13_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A conversation takes up to five turns from the one that begins its hundred."""
    conv = F.col("conv_id")
    head = F.crc32(conv.cast("string").cast("binary")) % 6
    return prefix_trie.trie(read(spark, sf_dir, "conversations"), conv - conv % 100, head, most=5)


QUERIES: dict[str, Query] = {
    q.__name__: q
    for q in (
        op1_quality_rules,
        op2_mix_sources,
        op3_pii_surrogates,
        op4_token_output,
        op5_lm_scoring,
        op6_decontaminate,
        op7_html_text,
        op8_secret_scan,
        op9_simhash,
        op10_language_id,
        op11_merkle_manifest,
        op12_best_fit_packing,
        op13_prefix_trie,
    )
}

#: Words of op6: everything but ASCII characters that are neither letters nor digits.
_BENCHMARK_WORDS = r"""regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
    'abcdefghijklmnopqrstuvwxyz'), '[0-9a-z\x{80}-\x{10FFFF}]+')"""

ORACLE_SQL: dict[str, str] = {
    "op11_merkle_manifest": digests_sql.MERKLE,
    "op13_prefix_trie": digests_sql.TRIE,
    "op2_mix_sources": r"""
WITH RECURSIVE sized AS (
    SELECT doc_id, source, md5('17|' || coalesce(doc_id::VARCHAR, 'null')) AS draw,
           coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size
    FROM documents),
sources AS (
    SELECT source, sum(size)::BIGINT AS source_size,
           [5.0, 2.0, 1.0][1 + ((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3)]::DOUBLE AS weight
    FROM sized GROUP BY source),
-- Each round clamps what is over its cap and shares the rest out again, until nothing is.
rounds AS (
    SELECT 0 AS n, [NULL::VARCHAR][1:0] AS clamped, false AS done
    UNION ALL
    SELECT n + 1, now.over, len(now.over) = len(clamped)
    FROM rounds, LATERAL (
        SELECT coalesce(list(coalesce(s.source, '')) FILTER (
            s.weight * (t.budget - t.held) / t.open >= 2.0 * s.source_size
            OR list_contains(clamped, coalesce(s.source, ''))), []) AS over
        FROM sources s, (
            SELECT 1.5 * sum(source_size) AS budget,
                   coalesce(sum(2.0 * source_size) FILTER (list_contains(clamped, coalesce(source, ''))), 0) AS held,
                   sum(weight) FILTER (NOT list_contains(clamped, coalesce(source, ''))) AS open
            FROM sources) t) now
    WHERE NOT done AND n < 1000),
final AS (SELECT clamped FROM rounds ORDER BY n DESC LIMIT 1),
targets AS (
    SELECT s.source, s.source_size, round(CASE WHEN list_contains(clamped, coalesce(s.source, ''))
        THEN 2.0 * s.source_size ELSE s.weight * (t.budget - t.held) / t.open END, 6) AS target
    FROM sources s, final, (
        SELECT 1.5 * sum(source_size) AS budget,
               coalesce(sum(2.0 * source_size) FILTER (list_contains(clamped, coalesce(source, ''))), 0) AS held,
               sum(weight) FILTER (NOT list_contains(clamped, coalesce(source, ''))) AS open
        FROM sources, final) t),
plan AS (
    SELECT *, CASE WHEN source_size > 0 THEN floor(target / source_size) ELSE 0 END::BIGINT AS whole,
           target - whole * source_size AS missing FROM targets),
-- The head of each source, in the order of the draw, up to where half of a document still fits.
cut AS (
    SELECT d.*, p.source_size, p.target, p.whole, p.missing,
           p.missing > 0 AND sum(d.size) OVER (PARTITION BY d.source ORDER BY d.draw, d.doc_id, d.size
               ROWS UNBOUNDED PRECEDING) - d.size / 2.0 <= p.missing AS extra
    FROM sized d JOIN plan p ON d.source IS NOT DISTINCT FROM p.source),
missed AS (
    SELECT *, missing - coalesce(sum(size) FILTER (extra) OVER (PARTITION BY source), 0) AS miss FROM cut),
-- The one document whose size is nearest to the miss is added or left out.
swaps AS (
    SELECT *, (extra = (miss < 0)) AND abs(abs(miss) - size) < abs(miss) AS usable,
           row_number() OVER (PARTITION BY source, (extra = (miss < 0)) AND abs(abs(miss) - size) < abs(miss)
               ORDER BY abs(abs(miss) - size), draw, doc_id, size) AS place
    FROM missed)
SELECT doc_id, size, source_size, target,
       size * (whole + (extra <> (usable AND place = 1))::BIGINT) AS taken
FROM swaps""",
    "op6_decontaminate": rf"""
WITH items AS (
    SELECT coalesce(item_id::VARCHAR, 'null') AS item, {_BENCHMARK_WORDS} AS w FROM benchmark),
windows AS (
    SELECT DISTINCT item, m, array_to_string(w[a:a + m - 1], ' ') AS gram
    FROM (SELECT item, w, least(len(w), 10) AS m, unnest(range(1, len(w) - least(len(w), 10) + 2)) AS a
          FROM items WHERE len(w) > 0)),
lengths AS (SELECT DISTINCT m FROM windows),
docs AS (SELECT row_number() OVER () AS r, doc_id, coalesce({_BENCHMARK_WORDS}, []) AS w FROM documents),
grams AS (
    SELECT r, m, a, array_to_string(w[a:a + m - 1], ' ') AS gram
    FROM (SELECT r, w, m, unnest(range(1, len(w) - m + 2)) AS a FROM docs, lengths WHERE len(w) >= m)),
hits AS (SELECT r, a, g.m, item FROM grams g JOIN windows v ON g.m = v.m AND g.gram = v.gram),
covered AS (
    SELECT r, count(DISTINCT p) AS n_hit
    FROM (SELECT r, unnest(range(a, a + m)) AS p FROM hits) GROUP BY r),
found AS (
    SELECT r, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS listed
    FROM (SELECT DISTINCT r, item FROM hits) GROUP BY r)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit,
       coalesce(n_items, 0)::BIGINT AS n_items, sha256(coalesce(listed, '')) AS items_sha256,
       coalesce(n_hit, 0) > 0 AS contaminated
FROM docs LEFT JOIN covered USING (r) LEFT JOIN found USING (r)""",
}
