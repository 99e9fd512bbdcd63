"""Quality rules, decontamination, SimHash and language identification against plain versions."""

import math
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from brute import base_counts, components, contamination, fingerprint
from pyspark.sql import functions as F

from couponflow.llm import decontamination, language, quality, queries, simhash
from couponflow.llm.components import components as connected


@pytest.fixture(scope="module")
def docs(spark, tables):
    return spark.read.parquet(f"{tables}/documents.parquet")


def pairs(df, *columns):
    return [tuple(r) for r in df.select(*columns).collect()]


def items(spark, rows):
    return spark.createDataFrame(rows, "item_id long, text string, doc_id long")


def test_op1_base_columns_and_verdicts(spark, tables, docs):
    found = queries.op1_quality_rules(spark, tables).collect()
    texts = dict(pairs(docs, "doc_id", "text"))
    for r in found:
        counts = (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed)
        assert counts == base_counts(texts[r.doc_id])
        assert not (r.kept and r.base_failed)
    assert len(found) == docs.count()


def test_quality_awkward_rows(awkward, no_docs, spark):
    found = quality.score(awkward, None)
    expected = sorted((str((d, *base_counts(t))) for d, t in pairs(awkward, "doc_id", "text")))
    columns = ["doc_id", *quality.COUNTS, "base_failed"]
    assert sorted(str(tuple(r)) for r in found.select(*columns).collect()) == expected
    assert quality.keep(awkward, None).columns == awkward.columns
    assert quality.keep(awkward, None).count() == found.where("kept").count()
    assert quality.score(no_docs, None).count() == 0
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert quality.train(awkward, labels) is None


def test_quality_repeated_ids_count_once(spark, tables, docs):
    labels = spark.read.parquet(f"{tables}/labels.parquet")
    once, twice = (quality.train(d, labels) for d in (docs, docs.unionByName(docs)))
    assert np.array_equal(once.threshold, twice.threshold) and np.array_equal(once.value, twice.value)


def test_trees_are_monotonic_and_learn():
    rng = np.random.default_rng(0)
    x = rng.random((3000, 3))
    y = ((x[:, 0] < 0.5) ^ (rng.random(3000) < 0.05)).astype(float)
    model = quality.fit(x, y, signs=(-1, 1, 0))
    assert (model.probability(x).round() == (x[:, 0] < 0.5)).mean() > 0.97
    for feature, sign in ((0, -1), (1, 1)):
        grid = np.tile(rng.random(3), (200, 1))
        grid[:, feature] = np.linspace(-0.5, 1.5, 200)
        assert (sign * np.diff(model.probability(grid)) >= -1e-12).all()
    assert quality.fit(x, np.ones(3000), signs=(0, 0, 0)) is None


def test_quality_held_out(spark):
    """Trained on half of the labelled rows, right on the others."""
    sf = "/root/testdata/sf0.1"
    documents = spark.read.parquet(f"{sf}/documents.parquet")
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    half = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 2 == 0
    trees = quality.train(documents, labels.where(half))
    scored = quality.score(documents, trees).join(labels.where(~half), "doc_id")
    right = (F.col("kept") == (F.col("quality") == 1)) | F.col("base_failed")
    good = scored.where("quality = 1 and not base_failed")
    assert scored.agg(F.avg(right.cast("int"))).first()[0] > 0.97
    assert good.agg(F.avg(F.col("kept").cast("int"))).first()[0] > 0.98


def test_decontamination(spark, awkward, no_docs):
    passage = " ".join(f"word{i % 97} thing{i % 31}" for i in range(10, 20))
    rows = [(1, passage, 9), (1, passage, 9), (2, "Two, WORDS!", 9), (3, None, 9), (4, "?!", 9), (None, "你好", 9)]
    bench = items(spark, rows)
    found = decontamination.report(awkward, bench)
    digest = F.sha2(F.array_join("items", ","), 256)
    got = pairs(found, "doc_id", "n_words", F.size("words"), F.size("items"), digest, F.size("words") > 0)
    expected = contamination(pairs(awkward, "doc_id", "text"), [(a, b) for a, b, _ in rows])
    assert sorted(map(str, got)) == sorted(map(str, expected))
    clean = decontamination.remove_documents(awkward, bench)
    assert clean.columns == awkward.columns
    assert clean.count() == sum(not e[5] for e in expected)
    cut = decontamination.remove_spans(awkward, bench)
    assert cut.count() == awkward.count()
    assert all(not e[5] for e in contamination(pairs(cut, "doc_id", "text"), [(a, b) for a, b, _ in rows[:2]]))
    assert decontamination.report(no_docs, bench).count() == 0
    assert decontamination.report(awkward, bench.limit(0)).where(F.size("words") > 0).count() == 0


def test_decontamination_without_the_hash_set(spark, awkward, monkeypatch):
    bench = items(spark, [(1, " ".join(f"word{i % 97} thing{i % 31}" for i in range(10, 20)), 9)])
    whole = pairs(decontamination.report(awkward, bench), "doc_id", "words")
    monkeypatch.setattr(decontamination, "SET_LIMIT", 2)
    assert sorted(map(str, pairs(decontamination.report(awkward, bench), "doc_id", "words"))) == sorted(map(str, whole))


def test_spans_keep_the_other_text(spark):
    docs = spark.createDataFrame([(1, "Keep -- a B, c; d? End!\n"), (2, "a b c d")], "doc_id long, text string")
    bench = items(spark, [(1, "a b c d", 0)])
    cut = dict(pairs(decontamination.remove_spans(docs, bench), "doc_id", "text"))
    assert cut == {1: "Keep? End!\n", 2: ""}


def test_op9_against_brute_force(spark, tables, docs):
    got = sorted(pairs(queries.op9_simhash(spark, tables), "doc_id", "fingerprint", "component_id"))
    texts = pairs(docs, "doc_id", "text")
    assert got == sorted(components([(d, fingerprint(t)) for d, t in texts]))


def test_simhash_awkward_rows(awkward, no_docs):
    found = simhash.duplicates(awkward).collect()
    expected = components([(d, fingerprint(t)) for d, t in pairs(awkward, "doc_id", "text")])
    got = [(r.doc_id, f"{r.fp & (1 << 64) - 1:016x}", r.component_id) for r in found]
    assert sorted(map(str, got)) == sorted(map(str, expected))
    kept = simhash.deduplicate(awkward)
    assert kept.columns == awkward.columns
    assert sorted(r.doc_id for r in kept.collect()) == sorted({e[2] for e in expected})
    assert simhash.deduplicate(no_docs).count() == 0


def test_tiled_comparison_misses_no_link(spark):
    """Random fingerprints and their neighbours, in small chunks, against all pairs."""
    rng = np.random.default_rng(5)
    base = rng.integers(0, 1 << 63, 150, dtype=np.uint64)
    near = [base ^ np.uint64(1 << int(a)) ^ np.uint64(1 << int(b)) for a, b in rng.integers(0, 64, (12, 2))]
    far = base ^ np.uint64(0b111)
    fps = sorted({int(f) for f in np.concatenate([base, far, *near])})
    signed = [f - (1 << 64) if f >> 63 else f for f in fps]
    rows = spark.createDataFrame([(s,) for s in signed], "fp long")
    got = connected(simhash.links(rows, chunk=8))
    root = {r.node: r.root for r in got.collect()}
    place = dict(zip(signed, fps, strict=True))
    classes = {}
    for s in signed:
        classes.setdefault(root.get(s, s), set()).add(place[s])
    named = {}
    for fp, _, name in components([(f, f) for f in fps]):
        named.setdefault(name, set()).add(fp)
    assert sorted(map(sorted, classes.values())) == sorted(map(sorted, named.values()))


def test_components_of_a_path_and_a_star(spark):
    path = [(i, i + 1) for i in range(40)]
    star = [(1000, i) for i in range(1001, 1300)]
    links = spark.createDataFrame([*path, *star, (7, 7), (5, 4)], "a long, b long")
    root = {r.node: r.root for r in connected(links).collect()}
    assert root == {**dict.fromkeys(range(41), 0), **dict.fromkeys(range(1000, 1300), 1000)}


def test_op10_held_out(spark, tables):
    found = queries.op10_language_id(spark, tables)
    known = spark.read.parquet(f"{tables}/documents.parquet").select("doc_id", "lang").join(found, "doc_id")
    right = known.where("held_out").agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("int"))).first()[0]
    assert right > 0.9
    assert found.where("score < 0 or score > 1").count() == 0


def test_language_awkward_rows(awkward, no_docs, monkeypatch):
    model = language.train(awkward)
    assert model.languages == ["en", "fr"]
    assert model.predict(None) == model.predict("12 ?") == ("und", 0.0)
    assert language.predict(awkward, model).count() == awkward.count()
    assert language.train(no_docs).predict("text") == ("und", 0.0)
    text = "Some words, été 你好 and more of them. " * 30
    whole = language.slots(text)
    monkeypatch.setattr(language, "BLOCK", 17)
    assert (language.slots(text) == whole).all()


def _plain_slots(text):
    """Slots of a text's n-grams, one at a time."""
    mask = 0xFFFFFFFF
    low = [ord(c) if c.isalpha() else 32 for c in f" {text.lower()} "]
    for i in range(len(low)):
        h = 0
        for order in language.ORDERS:
            if i + order > len(low):
                break
            h = (h + low[i + order - 1] * language.MULTIPLIERS[order - 1]) & mask
            if low[i] == 32 and low[i + order - 1] == 32:
                continue
            g = ((h ^ (h >> 15)) * 0x2C1B3C6D) & mask
            yield (g ^ (g >> 16)) & (language.BUCKETS - 1)


def test_op10_against_plain_counts(spark, tables, monkeypatch):
    """All predictions and scores equal those of plain naive Bayes, whatever texts share a batch."""
    rows = spark.read.parquet(f"{tables}/documents.parquet").select("doc_id", "text", "lang").collect()
    learned = [r for r in rows if zlib.crc32(str(r.doc_id).encode()) % 5 and r.lang is not None]
    counts = {lang: Counter() for lang in sorted({r.lang for r in learned})}
    for r in learned:
        counts[r.lang].update(_plain_slots(r.text or ""))
    size = {lang: c.total() + language.SMOOTHING * language.BUCKETS for lang, c in counts.items()}
    prior = {lang: sum(r.lang == lang for r in learned) / len(learned) for lang in counts}

    def scaled(share):
        return round(math.log(share) * language.SCALE)

    def plain(text):
        hits = Counter(_plain_slots(text or ""))
        if not hits:
            return "und", 0.0
        total = {
            lang: scaled(prior[lang])
            + sum(n * scaled((counts[lang][s] + language.SMOOTHING) / size[lang]) for s, n in hits.items())
            for lang in counts
        }
        best = max(total, key=total.get)
        return best, 1 / sum(math.exp((t - total[best]) / language.SCALE) for t in total.values())

    got = {r.doc_id: r for r in queries.op10_language_id(spark, tables).collect()}
    for r in rows:
        lang, score = plain(r.text)
        assert got[r.doc_id].lang_pred == lang and abs(got[r.doc_id].score - score) < 1e-6
    model = language.train(spark.createDataFrame(learned))
    texts = [r.text for r in rows[:300]] + ["", None, "12 ?", "a", "é\n" * 50]
    alone = [model.predict(t) for t in texts]
    for block in (1 << 19, 23):
        monkeypatch.setattr(language, "BLOCK", block)
        assert model.predict_all(texts) == alone
    monkeypatch.setattr(language, "TABLES", 1)
    assert sum(b.num_rows for b in language._counted(iter([pa.record_batch({"text": ["a", "b", "a"], "lang": ["x", "y", "z"]})]))) > 6
