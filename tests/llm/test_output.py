"""Mixing, surrogates, token files, model scores, page text, secrets and the pipeline."""

import random
import zlib

import duckdb
import numpy as np
import pytest
import regex
from brute import base_spans, losses, water_level, words
from pyspark.sql import functions as F

import corpus_pipeline
from couponflow.llm import html_text, lm_scoring, mixing, pii, queries, rans, secret_scan, token_output
from couponflow.llm.tables import slices
from couponflow.session import stage, table_path


def pairs(df, *columns):
    return [tuple(r) for r in df.select(*columns).collect()]


def test_mix_reaches_its_targets(spark, tables):
    rows = queries.op2_mix_sources(spark, tables)
    docs = spark.read.parquet(f"{tables}/documents.parquet").select("doc_id", "source")
    found = rows.join(docs, "doc_id").groupBy("source", "source_size", "target").agg(F.sum("taken").alias("taken"), F.max("size").alias("longest"))
    found = {r.source: r for r in found.collect()}
    sizes = {s: r.source_size for s, r in found.items()}
    weights = {s: (5, 2, 1)[i % 3] for i, s in enumerate(sorted(sizes))}
    wanted = water_level(sizes, weights, 1.5 * sum(sizes.values()), 2)
    for s, r in found.items():
        assert r.target == pytest.approx(wanted[s], abs=1e-5)
        assert abs(r.taken - r.target) <= r.longest / 2 + 1
    assert rows.where("taken > 2 * size").count() == 0
    assert sorted(rows.collect()) == sorted(queries.op2_mix_sources(spark, tables).collect())


def test_mix_awkward_rows(awkward, no_docs):
    found = mixing.shares(awkward)
    assert sorted(map(str, pairs(found, "doc_id", "size"))) == sorted(str((d, len(words(t)))) for d, t in pairs(awkward, "doc_id", "text"))
    mixed = mixing.materialize(awkward)
    assert mixed.columns == awkward.columns
    assert mixed.count() == found.agg(F.sum("copies")).first()[0]
    assert mixing.shares(no_docs).count() == 0


def test_op2_oracle(spark, tables):
    duck = duckdb.connect()
    duck.execute(f"CREATE VIEW documents AS SELECT * FROM '{tables}/documents.parquet'")
    result = duck.execute(queries.ORACLE_SQL["op2_mix_sources"])
    names = [d[0] for d in result.description]
    rows = queries.op2_mix_sources(spark, tables)
    assert sorted(rows.columns) == sorted(names)
    assert sorted(result.fetchall()) == sorted(pairs(rows, *names))


def test_surrogates(spark, no_docs, awkward):
    texts = [
        "Mrs Smith met Anna Smith, ANNA SMITH and Иван Петров. Μαρία Παππά came.",
        "(456) 555-2186 and +1 456-555-2186; bo.2@mail.co BO.2@MAIL.CO",
        "4539 1488 0343 6467 or 4539148803436467, 1234123412341234, 078-05-1120, 10.0.0.1",
        "999.1.1.1 1.2.3.4.5 version 2.0. and 12345 a@b stay",
        None,
        "",
    ]
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    got = {r.doc_id: r for r in pii.report(docs, "k").collect()}
    assert got[3].text == texts[3] and got[4].text is None and got[5].text == ""
    assert [got[i].n_entities for i in range(6)] == [5, 4, 5, 0, 0, 0]
    anna, loud = got[0].text.split(" met ")[1].split(", ")[0], got[0].text.split(", ")[1].split(" and ")[0]
    assert anna.upper() == loud and anna.split()[1] == got[0].text.split()[1] and anna.split()[0].endswith("a")
    assert any("а" <= c <= "я" for c in got[0].text) and any("α" <= c <= "ω" for c in got[0].text)
    first, second = got[1].text.split(" and ")[0], got[1].text.split("+1 ")[1].split(";")[0]
    assert first.translate(str.maketrans("", "", "() -")) == second.replace("-", "")
    mail = got[1].text.split("; ")[1].split()
    assert mail[0].upper() == mail[1] and mail[0] != "bo.2@mail.co"
    card, same = got[2].text.split(",")[0].split(" or ")
    assert card.replace(" ", "") == same and card[0] == "4" and len(same) == 16
    digits = [int(c) for c in same]
    assert sum(d * 2 - 9 * (d > 4) if i % 2 == 0 else d for i, d in enumerate(digits)) % 10 == 0
    assert pii.replace(awkward).columns == awkward.columns and pii.replace(awkward).count() == awkward.count()
    assert pii.report(no_docs).count() == 0


NAMES = [
    ("Dr Maria Elena Garcia spoke. Later Garcia left; GARCIA's car.", ["Maria", "Elena", "Garcia", "GARCIA"], 3),
    ("Mary Ann Smith and Dr John O'Brien, Mary Smith-Jones.", ["Mary", "Ann", "Smith", "O'B", "Brien", "Jones"], 3),
    ("Mr\nSmith, Anna  Smith, Olivia Brown, Señor Pérez. Prof. Dr. John F. van der Berg. The end", ["Smith", "Brown", "Pérez", "F.", "Berg"], 5),
    ("Mr Smith\nThe day. Jean-Pierre Dupont met Dupont", ["Smith", "Jean", "Pierre", "Dupont"], 3),
    ("+49 30 1234567 and +44 20 7946 0958 or +4915112345678", ["30 1234567", "20 7946 0958", "15112345678"], 3),
    ("378282246310005, 3782 822463 10005 and 6011000990139424 5555555555554444", ["8282246310005", "822463", "11000990139424", "55555555"], 4),
    ("DE89 3704 0044 0532 0130 00 is mine", ["3704", "0532"], 1),
    ("fe80::1ff:fe23:4567:890a, 2001:0db8:85a3:0000:0000:8a2e:0370:7334, jörg@müller.de", ["fe80", "85a3", "jörg", "müller"], 3),
]
NO_ENTITIES = "std::abs 12:30:45 20240101123000 12 12345678901234 2024 01 01 12 30 00 The Mister was Here; version 1.2.3-4"


def test_names_and_numbers_of_all_forms(spark):
    rows = [(i, t) for i, (t, _, _) in enumerate(NAMES)] + [(99, NO_ENTITIES)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: r for r in pii.report(docs, "k").collect()}
    for i, (_, gone, n) in enumerate(NAMES):
        assert got[i].n_entities == n
        assert not [g for g in gone if g in got[i].text]
    assert got[99].n_entities == 0 and got[99].text == NO_ENTITIES
    # One person, one surrogate: in full, alone, and in capitals; marks, particles and codes stay.
    full, alone = got[0].text.split(" spoke. Later ")
    surname = full.split()[-1]
    assert alone == f"{surname} left; {surname.upper()}'s car."
    assert got[1].text.split(",")[0].split()[2] == got[1].text.split("-")[0].split()[-1] == got[2].text.split(",")[0].split("\n")[1]
    assert " van der " in got[2].text and got[2].text.endswith("The end") and "\nThe day. " in got[3].text
    assert got[4].text.startswith("+49 ") and " +44 " in got[4].text and " or +49" in got[4].text
    assert got[6].text.startswith("DE") and len(got[6].text) == len(NAMES[6][0])
    account = got[6].text[: -len(" is mine")].replace(" ", "")
    assert int("".join(str(int(c, 36)) for c in account[4:] + account[:4])) % 97 == 1


def plain_found(text):
    """The matches of a text, by the same grammar in plain Python."""
    values = [m.group() for m in regex.finditer(pii.ANY, text)]
    people = [v for v in values if regex.match(r"\p{Lu}[^0-9@]*$", v)]
    words = {w for v in people for w in regex.findall(pii._WORD, v)} - set(pii.TITLES)
    forms = words | {w.upper() for w in words} | {w[:1].upper() + w[1:].lower() for w in words}
    alone = sorted(forms & set(regex.findall(pii._WORD, text)), reverse=True)
    if alone:
        values = [m.group() for m in regex.finditer(pii.ANY + r"|(?<!\p{L})(?:" + "|".join(alone) + r")(?!\p{L})", text)]
    return values


def test_detection_against_plain_python(spark, tables):
    texts = [r.text for r in spark.read.parquet(f"{tables}/documents.parquet").select("text").collect() if r.text]
    draw = random.Random(7)
    bits = [t for t, _, _ in NAMES] + [NO_ENTITIES, "Mrs Smith met ANNA SMITH and Иван Петров. Μαρία Παππά came.", "bo.2@mail.co 10.0.0.1 078-05-1120"]
    words = [w for b in bits for w in b.split(" ")]
    made = [draw.choice(" \n").join(draw.choices(words, k=draw.randint(1, 40))) for _ in range(200)]
    docs = spark.createDataFrame([(t,) for t in texts + made], "text string")
    for r in docs.select("text", pii._found(F.col("text")).alias("found")).collect():
        assert r.found.values == plain_found(r.text)


def test_surrogates_in_very_long_texts(spark):
    """Long runs of nearly matching text neither exhaust the matcher nor hide what follows."""
    runs = ["x@" + "a." * 30_000 + "2", "1234 " * 20_001, "1.2.3." * 20_000, "Mr " + "A" * 50_000 + "1", "a" * 50_000]
    docs = spark.createDataFrame([(i, f"{t} | bo@mail.co") for i, t in enumerate(runs)], "doc_id long, text string")
    for r in pii.report(docs).collect():
        assert r.n_entities >= 1 and not r.text.endswith(" bo@mail.co")


def test_surrogates_are_distinct(spark, monkeypatch):
    """More entities than a small space holds without collisions."""
    monkeypatch.setattr(pii, "_drawn", lambda key: (pii._number(key, 0, 3000) + 1000).cast("string"))
    entities = spark.range(300).select(F.lit("card").alias("kind"), (F.col("id") + 900).cast("string").alias("norm"))
    made = pii.surrogates(entities).collect()
    own = {r.norm for r in made}
    assert len(made) == 300 == len({r.surrogate for r in made})
    assert not own & {r.surrogate for r in made}


def test_blocks_round_trip():
    rng = np.random.default_rng(0)
    for n in (0, 1, 127, 1000, 65_537, 300_000):
        ids = (rng.zipf(1.3, n) % 49_408).astype(np.uint32)
        table = rans.Frequencies.of(np.bincount(ids, minlength=49_408))
        block = rans.encode(ids, table)
        assert (rans.decode(block, table) == ids).all()
        _, _, lanes, _, segments, _, _ = rans.HEADER.unpack_from(block)
        step = rans.SEGMENT * lanes
        for k in range(segments):
            assert (rans.decode(block, table, k, k + 1) == ids[k * step : (k + 1) * step]).all()
        if n > 1000:
            broken = bytearray(block)
            broken[-3] ^= 1
            with pytest.raises(rans.Damaged):
                rans.decode(bytes(broken), table)
    with pytest.raises(rans.Damaged):
        rans.decode(b"short", table)


def expected_tokens(rows):
    tokenizer = token_output.word_ids(token_output.public_tokenizers.path(token_output.TOKENIZER)).tokenizer
    out, start = [], 0
    for doc, text in rows:
        ids = [*tokenizer.encode(text or "", add_special_tokens=False).ids, 1]
        out.append((doc, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    return out


def test_op4_against_the_tokenizer(spark, tables):
    docs = spark.read.parquet(f"{tables}/documents.parquet")
    rows = sorted(pairs(docs, "doc_id", "text"))
    assert sorted(queries.op4_token_output(spark, tables).collect()) == expected_tokens(rows)


def test_token_files_awkward_rows(spark, awkward, no_docs, monkeypatch):
    monkeypatch.setattr(token_output, "IDS_PER_SHARD", 20_000)
    odd = ["don't THEY'VE 's", "<|endoftext|> x<|startoftext|>y <|ENDOFTEXT|>", "1½²³ ªº Ⅷ", "H̱ İ ΑΣ ΑΣ'Α", "a\xa0b\x1cc"]
    more = spark.createDataFrame([(100 + i, t) for i, t in enumerate(odd)], "doc_id long, text string")
    docs = awkward.select("doc_id", "text").unionByName(more)
    path = table_path(spark, "test-files")
    token_output.write(docs, path)
    got = token_output.digests(spark, path).collect()
    expected = expected_tokens(pairs(docs, "doc_id", "text"))
    assert sorted(str((r.doc_id, r.n_tokens, r.ids_crc32)) for r in got) == sorted(str((d, n, c)) for d, _, n, c in expected)
    in_order = sorted(got, key=lambda r: r.start)
    assert [r.start for r in in_order] == list(np.cumsum([0, *[r.n_tokens for r in in_order[:-1]]]))
    ids = [-1 if r.doc_id is None else r.doc_id for r in in_order]
    assert ids == sorted(ids)
    whole = {r.start: r.ids for r in token_output.read(spark, path).collect()}
    assert all(zlib.crc32(np.array(whole[r.start], "<u4").tobytes()) == r.ids_crc32 for r in got)
    token_output.write(no_docs, empty := table_path(spark, "test-files"))
    assert token_output.digests(spark, empty).count() == 0


def test_lm_scores(spark, awkward, no_docs):
    rows = [(i, "red green blue " * 30 if i % 2 else "one two three " * 30) for i in range(10)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    scored = lm_scoring.score(docs, F.col("doc_id") % 2 == 1).collect()
    assert all((r.difference < 0) == (r.doc_id % 2 == 1) for r in scored)
    assert all(r.n_words == 90 for r in scored)
    found = lm_scoring.score(awkward, F.col("lang") == "fr").collect()
    counts = [(d, len(words(t))) for d, t in pairs(awkward, "doc_id", "text")]
    assert sorted(str((r.doc_id, r.n_words)) for r in found) == sorted(map(str, counts))
    assert all(r.target_loss == r.background_loss == 0 for r in found if not r.n_words)
    assert lm_scoring.score(no_docs, F.lit(True)).count() == 0


@pytest.mark.parametrize(("block", "ranged"), [(1 << 22, 1 << 22), (400, 900)])
def test_lm_scores_against_plain_counts(spark, tables, monkeypatch, block, ranged):
    """Exact counts, with documents in one block or in many, cells in one range or in many."""
    docs = spark.read.parquet(f"{tables}/documents.parquet").select("doc_id", "text")
    odd = [(-1, None), (-2, " "), (-3, "one"), (-4, "never-seen-before"), (None, "one one One")]
    docs = docs.where("doc_id < 60").unionByName(spark.createDataFrame(odd, "doc_id long, text string"))
    rows = pairs(docs, "doc_id", "text")
    for target in (F.col("doc_id") % 3 == 1, F.lit(None).cast("boolean")):
        good = {r.doc_id for r in docs.where(target).collect()}
        expected = losses(rows, good, lm_scoring.PAIR, lm_scoring.EQUAL)
        monkeypatch.setattr(lm_scoring, "BLOCK_WORDS", block)
        monkeypatch.setattr(lm_scoring, "RANGE_WORDS", ranged)
        found = lm_scoring.score(docs.repartition(4), target).collect()
        got = {r.doc_id: (r.n_words, r.target_loss, r.background_loss, r.difference) for r in found}
        assert len(found) == len(rows) and set(got) == set(expected)
        for doc, (n, of_target, of_all) in expected.items():
            assert got[doc] == pytest.approx((n, of_target, of_all, of_target - of_all), abs=1e-9)


def test_page_text(spark, tables):
    tree = html_text.default_tree()
    pages = {
        '<body><nav><a href="/">Home</a></nav><article><h1>T</h1><p>One <b>t</b>wo &amp; &#233;.<p>Be.</article>': "T One two & é. Be.",
        '<div class="cookie-notice"><p>We use cookies on this site to make all of it work well</p></div>': "",
        "<p>open <!-- comment": "",
        "<script>var a='<p>x</p>';</script>": "",
    }
    for page, text in pages.items():
        assert html_text.main_text(page, tree) == text
    assert html_text.main_text(None, tree) == html_text.main_text("", tree) == ""
    rows = [(1, None, None, "x"), (1, "u", "", "x"), (None, "u", "<p", "x"), (2, "u", "<p>a " * 5000, "x")]
    odd = spark.createDataFrame(rows, "page_id long, url string, html string, text string")
    assert html_text.extract(odd).count() == 4
    assert html_text.extract(odd.limit(0)).count() == 0
    found = queries.op7_html_text(spark, tables)
    assert found.where("n_chars != length(text)").count() == 0
    assert found.where("n_chars = 0").count() == 0


def test_op8_base_spans(spark, tables, awkward, no_docs):
    import hashlib

    texts = dict(pairs(spark.read.parquet(f"{tables}/documents.parquet"), "doc_id", "text"))
    for r in queries.op8_secret_scan(spark, tables).collect():
        spans = base_spans(texts[r.doc_id])
        assert r.base_sha256 == hashlib.sha256(",".join(spans).encode()).hexdigest()
        kinds = [s.split(":")[0] for s in spans]
        assert [r.n_assign, r.n_access, r.n_hex] == [kinds.count(k) for k in ("assign", "access", "hex")]
    assert secret_scan.spans(awkward).count() == awkward.count()
    assert secret_scan.spans(no_docs).count() == 0
    masked = secret_scan.redact(awkward).where("doc_id = 12").first().text
    assert masked.startswith("[assign] ")


def test_automaton_finds_what_the_rules_find():
    machine = secret_scan.automaton()
    rng = random.Random(3)
    parts = ["password", "=", "token", ": ", '"', "AKIA", "A1B2C3D4", "deadbeef", "0123456789abcdef", "\n", " ", "é", "ghp_"]
    parts += ["abcDEF1234567890", "xoxb-", "sk_live_", "eyJ", ".", "://", "u:p@", "-----BEGIN ", "PRIVATE KEY-----", "APIKEY", ","]
    texts = ["".join(rng.choices(parts, k=rng.randint(0, 60))) for _ in range(400)]
    texts += ["a" * 9000 + "token=abcdef123", "x " * 4000 + "secret = hunter22", "deadbeef" * 2000]
    got = secret_scan.find([t.encode() for t in texts], machine)
    for text, spans in zip(texts, got, strict=True):
        named = [f"{secret_scan.RULES[n].kind}:{s}:{e}" for s, n, e in spans]
        assert [s for s in named if s.split(":")[0] in secret_scan.BASE_KINDS] == base_spans(text)


def test_pipeline(spark, tables, awkward):
    docs = spark.read.parquet(f"{tables}/documents.parquet")
    columns, before = docs.columns, docs.count()
    kept = docs
    for _, apply in corpus_pipeline.STAGES[:3]:
        kept = apply(spark, kept, tables)
        assert kept.columns == columns
    assert 0 < kept.count() < before
    assert kept.select("doc_id").distinct().count() == kept.count()
    result = corpus_pipeline.run(spark, tables).collect()
    assert {r.doc_id for r in result} <= {r.doc_id for r in kept.select("doc_id").collect()}
    assert len(corpus_pipeline.STAGES) == 5


@pytest.mark.parametrize("table", ["awkward", "no_docs"])
def test_pipeline_stages_on_awkward_and_empty_tables(request, spark, tables, table):
    """Every stage takes what the one before kept; awkward rows have extra columns with the operators' names."""
    docs = request.getfixturevalue(table)
    columns = docs.columns
    for n, (_, apply) in enumerate(corpus_pipeline.STAGES):
        docs = stage(apply(spark, docs, tables), "stage")
        if n < 4:
            assert docs.columns == columns
    assert docs.columns == ["doc_id", "start", "n_tokens", "ids_crc32"]
    assert (docs.count() == 0) == (table == "no_docs")


def test_slices_hold_all_rows():
    import pyarrow as pa

    batch = pa.record_batch([pa.array(range(100)), pa.array(["x" * 1000] * 100)], names=["n", "text"])
    empty = batch.slice(0, 0)
    parts = list(slices(iter([batch, empty, batch]), 10_000))
    assert [n for p in parts for n in p.column("n").to_pylist()] == [*range(100), *range(100)]
    assert 10 <= len(parts) <= 40
    assert [p.num_rows for p in slices(iter([batch.slice(0, 2)]), 1)] == [1, 1]
