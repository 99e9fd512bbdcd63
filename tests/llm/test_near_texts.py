"""Near-duplicate texts of the pipeline's stage against brute-force pairs."""

import random

import corpus_pipeline
import numpy as np
import pytest

from couponflow.llm import near_texts


def similarity(a, b):
    a, b = ({tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set() for w in (a.lower().split(), b.lower().split()))
    return len(a & b) / len(a | b) if a | b else 1.0


def kept_ids(rows):
    """Smallest id of each component of pairs with similarity 0.8 or more."""
    root = {d: d for d, _ in rows}

    def top(d):
        while root[d] != d:
            d = root[d]
        return d

    for i, (d, a) in enumerate(rows):
        for e, b in rows[i + 1 :]:
            if similarity(a, b) >= 0.8:
                d_top, e_top = sorted((top(d), top(e)))
                root[e_top] = d_top
    return sorted({top(d) for d in root})


def changed(words, places, mark):
    return " ".join(f"{mark}{i}" if i in places else w for i, w in enumerate(words))


def test_stage_links_what_brute_force_links(spark):
    """Copies with one to twelve changed words, chains, and groups just below the threshold."""
    draw = random.Random(3)
    texts = []
    for group in range(40):
        words = [f"w{draw.randrange(400)}" for _ in range(draw.randrange(60, 300))]
        texts.append(" ".join(words))
        for copy in range(4):
            texts.append(changed(words, set(draw.sample(range(len(words)), draw.randrange(1, 13))), f"g{group}c{copy}x"))
        for step in range(3):  # each like the one before, the last unlike the first
            words = words[len(words) // 12 :] + [f"s{group}t{step}n{i}" for i in range(len(words) // 12)]
            texts.append(" ".join(words))
    draw.shuffle(texts)
    rows = list(enumerate(texts))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    kept = sorted(r.doc_id for r in corpus_pipeline.near_duplicates(spark, docs, "").collect())
    expected = kept_ids(rows)
    assert 40 <= len(expected) < len(rows) - 40
    assert kept == expected


@pytest.mark.parametrize("columns", [1 << 14, 7])
def test_intersections_of_a_tile(monkeypatch, columns):
    monkeypatch.setattr(near_texts, "MATRIX_COLUMNS", columns)
    draw = np.random.default_rng(1)
    sets = [np.unique(draw.integers(0, 90, n).astype(np.uint64) << np.uint64(50)) for n in (0, 1, 5, 30, 60, 60, 200)]
    left, right = sets, sets[2:5]
    expected = [[len(np.intersect1d(a, b)) for b in right] for a in left]
    assert near_texts.intersections(left, right).tolist() == expected
    assert near_texts.intersections(sets[:1], sets[:1]).tolist() == [[0]]


def test_texts_that_share_a_template(spark, monkeypatch):
    """Texts mostly of one template and not similar, some true pairs and chains among them; many blocks a key."""
    monkeypatch.setattr(near_texts, "BLOCK_NODES", 9)
    draw = random.Random(8)
    template = [f"t{i}" for i in range(80)]
    texts = []
    for n in range(150):
        own = template + [f"own{n}x{i}" for i in range(draw.choice([22, 30, 40]))]
        texts.append(" ".join(own))
        if n % 10 == 0:
            texts.append(changed(own, {len(own) - 1}, f"c{n}x"))
    draw.shuffle(texts)
    rows = list(enumerate(texts))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    kept = sorted(r.doc_id for r in corpus_pipeline.near_duplicates(spark, docs, "").collect())
    expected = kept_ids(rows)
    assert len(expected) == 150 and kept == expected


def test_near_texts_awkward_rows(awkward, no_docs):
    kept = near_texts.deduplicate(awkward)
    assert kept.columns == awkward.columns
    rows = [(d, t or "") for d, t in awkward.select("doc_id", "text").collect() if d is not None]
    first = {}
    for d, t in rows:
        first.setdefault((d, t), (d, t))
    assert sorted(r.doc_id for r in kept.collect()) == kept_ids(sorted(first.values()))
    assert near_texts.deduplicate(no_docs).count() == 0


def test_fingerprints_link_texts_that_shingle_sets_keep_apart(spark):
    same = "again " * 200
    texts = [f"{same} one two three four five six seven", f"{same} eight nine ten eleven twelve thirteen", "quite another text"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    kept = lambda found: sorted(r.doc_id for r in found.select("doc_id").collect())
    assert kept(near_texts.deduplicate(docs)) == [0, 1, 2]
    assert kept(corpus_pipeline.near_duplicates(spark, docs, "")) == [0, 2]
    # Rows without an id or a text, and a row that comes twice.
    odd = spark.createDataFrame([*enumerate(texts), (0, texts[0]), (None, texts[2]), (7, None)], "doc_id long, text string")
    assert kept(corpus_pipeline.near_duplicates(spark, odd, "")) == [0, 2, 7]
