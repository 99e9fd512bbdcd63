"""Hash tree, packing and prefix trie against plain versions."""

import hashlib
import random
import string
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

from couponflow.llm import merkle, packing, prefix_trie
from couponflow.llm.ranges import placed, ranges_for
from couponflow.llm.tables import ship
from couponflow.session import stage


def sha(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


# --- ranges


def test_places_of_equal_rows_in_a_large_group(spark):
    rows = [("a", i % 7) for i in range(400)] + [("b", 1), ("c", None), ("c", 2)]
    df = stage(spark.createDataFrame(rows, "g string, k int"), "t")
    found = placed(df, "g", ["k"], 5).collect()
    by_group = defaultdict(list)
    for r in found:
        by_group[r["g"]].append((r["place"], -1 if r["k"] is None else r["k"]))
        assert r["members"] == {"a": 400, "b": 1, "c": 2}[r["g"]]
    for own in by_group.values():
        own.sort()
        assert [p for p, _ in own] == list(range(len(own)))
        assert [k for _, k in own] == sorted(k for _, k in own)


def test_number_of_ranges_stays_bounded():
    assert ranges_for(0) == 1
    assert ranges_for(10**6) == 21
    assert ranges_for(5 * 10**10) == 10_001


# --- hash tree


def plain_leaf(row, text):
    fields = [row["doc_id"], row["source"], row["lang"], row["n_chars"], text]
    return sha("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in fields))


def plain_tree(leaves):
    """Proof of each leaf as (left, right) pairs, and what remains."""
    level, paths, place = list(leaves), [[] for _ in leaves], list(range(len(leaves)))
    while len(level) > 1:
        for i, at in enumerate(place):
            run = level[at // 16 * 16 : at // 16 * 16 + 16]
            paths[i].append(("".join(run[: at % 16]), "".join(run[at % 16 + 1 :])))
            place[i] = at // 16
        level = [sha("".join(level[i : i + 16])) for i in range(0, len(level), 16)]
    return paths, level[0]


def plain_manifest(rows):
    lower = str.maketrans(string.ascii_uppercase, string.ascii_lowercase)
    groups = defaultdict(list)
    for r in rows:
        groups[r["source"]].append((r["doc_id"] is not None, r["doc_id"] or 0, plain_leaf(r, r["text"]), r))
    order = sorted(groups, key=lambda s: (s is not None, (s or "").encode()))
    trees = {}
    for source in order:
        own = sorted(groups[source], key=lambda x: x[:3])
        trees[source] = (own, *plain_tree([x[2] for x in own]))
    top_paths, root = plain_tree([trees[s][2] for s in order])
    found = []
    for i, source in enumerate(order):
        own, paths, subroot = trees[source]
        for (_, _, leaf, r), path in zip(own, paths):
            path = path + top_paths[i]
            tampered = r["doc_id"] is not None and zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0
            text = r["text"].translate(lower) if tampered and r["text"] else r["text"]
            done = plain_leaf(r, text)
            for left, right in path:
                done = sha(left + done + right)
            proof = sha("".join(left + right for left, right in path))
            found.append((r["doc_id"], leaf, subroot, root, proof, done, done == root))
    return sorted(found, key=repr)


def checked(docs, **options):
    tampered = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0
    text = F.when(tampered, F.translate("text", string.ascii_uppercase, string.ascii_lowercase)).otherwise(F.col("text"))
    found = merkle.verify(merkle.proofs(merkle.build(docs, {"text": text}, **options)))
    columns = ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]
    return sorted((tuple(r) for r in found.select(*columns).collect()), key=repr)


def test_manifest_of_awkward_documents(spark, awkward):
    rows = [r.asDict() for r in awkward.collect()]
    assert checked(awkward) == plain_manifest(rows)


@pytest.mark.parametrize("segments", [0, 2, merkle.BROADCAST_SEGMENTS])
def test_manifest_of_a_hot_source_and_many_small_ones(spark, segments):
    ship(spark)
    docs = [(i, f"Text {i % 40}", "en", "hot", i) for i in range(700)]
    docs += [(1000 + i, None, None, f"é{i}" if i % 2 else f"S{i}", 3) for i in range(40)] + [(5, "A", "de", None, None)] * 20
    df = spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long")
    rows = [r.asDict() for r in df.collect()]
    found = checked(df, ranges=6, broadcast_segments=segments)
    assert found == plain_manifest(rows)
    assert {f[-1] for f in found} == {True, False}


@pytest.mark.parametrize("n", [1, 2, 16, 17, 257])
def test_manifest_of_one_source(spark, n):
    ship(spark)
    df = spark.createDataFrame(
        [(i, "Abc", "en", "s", 3) for i in range(n)], "doc_id long, text string, lang string, source string, n_chars long"
    )
    assert checked(df) == plain_manifest([r.asDict() for r in df.collect()])


def test_manifest_of_no_documents(no_docs):
    assert merkle.build(no_docs).root is None
    assert checked(no_docs) == []


# --- packing


def test_both_tokenizers_agree_on_all_characters():
    from tokenizers import Tokenizer

    encoder = packing.encoder(public_tokenizers.path(packing.TOKENIZER), public_tokenizers.path(packing.RANKS))
    whole = Tokenizer.from_file(public_tokenizers.path(packing.TOKENIZER))
    chars = [chr(c) for c in range(0x110000) if not 0xD800 <= c < 0xE000]
    for i in range(0, len(chars), 997):
        text = " ".join(f"{c}a {c}{c}1" for c in chars[i : i + 997 : 3])
        assert encoder.ids(text).tolist() == whole.encode(text, add_special_tokens=False).ids
    draw = random.Random(2)
    for _ in range(3000):
        text = "".join(draw.choices("ab'stre 1\n\t\r\x1c\x85 é🙂.,-", k=draw.randint(0, 30))) + draw.choice(["", "<|endoftext|>", " <|endoftext|>x"])
        assert encoder.ids(text).tolist() == whole.encode(text, add_special_tokens=False).ids


def test_a_text_the_fast_tokenizer_gives_up_on():
    encoder = packing.Encoder(public_tokenizers.path(packing.TOKENIZER), public_tokenizers.path(packing.RANKS))
    assert len(encoder.ids("a" + " " * 2_000_000 + "b")) > 0


@pytest.mark.parametrize("seed", range(12))
def test_plan_uses_every_piece_once(seed):
    draw = random.Random(seed)
    capacity = draw.choice([8, 60, 1024])
    counts = {draw.randint(1, capacity): draw.choice([1, 2, 3, 50, 10**6]) for _ in range(draw.randint(1, 200))}
    made, used = packing.plan(dict(counts), capacity), Counter()
    for contents, times in made:
        assert times > 0 and sum(k * n for k, n in contents.items()) <= capacity
        for length, n in contents.items():
            used[length] += n * times
    assert used == counts
    sequences = sum(times for _, times in made)
    total = sum(k * n for k, n in counts.items())
    # Two sequences are never both half empty.
    assert -(-total // capacity) <= sequences <= 2 * total // capacity + 1


def test_exact_complements_of_one_two_and_three():
    for counts in ({700: 9, 324: 9}, {600: 4, 400: 4, 24: 4}, {500: 3, 300: 3, 200: 3, 24: 3}, {512: 5}):
        total = sum(k * n for k, n in counts.items())
        assert sum(t for _, t in packing.plan(counts)) == -(-total // 1024)


def test_slots_are_gapless():
    counts = {300: 11, 212: 7, 100: 40, 1: 3000, 1024: 2}
    slots = packing.Slots(packing.plan(dict(counts)), 1024)
    inside = defaultdict(list)
    for length, n in counts.items():
        for s, o in zip(*slots.find(np.full(n, length), np.arange(n))):
            inside[int(s)].append((int(o), length))
    assert set(inside) == set(range(slots.sequences))
    for own in inside.values():
        at = 0
        for offset, length in sorted(own):
            assert offset == at
            at += length
        assert at <= 1024


def test_packed_documents(spark, awkward):
    from tokenizers import Tokenizer

    whole = Tokenizer.from_file(public_tokenizers.path(packing.TOKENIZER))
    found = stage(packing.pieces(awkward.repartition(3), with_ids=True), "pieces")
    packed = packing.pack(found)
    expected = Counter()
    for r in awkward.select("doc_id", "text").collect():
        ids = whole.encode(r["text"] or "", add_special_tokens=False).ids + [2]
        cut, piece = [0, *range(len(ids) % 1024 or 1024, len(ids) + 1, 1024)], 0
        for piece, (start, end) in enumerate(zip(cut, cut[1:])):
            crc = zlib.crc32(np.array(ids[start:end], dtype="<u4").tobytes())
            expected[(r["doc_id"], piece, start, end - start, crc)] += 1
    rows = packed.collect()
    assert Counter((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in rows) == expected
    own = defaultdict(list)
    for r in rows:
        own[r["sequence_id"]].append((r["offset"], bytes(r["ids"])))
    joined = {s: b"".join(ids for _, ids in sorted(parts)) for s, parts in own.items()}
    made = {r["sequence_id"]: r for r in packing.sequences(packed).collect()}
    assert {s: bytes(r["ids"]) for s, r in made.items()} == joined
    assert all(r["length"] == len(r["ids"]) // 4 == sum(r["lengths"]) <= 1024 for r in made.values())
    assert len(made) <= -(-sum(r["length"] for r in rows) // 1024) + 1


def test_packing_nothing(no_docs):
    assert packing.pack(stage(packing.pieces(no_docs), "pieces")).collect() == []


# --- prefix trie

TURNS = "conv_id long, turn long, role string, text string, d long, f1 string"


def plain_trie(rows):
    own = defaultdict(list)
    for conv, turn, role, text, *_ in rows:
        if conv is not None:
            own[conv].append((turn is not None, turn or 0, role or "", text or ""))
    rebuilt = {}
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % 6
        base = c - (c % 100 if c >= 0 else -(-c % 100))
        rebuilt[c] = [t[2:] for t in sorted(own.get(base, []))[:h] + sorted(turns)[h:]]
    nodes = defaultdict(list)
    for c, turns in rebuilt.items():
        for d in range(len(turns) + 1):
            nodes[tuple(turns[:d])].append(c)
    kids, leaves, saved = Counter(), Counter(), Counter()
    for node, convs in nodes.items():
        if node:
            kids[node[:-1]] += 1
    for node, convs in nodes.items():
        value = (len(convs) - 1) * len(node[-1][1]) if node else 0
        for d in range(len(node) + 1):
            saved[node[:d]] += value
            leaves[node[:d]] += kids[node] == 0
    found = []
    for node, convs in nodes.items():
        ends = ",".join(map(str, sorted(c for c in convs if len(rebuilt[c]) == len(node))))
        parent = min(nodes[node[:-1]]) if node else None
        found.append((min(convs), len(node), parent, len(convs), kids[node], leaves[node], saved[node], sha(ends)))
    return sorted(found, key=repr)


def tried(df, **options):
    conv = F.col("conv_id")
    head = F.crc32(conv.cast("string").cast("binary")) % 6
    found = prefix_trie.trie(df, conv - conv % 100, head, 5, **options)
    columns = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
    return sorted((tuple(r) for r in found.select(*columns).collect()), key=repr)


def awkward_turns():
    draw = random.Random(4)
    rows = []
    for c in [*range(0, 60), *range(100, 190), *range(205, 230), 300, -7, -100]:
        for k in range(draw.randint(1, 9)):
            rows.append((c, k, draw.choice(["user", "assistant"]), draw.choice(["a", "b", "Größe 🙂", ""]), 1, "x"))
    rows += [(400, None, None, None, 1, "x"), (400, None, "user", "first", 1, "x"), (400, 3, "user", "z", 1, "x"), (400, 3, "user", "y", 1, "x")]
    rows += [(400, 3, "user", "y", 1, "x"), (401, 0, "a", "bc", None, None), (402, 0, "ab", "c", None, None)]
    rows += [(None, 1, "user", "nobody's", 1, "x"), (403, 0, "user", "long " * 40_000, 1, "x")]
    return rows


@pytest.mark.parametrize("ranges", [1, 9])
def test_trie_of_awkward_conversations(spark, ranges):
    ship(spark)
    rows = awkward_turns()
    assert tried(spark.createDataFrame(rows, TURNS), ranges=ranges) == plain_trie(rows)


def test_trie_of_long_conversations_and_many_copies(spark, monkeypatch):
    ship(spark)
    monkeypatch.setattr(prefix_trie, "PIECE", 16)
    monkeypatch.setattr(prefix_trie, "CHUNK", 8)
    monkeypatch.setattr(prefix_trie, "HOT_NODES", 3)
    rows = [(100, k, "user", f"t{k % 5}", 0, "") for k in range(400)]
    rows += [(150, k, "user", f"t{k % 5}", 0, "") for k in range(300)] + [(151, k, "user", "other", 0, "") for k in range(2)]
    for c in range(1000, 1120):
        rows += [(c, k, "user", "same", 0, "") for k in range(3)]
    draw = random.Random(1)
    draw.shuffle(rows)
    assert tried(spark.createDataFrame(rows, TURNS), ranges=7) == plain_trie(rows)


def test_colliding_fingerprints_are_noticed(spark):
    ship(spark)
    rows = awkward_turns()
    assert tried(spark.createDataFrame(rows, TURNS), primes=(11, prefix_trie.PRIME)) == plain_trie(rows)


def test_trie_of_nothing(spark):
    ship(spark)
    assert tried(spark.createDataFrame([], TURNS)) == []
