"""Prefix trie of conversations that are rebuilt from the head of a base and their own remaining turns.

Rebuilt conversations are never written out. A turn is known by its place in its own conversation and by the digest
stored there; a sequence of turns is known by its fingerprint, an element of the monoid of maps x -> x * b ** n + f
(modulo a prime, in two lanes): ``n`` turns, ``f`` their hash. The product of two sequences is
``(n + m, f * b ** m + g)``, and a suffix is what the product leaves when the head is taken off. So the fingerprint of a
rebuilt prefix follows from three stored products: base head, own head, and own prefix.

1. Order: turns go to ranges of (conversation, turn), and each task multiplies along its range, in pieces of at most
   ``PIECE`` turns. A conversation that spans ranges is continued by the product of the ranges before, of which one
   row a range is brought to the driver. So no conversation is too long for a task.
2. Heads: each conversation's first products; a base is met by the conversations that name it.
3. Members: per conversation, the fingerprint, the parent's fingerprint and the turn's digest at every depth.
4. Nodes: one group for each depth and fingerprint. All members of a group must have the same parent fingerprint and,
   through their references, the same turn digest (SHA-256); by induction over the depth the group then is one
   sequence. Where a group fails, other bases are drawn and the products are made anew.
5. Sums over subtrees, without walking the tree: the smallest member owns a node, and then also all nodes further
   down its path, so a conversation owns one stretch of its path, from depth ``first`` to its end. What a conversation
   has in common with smaller ones, its text above ``first``, is what storing it in the trie saves. So all sums of a
   node are sums over its members, in one more aggregate.

Hot groups: many copies of a conversation or a common first turn are pre-aggregated in every task. A node's ends are
sorted by range and hashed as a stream of chunks, in order; nothing of a group is held in memory.

Cases: a null role or text is empty; a null turn comes first; equal turn numbers are ordered by role, then text; equal
rows are turns like others; a row without a conversation id belongs to no conversation and is left out; an empty table
has no nodes; a base that does not exist has no turns. Other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from couponflow.llm.ranges import ranges_for
from couponflow.llm.tables import at_most
from couponflow.session import stage

PIECE = 1024
#: Ends of a node joined to one chunk of text.
CHUNK = 1024
#: Share of all members from which a node counts as hot: at most so many nodes have it.
HOT_NODES = 10_000
PRIME = (1 << 61) - 1

_TURN = pa.struct(
    [("k", pa.int64()), ("f1", pa.int64()), ("f2", pa.int64()), ("c", pa.int64()), ("sha", pa.binary()), ("chars", pa.int64())]
)
_TURN_SQL = "struct<k:bigint,f1:bigint,f2:bigint,c:bigint,sha:binary,chars:bigint>"
_PIECES_SQL = f"conv_id long, part int, no long, open boolean, off long, s1 long, s2 long, c0 long, turns array<{_TURN_SQL}>"
_PIECES = pa.schema(
    [
        ("conv_id", pa.int64()),
        ("part", pa.int32()),
        ("no", pa.int64()),
        ("open", pa.bool_()),
        ("off", pa.int64()),
        ("s1", pa.int64()),
        ("s2", pa.int64()),
        ("c0", pa.int64()),
        ("turns", pa.list_(_TURN)),
    ]
)
_MEMBER = "struct<d:bigint,f1:bigint,f2:bigint,g1:bigint,g2:bigint,sha:binary,before:bigint>"
_OWN = pa.schema(
    [
        ("conv_id", pa.int64()),
        ("length", pa.int64()),
        ("total", pa.int64()),
        (
            "rows",
            pa.list_(
                pa.struct(
                    [(n, pa.int64()) for n in ("d", "f1", "f2", "g1", "g2")] + [("sha", pa.binary()), ("before", pa.int64())]
                )
            ),
        ),
    ]
)
#: Turns after which a task hands over what it has.
_FLUSH = 4096
KEY = ["d", "f1", "f2"]


def bases(seed: int, prime: int) -> tuple[int, int]:
    """Two bases drawn by ``seed``."""
    drawn = hashlib.sha256(f"prefix-trie:{seed}".encode()).digest()
    return tuple(int.from_bytes(drawn[i : i + 8], "big") % (prime - 2) + 1 for i in (0, 8))


def _turns(conversations: DataFrame) -> DataFrame:
    """``conv_id, turn, role, tie, sha, chars`` of every turn; ``tie``: the text where a turn number occurs twice."""
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    whole = conversations.where("conv_id IS NOT NULL").select(
        F.col("conv_id").cast("long").alias("conv_id"), "turn", role.alias("role"), text.alias("text")
    )
    size = F.octet_length("role").cast("string")
    columns = [
        "conv_id",
        "turn",
        "role",
        F.unhex(F.sha2(F.concat(size, F.lit(":"), "role", "text"), 256)).alias("sha"),
        F.char_length("text").cast("long").alias("chars"),
    ]
    turns = stage(whole.select(*columns), "turns")
    tied = turns.groupBy("conv_id", "turn").count().where("count > 1")
    if at_most(tied, 0):
        return turns.withColumn("tie", F.lit(None).cast("string"))
    twice = tied.select(F.col("conv_id").alias("_c"), F.col("turn").alias("_t"), F.lit(True).alias("_twice"))
    same = (whole["conv_id"] == twice["_c"]) & whole["turn"].eqNullSafe(twice["_t"])
    return whole.join(twice, same, "left").select(*columns, F.when(F.col("_twice"), F.col("text")).alias("tie"))


def _pieces(turns: DataFrame, b: tuple[int, int], prime: int, ranges: int) -> DataFrame:
    """Products along each range. ``open``: the piece's conversation may have begun in an earlier range."""
    b1, b2 = b

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        conv = first = None
        done, held, no = [], 0, 0
        piece = None
        for batch in batches:
            for c, sha, chars in zip(*(batch.column(n).to_pylist() for n in ("conv_id", "sha", "chars")), strict=True):
                if c != conv:
                    first = c if conv is None else first
                    conv, k, f1, f2, total = c, 0, 0, 0, 0
                    piece = None
                if piece is None or len(piece["turns"]) == PIECE:
                    if held >= _FLUSH:
                        yield pa.RecordBatch.from_pylist(done, _PIECES)
                        done, held = [], 0
                    piece = {
                        "conv_id": c, "part": part, "no": no, "open": c == first,
                        "off": k, "s1": f1, "s2": f2, "c0": total, "turns": [],
                    }
                    done.append(piece)
                    no += 1
                k, total = k + 1, total + chars
                f1 = (f1 * b1 + int.from_bytes(sha[:8], "big")) % prime
                f2 = (f2 * b2 + int.from_bytes(sha[8:16], "big")) % prime
                piece["turns"].append({"k": k, "f1": f1, "f2": f2, "c": total, "sha": sha, "chars": chars})
                held += 1
        if done:
            yield pa.RecordBatch.from_pylist(done, _PIECES)

    order = ["conv_id", "turn", "role", "tie", "sha"]
    dealt = turns.repartitionByRange(ranges, *order).sortWithinPartitions(*order)
    pieces = stage(dealt.select("conv_id", "sha", "chars").mapInArrow(run, _PIECES_SQL), "pieces")
    return _continued(pieces, b, prime)


def _continued(pieces: DataFrame, b: tuple[int, int], prime: int) -> DataFrame:
    """``pieces`` with the products of earlier ranges put before those of conversations that go on."""
    last = F.element_at("turns", -1)
    ends = pieces.groupBy("part").agg(
        F.min("conv_id").alias("first"),
        F.max_by(F.struct("conv_id", last["k"].alias("k"), last["f1"].alias("f1"), last["f2"].alias("f2"), last["c"].alias("c")), "no").alias("end"),
    )
    # One row a range.
    carries, before = [], None
    for row in sorted(ends.collect(), key=lambda r: r["part"]):
        own = row["end"]
        state = (own["conv_id"], own["k"], own["f1"], own["f2"], own["c"])
        if before and before[0] == row["first"]:
            carries.append((row["part"], *before[1:]))
            if state[0] == row["first"]:
                n, f1, f2, c = before[1:]
                joined = [(f * pow(x, state[1], prime) + g) % prime for f, x, g in zip((f1, f2), b, state[2:4], strict=True)]
                state = (state[0], n + state[1], *joined, c + state[4])
        before = state
    if not carries:
        return pieces
    spark = pieces.sparkSession
    known = spark.createDataFrame(carries, "part int, n0 long, p1 long, p2 long, t0 long")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = batch.to_pylist()
            for row in rows:
                n0, p1, p2, t0 = (row.pop(name) for name in ("n0", "p1", "p2", "t0"))
                w1, w2 = pow(b[0], row["off"], prime), pow(b[1], row["off"], prime)
                row |= {
                    "off": row["off"] + n0,
                    "s1": (p1 * w1 + row["s1"]) % prime,
                    "s2": (p2 * w2 + row["s2"]) % prime,
                    "c0": row["c0"] + t0,
                }
                for t in row["turns"]:
                    w1, w2 = w1 * b[0] % prime, w2 * b[1] % prime
                    t |= {"k": t["k"] + n0, "f1": (p1 * w1 + t["f1"]) % prime, "f2": (p2 * w2 + t["f2"]) % prime, "c": t["c"] + t0}
            yield pa.RecordBatch.from_pylist(rows, _PIECES)

    going_on = F.col("open") & F.col("part").isin([c[0] for c in carries]) if len(carries) < 100 else F.col("open")
    some = pieces.where(going_on).join(F.broadcast(known), "part", "left").fillna(0, ["n0", "p1", "p2", "t0"])
    moved = some.select(*pieces.columns, "n0", "p1", "p2", "t0").mapInArrow(run, _PIECES_SQL)
    return pieces.where(~going_on).unionByName(moved)


def _conversations(pieces: DataFrame, base: Column, head: Column, most: int) -> DataFrame:
    """Per conversation: what its rebuilding takes from its base (``taken``), and the products that combine the two."""
    early = F.filter("turns", lambda t: t["k"] <= most)
    whole = pieces.groupBy("conv_id").agg(
        F.max(F.element_at("turns", -1)["k"]).alias("n"),
        F.max(F.element_at("turns", -1)["c"]).alias("chars"),
        F.sort_array(F.flatten(F.collect_list(F.when(F.col("off") < most, early)))).alias("heads"),
    )
    whole = stage(whole, "heads")
    named = whole.select("*", base.alias("base"), head.cast("int").alias("h"))
    found = whole.select(F.col("conv_id").alias("base"), F.col("heads").alias("theirs"))
    both = named.join(found, "base", "left").withColumn("theirs", F.coalesce("theirs", F.array().cast(f"array<{_TURN_SQL}>")))
    taken = F.slice("theirs", F.lit(1), F.col("h"))

    def at(heads: str, place: str, field: str) -> Column:
        return F.coalesce(F.get(heads, F.col(place) - 1)[field], F.lit(0).cast("long"))

    out = both.select("conv_id", "n", "chars", "heads", "h", taken.alias("taken"), F.size(taken).alias("hb"))
    goes_on = F.col("n") > F.col("h")
    out = out.select(
        "conv_id",
        "h",
        "hb",
        "taken",
        *(at("taken", "hb", f).alias(f"x_{f}") for f in ("f1", "f2", "c")),
        *(at("heads", "h", f).alias(f"y_{f}") for f in ("f1", "f2", "c")),
        (F.col("hb") + F.greatest(F.col("n") - F.col("h"), F.lit(0))).alias("length"),
        F.when(goes_on, F.col("chars") - at("heads", "h", "c")).otherwise(0).alias("own_chars"),
    )
    return stage(out.withColumn("total", F.col("x_c") + F.col("own_chars")), "conversations")


def _members(pieces: DataFrame, convs: DataFrame, b: tuple[int, int], prime: int) -> DataFrame:
    """``conv_id, length, total`` (characters) and ``rows``: what a member knows at each depth."""
    root = F.struct(
        F.lit(0).alias("d"), F.lit(0).alias("f1"), F.lit(0).alias("f2"), F.lit(None).alias("g1"), F.lit(None).alias("g2"),
        F.lit(None).alias("sha"), F.lit(0).alias("before"),
    )

    def head(t: Column, i: Column) -> Column:
        above = F.get("taken", i - 1)
        zero = F.lit(0).cast("long")
        return F.struct(
            t["k"].alias("d"), t["f1"].alias("f1"), t["f2"].alias("f2"), F.coalesce(above["f1"], zero).alias("g1"),
            F.coalesce(above["f2"], zero).alias("g2"), t["sha"].alias("sha"), (t["c"] - t["chars"]).alias("before"),
        )

    kind = f"array<{_MEMBER}>"
    heads = convs.select(
        "conv_id", "length", "total", F.concat(F.array(root).cast(kind), F.transform("taken", head).cast(kind)).alias("rows")
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out, held = [], 0
            for row in batch.to_pylist():
                h, hb, off = row["h"], row["hb"], row["off"]
                x1, x2, xc, y1, y2, yc = (row[n] for n in ("x_f1", "x_f2", "x_c", "y_f1", "y_f2", "y_c"))
                # base head * own suffix = own prefix + (base head - own head) * b ** turns of the suffix
                past = max(off - h, 0)
                w1, w2 = (x1 - y1) * pow(b[0], past, prime) % prime, (x2 - y2) * pow(b[1], past, prime) % prime
                g1, g2 = ((row["s1"] + w1) % prime, (row["s2"] + w2) % prime) if off > h else (x1, x2)
                rows = []
                for t in row["turns"]:
                    if t["k"] <= h:
                        continue
                    w1, w2 = w1 * b[0] % prime, w2 * b[1] % prime
                    f1, f2 = (t["f1"] + w1) % prime, (t["f2"] + w2) % prime
                    rows.append(
                        {"d": hb + t["k"] - h, "f1": f1, "f2": f2, "g1": g1, "g2": g2, "sha": t["sha"], "before": t["c"] - t["chars"] - yc + xc}
                    )
                    g1, g2 = f1, f2
                held += len(rows)
                out.append({"conv_id": row["conv_id"], "length": row["length"], "total": row["total"], "rows": rows})
                if held >= _FLUSH:
                    yield pa.RecordBatch.from_pylist(out, _OWN)
                    out, held = [], 0
            if out:
                yield pa.RecordBatch.from_pylist(out, _OWN)

    known = convs.drop("taken", "own_chars")
    late = pieces.where(F.element_at("turns", -1)["k"] > 0).join(known, "conv_id").where(F.element_at("turns", -1)["k"] > F.col("h"))
    own = late.select(
        "conv_id", "length", "total", "h", "hb", "off", "s1", "s2", "x_f1", "x_f2", "x_c", "y_f1", "y_f2", "y_c", "turns"
    ).mapInArrow(run, f"conv_id long, length long, total long, rows {kind}")
    return stage(heads.unionByName(own), "members")


def _unfold(members: DataFrame) -> DataFrame:
    return members.select(*(c for c in members.columns if c != "rows"), F.inline("rows"))


def _nodes(members: DataFrame) -> DataFrame:
    """One row a group of members: ``d, f1, f2, owner, before, leaf, sound``."""
    same = F.lit(True)
    for column in ("g1", "g2", "sha"):
        same = same & F.min(column).eqNullSafe(F.max(column))
    ends = F.count(F.when(F.col("d") == F.col("length"), True))
    return stage(
        _unfold(members).groupBy(*KEY).agg(
            F.min("conv_id").alias("owner"),
            F.min("before").alias("before"),
            (ends == F.count(F.lit(1))).alias("leaf"),
            same.alias("sound"),
        ),
        "nodes",
    )


def _ends(members: DataFrame, ranges: int) -> DataFrame:
    """``d, f1, f2, ends_sha256`` of nodes where conversations end: digest of their ids, ascending, comma-joined."""
    schema = pa.schema([("d", pa.int64()), ("f1", pa.int64()), ("f2", pa.int64()), ("first", pa.int64()), ("ids", pa.string())])

    def chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, ids = None, []
        for batch in batches:
            out = []
            for *own, c in zip(*(column.to_pylist() for column in batch.columns), strict=True):
                if own != key or len(ids) == CHUNK:
                    if ids:
                        out.append((*key, ids[0], ",".join(map(str, ids))))
                    key, ids = own, []
                ids.append(c)
            yield pa.RecordBatch.from_arrays([pa.array(v, f.type) for v, f in zip(zip(*out) if out else [[]] * 5, schema)], schema=schema)
        if ids:
            yield pa.RecordBatch.from_arrays(
                [pa.array([v], f.type) for v, f in zip((*key, ids[0], ",".join(map(str, ids))), schema)], schema=schema
            )

    digest = pa.schema([("d", pa.int64()), ("f1", pa.int64()), ("f2", pa.int64()), ("ends_sha256", pa.string())])

    def hashes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, state = None, None
        for batch in batches:
            out = []
            for *own, _, ids in zip(*(column.to_pylist() for column in batch.columns), strict=True):
                if own != key:
                    if key:
                        out.append((*key, state.hexdigest()))
                    key, state = own, hashlib.sha256(ids.encode())
                else:
                    state.update(b"," + ids.encode())
            yield pa.RecordBatch.from_arrays([pa.array(v, f.type) for v, f in zip(zip(*out) if out else [[]] * 4, digest)], schema=digest)
        if key:
            yield pa.RecordBatch.from_arrays([pa.array([v], f.type) for v, f in zip((*key, state.hexdigest()), digest)], schema=digest)

    ending = _unfold(members).where("d = length").select(*KEY, "conv_id")
    order = [*KEY, "conv_id"]
    joined = ending.repartitionByRange(ranges, *order).sortWithinPartitions(*order).mapInArrow(
        chunks, "d long, f1 long, f2 long, first long, ids string"
    )
    in_order = joined.repartition(ranges, *KEY).sortWithinPartitions(*KEY, "first")
    return in_order.mapInArrow(hashes, "d long, f1 long, f2 long, ends_sha256 string")


def _parents(found: DataFrame, members_in_all: int) -> DataFrame:
    """``found`` with ``parent_conv_id``. A parent of many nodes is met by a broadcast, all others by a shuffle."""
    above = found.select(
        (F.col("d") + 1).alias("d"), F.col("f1").alias("g1"), F.col("f2").alias("g2"), F.col("conv_id").alias("parent"), "n_convs"
    )
    hot = F.col("n_convs") * HOT_NODES >= members_in_all
    key = ["d", "g1", "g2"]
    # Below an owner's first node, parent and child have the same owner.
    inside = found.where(~F.col("is_first") | (F.col("d") == 0)).withColumn(
        "parent", F.when(F.col("d") > 0, F.col("conv_id"))
    )
    tops = found.where(F.col("is_first") & (F.col("d") > 0))
    known = tops.join(F.broadcast(above.where(hot).drop("n_convs")), key, "left")
    columns = [*found.columns, "parent"]
    rest = known.where("parent IS NULL").drop("parent").join(above.where(~hot).drop("n_convs"), key)
    return (
        inside.select(*columns)
        .unionByName(known.where("parent IS NOT NULL").select(*columns))
        .unionByName(rest.select(*columns))
    )


def trie(
    conversations: DataFrame,
    base: Column,
    head: Column,
    most: int,
    primes: tuple[int, ...] = (PRIME,),
    ranges: int | None = None,
) -> DataFrame:
    """Every node of the trie.

    ``base`` and ``head``: expressions of ``conv_id``, the conversation whose first turns it takes and how many (``most`` at
    most). ``primes``: of the first tries; the last one is kept until no fingerprint stands for two sequences.
    """
    turns = stage(_turns(conversations), "ordered-turns")
    ranges = ranges or ranges_for(turns.count())
    seed = 0
    while True:
        prime = primes[min(seed, len(primes) - 1)]
        b = bases(seed, prime)
        pieces = _pieces(turns, b, prime, ranges)
        convs = _conversations(pieces, base, head, most)
        members = _members(pieces, convs, b, prime)
        nodes = _nodes(members)
        if at_most(nodes.where(~F.col("sound")), 0):
            break
        seed += 1
    owners = nodes.groupBy(F.col("owner").alias("conv_id")).agg(
        F.min("d").alias("first"), F.min("before").alias("shared"), F.max("leaf").alias("leaf")
    )
    owned = members.join(owners, "conv_id", "left")
    first = F.coalesce("first", F.col("length") + 1)
    shared = F.coalesce("shared", "total")
    rows = _unfold(owned.select("conv_id", "length", first.alias("first"), shared.alias("shared"), F.coalesce("leaf", F.lit(False)).alias("leaf"), "rows"))
    next_owned = (F.col("first") <= F.col("d") + 1) & (F.col("d") < F.col("length"))
    found = stage(
        rows.groupBy(*KEY).agg(
            F.min("conv_id").alias("conv_id"),
            F.count(F.lit(1)).alias("n_convs"),
            F.count(F.when(next_owned, True)).alias("n_children"),
            F.count(F.when(F.col("leaf"), True)).alias("n_leaves"),
            F.sum(F.greatest(F.col("shared") - F.col("before"), F.lit(0))).alias("saved_tokens"),
            F.min("g1").alias("g1"),
            F.min("g2").alias("g2"),
            F.max(F.col("first") == F.col("d")).alias("is_first"),
        ),
        "trie",
    )
    members_in_all = convs.agg(F.sum(F.col("length") + 1)).first()[0] or 0
    return (
        _parents(found, members_in_all)
        .join(_ends(members, ranges), KEY, "left")
        .select(
            "conv_id",
            F.col("d").alias("depth"),
            F.col("parent").alias("parent_conv_id"),
            "n_convs",
            "n_children",
            "n_leaves",
            "saved_tokens",
            F.coalesce("ends_sha256", F.sha2(F.lit("").cast("binary"), 256)).alias("ends_sha256"),
        )
    )
