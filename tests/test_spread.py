"""Hot keys: same result as the plain join, more than one piece, bounded hot lists."""

from collections import Counter

from pyspark.sql import functions as F

from couponflow.operators.spread import (
    ROWS_PER_TASK,
    HotKeys,
    UserLayout,
    attach,
    legal_buckets,
    number_copies,
    with_row_ids,
)


def rows(spark):
    """1,000 rows; user 1 has a third of them, and its coupon 0 a third of those."""
    raw = spark.range(1000).select(
        F.lit(1).alias("fold"),
        F.when(F.col("id") % 3 == 0, 1).otherwise(F.col("id")).alias("user_id"),
        (F.col("id") % 9).alias("coupon_id"),
        F.col("id").cast("string").alias("row_id"),
    )
    return raw


def test_buckets_stay_legal():
    """Also for a pretended table of 10^13 rows."""
    assert legal_buckets(8, 100_000) == 8
    assert legal_buckets(10**13 // ROWS_PER_TASK, 100_000) == 100_000


def test_hot_keys_only_where_needed(spark):
    table = rows(spark)
    hot = HotKeys(table, rows_per_task=100)
    users = {(r.user_id, r._pieces) for r in hot.of(["fold", "user_id"]).collect()}
    assert users == {(1, 4)}
    pairs = {(r.user_id, r.coupon_id, r._pieces) for r in hot.of(["fold", "user_id", "coupon_id"]).collect()}
    assert pairs == {(1, 0, 2), (1, 3, 2), (1, 6, 2)}
    assert HotKeys(table, rows_per_task=1000).of(["fold", "user_id"]) is None
    assert HotKeys(table, rows_per_task=400).of(["fold", "user_id"]) is None


def test_attach_spreads_and_keeps_the_result(spark):
    table = rows(spark)
    features = table.groupBy("fold", "user_id").agg(F.count("*").alias("n"))
    features = features.where(F.col("user_id") % 2 == 1)
    keys = ["fold", "user_id"]
    hot = HotKeys(table, rows_per_task=50).of(keys)
    plain = sorted(attach(table, features, keys).collect(), key=str)
    spread = sorted(attach(table, features, keys, hot).select(*table.columns, "n").collect(), key=str)
    assert spread == sorted((r for r in plain), key=str)
    plan = attach(table, features, keys, hot)._jdf.queryExecution().toString()
    assert "_salt" in plan


def test_number_copies_in_chunks(spark):
    raw = [(1, None)] * 25 + [(2, "x")] * 3 + [(3, "y")]
    df = spark.createDataFrame(raw, "a int, b string")
    whole = sorted(map(tuple, number_copies(df).collect()), key=str)
    chunked = sorted(map(tuple, number_copies(df, rows_per_task=4).collect()), key=str)
    unsplit = sorted(map(tuple, number_copies(df, None).collect()), key=str)
    assert whole == chunked == unsplit
    assert Counter(r[0] for r in whole) == {1: 25, 2: 3, 3: 1}
    assert {r[2] for r in whole if r[0] == 1} == set(range(1, 26))


def test_row_ids_are_distinct(spark):
    df = spark.createDataFrame([(1, None), (1, None), (1, "a")], "a int, b string")
    ids = [r.row_id for r in with_row_ids(df, ["a", "b"]).collect()]
    assert len(set(ids)) == 3
    assert sorted(ids) == sorted(r.row_id for r in with_row_ids(df, ["a", "b"], 1).collect())


def test_user_layout(spark):
    table = rows(spark)
    small = UserLayout.of(table, rows_per_task=1000)
    assert small.buckets == int(spark.conf.get("spark.sql.shuffle.partitions"))
    assert small.hot_users is None
    split = UserLayout.of(table, rows_per_task=100)
    assert split.buckets == 10
    assert {r.user_id for r in split.hot_users.collect()} == {1}
    assert split.usual(table).count() + split.hot(table).count() == 1000


def test_a_missing_key_can_be_hot(spark):
    table = spark.createDataFrame(
        [(1, None if n % 2 else n, f"r{n}") for n in range(200)], "fold int, user_id long, row_id string"
    )
    keys = ["fold", "user_id"]
    hot = HotKeys(table, rows_per_task=30).of(keys)
    assert [tuple(r) for r in hot.collect()] == [(1, None, 4)]
    features = table.where("user_id is not null").select(*keys, F.lit(1).alias("n"))
    plain = sorted(attach(table, features, keys).collect(), key=str)
    assert sorted(attach(table, features, keys, hot).collect(), key=str) == plain
    layout = UserLayout.of(table, rows_per_task=30)
    assert (layout.usual(table).count(), layout.hot(table).count()) == (100, 100)
