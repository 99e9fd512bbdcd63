"""Sampling, scaling, encoding, blending and column checks."""

import hashlib

import pytest
from pyspark.sql import functions as F

from couponflow.operators import blending, sampling, scaling


@pytest.fixture(scope="module")
def rows(spark):
    return spark.range(2000).select(
        F.md5(F.col("id").cast("string")).alias("row_id"),
        (F.col("id") % 10 == 0).cast("int").alias("label"),
        (F.col("id") % 50).alias("user_id"),
    )


def test_split_is_stable_and_disjoint(rows):
    parts = sampling.split_train_test(rows, 0.25, 0.5)
    counts = {r.part: r["count"] for r in parts.groupBy("part").count().collect()}
    assert sum(counts.values()) == 2000
    assert 400 < counts["test"] < 600
    again = sampling.split_train_test(rows.repartition(7), 0.25, 0.5)
    assert parts.exceptAll(again).isEmpty()


def test_stratified_folds_balance_classes(rows):
    dealt = sampling.stratified_folds(rows, 4, digits=1).groupBy("label", "split").count()
    by_label = {}
    for r in dealt.collect():
        by_label.setdefault(r.label, []).append(r["count"])
    assert sum(map(sum, by_label.values())) == 2000
    for counts in by_label.values():
        assert len(counts) == 4
        assert max(counts) - min(counts) <= 16


def test_undersample_keeps_users_with_positives(rows):
    kept = sampling.undersample(rows, others=100)
    with_positive = rows.where("label = 1").select("user_id").distinct()
    full = rows.join(with_positive, "user_id", "left_semi").count()
    assert kept.join(with_positive, "user_id", "left_semi").count() == full
    assert kept.count() - full == 100


def test_exact_samples(rows, spark):
    for wanted in (0, 1, 777, 2000, 5000):
        found = sampling.exact_sample(rows, wanted)
        assert found.count() == min(wanted, 2000)
    hashes = {r.row_id: hashlib.md5(f"{r.row_id}/0-sample".encode()).hexdigest() for r in rows.collect()}
    expected = sorted(hashes, key=lambda i: (hashes[i], i))[:777]
    for small in (sampling.SMALL_BUCKET, 1, 0):
        found = sampling.exact_sample(rows.repartition(5), 777, small=small)
        assert sorted(r.row_id for r in found.collect()) == sorted(expected)
    assert sampling.exact_sample(rows, 50, seed=2).exceptAll(sampling.exact_sample(rows, 50)).count() > 0


def test_exact_samples_of_equal_ids(spark):
    ties = spark.createDataFrame([("a",)] * 30 + [("b",)] * 30 + [("c",)], "row_id string")
    for wanted in (1, 29, 30, 31, 45, 60, 61):
        assert sampling.exact_sample(ties, wanted).count() == wanted
        assert sampling.exact_sample(ties, wanted, small=0).count() == wanted


def test_exact_split(rows):
    train, test = sampling.split_exact(rows, 500)
    assert train.count() == 500 and train.join(test, "row_id", "left_semi").isEmpty()
    everything, _ = sampling.split_exact(rows, None)
    assert everything.count() + test.count() == 2000


def test_bags_differ(rows):
    one = sampling.bagging_split(rows, 0).where("is_test").select("row_id")
    two = sampling.bagging_split(rows, 1).where("is_test").select("row_id")
    assert one.join(two, "row_id").count() < one.count()


def test_scale_constant_is_zero(spark):
    df = spark.createDataFrame([(1.0, 5.0), (3.0, 5.0), (2.0, None)], "a double, b double")
    scaled = scaling.scale(df, scaling.bounds_of(df, ["a", "b"])).collect()
    assert [tuple(r) for r in scaled] == [(0.0, 0.0), (1.0, 0.0), (0.5, None)]


def test_label_encode_orders_numbers(spark):
    df = spark.createDataFrame([(10,), (-1,), (2,), (10,)], "v int")
    assert sorted(map(tuple, scaling.label_encode(df, ["v"]).collect())) == [
        (-1, 0),
        (2, 1),
        (10, 2),
        (10, 2),
    ]


def test_label_codes_rank_over_many_ranges(spark):
    df = spark.range(30_000).select((F.col("id") * 7 % 30_000 * 2).alias("v"))
    codes = scaling.label_codes(df, "v")
    assert codes.count() == 30_000 and codes.where("v <> 2 * v_code").count() == 0
    assert scaling.label_codes(df.where("v < 0"), "v").count() == 0


def test_variance_is_population(spark):
    df = spark.createDataFrame([(0.0, 1), (1.0, 1)], "a double, b int")
    found = {r.column_name: r.variance for r in scaling.variances(df, ["a", "b"]).collect()}
    assert found == {"a": 0.25, "b": 0.0}
    assert [r.column_name for r in scaling.variance_filter(df, ["a", "b"]).collect()] == ["a"]


def test_duplicate_columns(spark):
    df = spark.createDataFrame(
        [(1, 1.0, "x", None), (2, 2.0, "y", None), (2, 2.0, "y", 1)],
        "a int, b double, c string, d int",
    ).withColumn("e", F.col("c"))
    pairs = {tuple(r) for r in scaling.duplicate_columns(df).collect()}
    assert pairs == {("a", "b"), ("c", "e")}
    assert scaling.duplicate_columns(df.select("a", "d")).isEmpty()


def test_three_sigma(spark):
    df = spark.createDataFrame([(float(x),) for x in [1] * 50 + [2] * 50 + [100]], "v double")
    assert scaling.three_sigma(df, ["v"]).count() == 100


def test_blends(spark):
    df = spark.createDataFrame([(0.0, 1.0), (1.0, 0.5)], "a double, b double")
    sums = df.select(blending.weighted_sum(["a", "b"], blending.TWO_MODEL_WEIGHTS)).collect()
    assert [r[0] for r in sums] == pytest.approx([0.35, 0.825])
    four = df.select(blending.weighted_mean(["a", "b", "a", "b"], blending.CHECKPOINT_WEIGHTS))
    assert [r[0] for r in four.collect()] == pytest.approx([4 / 6, 4 / 6])
    assert [r.a for r in blending.stretch(df.select((F.col("a") * 3 + 1).alias("a")), "a").collect()] == [0, 1]


def test_new_keys_of_a_batch(spark):
    from couponflow.plans import reports

    batch = spark.createDataFrame([(1, 10), (2, 11), (2, 12)], "user_id long, merchant_id long")
    events = spark.createDataFrame([(1, 11), (3, 12)], "user_id long, merchant_id long")
    assert [r.user_id for r in reports.missing_keys(batch, events, "user_id").collect()] == [2]
    assert [r.merchant_id for r in reports.missing_keys(batch, events, "merchant_id").collect()] == [10]


def test_walk_goes_on_until_nothing_changes():
    from couponflow.models.search import Step, coordinate_search

    def evaluate(params, name, values):
        """One parameter can only get one step ahead of the other, so a sweep gains two steps."""

        def value(v):
            p = {**params, name: v}
            return p["a"] + p["b"] + 1 if abs(p["a"] - p["b"]) <= 1 else 0

        best = max(values, key=value)
        return best, value(best)

    steps = {"a": Step(1, 0, 9), "b": Step(1, 0, 9)}
    assert coordinate_search(evaluate, {"a": 0, "b": 0}, steps)[0] == {"a": 9, "b": 9}
    short, _ = coordinate_search(evaluate, {"a": 0, "b": 0}, steps, max_sweeps=2)
    assert short["a"] < 9
