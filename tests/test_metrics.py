import random

import pytest
from pyspark.sql import functions as F

from couponflow.operators import auc


def brute(pairs):
    pos = [s for s, y in pairs if y == 1]
    neg = [s for s, y in pairs if y == 0]
    won = sum((p > n) + 0.5 * (p == n) for p in pos for n in neg)
    return won / (len(pos) * len(neg))


@pytest.fixture(scope="module")
def raw():
    rng = random.Random(3)
    # Coupon 1 has a third of all rows; coupon 9 has one class only.
    out = [(rng.choice([1, 1, 2, 3, 4]), round(rng.random(), 2), rng.randint(0, 1)) for _ in range(600)]
    return out + [(9, 0.5, 1), (9, 0.6, 1), (10, 0.1, 0)]


@pytest.mark.parametrize("per_bucket", [10_000, 40, 7])
def test_auc_matches_brute_force(spark, raw, per_bucket):
    df = spark.createDataFrame(raw, "coupon_id int, score double, label int")
    whole = auc.auc(df, scores_per_bucket=per_bucket).first()
    assert whole.auc == pytest.approx(brute([(s, y) for _, s, y in raw]))
    groups = auc.auc_by_group(df, ["coupon_id"], scores_per_bucket=per_bucket).collect()
    assert {r.coupon_id for r in groups} == {1, 2, 3, 4}
    for r in groups:
        mine = [(s, y) for c, s, y in raw if c == r.coupon_id]
        assert r.auc == pytest.approx(brute(mine))
    mean = auc.mean_coupon_auc(df, scores_per_bucket=per_bucket).first()
    assert mean.coupons == 4
    assert mean.coupon_auc == pytest.approx(sum(r.auc for r in groups) / 4)


def test_accuracy(spark):
    df = spark.createDataFrame([(1, 1), (0, 1), (0, 0), (1, 1)], "prediction int, label int")
    assert tuple(auc.accuracy(df).first()) == (4, 0.75)


def test_no_window_over_everything(spark, raw):
    df = spark.createDataFrame(raw, "coupon_id int, score double, label int")
    scored = df.select("coupon_id", "score", "label").where(F.col("coupon_id") < 9)
    plan = auc.auc_by_group(scored, ["coupon_id"])._jdf.queryExecution().toString()
    assert "SinglePartition" not in plan
