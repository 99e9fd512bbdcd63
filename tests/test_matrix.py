"""The assembled matrix: every layout gives the same rows, and history stays history."""

import pytest
from pyspark.sql import functions as F

from couponflow.functions.basic import rounded
from couponflow.functions.cleaning import clean_offline
from couponflow.operators.folds import history_rows
from couponflow.plans import history as past
from couponflow.plans import matrix
from couponflow.session import CO_LOCATED, settings, stage, stage_by_key
from couponflow.sources import standin


def build(spark, tables, rows_per_task=10**9, offline=None):
    offline = standin.offline(spark, tables) if offline is None else offline
    table = matrix.feature_table(
        offline, standin.online(spark, tables), standin.FOLDS, rows_per_task=rows_per_task
    )
    return rounded(matrix.training_matrix(table))


def content(df):
    return sorted(map(tuple, df.select(*sorted(df.columns)).collect()))


@pytest.fixture(scope="module")
def skewed(spark, tables):
    """A third of all rows belong to user 1, and a third of those are copies of one row."""
    offline = stage(standin.offline(spark, tables), "skewed-in")
    user = F.when(F.hash("date", "distance") % 3 == 0, 1).otherwise(F.col("user_id"))
    skewed = offline.withColumn("user_id", user.cast("long"))
    label_from = standin.FOLDS[0].label_from
    one = skewed.where((F.col("user_id") == 1) & (F.col("date_received") > F.lit(label_from)))
    one = one.orderBy(*one.columns).limit(1)
    copies = one.select("*", F.explode(F.sequence(F.lit(1), F.lit(700)))).drop("col")
    return stage(skewed.unionByName(copies), "skewed")


def test_layouts_agree(spark, tables, skewed):
    small = content(build(spark, tables, offline=skewed))
    assert len(small) > 1700
    assert content(build(spark, tables, rows_per_task=3000, offline=skewed)) == small
    assert content(build(spark, tables, rows_per_task=300, offline=skewed)) == small


def test_shape(spark, tables):
    df = build(spark, tables)
    assert len(matrix.model_inputs(df)) == 115
    assert df.count() == 1142
    assert df.select("row_id").distinct().count() == 1142
    nulls = df.agg(*[F.count_if(F.col(c).isNull()).alias(c) for c in df.columns]).first()
    assert sum(nulls) == 0


def test_invariants(spark, tables):
    df = build(spark, tables)
    wrong = df.where(
        (F.col("u1") != F.col("u2") + F.col("u3"))
        | (F.col("m2") != F.col("m0") - F.col("m1"))
        | ((F.col("c2") > 0) & (F.col("c4") != F.col("c1") - F.col("c2")))
        | (F.col("m9") < F.col("m10"))
        | (F.col("m8") < F.col("m10") - 1e-6)
        | ~F.col("u4").between(0, 1)
        | ~F.col("m4").between(0, 1)
    )
    assert wrong.count() == 0


def test_later_events_do_not_change_history_features(spark, tables):
    """Redemptions after the history window of fold 1 are not visible to its features."""
    offline = standin.offline(spark, tables)
    late = F.col("date_received") > F.lit(standin.FOLDS[1].label_to)
    changed = offline.where(~F.coalesce(late, F.lit(False)))
    assert content(build(spark, tables)) == content(build(spark, tables, offline=changed))


def test_flag_drops_batch_features(spark, tables):
    table = matrix.feature_table(
        standin.offline(spark, tables), standin.online(spark, tables), standin.FOLDS
    )
    live = matrix.training_matrix(table, include_batch_features=False)
    assert len(matrix.model_inputs(live)) == 115 - len(matrix.BATCH_COLUMNS)


def test_buckets_need_no_shuffle(spark, tables):
    events = stage_by_key(clean_offline(standin.offline(spark, tables)), "events", "user_id", 4)
    history = history_rows(events, standin.FOLDS)
    pairs = stage_by_key(past.user_merchant_counts(history), "pairs", "user_id", 4)
    with settings(spark, CO_LOCATED):
        users = past.user_features(history, pairs, past.user_coupon_counts(history))
        joined = past.user_merchant_features(pairs).join(users, past.USER, "left")
        plan = joined._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan
    assert plan.count("SortMergeJoin") >= 3
