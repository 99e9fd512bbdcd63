"""What bounds a fit on a large table: rows of a task, fits at a time, no sort of the whole matrix."""

from datetime import date

import pytest
from pyspark.sql import DataFrameWriter
from pyspark.sql import functions as F

from couponflow import session
from couponflow.models import training
from couponflow.models.estimators import make
from couponflow.models.parallel import ROWS_AT_ONCE, WIDTH, in_parallel, width_for
from couponflow.operators import spread
from couponflow.operators.folds import Fold
from couponflow.session import BY_FILE, settings, stage_for_fits
from couponflow.sources.cache import FeatureCache


@pytest.fixture(scope="module")
def planted(spark):
    x, y = F.col("id") % 13, F.col("id") % 7
    rows = spark.range(0, 4000, 1, 2).select(
        F.md5(F.col("id").cast("string")).alias("row_id"), F.lit(1).alias("fold"), (F.col("id") % 3).alias("coupon_id"),
        (x > 6).cast("int").alias("label"), x.cast("double").alias("x"), y.cast("double").alias("y"),
    )
    return rows.cache()


def test_a_task_of_a_fit_has_few_rows(planted, spark, monkeypatch):
    monkeypatch.setattr(session, "ROWS_PER_FILE", 100)
    table = stage_for_fits(planted, "planted")
    assert len(table.inputFiles()) >= 40
    with settings(spark, BY_FILE):
        # Two files of any size, as one alone and the cost of opening it count as half of a task's share.
        assert max(table.rdd.mapPartitions(lambda rows: [sum(1 for _ in rows)]).collect()) <= 300
    assert table.exceptAll(planted).isEmpty() and table.count() == planted.count()


def test_large_fits_do_not_share_the_executors():
    assert width_for(1_000) == width_for(0) == WIDTH
    assert width_for(ROWS_AT_ONCE // 2) == 2
    assert width_for(ROWS_AT_ONCE) == width_for(100 * ROWS_AT_ONCE) == 1
    assert width_for(10, 2) == 2


def test_fits_read_by_file_and_leave_the_settings(planted, spark):
    name, wanted = next(iter(BY_FILE.items()))
    before = spark.conf.get(name)
    for width in (1, 3):
        assert in_parallel(spark, [lambda: spark.conf.get(name)] * 3, width) == [wanted] * 3
    training.fit(make("gbt", maxIter=1, maxDepth=2), training.vectors(planted, ["x", "y"]))
    assert spark.conf.get(name) == before


def test_a_pipeline_fitted_in_two_steps_is_the_pipeline(planted):
    estimator = make("logistic", maxIter=5)
    whole = training.pipeline(["x", "y"], estimator).fit(planted)
    steps = training.fit_pipeline(["x", "y"], estimator, planted)
    scores = [training.score(m, planted).orderBy("row_id").select("score") for m in (whole, steps)]
    pairs = zip(*[[r[0] for r in s.collect()] for s in scores], strict=True)
    assert all(abs(a - b) < 1e-9 for a, b in pairs)


def test_the_cache_writes_all_folds_without_a_sort(planted, spark, tmp_path, monkeypatch):
    seen, write = [], DataFrameWriter.parquet

    def noted(writer, *args, **kwargs):
        seen.append(int(spark.conf.get("spark.sql.maxConcurrentOutputFileWriters")))
        return write(writer, *args, **kwargs)

    monkeypatch.setattr(DataFrameWriter, "parquet", noted)
    days = [date(2016, 1, 1), date(2016, 2, 1)]
    folds = [Fold(n, *days, *days, *days) for n in (1, 2, 3)]
    rows = planted.withColumn("fold", F.pmod(F.hash("row_id"), F.lit(3)) + 1)
    kept = FeatureCache(spark, str(tmp_path)).table(folds, [], {}, lambda stale: rows)
    assert seen[0] > len(folds)
    assert kept.exceptAll(rows).isEmpty() and kept.count() == rows.count()


def test_buckets_hold_few_rows(planted, spark, monkeypatch):
    rows = planted.select(F.col("x").alias("user_id"))
    assert spread.UserLayout.of(rows).buckets == int(spark.conf.get("spark.sql.shuffle.partitions"))
    monkeypatch.setattr(spread, "ROWS_PER_BUCKET", 400)
    layout = spread.UserLayout.of(rows)
    # A user is hot by the limit of rows, not by the size of a bucket.
    assert layout.buckets == 10 and layout.hot_users is None
