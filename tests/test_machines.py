"""Factorization machines over blocks of rows against those of the library."""

import pytest
from pyspark.ml.classification import FMClassifier
from pyspark.ml.feature import OneHotEncoder, VectorAssembler
from pyspark.sql import functions as F

from couponflow.models import machines
from couponflow.models.checkpoints import CheckpointEnsemble
from couponflow.models.estimators import make
from couponflow.models.training import score


@pytest.fixture(scope="module")
def rows(spark):
    """Dense and sparse vectors, in partitions of unlike size, one of them empty."""
    plain = spark.range(0, 900, 1, 3).where("id < 250 OR id >= 600").select(
        F.col("id").alias("row_id"),
        (F.pmod(F.xxhash64("id"), F.lit(100)) / 50.0).alias("a"),
        F.when(F.col("id") % 5 == 0, F.col("id") / 900).otherwise(0.0).alias("b"),
        (F.col("id") % 9).cast("int").alias("c"),
        (F.pmod(F.xxhash64("id"), F.lit(100)) + (F.col("id") % 9) * 6 > 70).cast("int").alias("label"),
    )
    hot = OneHotEncoder(inputCols=["c"], outputCols=["hot"], dropLast=False).fit(plain).transform(plain)
    return VectorAssembler(inputCols=["hot", "a", "b"], outputCol="features").transform(hot).cache()


def library(**params):
    return FMClassifier(featuresCol="features", labelCol="label", solver="adamW", **params)


@pytest.mark.parametrize("tol, decay", [(1e-6, 0.0), (0.0, 0.05), (0.05, 0.0)])
def test_steps_are_those_of_the_library(rows, monkeypatch, tol, decay):
    monkeypatch.setattr(machines, "BLOCK_BYTES", 8 * 11 * 64)
    params = dict(maxIter=25, factorSize=3, stepSize=0.1, seed=5, tol=tol, regParam=decay)
    ours, theirs = make("fm", **params).fit(rows), library(**params).fit(rows)
    assert list(ours.summary().objectiveHistory) == pytest.approx(list(theirs.summary().objectiveHistory), rel=1e-9)
    assert ours.intercept == pytest.approx(theirs.intercept)
    assert list(ours.linear.toArray()) == pytest.approx(list(theirs.linear.toArray()))
    assert list(ours.factors.toArray().ravel()) == pytest.approx(list(theirs.factors.toArray().ravel()))
    scores = [{r.row_id: r.score for r in score(m, rows).collect()} for m in (ours, theirs)]
    assert scores[0] == pytest.approx(scores[1])


def test_machines_share_their_passes(rows, monkeypatch):
    passes, step = [], machines._step
    monkeypatch.setattr(machines, "_step", lambda b, runs, *rest: (passes.append(len(runs)), step(b, runs, *rest)))
    both = [make("fm", seed=s, factorSize=2 + s, stepSize=0.1, tol=0.0) for s in (0, 1)]
    models = CheckpointEnsemble(both, (4, 9)).fit(rows).models
    # Nine steps and the last loss; four runs of their own were 30 passes.
    assert passes == [2] * 10
    for model, (seed, steps) in zip(models, [(s, n) for s in (0, 1) for n in (4, 9)], strict=True):
        alone = library(maxIter=steps, factorSize=2 + seed, stepSize=0.1, seed=seed, tol=0.0).fit(rows)
        assert list(model.factors.toArray().ravel()) == pytest.approx(list(alone.factors.toArray().ravel()))


def test_rows_that_the_library_refuses(rows):
    for label in ("2", "null"):
        with pytest.raises(Exception, match="labels must be|must have a label"):
            make("fm", maxIter=2).fit(rows.withColumn("label", F.expr(f"CASE WHEN row_id = 7 THEN {label} ELSE label END")))
