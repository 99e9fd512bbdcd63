"""Encoders and pipelines that are saved and meet new values; checkpoints of one optimisation."""

import pytest
from pyspark.ml import Pipeline, PipelineModel
from pyspark.sql import functions as F

from couponflow.models import training
from couponflow.models.checkpoints import CheckpointEnsemble, is_prefix
from couponflow.models.encoders import LabelEncoder, LabelEncoderModel, RangeScaler, RangeScalerModel
from couponflow.models.estimators import make
from couponflow.session import stage


@pytest.fixture(scope="module")
def matrix(spark):
    return stage(
        spark.range(600).select(
            F.md5(F.col("id").cast("string")).alias("row_id"),
            F.lit(1).alias("fold"),
            (F.col("id") % 7).alias("coupon_id"),
            (F.pmod(F.xxhash64("id"), F.lit(100)) / 10.0).alias("strong"),
            F.lit(3.0).alias("constant"),
            (F.col("id") % 7).cast("int").alias("weekday"),
            (F.col("id") % 31 + 1).cast("int").alias("day"),
            ((F.col("id") % 5) * 10).cast("int").alias("discount_type"),
            (F.pmod(F.xxhash64("id"), F.lit(100)) + (F.col("id") % 7) * 5 > 60).cast("int").alias("label"),
        ),
        "matrix",
    )


def test_codes_are_ranks_and_new_values_get_their_own(spark, tmp_path):
    rows = spark.createDataFrame([(10, "b"), (2, "a"), (10, None), (30, "a")], "n int, s string")
    model = LabelEncoder(["n", "s"], ["n_code", "s_code"]).fit(rows)
    batch = spark.createDataFrame([(2, "b"), (11, "zz"), (None, None)], "n int, s string")
    model.write().save(str(tmp_path / "codes"))
    for one in (model, LabelEncoderModel.load(str(tmp_path / "codes"))):
        found = {(r.n, r.s): (r.n_code, r.s_code) for r in one.transform(batch).collect()}
        assert found == {(2, "b"): (0, 1), (11, "zz"): (3, 2), (None, None): (3, 2)}
        seen = {(r.n, r.s): (r.n_code, r.s_code) for r in one.transform(rows).collect()}
        assert seen == {(10, "b"): (1, 1), (2, "a"): (0, 0), (10, None): (1, 2), (30, "a"): (2, 0)}


def test_codes_by_a_shuffle(spark, monkeypatch):
    monkeypatch.setattr("couponflow.models.encoders.BROADCAST_VALUES", 0)
    rows = spark.range(300).select((F.col("id") % 13).alias("n"))
    found = LabelEncoder(["n"], ["code"]).fit(rows).transform(rows)
    assert found.where("n = code").count() == found.count() == 300


def test_ranges_are_kept(spark, tmp_path):
    rows = spark.createDataFrame([(0.0, 5.0, None), (10.0, 5.0, None)], "a double, b double, c double")
    RangeScaler(["a", "b", "c"]).fit(rows).write().save(str(tmp_path / "ranges"))
    model = RangeScalerModel.load(str(tmp_path / "ranges"))
    batch = spark.createDataFrame([(5.0, 7.0, 1.0), (20.0, 5.0, None), (None, None, None)], "a double, b double, c double")
    assert [tuple(r) for r in model.transform(batch).collect()] == [(0.5, 0.0, 0.0), (2.0, 0.0, None), (None, None, None)]


def test_a_loaded_machine_scores_a_batch_with_new_values(spark, matrix, tmp_path):
    model = training.fit_fm(matrix, maxIter=30, factorSize=2, stepSize=0.1)
    model.write().save(str(tmp_path / "fm"))
    loaded = PipelineModel.load(str(tmp_path / "fm"))
    before = {r.row_id: r.score for r in training.score(model, matrix).collect()}
    after = {r.row_id: r.score for r in training.score(loaded, matrix).collect()}
    assert before == pytest.approx(after)
    new = matrix.limit(3).withColumns({"discount_type": F.lit(77), "day": F.lit(99)})
    scores = [r.score for r in training.score(loaded, new).collect()]
    assert len(scores) == 3 and all(0 <= s <= 1 for s in scores)
    # A batch has neither label nor coupon.
    assert training.score(loaded, matrix.drop("label", "coupon_id")).count() == 600


def test_fm_metrics(matrix):
    _, found = training.train_fm(matrix, train_rows=400, maxIter=60, factorSize=2, stepSize=0.1)
    assert found.first().auc > 0.8


def test_checkpoints_are_parts_of_one_optimisation(matrix):
    shape = Pipeline(stages=training.wide_inputs(["strong", "constant"])).fit(matrix)
    rows = stage(shape.transform(matrix), "shaped")
    machines = [make("fm", seed=s, factorSize=2, stepSize=0.1, tol=0.0) for s in (0, 1)]
    ensemble = CheckpointEnsemble(machines, (5, 20)).fit(rows)
    first, second, *_ = (list(m.summary().objectiveHistory) for m in ensemble.models)
    assert len(first) < len(second) and is_prefix(first, second)
    scored = ensemble.predict(rows)
    row = scored.first()
    own = [row[n] for n in ensemble.names()]
    assert row.score == pytest.approx((own[0] + 2 * own[1] + own[2] + 2 * own[3]) / 6)
    assert len({round(x, 9) for x in own}) == 4
    with pytest.raises(ValueError, match="grow"):
        CheckpointEnsemble(machines, (20, 5)).fit(rows)


def test_prefixes():
    assert is_prefix([3.0, 2.0], [3.0, 2.0, 1.0]) and not is_prefix([3.0, 2.5], [3.0, 2.0, 1.0]) and not is_prefix([1.0, 1.0], [1.0])
