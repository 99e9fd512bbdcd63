"""Models on a planted signal; structure of the ensembles; the parameter walk."""

import pytest
from pyspark.sql import functions as F

from couponflow.models import search, stacking, training
from couponflow.models.estimators import DEFAULTS, make

QUICK = {"maxIter": 3, "maxDepth": 3, "numTrees": 3, "stepSize": 0.3, "minInstancesPerNode": 2}


@pytest.fixture(scope="module")
def planted(spark):
    noise = F.xxhash64("id")
    return (
        spark.range(600)
        .select(
            F.md5(F.col("id").cast("string")).alias("row_id"),
            F.lit(1).alias("fold"),
            (F.col("id") % 7).alias("coupon_id"),
            (F.pmod(noise, F.lit(100)) / 100).alias("strong"),
            (F.pmod(F.xxhash64("id", F.lit(1)), F.lit(100)) / 100).alias("weak"),
        )
        .withColumn("label", (F.col("strong") + F.col("weak") * 0.3 > 0.6).cast("int"))
        .cache()
    )


@pytest.fixture(scope="module")
def vectors(planted):
    return training.assemble(planted, ["strong", "weak"]).cache()


@pytest.mark.parametrize("name", ["gbt", "gbt_a", "gbt_b", "rf_gini", "et_entropy", "logistic"])
def test_signal_is_found(planted, name):
    row = training.train_and_evaluate(planted, name, **QUICK)[1].first()
    assert row.auc > 0.85
    assert row.coupons == 7


def test_every_model_can_be_made():
    for name in DEFAULTS:
        make(name, **QUICK)


def test_out_of_fold_covers_each_row_once(vectors):
    stack = stacking.Stack(bases=("gbt", "rf_gini"), k=3, overrides=QUICK)
    oof = stack.fit(vectors)
    assert oof.count() == 600 == oof.select("row_id").distinct().count()
    assert len(stack.members["gbt"]) == 3
    scored = stack.predict(vectors)
    bounds = scored.agg(F.min("score"), F.max("score")).first()
    assert tuple(bounds) == (0.0, 1.0)
    report = {r.model: r.auc for r in stack.report(scored).collect()}
    assert set(report) == {"gbt", "rf_gini", "score"} and min(report.values()) > 0.85


def test_members_fitted_in_parallel_are_those_fitted_in_order(vectors):
    found = []
    for width in (1, 4):
        stack = stacking.Stack(bases=("gbt", "gbt_a"), k=2, overrides=QUICK, width=width)
        rows = stack.out_of_fold(vectors).select("row_id", "gbt", "gbt_a").collect()
        found.append({r.row_id: (round(r.gbt, 9), round(r.gbt_a, 9)) for r in rows})
    assert found[0] == found[1]


def test_stack_bag(vectors):
    model = stacking.StackBag(stacking_num=2, bagging_num=2, overrides=QUICK)
    fitted = model.fit(vectors)
    assert fitted.count() == 600
    scored = model.predict(vectors)
    assert training.metrics(scored, "bag").first().auc > 0.85
    plain = stacking.StackBag(stacking_num=1, bagging_num=1, overrides=QUICK)
    plain.fit(vectors)
    assert plain.stack == [] and len(plain.bags) == 1


def test_holdout_blend(vectors):
    blend = stacking.HoldoutBlend([("gbt_a", 0), ("rf_gini", 1)], QUICK).fit(vectors)
    assert training.metrics(blend.predict(vectors), "blend").first().auc > 0.85


def test_grid_search_reports_every_point(vectors):
    trials = search.grid_search(vectors, "gbt", {"maxDepth": [1, 2]}, folds=2, **QUICK | {"maxDepth": 1})
    assert sorted(t.params["maxDepth"] for t in trials) == [1, 2]
    assert trials[0].mean_auc >= trials[1].mean_auc > 0.5


def test_a_search_that_starts_again_fits_nothing(spark, vectors, tmp_path):
    folder, mark = str(tmp_path / "trials"), search.data_mark(vectors)
    steps = {"maxDepth": search.Step(1, 1, 3), "subsamplingRate": search.SPACES["gbt_a"]["subsamplingRate"]}
    start = {"maxIter": 2, "maxDepth": 2, "stepSize": 0.3, "subsamplingRate": 1.0}
    found = []
    for _ in range(2):
        trials = search.Trials(spark, folder, mark)
        walk = search.Search(vectors, "gbt_a", 2, trials)
        found.append((search.coordinate_search(walk.evaluate, start, steps), trials.fitted))
    (first, fitted), (second, again) = found
    assert first == second and fitted > 3 and again == 0
    rows = search.Trials(spark, folder, mark).table()
    assert rows.count() == fitted == rows.select("key").distinct().count()
    # Lost after some trials: only the others are fitted.
    half = str(tmp_path / "half")
    rows.limit(2).write.parquet(half)
    trials = search.Trials(spark, half, mark)
    search.coordinate_search(search.Search(vectors, "gbt_a", 2, trials).evaluate, start, steps)
    assert trials.fitted == fitted - 2
    # Trials of other rows do not count.
    assert search.Trials(spark, folder, "other rows").known == {}


def test_every_tuned_model_has_a_space():
    for name, space in search.SPACES.items():
        for parameter, step in space.items():
            value = step.clip(step.low + step.step)
            model = make(name, **{parameter: str(value) if parameter == "featureSubsetStrategy" else value})
            assert getattr(model, parameter, None) is not None


def test_walk_climbs_and_stops():
    def score(p):
        return 1 - abs(p["a"] - 7) / 100 - abs(p["b"] - 0.3) / 10

    def evaluate(params, name, values):
        best = max(values, key=lambda v: score({**params, name: v}))
        return best, score({**params, name: best})

    steps = {"a": search.Step(2, 1, None), "b": search.Step(0.1, 0.1, 1.0)}
    found, log = search.coordinate_search(evaluate, {"a": 3, "b": 0.5}, steps)
    assert found == {"a": 7, "b": 0.3}
    assert all(0.1 <= t.params["b"] <= 1.0 for t in log)
    capped, _ = search.coordinate_search(evaluate, {"a": 3, "b": 0.3}, {"a": search.Step(2, 1, 5)})
    assert capped["a"] == 5


def test_saved_pipeline_scores_the_same(planted, tmp_path):
    fitted = training.pipeline(["strong", "weak"], make("logistic")).fit(planted)
    loaded = training.save_and_load(fitted, str(tmp_path / "model"))
    before = training.score(fitted, planted).select("row_id", "score")
    after = training.score(loaded, planted).select("row_id", "score")
    assert before.exceptAll(after).isEmpty()
