"""Registered model queries fit tuned models on all rows; forests of many trees; what a fit leaves on disk."""

import os
from collections import Counter
from types import SimpleNamespace

import pytest
from pyspark.sql import functions as F

from couponflow import catalog, session
from couponflow.models import estimators, search, stacking, training, trees
from couponflow.models.estimators import DEFAULTS, make
from couponflow.models.stacking import HOLDOUT_BASES, STACK_BASES

ROWS = 400


@pytest.fixture(scope="module")
def matrix(spark):
    x, y = F.col("id") % 13, F.col("id") % 7
    return spark.range(0, ROWS, 1, 2).select(
        F.md5(F.col("id").cast("string")).alias("row_id"), F.lit(1).alias("fold"), (F.col("id") % 3).alias("coupon_id"),
        (x + F.pmod(F.xxhash64("id"), F.lit(5)) > 8).cast("int").alias("label"), x.cast("double").alias("x"), y.cast("double").alias("y"),
    ).cache()


@pytest.fixture(scope="module")
def vectors(matrix):
    return training.assemble(matrix, ["x", "y"]).cache()


#: The models that each query fits.
FITTED = {
    "train_gbt": ["gbt"],
    "train_gbt_variant_a": ["gbt_a"],
    "train_gbt_variant_b": ["gbt_b"],
    "train_gbt_variant_c": ["gbt_c"],
    "train_rf": ["rf_gini", "rf_entropy"],
    "train_et": ["et_gini", "et_entropy"],
    "feature_importance": ["gbt_a"],
    "grid_search": ["gbt"] * 15,
    "stack_oof": STACK_BASES * 3,
    "stack_meta": STACK_BASES * 3,
    "holdout_blend": [name for name, _ in HOLDOUT_BASES],
    "stack_bag_fit": ["gbt_b"] * 8,
    "stack_bag_predict": ["gbt_b"] * 8,
    "submission": STACK_BASES * 3,
    "submission_single": ["gbt"],
}


@pytest.mark.parametrize("name", sorted(FITTED))
def test_models_of_a_query_have_their_tuned_sizes(spark, matrix, name, monkeypatch):
    wanted = []

    def noted(model, seed=0, **overrides):
        whole = make(model, seed, **overrides)
        if model != "logistic":
            read = lambda p: getattr(whole, p) if isinstance(whole, trees.ExtraTrees) else whole.getOrDefault(p)
            wanted.append((model, {p: read(p) for p in DEFAULTS[model][1]}))
        return make(model, seed, **overrides | {"maxIter": 2, "maxDepth": 2, "numTrees": 2})

    class Planted(catalog.Inputs):
        matrix = property(lambda _: rows)
        scoring_table = property(lambda _: rows.withColumns({"user_id": F.col("coupon_id"), "date_received": F.current_date()}))

    rows = matrix
    monkeypatch.setattr(catalog, "Inputs", Planted)
    if name not in catalog.REGISTRY or not name.startswith("train_"):
        build = getattr(catalog, name)
        run = lambda: build(Planted(spark, "none"))
    else:
        run = lambda: catalog.REGISTRY[name](spark, "none")
    for module in (training, stacking, search, catalog):
        monkeypatch.setattr(module, "make", noted)
    found = run()
    assert Counter(model for model, _ in wanted) == Counter(FITTED[name])
    depths = Counter(params.pop("maxDepth") for _, params in wanted) if name == "grid_search" else None
    assert depths in (None, {8: 5, 9: 5, 10: 5})
    assert all(params == {k: v for k, v in DEFAULTS[model][1].items() if k in params} for model, params in wanted)
    if name in ("stack_oof", "stack_bag_fit"):
        assert found.count() == ROWS and found.select("row_id").distinct().count() == ROWS


def test_a_grid_is_searched_on_all_rows(spark, matrix, monkeypatch):
    seen = []

    class Noted(search.Search):
        def grid(self, grid, base=None):
            seen.append(self.dealt.count())
            return []

    class Planted(catalog.Inputs):
        matrix = property(lambda _: rows)

    rows = matrix
    monkeypatch.setattr(search, "Search", Noted)
    # Fewer than there are: a sample of so many was taken before.
    monkeypatch.setattr(catalog, "TUNING_ROWS", 100)
    catalog.grid_search(Planted(spark, "none"))
    assert seen == [ROWS]


def scores(model, rows):
    return {r.row_id: r.score for r in training.score(model, rows).collect()}


def test_a_forest_in_parts_votes_as_one(spark, vectors, monkeypatch):
    monkeypatch.setattr(trees, "MOST_TREES", 3)
    forest = make("rf_gini", numTrees=8, maxDepth=4).fit(vectors)
    assert isinstance(forest, trees.Forest) and forest.getNumTrees == 8
    assert [size for _, size in forest.parts] == [3, 3, 2]
    parts = [(scores(trees.RandomForestClassificationModel.load(path), vectors), size) for path, size in forest.parts]
    assert parts[0][0] != parts[1][0]
    means = {row: sum(p[row] * size for p, size in parts) / 8 for row in parts[0][0]}
    assert scores(forest, vectors) == pytest.approx(means) and len(means) == ROWS
    report = training.metrics(training.score(forest, vectors), "forest").first()
    assert report.auc > 0.8 and report["rows"] == ROWS


def test_extra_trees_in_parts_are_the_same_trees(vectors, monkeypatch):
    whole = make("et_gini", numTrees=5, maxDepth=4, seed=3).fit(vectors)
    monkeypatch.setattr(trees, "MOST_TREES", 2)
    parts = make("et_gini", numTrees=5, maxDepth=4, seed=3).fit(vectors)
    assert not isinstance(whole, trees.Forest) and isinstance(parts, trees.Forest) and parts.getNumTrees == 5
    assert scores(parts, vectors) == pytest.approx(scores(whole, vectors))


def test_trees_of_one_model_are_bounded_by_their_nodes():
    assert trees.trees_at_once(1_000, 15, 1) == trees.MOST_TREES
    assert trees.trees_at_once(10**9, 30, 1) == 1
    assert 1 < trees.trees_at_once(100_000, 22, 1) < trees.MOST_TREES
    assert trees.trees_at_once(10**9, 3, 1) == trees.MOST_TREES


def test_scores_of_a_layer_are_written_without_vectors(vectors):
    quick = {"maxIter": 2, "maxDepth": 2}
    stack = stacking.Stack(bases=("gbt", "gbt_a"), k=2, overrides=quick)
    oof = stack.fit(vectors)
    assert "features" not in oof.columns and {"row_id", "gbt", "gbt_a", "split"} <= set(oof.columns)
    assert "features" not in stack.predict(vectors).columns
    bag = stacking.StackBag(stacking_num=2, bagging_num=1, overrides=quick)
    rows = bag.fit(vectors)
    assert "features" not in rows.columns and rows.where("layer_score IS NOT NULL").count() == ROWS
    assert bag.predict(vectors).count() == ROWS


def test_scratch_tables_go_with_their_block(spark, matrix):
    before = session.stage(matrix, "before")
    with session.scratch(spark) as keep:
        gone, kept = session.stage(matrix, "gone"), keep(session.stage_for_fits(matrix, "kept"))
        bucketed = session.stage_by_key(matrix, "bucketed", "coupon_id", 2)
        folders = [os.path.dirname(t.inputFiles()[0].removeprefix("file:").replace("///", "/")) for t in (before, kept, gone, bucketed)]
        assert all(map(os.path.exists, folders))
    assert list(map(os.path.exists, folders)) == [True, True, False, False]
    assert kept.count() == before.count() == ROWS
    assert session._SCRATCH.get() == ()


def test_defaults_are_the_tuned_sizes():
    assert [estimators.DEFAULTS[m][1].get("maxIter") for m in STACK_BASES] == [1900, 1260, 360, 3600]
