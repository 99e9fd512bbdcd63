"""Split counts, best prefixes, extremely random trees and parallel fits."""

import math
import random
import re
import threading
import time
from collections import Counter

import pytest
from pyspark.ml.classification import GBTClassifier
from pyspark.ml.linalg import Vectors

from couponflow.models import trees
from couponflow.models.estimators import make
from couponflow.models.parallel import in_parallel
from couponflow.models.training import score
from couponflow.operators import auc


def vectors(spark, n, seed, noise=0.1):
    draw = random.Random(seed)
    rows = []
    for i in range(n):
        x = [draw.random(), draw.random() * 100 - 50, float(draw.randint(0, 3)), 7.0]
        label = int((x[0] > 0.4) ^ (x[1] > 0)) if draw.random() > noise else draw.randint(0, 1)
        rows.append((i, label, Vectors.dense(x)))
    return spark.createDataFrame(rows, ["row_id", "label", "features"]).cache()


@pytest.fixture(scope="module")
def train(spark):
    return vectors(spark, 1500, 1)


@pytest.fixture(scope="module")
def held(spark):
    return vectors(spark, 700, 2)


def test_split_counts_are_those_of_the_printed_trees(spark, train):
    for model in (
        GBTClassifier(maxIter=6, maxDepth=3, seed=1).fit(train),
        make("rf_gini", numTrees=5, maxDepth=4).fit(train),
    ):
        # Each split is printed twice, as If and as Else.
        printed = Counter(int(n) for n in re.findall(r"If \(feature (\d+) <=", model.toDebugString))
        rows = trees.split_counts(model, ["a", "b", "c", "d"]).collect()
        assert {r["feature"]: r["splits"] for r in rows} == {n: printed.get(i, 0) for i, n in enumerate("abcd")}
        assert sum(r["importance"] for r in rows) == pytest.approx(1)
        assert {r["feature"] for r in rows if r["splits"] == 0} == {r["feature"] for r in rows if r["importance"] == 0}


def test_best_prefix():
    assert trees.best_prefix([3, 2, 1, 2, 0], 2) == 5
    assert trees.best_prefix([3, 2, 1, 2, 2, 0], 2) == 3
    assert trees.best_prefix([1, 1, 1], 200) == 1
    assert trees.best_prefix([5, 4, 3], 1) == 3


def test_first_trees_score_as_a_shorter_fit(spark, train, held):
    whole = GBTClassifier(maxIter=12, maxDepth=2, stepSize=0.3, seed=3).fit(train)
    cut = trees.first_trees(whole, 5)
    assert cut.getNumTrees == 5 and cut.treeWeights == whole.treeWeights[:5]
    short = GBTClassifier(maxIter=5, maxDepth=2, stepSize=0.3, seed=3).fit(train)
    both = score(short, score(cut, held, "a"), "b").collect()
    assert all(r["a"] == pytest.approx(r["b"]) for r in both)
    assert cut.evaluateEachIteration(held) == pytest.approx(whole.evaluateEachIteration(held)[:5])


def test_patience_finds_a_prefix_that_is_not_the_last(spark):
    noisy, other = vectors(spark, 300, 5, noise=0.6), vectors(spark, 400, 6, noise=0.6)
    kind = GBTClassifier(maxIter=30, maxDepth=5, stepSize=0.5, seed=1)
    losses = kind.fit(noisy).evaluateEachIteration(other)
    model = trees.fit_with_patience(kind, noisy, other, patience=200)
    assert model.getNumTrees == losses.index(min(losses)) + 1 < 30
    impatient = trees.fit_with_patience(kind, noisy, other, patience=1)
    assert impatient.getNumTrees <= model.getNumTrees


def test_cuts_are_drawn_per_seed_and_tree():
    bounds = [(0.0, 1.0), (5.0, 5.0), (-3.0, 2.0)]
    kind = trees.ExtraTrees(cuts=4, seed=1)
    first = kind.draw(bounds, 0)
    assert first == kind.draw(bounds, 0)
    assert first != kind.draw(bounds, 1) and first != trees.ExtraTrees(cuts=4, seed=2).draw(bounds, 0)
    assert first[1] == [] and len(first[0]) == 4 and first[0] == sorted(first[0])
    assert all(low < x <= high for (low, high), places in zip(bounds, first) for x in places)


def thresholds(model):
    return {(r["feature"], r["threshold"]) for r in trees.nodes(model).where("feature is not null").collect()}


def test_extra_trees_find_the_signal(spark, train, held):
    kind = make("et_gini", seed=4, numTrees=8, maxDepth=8, cuts=6)
    assert isinstance(kind, trees.ExtraTrees)
    model = kind.fit(train)
    assert model.getNumTrees == 8
    scored = score(model, held)
    assert auc.auc(scored).first()["auc"] > 0.8
    # Only drawn places are used, each just below the start of a bin.
    bounds = _bounds(train)
    allowed = {
        (n, math.nextafter(x, -math.inf)) for t in range(8) for n, places in enumerate(kind.draw(bounds, t)) for x in places
    }
    used = thresholds(model)
    assert used and used <= allowed
    other = make("et_gini", seed=5, numTrees=8, maxDepth=8, cuts=6).fit(train)
    assert not used & thresholds(other)


def _bounds(rows):
    found = [r["features"].toArray() for r in rows.select("features").collect()]
    return [(float(min(c)), float(max(c))) for c in zip(*found)]


def test_extra_trees_decide_as_their_bins(spark, train):
    """Thresholds turned back from bins send every row where its bin went."""
    kind = trees.ExtraTrees(numTrees=1, maxDepth=3, cuts=3, seed=9)
    model = kind.fit(train)
    places = kind.draw(_bounds(train), 0)
    found = {r["node"]: r for r in trees.nodes(model).collect()}
    sizes = Counter()
    for row in train.collect():
        at = 0
        while found[at]["feature"] is not None:
            n = found[at]
            x = row["features"][n["feature"]]
            bin_of = sum(x >= p for p in places[n["feature"]])
            goes_left = bin_of <= sum(p <= n["threshold"] for p in places[n["feature"]])
            assert goes_left == (x <= n["threshold"])
            at = n["left"] if goes_left else n["right"]
        sizes[at] += 1
    assert all(found[at]["rows"] == n for at, n in sizes.items())


def test_parallel_fits(spark, train):
    jobs = [lambda s=s: GBTClassifier(maxIter=2, maxDepth=2, subsamplingRate=0.7, seed=s).fit(train).toDebugString for s in range(4)]
    strip = lambda text: text.split("\n", 1)[1]
    assert list(map(strip, in_parallel(spark, jobs))) == list(map(strip, in_parallel(spark, jobs, 1)))


def test_parallel_width_is_bounded_and_errors_are_raised(spark):
    running, most, lock = [0], [0], threading.Lock()

    def job():
        with lock:
            running[0] += 1
            most[0] = max(most[0], running[0])
        time.sleep(0.05)
        with lock:
            running[0] -= 1
        return spark.sparkContext.getLocalProperty("spark.scheduler.pool")

    pools = in_parallel(spark, [job] * 7, 3)
    assert most[0] <= 3 and set(pools) == {"fit-0", "fit-1", "fit-2"}

    def broken():
        raise ValueError("no")

    with pytest.raises(ValueError):
        in_parallel(spark, [job, broken], 2)
