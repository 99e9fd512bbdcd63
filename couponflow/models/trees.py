"""Tree ensembles as tables: split counts, best prefixes, and extremely random trees.

Spark saves an ensemble as a table of nodes, a table of trees and one line of metadata. Reading those tables gives what the
model classes do not offer; writing them gives ensembles that the library cannot fit, as ordinary models that score, save
and load like any other.
"""

from __future__ import annotations

import json
import math
import random
from collections.abc import Sequence
from dataclasses import dataclass
from functools import partial

from pyspark.ml import Model
from pyspark.ml.classification import RandomForestClassificationModel, RandomForestClassifier
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from couponflow.models.names import FEATURES, LABEL
from couponflow.models.parallel import WIDTH, in_parallel, width_for
from couponflow.session import BY_FILE, settings, stage, table_path

# --- reading -------------------------------------------------------------------------------


def saved(model: Model) -> str:
    path = table_path(SparkSession.active(), "model")
    model.write().save(path)
    return path


def nodes(model: Model) -> DataFrame:
    """One row a node: ``tree, node, feature, threshold, gain, rows, left, right, prediction``; leaves have no feature."""
    spark = SparkSession.active()
    split, inner = F.col("nodeData.split"), F.col("nodeData.leftChild") >= 0
    return spark.read.parquet(f"{saved(model)}/data").select(
        F.col("treeID").alias("tree"),
        F.col("nodeData.id").alias("node"),
        F.when(inner, split["featureIndex"]).alias("feature"),
        F.when(inner, split["leftCategoriesOrThreshold"][0]).alias("threshold"),
        F.when(inner, F.col("nodeData.gain")).alias("gain"),
        F.col("nodeData.rawCount").alias("rows"),
        F.when(inner, F.col("nodeData.leftChild")).alias("left"),
        F.when(inner, F.col("nodeData.rightChild")).alias("right"),
        F.col("nodeData.prediction").alias("prediction"),
    )


def split_counts(model: Model, inputs: Sequence[str]) -> DataFrame:
    """``feature, splits, importance`` of every input: how often it splits a node, and its share of the gain."""
    spark = SparkSession.active()
    gains = model.featureImportances.toArray()
    named = spark.createDataFrame(
        [(n, name, float(gains[n])) for n, name in enumerate(inputs)], "number int, feature string, importance double"
    )
    counts = nodes(model).where("feature IS NOT NULL").groupBy(F.col("feature").alias("number")).agg(F.count(F.lit(1)).alias("splits"))
    return named.join(counts, "number", "left").select("feature", F.coalesce("splits", F.lit(0)).alias("splits"), "importance")


# --- best prefix ---------------------------------------------------------------------------


def best_prefix(losses: Sequence[float], patience: int) -> int:
    """Trees up to the lowest loss before ``patience`` rounds in a row brought no lower one."""
    best, at = math.inf, 0
    for n, loss in enumerate(losses, 1):
        if loss < best:
            best, at = loss, n
        elif n - at >= patience:
            break
    return at


def first_trees(model: Model, count: int) -> Model:
    """The ensemble of the first ``count`` trees."""
    if count >= model.getNumTrees:
        return model
    spark, old, new = SparkSession.active(), saved(model), table_path(SparkSession.active(), "model")
    spark.read.parquet(f"{old}/data").where(F.col("treeID") < count).write.parquet(f"{new}/data")
    trees = spark.read.parquet(f"{old}/treesMetadata")
    trees.where(F.col(trees.columns[0]) < count).coalesce(1).write.parquet(f"{new}/treesMetadata")
    about = json.loads(spark.read.text(f"{old}/metadata").first()[0]) | {"numTrees": count}
    _write_line(spark, json.dumps(about), f"{new}/metadata")
    return type(model).load(new)


def fit_with_patience(estimator, train: DataFrame, held: DataFrame, patience: int) -> Model:
    """Fit all rounds on ``train``, then keep the trees up to the best round on ``held``.

    The loss after every round comes from one pass over ``held``. Training itself does not stop early, as the library cannot go
    on with a half-trained ensemble; what is kept is the model that stopping would have kept.
    """
    model = estimator.fit(train)
    losses = model.evaluateEachIteration(held)
    return first_trees(model, best_prefix(losses, patience))


def _write_line(spark: SparkSession, line: str, path: str) -> None:
    spark.createDataFrame([(line,)], "value string").coalesce(1).write.text(path)


# --- forests of many trees -----------------------------------------------------------------

#: Trees of one model at most: a fit notes for each row how often each of its trees has drawn it.
MOST_TREES = 100
#: Nodes that the trees of one model may have together; each takes some hundred bytes of the driver.
MOST_NODES = 4_000_000
_AT = "_forest_row"


def trees_at_once(rows: int, depth: int, per_leaf: int) -> int:
    """How many trees over so many rows one model may hold."""
    nodes = min(2 ** (depth + 1), 2 * max(rows // max(per_leaf, 1), 1))
    return max(1, min(MOST_TREES, MOST_NODES // nodes))


class Forest:
    """A forest whose trees are too many for one model: ordinary forests, saved, that vote together."""

    def __init__(self, parts: Sequence[tuple[str, int]]):
        self.parts = list(parts)
        self.getNumTrees = sum(size for _, size in self.parts)

    def scored(self, rows: DataFrame, name: str) -> DataFrame:
        """``rows`` with the mean vote of all trees. Each part votes in a pass of its own, so a task holds few of them."""
        spark = rows.sparkSession
        kept = stage(rows.withColumn(_AT, F.monotonically_increasing_id()), "forest-rows")
        path = table_path(spark, "forest-votes")

        def vote(number: int, part: str) -> None:
            model = RandomForestClassificationModel.load(part)
            votes = model.transform(kept.select(_AT, FEATURES)).select(_AT, vector_to_array("rawPrediction")[1].alias("votes"))
            votes.write.parquet(f"{path}/part={number}")

        in_parallel(spark, [partial(vote, n, part) for n, (part, _) in enumerate(self.parts)])
        votes = spark.read.schema(f"{_AT} bigint, votes double, part int").parquet(path)
        # Added up in the order of the parts, so that equal rows have equal scores.
        in_order = F.sort_array(F.collect_list(F.struct("part", "votes")))
        total = F.aggregate(in_order, F.lit(0.0), lambda sum_, one: sum_ + one["votes"])
        means = votes.groupBy(_AT).agg((total / self.getNumTrees).alias(name))
        return kept.join(means, _AT).drop(_AT)


class ForestClassifier(RandomForestClassifier):
    """``RandomForestClassifier`` for any number of trees; the fit of many gives a :class:`Forest`."""

    def _fit(self, dataset: DataFrame) -> RandomForestClassificationModel | Forest:
        wanted = self.getNumTrees()
        size = trees_at_once(dataset.count(), self.getMaxDepth(), self.getMinInstancesPerNode())
        if wanted <= size:
            return super()._fit(dataset)
        parts = []
        for start in range(0, wanted, size):
            count = min(size, wanted - start)
            # Each part draws its own rows and inputs.
            part = self.copy({self.numTrees: count, self.seed: (self.getSeed() + 1) * 1_000_003 + start})
            parts.append((saved(RandomForestClassifier._fit(part, dataset)), count))
        return Forest(parts)


# --- extremely random trees ----------------------------------------------------------------


@dataclass
class ExtraTrees:
    """Forest whose trees cut each input at random places only.

    Every tree draws ``cuts`` places for each input, uniformly between its lowest and highest value. At a node it picks the
    best of these cuts among a random choice of inputs. All rows go into every tree. The result is an ordinary forest, or a
    :class:`Forest` if its trees are many.
    """

    numTrees: int = 20
    maxDepth: int = 10
    minInstancesPerNode: int = 1
    impurity: str = "gini"
    cuts: int = 8
    seed: int = 0
    width: int = WIDTH

    def draw(self, bounds: Sequence[tuple[float, float]], tree: int) -> list[list[float]]:
        """Ascending cut places of each input; an input with one value has none."""
        draws = random.Random(f"extra-trees/{self.seed}/{tree}")
        places = []
        for low, high in bounds:
            drawn = {draws.uniform(low, high) for _ in range(self.cuts)}
            places.append(sorted(x for x in drawn if low < x <= high))
        return places

    def fit(self, rows: DataFrame) -> RandomForestClassificationModel | Forest:
        with settings(rows.sparkSession, BY_FILE):
            return self._fit(rows)

    def _fit(self, rows: DataFrame) -> RandomForestClassificationModel | Forest:
        spark = rows.sparkSession
        values = vector_to_array(FEATURES)
        inputs = len(rows.select(FEATURES).first()[0])
        wide = rows.select(*[values[n].alias(f"_x{n}") for n in range(inputs)])
        low, high = [F.min(c) for c in wide.columns], [F.max(c) for c in wide.columns]
        lows, highs, total = wide.agg(F.array(*low), F.array(*high), F.count(F.lit(1))).first()
        bounds = list(zip(lows, highs, strict=True))
        grower = _Grower(self, rows)
        size = trees_at_once(total, self.maxDepth, self.minInstancesPerNode)
        parts = []
        for start in range(0, self.numTrees, size):
            some = range(start, min(start + size, self.numTrees))
            jobs = [partial(self._grow, grower, bounds, tree) for tree in some]
            model = grower.forest(in_parallel(spark, jobs, width_for(total, self.width)))
            if len(some) == self.numTrees:
                return model
            parts.append((saved(model), len(some)))
        return Forest(parts)

    def _grow(self, grower: _Grower, bounds: Sequence[tuple[float, float]], tree: int):
        return grower.tree(self.draw(bounds, tree), self.seed * 1_000_003 + tree)


class _Grower:
    """The library's search for the splits of a tree, over given cut places.

    ``RandomForestClassifier`` looks for cut places itself. What it does next, with rows as numbers of the bins between
    them, is called here directly; a tree so takes one pass over the vectors and no plan over all of its inputs.
    """

    def __init__(self, kind: ExtraTrees, rows: DataFrame):
        self.context = rows.sparkSession.sparkContext
        self.jvm, self.new_array = self.context._jvm, self.context._gateway.new_array
        self.estimator = RandomForestClassifier(
            featuresCol=FEATURES,
            labelCol=LABEL,
            numTrees=1,
            bootstrap=False,
            featureSubsetStrategy="sqrt",
            maxDepth=kind.maxDepth,
            minInstancesPerNode=kind.minInstancesPerNode,
            impurity=kind.impurity,
            maxBins=max(kind.cuts + 2, 4),
        )
        self.estimator._transfer_params_to_java()
        self.java = self.estimator._java_obj
        self.none = self._object("scala.None")
        utils = self._object("org.apache.spark.ml.util.DatasetUtils")
        self.classes = utils.getNumClasses(rows._jdf, LABEL, 100)
        self.rows = utils.extractInstances(self.java, rows._jdf, self.jvm.scala.Some(self.classes))
        self.impl = self.jvm.org.apache.spark.ml.tree.impl
        self.about = self.impl.DecisionTreeMetadata.buildMetadata(self.rows, self._strategy(), 1, "sqrt")

    def tree(self, places: Sequence[Sequence[float]], seed: int):
        """A tree with splits at ``places`` only. A row at a place goes right, as the bin there begins with it."""
        kind = self.jvm.org.apache.spark.ml.tree
        splits, bins = self.new_array(kind.Split, len(places), 0), self.new_array(self.jvm.int, len(places))
        for n, cuts in enumerate(places):
            splits[n] = self.new_array(kind.Split, len(cuts))
            for m, place in enumerate(cuts):
                splits[n][m] = kind.ContinuousSplit(n, math.nextafter(place, -math.inf))
            bins[n] = len(cuts) + 1
        about = self._about(bins)
        points = self.impl.TreePoint.convertToTreeRDD(self.rows, splits, about)
        once = getattr(self.impl.BaggedPoint, "convertToBaggedRDD$default$5")()
        bagged = self.impl.BaggedPoint.convertToBaggedRDD(points, 1.0, 1, False, once, seed)
        bagged.persist(self.jvm.org.apache.spark.storage.StorageLevel.MEMORY_AND_DISK())
        sent = self.context._jsc.broadcast(splits)
        unlimited = getattr(self.impl.RandomForest, "runBagged$default$11")()
        try:
            return self.impl.RandomForest.runBagged(
                bagged, about, sent, self._strategy(), 1, "sqrt", seed, self.none, True, self.none, unlimited
            )[0]
        finally:
            bagged.unpersist(False)
            sent.destroy()

    def forest(self, grown: Sequence) -> RandomForestClassificationModel:
        """The trees as one model of the library."""
        classes = self.jvm.org.apache.spark.ml.classification
        held = self.new_array(classes.DecisionTreeClassificationModel, len(grown))
        for n, tree in enumerate(grown):
            held[n] = tree
        whole = self.estimator.copy({self.estimator.numTrees: len(grown)})
        whole._transfer_params_to_java()
        java = whole._java_obj
        made = classes.RandomForestClassificationModel(whole.uid, held, self.about.numFeatures(), self.classes)
        return whole._copyValues(RandomForestClassificationModel(java.copyValues(made, java.extractParamMap())))

    def _object(self, name: str):
        found = self.jvm
        for part in f"{name}$".split("."):
            found = getattr(found, part)
        return getattr(found, "MODULE$")

    def _strategy(self):
        algo = self.jvm.org.apache.spark.mllib.tree.configuration.Algo.Classification()
        continuous = self._object("scala.collection.immutable.Map").empty()
        found = self.java.getOldStrategy(continuous, self.classes, algo, self.java.getOldImpurity())
        found.setBootstrap(False)
        return found

    def _about(self, bins):
        """What is known of the rows, with the numbers of bins of one tree."""
        a = self.about
        return self.impl.DecisionTreeMetadata(
            a.numFeatures(), a.numExamples(), a.weightedNumExamples(), a.numClasses(), a.maxBins(), a.featureArity(),
            a.unorderedFeatures(), bins, a.impurity(), a.quantileStrategy(), a.maxDepth(), a.minInstancesPerNode(),
            a.minWeightFractionPerNode(), a.minInfoGain(), a.numTrees(), a.numFeaturesPerNode(),
        )
