"""Parameter search: a cross-validated grid and a walk along one parameter at a time, with a table of all trials."""

from __future__ import annotations

import hashlib
import json
import threading
from collections.abc import Callable, Sequence
from dataclasses import dataclass
from functools import partial
from itertools import product
from typing import Any

import numpy as np
from pyspark.ml.evaluation import BinaryClassificationEvaluator
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from couponflow.models.estimators import make
from couponflow.models.names import LABEL
from couponflow.models.parallel import WIDTH, in_parallel, width_for
from couponflow.models.training import score
from couponflow.operators.sampling import stratified_folds
from couponflow.session import stage_for_fits


@dataclass(frozen=True)
class Trial:
    params: dict[str, Any]
    mean_auc: float
    two_std: float


@dataclass(frozen=True)
class Step:
    """Step width and closed limits of one parameter; ``None`` is no limit."""

    step: float
    low: float
    high: float | None = None

    def clip(self, value: float) -> float:
        value = max(value, self.low)
        return value if self.high is None else min(value, self.high)

    def inside(self, value: float) -> bool:
        return value >= self.low and (self.high is None or value <= self.high)


# Steps and limits of the tuned parameters that have a counterpart here. Depths end at 30, the library's limit.
_SHARE, _GAIN, _DEPTH = Step(0.1, 0.1, 1.0), Step(0.1, 0.0, 1.0), Step(1, 1, 30)
_FOREST = {"numTrees": Step(10, 1), "maxDepth": _DEPTH, "minInstancesPerNode": Step(2, 1)}
SPACES: dict[str, dict[str, Step]] = {
    "gbt": {"maxIter": Step(100, 1), "maxDepth": _DEPTH, "minInstancesPerNode": Step(10, 1), "subsamplingRate": _SHARE},
    "gbt_a": {
        "maxIter": Step(10, 1),
        "maxDepth": _DEPTH,
        "minInstancesPerNode": Step(1, 1),
        "minInfoGain": _GAIN,
        "subsamplingRate": _SHARE,
        "featureSubsetStrategy": _SHARE,
    },
    "gbt_b": {
        "maxIter": Step(100, 1),
        "maxDepth": _DEPTH,
        "minInfoGain": _GAIN,
        "minInstancesPerNode": Step(1, 1),
        "featureSubsetStrategy": _SHARE,
    },
    "gbt_c": {"maxIter": Step(100, 1), "maxDepth": _DEPTH, "maxBins": Step(1, 2, 255), "subsamplingRate": _SHARE},
    "rf_gini": _FOREST,
    "rf_entropy": _FOREST,
    "et_gini": _FOREST,
    "et_entropy": _FOREST,
}


class Trials:
    """All trials of a search, one row each, kept in a folder that outlives the application.

    A trial is written when it is done and looked up before it is fitted. So a search that is started again, after a lost
    driver or over a larger space, fits only what is new. ``data``: a mark of the rows, as trials of other rows do not count.
    """

    SCHEMA = "key string, data string, model string, folds int, params string, mean_auc double, two_std double"

    def __init__(self, spark: SparkSession, folder: str, data: str):
        self.spark, self.folder, self.data = spark, folder.rstrip("/"), data
        #: Trials fitted, not looked up, by this object.
        self.fitted = 0
        self._writing = threading.Lock()
        marker = spark._jvm.org.apache.hadoop.fs.Path(self.folder)
        exists = marker.getFileSystem(spark._jsc.hadoopConfiguration()).exists(marker)
        rows = self.table().where(F.col("data") == data).collect() if exists else []
        self.known = {r["key"]: Trial(json.loads(r["params"]), r["mean_auc"], r["two_std"]) for r in rows}

    def table(self) -> DataFrame:
        return self.spark.read.schema(self.SCHEMA).parquet(self.folder)

    def key(self, model: str, folds: int, params: dict[str, Any]) -> str:
        return hashlib.md5(json.dumps([self.data, model, folds, params], sort_keys=True).encode()).hexdigest()

    def add(self, model: str, folds: int, trial: Trial) -> None:
        key = self.key(model, folds, trial.params)
        text = json.dumps(trial.params, sort_keys=True)
        row = (key, self.data, model, folds, text, trial.mean_auc, trial.two_std)
        # Two writers of one folder must not overlap: the first to end removes what the other has not committed yet.
        with self._writing:
            self.spark.createDataFrame([row], self.SCHEMA).coalesce(1).write.mode("append").parquet(self.folder)
            self.known[key] = trial
            self.fitted += 1


def data_mark(rows: DataFrame) -> str:
    """Mark of a set of rows with ids, whatever their order."""
    found = rows.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("row_id", LABEL))).first()
    return f"{found[0]}-{found[1]}"


class Search:
    """Cross-validated AUC of one model over rows with vectors; all points share the same ``folds`` parts."""

    def __init__(self, rows: DataFrame, model: str, folds: int = 5, trials: Trials | None = None, width: int = WIDTH):
        self.model, self.folds, self.trials, self.width = model, folds, trials, width
        dealt = stratified_folds(rows, folds).select("features", LABEL, "split")
        self.dealt = stage_for_fits(dealt, "search-folds")
        self.rows = self.dealt.count()

    def trial(self, params: dict[str, Any]) -> Trial:
        """Looked up, or fitted and written."""
        if self.trials is not None:
            known = self.trials.known.get(self.trials.key(self.model, self.folds, params))
            if known is not None:
                return known
        values = [self._auc(params, part) for part in range(self.folds)]
        found = Trial(params, float(np.mean(values)), float(2 * np.std(values)))
        if self.trials is not None:
            self.trials.add(self.model, self.folds, found)
        return found

    def _auc(self, params: dict[str, Any], part: int) -> float:
        named = {k: str(v) if k == "featureSubsetStrategy" else v for k, v in params.items()}
        model = make(self.model, **named).fit(self.dealt.where(F.col("split") != part))
        held = score(model, self.dealt.where(F.col("split") == part))
        return BinaryClassificationEvaluator(labelCol=LABEL, rawPredictionCol="score", numBins=0).evaluate(held)

    def grid(self, grid: dict[str, Sequence[Any]], base: dict[str, Any] | None = None) -> list[Trial]:
        """Every combination of ``grid`` over ``base``, best first."""
        points = [(base or {}) | dict(zip(grid, values, strict=True)) for values in product(*grid.values())]
        jobs = [partial(self.trial, p) for p in points]
        return sorted(in_parallel(self.dealt.sparkSession, jobs, width_for(self.rows, self.width)), key=lambda t: -t.mean_auc)

    def evaluate(self, params: dict[str, Any], name: str, values: list[Any]) -> tuple[Any, float]:
        """For :func:`coordinate_search`: the best of ``values`` for one parameter, and its score."""
        best = self.grid({name: values}, params)[0]
        return best.params[name], best.mean_auc


def grid_search(rows: DataFrame, model: str, grid: dict[str, Sequence[Any]], folds: int = 5, **base: Any) -> list[Trial]:
    """Cross-validated AUC per grid point, best first. ``rows`` holds the feature vector."""
    return Search(rows, model, folds).grid(grid, base)


def coordinate_search(
    evaluate: Callable[[dict[str, Any], str, list[Any]], tuple[Any, float]],
    start: dict[str, Any],
    steps: dict[str, Step],
    max_sweeps: int | None = None,
) -> tuple[dict[str, Any], list[Trial]]:
    """Climb one parameter at a time, and sweep again until nothing changes.

    ``evaluate(params, name, values)`` returns the best of ``values`` for parameter ``name``
    and its score. A parameter is first tried one step down, as it is, and one step up; then
    it goes on in the better direction, one value per round, until the score falls or a limit
    is reached. ``max_sweeps`` may end the walk early; the log then stops short of a sweep that
    changes nothing.
    """
    params, log = dict(start), []
    sweeps = 0
    while max_sweeps is None or sweeps < max_sweeps:
        sweeps += 1
        before = dict(params)
        for name, step in steps.items():
            here = params[name]
            around = {_tidy(step.clip(here - step.step), here), here, _tidy(step.clip(here + step.step), here)}
            candidates, best_score = sorted(around), 0.0
            while candidates:
                value, found = evaluate(params, name, candidates)
                log.append(Trial({**params, name: value}, found, 0.0))
                if value == params[name] or found < best_score:
                    break
                direction = 1 if value > params[name] else -1
                params[name], best_score = value, found
                ahead = _tidy(value + direction * step.step, value)
                candidates = [ahead] if step.inside(ahead) else []
        if params == before:
            break
    return params, log


def _tidy(value: float, like: float) -> float:
    return int(value) if isinstance(like, int) else round(value, 10)
