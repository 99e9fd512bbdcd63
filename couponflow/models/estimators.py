"""Named estimators with their tuned defaults.

The gradient-boosting libraries of the original work are replaced by ``GBTClassifier`` with
the nearest parameters. A leaf limit becomes a depth of log2(leaves); the column share becomes
``featureSubsetStrategy``.
"""

from __future__ import annotations

from dataclasses import fields
from typing import Any

from pyspark.ml import Estimator
from pyspark.ml.classification import GBTClassifier, LogisticRegression

from couponflow.models.machines import FactorizationMachine
from couponflow.models.names import FEATURES, LABEL
from couponflow.models.trees import ExtraTrees, ForestClassifier

# Tuned parameters per model.
DEFAULTS: dict[str, tuple[type, dict[str, Any]]] = {
    "gbt": (
        GBTClassifier,
        dict(stepSize=0.01, maxIter=1900, maxDepth=9, minInstancesPerNode=50, subsamplingRate=0.8),
    ),
    "gbt_a": (
        GBTClassifier,
        dict(
            stepSize=0.01,
            maxIter=1260,
            maxDepth=8,
            minInstancesPerNode=4,
            subsamplingRate=0.6,
            featureSubsetStrategy="0.8",
        ),
    ),
    "gbt_b": (
        GBTClassifier,
        dict(
            stepSize=0.025,
            maxIter=360,
            maxDepth=6,
            minInstancesPerNode=21,
            subsamplingRate=0.8,
            featureSubsetStrategy="0.8",
        ),
    ),
    "gbt_c": (
        GBTClassifier,
        dict(stepSize=0.01, maxIter=3600, maxDepth=8, maxBins=127, subsamplingRate=0.7),
    ),
    "rf_gini": (
        ForestClassifier,
        dict(numTrees=3090, maxDepth=15, minInstancesPerNode=1, impurity="gini"),
    ),
    "rf_entropy": (
        ForestClassifier,
        dict(numTrees=3110, maxDepth=13, minInstancesPerNode=10, impurity="entropy"),
    ),
    "et_gini": (ExtraTrees, dict(numTrees=3060, maxDepth=22, minInstancesPerNode=1, impurity="gini")),
    "et_entropy": (
        ExtraTrees,
        dict(numTrees=3100, maxDepth=13, minInstancesPerNode=10, impurity="entropy"),
    ),
    "logistic": (LogisticRegression, dict(regParam=0.01, elasticNetParam=0.01, maxIter=100, standardization=False)),
    "fm": (FactorizationMachine, dict(factorSize=8, solver="adamW", stepSize=0.01, maxIter=100)),
}

# The base models of the stack.
STACK_BASES = ["gbt", "gbt_a", "gbt_b", "gbt_c"]


def make(name: str, seed: int = 0, **overrides: Any) -> Estimator | ExtraTrees:
    """Estimator ``name`` with ``overrides`` for those parameters that it has."""
    kind, defaults = DEFAULTS[name]
    if kind is ExtraTrees:
        known = {f.name for f in fields(kind)}
        return kind(**defaults | {"seed": seed} | {k: v for k, v in overrides.items() if k in known})
    estimator = kind(featuresCol=FEATURES, labelCol=LABEL, **defaults)
    if estimator.hasParam("seed"):
        estimator = estimator.copy({estimator.getParam("seed"): seed})
    wanted = {estimator.getParam(k): v for k, v in overrides.items() if estimator.hasParam(k)}
    return estimator.copy(wanted)
