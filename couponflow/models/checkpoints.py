"""Averages of checkpoints, as of factorization machines that are stopped at growing numbers of steps."""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.ml import Model
from pyspark.sql import DataFrame

from couponflow.models.machines import FactorizationMachine, fit_together
from couponflow.models.training import score
from couponflow.operators.blending import CHECKPOINT_WEIGHTS, weighted_mean


def is_prefix(short: Sequence[float], long: Sequence[float], tolerance: float = 1e-6) -> bool:
    """Whether the losses of one optimisation are the first ones of another."""
    return len(short) <= len(long) and all(math.isclose(a, b, rel_tol=tolerance) for a, b in zip(short, long))


@dataclass
class CheckpointEnsemble:
    """Weighted mean of the scores of each estimator at each number of steps.

    All machines take their steps in the same passes over the rows, and keep their coefficients on the way. They go on to their
    last step unless their ``tol`` ends them (0 never does). Order of ``weights``: estimators, then steps.
    """

    estimators: Sequence[FactorizationMachine]
    steps: Sequence[int]
    weights: Sequence[float] = CHECKPOINT_WEIGHTS
    models: list[Model] = field(default_factory=list)

    def fit(self, rows: DataFrame) -> CheckpointEnsemble:
        if list(self.steps) != sorted(set(self.steps)):
            raise ValueError("the numbers of steps must grow")
        self.models = fit_together(self.estimators, self.steps, rows)
        for n in range(0, len(self.models), len(self.steps)):
            losses = [list(m.summary().objectiveHistory) for m in self.models[n : n + len(self.steps)]]
            for short, long in zip(losses, losses[1:]):
                if not is_prefix(short, long):
                    raise ValueError("runs of one estimator are not parts of one optimisation")
        return self

    def names(self) -> list[str]:
        return [f"checkpoint_{e}_{n}" for e in range(len(self.estimators)) for n in self.steps]

    def predict(self, rows: DataFrame) -> DataFrame:
        """``score``, and each checkpoint's own score beside it."""
        for name, model in zip(self.names(), self.models, strict=True):
            rows = score(model, rows, name)
        return rows.withColumn("score", weighted_mean(self.names(), self.weights))
