"""Combining scores that sit in columns of the same rows."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from couponflow.operators.scaling import bounds_of, scale

# Weights of the two-model blend and of the four checkpoints.
TWO_MODEL_WEIGHTS = (0.65, 0.35)
CHECKPOINT_WEIGHTS = (1, 2, 1, 2)


def weighted_sum(columns: Sequence[str], weights: Sequence[float]) -> Column:
    return reduce(
        lambda a, b: a + b, [F.col(c) * float(w) for c, w in zip(columns, weights, strict=True)]
    )


def weighted_mean(columns: Sequence[str], weights: Sequence[float]) -> Column:
    return weighted_sum(columns, weights) / float(sum(weights))


def mean_of(columns: Sequence[str]) -> Column:
    return weighted_mean(columns, [1] * len(columns))


def stretch(rows: DataFrame, score: str = "score") -> DataFrame:
    """Linear stretch of the scores to [0, 1]."""
    return scale(rows, bounds_of(rows, [score]))
