"""Accuracy and AUC, globally and per coupon, without a loop over groups.

AUC is the share of (positive, negative) pairs in the right order, ties counting one half. Rows
are first counted per (group, score). Scores are then cut into buckets at approximate quantiles
of all scores, so that running sums are taken inside (group, bucket): a group with most of the
rows is spread over all buckets, and one more running sum over its few buckets completes the
result. The cut points affect the work layout only, never the value.
"""

from __future__ import annotations

from collections.abc import Sequence
from math import ceil, inf

from pyspark.ml.feature import Bucketizer
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from couponflow.session import stage

SCORES_PER_BUCKET = 2_000_000


def auc_by_group(
    scored: DataFrame,
    groups: Sequence[str],
    score: str = "score",
    label: str = "label",
    scores_per_bucket: int = SCORES_PER_BUCKET,
) -> DataFrame:
    """``groups``, ``positives``, ``negatives`` and ``auc`` for groups that have both classes."""
    groups = list(groups)
    counts = scored.groupBy(*groups, F.col(score).cast("double").alias("_score")).agg(
        F.count_if(F.col(label) == 1).alias("_pos"), F.count_if(F.col(label) == 0).alias("_neg")
    )
    # Staged, as it is read for its size, its quantiles and the result.
    bucketed = _bucketed(stage(counts, "score-counts"), scores_per_bucket)
    below = Window.partitionBy(*groups, "_bucket").orderBy("_score")
    below = below.rowsBetween(Window.unboundedPreceding, -1)
    beaten = F.coalesce(F.sum("_neg").over(below), F.lit(0)) + F.col("_neg") / 2
    per_bucket = (
        bucketed.withColumn("_won", F.col("_pos") * beaten)
        .groupBy(*groups, "_bucket")
        .agg(F.sum("_won").alias("_won"), F.sum("_pos").alias("_pos"), F.sum("_neg").alias("_neg"))
    )
    lower = Window.partitionBy(*groups).orderBy("_bucket")
    lower = lower.rowsBetween(Window.unboundedPreceding, -1)
    carried = F.col("_pos").cast("double") * F.coalesce(F.sum("_neg").over(lower), F.lit(0))
    pairs = F.col("positives").cast("double") * F.col("negatives")
    return (
        per_bucket.withColumn("_won", F.col("_won") + carried)
        .groupBy(*groups)
        .agg(
            F.sum("_pos").alias("positives"),
            F.sum("_neg").alias("negatives"),
            F.sum("_won").alias("_won"),
        )
        .where((F.col("positives") > 0) & (F.col("negatives") > 0))
        .select(*groups, "positives", "negatives", (F.col("_won") / pairs).alias("auc"))
    )


def auc(scored: DataFrame, score: str = "score", label: str = "label", **layout) -> DataFrame:
    """One row: ``positives``, ``negatives``, ``auc`` over all rows."""
    return auc_by_group(
        scored.withColumn("_all", F.lit(0)), ["_all"], score, label, **layout
    ).drop("_all")


def mean_coupon_auc(
    scored: DataFrame, group: str = "coupon_id", score: str = "score", label: str = "label", **layout
) -> DataFrame:
    """One row: unweighted mean AUC over coupons with both classes, and their number."""
    return auc_by_group(scored, [group], score, label, **layout).agg(
        F.count(F.lit(1)).alias("coupons"), F.avg("auc").alias("coupon_auc")
    )


def accuracy(scored: DataFrame, prediction: str = "prediction", label: str = "label") -> DataFrame:
    right = (F.col(prediction) == F.col(label)).cast("int")
    return scored.agg(F.count(F.lit(1)).alias("rows"), F.avg(right).alias("accuracy"))


def _bucketed(counts: DataFrame, scores_per_bucket: int) -> DataFrame:
    buckets = ceil(counts.count() / scores_per_bucket)
    edges: list[float] = []
    if buckets > 1:
        shares = [n / buckets for n in range(1, buckets)]
        edges = sorted(set(counts.approxQuantile("_score", shares, 0.25 / buckets)))
    if not edges:
        return counts.withColumn("_bucket", F.lit(0.0))
    cut = Bucketizer(splits=[-inf, *edges, inf], inputCol="_score", outputCol="_bucket")
    return cut.transform(counts)
