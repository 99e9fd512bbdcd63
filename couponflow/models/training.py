"""Fit on a split of the matrix, score, and report the metrics."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml import Estimator, Model, Pipeline, PipelineModel
from pyspark.ml.feature import OneHotEncoder, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from couponflow.models.encoders import LabelEncoder, RangeScaler
from couponflow.models.estimators import make
from couponflow.models.machines import FactorizationMachine
from couponflow.models.names import FEATURES, LABEL
from couponflow.models.trees import Forest
from couponflow.operators import auc
from couponflow.operators.sampling import hash_fraction, split_exact
from couponflow.plans.matrix import model_inputs
from couponflow.session import BY_FILE, settings, stage, stage_for_fits

KEPT = ["row_id", "fold", "coupon_id", LABEL]
# The categorical inputs of the factorization machine.
SPARSE_INPUTS = ["weekday", "day", "discount_type"]


def assemble(matrix: DataFrame, inputs: Sequence[str]) -> DataFrame:
    """One ``features`` vector; identifying columns stay beside it."""
    vector = VectorAssembler(inputCols=list(inputs), outputCol=FEATURES)
    kept = [c for c in [*KEPT, "user_id", "date_received"] if c in matrix.columns]
    return vector.transform(matrix).select(*kept, FEATURES)


def vectors(matrix: DataFrame, inputs: Sequence[str]) -> DataFrame:
    """As :func:`assemble`, written: a fit reads its rows several times, which takes longer to assemble than to read."""
    with settings(matrix.sparkSession, BY_FILE):
        return stage_for_fits(assemble(matrix, inputs), "vectors")


def fit(estimator: Estimator, rows: DataFrame) -> Model:
    """The estimator fitted on ``rows``, a task for each of their files (see :func:`couponflow.session.stage_for_fits`)."""
    with settings(rows.sparkSession, BY_FILE):
        return estimator.fit(rows)


def score(model: Model | Forest, rows: DataFrame, name: str = "score") -> DataFrame:
    """Add the probability of redemption as ``name``; the model's own columns are dropped."""
    if isinstance(model, Forest):
        return model.scored(rows, name)
    made = {"rawPrediction", "probability", "prediction"}
    out = model.transform(rows).withColumn(name, vector_to_array("probability")[1])
    return out.drop(*made)


def metrics(scored: DataFrame, name: str) -> DataFrame:
    """One row: accuracy, global AUC and mean per-coupon AUC of ``score``."""
    scored = stage(scored.select("coupon_id", LABEL, "score"), "scored")
    labelled = scored.withColumn("prediction", (F.col("score") > 0.5).cast("int"))
    right = auc.accuracy(labelled).withColumn("model", F.lit(name))
    both = auc.auc(scored).select(F.lit(name).alias("model"), "auc")
    per_coupon = auc.mean_coupon_auc(scored).withColumn("model", F.lit(name))
    return right.join(both, "model", "left").join(per_coupon, "model", "left")


def split(matrix: DataFrame, train_rows: int | None = None) -> tuple[DataFrame, DataFrame]:
    """Training rows (exactly ``train_rows``, if there are so many) and the quarter kept for testing."""
    return split_exact(matrix, train_rows)


def train_and_evaluate(
    matrix: DataFrame, name: str, train_rows: int | None = None, **overrides
) -> tuple[Model, DataFrame]:
    """Fit estimator ``name`` on the training part; metrics on the test part."""
    train, test = split(vectors(matrix, model_inputs(matrix)), train_rows)
    model = fit(make(name, **overrides), train)
    return model, metrics(score(model, test), name)


def wide_inputs(dense: Sequence[str]) -> list:
    """Stages that turn filled matrix rows into one-hot categories and scaled numbers, fitted on training rows only."""
    codes, hot = ([f"{c}_{kind}" for c in SPARSE_INPUTS] for kind in ("code", "hot"))
    return [
        LabelEncoder(SPARSE_INPUTS, codes),
        RangeScaler(list(dense)),
        # A value that is new in a batch has a place of its own, which training leaves empty.
        OneHotEncoder(inputCols=codes, outputCols=hot, dropLast=False, handleInvalid="keep"),
        VectorAssembler(inputCols=[*hot, *dense], outputCol=FEATURES),
    ]


def dense_inputs(matrix: DataFrame) -> list[str]:
    return [c for c in model_inputs(matrix) if c not in SPARSE_INPUTS]


def fit_fm(train: DataFrame, **overrides) -> PipelineModel:
    """Encoders and factorization machine in one pipeline, which can be saved and scores any batch with these columns."""
    return fit_last(wide_inputs(dense_inputs(train)), make("fm", **overrides), train)


def train_fm(matrix: DataFrame, train_rows: int | None = None, **overrides) -> tuple[PipelineModel, DataFrame]:
    """Factorization machine and its metrics on the test part."""
    train, test = split(matrix, train_rows)
    model = fit_fm(train, **overrides)
    return model, metrics(score(model, test), "fm")


def pipeline(inputs: Sequence[str], estimator: Estimator) -> Pipeline:
    return Pipeline(stages=[VectorAssembler(inputCols=list(inputs), outputCol=FEATURES), estimator])


def fit_last(stages: Sequence, estimator: Estimator, train: DataFrame) -> PipelineModel:
    """The pipeline of ``stages`` and ``estimator``, fitted; what the stages make of the rows is written for the estimator."""
    with settings(train.sparkSession, BY_FILE):
        shape = Pipeline(stages=list(stages)).fit(train)
        rows = shape.transform(train).select(FEATURES, LABEL)
        # A factorization machine writes its rows itself.
        rows = rows if isinstance(estimator, FactorizationMachine) else stage_for_fits(rows, "shaped")
        return PipelineModel([*shape.stages, estimator.fit(rows)])


def fit_pipeline(inputs: Sequence[str], estimator: Estimator, train: DataFrame) -> PipelineModel:
    """:func:`pipeline`, fitted on ``train``."""
    return fit_last([VectorAssembler(inputCols=list(inputs), outputCol=FEATURES)], estimator, train)


def save_and_load(model: PipelineModel, path: str) -> PipelineModel:
    model.write().overwrite().save(path)
    return PipelineModel.load(path)


def halves(rows: DataFrame, seed: int = 0) -> tuple[DataFrame, DataFrame]:
    first = hash_fraction(f"{seed}-half") < 0.5
    return rows.where(first), rows.where(~first)
