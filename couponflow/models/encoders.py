"""Encoders that keep what they were fitted on, so that a batch is coded as the training rows were.

Each is an estimator whose model can be saved, alone or in a pipeline, and loaded by another application.
"""

from __future__ import annotations

from pyspark.ml import Estimator, Model
from pyspark.ml.param import Param, Params, TypeConverters
from pyspark.ml.param.shared import HasInputCols, HasOutputCols
from pyspark.ml.util import (
    DefaultParamsReadable,
    DefaultParamsReader,
    DefaultParamsWritable,
    DefaultParamsWriter,
    MLReadable,
    MLReader,
    MLWritable,
    MLWriter,
)
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from couponflow.operators.scaling import bounds_of, label_codes, scale
from couponflow.session import stage

#: Values of a column up to which its code table is broadcast; others are joined by a shuffle.
BROADCAST_VALUES = 500_000


class LabelEncoder(Estimator, HasInputCols, HasOutputCols, DefaultParamsReadable, DefaultParamsWritable):
    """Ranks of the distinct values of each input column, from 0."""

    def __init__(self, inputCols: list[str] | None = None, outputCols: list[str] | None = None):
        super().__init__()
        if inputCols is not None:
            self._set(inputCols=inputCols, outputCols=outputCols)

    def _fit(self, dataset: DataFrame) -> LabelEncoderModel:
        tables = [
            stage(label_codes(dataset, c).select(F.col(c).alias("value"), F.col(f"{c}_code").alias("code")), "codes")
            for c in self.getInputCols()
        ]
        return LabelEncoderModel(self.getInputCols(), self.getOutputCols(), tables)


class LabelEncoderModel(Model, HasInputCols, HasOutputCols, MLWritable, MLReadable):
    """Codes by table. A value that was not there when the tables were made, or none, gets the number of known values."""

    def __init__(self, inputCols: list[str], outputCols: list[str], tables: list[DataFrame]):
        super().__init__()
        self._set(inputCols=inputCols, outputCols=outputCols)
        self.tables = tables
        self.sizes = [t.count() for t in tables]

    def _transform(self, dataset: DataFrame) -> DataFrame:
        for name, code, table, size in zip(self.getInputCols(), self.getOutputCols(), self.tables, self.sizes, strict=True):
            known = table.select(F.col("value").alias(name), F.col("code").alias(code))
            known = F.broadcast(known) if size <= BROADCAST_VALUES else known
            dataset = dataset.join(known, name, "left").withColumn(code, F.coalesce(code, F.lit(size).cast("long")))
        return dataset

    def write(self) -> MLWriter:
        return _CodesWriter(self)

    @classmethod
    def read(cls) -> MLReader:
        return _CodesReader()


class _CodesWriter(MLWriter):
    def __init__(self, instance: LabelEncoderModel):
        super().__init__()
        self.instance = instance

    def saveImpl(self, path: str) -> None:
        DefaultParamsWriter.saveMetadata(self.instance, path, self.sparkSession)
        for n, table in enumerate(self.instance.tables):
            table.write.parquet(f"{path}/codes/{n}")


class _CodesReader(MLReader):
    def load(self, path: str) -> LabelEncoderModel:
        spark = SparkSession.active()
        metadata = DefaultParamsReader.loadMetadata(path, spark)
        given = metadata["paramMap"]
        tables = [spark.read.parquet(f"{path}/codes/{n}") for n in range(len(given["inputCols"]))]
        model = LabelEncoderModel(given["inputCols"], given["outputCols"], tables)
        model._resetUid(metadata["uid"])
        return model


class RangeScaler(Estimator, HasInputCols, DefaultParamsReadable, DefaultParamsWritable):
    """Maps each input column, in place, from its range to [0, 1]."""

    def __init__(self, inputCols: list[str] | None = None):
        super().__init__()
        if inputCols is not None:
            self._set(inputCols=inputCols)

    def _fit(self, dataset: DataFrame) -> RangeScalerModel:
        bounds = bounds_of(dataset, self.getInputCols())
        # A column without values has the empty range at 0.
        lows, highs = zip(*[tuple(0.0 if x is None else x for x in bounds[c]) for c in self.getInputCols()], strict=True)
        return RangeScalerModel(self.getInputCols(), list(lows), list(highs))


class RangeScalerModel(Model, HasInputCols, DefaultParamsReadable, DefaultParamsWritable):
    """The fitted ranges. Values outside go beyond [0, 1]; a column with one value becomes 0."""

    lows = Param(Params._dummy(), "lows", "lowest values", TypeConverters.toListFloat)
    highs = Param(Params._dummy(), "highs", "highest values", TypeConverters.toListFloat)

    def __init__(self, inputCols: list[str] | None = None, lows: list[float] | None = None, highs: list[float] | None = None):
        super().__init__()
        if inputCols is not None:
            self._set(inputCols=inputCols, lows=lows, highs=highs)

    def _transform(self, dataset: DataFrame) -> DataFrame:
        ranges = zip(self.getOrDefault(self.lows), self.getOrDefault(self.highs), strict=True)
        return scale(dataset, dict(zip(self.getInputCols(), ranges, strict=True)))
