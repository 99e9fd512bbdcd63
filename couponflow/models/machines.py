"""Factorization machines whose steps are matrix products over blocks of rows.

``FMClassifier`` takes every step row by row, about 35 microseconds of a core each, and gives up all but its last
coefficients. Here the rows are written once as blocks of numbers and a step is a few products a block. Start, loss, gradient,
update and end are those of the library, so are the models; machines that are fitted on the same rows share each pass, and
coefficients after any number of steps can be kept.
"""

from __future__ import annotations

from collections.abc import Sequence
from types import SimpleNamespace

import numpy as np
from pyspark import SparkContext
from pyspark.ml.classification import FMClassificationModel, FMClassifier
from pyspark.ml.common import _py2java
from pyspark.ml.functions import vector_to_array
from pyspark.ml.linalg import DenseMatrix, DenseVector
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from couponflow.session import BY_FILE, settings, table_path

#: Bytes of a block of rows before it is packed, and blocks of a file. A task reads a file or a few.
BLOCK_BYTES, BLOCKS_PER_FILE = 1 << 20, 64
#: A task holds this many blocks at a time.
BY_BLOCK = BY_FILE | {"spark.sql.parquet.columnarReaderBatchSize": "8", "spark.sql.execution.arrow.maxRecordsPerBatch": "8"}


class Machine(FMClassificationModel):
    """A model of the library that knows the losses of its own steps."""

    def __init__(self, java_model, losses: Sequence[float] = ()):
        super().__init__(java_model)
        self.losses = list(losses)

    def summary(self):
        return SimpleNamespace(objectiveHistory=self.losses)


class FactorizationMachine(FMClassifier):
    """``FMClassifier`` with steps over blocks."""

    def _fit(self, dataset: DataFrame) -> FMClassificationModel:
        if not self.takes_blocks():
            return super()._fit(dataset)
        return fit_together([self], [self.getMaxIter()], dataset)[0]

    def takes_blocks(self) -> bool:
        """Other solvers, and machines without some of the coefficients, are left to the library."""
        whole = self.getFitIntercept() and self.getFitLinear()
        return whole and self.getSolver() == "adamW" and self.getMiniBatchFraction() == 1.0


class _Run:
    """The optimisation of one machine, as of the library's ``GradientDescent`` with its ``AdamWUpdater``."""

    def __init__(self, machine: FactorizationMachine, width: int):
        self.machine, self.width, self.size = machine, width, machine.getFactorSize()
        machine._transfer_params_to_java()
        self.weights = np.array(list(machine._java_obj.initCoefficients(width).toArray()))
        self.mean, self.square, self.step = np.zeros_like(self.weights), np.zeros_like(self.weights), 0
        self.losses: list[float] = []
        self.kept: dict[int, np.ndarray] = {}
        self.penalty = self._penalty()
        self.ended = False

    def parts(self) -> tuple[np.ndarray, np.ndarray, float]:
        cut = self.width * self.size
        return self.weights[:cut].reshape(self.width, self.size), self.weights[cut:-1], float(self.weights[-1])

    def take(self, gradient: np.ndarray) -> None:
        """One step, given the mean gradient of all rows."""
        before, rate, decay = self.weights, self.machine.getStepSize(), self.machine.getRegParam()
        self.step += 1
        self.mean = 0.9 * self.mean + 0.1 * gradient
        self.square = 0.999 * self.square + 0.001 * gradient * gradient
        ahead = (self.mean / (1 - 0.9**self.step)) / (np.sqrt(self.square / (1 - 0.999**self.step)) + 1e-8)
        self.weights = before - (rate * ahead + decay * before)
        self.penalty = self._penalty()
        moved = np.linalg.norm(self.weights - before)
        # The library compares the coefficients of two steps, so the first one never ends it.
        self.ended = self.step > 1 and moved < self.machine.getTol() * max(np.linalg.norm(self.weights), 1.0)

    def keep(self, steps: int) -> None:
        """Remember the coefficients as those after ``steps`` steps."""
        self.kept[steps] = self.weights

    def model(self, steps: int) -> Machine:
        """The library's model after ``steps`` steps. Its losses are those before each step and, unless ``tol`` ended it, the last."""
        self.weights, losses = self.kept[steps], self.losses[: steps + 1]
        factors, linear, intercept = self.parts()
        context, java = SparkContext._active_spark_context, self.machine._java_obj
        matrix = DenseMatrix(self.width, self.size, factors.ravel(), isTransposed=True)
        made = context._jvm.org.apache.spark.ml.classification.FMClassificationModel(
            self.machine.uid, intercept, _py2java(context, DenseVector(linear)), _py2java(context, matrix)
        )
        return self.machine._copyValues(Machine(java.copyValues(made, java.extractParamMap()), losses))

    def _penalty(self) -> float:
        return 0.5 * self.machine.getRegParam() * float(self.weights @ self.weights)


def fit_together(machines: Sequence[FactorizationMachine], steps: Sequence[int], rows: DataFrame) -> list[Machine]:
    """The models of each machine after each number of steps (ascending), machine by machine, in one pass a step for all."""
    if not all(m.takes_blocks() for m in machines):
        raise ValueError("only whole machines with the adamW solver take their steps together")
    first = machines[0]
    width = _width(rows, first.getFeaturesCol())
    blocks = _blocks(rows, first.getFeaturesCol(), first.getLabelCol(), width)
    runs = [_Run(m, width) for m in machines]
    # The pass after the last step is for the last loss.
    for step in range(1, steps[-1] + 2):
        _step(blocks, [r for r in runs if not r.ended], width, step > steps[-1])
        if step in steps:
            for run in runs:
                run.keep(step)
    return [run.model(n) for run in runs for n in steps]


def _width(rows: DataFrame, features: str) -> int:
    """Inputs, from what the assembler has noted, else from a row."""
    noted = rows.schema[features].metadata.get("ml_attr", {}).get("num_attrs")
    return noted or len(rows.select(features).first()[0])


def _blocks(rows: DataFrame, features: str, label: str, width: int) -> DataFrame:
    """``rows`` written as blocks: ``y`` is their labels, ``x`` their inputs, input by input and packed.

    A pass is mostly the way of the bytes to the Python task, so they stay packed on it.
    """
    size = max(1, BLOCK_BYTES // (8 * max(width, 1)))

    # Shipped by value, with what it uses, so that executors need nothing of this package.
    def pack(batches):
        import numpy as np
        import pyarrow as pa

        def block(y, x):
            packed = pa.compress(np.ascontiguousarray(x.T).tobytes(), codec="zstd", asbytes=True)
            return pa.RecordBatch.from_arrays([pa.array([y.tobytes()], pa.binary()), pa.array([packed], pa.binary())], names=["y", "x"])

        left_y, left_x = np.empty(0), np.empty((0, width))
        for batch in batches:
            if batch.column(0).null_count or batch.column(1).null_count:
                raise ValueError("rows to fit must have a label and inputs")
            y, flat = batch.column(0).to_numpy(zero_copy_only=False), batch.column(1).flatten().to_numpy(zero_copy_only=False)
            if not (np.isin(y, (0.0, 1.0)).all() and np.isfinite(flat).all()):
                raise ValueError("labels must be 0 or 1, and inputs numbers")
            left_y, left_x = np.concatenate([left_y, y]), np.concatenate([left_x, flat.reshape(-1, width)])
            whole = len(left_y) // size * size
            for at in range(0, whole, size):
                yield block(left_y[at : at + size], left_x[at : at + size])
            left_y, left_x = left_y[whole:], left_x[whole:]
        if len(left_y):
            yield block(left_y, left_x)

    spark, path = rows.sparkSession, table_path(rows.sparkSession, "blocks")
    with settings(spark, BY_FILE):
        plain = rows.select(F.col(label).cast("double").alias("y"), vector_to_array(features).alias("x"))
        packed = plain.mapInArrow(pack, "y binary, x binary")
        packed.write.option("maxRecordsPerFile", BLOCKS_PER_FILE).option("compression", "none").parquet(path)
    return spark.read.schema("y binary, x binary").parquet(path)


def _step(blocks: DataFrame, runs: Sequence[_Run], width: int, only_loss: bool) -> None:
    """One pass over all blocks and one step of every run. A task gives back its sums as one row."""
    if not runs:
        return
    given = [r.parts() for r in runs]
    sizes = [r.size for r in runs]

    def add(batches):
        import numpy as np
        import pyarrow as pa

        both = [np.column_stack([factors, linear]) for factors, linear, _ in given]
        squared = [(factors * factors).sum(axis=1) for factors, _, _ in given]
        slopes = [np.zeros((width, k + 1)) for k in sizes]
        curves = [np.zeros(width) for _ in sizes]
        totals, count = np.zeros((len(sizes), 2)), 0
        for batch in batches:
            for n in range(batch.num_rows):
                y = np.frombuffer(batch.column(0)[n].as_buffer())
                x = pa.decompress(batch.column(1)[n].as_buffer(), decompressed_size=8 * len(y) * width, codec="zstd")
                x = np.frombuffer(x).reshape(width, len(y)).T
                squares = x * x
                count += len(y)
                for m, k in enumerate(sizes):
                    seen = x @ both[m]
                    sums = seen[:, :k]
                    raw = given[m][2] + seen[:, k] + 0.5 * ((sums * sums).sum(axis=1) - squares @ squared[m])
                    totals[m, 1] += np.logaddexp(0, np.where(y > 0, -raw, raw)).sum()
                    with np.errstate(over="ignore"):
                        slope = 1 / (1 + np.exp(-raw)) - y
                    slopes[m] += x.T @ np.column_stack([sums * slope[:, None], slope])
                    curves[m] += squares.T @ slope
                    totals[m, 0] += slope.sum()
        if count:
            parts = [np.array([float(count)])]
            for m, k in enumerate(sizes):
                inner = slopes[m][:, :k] - given[m][0] * curves[m][:, None]
                parts += [inner.ravel(), slopes[m][:, k], totals[m]]
            yield pa.RecordBatch.from_arrays([pa.array([np.concatenate(parts).tobytes()], pa.binary())], names=["sums"])

    with settings(blocks.sparkSession, BY_BLOCK):
        found = blocks.mapInArrow(add, "sums binary").collect()
    if not found:
        return
    sums = np.sum([np.frombuffer(r["sums"]) for r in found], axis=0)
    at = 1
    for run in runs:
        size = len(run.weights)
        run.losses.append(sums[at + size] / sums[0] + run.penalty)
        if not only_loss:
            run.take(sums[at : at + size] / sums[0])
        at += size + 1
