"""Reading tables, shipping this package to the executors, and a size-checked broadcast."""

from __future__ import annotations

import ctypes
import tempfile
import zipfile
from collections.abc import Iterator
from pathlib import Path

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows up to which a narrow side of a join (an id or hash, a few numbers) may be broadcast.
BROADCAST_ROWS = 500_000
_shipped: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Let Python tasks import this package, once per application.

    The driver packs its modules and Spark's file server hands them to every executor, so nothing has
    to be installed there. Where the package is installed, it is the same code.
    """
    context = spark.sparkContext
    if context.applicationId in _shipped:
        return
    package = Path(__file__).resolve().parents[1]
    packed = Path(tempfile.mkdtemp(prefix="couponflow-modules-")) / f"{package.name}.zip"
    with zipfile.ZipFile(packed, "w") as out:
        for module in sorted(package.rglob("*.py")):
            out.write(module, module.relative_to(package.parent))
    context.addPyFile(str(packed))
    _shipped.add(context.applicationId)


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    ship(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def at_most(df: DataFrame, rows: int) -> bool:
    """Whether ``df`` has no more than ``rows`` rows. Reads no more than it needs to."""
    return df.limit(rows + 1).count() <= rows


def small_side(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """``df`` with a broadcast hint if it is checked to be small, else as it is.

    Without the hint Spark joins by a shuffle, which holds for any size.
    """
    return F.broadcast(df) if at_most(df, rows) else df


#: Bytes of a slice of a batch that a Python task turns into objects at a time.
SLICE_BYTES = 8 << 20


def slices(batches: Iterator[pa.RecordBatch], size: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """The batches in slices of about ``size`` bytes (one row at least), without a copy.

    Spark bounds a batch at 64 MB, of which a task would hold several copies. At the end the freed memory is given
    back, so that a worker that is used again does not keep what an earlier stage needed.
    """
    for batch in batches:
        rows = max(1, int(batch.num_rows * min(1.0, size / max(batch.nbytes, 1))))
        for start in range(0, batch.num_rows, rows):
            yield batch.slice(start, rows)
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim is not None:
        trim(0)
