"""Where intermediate tables go, and how they are written."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from contextvars import ContextVar
from urllib.parse import unquote, urlparse

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """Folder every executor can reach, taken from ``spark.checkpoint.dir``.

    A machine-local folder is made only for a local master with no setting (tests).
    """
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        return configured.rstrip("/")
    context = spark.sparkContext
    if not context.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder all executors share")
    local = tempfile.mkdtemp(prefix="couponflow-")
    spark.conf.set("spark.checkpoint.dir", local)
    context.setCheckpointDir(local)
    return local


def table_path(spark: SparkSession, name: str) -> str:
    """Fresh path under the shared folder."""
    app = spark.sparkContext.applicationId
    path = f"{shared_dir(spark)}/couponflow/{app}/{name}-{uuid.uuid4().hex}"
    for made in _SCRATCH.get():
        made.append(path)
    return path


#: Paths handed out inside each open :func:`scratch` block of this thread.
_SCRATCH: ContextVar[tuple[list[str], ...]] = ContextVar("scratch", default=())


@contextmanager
def scratch(spark: SparkSession) -> Iterator[Callable[[DataFrame], DataFrame]]:
    """Tables that this thread stages inside the block are deleted at its end, but for those given to what it yields.

    For work whose result is a written table. Without it they stay until the application has ended, and with them the
    shuffles they were made by, which Spark deletes when nobody holds their plans.
    """
    made: list[str] = []
    kept: set[str] = set()

    def keep(table: DataFrame) -> DataFrame:
        files = [unquote(urlparse(f).path) for f in table.inputFiles()]
        kept.update(path for path in made if any(f.startswith(f"{urlparse(path).path}/") for f in files))
        return table

    token = _SCRATCH.set((*_SCRATCH.get(), made))
    try:
        yield keep
    finally:
        _SCRATCH.reset(token)
        for path in (p for p in made if p not in kept):
            at = spark._jvm.org.apache.hadoop.fs.Path(path)
            at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)
        spark._jvm.java.lang.System.gc()


# Joins of tables that share their buckets: join on the buckets as they are, even where the
# join keys are wider than the bucket key, and move neither side.
CO_LOCATED = {
    "spark.sql.requireAllClusterKeysForCoPartition": "false",
    "spark.sql.autoBroadcastJoinThreshold": "-1",
}


@contextmanager
def settings(spark: SparkSession, values: dict[str, str]) -> Iterator[None]:
    """Session settings for the jobs run inside the block."""
    before = {name: spark.conf.get(name) for name in values}
    for name, value in values.items():
        spark.conf.set(name, value)
    try:
        yield
    finally:
        for name, value in before.items():
            spark.conf.set(name, value)


def stage_by_key(df: DataFrame, name: str, key: str, buckets: int) -> DataFrame:
    """As :func:`stage`, bucketed by ``key``.

    Groups and joins whose keys include ``key`` then run on the buckets as they are, with no
    further shuffle. The caller sees to it that no key is too big for one task.
    """
    spark = df.sparkSession
    table = f"couponflow_{name.replace('-', '_')}_{uuid.uuid4().hex}"
    writer = df.repartition(buckets, key).write.format("parquet")
    writer.bucketBy(buckets, key).option("path", table_path(spark, name)).saveAsTable(table)
    return spark.table(table)


#: Rows of one file of a table that models are fitted on. A fit keeps the rows of a task in memory as one block, of about
#: 1.5 kB a row with all that boosting adds.
ROWS_PER_FILE = 250_000
#: Reading such tables, a task takes one file (small files: a few).
BY_FILE = {"spark.sql.files.maxPartitionBytes": str(8 << 20)}


def stage_for_fits(df: DataFrame, name: str) -> DataFrame:
    """As :func:`stage`, in files of a bounded number of rows. To be read with the settings ``BY_FILE``."""
    spark, path = df.sparkSession, table_path(df.sparkSession, name)
    with settings(spark, BY_FILE):
        df.write.option("maxRecordsPerFile", ROWS_PER_FILE).option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def stage(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet and read it back.

    This cuts lineage (a lost executor costs no recomputation of earlier stages), lets every
    consumer read only its columns, and gives the optimizer real sizes for join selection.
    """
    path = table_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
