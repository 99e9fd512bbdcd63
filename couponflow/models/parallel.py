"""Independent fits as parallel Spark jobs, a bounded number at a time."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from concurrent.futures import ThreadPoolExecutor
from typing import TypeVar

from pyspark import inheritable_thread_target
from pyspark.sql import SparkSession

from couponflow.session import BY_FILE, settings

T = TypeVar("T")
#: Fits at a time. Each keeps its own (partly idle) rounds of small jobs, so a few fill the executors.
WIDTH = 4
#: Rows of all fits at a time. Each fit keeps its own copy of its rows, and large ones fill the executors alone.
ROWS_AT_ONCE = 4_000_000


def width_for(rows: int, width: int = WIDTH) -> int:
    """How many fits over so many rows each should run at a time."""
    return max(1, min(width, ROWS_AT_ONCE // max(rows, 1)))


def in_parallel(spark: SparkSession, jobs: Sequence[Callable[[], T]], width: int = WIDTH) -> list[T]:
    """Results of ``jobs`` in their order. Each runs in a scheduler pool of its own.

    With ``spark.scheduler.mode`` FAIR the pools share the executors evenly; otherwise the jobs still overlap, earlier ones
    first. The first error is raised, after the jobs that are running have ended.
    """
    with settings(spark, BY_FILE):
        return _results(spark, jobs, width)


def _results(spark: SparkSession, jobs: Sequence[Callable[[], T]], width: int) -> list[T]:
    if width <= 1 or len(jobs) <= 1:
        return [job() for job in jobs]

    def pooled(number: int, job: Callable[[], T]) -> Callable[[], T]:
        @inheritable_thread_target(spark)
        def run() -> T:
            spark.sparkContext.setLocalProperty("spark.scheduler.pool", f"fit-{number % width}")
            return job()

        return run

    with ThreadPoolExecutor(max_workers=width) as pool:
        waiting = [pool.submit(pooled(n, job)) for n, job in enumerate(jobs)]
        return [w.result() for w in waiting]
