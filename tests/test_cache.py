"""The feature cache: what is built again, what is reused, and how parts are published."""

import subprocess
import sys
from dataclasses import replace
from datetime import date, timedelta
from pathlib import Path

import pytest

from couponflow.operators.folds import Fold, history_rows
from couponflow.session import table_path
from couponflow.sources.cache import FeatureCache, Source, depends
from couponflow.sources.schemas import OFFLINE

FOLDS = [
    Fold(1, date(2016, 3, 1), date(2016, 3, 31), date(2016, 1, 1), date(2016, 1, 31), date(2016, 1, 1), date(2016, 2, 28)),
    Fold(2, date(2016, 6, 1), date(2016, 6, 30), date(2016, 4, 1), date(2016, 4, 30), date(2016, 4, 1), date(2016, 5, 31)),
]


def write(spark, folder, day, users=3):
    rows = [(u, 1, 5, "30:5", 1, day, day + timedelta(2)) for u in range(users)] + [(9, 1, None, None, None, None, day)]
    spark.createDataFrame(rows, OFFLINE).coalesce(1).write.mode("append").parquet(folder)


@pytest.fixture
def cached(spark):
    source = table_path(spark, "source")
    for day in (date(2016, 1, 5), date(2016, 4, 5)):
        write(spark, source, day)
    place = table_path(spark, "cache")
    calls = []

    def read(files):
        return spark.read.schema(OFFLINE).parquet(*files)

    def table(folds=FOLDS, flags=None, cache=None):
        def build(stale):
            calls.append([f.fold for f in stale])
            return history_rows(read([source]).fillna({"coupon_id": 0}), stale).groupBy("fold").count()

        cache = cache or FeatureCache(spark, place)
        found = cache.table(folds, [Source("offline", (source,), read)], flags or {}, build)
        return {r["fold"]: r["count"] for r in found.collect()}, cache

    return source, place, calls, table


def test_only_stale_folds_are_built(spark, cached):
    source, place, calls, table = cached
    assert table()[0] == {1: 4, 2: 4}
    assert table()[0] == {1: 4, 2: 4} and calls == [[1, 2]]
    # A new file in the windows of fold 2 only.
    write(spark, source, date(2016, 4, 20), users=1)
    found, cache = table()
    assert found == {1: 4, 2: 6} and calls[1:] == [[2]] and (cache.built, cache.reused) == ([2], [1])
    # A file in no window at all.
    write(spark, source, date(2016, 9, 1))
    assert table()[0] == {1: 4, 2: 6} and len(calls) == 2
    # Another window of fold 1.
    moved = [replace(FOLDS[0], buy_to=date(2016, 1, 2)), FOLDS[1]]
    assert table(moved)[0] == {1: 3, 2: 6} and calls[2:] == [[1]]
    # Another flag: everything; and the parts of before are still there.
    assert table(flags={"compat": True})[0] == {1: 4, 2: 6} and calls[3:] == [[1, 2]]
    assert table()[0] == {1: 4, 2: 6} and len(calls) == 4


def test_a_changed_file_is_noticed(spark, cached):
    source, _, calls, table = cached
    table()
    victim = next(p for p in Path(source).glob("part-*") if spark.read.parquet(str(p)).where("month(date) = 1").count())
    victim.unlink()
    write(spark, source, date(2016, 1, 9), users=7)
    assert table()[0] == {1: 8, 2: 4} and calls[1:] == [[1]]


def test_another_application_reuses_the_parts(spark, cached, tables):
    source, place, calls, table = cached
    table()
    script = f"""
import sys
from pyspark.sql import SparkSession
sys.path.insert(0, {str(Path(__file__).resolve().parents[1])!r})
sys.path.insert(0, {str(Path(__file__).resolve().parent)!r})
from couponflow.sources.cache import FeatureCache, Source
from couponflow.sources.schemas import OFFLINE
from test_cache import FOLDS
spark = SparkSession.builder.master("local[1]").config("spark.ui.enabled", "false").getOrCreate()
read = lambda files: spark.read.schema(OFFLINE).parquet(*files)
cache = FeatureCache(spark, {place!r})
rows = cache.table(FOLDS, [Source("offline", ({source!r},), read)], {{}}, None)
print("FOUND", cache.built, cache.reused, rows.count())
"""
    done = subprocess.run([sys.executable, "-c", script], capture_output=True, text=True, timeout=120)
    assert "FOUND [] [1, 2] 2" in done.stdout, done.stderr[-2000:]


def test_two_writers_keep_both_parts(spark, cached):
    _, place, calls, table = cached
    slow = FeatureCache(spark, place)
    before = slow.latest()
    assert table([FOLDS[0]])[0] == {1: 4}
    before.parts["theirs"] = {"fold": 7, "path": "data-x/part=7", "schema": "{}"}
    after = slow._publish(before)
    assert after.number == 2 and len(after.parts) == 2 and set(slow.latest().parts) == set(after.parts)
    assert table([FOLDS[0]])[0] == {1: 4} and calls == [[1]]


def test_unpublished_data_is_not_seen_and_can_be_cleared(spark, cached):
    _, place, calls, table = cached
    table()
    # As left by a writer that was lost before its manifest.
    spark.range(5).write.parquet(f"{place}/data-lost")
    assert table()[0] == {1: 4, 2: 4} and calls == [[1, 2]]
    moved = [replace(FOLDS[0], buy_to=date(2016, 1, 2))]
    _, cache = table(moved)
    keys = {k for k, p in cache.latest().parts.items() if p["fold"] == 1}
    cache.forget(keys)
    gone = cache.vacuum()
    assert "data-lost" in gone and len(gone) == 2
    assert table()[0] == {1: 4, 2: 4} and calls[2:] == [[1]]


def test_a_fold_without_rows_is_kept_too(spark, cached):
    _, _, calls, table = cached
    empty = replace(FOLDS[0], fold=3, recv_from=date(2030, 1, 1), recv_to=None, buy_from=date(2030, 1, 1), buy_to=None)
    assert table([FOLDS[0], empty])[0] == {1: 4}
    assert table([FOLDS[0], empty])[0] == {1: 4} and calls == [[1, 3]]


def test_which_files_a_fold_depends_on():
    one = FOLDS[0]
    assert depends(one, ["2016-03-31", "2016-05-01"], [None, None])
    assert depends(one, ["2016-02-01", "2016-02-20"], ["2016-02-28", "2016-03-01"])
    assert not depends(one, ["2016-02-01", "2016-02-20"], ["2016-03-01", "2016-03-09"])
    assert not depends(one, [None, None], [None, None])
    assert depends(replace(one, recv_from=None), ["2001-01-01", "2001-01-01"], [None, None])


