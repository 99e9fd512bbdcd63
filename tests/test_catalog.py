"""Every query with an oracle, against DuckDB on the same tables."""

import glob
import math
from collections import Counter
from pathlib import Path

import duckdb
import pytest

import __spark_entry__ as entry

ORACLES = entry.oracle_sql()
QUERIES = entry.queries()


@pytest.fixture(scope="module")
def duck(tables):
    connection = duckdb.connect()
    for path in glob.glob(f"{tables}/*.parquet"):
        connection.execute(f"CREATE VIEW {Path(path).stem} AS SELECT * FROM '{path}'")
    return connection


def value(v):
    return "nan" if isinstance(v, float) and math.isnan(v) else v


def test_every_oracle_has_a_query():
    assert set(ORACLES) <= set(QUERIES)
    assert len(QUERIES) >= 116


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_matches_oracle(spark, duck, tables, name):
    df = QUERIES[name](spark, tables)
    result = duck.execute(ORACLES[name])
    names = [d[0] for d in result.description]
    assert sorted(df.columns) == sorted(names)
    expected = Counter(tuple(map(value, row)) for row in result.fetchall())
    found = Counter(tuple(map(value, row)) for row in df.select(*names).collect())
    assert found == expected


def test_flagship(spark):
    assert entry.entry(spark).count() == 1142
