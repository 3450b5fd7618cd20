"""Every registered query against its SQL, on the smallest tables."""

import math
import sys
from collections import Counter
from pathlib import Path

import duckdb
import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

import __spark_entry__ as driver  # noqa: E402

SF = "/root/testdata/sf0.001"
QUERIES, SQL = driver.queries(), driver.oracle_sql()


@pytest.fixture(scope="module")
def duck():
    connection = duckdb.connect()
    for file in Path(SF).glob("*.parquet"):
        connection.execute(f"CREATE VIEW {file.stem} AS SELECT * FROM '{file}'")
    return connection


def _plain(value):
    if isinstance(value, float):
        return None if math.isnan(value) else value + 0.0
    return value


def test_every_sql_belongs_to_a_query():
    assert set(SQL) <= set(QUERIES)


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_equals_sql(spark, duck, name):
    ours = QUERIES[name](spark, SF)
    theirs = duck.execute(SQL[name])
    columns = [c[0] for c in theirs.description]
    assert sorted(columns) == sorted(ours.columns)
    got = Counter(tuple(map(_plain, r)) for r in ours.select(*[f"`{c}`" for c in columns]).collect())
    assert got == Counter(tuple(map(_plain, r)) for r in theirs.fetchall())


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(SQL)))
def test_query_without_sql(spark, name):
    first, second = (QUERIES[name](spark, SF) for _ in range(2))
    assert first.schema == second.schema
    assert first.count() > 0


def test_entry(spark):
    row = driver.entry(spark).first()
    live = QUERIES["stream_score"](spark, SF).filter("label IS NOT NULL")
    assert row.total_rows == live.count() and row.positive + row.negative == row.total_rows
    assert 0 <= row.accuracy <= 100
