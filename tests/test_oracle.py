"""Every registered query with SQL against DuckDB on the same tables, as multisets of rows."""

from collections import Counter
from pathlib import Path

import duckdb
import pytest

import __spark_entry__ as entry
from foliant.plans.oracle import ORACLE_SQL
from foliant.plans.queries import QUERIES


@pytest.fixture(scope="module")
def duck(sf_dir):
    connection = duckdb.connect()
    for path in Path(sf_dir).glob("*.parquet"):
        connection.execute(f"CREATE VIEW {path.stem} AS SELECT * FROM '{path}'")
    return connection


def test_every_query_has_sql():
    assert set(QUERIES) == set(ORACLE_SQL)


def test_entry(spark):
    assert entry.entry(spark).count() == 200


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_matches_duckdb(spark, sf_dir, duck, name):
    found = QUERIES[name](spark, sf_dir)
    wanted = duck.sql(ORACLE_SQL[name])
    columns = sorted(found.columns)
    assert columns == sorted(wanted.columns)
    places = [wanted.columns.index(c) for c in columns]
    rows = Counter(repr([r[c] for c in columns]) for r in found.collect())
    assert rows == Counter(repr([r[i] for i in places]) for r in wanted.fetchall())
    assert rows
