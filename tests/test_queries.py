"""Every registered query against its SQL, on the smallest tables."""

from __future__ import annotations

import importlib
from pathlib import Path

import pytest

from workload import oracles
from workload import queries as workload_queries

duckdb = pytest.importorskip("duckdb")
entry_point = importlib.import_module("__spark_entry__")

FOLDER = Path("/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not FOLDER.exists(), reason="no test data")


@pytest.fixture(scope="module")
def database():
    connection = duckdb.connect()
    for file in sorted(FOLDER.glob("*.parquet")):
        connection.execute(f"create view {file.stem} as select * from '{file}'")
    return connection


def test_every_query_has_its_sql():
    assert set(workload_queries.queries()) == set(oracles.oracle_sql())
    assert set(entry_point.oracle_sql()) <= set(entry_point.queries())


@pytest.mark.parametrize("name", sorted(workload_queries.queries()))
def test_query(spark, database, name):
    result = entry_point.queries()[name](spark, str(FOLDER))
    columns = sorted(result.columns)
    expected = database.execute(entry_point.oracle_sql()[name])
    names = [column[0] for column in expected.description]
    assert sorted(names) == columns
    order = [names.index(column) for column in columns]
    found = [tuple(r) for r in result.select(*columns).collect()]
    assert sorted(found, key=repr) == sorted((tuple(row[i] for i in order) for row in expected.fetchall()), key=repr)


def test_entry(spark):
    result = entry_point.entry(spark)
    assert result.columns == ["node", "component"]
    assert result.count() == 380
    assert result.filter("node = component").count() == 125
