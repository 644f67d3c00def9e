"""The skew-safe join gives what the plain join gives."""

from __future__ import annotations

import pytest

from archipelago.operators import lookup
from archipelago.operators.lookup import HOT_ROWS, hot_keys, hot_limit


def collected(df):
    columns = sorted(df.columns)
    return sorted(df.select(*columns).collect(), key=str)


@pytest.fixture
def tables(spark):
    # Key 1 holds a third of the rows and is in the table; key 2 holds another third and is not.
    keys = [1] * 50 + [2] * 50 + list(range(3, 53))
    rows = spark.createDataFrame([("g" if n % 2 else "h", k, n) for n, k in enumerate(keys)], "g string, k int, n int")
    table = spark.createDataFrame([(g, k, k * 10) for g in "gh" for k in range(1, 30) if k != 2], "g string, k int, v int")
    return rows, table


@pytest.mark.parametrize("how", ["left", "inner"])
def test_hot_keys_change_nothing(spark, tables, hot_nodes, how):
    rows, table = tables
    assert collected(lookup(rows, table, "k", ["g"], how)) == collected(rows.join(table, ["g", "k"], how))


def test_rows_of_a_hot_key_are_spread(spark, hot_nodes):
    rows = spark.range(1000).selectExpr("1 as k", "id as n")
    table = spark.createDataFrame([(1, 10), (2, 20)], "k int, v int")
    joined = lookup(rows, table, "k", total=1000)
    assert "_part" in joined._jdf.queryExecution().optimizedPlan().toString()
    assert collected(joined) == collected(rows.join(table, "k"))


def test_plain_join_where_no_key_can_be_hot(spark, tables, hot_nodes):
    rows, table = tables
    assert "_part" not in lookup(rows, table, "k", ["g"], total=3)._jdf.queryExecution().optimizedPlan().toString()


def test_the_limit_is_an_argument_or_a_setting(spark, hot_nodes):
    assert hot_limit(spark) == 3
    assert hot_limit(spark, 10) == 10
    spark.conf.unset(HOT_ROWS[0])
    assert hot_limit(spark) == HOT_ROWS[1]


def test_hot_keys_are_those_above_the_limit(spark):
    key = "case when id < 3000 then 1 when id < 4000 then 2 else id end as k"
    rows = spark.range(5000).selectExpr(key, "id as n")
    assert [tuple(row) for row in hot_keys(rows, ["k"], 1000).collect()] == [(1, 3)]


def test_nothing_runs_before_the_result_is_asked_for(spark, tables):
    rows, table = tables
    spark.sparkContext.setJobGroup("lookup", "")
    lookup(rows, table, "k", ["g"], hot_rows=3)
    assert list(spark.sparkContext.statusTracker().getJobIdsForGroup("lookup")) == []
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)


def test_join_with_many_hot_keys(spark):
    key = "case when id < 10000 then id % 7 else id end as k"
    rows = spark.range(15_000).selectExpr(key, "id as n")
    table = spark.range(0, 15_000, 2).selectExpr("id + 1 as k", "id as v")
    for how in ("left", "inner"):
        joined = lookup(rows, table, "k", how=how, hot_rows=500)
        plain = rows.join(table, "k", how)
        assert joined.exceptAll(plain).count() == 0
        assert joined.count() == plain.count()
