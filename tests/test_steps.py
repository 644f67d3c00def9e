"""The single steps, on a toy graph with known results and against plain Python models."""

from __future__ import annotations

import os
import random
import re

import pytest
from pyspark.sql import functions as F

import archipelago as ar
from archipelago.operators import as_edges, emitted_pairs, lookup
from archipelago.operators.ccf import crowded
from archipelago.sources import RoundTables
from tests.goldens import FIRST, LAST, SECOND, TOY
from tests.model import counts, step


def rows(df):
    return sorted(tuple(row) for row in df.collect())


def random_edges(seed, nodes, edges):
    pick = random.Random(seed)
    return [(pick.randint(-nodes, nodes), pick.randint(-nodes, nodes)) for _ in range(edges)]


def test_symmetrize_keeps_duplicates(edges_of):
    both = ar.symmetrize(edges_of([*TOY, (1, 2)]))
    assert rows(both) == sorted([*TOY, (1, 2)] + [(b, a) for a, b in [*TOY, (1, 2)]])


def test_normalise(edges_of):
    messy = edges_of([(1, 2), (2, 1), (1, 2), (3, 3), (-5, 4), (None, 1), (1, None)])
    assert rows(ar.normalise(messy)) == [(2, 1), (4, -5)]


def test_neighbour_min(edges_of):
    smallest = ar.neighbour_min(ar.symmetrize(edges_of(TOY)))
    assert rows(smallest) == [(1, 1), (2, 1), (3, 2), (4, 2), (5, 4), (6, 6), (7, 6), (8, 7)]


@pytest.mark.parametrize("form", ["join", "array"])
def test_toy_steps(edges_of, form):
    first = ar.ccf_step(ar.normalise(edges_of(TOY)), form=form)
    assert set(rows(first)) == FIRST
    second = ar.ccf_step(first, form=form)
    assert set(rows(second)) == SECOND
    third = ar.ccf_step(second, form=form)
    assert set(rows(third)) == LAST
    assert set(rows(ar.ccf_step(third, form=form))) == LAST


def test_toy_new_pairs(edges_of):
    pairs = ar.normalise(edges_of(TOY))
    seen = []
    for _ in range(4):
        seen.append(ar.new_pair_count(pairs).first()[0])
        pairs = ar.ccf_step(pairs)
    assert seen == [4, 9, 4, 0]


def test_new_pairs_of_an_empty_graph(edges_of):
    assert rows(ar.new_pair_count(ar.normalise(edges_of([(5, 5)])))) == [(0,)]


@pytest.mark.parametrize("form", ["join", "array"])
@pytest.mark.parametrize("shape", [(1, 30, 40), (2, 10, 60), (3, 100, 50)])
def test_step_equals_model(edges_of, form, shape):
    edges = random_edges(*shape)
    pairs = ar.normalise(edges_of(edges))
    expected, new = step(edges)
    emitted = emitted_pairs(pairs, form=form)
    assert emitted.agg(F.sum("fresh")).first()[0] == new == ar.new_pair_count(pairs).first()[0]
    assert set(rows(ar.ccf_step(pairs, form=form))) == expected


@pytest.mark.parametrize("form", ["join", "array"])
def test_step_with_hot_nodes(edges_of, hot_nodes, form):
    edges = [(1, n) for n in range(2, 40)] + [(n, 50) for n in range(30, 45)] + random_edges(4, 40, 60)
    expected, _ = step(edges)
    assert set(rows(ar.ccf_step(ar.normalise(edges_of(edges)), form=form))) == expected


HUBS = [(1, n) for n in range(2, 40)] + [(n, 50) for n in range(30, 45)] + random_edges(4, 40, 60)


def test_array_form_with_split_lists(edges_of):
    expected, new = step(HUBS)
    pairs = ar.normalise(edges_of(HUBS))
    assert set(rows(ar.ccf_step(pairs, form="array", list_length=5))) == expected
    emitted = emitted_pairs(pairs, form="array", list_length=5)
    assert emitted.agg(F.sum("fresh")).first()[0] == new


@pytest.mark.parametrize("form", ["join", "array"])
@pytest.mark.parametrize("ids", [(1, 2), (7, 40), (-3, 0)])
def test_many_equal_pairs(spark, form, ids):
    small, large = ids
    pairs = spark.range(100_002).select(F.lit(large).cast("bigint").alias("node"), F.lit(small).cast("bigint").alias("component"))
    assert rows(ar.ccf_step(pairs, form=form)) == [(large, small)]


def test_lists_do_not_depend_on_duplicates(spark):
    edges = spark.range(250_000).selectExpr("1L as src", "2L as dst")
    assert rows(ar.adjacency_lists(ar.symmetrize(edges))) == [(1, 0, [2]), (2, 0, [1])]


def test_steps_write_their_input_once(spark, edges_of, tmp_path):
    with RoundTables(spark, str(tmp_path)) as tables:
        result = ar.ccf_step(ar.normalise(edges_of(TOY)), tables=tables)
        assert set(rows(result)) == FIRST
        assert [d.split("-", 1)[1] for d in os.listdir(tables.folder)] == ["pairs"]
    assert os.listdir(tmp_path) == []


def test_unknown_form(edges_of):
    with pytest.raises(ValueError):
        ar.ccf_step(ar.normalise(edges_of(TOY)), form="other")


def test_adjacency_lists(edges_of):
    lists = ar.adjacency_lists(ar.symmetrize(edges_of([*TOY, (1, 2)])))
    assert rows(lists) == [
        (1, 0, [2]), (2, 0, [1, 3, 4]), (3, 0, [2]), (4, 0, [2, 5]),
        (5, 0, [4]), (6, 0, [7]), (7, 0, [6, 8]), (8, 0, [7]),
    ]


def test_long_adjacency_lists_are_split(edges_of):
    edges = [(0, n) for n in range(1, 101)]
    lists = ar.adjacency_lists(ar.symmetrize(edges_of(edges)), list_length=10).collect()
    hub = [row for row in lists if row.node == 0]
    assert len(hub) > 1
    assert len({row.part for row in hub}) == len(hub)
    assert max(len(row.neighbours) for row in hub) < 40
    assert sorted(n for row in hub for n in row.neighbours) == list(range(1, 101))
    assert sorted(row.node for row in lists if row.node) == list(range(1, 101))


def test_orientation(edges_of):
    pairs = ar.normalise(edges_of(TOY))
    assert ar.by_component(pairs).columns == ["component", "node"]
    assert as_edges(pairs).columns == ["src", "dst"]
    assert rows(ar.by_component(pairs)) == sorted(TOY)


def plan_of(frame):
    return frame._jdf.queryExecution().executedPlan().toString()


def test_step_without_links_needs_no_join(edges_of, hot_nodes):
    """All hang on the smallest node already, which the minima say."""
    star = ar.normalise(edges_of([(1, node) for node in range(2, 9)]))
    for form in ("join", "array"):
        emitted = emitted_pairs(star, form=form, total=7)
        assert "Join" not in plan_of(emitted) and "collect_list" not in plan_of(emitted)
        assert sorted(tuple(row) for row in emitted.collect()) == [(node, 1, 0) for node in range(2, 9)]


def test_lists_are_made_after_the_shuffle(edges_of):
    """Lists begun by each task would be shuffled, and grow in number with the tasks."""
    lists = plan_of(ar.adjacency_lists(ar.symmetrize(edges_of([(1, 2), (2, 3), (3, 4)]))))
    assert lists.index("partial_collect_list") < lists.index("Exchange")


def test_large_tables_are_hashed_where_partitions_fit(spark, edges_of):
    rows = edges_of([(1, 2), (2, 3)])
    table = edges_of([(1, 5)]).withColumnRenamed("dst", "value")

    def hinted(count):
        return "SHUFFLE_HASH" in lookup(rows, table, "src", total=2, table_rows=count)._jdf.queryExecution().logical().toString().upper()

    partitions = int(spark.conf.get("spark.sql.shuffle.partitions"))
    assert not hinted(None) and not hinted(1000)
    spark.conf.set("spark.archipelago.hashed.rows", 3_000_000)
    assert hinted(3_000_000 * partitions) and not hinted(3_000_000 * partitions + 1)
    spark.conf.unset("spark.archipelago.hashed.rows")
    both = sorted(tuple(row) for row in lookup(rows, table, "src", total=2, table_rows=3_000_000 // 2 * partitions).collect())
    assert both == [(1, 2, 5), (2, 3, None)]


class SeenSteps(RoundTables):
    """Keeps the names and plans of what is written."""

    plans: list[tuple[str, str]] = []

    def write(self, df, name, **how):
        self.plans.append((name, plan_of(df)))
        return super().write(df, name, **how)


@pytest.fixture
def seen_steps(monkeypatch):
    monkeypatch.setattr(SeenSteps, "temporary", lambda self: SeenSteps(self._spark, self.folder))
    SeenSteps.plans = []
    return SeenSteps


@pytest.mark.parametrize("form", ["join", "array"])
def test_a_step_shuffles_pairs_and_links_once(spark, edges_of, seen_steps, form):
    """By component the pairs and the minima, by node the links; the edges of both directions are not shuffled."""
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        ar.run_ccf(edges_of(TOY), form=form, tables=seen_steps(spark))
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    steps = [plan for name, plan in seen_steps.plans if name == "step"]
    assert steps
    for plan in steps:
        assert plan.count("Exchange hashpartitioning") == 3
        assert "inline" not in plan


@pytest.mark.parametrize("form", ["join", "array"])
@pytest.mark.parametrize("bytes_sent", [0, 1 << 20])
def test_large_steps_log_true_counts(spark, edges_of, hot_nodes, seen_steps, form, bytes_sent):
    """With crowded nodes, and with the minima of the centres shuffled or sent to every task."""
    spark.conf.set("spark.archipelago.broadcast.bytes", str(bytes_sent))
    high = [(n, 300) for n in range(100, 130)]
    edges = [(a, b) for a, b in HUBS + high if a != b]
    try:
        run = ar.run_ccf(edges_of(edges), form=form, tables=seen_steps(spark))
    finally:
        spark.conf.unset("spark.archipelago.broadcast.bytes")
    assert [new for _, new, _ in run.log] == counts(edges)
    names = {name for name, _ in seen_steps.plans}
    assert "crowded" in names and ("centres" in names) == (bytes_sent > 0)
    model = edges
    for _, new, pairs in run.log:
        model, expected = step(model)
        assert (new, pairs) == (expected, len(model))
    assert set(rows(run.pairs)) == set(model)


@pytest.mark.parametrize("groups", [1, 1 << 16])
def test_crowded_nodes_are_those_above_the_limit(spark, edges_of, monkeypatch, groups):
    from archipelago.operators import ccf

    monkeypatch.setattr(ccf, "GROUPS", groups)
    pairs = ar.normalise(edges_of([(0, n) for n in range(1, 31)] + [(n, 100) for n in range(1, 11)] + [(200, 201)]))
    tables = RoundTables(spark)
    found = crowded(tables, pairs, total=41, hot_rows=10)
    assert rows(found) == [(0, 30)]
    assert rows(crowded(tables, pairs, total=41, list_length=9)) == [(0, 30), (100, 10)]
    assert crowded(tables, pairs, total=41, hot_rows=30) is None
    assert crowded(tables, pairs, total=41, hot_rows=82) is None


def test_many_smaller_neighbours_are_held_in_parts(spark, edges_of, tmp_path):
    from archipelago.operators.ccf import hold

    pairs = ar.normalise(edges_of([(n, 500) for n in range(1, 101)] + [(1, 2)]))
    tables = RoundTables(spark, str(tmp_path))
    held = hold(tables, pairs, form="array", crowd=crowded(tables, pairs, total=101, list_length=10), list_length=10)
    assert (held.pairs, held.nodes) == (101, 2)
    assert sorted(tuple(row) for row in held.rows.select("node", "component", "smallest").collect()) == [
        (2, 1, 1), *[(500, n, 1) for n in range(1, 101)],
    ]
    assert rows(held.minima.select("node", "smallest")) == [(2, 1), (500, 1)]
    assert max(row.n for row in held.df.select(F.size("components").alias("n")).collect()) < 40


@pytest.mark.parametrize("form", ["join", "array"])
def test_equal_links_of_a_crowded_node_are_one_before_the_shuffle(spark, edges_of, hot_nodes, seen_steps, form):
    """All members of a hub have the same smaller neighbour, so each of them links the hub to it."""
    edges = [(50, node) for node in range(100, 160)] + [(1, node) for node in range(100, 160)]
    spark.conf.set("spark.archipelago.broadcast.bytes", "0")
    try:
        run = ar.run_ccf(edges_of(edges), form=form, tables=seen_steps(spark))
    finally:
        spark.conf.unset("spark.archipelago.broadcast.bytes")
    assert run.log[0] == (1, 60, 61)
    first = next(plan for name, plan in seen_steps.plans if name == "step")
    assert re.search(r"HashAggregate\(keys=\[node#\d+L?, component#\d+L?\], functions=\[partial_count", first)
