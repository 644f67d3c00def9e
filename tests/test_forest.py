"""Spanning forests, and the certificate that needs one."""

from __future__ import annotations

import random
from collections import Counter

import pytest

import archipelago as ar
from archipelago.sources.round_tables import RoundTables
from archipelago.plans import certificate
from tests.model import components
from tests.test_components import SHAPES, edges_with_graph
from tests.test_updates import random_graphs

BY = ("graph",)
GRAPHS = SHAPES | {name: edges + batch for name, (edges, batch) in random_graphs(6).items()}


@pytest.fixture(scope="module")
def graph_edges(spark):
    return edges_with_graph(spark, GRAPHS)


@pytest.mark.parametrize("hot_rows", [None, 2])
def test_forest(spark, graph_edges, hot_rows):
    found: dict[str, list] = {name: [] for name in GRAPHS}
    for row in ar.spanning_forest(graph_edges, by=BY, hot_rows=hot_rows).collect():
        found[row.graph].append((row.src, row.dst, row.component))
    for name, edges in GRAPHS.items():
        forest, expected = found[name], components(edges)
        assert {(a, b) for a, b, _ in forest} <= set(edges)
        assert components([(a, b) for a, b, _ in forest]) == expected
        members = Counter(expected.values())
        assert Counter(c for _, _, c in forest) == {c: n - 1 for c, n in members.items()}
        assert all(expected[a] == c for a, _, c in forest)


def test_forest_of_nothing(spark, edges_of):
    assert ar.spanning_forest(edges_of([])).columns == ["src", "dst", "component"]
    assert ar.spanning_forest(edges_of([(3, 3), (None, 1)])).count() == 0
    with pytest.raises(RuntimeError, match="after 1 rounds"):
        ar.spanning_forest(edges_of([(n, (n * 7 + 1) % 50) for n in range(50)]), max_rounds=1)


def test_only_the_forest_is_left(spark, edges_of, tmp_path):
    tables = ar.RoundTables(spark, str(tmp_path))
    ar.spanning_forest(edges_of(SHAPES["path_down_up"]), tables=tables).collect()
    import os

    assert [name.split("-", 1)[1] for name in os.listdir(tables.folder) if not name.startswith("archipelago")] == ["forest"]


def offences(spark, edges, assignments, forest):
    pairs = spark.createDataFrame(edges, "src bigint, dst bigint")
    rows = spark.createDataFrame(assignments, "node bigint, component bigint")
    chosen = spark.createDataFrame(forest, "src bigint, dst bigint")
    return {tuple(r) for r in ar.offences(rows, pairs, chosen).collect()}


EDGES = [(1, 2), (2, 3), (3, 1), (5, 6), (7, 8), (8, 9)]
RIGHT = [(1, 1), (2, 1), (3, 1), (5, 5), (6, 5), (7, 7), (8, 7), (9, 7)]
FOREST = [(1, 2), (3, 2), (5, 6), (8, 7), (8, 9)]


def test_right_tables_pass(spark):
    assert offences(spark, EDGES, RIGHT, FOREST) == set()
    assert offences(spark, EDGES, [*RIGHT, (20, 20)], FOREST) == set()
    assert offences(spark, [], [], []) == set()


@pytest.mark.parametrize(
    ("assignments", "forest", "expected"),
    [
        # A lost row, and a row that is there twice.
        ([r for r in RIGHT if r[0] != 6], FOREST, {(certificate.MISSING, 6, None)}),
        ([*RIGHT, (6, 5)], FOREST, {(certificate.REPEATED, 6, 5)}),
        ([*RIGHT, (None, 5), (4, None)], FOREST, {(certificate.REPEATED, None, 5), (certificate.REPEATED, 4, None)}),
        # A node with a label of its own.
        ([(n, 9 if n == 9 else c) for n, c in RIGHT], FOREST,
         {(certificate.ACROSS, 9, 8), (certificate.NOT_REACHED, 9, 9)}),
        # A whole component with a wrong label.
        ([(n, 6 if c == 5 else c) for n, c in RIGHT], FOREST,
         {(certificate.NOT_SMALLEST, 5, 6), (certificate.NOT_SMALLEST, 6, 6), (certificate.NOT_REACHED, 5, 6), (certificate.NOT_REACHED, 6, 6)}),
        # Two components with one label: only the forest shows it.
        ([(n, 1 if c == 5 else c) for n, c in RIGHT], FOREST, {(certificate.NOT_REACHED, 5, 1), (certificate.NOT_REACHED, 6, 1)}),
        # The same with an edge in the forest that is none.
        ([(n, 1 if c == 5 else c) for n, c in RIGHT], [*FOREST, (3, 5)],
         {(certificate.NO_EDGE, 5, 3), (certificate.NOT_REACHED, 5, 1), (certificate.NOT_REACHED, 6, 1)}),
        # A forest that lost an edge proves less.
        (RIGHT, FOREST[:-1], {(certificate.NOT_REACHED, 9, 7)}),
        # A node that no edge touches can't have another's label.
        ([*RIGHT, (20, 1)], FOREST, {(certificate.NOT_REACHED, 20, 1)}),
    ],
)
def test_damaged_tables(spark, assignments, forest, expected):
    assert offences(spark, EDGES, assignments, forest) == expected


def test_several_graphs(spark, graph_edges):
    assignments = ar.connected_components(graph_edges, by=BY)
    forest = ar.spanning_forest(graph_edges, by=BY)
    assert ar.offences(assignments, graph_edges, forest, by=BY).count() == 0
    assert ar.offences(assignments, graph_edges, forest, by=BY, hot_rows=2).count() == 0
    damaged = assignments.withColumn("component", assignments["node"])
    wrong = {(r.graph, r.node) for r in ar.offences(damaged, graph_edges, forest, by=BY).filter(f"reason = '{certificate.NOT_REACHED}'").collect()}
    assert wrong == {(name, n) for name, edges in GRAPHS.items() for n, c in components(edges).items() if n != c}


def kruskal(edges):
    """The edges of the minimum spanning forest in the order (weight, src, dst)."""
    leader = {}

    def find(node):
        while leader.setdefault(node, node) != node:
            node = leader[node]
        return node

    chosen = set()
    for weight, a, b in sorted((w, a, b) for a, b, w in edges if a != b and w is not None and a is not None and b is not None):
        one, two = find(a), find(b)
        if one != two:
            leader[one] = two
            chosen.add((a, b, weight))
    return chosen


def weighted(seed):
    draw = random.Random(seed)
    graphs = {name: [(a, b, draw.randint(0, 4)) for a, b in edges] for name, edges in GRAPHS.items()}
    graphs["parallel"] = [(1, 2, 3), (2, 1, 1), (1, 2, 1), (1, 2, 2), (2, 3, 0), (3, 2, 0), (3, 3, -1), (4, 5, None), (None, 1, 0)]
    graphs["same"] = [(a, b, 1) for a in range(9) for b in range(a)]
    return graphs


@pytest.mark.parametrize("hot_rows", [None, 2])
def test_minimum_spanning_forest(spark, hot_rows):
    graphs = weighted(11)
    rows = [(name, *edge) for name, edges in graphs.items() for edge in edges]
    edges = spark.createDataFrame(rows, "graph string, src bigint, dst bigint, weight int")
    found: dict[str, set] = {name: set() for name in graphs}
    for row in ar.minimum_spanning_forest(edges, by=BY, hot_rows=hot_rows).collect():
        found[row.graph].add((row.src, row.dst, row.weight))
    assert found == {name: kruskal(given) for name, given in graphs.items()}


def test_single_linkage(spark):
    graphs = weighted(12)
    rows = [(name, *edge) for name, edges in graphs.items() for edge in edges]
    edges = spark.createDataFrame(rows, "graph string, src bigint, dst bigint, weight int")
    found = {(r.graph, r.cutoff, r.node): r.component for r in ar.single_linkage(edges, [3, 0, 1, 1], by=BY).collect()}
    expected = {}
    for name, given in graphs.items():
        for cutoff in (0, 1, 3):
            part = [(a, b) for a, b, w in given if w is not None and a is not None and w <= cutoff]
            expected |= {(name, cutoff, n): c for n, c in components(part).items()}
    assert found == expected
    with pytest.raises(ValueError, match="cut-offs"):
        ar.single_linkage(edges, [], by=BY)


def test_rounds_hash_their_aggregates(edges_of):
    """A minimum of structs would sort all edges."""
    from archipelago.plans.forest import witnessed_pairs, witnessed_pointers

    pairs = witnessed_pairs(edges_of([(5, 2), (2, 5), (7, 5), (7, 2)]))
    assert sorted(tuple(row) for row in pairs.collect()) == [(5, 2, 2, 5), (7, 2, 7, 2), (7, 5, 7, 5)]
    pointers = witnessed_pointers(pairs)
    assert sorted(tuple(row) for row in pointers.collect()) == [(5, 2, 2, 5), (7, 2, 7, 2)]
    for frame in (pairs, pointers):
        assert "SortAggregate" not in frame._jdf.queryExecution().executedPlan().toString()


def test_linkage_rounds_carry_places(spark, tmp_path, monkeypatch):
    """Edges are numbered in their order once, and shuffled with their number alone."""
    columns = {}
    write = RoundTables.write

    def noted(self, df, name, *args, **sums):
        columns.setdefault(name, df.columns)
        return write(self, df, name, *args, **sums)

    monkeypatch.setattr(RoundTables, "write", noted)
    edges = [(1, 2, 3), (2, 1, 3), (3, 2, 3), (1, 3, 3), (3, 4, None), (5, 4, 1), (4, 1, 9), (5, 1, 9)]
    given = spark.createDataFrame(edges, "src bigint, dst bigint, weight int")
    forest = ar.minimum_spanning_forest(given, tables=RoundTables(spark, str(tmp_path)))
    assert sorted(tuple(row) for row in forest.collect()) == [(1, 2, 3), (1, 3, 3), (4, 1, 9), (5, 4, 1)]
    assert columns["pairs"] == ["node", "component", "place"]
