"""Connected components: known shapes, properties on random graphs, skew, checkpoints and plans."""

from __future__ import annotations

import os
import random

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

import archipelago as ar
from archipelago.plans import contract, contraction
from archipelago.sources import round_tables
from tests.goldens import TOY
from tests.model import components, counts

SHAPES = {
    "toy": TOY,
    "reciprocal": [*TOY, (2, 1), (2, 4)],
    "self_loops": [*TOY, (3, 3), (1, 1), (9, 9)],
    "path": [(n, n + 1) for n in range(1, 64)],
    "path_down_up": [(n * 37 % 64, (n + 1) * 37 % 64) for n in range(63)],
    "star_low": [(1, n) for n in range(2, 17)],
    "star_high": [(n, 17) for n in range(1, 17)],
    "clique": [(a, b) for a in range(8) for b in range(a)],
    "cycle": [(n, n % 10 + 1) for n in range(1, 11)],
    "negatives": [(-3, 0), (0, 7)],
    "wide_ids": [(2**62, -(2**62)), (2**62, 3_000_000_000)],
    "only_a_self_loop": [(5, 5)],
}
# New pairs per step, self-loops dropped first.
COUNTS = {
    "toy": [4, 9, 4, 0],
    "reciprocal": [4, 9, 4, 0],
    "self_loops": [4, 9, 4, 0],
    "path": [62, 185, 423, 865, 1609, 2529, 2082, 0],
    "star_low": [0],
    "star_high": [15, 0],
    "clique": [42, 0],
    "cycle": [9, 23, 39, 16, 0],
    "negatives": [1, 2, 0],
    "only_a_self_loop": [0],
}
METHODS = [("auto", "join"), ("contract", "join"), ("ccf", "join"), ("ccf", "array")]


def labelled(df):
    rows = df.collect()
    result = {tuple(row)[:-1]: row.component for row in rows}
    assert len(result) == len(rows), "a node has more than one component"
    return result


def edges_with_graph(spark, graphs):
    rows = [(name, a, b) for name, edges in graphs.items() for a, b in edges]
    return spark.createDataFrame(rows, "graph string, src bigint, dst bigint")


def expected_of(graphs):
    return {(name, node): c for name, edges in graphs.items() for node, c in components(edges).items()}


@pytest.mark.parametrize(("method", "form"), METHODS)
def test_all_shapes_in_one_job(spark, method, form):
    result = ar.connected_components(edges_with_graph(spark, SHAPES), method=method, form=form, by=["graph"])
    assert labelled(result) == expected_of(SHAPES)


@pytest.mark.parametrize("method", ["auto", "contract", "ccf"])
def test_single_graph_and_roots(edges_of, method):
    with_roots = ar.connected_components(edges_of(TOY), method=method)
    assert with_roots.dtypes == [("node", "bigint"), ("component", "bigint")]
    assert labelled(with_roots) == {(n,): c for n, c in components(TOY).items()}
    pairs = ar.connected_components(edges_of(TOY), include_roots=False, method=method)
    assert labelled(pairs) == {(n,): c for n, c in components(TOY).items() if n != c}


@pytest.mark.parametrize("shape", sorted(COUNTS))
def test_known_counts(shape):
    loop_free = [(a, b) for a, b in SHAPES[shape] if a != b]
    assert counts(loop_free) == COUNTS[shape]


@pytest.mark.parametrize("shape", ["self_loops", "star_high", "cycle", "only_a_self_loop"])
def test_iteration_log(edges_of, shape):
    log = ar.iteration_log(edges_of(SHAPES[shape])).orderBy("iteration").collect()
    assert [row.iteration for row in log] == list(range(1, len(log) + 1))
    assert [row.new_pairs for row in log] == COUNTS[shape]
    nodes = components(SHAPES[shape])
    assert log[-1].pairs == sum(node != c for node, c in nodes.items())


@pytest.mark.parametrize("method", ["auto", "contract", "ccf"])
def test_empty_graph(edges_of, method):
    result = ar.connected_components(edges_of([]), method=method)
    assert result.collect() == []
    assert ar.component_count(result).first()[0] == 0


def test_vertices_without_edges(spark, edges_of):
    vertices = spark.createDataFrame([(1,), (2,), (2,), (99,), (-1,), (None,)], "node bigint")
    result = ar.connected_components(edges_of(TOY), vertices=vertices)
    alone = {(99,): 99, (-1,): -1}
    assert labelled(result) == {(n,): c for n, c in components(TOY).items()} | alone
    assert ar.component_count(result).first()[0] == 4


def random_graphs(seed, n):
    pick = random.Random(seed)
    graphs = {}
    for number in range(n):
        nodes = pick.choice([5, 20, 60])
        edges = pick.randint(1, 2 * nodes)
        graphs[f"g{number}"] = [(pick.randint(-nodes, nodes), pick.randint(-nodes, nodes)) for _ in range(edges)]
    return graphs


def test_few_moving_pointers_in_a_large_forest(spark, hot_nodes):
    # 600 stars and one chain: after the first pass only the chain's pointers move on.
    stars = [(10_000 + 10 * n, 10_000 + 10 * n + m) for n in range(600) for m in range(1, 4)]
    edges = stars + [(n, n + 1) for n in range(20)]
    result = ar.connected_components(spark.createDataFrame(edges, "src bigint, dst bigint"), method="contract")
    assert labelled(result) == {(n,): c for n, c in components(edges).items()}


@pytest.mark.parametrize(("method", "form"), METHODS)
def test_many_random_graphs(spark, method, form):
    graphs = random_graphs(7, 60)
    result = ar.connected_components(edges_with_graph(spark, graphs), method=method, form=form, by=["graph"])
    assert labelled(result) == expected_of(graphs)


@pytest.mark.parametrize(("method", "form"), METHODS)
def test_hot_nodes(spark, hot_nodes, method, form):
    graphs = random_graphs(8, 20) | {"hub": [(0, n) for n in range(1, 200)], "high": [(n, 500) for n in range(200)]}
    result = ar.connected_components(edges_with_graph(spark, graphs), method=method, form=form, by=["graph"])
    assert labelled(result) == expected_of(graphs)


def test_one_way_at_every_size(spark, monkeypatch):
    monkeypatch.setattr(contraction, "RoundTables", SeenPlans)
    monkeypatch.setattr(SeenPlans, "temporary", lambda self: SeenPlans(self._spark, self.folder))
    SeenPlans.seen = []
    assert ar.connected_components(edges_with_graph(spark, random_graphs(12, 15)), by=["graph"]).count()
    kinds = {name for name, _ in SeenPlans.seen}
    assert "pointers" in kinds and "step" not in kinds


def test_order_direction_duplicates_and_loops_do_not_matter(spark):
    graphs = random_graphs(9, 15)
    pick = random.Random(10)
    changed = {}
    for name, edges in graphs.items():
        more = [(b, a) if pick.random() < 0.5 else (a, b) for a, b in edges] + edges[:3]
        more += [(a, a) for a, _ in edges if pick.random() < 0.3]
        pick.shuffle(more)
        changed[name] = more
    assert labelled(
        ar.connected_components(edges_with_graph(spark, changed), by=["graph"])
    ) == expected_of(graphs)


def test_order_preserving_relabel(spark):
    graphs = random_graphs(11, 10)
    moved = {name: [(3 * a + 1, 3 * b + 1) for a, b in edges] for name, edges in graphs.items()}
    result = labelled(ar.connected_components(edges_with_graph(spark, moved), by=["graph"]))
    assert result == {(g, 3 * n + 1): 3 * c + 1 for (g, n), c in expected_of(graphs).items()}


@settings(max_examples=5, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.tuples(st.integers(-12, 12), st.integers(-12, 12)), max_size=30))
def test_generated_graphs(spark, edges):
    df = spark.createDataFrame(edges, "src bigint, dst bigint")
    result = labelled(ar.connected_components(df))
    assert result == {(n,): c for n, c in components(edges).items()}
    assert all(c <= n for (n,), c in result.items())


def test_a_long_path_takes_few_rounds(spark):
    path = spark.range(2000).selectExpr("id as src", "id + 1 as dst")
    result = contract(path, max_rounds=1)
    assert result.count() == 2000
    assert result.filter("component <> 0").count() == 0


@pytest.mark.parametrize("method", ["contract", "ccf"])
def test_too_many_rounds_raise(edges_of, method):
    # A path that needs more than one round either way.
    edges = edges_of(SHAPES["path_down_up"])
    with pytest.raises(RuntimeError, match="after 1"):
        ar.connected_components(edges, method=method, max_rounds=1)


@pytest.mark.parametrize("method", ["contract", "ccf"])
def test_no_rounds_at_all(edges_of, method):
    with pytest.raises((RuntimeError, ValueError), match="round"):
        ar.connected_components(edges_of(TOY), method=method, max_rounds=0)


def test_no_graphs():
    with pytest.raises(ValueError, match="no graphs"):
        ar.multi_graph({})


def test_unknown_method(edges_of):
    with pytest.raises(ValueError):
        ar.connected_components(edges_of(TOY), method="other")


def test_counts_and_sizes(spark):
    graphs = {name: SHAPES[name] for name in ("toy", "clique", "self_loops")}
    frames = {name: spark.createDataFrame(edges, "src bigint, dst bigint") for name, edges in graphs.items()}
    counted = {row.graph: row.components for row in ar.multi_graph_counts(frames).collect()}
    assert counted == {"toy": 2, "clique": 1, "self_loops": 2}
    toy = ar.connected_components(frames["toy"])
    assert {(r.component, r.members) for r in ar.component_sizes(toy).collect()} == {(1, 5), (6, 3)}
    pairs = ar.connected_components(frames["toy"], include_roots=False)
    assert ar.component_count(pairs).collect() == ar.component_count(toy).collect()


class SeenPlans(round_tables.RoundTables):
    seen: list[tuple[str, int]] = []

    def write(self, df, name, **sums):
        plan = df._jdf.queryExecution().optimizedPlan().toString()
        self.seen.append((name, plan.count("Relation [")))
        return super().write(df, name, **sums)


def test_plans_do_not_grow(spark, monkeypatch):
    from archipelago.plans import ccf_rounds

    SeenPlans.seen = []
    monkeypatch.setattr(ccf_rounds, "RoundTables", SeenPlans)
    monkeypatch.setattr(SeenPlans, "temporary", lambda self: SeenPlans(self._spark, self.folder))
    ar.run_ccf(spark.range(1, 64).selectExpr("id as src", "id + 1 as dst"))
    leaves = [n for name, n in SeenPlans.seen if name == "step"]
    assert len(leaves) == 8
    assert len(set(leaves)) == 1


def test_contraction_plans_do_not_grow(spark, monkeypatch):
    SeenPlans.seen = []
    monkeypatch.setattr(contraction, "RoundTables", SeenPlans)
    monkeypatch.setattr(SeenPlans, "temporary", lambda self: SeenPlans(self._spark, self.folder))
    pick = random.Random(3)
    order = list(range(400))
    pick.shuffle(order)
    path = list(zip(order, order[1:]))
    result = contract(spark.createDataFrame(path, "src bigint, dst bigint"))
    assert result.count() == 399
    assert len([name for name, _ in SeenPlans.seen if name == "pairs"]) >= 3
    assert max(n for _, n in SeenPlans.seen) <= 30


@pytest.mark.parametrize("method", ["auto", "ccf"])
@pytest.mark.parametrize("shape", ["cycle", "path_down_up", "only_a_self_loop", "star_high"])
def test_only_what_the_result_reads_is_kept(spark, edges_of, tmp_path, method, shape):
    with round_tables.RoundTables(spark, str(tmp_path)) as tables:
        result = ar.connected_components(edges_of(SHAPES[shape]), method=method, tables=tables, hot_rows=3)
        assert [d.split("-", 1)[1] for d in os.listdir(tables.folder)] == ["components"]
        assert labelled(result) == {(n,): c for n, c in components(SHAPES[shape]).items()}
    assert os.listdir(tmp_path) == []


@pytest.mark.parametrize("method", ["auto", "ccf"])
def test_nothing_is_left_by_a_run_that_raises(spark, edges_of, tmp_path, method):
    tables = round_tables.RoundTables(spark, str(tmp_path))
    with pytest.raises(RuntimeError):
        ar.connected_components(edges_of(SHAPES["path_down_up"]), method=method, max_rounds=1, tables=tables)
    assert os.listdir(tables.folder) == []


class FakeSession:
    """A session without a checkpoint folder."""

    def __init__(self, master):
        self.sparkContext = self
        self.conf = self
        self.master = master
        self.folder = None

    def get(self, name, default):
        return default

    def getCheckpointDir(self):
        return self.folder

    def setCheckpointDir(self, folder):
        self.folder = folder


def test_round_tables_need_a_shared_folder_on_a_cluster():
    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        round_tables.shared_folder(FakeSession("yarn"))


def test_local_mode_gets_a_folder_of_its_own():
    local = FakeSession("local[2]")
    folder = round_tables.shared_folder(local)
    assert os.path.isdir(folder)
    assert round_tables.shared_folder(local) == folder


def test_the_sessions_folder_is_used(spark):
    named = spark.conf.get("spark.checkpoint.dir")
    assert round_tables.RoundTables(spark).folder.startswith(f"{named}/archipelago-")


def test_written_sums(spark):
    tables = round_tables.RoundTables(spark)
    from pyspark.sql import functions as F

    table = tables.write(spark.range(100).repartition(7), "numbers", even=F.count_if(F.col("id") % 2 == 0))
    assert (table.rows, table.sums) == (100, {"even": 50})
    empty = tables.write(spark.range(100).filter("id > 100"), "none", total=F.coalesce(F.sum("id"), F.lit(0)))
    assert (empty.rows, empty.sums) == (0, {"total": 0})
    assert empty.df.collect() == []
