"""Added and removed edges against full runs, and the store that keeps the result."""

from __future__ import annotations

import random

import pytest

import archipelago as ar
from tests.model import components

BY = ("graph",)


def random_graphs(seed: int, count: int = 24):
    """Edges before and edges of a batch, many small graphs: sparse, dense, chains, stars, empty ones."""
    draw = random.Random(seed)
    graphs = {}
    for number in range(count):
        nodes, most = draw.randint(2, 40), draw.choice([0, 3, 20, 60])
        edges = [(draw.randint(-5, nodes), draw.randint(-5, nodes)) for _ in range(draw.randint(0, most))]
        batch = [(draw.randint(-5, nodes + 5), draw.randint(-5, nodes + 5)) for _ in range(draw.choice([0, 1, 4, 15]))]
        graphs[f"g{number}"] = (edges, batch)
    graphs["chain"] = ([(n, n + 1) for n in range(30) if n % 10], [(n, n + 1) for n in range(0, 30, 10)])
    graphs["star"] = ([(0, n) for n in range(1, 30)], [(0, 99), (50, 51), (5, 6)])
    return graphs


def frame(spark, graphs, which):
    rows = [(name, a, b) for name, given in graphs.items() for a, b in given[which]]
    return spark.createDataFrame([*rows, ("g0", None, 3)], "graph string, src bigint, dst bigint")


def labels(df):
    rows = df.collect()
    found = {(r.graph, r.node): r.component for r in rows}
    assert len(found) == len(rows)
    return found


def expected(graphs, edges_of):
    return {(name, n): c for name, given in graphs.items() for n, c in components(edges_of(*given)).items()}


def stored(spark, graphs, tmp_path, which=0):
    """The components of the edges before, read back from a file."""
    path = str(tmp_path / "stored")
    ar.write_assignments(ar.connected_components(frame(spark, graphs, which), by=BY), path)
    return ar.read_assignments(spark, path)


@pytest.fixture(params=["broadcast", "shuffle"])
def sides(request, spark):
    """Small sides are broadcast, or nothing is small and every key with more than three rows is hot."""
    if request.param == "shuffle":
        spark.conf.set("spark.archipelago.broadcast.bytes", "0")
        spark.conf.set("spark.archipelago.hot.rows", "3")
    yield
    spark.conf.unset("spark.archipelago.broadcast.bytes")
    spark.conf.unset("spark.archipelago.hot.rows")


@pytest.mark.parametrize("seed", [1, 2])
def test_added(spark, tmp_path, sides, seed):
    graphs = random_graphs(seed)
    before = stored(spark, graphs, tmp_path)
    update = ar.added_edges(before, frame(spark, graphs, 1), by=BY)
    assert labels(update.applied_to(before)) == expected(graphs, lambda edges, batch: edges + batch)


@pytest.mark.parametrize("with_forest", [False, True])
def test_removed(spark, tmp_path, sides, with_forest):
    graphs = {name: (edges + batch, batch, [e for e in edges if e not in batch and e[::-1] not in batch])
              for name, (edges, batch) in random_graphs(3).items()}
    before = stored(spark, graphs, tmp_path)
    forest = ar.spanning_forest(frame(spark, graphs, 0), by=BY) if with_forest else None
    update = ar.removed_edges(before, frame(spark, graphs, 2), frame(spark, graphs, 1), by=BY, forest=forest)
    assert labels(update.applied_to(before)) == expected(graphs, lambda every, batch, rest: rest)


def test_a_component_that_keeps_its_forest_stays(spark):
    """A cycle without one edge: nothing to compute if that edge isn't in the forest."""
    edges = [(1, 2), (2, 3), (3, 1), (7, 8)]
    given = spark.createDataFrame(edges, "src bigint, dst bigint")
    before, forest = ar.connected_components(given), ar.spanning_forest(given)
    chosen = {frozenset((r.src, r.dst)) for r in forest.collect()}
    (spare,) = [e for e in edges if frozenset(e) not in chosen]
    removed = spark.createDataFrame([spare], "src bigint, dst bigint")
    remaining = given.exceptAll(removed)
    assert ar.removed_edges(before, remaining, removed, forest=forest).touched.rows == 0
    update = ar.removed_edges(before, remaining, removed)
    assert [r.component for r in update.touched.df.collect()] == [1]


def test_isolated_nodes(spark):
    edges = spark.createDataFrame([(1, 2), (2, 3), (5, 6)], "src bigint, dst bigint")
    removed = spark.createDataFrame([(3, 2), (9, 10)], "src bigint, dst bigint")
    remaining = spark.createDataFrame([(1, 2), (5, 6)], "src bigint, dst bigint")
    before = ar.connected_components(edges)
    for keep, extra in ((False, set()), (True, {(3, 3)})):
        update = ar.removed_edges(before, remaining, removed, keep_isolated=keep)
        assert set(map(tuple, update.applied_to(before).collect())) == {(1, 1), (2, 1), (5, 5), (6, 5)} | extra


def test_untouched_rows_are_not_shuffled(spark, tmp_path):
    graphs = random_graphs(4)
    before = stored(spark, graphs, tmp_path)
    update = ar.added_edges(before, frame(spark, graphs, 1), by=BY)
    plan = update.applied_to(before)._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastExchange" in plan and "hashpartitioning" not in plan and "rangepartitioning" not in plan
    ids = update.rows.select("graph", "component").distinct().collect()
    assert len(ids) < before.select("graph", "component").distinct().count()


def test_empty_batches(spark, tmp_path):
    graphs = random_graphs(5)
    before = stored(spark, graphs, tmp_path)
    nothing = frame(spark, {}, 0)
    same = labels(before)
    assert labels(ar.added_edges(before, nothing, by=BY).applied_to(before)) == same
    assert labels(ar.removed_edges(before, frame(spark, graphs, 0), nothing, by=BY).applied_to(before)) == same
    first = ar.added_edges(before.limit(0), frame(spark, graphs, 0), by=BY).applied_to(before.limit(0))
    assert labels(first) == same


class TestStore:
    def folder_of(self, store, version):
        return sorted(name for name in store._folder(f"{store.path}/rows-{version}") if name.startswith("part="))

    def test_only_touched_parts_are_written(self, spark, tmp_path):
        edges = [(2 * n, 2 * n + 1) for n in range(200)]
        store = ar.AssignmentStore(spark, str(tmp_path / "store"))
        store.create(ar.connected_components(spark.createDataFrame(edges, "src bigint, dst bigint")), parts=32)
        added = [(1, 2), (7, 1000), (400, 401)]
        update = ar.added_edges(store.read(), spark.createDataFrame(added, "src bigint, dst bigint"))
        store.update(update.touched, update.rows)
        assert {r.node: r.component for r in store.read().collect()} == components(edges + added)
        # Components 0, 2 and 6 are in three parts at most, 400 in one more; 6 only gets a member.
        assert 0 < len(store.parts_of_last_update()) <= 4
        assert self.folder_of(store, 1) == sorted(f"part={p}" for p in store.parts_of_last_update())

    def test_many_updates(self, spark, tmp_path):
        draw = random.Random(8)
        store = ar.AssignmentStore(spark, str(tmp_path / "store"))
        edges = [(draw.randint(0, 60), draw.randint(0, 60)) for _ in range(10)]
        empty = spark.createDataFrame([], "node bigint, component bigint")
        store.create(empty, parts=8)
        assert store.read().count() == 0
        batches = [edges, [(1, 2)], [], [(draw.randint(0, 90), draw.randint(0, 90)) for _ in range(20)]]
        seen = []
        for batch in batches:
            seen += batch
            update = ar.added_edges(store.read(), spark.createDataFrame(batch, "src bigint, dst bigint"))
            store.update(update.touched, update.rows)
            assert {r.node: r.component for r in store.read().collect()} == components(seen)
        store.vacuum()
        assert {r.node: r.component for r in store.read().collect()} == components(seen)

    def test_a_lost_update_changes_nothing(self, spark, tmp_path, monkeypatch):
        edges = spark.createDataFrame([(1, 2), (3, 4)], "src bigint, dst bigint")
        store = ar.AssignmentStore(spark, str(tmp_path / "store"))
        store.create(ar.connected_components(edges), parts=4)
        before = set(map(tuple, store.read().collect()))
        update = ar.added_edges(store.read(), spark.createDataFrame([(2, 3)], "src bigint, dst bigint"))

        def lost(*_):
            raise RuntimeError("driver lost")

        with monkeypatch.context() as patch:
            patch.setattr(store, "_write_manifest", lost)
            with pytest.raises(RuntimeError, match="lost"):
                store.update(update.touched, update.rows)
        assert set(map(tuple, store.read().collect())) == before
        store.update(update.touched, update.rows)
        assert {r.component for r in store.read().collect()} == {1}
        with pytest.raises(FileExistsError):
            store.create(store.read())
        with pytest.raises(FileNotFoundError):
            ar.AssignmentStore(spark, str(tmp_path / "nowhere")).read()
