"""Edge files, edges from tables, and the assignment sink."""

from __future__ import annotations

import gzip
import os

import pytest
from pyspark.sql import functions as F

import archipelago as ar
from archipelago.sources import RoundTables
from tests.goldens import TOY

TOY_FILE = "# six undirected edges\n# of two components\n" + "".join(f"{a}\t{b}\n" for a, b in TOY)


def rows(df):
    return sorted(tuple(row) for row in df.collect())


def lines(spark, *values):
    return spark.createDataFrame([(v,) for v in values], "value string")


def test_toy_file(spark, tmp_path):
    (tmp_path / "toy.txt").write_text(TOY_FILE)
    path = str(tmp_path / "toy.txt")
    assert [r.value for r in ar.read_edge_lines(spark, path).limit(3).collect()] == ["# six undirected edges", "# of two components", "1\t2"]
    edges = ar.read_edge_file(spark, path, on_bad="fail")
    assert edges.dtypes == [("src", "bigint"), ("dst", "bigint")]
    assert rows(edges) == TOY
    assert rows(ar.component_count_from_file(spark, path)) == [(2,)]
    assert rows(ar.component_count_from_file(spark, path, method="ccf")) == [(2,)]


def test_several_and_compressed_files(spark, tmp_path):
    (tmp_path / "a.txt").write_text(TOY_FILE)
    with gzip.open(tmp_path / "b.txt.gz", "wt") as file:
        file.write("# more\n8\t9\n")
    edges = ar.read_edge_file(spark, [str(tmp_path / "a.txt"), str(tmp_path / "b.txt.gz")])
    assert rows(edges) == [*TOY, (8, 9)]


def test_paths_of_any_file_system(spark, tmp_path):
    """A path that only Spark's readers and writers can open."""
    (tmp_path / "toy.txt").write_text(TOY_FILE)
    configuration = spark.sparkContext._jsc.hadoopConfiguration()
    configuration.set("fs.viewfs.mounttable.graphs.link./in", f"file://{tmp_path}")
    edges = ar.read_edge_file(spark, "viewfs://graphs/in/toy.txt", on_bad="fail")
    assert rows(edges) == TOY
    with RoundTables(spark, "viewfs://graphs/in/rounds") as tables:
        assert ar.component_count(ar.connected_components(edges, tables=tables)).first()[0] == 2
        ar.write_assignments(ar.connected_components(edges, tables=tables), "viewfs://graphs/in/out")
    assert ar.read_assignments(spark, "viewfs://graphs/in/out").count() == 8


def test_windows_line_ends_and_comma_in_the_first_line(spark, tmp_path):
    (tmp_path / "w.txt").write_bytes(b"# a, b\r\n1\t2\r\n\r\n2\t3\r\n")
    assert rows(ar.read_edge_file(spark, str(tmp_path / "w.txt"), on_bad="fail")) == [(1, 2), (2, 3)]


@pytest.mark.parametrize(
    ("line", "edges"),
    [
        ("", []),
        ("   ", []),
        ("# a, b", []),
        ("#1\t2", []),
        ("2\t3\t9", [(2, 3)]),
        ("3000000000\t1", [(3_000_000_000, 1)]),
        ("1\t2\r", [(1, 2)]),
        ("-1\t-2", [(-1, -2)]),
        (" 1 \t 2 ", [(1, 2)]),
    ],
)
def test_accepted_lines(spark, line, edges):
    for on_bad in ("drop", "fail"):
        assert rows(ar.parse_edge_lines(lines(spark, line), on_bad)) == edges


@pytest.mark.parametrize("line", ["4", "x\t1", "1\tx", "5\t6#x", "5 # x\t6", "1 2", "1.5\t2", "99999999999999999999\t1"])
def test_bad_lines(spark, line):
    assert rows(ar.parse_edge_lines(lines(spark, line, "1\t2"))) == [(1, 2)]
    with pytest.raises(Exception, match="not an edge line"):
        ar.parse_edge_lines(lines(spark, line, "1\t2"), "fail").collect()


@pytest.mark.parametrize(
    "consume",
    [
        lambda edges: edges.count(),
        lambda edges: edges.select("src").collect(),
        lambda edges: edges.select("dst").collect(),
        lambda edges: edges.filter("src > 100").collect(),
        lambda edges: edges.agg(F.max("dst")).collect(),
    ],
)
def test_bad_lines_fail_whatever_is_read(spark, consume):
    with pytest.raises(Exception, match="not an edge line"):
        consume(ar.parse_edge_lines(lines(spark, "1\t2", "1\tx"), "fail"))


def test_on_bad_is_checked(spark):
    with pytest.raises(ValueError):
        ar.parse_edge_lines(lines(spark, ""), "ignore")


def test_edges_from_columns(spark):
    table = spark.createDataFrame([(1, 2), (None, 3), (4, None)], "a int, b bigint")
    edges = ar.edges_from_columns(table, "a", "b")
    assert edges.dtypes == [("src", "bigint"), ("dst", "bigint")]
    assert rows(edges) == [(1, 2)]


def test_two_kinds_of_ids_never_meet(spark):
    pairs = [(1, 2), (1_000_000_007, 9), (3, 7), (-4, -4), (2**62 - 1, -(2**62))]
    table = spark.createDataFrame(pairs, "a bigint, b bigint")
    edges = ar.edges_from_columns(table, "a", "b", two_kinds=True)
    assert ar.component_count(ar.connected_components(edges)).first()[0] == len(pairs)
    kind, own = ar.kind_and_id("src")
    assert sorted(r[1] for r in edges.select(kind, own).collect()) == sorted(a for a, _ in pairs)
    kind, own = ar.kind_and_id("dst")
    assert {(r[0], r[1]) for r in edges.select(kind, own).collect()} == {(1, b) for _, b in pairs}


@pytest.mark.parametrize("pair", [(2**62, 1), (1, 2**62), (-(2**62) - 1, 1)])
def test_ids_that_do_not_fit_fail(spark, pair):
    table = spark.createDataFrame([pair], "a bigint, b bigint")
    with pytest.raises(Exception, match="out of range"):
        ar.edges_from_columns(table, "a", "b", two_kinds=True).collect()


def shared_value_edges(held):
    groups = {}
    for node, value in held:
        if value is not None:
            groups.setdefault(value, set()).add(node)
    return sorted({(min(g), n) for g in groups.values() for n in g if n != min(g)})


HELD = [(n, "hot") for n in range(40, 5, -1)] + [(1, "a"), (2, "a"), (2, "a"), (3, "b"), (4, None), (5, None), (7, "c"), (6, "c")]


def test_edges_from_shared_value(spark):
    table = spark.createDataFrame(HELD, "id int, v string")
    assert rows(ar.edges_from_shared_value(table, "id", "v")) == shared_value_edges(HELD)
    upper = ar.edges_from_shared_value(table, "id", F.upper("v"))
    assert rows(upper) == shared_value_edges(HELD)


def test_edges_from_a_hot_value(spark):
    table = spark.createDataFrame(HELD * 3, "id int, v string")
    edges = ar.edges_from_shared_value(table, "id", "v", hot_rows=3)
    assert rows(edges) == shared_value_edges(HELD)


def test_holders_are_deleted(spark, tmp_path):
    table = spark.createDataFrame(HELD, "id int, v string")
    with RoundTables(spark, str(tmp_path)) as tables:
        edges = ar.edges_from_shared_value(table, "id", "v", tables=tables)
        assert [d.split("-", 1)[1] for d in os.listdir(tables.folder)] == ["shared-values"]
        assert edges.count() == len(shared_value_edges(HELD))
    assert os.listdir(tmp_path) == []


def test_write_and_read_assignments(spark, tmp_path):
    path = str(tmp_path / "out")
    assignments = spark.createDataFrame([(1, 1), (2, 1)], "node bigint, component bigint")
    ar.write_assignments(assignments, path)
    assert rows(ar.read_assignments(spark, path)) == [(1, 1), (2, 1)]
    with pytest.raises(Exception, match="already exists"):
        ar.write_assignments(assignments, path)
    ar.write_assignments(assignments.limit(1), path, mode="overwrite")
    assert ar.read_assignments(spark, path).count() == 1


def test_comment_filter_reaches_the_scan(spark, tmp_path):
    (tmp_path / "toy.txt").write_text(TOY_FILE)
    plan = ar.read_edge_file(spark, str(tmp_path / "toy.txt"))._jdf.queryExecution().toString()
    assert "Not(StringStartsWith(value,#))" in plan


def test_reports(spark):
    wide = spark.createDataFrame([("x", 1, 2), ("y", 3, 4)], "place string, first int, second int")
    long = ar.wide_to_long(wide, ["place"], ["first", "second"], {"variable": "attempt", "value": "points"})
    assert long.columns == ["place", "attempt", "points"]
    assert rows(long) == [("x", "first", 1), ("x", "second", 2), ("y", "first", 3), ("y", "second", 4)]
    assert [tuple(r) for r in ar.ordered_preview(wide, 1, "second").collect()] == [("x", 1, 2)]
    assert ar.ordered_preview(wide, 5).count() == 2


def test_separated_lines(spark, tmp_path):
    """Edges, quarantine and skipped lines are all lines, in one table."""
    lines = ["1\t2", "# 3\t4", "", "  ", "5", "x\t6", "7\ty", "8\t9\tmore", "\t", "10 11", "99999999999999999999\t1", "-1\t0\r"]
    (tmp_path / "edges.txt").write_text("\n".join(lines) + "\n")
    found = ar.separate_edge_lines(ar.read_edge_lines(spark, str(tmp_path / "edges.txt")))
    assert sorted(map(tuple, found.edges.collect())) == [(-1, 0), (1, 2), (8, 9)]
    rejected = {r.line: r.reason for r in found.rejected.collect()}
    assert rejected == {
        "5": "no second field", "10 11": "no second field", "x\t6": "first field is not an id",
        "99999999999999999999\t1": "first field is not an id", "7\ty": "second field is not an id", "\t": "first field is not an id",
    }
    assert all(r.file.endswith("edges.txt") for r in found.rejected.collect())
    assert (found.edge_count, found.rejected_count, found.skipped_count) == (3, 6, 3)
    plan = found.edges._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters" in plan and "line" not in plan.split("ReadSchema")[1]


def test_separated_lines_of_nothing(spark):
    found = ar.separate_edge_lines(spark.createDataFrame([], "value string"))
    assert found.edges.collect() == [] and found.rejected.collect() == []
    assert (found.edge_count, found.rejected_count, found.skipped_count) == (0, 0, 0)
    found = ar.separate_edge_lines(spark.createDataFrame([(None,), ("1\t2",)], "value string"))
    assert (found.edge_count, found.rejected_count, found.skipped_count) == (1, 0, 1)
