"""Connected components of an edge list."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from archipelago.operators import component_count, with_roots, with_vertices
from archipelago.plans.ccf_rounds import run_ccf
from archipelago.plans.contraction import contract
from archipelago.sources import read_edge_file
from archipelago.sources.round_tables import RoundTables

METHODS = ("auto", "contract", "ccf")


def connected_components(
    edges: DataFrame,
    vertices: DataFrame | None = None,
    include_roots: bool = True,
    method: str = "auto",
    by: Sequence[str] = (),
    form: str = "join",
    max_rounds: int = 100,
    hot_rows: int | None = None,
    tables: RoundTables | None = None,
) -> DataFrame:
    """Label every node with the smallest node id it can reach: ``node, component``.

    ``edges`` has ``src`` and ``dst`` (and the ``by`` columns, if several graphs run in one job);
    direction, duplicates and self-loops do not matter. Nodes without an edge appear if
    ``vertices`` (``node`` and the ``by`` columns) lists them. ``include_roots=False`` leaves out
    the rows of nodes that are their own component.

    ``method`` changes the way, not the result: ``"contract"`` contracts the graph, at every size, and is
    what ``"auto"`` takes; ``"ccf"`` repeats the CCF step (in the given ``form``, see
    :func:`archipelago.operators.emitted_pairs`). ``hot_rows`` is how many rows of one node a task
    should get at most (see :func:`archipelago.operators.lookup`).

    The rounds run at once. The returned DataFrame reads one table of ``tables``, by default of a
    new :class:`RoundTables`; pass your own to name its folder or to delete it after use.
    """
    if method not in METHODS:
        raise ValueError(f"method must be one of {METHODS}, not {method!r}")
    if method == "ccf":
        pairs = run_ccf(edges, by, form, max_rounds, hot_rows, tables).pairs
    else:
        pairs = contract(edges, by, max_rounds, hot_rows, tables)
    if not include_roots:
        return pairs
    assignments = with_roots(pairs, by)
    return assignments if vertices is None else with_vertices(assignments, vertices, by)


def component_count_from_file(
    spark: SparkSession, path: str | list[str], on_bad: str = "drop", **options: object
) -> DataFrame:
    """One row, ``components``: read an edge file and count its connected components."""
    return component_count(connected_components(read_edge_file(spark, path, on_bad), **options))


def multi_graph(graphs: Mapping[str, DataFrame]) -> DataFrame:
    """The edges of several graphs in one DataFrame, told apart by the column ``graph``."""
    if not graphs:
        raise ValueError("no graphs given")
    named = [edges.select(F.lit(name).alias("graph"), "src", "dst") for name, edges in graphs.items()]
    first, *others = named
    for edges in others:
        first = first.unionByName(edges)
    return first


def multi_graph_counts(graphs: Mapping[str, DataFrame], **options: object) -> DataFrame:
    """``graph, components`` for several graphs, all labelled in the same rounds."""
    by = ("graph",)
    return component_count(connected_components(multi_graph(graphs), by=by, **options), by)
