"""Connected components by contraction: the same result as the CCF steps, for graphs of any shape.

CCF keeps linking nodes to ever smaller ids, and on a long chain its pairs grow to the square of
the chain's length. Here the graph shrinks instead. A round has two parts:

1. Every node with a smaller neighbour points to its smallest one. The pointers form trees, whose
   roots are the nodes without a smaller neighbour. Pointer doubling flattens the trees.
2. Both ends of every edge are replaced by their roots, and edges inside a tree disappear.

A node left after two rounds was a local minimum both times, and there can be at most half as many
of those as there were nodes: so rounds are logarithmic, and the work of all rounds together is a
small multiple of the first one's. The smallest node of a component is a root in every round, so it
is the one that remains.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from archipelago.operators import lookup, normalise
from archipelago.sources.round_tables import RoundTables


@dataclass(frozen=True)
class Flat:
    """Pointers to roots, and how many there are."""

    pointers: DataFrame
    rows: int


def pointers(pairs: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """``node, parent``: each node that has a smaller neighbour, with its smallest one."""
    return pairs.groupBy(*by, "node").agg(F.min("component").alias("parent"))


def double_pointers(
    moving: DataFrame,
    ahead: DataFrame,
    by: Sequence[str] = (),
    total: int | None = None,
    hot_rows: int | None = None,
) -> DataFrame:
    """``node, parent, moved``: the parent's parent where there is one.

    ``moving`` are the pointers to follow, ``ahead`` (``node, parent, at_root``) the pointers they can run into. A
    pointer has arrived, and ``moved`` is false, if its parent has no pointer or one that is known to end at a root.
    """
    onward = ahead.select(*by, F.col("node").alias("parent"), F.col("parent").alias("next"), "at_root")
    return lookup(moving, onward, "parent", by, "left", total, hot_rows=hot_rows).select(
        *by,
        "node",
        F.coalesce("next", "parent").alias("parent"),
        (F.col("next").isNotNull() & ~F.coalesce("at_root", F.lit(False))).alias("moved"),
    )


def flatten(
    tables: RoundTables,
    forest: DataFrame,
    total: int,
    by: Sequence[str] = (),
    hot_rows: int | None = None,
) -> Flat:
    """Point every node of a forest (``node``, ``parent``; ``total`` pointers at most) at its root.

    Each pass follows and writes only the pointers that may not have arrived yet, so the passes get smaller: the
    pointers they can run into are picked by a semi-join with the few, and the rest of the forest is not shuffled
    again. A pointer that meets one that has arrived has arrived itself, so no pass is spent on finding that out.
    The first pass reads ``forest`` twice; Spark computes an aggregation like that of :func:`pointers` once.
    """
    first = double_pointers(forest, forest.withColumn("at_root", F.lit(False)), by, total, hot_rows)
    passes = [tables.write(first, "pointers", moved=F.count_if("moved"))]
    while passes[-1].sums["moved"]:
        last = passes[-1]
        moving = last.df.filter("moved").drop("moved")
        ahead = _union([table.df.filter(~F.col("moved")).withColumn("at_root", F.lit(True)) for table in passes])
        ahead = ahead.drop("moved").unionByName(moving.withColumn("at_root", F.lit(False)))
        targets = moving.select(*by, F.col("parent").alias("node")).distinct()
        ahead = ahead.join(targets, [*by, "node"], "left_semi")
        onward = double_pointers(moving, ahead, by, last.sums["moved"], hot_rows)
        passes.append(tables.write(onward, "pointers", moved=F.count_if("moved")))
    settled = _union([table.df.filter(~F.col("moved")).drop("moved") for table in passes])
    return Flat(settled, passes[0].rows)


def _union(frames: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, frames)


def relabel(
    pairs: DataFrame, roots: DataFrame, by: Sequence[str], total: int, hot_rows: int | None = None
) -> DataFrame:
    """Canonical pairs between the trees: both ends replaced by their roots."""
    of_node = roots.select(*by, "node", F.col("parent").alias("src"))
    of_component = roots.select(*by, F.col("node").alias("component"), F.col("parent").alias("root"))
    moved = lookup(pairs, of_node, "node", by, "inner", total, hot_rows=hot_rows)
    # Most pairs of a sparse graph end at the root already and are dropped on the way.
    moved = moved.filter(F.col("src") != F.col("component")).select(*by, "src", "component")
    edges = lookup(moved, of_component, "component", by, "left", total, pairs, hot_rows)
    return normalise(edges.select(*by, "src", F.coalesce("root", "component").alias("dst")), by)


def contract(
    edges: DataFrame,
    by: Sequence[str] = (),
    max_rounds: int = 100,
    hot_rows: int | None = None,
    tables: RoundTables | None = None,
) -> DataFrame:
    """``node, component`` for every node that is not its component's smallest.

    The result is one table of ``tables``; all others are deleted, also if a round raises.
    """
    tables = tables or RoundTables(edges.sparkSession)
    with tables.temporary() as scratch:
        labels = _rounds(scratch, edges, by, max_rounds, hot_rows)
        return tables.write(labels, "components").df


def _rounds(
    tables: RoundTables, edges: DataFrame, by: Sequence[str], max_rounds: int, hot_rows: int | None
) -> DataFrame:
    current = tables.write(normalise(edges, by), "pairs")
    forests: list[Flat] = []
    while current.rows:
        if len(forests) == max_rounds:
            raise RuntimeError(f"still {current.rows} edges between components after {max_rounds} rounds")
        forest = flatten(tables, pointers(current.df, by), current.rows, by, hot_rows)
        forests.append(forest)
        if forest.rows == current.rows:
            break  # one smaller neighbour each: the edges were a forest, and nothing is left
        between = relabel(current.df, forest.pointers, by, current.rows, hot_rows)
        previous, current = current, tables.write(between, "pairs")
        tables.drop(previous)

    if not forests:
        return current.df.select(*by, "node", "component")
    return resolved(tables, forests, by, hot_rows)


def resolved(
    tables: RoundTables, forests: list[Flat], by: Sequence[str] = (), hot_rows: int | None = None
) -> DataFrame:
    """``node, component`` from the flat forests of all rounds.

    A node is in the forest of the round that removed it. From the last round back, the root that a round
    has found is replaced by what the later rounds have made of it.
    """
    labels = forests[-1].pointers
    for forest in reversed(forests[:-1]):
        later = labels.select(*by, F.col("node").alias("parent"), F.col("parent").alias("next"))
        onward = lookup(forest.pointers, later, "parent", by, "left", forest.rows, hot_rows=hot_rows)
        onward = onward.select(*by, "node", F.coalesce("next", "parent").alias("parent"))
        labels = labels.unionByName(onward)
        if forest is not forests[0]:
            labels = tables.write(labels, "labels").df
    return labels.select(*by, "node", F.col("parent").alias("component"))
