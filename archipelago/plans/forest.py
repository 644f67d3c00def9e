"""A spanning forest: input edges that alone connect what all edges connect.

The rounds are those of :mod:`archipelago.plans.contraction`. Each pair between trees carries one input edge that made it,
its witness. A pointer of a round joins two trees that were apart, so its witness joins them too, and no later round
joins them again. The witnesses of all pointers are therefore a forest, and as every node but a component's smallest
gets exactly one pointer, it has one edge fewer than nodes in each component.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from archipelago.operators import lookup
from archipelago.plans.contraction import Flat, flatten, resolved
from archipelago.sources.round_tables import RoundTables

_WITNESS = ("src", "dst")


def witnessed_pairs(edges: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """``node, component, src, dst``: distinct canonical pairs with the smallest edge that has these ends."""
    node = F.greatest("src", "dst").cast("bigint").alias("node")
    component = F.least("src", "dst").cast("bigint").alias("component")
    given = edges.filter(F.col("src") != F.col("dst")).select(*by, node, component, "src")
    # The smaller edge is the one that begins at the smaller end, if there is one.
    first = given.groupBy(*by, "node", "component").agg(F.min("src").alias("src"))
    other = F.when(F.col("src") == F.col("component"), F.col("node")).otherwise(F.col("component"))
    return first.withColumn("dst", other.cast(edges.schema["dst"].dataType))


def _distinct(pairs: DataFrame, by: Sequence[str]) -> DataFrame:
    first = F.min(F.struct(*_WITNESS)).alias("witness")
    return pairs.groupBy(*by, "node", "component").agg(first).select(*by, "node", "component", "witness.*")


def witnessed_pointers(pairs: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """``node, parent, src, dst``: each node that has a smaller neighbour, its smallest one, and the edge between them."""
    # A node's pairs have different components, so no two are the smallest.
    of_smallest = [F.min_by(name, "component").alias(name) for name in _WITNESS]
    return pairs.groupBy(*by, "node").agg(F.min("component").alias("parent"), *of_smallest)


def _between(pairs: DataFrame, roots: DataFrame, by: Sequence[str], total: int, hot_rows: int | None) -> DataFrame:
    """Pairs between the trees, each with one of the witnesses of its pairs."""
    of_node = roots.select(*by, "node", F.col("parent").alias("high"))
    of_component = roots.select(*by, F.col("node").alias("component"), F.col("parent").alias("root"))
    moved = lookup(pairs, of_node, "node", by, "inner", total, hot_rows=hot_rows)
    moved = moved.filter(F.col("high") != F.col("component")).drop("node")
    ends = lookup(moved, of_component, "component", by, "left", total, pairs, hot_rows)
    low = F.coalesce("root", "component")
    ends = ends.withColumn("low", low).filter(F.col("high") != F.col("low"))
    pair = (F.greatest("high", "low").alias("node"), F.least("high", "low").alias("component"))
    return _distinct(ends.select(*by, *pair, *_WITNESS), by)


def spanning_forest(
    edges: DataFrame,
    by: Sequence[str] = (),
    max_rounds: int = 100,
    hot_rows: int | None = None,
    tables: RoundTables | None = None,
) -> DataFrame:
    """``src, dst, component``: for each component one edge of ``edges`` fewer than it has nodes, which connect it.

    Edges are given as they are in the input. Of equal pairs in either direction the smaller (``src``, ``dst``) counts;
    self-loops and NULL ids are dropped. ``component`` is the smallest node of the component. Which edges are chosen
    depends on the edges alone. The result is one table of ``tables``; all others are deleted, also if a round raises.
    """
    tables = tables or RoundTables(edges.sparkSession)
    with tables.temporary() as scratch:
        joined, forests = _rounds(scratch, edges, by, max_rounds, hot_rows)
        if not forests:
            empty = joined[0].select(*by, *_WITNESS, "component")
            return tables.write(empty, "forest").df
        chosen = reduce(DataFrame.unionByName, joined)
        labels = resolved(scratch, forests, by, hot_rows)
        labels = labels.select(*by, F.col("node").alias("src"), "component")
        total = sum(forest.rows for forest in forests)
        found = lookup(chosen, labels, "src", by, "left", total, hot_rows=hot_rows)
        found = found.select(*by, *_WITNESS, F.coalesce("component", "src").alias("component"))
        return tables.write(found, "forest").df


def _rounds(
    tables: RoundTables, edges: DataFrame, by: Sequence[str], max_rounds: int, hot_rows: int | None
) -> tuple[list[DataFrame], list[Flat]]:
    """The witnesses that each round has chosen, and its flat forest."""
    current = tables.write(witnessed_pairs(edges, by), "pairs")
    chosen, forests = [current.df], []
    if current.rows:
        chosen = []
    while current.rows:
        if len(forests) == max_rounds:
            raise RuntimeError(f"still {current.rows} edges between components after {max_rounds} rounds")
        # Written first: its witnesses are results, and its pointers are read more than once.
        first = tables.write(witnessed_pointers(current.df, by), "witnesses")
        chosen.append(first.df.select(*by, *_WITNESS))
        forests.append(flatten(tables, first.df.select(*by, "node", "parent"), first.rows, by, hot_rows))
        if first.rows == current.rows:
            break
        between = _between(current.df, forests[-1].pointers, by, current.rows, hot_rows)
        previous, current = current, tables.write(between, "pairs")
        tables.drop(previous)
    return chosen, forests
