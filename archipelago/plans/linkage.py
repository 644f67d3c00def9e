"""Single linkage: the components for many cut-offs of weighted edges, from one minimum spanning forest.

The forest is grown by Boruvka rounds. In a round every node points along its lightest edge; edges are in one strict order
(weight, then ends), in which they are numbered once, so pointers form trees but for pairs of nodes that point at each other along the same edge, of
which the smaller one becomes the root. Trees are contracted, and of parallel edges between two trees the lightest is
left. At least half of the nodes with an edge disappear in each round. Edges up to a weight connect the same nodes as those of
the forest up to that weight, so each cut-off needs the few edges of the forest only.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from archipelago.operators import lookup
from archipelago.operators.lookup import hashed, hot_limit
from archipelago.plans.connected import connected_components
from archipelago.plans.contraction import flatten
from archipelago.sources.round_tables import RoundTable, RoundTables

# An edge as it came, in the order in which edges are compared.
_EDGE = ("weight", "src", "dst")


def _placed(tables: RoundTables, given: DataFrame, by: Sequence[str]) -> RoundTable:
    """``weight, src, dst, place``: of the edges between two nodes the lightest, in order; rounds carry the place alone."""
    # Of two directions with one weight, the edge from the smaller node counts.
    forward = F.min(F.when(F.col("src") < F.col("dst"), F.col("weight"))).alias("forward")
    node, component = _pair("src", "dst")
    lightest = given.groupBy(*by, node, component).agg(F.min("weight").alias("weight"), forward)
    rises = F.coalesce(F.col("forward") == F.col("weight"), F.lit(False))
    ends = (F.when(rises, F.col(one)).otherwise(F.col(two)).alias(name) for name, one, two in
            (("src", "component", "node"), ("dst", "node", "component")))
    ordered = lightest.select(*by, "weight", *ends).orderBy(*_EDGE)
    return tables.write(ordered.withColumn("place", F.monotonically_increasing_id()), "edges")


def _pair(one: str, two: str) -> tuple[Column, Column]:
    return F.greatest(one, two).alias("node"), F.least(one, two).alias("component")


def _pointers(
    tables: RoundTables, pairs: DataFrame, by: Sequence[str], hot_rows: int | None
) -> tuple[RoundTable, RoundTable]:
    """``node, parent`` and the place of its edge, for every node but those that are the smaller one of a mutual pair.

    The first table has all nodes, with the number of their ``edges``.
    """
    ends = F.array(
        F.struct(F.col("node").alias("node"), F.col("component").alias("parent")),
        F.struct(F.col("component").alias("node"), F.col("node").alias("parent")),
    )
    both = pairs.select(*by, "place", F.inline(ends))
    first = (F.min("place").alias("place"), F.min_by("parent", "place").alias("parent"), F.count(F.lit(1)).alias("edges"))
    chosen = tables.write(both.groupBy(*by, "node").agg(*first), "lightest")
    back = chosen.df.select(*by, F.col("node").alias("parent"), F.col("parent").alias("back"))
    found = lookup(chosen.df, back, "parent", by, "inner", chosen.rows, hot_rows=hot_rows, table_rows=chosen.rows)
    mutual = F.col("back") == F.col("node")
    kept = found.filter(~mutual | (F.col("node") > F.col("parent")))
    return chosen, tables.write(kept.select(*by, "node", "parent", "place"), "pointers")


def minimum_spanning_forest(
    edges: DataFrame,
    by: Sequence[str] = (),
    max_rounds: int = 100,
    hot_rows: int | None = None,
    tables: RoundTables | None = None,
) -> DataFrame:
    """``src, dst, weight``: edges of least total weight that connect what all edges (``src, dst, weight``) connect.

    Of edges with one weight, those with smaller (``src``, ``dst``) are preferred, so the result depends on the edges alone.
    Weights are of any type that can be ordered. Self-loops and edges with a NULL are dropped. The result is one table of
    ``tables``; all others are deleted, also if a round raises.
    """
    tables = tables or RoundTables(edges.sparkSession)
    ids = [F.col(name).cast("bigint").alias(name) for name in ("src", "dst")]
    given = edges.select(*by, "weight", *ids).filter((F.col("src") != F.col("dst")) & F.col("weight").isNotNull())
    with tables.temporary() as scratch:
        edges = _placed(scratch, given, by)
        current, rows = edges.df.select(*by, *_pair("src", "dst"), "place"), edges.rows
        written, places = None, []
        limit = hot_limit(edges.df.sparkSession, hot_rows)
        while rows:
            if len(places) == max_rounds:
                raise RuntimeError(f"still {rows} edges between components after {max_rounds} rounds")
            nodes, pointers = _pointers(scratch, current, by, hot_rows)
            places.append(pointers)
            flat = flatten(scratch, pointers.df.select(*by, "node", "parent"), pointers.rows, by, hot_rows)
            high = flat.pointers.select(*by, "node", F.col("parent").alias("high"))
            low = flat.pointers.select(*by, F.col("node").alias("component"), F.col("parent").alias("low"))
            hot = nodes.df.filter(F.col("edges") > limit)
            hot = hot.select(*by, "node", F.ceil(F.col("edges") / limit).cast("bigint").alias("_parts"))
            moved = lookup(current, high, "node", by, "left", rows, None, hot_rows, flat.rows, hot)
            hot = hot.withColumnRenamed("node", "component")
            moved = lookup(moved, low, "component", by, "left", rows, None, hot_rows, flat.rows, hot)
            moved = moved.select(
                *by, "place", F.coalesce("high", "node").alias("high"), F.coalesce("low", "component").alias("low")
            ).filter(F.col("high") != F.col("low"))
            between = moved.groupBy(*by, *_pair("high", "low")).agg(F.min("place").alias("place"))
            previous, written = written, scratch.write(between, "pairs")
            current, rows = written.df, written.rows
            scratch.drop(nodes, *([previous] if previous else []))
        if not places:
            return tables.write(edges.df.select(*by, "src", "dst", "weight"), "forest").df
        chosen = reduce(DataFrame.unionByName, [pointers.df.select("place") for pointers in places])
        # Places are distinct, so no key is hot.
        chosen = hashed(chosen, sum(pointers.rows for pointers in places))
        found = edges.df.join(chosen, "place", "left_semi")
        return tables.write(found.select(*by, "src", "dst", "weight"), "forest").df


def single_linkage(
    edges: DataFrame,
    cutoffs: Sequence[float],
    by: Sequence[str] = (),
    hot_rows: int | None = None,
    tables: RoundTables | None = None,
) -> DataFrame:
    """``cutoff, node, component``: for each cut-off, the components of the edges whose weight is not above it.

    A node appears under the cut-offs that leave it an edge. All cut-offs are labelled in the same rounds, on the edges of
    :func:`minimum_spanning_forest` alone.
    """
    if not cutoffs:
        raise ValueError("no cut-offs given")
    tables = tables or RoundTables(edges.sparkSession)
    with tables.temporary() as scratch:
        forest = minimum_spanning_forest(edges, by, hot_rows=hot_rows, tables=scratch)
        levels = F.array(*[F.lit(cutoff) for cutoff in sorted(set(cutoffs))])
        cut = forest.select(*by, "src", "dst", F.explode(F.filter(levels, lambda level: level >= F.col("weight"))).alias("cutoff"))
        return connected_components(cut, by=[*by, "cutoff"], hot_rows=hot_rows, tables=tables).select(
            *by, "cutoff", "node", "component"
        )
