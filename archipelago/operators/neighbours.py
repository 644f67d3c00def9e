"""Neighbourhoods of symmetric edges (see :func:`archipelago.operators.pairs.symmetrize`)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from archipelago.operators.lookup import lookup
from archipelago.sources.round_tables import RoundTables

LIST_LENGTH = 100_000
# Nodes with several lists that may be sent to every task.
FEW_LARGE = 100_000


def neighbour_min(symmetric: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """``node, smallest``: the smallest id among each node and its neighbours.

    A plain ``min`` combines before the shuffle, so a node with very many neighbours sends one row
    per input task.
    """
    return (
        symmetric.groupBy(*by, F.col("src").alias("node"))
        .agg(F.min("dst").alias("smallest"))
        .withColumn("smallest", F.least("node", "smallest"))
    )


def split_lists(
    tables: RoundTables,
    edges: DataFrame,
    by: Sequence[str] = (),
    list_length: int = LIST_LENGTH,
    hot_rows: int | None = None,
    total: int | None = None,
) -> tuple[DataFrame, DataFrame | None]:
    """Neighbour lists (``node, part, neighbours``) of distinct symmetric edges.

    The first frame has the nodes with one list, the second the lists of nodes with more, or is
    None if there are none: which nodes those are is written first.
    """
    degrees = edges.groupBy(*by, "src").agg(F.count(F.lit(1)).alias("edges"))
    large = tables.write(degrees.filter(F.col("edges") > list_length), "large-nodes")
    if not large.rows:
        tables.drop(large)
        return split_by(None, edges, by, list_length, hot_rows, total)
    return split_by(large.df, edges, by, list_length, hot_rows, total, large.rows)


def split_by(
    large: DataFrame | None,
    edges: DataFrame,
    by: Sequence[str] = (),
    list_length: int = LIST_LENGTH,
    hot_rows: int | None = None,
    total: int | None = None,
    large_rows: int | None = None,
) -> tuple[DataFrame, DataFrame | None]:
    """The same, where it is known which nodes have more than ``list_length`` neighbours.

    ``large`` are those (``src``) with their number of ``edges``, or None if there are none, and ``large_rows`` how many.
    """

    def lists(edges: DataFrame, *parts: str) -> DataFrame:
        # The rows of a list come together as they are, in one shuffle; lists begun in each task would all be shuffled.
        members = F.array_sort(F.collect_list("dst")).alias("neighbours")
        keyed = edges.select(*by, F.col("src").alias("node"), "part", "dst")
        return keyed.repartition(*by, "node", *parts).groupBy(*by, "node", "part").agg(members)

    whole = F.lit(0).cast("bigint")
    if large is None:
        return lists(edges.withColumn("part", whole)), None
    large = large.select(*by, "src", F.ceil(F.col("edges") / list_length).cast("bigint").alias("parts"))
    if large_rows is not None and large_rows <= FEW_LARGE:
        found = edges.join(F.broadcast(large), [*by, "src"], "left")
    else:
        found = lookup(edges, large, "src", by, "left", total, hot_rows=hot_rows)
    few = found.filter(F.col("parts").isNull()).withColumn("part", whole)
    many = found.filter(F.col("parts").isNotNull()).withColumn("part", F.pmod(F.xxhash64("dst"), "parts"))
    return lists(few), lists(many, "part")


def adjacency_lists(
    symmetric: DataFrame,
    by: Sequence[str] = (),
    list_length: int = LIST_LENGTH,
    hot_rows: int | None = None,
    tables: RoundTables | None = None,
) -> DataFrame:
    """``node, part, neighbours``: the distinct neighbours of each node as sorted arrays.

    A node with up to ``list_length`` distinct neighbours has one row, part 0. Those of a larger one are
    spread by hash over as many parts as lists of that length need, so that no task and no row has
    to hold them all; each neighbour is in exactly one part, and a part that gets none has no row.

    The distinct edges are written once, to ``tables`` (see :class:`RoundTables`, which can delete
    them after the last use), and everything is read from there.
    """
    tables = tables or RoundTables(symmetric.sparkSession)
    edges = tables.write(symmetric.select(*by, "src", "dst").distinct(), "edges")
    few, many = split_lists(tables, edges.df, by, list_length, hot_rows, edges.rows)
    return few if many is None else few.unionByName(many)
