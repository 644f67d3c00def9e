"""Edges and pairs.

An edge is (``src``, ``dst``) in any direction. A pair is (``node``, ``component``) with
``node > component``; it is both an edge in canonical direction and a claim that ``component`` is
reachable from ``node``. ``by`` names extra columns, such as a graph name, that keep several graphs
apart in one DataFrame.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def symmetrize(edges: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Every edge in both directions, duplicates kept. The input is read once."""
    both = F.array(
        F.struct(F.col("src").alias("src"), F.col("dst").alias("dst")),
        F.struct(F.col("dst").alias("src"), F.col("src").alias("dst")),
    )
    return edges.select(*by, F.inline(both))


def as_edges(pairs: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Pairs as edges ``component -> node``."""
    return pairs.select(*by, F.col("component").alias("src"), F.col("node").alias("dst"))


def normalise(edges: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Distinct canonical pairs of an undirected graph; self-loops and NULL ids are dropped."""
    return (
        edges.filter(F.col("src") != F.col("dst"))
        .select(
            *by,
            F.greatest("src", "dst").cast("bigint").alias("node"),
            F.least("src", "dst").cast("bigint").alias("component"),
        )
        .distinct()
    )


def by_component(assignments: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """The other orientation: ``component`` first, ``node`` second."""
    return assignments.select(*by, "component", "node")
