"""What follows from component assignments (``node``, ``component``)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def with_roots(pairs: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Add the row of each component's smallest node, which is its own component."""
    roots = pairs.select(*by, "component").distinct()
    return pairs.unionByName(roots.select(*by, F.col("component").alias("node"), "component"))


def with_vertices(assignments: DataFrame, vertices: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Add the vertices (``node``) that no edge touches, each as its own component.

    A component id is never above its node, so the smallest claim per node is the right one and
    known vertices change nothing.
    """
    alone = vertices.filter(F.col("node").isNotNull()).select(
        *by, F.col("node").cast("bigint").alias("node"), F.col("node").cast("bigint").alias("component")
    )
    claims = assignments.select(*by, "node", "component").unionByName(alone)
    return claims.groupBy(*by, "node").agg(F.min("component").alias("component"))


def component_count(assignments: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """``components`` per graph, or one row; the rows of the components' smallest nodes may be there or not.

    Nodes of a component combine to one row before the shuffle.
    """
    distinct = assignments.select(*by, "component").distinct()
    return distinct.groupBy(*by).agg(F.count("component").alias("components"))


def component_sizes(assignments: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """``component, members`` for assignments with root rows."""
    return assignments.groupBy(*by, "component").agg(F.count(F.lit(1)).alias("members"))
