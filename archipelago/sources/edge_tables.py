"""Edges from ordinary tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from archipelago.operators.lookup import lookup
from archipelago.sources.round_tables import RoundTables


def edges_from_columns(df: DataFrame, src: str, dst: str, two_kinds: bool = False) -> DataFrame:
    """One edge per row, from two id columns. Rows with a missing id give no edge.

    If the two columns number different kinds of things, ``two_kinds`` keeps them apart, whatever
    their size: the ids become ``2 * src`` and ``2 * dst + 1`` (see :func:`kind_and_id`). An id
    whose double is no bigint fails the job.
    """
    given = df.filter(F.col(src).isNotNull() & F.col(dst).isNotNull()).select(
        F.col(src).cast("bigint").alias("src"), F.col(dst).cast("bigint").alias("dst")
    )
    if not two_kinds:
        return given
    return given.select(_doubled("src").alias("src"), (_doubled("dst") + 1).alias("dst"))


def _doubled(column: str) -> Column:
    """Twice an id; the check raises without ANSI mode too."""
    fits = F.col(column).between(-(2**62), 2**62 - 1)
    refused = F.raise_error(F.concat(F.lit("id out of range: "), F.col(column).cast("string")))
    return F.when(fits, F.col(column) * 2).otherwise(refused.cast("bigint"))


def kind_and_id(node: Column | str) -> tuple[Column, Column]:
    """Of a node made with ``two_kinds``: 0 for the first column and 1 for the second, and the id there."""
    node = F.col(node) if isinstance(node, str) else node
    return F.pmod(node, F.lit(2)).cast("int"), F.shiftright(node, 1)


def edges_from_shared_value(
    df: DataFrame,
    node: str,
    value: str | Column,
    hot_rows: int | None = None,
    tables: RoundTables | None = None,
) -> DataFrame:
    """Link all rows that hold the same value, each to the smallest node that holds it.

    k nodes with one value give k - 1 edges, and the components are those of all k * k pairs. The
    values travel as SHA-256 digests. The distinct holders of each value are computed once, into a narrow
    table that combines before the shuffle, since they are read twice: for the smallest node of each value and
    for the nodes to link to it. Values of a single node are left out before the join, and a value held by a
    large part of all nodes is never gathered in one task (see :func:`lookup`). The edges are written
    to ``tables`` (see :class:`RoundTables`, which can delete them after the last use); the holders are
    deleted at once.
    """
    held = F.col(value) if isinstance(value, str) else value
    tables = tables or RoundTables(df.sparkSession)
    with tables.temporary() as scratch:
        holders = scratch.write(
            df.select(
                F.col(node).cast("bigint").alias("dst"),
                F.unhex(F.sha2(held.cast("string"), 256)).alias("digest"),
            )
            .filter(F.col("digest").isNotNull() & F.col("dst").isNotNull())
            .distinct(),
            "holders",
        )
        shared = (
            holders.df.groupBy("digest")
            .agg(F.min("dst").alias("src"), F.max("dst").alias("largest"))
            .filter(F.col("src") < F.col("largest"))
            .drop("largest")
        )
        linked = lookup(holders.df, shared, "digest", how="inner", total=holders.rows, hot_rows=hot_rows)
        edges = linked.filter(F.col("src") < F.col("dst")).select("src", "dst").distinct()
        return tables.write(edges, "shared-values").df
