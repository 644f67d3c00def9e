"""Join a large table to a written one, without a shuffle where that one is small."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from archipelago.operators.lookup import lookup
from archipelago.sources.round_tables import RoundTable

# Session setting: the largest table, in bytes, that is sent to every task.
SMALL_BYTES = ("spark.archipelago.broadcast.bytes", 32 << 20)


def fits(spark: SparkSession, rows: int, columns: int) -> bool:
    """Whether so many rows of ids may be broadcast, with 8 bytes a column and 8 a row."""
    name, default = SMALL_BYTES
    return rows * 8 * (columns + 1) <= int(spark.conf.get(name, str(default)))


def is_small(side: RoundTable) -> bool:
    """Whether a written table of ids may be broadcast, by its number of rows."""
    return fits(side.df.sparkSession, side.rows, len(side.df.columns))


def side_lookup(
    rows: DataFrame, side: RoundTable, key: str, by: Sequence[str] = (), how: str = "left", hot_rows: int | None = None
) -> DataFrame:
    """Add the columns of ``side``, which has one row per ``by`` + ``key``, to ``rows``.

    A small ``side`` is broadcast, and ``rows`` stay where they are; with a larger one this is :func:`lookup`, which
    salts hot keys. The rows that come out are the same.
    """
    if is_small(side):
        return rows.join(F.broadcast(side.df), [*by, key], how)
    return lookup(rows, side.df, key, by, how, hot_rows=hot_rows)


def without(rows: DataFrame, side: RoundTable, key: str, by: Sequence[str] = (), hot_rows: int | None = None) -> DataFrame:
    """The ``rows`` whose ``by`` + ``key`` is not in ``side``."""
    if is_small(side):
        return rows.join(F.broadcast(side.df), [*by, key], "left_anti")
    marked = lookup(rows, side.df.withColumn("_listed", F.lit(True)), key, by, "left", hot_rows=hot_rows)
    return marked.filter(F.col("_listed").isNull()).drop("_listed")
