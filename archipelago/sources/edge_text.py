"""Edges from text files: one edge per line, two ids separated by a tab."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from archipelago.functions import has_field, id_field, is_edge_line
from archipelago.sources.round_tables import RoundTables

# Why a line is no edge.
NO_SECOND = "no second field"
NO_FIRST_ID = "first field is not an id"
NO_SECOND_ID = "second field is not an id"


def read_edge_lines(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """Raw lines as ``value: string``; any Hadoop file system, compressed or not."""
    return spark.read.text(path)


def parse_edge_lines(lines: DataFrame, on_bad: str = "drop") -> DataFrame:
    """Turn lines (``value``) into edges (``src``, ``dst``).

    Lines starting with ``#`` and blank lines are skipped, fields after the second are ignored.
    A line without two integer fields is skipped too, or fails the job with ``on_bad="fail"``.
    """
    if on_bad not in ("drop", "fail"):
        raise ValueError(f"on_bad must be 'drop' or 'fail', not {on_bad!r}")
    line = F.col("value")
    edges = lines.filter(is_edge_line(line)).select(
        line, id_field(line, 0).alias("src"), id_field(line, 1).alias("dst")
    )
    good = F.col("src").isNotNull() & F.col("dst").isNotNull()
    if on_bad == "fail":
        # In the filter, where no later choice of columns can leave it out.
        refuse = F.raise_error(F.concat(F.lit("not an edge line: "), line)).cast("boolean")
        good = F.when(good, F.lit(True)).otherwise(refuse)
    return edges.filter(good).select("src", "dst")


def read_edge_file(spark: SparkSession, path: str | list[str], on_bad: str = "drop") -> DataFrame:
    """Edges (``src``, ``dst``) of one or more edge files."""
    return parse_edge_lines(read_edge_lines(spark, path), on_bad)


@dataclass(frozen=True)
class SeparatedLines:
    """What :func:`separate_edge_lines` has made of some lines.

    ``edges`` (``src``, ``dst``), ``rejected`` (``file, line, reason``), and how many lines there were: ``edge_count`` +
    ``rejected_count`` + ``skipped_count`` (comments and blank lines) are all of them.
    """

    edges: DataFrame
    rejected: DataFrame
    edge_count: int
    rejected_count: int
    skipped_count: int


def separate_edge_lines(lines: DataFrame, tables: RoundTables | None = None) -> SeparatedLines:
    """Good lines as edges, bad ones in a quarantine table, in one pass over the lines (``value``).

    Both are one table of ``tables``, laid out so that readers of the edges do not read the bad lines. ``file`` is the file
    that a line was read from, empty if it comes from no file.
    """
    tables = tables or RoundTables(lines.sparkSession)
    line = F.col("value")
    src, dst = id_field(line, 0), id_field(line, 1)
    reason = (
        F.when(~has_field(line, 1), NO_SECOND)
        .when(src.isNull(), NO_FIRST_ID)
        .when(dst.isNull(), NO_SECOND_ID)
        .otherwise("")
    )
    # A NULL line is skipped like a blank one.
    kind = F.when(F.coalesce(is_edge_line(line), F.lit(False)), F.when(reason == "", "edge").otherwise("rejected"))
    kind = kind.otherwise("skipped")
    bad = kind == "rejected"

    def only(where: Column, value: Column) -> Column:
        return F.when(where, value)

    separated = lines.select(
        only(kind == "edge", src).alias("src"),
        only(kind == "edge", dst).alias("dst"),
        only(bad, F.input_file_name()).alias("file"),
        only(bad, line).alias("line"),
        only(bad, reason).alias("reason"),
        kind.alias("kind"),
    )
    counts = {name: F.count_if(F.col("kind") == name) for name in ("edge", "rejected", "skipped")}
    table = tables.write(separated, "lines", partition_by=["kind"], **counts)
    return SeparatedLines(
        table.df.filter("kind = 'edge'").select("src", "dst"),
        table.df.filter("kind = 'rejected'").select("file", "line", "reason"),
        *(table.sums[name] for name in ("edge", "rejected", "skipped")),
    )
