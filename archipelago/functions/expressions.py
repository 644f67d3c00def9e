"""Column expressions shared by the sources and the operators."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values of the edge file format.
COMMENT_PREFIX = "#"
FIELD_SEPARATOR = "\t"


def is_edge_line(line: Column) -> Column:
    """True for lines that are neither a comment nor blank."""
    return ~line.startswith(COMMENT_PREFIX) & (F.trim(line) != "")


def id_field(line: Column, position: int) -> Column:
    """The field at ``position`` as a bigint, NULL when missing or not a number."""
    return F.get(F.split(line, FIELD_SEPARATOR), F.lit(position)).try_cast("bigint")


def has_field(line: Column, position: int) -> Column:
    """Whether a line has so many separators that there is a field at ``position``."""
    return F.size(F.split(line, FIELD_SEPARATOR)) > position


def smallest_in_neighbourhood(node: Column, neighbours: Column) -> Column:
    """The smallest id among a node and its array of neighbours."""
    return F.least(node, F.array_min(neighbours))
