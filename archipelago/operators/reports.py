"""Small reports on results."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame


def ordered_preview(df: DataFrame, rows: int, *columns: str) -> DataFrame:
    """The first rows in the order of ``columns`` (all columns when none are named)."""
    return df.orderBy(*(columns or df.columns)).limit(rows)


def wide_to_long(
    df: DataFrame,
    ids: Sequence[str],
    values: Sequence[str],
    rename: Mapping[str, str] | None = None,
) -> DataFrame:
    """One row per id and value column: ``variable`` holds the column's name, ``value`` its value.

    ``rename`` maps column names of the result to new ones.
    """
    long = df.unpivot(list(ids), list(values), "variable", "value")
    return long.withColumnsRenamed(dict(rename or {}))
