"""Join every row to the one table row with its key, whatever the spread of the keys."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Session setting: rows of a key that one task should get at most. A key with more is hot.
HOT_ROWS = ("spark.archipelago.hot.rows", 4_000_000)
# Session setting: table rows per shuffle partition that a task may hash instead of sorting both sides.
HASHED_ROWS = ("spark.archipelago.hashed.rows", 500_000)
# Tables of fewer rows are left to Spark, which may broadcast them.
LEAST_HASHED = 2_000_000


def hot_limit(spark: SparkSession, hot_rows: int | None = None) -> int:
    """Rows a key may hold before it is split: ``hot_rows``, or the session's setting, or its default."""
    name, default = HOT_ROWS
    return int(spark.conf.get(name, str(default))) if hot_rows is None else hot_rows


def hot_keys(rows: DataFrame, on: Sequence[str], limit: int) -> DataFrame:
    """The keys with more than ``limit`` rows, and in ``_parts`` how many times that they have."""
    return (
        rows.groupBy(*on)
        .count()
        .filter(F.col("count") > limit)
        .select(*on, F.ceil(F.col("count") / limit).cast("bigint").alias("_parts"))
    )


def hashed(table: DataFrame, rows: int | None) -> DataFrame:
    """``table``, to be hashed by the join it is the right side of, if its number of rows says that a partition fits in memory."""
    if rows is None:
        return table
    name, default = HASHED_ROWS
    conf = table.sparkSession.conf
    each = int(conf.get(name, str(default)))
    return table.hint("shuffle_hash") if LEAST_HASHED < rows <= each * int(conf.get("spark.sql.shuffle.partitions")) else table


def lookup(
    rows: DataFrame,
    table: DataFrame,
    key: str,
    by: Sequence[str] = (),
    how: str = "left",
    total: int | None = None,
    counted_on: DataFrame | None = None,
    hot_rows: int | None = None,
    table_rows: int | None = None,
    hot: DataFrame | None = None,
) -> DataFrame:
    """Add the columns of ``table`` to ``rows``; ``table`` has one row per ``by`` + ``key``.

    ``how`` is ``"left"`` (NULLs where the key is not in the table) or ``"inner"``. Nothing runs
    before the result is asked for.

    The rows of a hot key, one with more than ``hot_rows`` rows, are salted over as many parts as
    its size needs, and its one table row is repeated for each part. The list of hot keys is broadcast to
    both sides: it has at most one row for every ``hot_rows`` rows of the input, and twice as many
    parts. ``total`` is the number of ``rows`` or a bound of it, where that is known; if it is
    too small for any key to be hot, this is an ordinary join.

    Keys are counted on ``rows``, or on ``counted_on`` if that is cheaper to compute and has no
    fewer rows of any key; counts combine before the shuffle. Rows are dealt to parts by a hash of
    their content, so ``rows`` should be distinct: equal rows share a part. ``hot`` are the :func:`hot_keys`, where they
    are known already.

    ``table_rows`` is the number of rows of ``table`` or a bound of it. Where it says that a partition of ``table`` fits
    in a task's memory, that is hashed, and ``rows`` are not sorted.
    """
    on = [*by, key]
    limit = hot_limit(rows.sparkSession, hot_rows)
    if total is not None and total <= limit:
        return rows.join(hashed(table, table_rows), on, how)

    hot = F.broadcast(hot_keys(rows if counted_on is None else counted_on, on, limit) if hot is None else hot)
    part = F.when(F.col("_parts").isNotNull(), F.pmod(F.xxhash64(*rows.columns), "_parts")).otherwise(0)
    parts = F.sequence(F.lit(0).cast("bigint"), F.coalesce("_parts", F.lit(1)) - 1)
    salted_rows = rows.join(hot, on, "left").withColumn("_part", part).drop("_parts")
    salted_table = table.join(hot, on, "left").withColumn("_part", F.explode(parts)).drop("_parts")
    return salted_rows.join(hashed(salted_table, table_rows), [*on, "_part"], how).drop("_part")
