"""Component assignments on disk."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def write_assignments(assignments: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """Write ``node, component`` rows (and any graph columns) as parquet."""
    assignments.write.mode(mode).parquet(path)


def read_assignments(spark: SparkSession, path: str) -> DataFrame:
    """Read back what :func:`write_assignments` wrote."""
    return spark.read.parquet(path)
