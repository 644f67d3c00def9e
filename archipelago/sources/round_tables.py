"""Tables that cut the plan between rounds.

An iterative job whose plan grows every round recomputes its past and soon spends its time in the
optimizer. Each round is therefore written as parquet to the shared folder the cluster names in
``spark.checkpoint.dir`` and read back. Losing executors loses nothing, ids compress well, unused
columns are not read again, and a round no longer needed can be deleted at once.
"""

from __future__ import annotations

import contextlib
import tempfile
import uuid
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F


def shared_folder(spark: SparkSession) -> str:
    """The folder for intermediate tables, from the session's settings.

    Where none is set, a temporary folder will do in local mode only: on a cluster the executors
    do not share the driver's disk.
    """
    named = spark.conf.get("spark.checkpoint.dir", "")
    if named:
        return named
    context = spark.sparkContext
    checkpoint_dir = context.getCheckpointDir()
    if checkpoint_dir:
        return checkpoint_dir
    if not context.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    context.setCheckpointDir(tempfile.mkdtemp(prefix="archipelago-"))
    return context.getCheckpointDir()


@dataclass(frozen=True)
class RoundTable:
    """A written table, its number of rows and other sums taken while it was written."""

    df: DataFrame
    path: str
    rows: int
    sums: dict[str, int]


class RoundTables:
    """The tables of one run, in a folder of their own.

    ``folder`` names the place; by default it is in the shared folder of the session's settings.
    Results read tables of their run, which stay until :meth:`delete` (or ``with``) removes them.
    """

    def __init__(self, spark: SparkSession, folder: str | None = None) -> None:
        self._spark = spark
        parent = shared_folder(spark) if folder is None else folder
        self.folder = f"{parent.rstrip('/')}/archipelago-{uuid.uuid4().hex}"
        self._written = 0

    def __enter__(self) -> RoundTables:
        return self

    def __exit__(self, *_: object) -> None:
        self.delete()

    def new_path(self, name: str) -> str:
        self._written += 1
        return f"{self.folder}/{self._written:04d}-{name}"

    def write(
        self,
        df: DataFrame,
        name: str,
        partition_by: Sequence[str] = (),
        unfolded: Callable[[DataFrame], DataFrame] | None = None,
        **sums: Column,
    ) -> RoundTable:
        """Compute ``df`` once and return it as a table that has no past.

        With ``partition_by``, its last columns, readers that filter by these read only what they need.
        ``sums`` are aggregates to take in the same job. They are observed on the rows as they are
        written, that is in the tasks of the job's result stage, which Spark counts once each even
        if some run twice. With ``unfolded``, the table has the rows that this makes of the ones counted, without a shuffle.
        """
        path = self.new_path(name)
        seen = Observation()
        counts = [column.alias(key) for key, column in sums.items()]
        df = df.observe(seen, F.count(F.lit(1)).alias("rows"), *counts)
        df = df if unfolded is None else unfolded(df)
        df.write.partitionBy(*partition_by).parquet(path)
        taken = dict(seen.get)
        rows = taken.pop("rows")
        return RoundTable(self._spark.read.schema(df.schema).parquet(path), path, rows, taken)

    def drop(self, *tables: RoundTable) -> None:
        """Delete tables that nothing reads any more."""
        for table in tables:
            self._remove(table.path)

    def delete(self) -> None:
        """Delete all tables of the run, and with them what reads them."""
        self._remove(self.folder)

    @contextlib.contextmanager
    def temporary(self) -> Iterator[RoundTables]:
        """Tables that are deleted at the end of a ``with`` block, however it ends."""
        with RoundTables(self._spark, self.folder) as tables:
            yield tables

    def _remove(self, name: str) -> None:
        context = self._spark.sparkContext
        path = context._jvm.org.apache.hadoop.fs.Path(name)
        path.getFileSystem(context._jsc.hadoopConfiguration()).delete(path, True)
