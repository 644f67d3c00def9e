"""Stored assignments in parts, of which an update rewrites only those it touches.

A store is a folder. ``rows-N`` has the rows written by update N, partitioned by ``part``, a hash of the component;
``manifest-N`` says for each part which update wrote it last. A manifest counts once its job has committed (its
``_SUCCESS`` file is there), and rows are never changed, so a reader sees all of an update or nothing, and an update that
was lost on the way leaves the store as it was.
"""

from __future__ import annotations

import re
from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from archipelago.operators.sides import without
from archipelago.sources.round_tables import RoundTable


class AssignmentStore:
    """``node, component`` rows (and the ``by`` columns) under ``path``. One update at a time."""

    def __init__(self, spark: SparkSession, path: str, by: Sequence[str] = ()) -> None:
        self._spark = spark
        self.path = path.rstrip("/")
        self._by = list(by)

    def create(self, assignments: DataFrame, parts: int = 256) -> None:
        """Write a new store. Components are dealt to ``parts`` by hash; a part has as many files as its size asks for."""
        if self._versions():
            raise FileExistsError(self.path)
        rows = assignments.select(*self._by, "node", "component")
        rows.limit(0).write.mode("overwrite").parquet(f"{self.path}/columns")
        self._write(rows, parts, 0)
        self._write_manifest(dict.fromkeys(range(parts), 0), 0)

    def read(self) -> DataFrame:
        """All rows, of the last committed update."""
        return self._read(self._manifest(self._latest()))

    def update(self, touched: RoundTable, rows: DataFrame) -> None:
        """Replace the rows of the components ``touched`` by ``rows`` (see :class:`archipelago.plans.updates.Update`).

        Parts that hold none of these components are neither read nor written.
        """
        latest = self._latest()
        manifest = self._manifest(latest)
        parts = len(manifest)
        components = touched.df.select(*self._by, "component").unionByName(rows.select(*self._by, "component"))
        # A number for each part at most.
        changed = [row["part"] for row in components.select(self._part(parts)).distinct().collect()]
        if not changed:
            return
        kept = without(self._read({part: manifest[part] for part in changed}), touched, "component", self._by)
        version = latest + 1
        names = [*self._by, "node", "component"]
        self._write(kept.select(names).unionByName(rows.select(names)), parts, version)
        self._write_manifest(manifest | dict.fromkeys(changed, version), version)

    def parts_of_last_update(self) -> list[int]:
        """The parts that the last update has written."""
        latest = self._latest()
        return sorted(part for part, version in self._manifest(latest).items() if version == latest)

    def vacuum(self) -> None:
        """Delete the rows and manifests that the last manifest does not need. Readers of older ones lose their files."""
        latest = self._latest()
        needed = set(self._manifest(latest).values())
        for name, number in self._listed("manifest") + self._listed("rows"):
            if number != latest and not (name.startswith("rows") and number in needed):
                self._folder(f"{self.path}/{name}", delete=True)

    def _part(self, parts: int) -> Column:
        return F.pmod(F.xxhash64(*self._by, "component"), F.lit(parts)).cast("int").alias("part")

    def _write(self, rows: DataFrame, parts: int, version: int) -> None:
        # Adaptive execution splits parts that are larger than the others.
        dealt = rows.select("*", self._part(parts)).hint("rebalance", "part")
        # Rows without a manifest are left over from an update that was lost.
        dealt.write.mode("overwrite").partitionBy("part").parquet(f"{self.path}/rows-{version}")

    def _write_manifest(self, manifest: dict[int, int], version: int) -> None:
        rows = self._spark.createDataFrame(sorted(manifest.items()), "part int, version int")
        rows.coalesce(1).write.mode("overwrite").parquet(f"{self.path}/manifest-{version}")

    def _read(self, manifest: dict[int, int]) -> DataFrame:
        columns = self._spark.read.parquet(f"{self.path}/columns").schema
        frames = [self._spark.createDataFrame([], columns)]
        for version in sorted(set(manifest.values())):
            parts = [part for part, written in manifest.items() if written == version]
            if self._has_rows(version):
                rows = self._spark.read.parquet(f"{self.path}/rows-{version}")
                frames.append(rows.filter(F.col("part").isin(parts)).drop("part"))
        return reduce(DataFrame.unionByName, frames[1:] or frames)

    def _has_rows(self, version: int) -> bool:
        return any(name.startswith("part=") for name in self._folder(f"{self.path}/rows-{version}"))

    def _manifest(self, version: int) -> dict[int, int]:
        rows = self._spark.read.parquet(f"{self.path}/manifest-{version}").collect()
        return {row["part"]: row["version"] for row in rows}

    def _latest(self) -> int:
        versions = self._versions()
        if not versions:
            raise FileNotFoundError(f"no store in {self.path}")
        return max(versions)

    def _versions(self) -> list[int]:
        return [n for name, n in self._listed("manifest") if "_SUCCESS" in self._folder(f"{self.path}/{name}")]

    def _listed(self, kind: str) -> list[tuple[str, int]]:
        found = [re.fullmatch(rf"({kind})-(\d+)", name) for name in self._folder(self.path)]
        return [(match[0], int(match[2])) for match in found if match]

    def _folder(self, name: str, delete: bool = False) -> list[str]:
        """The names in a folder of any Hadoop file system."""
        context = self._spark.sparkContext
        path = context._jvm.org.apache.hadoop.fs.Path(name)
        system = path.getFileSystem(context._jsc.hadoopConfiguration())
        if delete:
            system.delete(path, True)
            return []
        if not system.exists(path):
            return []
        return [status.getPath().getName() for status in system.listStatus(path)]
