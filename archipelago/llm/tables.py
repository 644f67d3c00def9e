"""Intermediate tables, row identities and text shards shared by the operators."""

from __future__ import annotations

import contextlib
from collections.abc import Iterator
from contextvars import ContextVar
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from archipelago.llm.arrays import pieces, utf8
from archipelago.sources.round_tables import RoundTables

# Bytes of text in a shard, and in one row of it.
SHARD_BYTES = 8 << 20
ROW_BYTES = 1 << 20
# The largest side of a join that is broadcast.
BROADCAST_BYTES = 32 << 20


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """One of the tables in a folder of Parquet tables."""
    return spark.read.parquet(f"{folder}/{name}.parquet")


_tables: ContextVar[RoundTables | None] = ContextVar("_tables", default=None)


@contextlib.contextmanager
def scratch(spark: SparkSession, folder: str | None = None) -> Iterator[RoundTables]:
    """The intermediate tables of all operators called in a ``with`` block, deleted at its end.

    What the operators return reads these tables, so it has to be written elsewhere before. Without such a
    block the tables stay in the shared folder.
    """
    with RoundTables(spark, folder) as tables:
        token = _tables.set(tables)
        try:
            yield tables
        finally:
            _tables.reset(token)


def run_tables(spark: SparkSession) -> RoundTables:
    """Where operators put their intermediate tables."""
    return _tables.get() or RoundTables(spark)


def written(df: DataFrame, name: str) -> DataFrame:
    """Compute ``df`` once, as a table in the shared folder, and read it back."""
    return run_tables(df.sparkSession).write(df, name).df


def small_side(df: DataFrame, name: str, most: int = BROADCAST_BYTES) -> DataFrame:
    """A side of a join with rows of a few numbers, written and counted; broadcast if it has ``most`` bytes at most.

    A larger one is joined as Spark sees fit. The rows that come out are the same.
    """
    side = run_tables(df.sparkSession).write(df, name)
    fits = side.rows * 8 * (len(df.columns) + 1) <= most
    return F.broadcast(side.df) if fits else side.df


def row_key(*columns: Column | str) -> Column:
    """128 bits that identify a row by the values of some columns; null differs from any value."""
    parts = []
    for column in columns:
        column = F.col(column) if isinstance(column, str) else column
        parts += [column.isNull(), column]
    return F.struct(F.xxhash64(*parts).alias("a"), F.xxhash64(F.lit(0x5EED), *parts).alias("b"))


def text_bytes(docs: DataFrame) -> int:
    """UTF-8 bytes of all texts."""
    return docs.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]


def part_count(total_bytes: int, share: int = SHARD_BYTES) -> int:
    """In how many parts to deal what is gathered from so many bytes of text."""
    return max(16, -(-total_bytes // share))


def to_ipc(batch: pa.RecordBatch) -> bytes:
    sink = pa.BufferOutputStream()
    options = pa.ipc.IpcWriteOptions(compression=pa.Codec("zstd", compression_level=3))
    with pa.ipc.new_stream(sink, batch.schema, options=options) as writer:
        writer.write_batch(batch)
    return sink.getvalue().to_pybytes()


def from_ipc(values: list[bytes]) -> pa.Table:
    return pa.concat_tables([pa.ipc.open_stream(value).read_all() for value in values])


def text_shards(docs: DataFrame) -> DataFrame:
    """``shard, payload``: the rows of ``docs`` as compressed pieces, written once.

    Shards have about ``SHARD_BYTES`` of text (more only where a single text is longer). They are
    numbered while they are written, so all later readers see the same shards, whichever task or
    executor reads them.
    """
    place = docs.columns.index("text")

    def shard(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        number, filled = TaskContext.get().partitionId() << 32, 0
        for batch in batches:
            _, limits = utf8(batch.column(place))
            for first, end in pieces(limits, ROW_BYTES):
                size = int(limits[end] - limits[first])
                if filled and filled + size > SHARD_BYTES:
                    number, filled = number + 1, 0
                filled += size
                payload = to_ipc(batch.slice(first, end - first))
                yield pa.RecordBatch.from_pydict(
                    {"shard": pa.array([number], pa.int64()), "payload": pa.array([payload], pa.binary())}
                )

    return written(docs.mapInArrow(shard, "shard bigint, payload binary"), "text-shards")


def by_shard(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, pa.Table]]:
    """The rows of each shard, from a task's batches of :func:`text_shards`."""
    shard, payloads = None, []
    for batch in batches:
        for number, payload in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            if number != shard and payloads:
                yield shard, from_ipc(payloads)
                payloads = []
            shard = number
            payloads.append(payload)
    if payloads:
        yield shard, from_ipc(payloads)


def spread_join(rows: DataFrame, small: DataFrame, on: list[str], by: str, how: str = "inner", parts: int = 32) -> DataFrame:
    """Join where one key may hold a large part of ``rows``.

    The rows of a key are dealt to ``parts`` tasks by a hash of their column ``by``; each row of
    ``small`` (one for each key) is there once for every one of them.
    """
    many = small.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(parts - 1))))
    salted = rows.withColumn("_salt", F.pmod(F.xxhash64(by), F.lit(parts)).cast("int"))
    return salted.join(many, [*on, "_salt"], how).drop("_salt")


def union(*frames: DataFrame) -> DataFrame:
    return reduce(DataFrame.unionByName, frames)
