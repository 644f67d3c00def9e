"""Token ids of documents in compressed block files.

A file is a folder with two Parquet tables: ``table`` has the frequency table all blocks share, ``blocks``
has one row per block of :mod:`archipelago.llm.rans`, with the documents in it. A block holds whole
documents, in ascending order of ``doc_id``, and can be read without any other. ``first_id`` is the
number of ids in all blocks before it.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from archipelago.llm.arrays import pieces, release, utf8
from archipelago.llm.pretokens import PieceEncoder
from archipelago.llm.rans import Decoder, Frequencies, encode
from archipelago.llm.tables import run_tables, written

# Ids of a block, unless a single document has more.
BLOCK = 1 << 20
# Bytes of text that are cut into pieces at a time.
_PIECE = 1 << 19


def _encoder(tokenizer_json: str, end: int) -> PieceEncoder:
    """The encoder of this Python process: its memory serves all tasks that run in it."""
    import os

    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    import tokenizers

    key = (zlib.crc32(tokenizer_json.encode()), end)
    held = getattr(tokenizers, "_piece_encoder", None)
    if held is None or held[0] != key:
        held = (key, PieceEncoder(tokenizer_json, end, added=True))
        tokenizers._piece_encoder = held
    return held[1]


def _squeeze(ids: np.ndarray) -> bytes:
    """Ids by byte planes, which compress better apart."""
    planes = ids.astype("<u4").view(np.uint8).reshape(-1, 4)
    return zstandard.ZstdCompressor(level=1).compress(np.ascontiguousarray(planes.T).tobytes())


def _spread(value: bytes) -> np.ndarray:
    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(value), np.uint8).reshape(4, -1)
    return np.ascontiguousarray(planes.T).view("<u4").ravel()


_UNCODED = "part int, within bigint, doc_ids array<bigint>, sizes array<bigint>, n_ids bigint, ids binary"


def tokenized(docs: DataFrame, tokenizer_json: str, end: int) -> DataFrame:
    """Blocks of uncoded ids (``_UNCODED``) in ascending ``doc_id`` order of ``part`` and ``within``.

    ``within`` is the number of ids of the blocks before it in its part.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, encoder = TaskContext.get().partitionId(), _encoder(tokenizer_json, end)
        doc_ids: list = []
        sizes: list[np.ndarray] = []
        ids: list[np.ndarray] = []
        within = held = 0

        def block() -> pa.RecordBatch:
            values = [[part], [within], [doc_ids], [np.concatenate(sizes)], [held], [_squeeze(np.concatenate(ids))]]
            kinds = [pa.int32(), pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.int64(), pa.binary()]
            names = ["part", "within", "doc_ids", "sizes", "n_ids", "ids"]
            return pa.RecordBatch.from_arrays([pa.array(v, k) for v, k in zip(values, kinds, strict=True)], names=names)

        for batch in batches:
            _, limits = utf8(batch.column(1))
            for first, last in pieces(limits, _PIECE):
                own = batch.slice(first, last - first)
                new, counts = encoder.encode(own.column(1))
                if held and held + len(new) > BLOCK:
                    yield block()
                    within, held, doc_ids, sizes, ids = within + held, 0, [], [], []
                doc_ids += own.column(0).to_pylist()
                sizes.append(counts)
                ids.append(new.astype(np.uint32))
                held += len(new)
        if doc_ids:
            yield block()
        release()

    texts = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text")
    in_order = texts.repartitionByRange("doc_id").sortWithinPartitions("doc_id", "text")
    return written(in_order.mapInArrow(run, _UNCODED), "token-ids")


def frequencies(blocks: DataFrame, most: int) -> Frequencies:
    """The shared table, from the counts of all ids (all below ``most``, the tokenizer's size)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(most, np.int64)
        for batch in batches:
            for value in batch.column(0).to_pylist():
                counts += np.bincount(_spread(value), minlength=most)
        seen = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(seen), pa.array(counts[seen])], names=["id", "n"])

    # At most one row for each token of the vocabulary.
    rows = blocks.select("ids").mapInArrow(run, "id bigint, n bigint").groupBy("id").agg(F.sum("n").alias("n"))
    counts = np.zeros(most, np.int64)
    for row in rows.collect():
        counts[row["id"]] = row["n"]
    return Frequencies.from_counts(counts)


def write_tokens(docs: DataFrame, tokenizer_json: str, path: str, end: int = 2) -> None:
    """Encode ``text`` of all documents and write a file to ``path``.

    A null text is empty; strings of added tokens are those tokens, as the tokenizer has it by default;
    every document ends with the id ``end``. Documents are in ascending order of
    ``doc_id``, those without one first, repeated ones in the order of their texts. An empty table gives a
    file without blocks. Other columns are not read.
    """
    from tokenizers import Tokenizer

    most = max(Tokenizer.from_str(tokenizer_json).get_vocab_size(), end + 1)
    uncoded = tokenized(docs, tokenizer_json, end)
    table = frequencies(uncoded, most)
    spark = docs.sparkSession
    share = bytearray(table.share.astype("<u4").tobytes())
    spark.createDataFrame([(share, table.checksum())], "share binary, checksum bigint").write.parquet(f"{path}/table")

    # One row for each partition.
    parts = uncoded.groupBy("part").agg(F.sum("n_ids").alias("n_ids"))
    earlier = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.select("part", F.coalesce(F.sum("n_ids").over(earlier), F.lit(0)).alias("before"))
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = batch.schema.get_field_index("ids")
            coded = [encode(_spread(value), table) for value in batch.column(at).to_pylist()]
            yield batch.set_column(at, "block", pa.array(coded, pa.binary()))

    schema = _UNCODED.replace("ids binary", "block binary")
    coded = uncoded.mapInArrow(run, schema)
    first = (F.col("before") + F.col("within")).alias("first_id")
    blocks = coded.join(F.broadcast(parts), "part").select(first, "doc_ids", "sizes", "n_ids", "block")
    blocks.write.parquet(f"{path}/blocks")
    # The driver is done with its tokenizer and counts: what is free of them goes back, as for tasks.
    release()


def read_tokens(spark: SparkSession, path: str) -> DataFrame:
    """``doc_id, start, n_tokens, ids_crc32, ids``: the documents of a file.

    ``start`` is the number of ids of all documents before, ``ids`` are little-endian unsigned 32-bit
    integers, ``ids_crc32`` is their checksum.
    """
    saved = spark.read.parquet(f"{path}/table").first()
    table = Frequencies.of(np.frombuffer(bytes(saved["share"]), "<u4"))
    if table.checksum() != saved["checksum"]:
        raise ValueError("the frequency table is damaged")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        decoder = Decoder(table)
        for batch in batches:
            for row in range(len(batch)):
                first, doc_ids, sizes = batch.column(0)[row].as_py(), batch.column(1)[row].values, batch.column(2)[row]
                sizes = sizes.values.to_numpy()
                raw = decoder.decode(batch.column(3)[row].as_py()).astype("<u4").tobytes()
                ends = np.cumsum(sizes)
                starts = ends - sizes
                values = [raw[4 * a : 4 * b] for a, b in zip(starts.tolist(), ends.tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays(
                    [
                        doc_ids,
                        pa.array(first + starts),
                        pa.array(sizes),
                        pa.array([zlib.crc32(value) for value in values], pa.int64()),
                        pa.array(values, pa.binary()),
                    ],
                    names=["doc_id", "start", "n_tokens", "ids_crc32", "ids"],
                )
        release()

    schema = "doc_id bigint, start bigint, n_tokens bigint, ids_crc32 bigint, ids binary"
    blocks = spark.read.parquet(f"{path}/blocks").select("first_id", "doc_ids", "sizes", "block")
    return blocks.mapInArrow(run, schema)


def new_path(spark: SparkSession) -> str:
    """A path in the shared folder for a file that only this run needs."""
    return run_tables(spark).new_path("tokens")
