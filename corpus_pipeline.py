"""A training corpus from raw documents, in five stages.

Quality outliers go, one document of each group of near copies stays, documents with benchmark passages
go, sources are mixed to their targets, and the mix is written as token files. Each stage's rows are
written to the shared folder and read back as the next one's input, so a lost executor costs
tasks of one stage only.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from archipelago.llm import decontaminate, mixing, near_copies, quality
from archipelago.llm.queries import token_digests
from archipelago.llm.tables import scratch, table
from archipelago.sources.round_tables import RoundTables

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the fixed rules and are no outliers of their language and source."""
    return quality.reject_outliers(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest id of each group of near copies."""
    return near_copies.drop_near_copies(docs)


def benchmark_decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no window of a benchmark item."""
    return decontaminate.drop_contaminated(docs, table(spark, sf_dir, "benchmark"))


def source_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document as often as the mix takes it: not at all, once or twice."""
    return mixing.mixed(docs)


def token_output(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """``doc_id, start, n_tokens, ids_crc32``: the token file of the mix, read back."""
    return token_digests(docs)


STAGES: list[tuple[str, Stage]] = [
    ("quality_rules", quality_rules),
    ("near_dedup", near_dedup),
    ("benchmark_decontamination", benchmark_decontamination),
    ("source_mix", source_mix),
    ("token_output", token_output),
]

# The stages iterate, sample and encode, which SQL can't express.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages, one after the other, over the whole table of documents."""
    docs, kept = table(spark, sf_dir, "documents"), RoundTables(spark)
    last = None
    for name, stage in STAGES:
        # A stage's own tables go when its rows are written, and these when the next stage's are.
        with scratch(spark):
            rows = kept.write(stage(spark, docs, sf_dir), name)
        if last is not None:
            kept.drop(last)
        docs, last = rows.df, rows
    return docs
