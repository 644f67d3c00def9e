"""Exact copies of texts, with the frequent ones removed map-side; DataFrame and SQL functions only.

A text's key is its SHA-256 digest after lower-casing A-Z. One key may hold a third of all rows, so keys
are split in two kinds before anything is shuffled by them:

1. Misra-Gries counting over all digests (``freqItems``, with partial counters in every task) names every digest
   that holds more than ``SUPPORT`` of the rows. It may name others too, but never more than ``1 / SUPPORT`` in all.
2. The named ones are verified: an exact count and the row that stays, from sums that combine before the
   shuffle. These few winners, one row per named digest, are broadcast, and their rows get their verdict in the task
   that reads them.
3. The remaining digests, none of which is frequent, are grouped by an ordinary shuffle.
"""

from __future__ import annotations

import string

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from archipelago.llm.tables import written

# A digest with a larger share of the rows is frequent. Counters and broadcast rows are 1 / SUPPORT at most, about
# 100 bytes each.
SUPPORT = 0.0002


def normalised(text: Column | str) -> Column:
    """The text with A-Z lower-cased and everything else as it is; null is empty."""
    given = F.coalesce(text, F.lit(""))
    # Where all characters are ASCII this is what lower() does, which is much faster.
    plain = F.octet_length(given) == F.char_length(given)
    return F.when(plain, F.lower(given)).otherwise(
        F.translate(given, string.ascii_uppercase, string.ascii_lowercase)
    )


def frequent_digests(keyed: DataFrame, support: float = SUPPORT) -> DataFrame:
    """``digest``: all digests with more than ``support`` of the rows, and perhaps others; ``1 / support`` at most."""
    return keyed.freqItems(["digest"], support).select(F.explode("digest_freqItems").alias("digest"))


def _winners(keyed: DataFrame) -> DataFrame:
    """``digest, winner, group_size``: exact, and combined before the shuffle."""
    # A row without id only stays where no row has one: nulls are the smallest.
    return keyed.groupBy("digest").agg(
        F.max(F.struct("doc_id", "row")).alias("winner"), F.count(F.lit(1)).alias("group_size")
    )


def judged(keyed: DataFrame, support: float = SUPPORT) -> DataFrame:
    """``keyed`` (``doc_id, row, digest``; read several times) with ``winner`` and ``group_size``."""
    named = F.broadcast(frequent_digests(keyed, support))
    verified = F.broadcast(written(_winners(keyed.join(named, "digest", "left_semi")), "frequent-copies"))
    rest = keyed.join(verified, "digest", "left_anti")
    removed = keyed.join(verified, "digest")
    return removed.unionByName(rest.join(_winners(rest), "digest"))


def _keyed(docs: DataFrame) -> DataFrame:
    return docs.withColumns(
        {"row": F.monotonically_increasing_id(), "digest": F.sha2(normalised("text"), 256)}
    )


def exact_copies(docs: DataFrame, support: float = SUPPORT) -> DataFrame:
    """``doc_id, keep_id, group_size, kept, text_sha256``: one row for each row of ``docs``.

    Texts are equal when identical after lower-casing A-Z. Of equal texts the row with the largest ``doc_id``
    stays, and ``keep_id`` is its id. A null text is empty, and empty texts are equal. A row without id stays only if
    no equal text has one; then, and among rows of one id and text, one of them stays. An empty table gives
    an empty result. Other columns are not read.
    """
    keyed = written(_keyed(docs.select("doc_id", "text")).drop("text"), "digests")
    return judged(keyed, support).select(
        "doc_id",
        F.col("winner.doc_id").alias("keep_id"),
        "group_size",
        (F.col("row") == F.col("winner.row")).alias("kept"),
        F.col("digest").alias("text_sha256"),
    )


def drop_exact_copies(docs: DataFrame, support: float = SUPPORT) -> DataFrame:
    """The rows of ``docs`` that stay (see :func:`exact_copies`), with all their columns.

    The table is written once with row numbers, so that a row is the same one each time it is read.
    """
    held = written(_keyed(docs.select("doc_id", "text", F.struct("*").alias("doc"))).drop("text"), "keyed")
    kept = judged(held.drop("doc"), support).filter(F.col("row") == F.col("winner.row"))
    return held.join(kept.select("row"), "row", "left_semi").select("doc.*")
