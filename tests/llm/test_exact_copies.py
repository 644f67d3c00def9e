"""Exact copies against a dictionary of texts."""

from __future__ import annotations

import hashlib
import string
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from archipelago.llm import exact_copies
from tests.llm.conftest import SCHEMA, same

LOWER = str.maketrans(string.ascii_uppercase, string.ascii_lowercase)


def brute(rows):
    """``doc_id, keep_id, group_size, text_sha256`` of each row, and how many rows of each digest stay: one."""
    groups = defaultdict(list)
    for doc_id, text, *_ in rows:
        groups[(text or "").translate(LOWER)].append(doc_id)
    out = []
    for text, ids in groups.items():
        keep = max((i for i in ids if i is not None), default=None)
        out += [(i, keep, len(ids), hashlib.sha256(text.encode()).hexdigest()) for i in ids]
    return out


@pytest.mark.parametrize("support", [exact_copies.SUPPORT, 0.02, 0.5])
def test_brute_force(spark, docs, rows, support):
    """At 0.5 nothing is frequent, at 0.0002 every digest of so small a table may be."""
    found = exact_copies.exact_copies(docs, support).collect()
    same([(r.doc_id, r.keep_id, r.group_size, r.text_sha256) for r in found], brute(rows))
    kept = [r.text_sha256 for r in found if r.kept]
    assert sorted(kept) == sorted({r.text_sha256 for r in found})
    assert all(r.doc_id == r.keep_id for r in found if r.kept)


def test_only_ascii_is_lowered(spark):
    rows = [(1, "ÄB"), (2, "äB"), (3, "äb"), (4, "\u212a"), (5, "k"), (6, "K"), (7, "\u0130")]
    rows += [(8, None), (9, "")]
    found = exact_copies.exact_copies(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()
    assert {r.doc_id: r.keep_id for r in found} == {1: 1, 2: 3, 3: 3, 4: 4, 5: 6, 6: 6, 7: 7, 8: 9, 9: 9}


def test_misra_gries_names_all_frequent_digests(spark):
    """Digests above the support are named whatever the order of the rows, and never more than counters."""
    keyed = spark.range(20_000).select(
        F.when(F.col("id") % 7 == 0, F.lit("seventh")).when(F.col("id") % 101 == 1, F.lit("few"))
        .otherwise(F.sha2(F.col("id").cast("string"), 256)).alias("digest"),
    ).repartition(6)
    named = [r.digest for r in exact_copies.frequent_digests(keyed, 0.005).collect()]
    assert {"seventh", "few"} <= set(named)
    assert len(named) == len(set(named)) <= 200


def test_frequent_copies_are_not_shuffled_by_digest(spark):
    """Half of the rows are copies: no exchange by digest sees them."""
    docs = spark.range(4000).select(
        F.col("id").alias("doc_id"),
        F.when(F.col("id") % 2 == 0, F.lit("Same Text")).otherwise(F.col("id").cast("string")).alias("text"),
    )
    keyed = exact_copies.written(exact_copies._keyed(docs).drop("text"), "digests")
    verdicts = exact_copies.judged(keyed, 0.01)
    assert verdicts.filter("digest = sha2('same text', 256)").select("group_size", "winner.doc_id").distinct().collect() == [(2000, 3998)]
    plan = verdicts._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan
    assert "Python" not in plan and "Arrow" not in plan and "CartesianProduct" not in plan


def test_dropping_keeps_columns(spark, docs, rows):
    left = exact_copies.drop_exact_copies(docs)
    assert left.columns == docs.columns
    kept = left.select("doc_id", "text", "lang").collect()
    assert len(kept) == len({(t or "").translate(LOWER) for _, t, *_ in rows})
    assert set(map(tuple, kept)) <= {r[:3] for r in rows}


def test_empty_table(spark, no_docs):
    assert exact_copies.exact_copies(no_docs).count() == 0
    assert exact_copies.drop_exact_copies(no_docs).count() == 0


def test_all_rows_alike(spark):
    docs = spark.createDataFrame([(None, "a"), (None, "A"), (None, "a")], "doc_id bigint, text string")
    found = exact_copies.exact_copies(docs).collect()
    assert [r.kept for r in found].count(True) == 1 and {r.group_size for r in found} == {3}
    assert {r.keep_id for r in found} == {None}


def test_schema(spark, docs):
    assert exact_copies.exact_copies(docs).drop("text_sha256").dtypes == [
        ("doc_id", "bigint"), ("keep_id", "bigint"), ("group_size", "bigint"), ("kept", "boolean"),
    ]
    assert SCHEMA.startswith("doc_id bigint, text string")
