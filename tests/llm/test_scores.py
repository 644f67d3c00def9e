"""Prediction by partial matching."""

from __future__ import annotations

import random

import numpy as np
import pytest

from archipelago.llm import ppm
from tests.llm import brute


def test_against_brute_force(docs, rows):
    pairs = [r[:2] for r in rows]
    expected = sorted(brute.ppm(pairs, ppm.ORDER), key=lambda r: (repr(r[0]), r[2], r[6]))
    found = sorted(map(tuple, ppm.ppm_scores(docs).collect()), key=lambda r: (repr(r[0]), r[2], r[6]))
    assert len(found) == len(expected)
    for a, b in zip(found, expected, strict=True):
        assert a[:5] == b[:5]
        assert a[5:] == pytest.approx(b[5:], rel=1e-5)


def test_empty_table(no_docs):
    assert ppm.ppm_scores(no_docs).collect() == []


def test_nothing_to_learn_from(spark):
    # 2 is a held-out id.
    held_out = next(i for i in range(100) if brute.held_out(i))
    row = ppm.ppm_scores(spark.createDataFrame([(held_out, "ab")], "doc_id bigint, text string")).first()
    assert row["held_out"] and row["n_tokens"] == 2 and row["n_known"] == 0 and row["train_tokens"] == 0
    assert row["score"] == pytest.approx(3 * -np.log10(256), rel=1e-5)
    assert row["base_score"] == 0


def test_a_context_predicts_a_distribution():
    data = np.frombuffer(b"abracadabra" * 3 + b"alakazam", np.uint8)
    events, _ = ppm._events(data, np.array([0, len(data)]))
    found, counts = np.unique(events, return_counts=True)
    trie = ppm.Trie(ppm._shorter(found, counts, ppm.ORDER, 0))
    every = np.arange(256, dtype=np.uint64)
    for context in (b"abrac", b"zzzzz", b"\0\0\0ab", b"dabra"):
        number = int.from_bytes(context, "big")
        total = (10 ** trie.log10((np.uint64(number) << np.uint64(8)) | every)).sum()
        assert total == pytest.approx(1, abs=1e-9)


def test_held_out_text_is_between_the_source_and_single_words(spark):
    """Sentences from a list: what the source itself takes to name them is the least, their words one by one are more."""
    draw = random.Random(2)
    vocabulary = ["".join(draw.choices("abcdefghij", k=draw.randint(3, 8))) for _ in range(200)]
    sentences = [" ".join(draw.choices(vocabulary, k=9)) for _ in range(24)]
    said = [draw.choices(sentences, k=12) for _ in range(300)]
    docs = spark.createDataFrame([(i, ". ".join(text)) for i, text in enumerate(said)], "doc_id bigint, text string")
    rows = ppm.ppm_scores(docs).filter("held_out").collect()
    source = -12 * len(rows) * np.log10(len(sentences))
    score, base = sum(r["score"] for r in rows), sum(r["base_score"] for r in rows)
    assert len(rows) > 20
    assert base < score < source
    # Five bytes of context tell the sentence most of the time, after its first words.
    assert score > base / 2
