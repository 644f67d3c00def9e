"""Cube-method mixing."""

from __future__ import annotations

from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from archipelago.llm import mixing
from tests.llm import brute


def targets(sizes: dict) -> dict:
    """Water filling by repeated sharing."""
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: (3, 1, 2)[i % 3] for i, s in enumerate(names)}
    left, open_, out = 1.5 * sum(sizes.values()), set(names), {}
    while open_:
        level = left / sum(weight[s] for s in open_)
        over = {s for s in open_ if level * weight[s] >= 2 * sizes[s]}
        if not over:
            return out | {s: level * weight[s] for s in open_}
        out |= {s: 2.0 * sizes[s] for s in over}
        left -= sum(out[s] for s in over)
        open_ -= over
    return out


def check(mix, rows):
    sizes = Counter()
    for _, text, _, source in rows:
        sizes[source] += len(brute.WORD.findall(brute.utf8(text)))
    wanted, taken, documents = targets(sizes), Counter(), 0
    for row in mix:
        assert row["source_size"] == sizes[row["source"]]
        assert row["target"] == pytest.approx(wanted[row["source"]])
        assert row["copies"] in (0, 1, 2)
        taken[row["source"]] += row["rows"] * row["copies"] * row["size"]
        documents += row["rows"]
    assert documents == len(rows)
    return wanted, taken


def test_odd_rows(docs, rows):
    mix = mixing.mix_sources(docs).collect()
    check(mix, [r[:4] for r in rows])
    again = mixing.mix_sources(docs.repartition(7)).collect()
    assert sorted(map(repr, mix)) == sorted(map(repr, again))
    out = mixing.mixed(docs)
    assert out.columns == docs.columns
    assert out.count() == sum(r["rows"] * r["copies"] for r in mix)


def test_empty_table(no_docs):
    assert mixing.mix_sources(no_docs).collect() == []
    assert mixing.mixed(no_docs).collect() == []


def test_no_words(spark):
    docs = spark.createDataFrame([(1, " ", "a"), (2, None, None)], "doc_id bigint, text string, source string")
    assert [(r["size"], r["target"], r["copies"]) for r in mixing.mix_sources(docs).collect()] == [(0, 0.0, 0)] * 2


def test_taken_words_come_near_the_targets(spark, monkeypatch):
    """Several passes, and a source that holds most documents."""
    monkeypatch.setattr(mixing, "CHUNK", 64)
    draw = np.random.default_rng(4)
    rows = [
        (i, "w " * int(draw.lognormal(3, 1)), "en", None if i % 11 == 0 else "hot" if i % 3 else f"s{i % 7}")
        for i in range(3000)
    ]
    docs = spark.createDataFrame([(r[0], r[1], r[3]) for r in rows], "doc_id bigint, text string, source string")
    wanted, taken = check(mixing.mix_sources(docs).collect(), rows)
    for source, target in wanted.items():
        assert abs(taken[source] - target) <= 0.01 * target + 5


def test_a_document_with_a_third_of_the_words(spark):
    rows = []
    for source in ("a", "b", "c"):
        draw = np.random.default_rng(ord(source))
        sizes = [*draw.lognormal(3, 1, 500).astype(int).tolist()]
        sizes.append(sum(sizes) // 2)
        rows += [(len(rows) + i, "w " * size, "en", source) for i, size in enumerate(sizes)]
    docs = spark.createDataFrame([(r[0], r[1], r[3]) for r in rows], "doc_id bigint, text string, source string")
    mix = mixing.mix_sources(docs).collect()
    wanted, taken = check(mix, rows)
    for source, target in wanted.items():
        assert abs(taken[source] - target) <= 0.001 * target + 5


@pytest.mark.parametrize("large", [50, 150, 255])
def test_flight_decides_large_units(large):
    ones, expected = np.ones(501, np.int64), []
    for seed in range(100):
        size = np.append(large * 340, np.random.default_rng(seed).lognormal(5.3, 1, 500).astype(np.int64))
        size[0] = min(size[0], size[1:].sum() // 2)
        moved = mixing.flight(np.full(501, 0.5), ones, size, seed)
        assert moved[0] in (0, 1) and ((moved > 0) & (moved < 1)).sum() <= 2
        assert moved @ size == pytest.approx(size.sum() / 2, rel=1e-6)
        expected.append(moved[0])
    assert np.mean(expected) == pytest.approx(0.5, abs=0.2)


def test_flight_beside_units_without_words():
    chance, ones, size = np.full(41, 0.5), np.ones(41, np.int64), np.array([100] + [0] * 40)
    moved = mixing.flight(chance, ones, size, 1)
    assert ((moved >= 0) & (moved <= 1)).all() and ((moved > 0) & (moved < 1)).sum() <= 2


def test_flight_keeps_totals():
    draw = np.random.default_rng(0)
    chance, ones, size = draw.random(500), np.ones(500, np.int64), draw.integers(0, 900, 500)
    moved = mixing.flight(chance, ones, size, 1)
    assert ((moved > 0) & (moved < 1)).sum() <= 2
    assert moved.sum() == pytest.approx(chance.sum(), abs=1e-4)
    assert (moved * size).sum() == pytest.approx((chance * size).sum(), rel=1e-6)


def test_flight_keeps_inclusion_probabilities():
    chance, ones, size = np.array([0.2, 0.5, 0.8, 0.5]), np.ones(4, np.int64), np.array([5, 1, 9, 3])
    mean = np.mean([mixing.flight(chance, ones, size, seed) for seed in range(4000)], axis=0)
    assert mean == pytest.approx(chance, abs=0.03)


def test_numbering(spark):
    df = spark.range(1000).select((F.col("id") * 37 % 1000).alias("value"))
    assert [r["number"] for r in mixing.numbered(df, "value").orderBy("value").collect()] == list(range(1000))
