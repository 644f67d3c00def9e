"""Quality rules with robust outliers."""

from __future__ import annotations

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from archipelago.llm import quality
from tests.llm import brute
from tests.llm.conftest import same


def test_counts_against_brute_force(docs, rows):
    found = quality.judged(docs).select("doc_id", *quality.COUNTS, "base_failed").collect()
    expected = []
    for doc_id, text, *_ in rows:
        counts = brute.text_counts(text)
        expected.append((doc_id, *counts, counts[0] < 20 or 100 * counts[4] > 30 * counts[0]))
    same(found, expected)


def test_empty_table(no_docs):
    assert quality.judged(no_docs).collect() == []
    assert quality.reject_outliers(no_docs).collect() == []


def test_too_few_to_judge_are_kept(docs, rows):
    for row in quality.judged(docs).collect():
        assert row["kept"] != row["base_failed"]
    kept = quality.reject_outliers(docs)
    assert kept.columns == docs.columns
    wanted = [r for r in rows if not ((c := brute.text_counts(r[1]))[0] < 20 or 100 * c[4] > 30 * c[0])]
    same(kept.select("doc_id", "text", "lang", "source", "n_chars").collect(), wanted)


def test_outliers_go_and_clean_documents_stay(spark):
    draw = random.Random(1)
    words = ["".join(draw.choices("abcdefgh", k=draw.randint(2, 9))) for _ in range(500)]
    rows = []
    for i in range(600):
        said = draw.choices(words, k=draw.randint(40, 200))
        if i % 10 == 0:
            said = [w + "###" for w in said]
        elif i % 10 == 1:
            said = [w.upper() for w in said]
        rows.append((i, " ".join(said) + ".", "en", "big" if i % 3 else f"small{i % 7}"))
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string")
    kept = {r["doc_id"] for r in quality.reject_outliers(docs).collect()}
    assert not [i for i in range(600) if i % 10 < 2 and i in kept]
    assert len([i for i in range(600) if i % 10 >= 2 and i in kept]) == 480


def test_sources_of_mostly_short_documents_are_pooled(spark):
    draw = random.Random(2)
    words = ["".join(draw.choices("abcdefgh", k=draw.randint(2, 9))) for _ in range(500)]
    rows = [(i, " ".join(draw.choices(words, k=5)), "en", "short") for i in range(300)]
    for i in range(300, 600):
        said = draw.choices(words, k=draw.randint(40, 200))
        if 300 <= i < 306:
            said = [w + "###" for w in said]
        rows.append((i, " ".join(said) + ".", "en", "short" if i < 360 else f"small{i % 6}"))
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string")
    assert {r["doc_id"] for r in quality.reject_outliers(docs).collect()} == set(range(306, 600))


def test_chi_square():
    assert quality.chi_square(3.0, 2) == pytest.approx(0.7768698, abs=1e-6)
    assert quality.chi_square_quantile(0.95, 6) == pytest.approx(12.5916, abs=1e-3)
    assert quality.chi_square(0, 4) == 0


def marked(draw, capitals, punctuation, words=150):
    """Text whose roots of the shares of capitals and punctuation are about these."""
    letters = [draw.choice("abcdefgh") for _ in range(words * 6)]
    size = len(letters) / (1 - punctuation**2)
    for i in draw.sample(range(len(letters)), int(capitals**2 * size)):
        letters[i] = letters[i].upper()
    marks = [""] * words
    for _ in range(int(punctuation**2 * size)):
        marks[draw.randrange(words)] += "."
    return " ".join("".join(letters[6 * i : 6 * i + 6]) + marks[i] for i in range(words))


@pytest.fixture(scope="module")
def correlated():
    """Texts with as many capitals as punctuation marks, a few or many, and 40 of 400 where one goes without the other."""
    draw = random.Random(7)
    rows = []
    for i in range(400):
        a, b = draw.uniform(0.1, 0.5), 0.0
        b = min(0.5, max(0.1, a + draw.gauss(0, 0.01)))
        if i % 10 == 0:
            a, b = draw.choice([(0.48, 0.12), (0.12, 0.48)])
        rows.append((i, marked(draw, a, b), "en", "one"))
    return rows


def verdicts(spark, rows):
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string")
    return {r["doc_id"]: r for r in quality.judged(docs).collect()}


def test_correlated_outliers(spark, correlated, monkeypatch):
    """No single statistic shows them: only the estimate does, and only after its steps."""
    found = verdicts(spark, correlated)
    assert [i for i, r in sorted(found.items()) if not r["kept"]] == list(range(0, 400, 10))
    monkeypatch.setattr(quality, "FIRST_STEPS", 0)
    monkeypatch.setattr(quality, "STEPS", 0)
    assert all(r["kept"] for r in verdicts(spark, correlated).values())


def test_estimate_against_brute_force(spark, correlated):
    """The same distances as a plain model with the same bins, and nearly those of the exact closest part."""
    docs = spark.createDataFrame(correlated, "doc_id bigint, text string, lang string, source string")
    keyed = docs.select("doc_id", F.col("doc_id").alias("a"), F.lit(0).alias("b"), "text")
    rows = quality.text_statistics(keyed, "doc_id", "a", "b")
    z = quality._standardised(rows.withColumns({"grp": F.lit("g"), "fit": ~quality.base_failed()}))
    z = quality.written(z, "z")
    estimate = quality.minimum_determinant(z).df.collect()
    assert len(estimate) == 1
    estimate = estimate[0]
    plain = np.array([r[1:] for r in sorted(z.select("a", *[f"z_{n}" for n in quality.VECTOR]).collect())], float) / quality.STEP
    size = plain.shape[1]
    length = (plain**2).sum(1)
    signs = plain * np.sqrt(size / np.where(length > 0, length, 1))[:, None]
    zero = np.zeros(size)
    starts = [(zero, np.eye(size)), (zero, plain.T @ plain / len(plain)), (zero, signs.T @ signs / len(plain))]
    correction = quality.PART / quality.chi_square(quality.chi_square_quantile(quality.PART, size), size + 2)
    options = plain, quality.PART, quality.LEAST_VARIANCE, starts, correction
    centre, inverse, logdet, _ = brute.closest_part(
        *options, bins=quality.BINS, first_steps=quality.FIRST_STEPS, enough=quality.ENOUGH
    )
    assert estimate["logdet"] == pytest.approx(logdet, abs=1e-6)
    assert estimate["centre"] == pytest.approx(centre.tolist(), abs=1e-6)
    assert estimate["inverse"] == pytest.approx(inverse.ravel().tolist(), abs=1e-5)
    *_, exact, distances = brute.closest_part(*options)
    # Whole bins hold a little more than the part.
    assert exact <= estimate["logdet"] + 1e-9 < exact + 0.5
    assert sorted(np.flatnonzero(distances > quality.CUTOFF).tolist()) == list(range(0, 400, 10))
