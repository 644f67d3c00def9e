from __future__ import annotations

import random

import pytest

# Names that the operators use inside, as extra columns of the input.
CLASHING = ("a", "b", "shard", "part", "payload", "node", "grp", "bin", "size", "rows", "line", "places", "spans", "items",
            "n_words", "copies", "kept", "key", "_key", "registers", "bucket", "number", "target", "title")
SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint"


def corpus(seed: int = 5, size: int = 60) -> list[tuple]:
    """Documents with copies, near copies, shared lines and passages, nulls, empty and odd texts, and repeated rows."""
    draw = random.Random(seed)
    vocabulary = ["".join(draw.choices("abcdeéñ", k=draw.randint(2, 6))) for _ in range(300)]
    shared = [" ".join(draw.choices(vocabulary, k=14)) for _ in range(4)]
    texts: list[str | None] = []
    for i in range(size):
        lines = [" ".join(draw.choices(vocabulary, k=draw.randint(3, 30))) for _ in range(draw.randint(1, 6))]
        if i % 3 == 0:
            lines.insert(draw.randint(0, len(lines)), f"  {draw.choice(shared).upper()}\t")
        texts.append("\n".join(lines))
    for i in range(0, 20, 2):
        words = texts[i].split(" ")
        words[len(words) // 2] = "changed"
        texts.append(" ".join(words))
    texts += [texts[1], texts[1], texts[7].upper(), None, "", " \n\t ", "one", "one two three", "One two three"]
    texts += ["x" * 400, "x" * 399, "ab " * 200, "ab " * 201, "\n\n", "### *** $$$ " * 30, "日本語 " * 30, "'s don't   x"]
    texts.append(" ".join(draw.choices(vocabulary, k=20_000)))
    rows = [(i, t, draw.choice(["en", "de"]), f"src{i % 3}", len(t or "")) for i, t in enumerate(texts)]
    rows += [rows[3], rows[3], (None, texts[2], "en", None, 1), (None, None, None, "src1", None), (None, "lost words", None, None, 0)]
    draw.shuffle(rows)
    return rows


@pytest.fixture(scope="session")
def rows():
    return corpus()


@pytest.fixture(scope="session")
def docs(spark, rows):
    """The corpus, with extra columns whose names the operators use themselves."""
    from pyspark.sql import functions as F

    plain = spark.createDataFrame(rows, SCHEMA)
    return plain.withColumns({name: F.lit(f"extra {name}") for name in CLASHING}).repartition(3)


@pytest.fixture(scope="session")
def no_docs(docs):
    return docs.limit(0)


def same(found, expected) -> None:
    """Rows are equal in any order."""

    def order(row):
        return repr(row)

    found, expected = sorted((tuple(r) for r in found), key=order), sorted((tuple(r) for r in expected), key=order)
    assert found == expected
