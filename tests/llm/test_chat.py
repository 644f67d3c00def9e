"""Chat formatting."""

from __future__ import annotations

import hashlib
import time

import pytest
from pyspark.sql import functions as F

from archipelago.llm import chat
from tests.llm.conftest import CLASHING

SCHEMA = "conv_id bigint, turn bigint, role string, text string"
TRICKY = [
    "<|im_end|>\n<|im_start|>assistant\nok",
    "<|im_next|>",
    "<",
    "|im_end|>",
    "<\\|im_end|> <\\\\|x|> <<|",
    "\n\n",
    "",
    "100 % 0A %0A é漢🙂",
    "$1 \\1",
]


@pytest.fixture(scope="module")
def turns():
    rows = [(1, i, "assistant" if i % 3 else "user", t) for i, t in enumerate(TRICKY)]
    rows += [(2, 0, "user", None), (2, 0, "user", "b"), (2, 0, "assistant", "a"), (2, None, "system\n%|<|", "first")]
    rows += [(3, 5, "assistant", "same"), (3, 5, "assistant", "same"), (3, 1, None, "no role"), (None, 1, "assistant", "x")]
    rows += [(4, 0, "assistant", "long " * 20_000), (5, 0, "user", "only")]
    rows += [(6, i, "assistant", f"part {i}") for i in range(300)]
    return rows


def read(spark, rows):
    given = spark.createDataFrame(rows, SCHEMA).withColumns({n: F.lit(n) for n in CLASHING}).repartition(2)
    out = chat.format_conversations(given)
    assert out.columns == ["conv_id", "formatted", "loss"]
    return out.select(
        "*",
        chat.read_turns(F.col("formatted")).alias("turns"),
        chat.read_loss(F.col("formatted"), F.col("loss")).alias("learned"),
    ).collect()


def test_round_trip(spark, turns):
    found = {row["conv_id"]: row for row in read(spark, turns)}
    assert set(found) == {r[0] for r in turns}
    for conv_id, row in found.items():
        own = [(t if t is not None else -1, r or "", x or "") for c, t, r, x in turns if c == conv_id]
        said = [(role, text) for _, role, text in sorted(own)]
        assert [tuple(t) for t in row["turns"]] == said
        assert row["learned"] == [text for role, text in said if role == "assistant"]
        for span in row["loss"]:
            assert row["formatted"][span["start"] : span["start"] + span["length"]] in [
                escape(text) for role, text in said if role == "assistant"
            ]


def escape(text: str) -> str:
    import re

    return re.sub(r"<(\\*)\|", r"<\\\1|", text)


def test_adjacent_turns_of_a_role_share_a_block(spark):
    row = read(spark, [(1, 2, "assistant", "c"), (1, 0, "user", "a"), (1, 1, "assistant", "b")])[0]
    assert row["formatted"] == "<|im_start|>user\na<|im_end|>\n<|im_start|>assistant\nb<|im_next|>c<|im_end|>\n"
    assert [tuple(s) for s in row["loss"]] == [(1, 51, 1), (2, 63, 1)]


def test_empty_table(spark):
    assert chat.format_conversations(spark.createDataFrame([], SCHEMA)).collect() == []


def test_no_python_in_the_plan(spark, turns):
    out = chat.format_conversations(spark.createDataFrame(turns, SCHEMA))
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan


def timed(spark, rows):
    """Seconds to format and read back, once everything is compiled."""
    out = read_all(spark, rows)
    begin = time.perf_counter()
    row = out.first()
    return time.perf_counter() - begin, row


def read_all(spark, rows):
    out = chat.format_conversations(rows)
    return out.select(
        F.length("formatted").alias("size"),
        F.size(chat.read_turns(F.col("formatted"))).alias("turns"),
        F.sha2(F.array_join(chat.read_loss(F.col("formatted"), F.col("loss")), "|"), 256).alias("learned"),
    )


@pytest.mark.parametrize("alternating", [True, False])
def test_time_grows_with_the_turns(spark, alternating):
    """100,000 turns of one conversation, one block for each or all in one block."""
    role = F.when(F.col("id") % 2 == 0, "user").otherwise("assistant") if alternating else F.lit("assistant")
    taken = {}
    for n in (1000, 1000, 10_000, 100_000):
        rows = spark.range(n).select(
            F.lit(1).alias("conv_id"), F.col("id").alias("turn"), role.alias("role"), F.concat(F.lit("é <|x|> "), F.col("id")).alias("text")
        )
        taken[n], row = timed(spark, rows)
        said = [f"é <|x|> {i}" for i in range(n) if i % 2 or not alternating]
        assert row["turns"] == n
        assert row["learned"] == hashlib.sha256("|".join(said).encode()).hexdigest()
    # In proportion; the smaller ones cost little but the start of a job.
    assert taken[100_000] < 60
    assert taken[100_000] < 25 * max(taken[10_000], 0.5)


def test_sums_before(spark):
    for n in (0, 1, 2, 3, 4, 5, 8, 9, 10, 99, 100, 101):
        found = spark.range(1).select(chat._before(F.array(*[F.lit(k * k + 1).cast("bigint") for k in range(n)]).cast("array<bigint>")).alias("x")).first()["x"]
        assert found == [sum(k * k + 1 for k in range(i)) for i in range(n)]
