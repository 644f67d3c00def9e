"""Line dedup with levelled runs."""

from __future__ import annotations

import pytest

from archipelago.llm import line_runs
from archipelago.sources.round_tables import RoundTables
from tests.llm import brute
from tests.llm.conftest import same


@pytest.mark.parametrize("batches", [1, 7])
def test_against_brute_force(docs, rows, batches):
    found = line_runs.drop_repeated_lines(docs, batches, 20, 3).collect()
    same(found, brute.without_lines([r[:2] for r in rows], 20, 3))


def test_production_parameters(docs, rows):
    same(line_runs.drop_repeated_lines(docs).collect(), brute.without_lines([r[:2] for r in rows]))


def test_empty_table(no_docs):
    assert line_runs.drop_repeated_lines(no_docs).collect() == []


def test_runs_are_compacted_and_hold_a_key_once(spark):
    runs = line_runs.LineRuns(spark, fanout=3)
    with pytest.raises(ValueError, match="batch"):
        runs.repeated()
    long = "a line that is long enough to have a key of its own, number {}"
    for batch in range(9):
        texts = [(10 * batch + i, "\n".join([long.format(batch), long.format("x"), long.format(batch)])) for i in range(2)]
        run = runs.add(line_runs.keyed_lines(spark.createDataFrame(texts, "doc_id bigint, text string")))
        # The shared line is new in the first batch only, and an update after that; it is in two documents of each.
        assert run.keys.rows == (2 if batch == 0 else 1)
        assert (run.updates is None) == (batch == 0)
        assert {r["documents"] for r in run.keys.df.collect()} == {2}
    assert [len(level) for level in runs.levels] == [3, 2]
    held = [r["line"] for run in runs._all() for r in run.keys.df.collect()]
    assert len(held) == len(set(held)) == 10
    # The run of the first three batches has counted their updates; the next one's are still to be added.
    first, second = runs.levels[1]
    assert first.updates is None and max(r["documents"] for r in first.keys.df.collect()) == 6
    assert [r["documents"] for r in second.updates.df.collect()] == [6]
    repeated = runs.repeated(18).collect()
    assert len(repeated) == 1 and repeated[0]["largest"] == 81
    assert len(runs.repeated(2).collect()) == 10


def test_batches_follow_the_lines(docs, rows, monkeypatch):
    added = []
    add = line_runs.LineRuns.add
    monkeypatch.setattr(line_runs.LineRuns, "add", lambda self, batch: added.append(1) or add(self, batch))
    monkeypatch.setattr(line_runs, "BATCH_LINES", 40)
    same(line_runs.drop_repeated_lines(docs, None, 20, 3).collect(), brute.without_lines([r[:2] for r in rows], 20, 3))
    assert 2 < len(added) <= line_runs.MOST_BATCHES


def test_a_batch_meets_the_runs_once(spark, monkeypatch):
    written = []
    write = RoundTables.write
    monkeypatch.setattr(RoundTables, "write", lambda self, df, name, **more: written.append(df) or write(self, df, name, **more))
    runs = line_runs.LineRuns(spark)
    long = "a line that is long enough to have a key of its own, number {}"
    for batch in range(3):
        texts = [(batch, "\n".join([long.format(batch), long.format("x")]))]
        runs.add(line_runs.keyed_lines(spark.createDataFrame(texts, "doc_id bigint, text string")))
    # One table for each batch, with its keys and its updates, from one join with all runs before.
    assert len(written) == 3
    joins = [df._jdf.queryExecution().optimizedPlan().toString().count("Join ") for df in written]
    assert joins == [0, 1, 1]
