"""CCF steps until no new pair appears."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame

from archipelago.operators import normalise
from archipelago.operators.ccf import FORMS, crowded, hold, linked
from archipelago.operators.lookup import hot_limit
from archipelago.sources.round_tables import RoundTables

LOG_SCHEMA = "iteration bigint, new_pairs bigint, pairs bigint"


@dataclass(frozen=True)
class CcfRun:
    """The pairs of the last step (no root rows), and one log row per step."""

    pairs: DataFrame
    log: list[tuple[int, int, int]]

    def iteration_log(self) -> DataFrame:
        """``iteration, new_pairs, pairs``: true counts per step, the last with no new pair."""
        return self.pairs.sparkSession.createDataFrame(self.log, LOG_SCHEMA)


def run_ccf(
    edges: DataFrame,
    by: Sequence[str] = (),
    form: str = "join",
    max_rounds: int = 100,
    hot_rows: int | None = None,
    tables: RoundTables | None = None,
) -> CcfRun:
    """Repeat the CCF step on ``edges`` (``src``, ``dst``) to its fixpoint.

    Each step writes its pairs, those of a node together, and counts them on the way; the driver sees
    a few numbers per step. The last step's pairs are one table of ``tables``; all others are
    deleted, also if a step raises.
    """
    if form not in FORMS:
        raise ValueError(f"form must be one of {FORMS}, not {form!r}")
    if max_rounds < 1:
        raise ValueError(f"max_rounds must be 1 at least, not {max_rounds}")
    tables = tables or RoundTables(edges.sparkSession)
    log: list[tuple[int, int, int]] = []
    with tables.temporary() as scratch:
        given = scratch.write(normalise(edges, by), "pairs")
        crowd = crowded(scratch, given.df, by, given.rows, hot_rows)
        held, centres = hold(scratch, given.df, by, form, crowd, hot_rows), None
        scratch.drop(given)
        while not log or log[-1][1]:
            if len(log) == max_rounds:
                raise RuntimeError(f"still {log[-1][1]} new pairs after {max_rounds} steps")
            # Small steps are one job each, and Spark sees what it can broadcast.
            aside = scratch if 2 * held.pairs > hot_limit(edges.sparkSession, hot_rows) else None
            links, few, fresh = linked(aside, held, by, centres, crowd, hot_rows)
            if not fresh:
                log.append((len(log) + 1, 0, held.nodes))
                break
            # The neighbours of a crowded node may all emit the same link to it.
            combine = few or crowd is not None
            previous, held = held, hold(scratch, links, by, form, crowd, hot_rows, combine=combine, name="step")
            centres = previous.centres
            # Besides the new pairs, each node emits the one to its smallest neighbour.
            log.append((len(log) + 1, held.emitted - previous.nodes, held.pairs))
            scratch.drop(*previous.written)
            if log[-1][1]:
                crowd = crowded(scratch, held.rows, by, held.pairs, hot_rows)
        kept = tables.write(held.rows.select(*by, "node", "component"), "components")
    return CcfRun(kept.df, log)


def iteration_log(edges: DataFrame, form: str = "join", max_rounds: int = 100) -> DataFrame:
    """The log of :func:`run_ccf` as a DataFrame; the pairs are deleted."""
    with RoundTables(edges.sparkSession) as tables:
        return run_ccf(edges, form=form, max_rounds=max_rounds, tables=tables).iteration_log()
