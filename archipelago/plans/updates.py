"""New and lost edges of a graph whose components are stored already.

``assignments`` (``node, component``, with a row for every node, roots included) is the large table here: it is scanned, and only
its rows of touched components are shuffled, as long as a batch of edges is small (see :mod:`archipelago.operators.sides`).
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from archipelago.operators import lookup, normalise, symmetrize, with_roots, with_vertices
from archipelago.operators.sides import side_lookup, without
from archipelago.plans.contraction import contract
from archipelago.sources.round_tables import RoundTable, RoundTables


@dataclass(frozen=True)
class Update:
    """What edges change.

    ``touched`` (``component``) are the stored components whose rows are replaced, ``rows`` (``node, component``) the rows that
    replace them, and those of new nodes.
    """

    touched: RoundTable
    rows: DataFrame
    by: tuple[str, ...] = ()
    hot_rows: int | None = None

    def applied_to(self, assignments: DataFrame) -> DataFrame:
        """All rows after the update. Rows of other components go through as they are, without a shuffle."""
        others = without(assignments, self.touched, "component", self.by, self.hot_rows)
        return others.select(*self.by, "node", "component").unionByName(self.rows)


def _ends(scratch: RoundTables, pairs: DataFrame, by: Sequence[str]) -> RoundTable:
    """``node``: the distinct ends of some edges."""
    edges = pairs.select(*by, F.col("node").alias("src"), F.col("component").alias("dst"))
    return scratch.write(symmetrize(edges, by).select(*by, F.col("src").alias("node")).distinct(), "ends")


def added_edges(
    assignments: DataFrame,
    added: DataFrame,
    by: Sequence[str] = (),
    hot_rows: int | None = None,
    tables: RoundTables | None = None,
) -> Update:
    """What ``added`` edges (``src``, ``dst``) change in stored ``assignments``.

    Only the ends of the new edges are looked up. What is contracted is a graph of stored components, with an edge where a
    new edge runs between two of them (a node not stored is its own); components that get another label are rewritten,
    those that keep theirs stay as they are. Edges known already, self-loops and NULL ids change nothing. The result
    equals a run over all edges, if ``assignments`` are one of the edges before.
    """
    tables = tables or RoundTables(assignments.sparkSession)
    with tables.temporary() as scratch:
        pairs = scratch.write(normalise(added, by), "added")
        ends = _ends(scratch, pairs.df, by)
        stored = assignments.select(*by, "node", "component")
        known = scratch.write(side_lookup(stored, ends, "node", by, "inner", hot_rows), "known")

        from_ = known.df.select(*by, "node", F.col("component").alias("root"))
        to = known.df.select(*by, F.col("node").alias("component"), F.col("component").alias("other"))
        edges = lookup(pairs.df, from_, "node", by, "left", pairs.rows, hot_rows=hot_rows)
        edges = lookup(edges, to, "component", by, "left", pairs.rows, pairs.df, hot_rows)
        edges = edges.select(*by, F.coalesce("root", "node").alias("src"), F.coalesce("other", "component").alias("dst"))
        labels = scratch.write(contract(edges, by, hot_rows=hot_rows, tables=scratch), "labels")

        # A new node that got a label is no stored component.
        relabelled = labels.df.select(*by, F.col("node").alias("component"))
        touched = tables.write(relabelled.join(known.df, [*by, "component"], "left_semi"), "touched")
        becomes = scratch.write(
            labels.df.select(*by, F.col("node").alias("component"), F.col("component").alias("becomes")), "becomes"
        )
        moved = side_lookup(stored, becomes, "component", by, "inner", hot_rows)
        new = ends.df.join(known.df, [*by, "node"], "left_anti")
        new = new.join(labels.df.withColumnRenamed("component", "becomes"), [*by, "node"], "left")
        rows = moved.select(*by, "node", F.col("becomes").alias("component")).unionByName(
            new.select(*by, "node", F.coalesce("becomes", "node").alias("component"))
        )
        return Update(touched, tables.write(rows, "changed").df, tuple(by), hot_rows)


def removed_edges(
    assignments: DataFrame,
    remaining: DataFrame,
    removed: DataFrame,
    by: Sequence[str] = (),
    keep_isolated: bool = False,
    forest: DataFrame | None = None,
    hot_rows: int | None = None,
    tables: RoundTables | None = None,
) -> Update:
    """What changes in stored ``assignments`` when ``removed`` edges go and the ``remaining`` ones stay.

    Only components with a removed edge are computed again, from the remaining edges between their nodes. With ``forest``,
    a spanning forest of the edges before (see :func:`archipelago.plans.forest.spanning_forest`), that are only
    those that lose an edge of it: without another edge they are still connected; but then nodes without any edge can
    only be in such components, too. Removed edges that are not stored change nothing.

    A node left without an edge to another disappears, as it would in a run over the remaining edges, or is its own
    component with ``keep_isolated``.
    """
    tables = tables or RoundTables(assignments.sparkSession)
    with tables.temporary() as scratch:
        gone = normalise(removed, by)
        if forest is not None:
            gone = gone.join(normalise(forest, by), [*by, "node", "component"], "left_semi")
        ends = _ends(scratch, scratch.write(gone, "removed").df, by)
        stored = assignments.select(*by, "node", "component")
        known = side_lookup(stored, ends, "node", by, "inner", hot_rows)
        touched = tables.write(known.select(*by, "component").distinct(), "touched")
        members = side_lookup(stored, touched, "component", by, "inner", hot_rows)
        members = scratch.write(members.select(*by, "node"), "members")

        inside = members.df.select(*by, F.col("node").alias("src"))
        inside = RoundTable(inside, members.path, members.rows, {})
        edges = side_lookup(remaining.select(*by, "src", "dst"), inside, "src", by, "inner", hot_rows)
        rows = with_roots(contract(edges, by, hot_rows=hot_rows, tables=scratch), by)
        if keep_isolated:
            rows = with_vertices(rows, members.df, by)
        return Update(touched, tables.write(rows, "changed").df, tuple(by), hot_rows)
