"""Check stored components against the edges, without computing them again.

Three things together prove that every label is the smallest node that its node can reach:

* both ends of every edge have the same label, so a component has one label;
* each label is the smallest of the nodes that have it, and one of them;
* the edges of a spanning forest are edges, and they alone connect each node with its label, so nodes with one
  label are in one component.

The first two are joins and sums over the whole tables. The third contracts the forest, which has fewer edges than nodes.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from archipelago.operators import lookup, normalise
from archipelago.plans.contraction import contract
from archipelago.sources.round_tables import RoundTables

# Reasons, in the order of the checks.
REPEATED = "node with several rows"
MISSING = "node of an edge without a row"
ACROSS = "edge between labels"
NOT_SMALLEST = "label is not the smallest of its nodes"
NO_EDGE = "edge of the forest is not an edge"
NOT_REACHED = "forest does not connect the node with its label"


def _offence(rows: DataFrame, reason: str, by: Sequence[str], node: Column, component: Column) -> DataFrame:
    return rows.select(*by, F.lit(reason).alias("reason"), node.alias("node"), component.alias("component"))


def offences(
    assignments: DataFrame,
    edges: DataFrame,
    forest: DataFrame,
    by: Sequence[str] = (),
    hot_rows: int | None = None,
    tables: RoundTables | None = None,
) -> DataFrame:
    """``reason, node, component``: what is wrong with ``assignments`` (``node, component``, roots included); no rows if nothing is.

    ``forest`` has edges (``src``, ``dst``) that connect each component, as :func:`archipelago.plans.forest.spanning_forest`
    gives them. ``node`` and ``component`` are those of an assignment, the two ends of an edge (the larger first), or for a
    missing node the node alone. Nodes that no edge touches may have rows, with themselves as label. Rows with a NULL
    are ``REPEATED`` like a node with several rows, and take no part in the other checks.
    """
    tables = tables or RoundTables(assignments.sparkSession)
    with tables.temporary() as scratch:
        pairs = scratch.write(normalise(edges, by), "edges")
        given = assignments.select(*by, "node", "component")
        whole = F.col("node").isNotNull() & F.col("component").isNotNull()
        counted = given.groupBy(*by, "node").agg(
            F.count(F.lit(1)).alias("rows"), F.min("component").alias("component"), F.count("component").alias("labels")
        )
        stored = scratch.write(counted, "stored")
        repeated = stored.df.filter((F.col("rows") > 1) | F.col("node").isNull() | (F.col("labels") == 0))
        # A node with several rows is judged by its smallest label.
        labels = stored.df.filter(whole).select(*by, "node", "component")

        of_node = labels.select(*by, "node", F.col("component").alias("label"))
        of_other = labels.select(*by, F.col("node").alias("component"), F.col("component").alias("other"))
        ends = lookup(pairs.df, of_node, "node", by, "left", pairs.rows, hot_rows=hot_rows)
        ends = scratch.write(lookup(ends, of_other, "component", by, "left", pairs.rows, pairs.df, hot_rows), "ends").df
        missing = ends.filter(F.col("label").isNull()).select(*by, "node").unionByName(
            ends.filter(F.col("other").isNull()).select(*by, F.col("component").alias("node"))
        )
        across = ends.filter(F.col("label") != F.col("other"))

        least = labels.groupBy(*by, "component").agg(F.min("node").alias("least"))
        wrong = least.filter(F.col("least") != F.col("component")).drop("least")
        wrong = lookup(labels, wrong.withColumn("wrong", F.lit(True)), "component", by, "inner", stored.rows, hot_rows=hot_rows)

        chosen = scratch.write(normalise(forest, by), "forest")
        no_edge = chosen.df.join(pairs.df, [*by, "node", "component"], "left_anti")
        proven = chosen.df.join(pairs.df, [*by, "node", "component"], "left_semi")
        proven = proven.select(*by, F.col("node").alias("src"), F.col("component").alias("dst"))
        reached = contract(proven, by, hot_rows=hot_rows, tables=scratch)
        reached = labels.join(reached.withColumnRenamed("component", "smallest"), [*by, "node"], "left")
        # Against the smallest node that the forest reaches; a wrong label is named by the check before.
        apart = reached.filter(F.coalesce("smallest", "node") != F.col("component"))

        node, component = F.col("node"), F.col("component")
        nothing = F.lit(None).cast("bigint")
        found = (
            _offence(repeated, REPEATED, by, node, component)
            .unionByName(_offence(missing.distinct(), MISSING, by, node, nothing))
            .unionByName(_offence(across, ACROSS, by, node, component))
            .unionByName(_offence(wrong, NOT_SMALLEST, by, node, component))
            .unionByName(_offence(no_edge, NO_EDGE, by, node, component))
            .unionByName(_offence(apart, NOT_REACHED, by, node, component))
        )
        return tables.write(found, "offences").df
