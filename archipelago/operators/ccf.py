"""One step of the CCF iteration, on canonical pairs (see :mod:`archipelago.operators.pairs`).

For every node that has a smaller neighbour, let m be its smallest one. The step links the node and
all its other neighbours to m. A node without a smaller neighbour emits nothing. The links made
from other neighbours are the new pairs; when there are none, every node hangs on its component's
smallest id.

The smaller neighbours of a node are the components of its pairs, the larger ones the nodes whose pairs name it. Where the
pairs of a node are held together with their smallest component, the links to its smaller neighbours need no shuffle;
those to the larger ones come from one lookup of each pair's component.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from archipelago.functions import smallest_in_neighbourhood
from archipelago.operators.lookup import hot_limit, lookup
from archipelago.operators.neighbours import LIST_LENGTH
from archipelago.operators.pairs import as_edges, symmetrize
from archipelago.operators.sides import fits, is_small
from archipelago.sources.round_tables import RoundTable, RoundTables

FORMS = ("join", "array")
# Groups of nodes whose neighbours are counted first, at least.
GROUPS = 1 << 16


@dataclass(frozen=True)
class Held:
    """Distinct pairs, those of a node held together.

    ``df`` has rows ``node, component, smallest``, where ``smallest`` is the smallest component of the node, or in the array form
    lists ``node, components, smallest``. ``nodes`` says how many nodes have pairs, ``centres`` about how many components the
    next step's pairs have, ``emitted`` how many rows became these pairs, and ``written`` are the tables that ``df`` reads.
    Numbers are None where nothing has run yet.
    """

    df: DataFrame
    form: str
    pairs: int | None = None
    nodes: int | None = None
    centres: int | None = None
    emitted: int | None = None
    written: tuple[RoundTable, ...] = ()

    @property
    def rows(self) -> DataFrame:
        """All pairs as rows ``node, component, smallest``."""
        return self.df if self.form == "join" else _unfolded(self.df)

    @property
    def minima(self) -> DataFrame:
        """``node, smallest``: one row for each node."""
        first = F.col("component") if self.form == "join" else F.array_min("components")
        return self.df.filter(first == F.col("smallest"))

    def near(self, by: Sequence[str]) -> DataFrame:
        """``node, component, fresh``: the links from each node and its other smaller neighbours to the smallest."""
        smallest = F.col("component") == F.col("smallest")
        node = F.when(smallest, F.col("node")).otherwise(F.col("component")).alias("node")
        fresh = F.when(smallest, 0).otherwise(1).alias("fresh")
        return self.rows.select(*by, node, F.col("smallest").alias("component"), fresh)


def crowded(
    tables: RoundTables,
    pairs: DataFrame,
    by: Sequence[str] = (),
    total: int | None = None,
    hot_rows: int | None = None,
    list_length: int = LIST_LENGTH,
) -> DataFrame | None:
    """``node, edges`` of the nodes with more neighbours than a task or a list should get, or None if there are none.

    Neighbours are counted for groups of nodes first, then for the nodes of the groups that have too many, so that few
    numbers are shuffled. A step emits no more pairs of a node than it has neighbours, and one.
    """
    most = min(hot_limit(pairs.sparkSession, hot_rows), list_length)
    if total is not None and 2 * total <= most:
        return None
    groups = max(GROUPS, 16 * (total or 0) // most)
    ends = symmetrize(as_edges(pairs, by), by).select(*by, F.col("src").alias("node"))
    ends = ends.withColumn("group", F.pmod(F.xxhash64(*by, "node"), F.lit(groups)))
    full = tables.write(ends.groupBy("group").count().filter(F.col("count") > most).select("group"), "full-groups")
    if not full.rows:
        return None
    each = ends.join(F.broadcast(full.df), "group", "left_semi").groupBy(*by, "node").agg(F.count(F.lit(1)).alias("edges"))
    found = tables.write(each.filter(F.col("edges") > most), "crowded")
    return found.df if found.rows else None


def _parts(crowd: DataFrame, most: int, by: Sequence[str], key: str = "node") -> DataFrame:
    """Into how many parts the rows of nodes with more than ``most`` neighbours go."""
    each = F.ceil(F.col("edges") / most).cast("bigint").alias("_parts")
    return crowd.filter(F.col("edges") > most).select(*by, F.col("node").alias(key), each)


def _listed(
    rows: DataFrame, by: Sequence[str], crowd: DataFrame | None = None, most: int = LIST_LENGTH, combine: bool = False
) -> DataFrame:
    """``node, components, smallest, times`` for each node, or each part of a crowded one: its distinct components, the smallest
    of them, and how many ``rows`` there were.

    The rows are shuffled once, by node and part. With ``combine``, equal rows become one before that.
    """
    place = [*by, "node"]
    rows, times = rows.select(*place, "component"), F.count(F.lit(1)).alias("times")
    if combine:
        rows, times = rows.groupBy(*place, "component").agg(times), F.sum("times").alias("times")
    if crowd is not None:
        part = F.when(F.col("_parts").isNotNull(), F.pmod(F.xxhash64("component"), "_parts"))
        rows = rows.join(F.broadcast(_parts(crowd, most, by)), place, "left").withColumn("part", part).drop("_parts")
        place = [*place, "part"]
    lists = rows.repartition(*place).groupBy(*place).agg(F.collect_set("component").alias("components"), times)
    return lists.withColumn("smallest", smallest_in_neighbourhood(F.col("node"), F.col("components")))


def _unfolded(lists: DataFrame) -> DataFrame:
    """A row for each component of the lists."""
    return lists.withColumn("component", F.explode("components")).drop("components", "times")


def hold(
    tables: RoundTables,
    rows: DataFrame,
    by: Sequence[str] = (),
    form: str = "join",
    crowd: DataFrame | None = None,
    hot_rows: int | None = None,
    list_length: int = LIST_LENGTH,
    combine: bool = False,
    name: str = "held",
) -> Held:
    """Write the distinct pairs of ``rows`` (``node, component``), those of a node together.

    ``form="join"`` writes them as rows, ``form="array"`` as lists of bounded length. ``crowd`` are the nodes that may have too many
    pairs for one task or list (see :func:`crowded`): theirs go to several, and the smallest of all is found after that.
    """
    lists = _listed(rows, by, crowd, min(hot_limit(rows.sparkSession, hot_rows), list_length), combine)
    whole = F.lit(True) if crowd is None else F.col("part").isNull()
    table = tables.write(
        lists,
        name,
        unfolded=_unfolded if form == "join" else None,
        pairs=F.coalesce(F.sum(F.size("components")), F.lit(0)),
        emitted=F.coalesce(F.sum("times"), F.lit(0)),
        nodes=F.count_if(whole),
        split=F.count_if(~whole),
        centres=F.approx_count_distinct(F.xxhash64(*by, "smallest")),
    )
    sums = table.sums
    held, nodes, written = table.df, sums["nodes"], (table,)
    if sums["split"]:
        of_parts = held.filter(F.col("part").isNotNull()).groupBy(*by, "node").agg(F.min("smallest").alias("of_all"))
        minima = tables.write(of_parts, "minima")
        held = held.join(F.broadcast(minima.df), [*by, "node"], "left").withColumn("smallest", F.coalesce("of_all", "smallest"))
        nodes, written = nodes + minima.rows, (table, minima)
    return Held(held, form, sums["pairs"], nodes, sums["centres"], sums["emitted"], written)


def _rows_held(pairs: DataFrame, by: Sequence[str], total: int | None, limit: int) -> Held:
    """The same rows with nothing written: the minima are joined to the ``pairs``, which are distinct."""
    minima = pairs.groupBy(*by, "node").agg(F.min("component").alias("smallest"))
    return Held(lookup(pairs.select(*by, "node", "component"), minima, "node", by, "inner", total, hot_rows=limit), "join", total)


def linked(
    tables: RoundTables | None,
    held: Held,
    by: Sequence[str] = (),
    centres: int | None = None,
    crowd: DataFrame | None = None,
    hot_rows: int | None = None,
) -> tuple[DataFrame, bool, bool]:
    """``node, component, fresh`` of one step from pairs that are held; whether they come from few centres, and whether any is new.

    ``centres`` says about how many components the pairs have. Where they are few, those with a smaller neighbour are written to
    ``tables`` and sent to every task, and equal links are likely; otherwise the pairs are shuffled by component. Without
    ``tables`` nothing runs, and "few" and "new" are guesses.
    """
    near = held.near(by)
    minima, rows = held.minima.select(*by, F.col("node").alias("component"), F.col("smallest").alias("to")), held.nodes
    pairs = held.rows.select(*by, "node", "component")
    most_centres = held.pairs if centres is None else centres
    few = tables is not None and fits(pairs.sparkSession, most_centres, len(by) + 2)
    if few:
        named = pairs.select(*by, "component").distinct()
        found = tables.write(minima.join(F.broadcast(named), [*by, "component"], "left_semi"), "centres")
        if not found.rows:
            return near, True, held.pairs > held.nodes
        minima, rows, few = found.df, found.rows, is_small(found)
    if few:
        far = pairs.join(F.broadcast(minima), [*by, "component"])
    else:
        limit = hot_limit(pairs.sparkSession, hot_rows)
        # Where no node is crowded, no number of pairs calls for salt.
        total = 0 if crowd is None and held.pairs is not None else held.pairs
        hot = None if crowd is None else _parts(crowd, limit, by, "component")
        far = lookup(pairs, minima, "component", by, "inner", total, hot_rows=limit, table_rows=rows, hot=hot)
    far = far.select(*by, "node", F.col("to").alias("component"), F.lit(1).alias("fresh"))
    return near.unionByName(far), few, True


def emitted_pairs(
    pairs: DataFrame,
    by: Sequence[str] = (),
    form: str = "join",
    total: int | None = None,
    hot_rows: int | None = None,
    list_length: int = LIST_LENGTH,
    tables: RoundTables | None = None,
) -> DataFrame:
    """``node, component, fresh``: all pairs of one step; ``fresh`` is 1 on new pairs, else 0.

    ``pairs`` must be distinct; they are read more than once. ``form="join"`` holds a node's pairs as rows.
    ``form="array"`` gathers them in lists of bounded length and unfolds them again. Both emit the same rows.
    ``total`` is the number of ``pairs``, where it is known. The pairs are written to ``tables`` by node first for the lists,
    and for the rows where ``total`` says that nodes can be hot.
    """
    if form not in FORMS:
        raise ValueError(f"form must be one of {FORMS}, not {form!r}")
    limit = hot_limit(pairs.sparkSession, hot_rows)
    if form == "join" and (total is None or 2 * total <= limit):
        return linked(None, _rows_held(pairs, by, total, limit), by, hot_rows=limit)[0]
    tables = tables or RoundTables(pairs.sparkSession)
    crowd = crowded(tables, pairs, by, total, hot_rows, list_length)
    held = hold(tables, pairs, by, form, crowd, hot_rows, list_length)
    return linked(tables, held, by, None, crowd, hot_rows)[0]


def dedup(emitted: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Distinct pairs, ``fresh`` summed, so that the new-pair count is known after the dedup too."""
    return emitted.groupBy(*by, "node", "component").agg(F.sum("fresh").alias("fresh"))


def ccf_step(
    pairs: DataFrame,
    by: Sequence[str] = (),
    form: str = "join",
    hot_rows: int | None = None,
    list_length: int = LIST_LENGTH,
    tables: RoundTables | None = None,
) -> DataFrame:
    """The distinct pairs after one step; repeated pairs do not matter.

    The distinct input is written once, to ``tables`` (see :class:`RoundTables`, which can
    delete it after the last use), and read from there.
    """
    if form not in FORMS:
        raise ValueError(f"form must be one of {FORMS}, not {form!r}")
    tables = tables or RoundTables(pairs.sparkSession)
    given = tables.write(pairs.select(*by, "node", "component").distinct(), "pairs")
    emitted = emitted_pairs(given.df, by, form, given.rows, hot_rows, list_length, tables)
    return dedup(emitted, by).drop("fresh")


def new_pair_count(pairs: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """One row per graph, ``new_pairs``: how many new pairs the next step would emit.

    A node with d neighbours that is not its own minimum emits d - 1. That needs the degrees only.
    """
    smaller = F.count_if(F.col("dst") < F.col("src"))
    per_node = (
        symmetrize(as_edges(pairs, by), by)
        .groupBy(*by, "src")
        .agg(F.count(F.lit(1)).alias("neighbours"), smaller.alias("smaller"))
    )
    emits = F.when(F.col("smaller") > 0, F.col("neighbours") - 1).otherwise(F.lit(0))
    return per_node.groupBy(*by).agg(F.coalesce(F.sum(emits), F.lit(0)).alias("new_pairs"))
