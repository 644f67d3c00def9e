"""One query per operator, each over whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

import archipelago as ar
from archipelago.sources.round_tables import RoundTables
from workload import graphs
from workload.graphs import EdgeSet, table
from workload.oracles import CUTOFFS, MULTI, PREVIEW_ROWS

Query = Callable[[SparkSession, str], DataFrame]

EDGE_SETS: dict[str, EdgeSet] = {
    "order_part": graphs.order_part,
    "bulk_order_part": graphs.bulk_order_part,
    "part_supplier": graphs.part_supplier,
    "customer_order": graphs.customer_order,
    "supplier_nation": graphs.supplier_nation,
    "doc_copies": graphs.doc_copies,
    "doc_lines": graphs.doc_lines,
}


def written_edge_file(edges: DataFrame) -> str:
    """Write edges as an edge file with a comment on top of it, and return its path."""
    spark = edges.sparkSession
    header = edges.agg(F.count(F.lit(1)).alias("n")).select(
        F.explode(
            F.array(F.lit("# undirected graph, one edge per line"), F.concat(F.lit("# Edges:\t"), "n"))
        ).alias("value")
    )
    path = RoundTables(spark).new_path("edges.txt")
    header.unionByName(edges.select(F.concat_ws("\t", "src", "dst").alias("value"))).write.text(path)
    return path


def edge_file_parse(spark: SparkSession, folder: str) -> DataFrame:
    path = written_edge_file(graphs.order_part(spark, folder))
    return ar.read_edge_file(spark, path, on_bad="fail")


def malformed_lines(spark: SparkSession, folder: str) -> DataFrame:
    """Every line item as a line, in one of seven shapes of which three are edges."""
    src = (2 * F.col("l_orderkey")).cast("string")
    dst = (2 * F.col("l_partkey") + 1).cast("string")
    shapes = {
        1: F.concat_ws("\t", src, dst),
        2: F.concat_ws("\t", src, dst, F.lit("extra")),
        3: F.concat(F.lit("# "), F.concat_ws("\t", src, dst)),
        4: F.lit("  "),
        5: src,
        6: F.concat_ws("\t", F.lit("x"), dst),
        7: F.concat(F.concat_ws("\t", src, dst), F.lit("\r")),
    }
    value = F.lit(None).cast("string")
    for shape, line in shapes.items():
        value = F.when(F.col("l_linenumber") == shape, line).otherwise(value)
    return table(spark, folder, "lineitem").select(value.alias("value"))


def edge_lines_malformed(spark: SparkSession, folder: str) -> DataFrame:
    return ar.parse_edge_lines(malformed_lines(spark, folder))


def edge_lines_separated(spark: SparkSession, folder: str) -> DataFrame:
    """Bad lines by reason, and what became of all lines."""
    found = ar.separate_edge_lines(malformed_lines(spark, folder))
    reasons = found.rejected.groupBy(F.col("reason").alias("kind")).agg(F.count(F.lit(1)).alias("lines"))
    edges = found.edges.select(F.lit("edge").alias("kind")).groupBy("kind").agg(F.count(F.lit(1)).alias("lines"))
    return reasons.unionByName(edges).withColumn("skipped", F.lit(found.skipped_count).cast("bigint"))


def symmetrize(spark: SparkSession, folder: str) -> DataFrame:
    return ar.symmetrize(graphs.order_part(spark, folder))


def normalise(spark: SparkSession, folder: str) -> DataFrame:
    return ar.normalise(graphs.order_part(spark, folder))


def neighbour_min(spark: SparkSession, folder: str) -> DataFrame:
    return ar.neighbour_min(ar.symmetrize(graphs.order_part(spark, folder)))


def adjacency_lists(spark: SparkSession, folder: str) -> DataFrame:
    lists = ar.adjacency_lists(ar.symmetrize(graphs.order_part(spark, folder)))
    return lists.select(
        "node",
        "part",
        F.size("neighbours").cast("bigint").alias("degree"),
        F.array_join(F.transform("neighbours", lambda n: n.cast("string")), ",").alias("neighbours"),
    )


def adjacency_lists_split(spark: SparkSession, folder: str) -> DataFrame:
    """Lists of about 50 neighbours: what all lists of a node hold together."""
    lists = ar.adjacency_lists(ar.symmetrize(graphs.part_supplier(spark, folder)), list_length=50)
    each = lists.select("node", "part", F.explode("neighbours").alias("neighbour"))
    held = F.transform(F.array_sort(F.collect_list("neighbour")), lambda n: n.cast("string"))
    return each.groupBy("node").agg(
        F.count(F.lit(1)).alias("degree"),
        (F.count_distinct("part") > 1).alias("several"),
        F.array_join(held, ",").alias("neighbours"),
    )


def ccf_step_join(spark: SparkSession, folder: str) -> DataFrame:
    return ar.ccf_step(normalise(spark, folder), form="join")


def ccf_step_array(spark: SparkSession, folder: str) -> DataFrame:
    return ar.ccf_step(normalise(spark, folder), form="array")


def ccf_step_array_split(spark: SparkSession, folder: str) -> DataFrame:
    pairs = ar.normalise(graphs.part_supplier(spark, folder))
    return ar.ccf_step(pairs, form="array", list_length=50)


def new_pair_count(spark: SparkSession, folder: str) -> DataFrame:
    return ar.new_pair_count(normalise(spark, folder))


def cc_query(edge_set: EdgeSet) -> Query:
    def run(spark: SparkSession, folder: str) -> DataFrame:
        return ar.connected_components(edge_set(spark, folder))

    return run


def log_query(edge_set: EdgeSet) -> Query:
    def run(spark: SparkSession, folder: str) -> DataFrame:
        return ar.iteration_log(edge_set(spark, folder))

    return run


bulk_components = cc_query(graphs.bulk_order_part)
document_components = cc_query(graphs.doc_lines)


def cc_pairs_no_roots(spark: SparkSession, folder: str) -> DataFrame:
    return ar.connected_components(graphs.doc_lines(spark, folder), include_roots=False)


def cc_pairs_by_component(spark: SparkSession, folder: str) -> DataFrame:
    return ar.by_component(cc_pairs_no_roots(spark, folder))


def cc_documents_all(spark: SparkSession, folder: str) -> DataFrame:
    """Clusters of documents by shared lines; a document without any is its own cluster."""
    documents = table(spark, folder, "documents").select(F.col("doc_id").alias("node"))
    return ar.connected_components(graphs.doc_lines(spark, folder), vertices=documents)


def cc_by_ccf_array(spark: SparkSession, folder: str) -> DataFrame:
    return ar.connected_components(graphs.order_part(spark, folder), method="ccf", form="array")


def cc_by_ccf_join(spark: SparkSession, folder: str) -> DataFrame:
    return ar.connected_components(graphs.part_supplier(spark, folder), method="ccf", form="join")


def cc_by_contraction(spark: SparkSession, folder: str) -> DataFrame:
    return ar.connected_components(graphs.order_part(spark, folder), method="contract")


def cc_part_supplier_hot(spark: SparkSession, folder: str) -> DataFrame:
    """The same with every supplier and many parts as hot keys."""
    return ar.connected_components(graphs.part_supplier(spark, folder), hot_rows=20)


def cc_doc_lines_hot(spark: SparkSession, folder: str) -> DataFrame:
    return ar.connected_components(graphs.doc_lines(spark, folder, hot_rows=3), hot_rows=3)


def component_count(spark: SparkSession, folder: str) -> DataFrame:
    return ar.component_count(document_components(spark, folder))


def component_count_pairs(spark: SparkSession, folder: str) -> DataFrame:
    return ar.component_count(cc_pairs_no_roots(spark, folder))


def component_count_file(spark: SparkSession, folder: str) -> DataFrame:
    return ar.component_count_from_file(spark, written_edge_file(graphs.customer_order(spark, folder)))


def component_sizes(spark: SparkSession, folder: str) -> DataFrame:
    return ar.component_sizes(document_components(spark, folder))


def several_graphs(spark: SparkSession, folder: str) -> dict[str, DataFrame]:
    return {name: EDGE_SETS[name](spark, folder) for name in MULTI}


def multi_graph_counts(spark: SparkSession, folder: str) -> DataFrame:
    return ar.multi_graph_counts(several_graphs(spark, folder))


def unpivot_report(spark: SparkSession, folder: str) -> DataFrame:
    """Nodes and components per graph, one row per number."""
    edges = ar.multi_graph(several_graphs(spark, folder))
    assignments = ar.connected_components(edges, by=["graph"])
    wide = assignments.groupBy("graph").agg(
        F.count(F.lit(1)).alias("nodes"),
        F.count_if(F.col("node") == F.col("component")).alias("components"),
    )
    return ar.wide_to_long(
        wide, ["graph"], ["nodes", "components"], {"variable": "measure", "value": "number"}
    )


def ordered_preview(spark: SparkSession, folder: str) -> DataFrame:
    return ar.ordered_preview(document_components(spark, folder), PREVIEW_ROWS, "component", "node")


def write_read_assignments(spark: SparkSession, folder: str) -> DataFrame:
    path = RoundTables(spark).new_path("assignments")
    ar.write_assignments(ar.connected_components(graphs.customer_order(spark, folder)), path)
    return ar.read_assignments(spark, path)


def cc_added_edges(spark: SparkSession, folder: str) -> DataFrame:
    """Later order lines, folded into the components of the first ones."""
    before, added = graphs.order_part_lines(spark, folder)
    stored = ar.connected_components(before)
    return ar.added_edges(stored, added).applied_to(stored)


def cc_added_links(spark: SparkSession, folder: str) -> DataFrame:
    """Copies of documents, folded into the clusters by shared lines."""
    stored = document_components(spark, folder)
    return ar.added_edges(stored, graphs.doc_copies(spark, folder)).applied_to(stored)


def cc_stored_updates(spark: SparkSession, folder: str) -> DataFrame:
    """A store of the decided orders' components, with the pending orders added."""
    before, added = graphs.customer_order_pending(spark, folder)
    store = ar.AssignmentStore(spark, RoundTables(spark).new_path("store"))
    store.create(ar.connected_components(before), parts=64)
    update = ar.added_edges(store.read(), added)
    store.update(update.touched, update.rows)
    return store.read()


def cc_removed_edges(spark: SparkSession, folder: str) -> DataFrame:
    """The pending orders taken away again."""
    remaining, removed = graphs.customer_order_pending(spark, folder)
    stored = ar.connected_components(graphs.customer_order(spark, folder))
    return ar.removed_edges(stored, remaining, removed).applied_to(stored)


def cc_removed_edges_forest(spark: SparkSession, folder: str) -> DataFrame:
    """The later order lines taken away; components that keep their spanning forest are not computed again."""
    edges = graphs.order_part(spark, folder)
    remaining, removed = graphs.order_part_lines(spark, folder)
    stored = ar.connected_components(edges)
    return ar.removed_edges(stored, remaining, removed, forest=ar.spanning_forest(edges)).applied_to(stored)


def spanning_forest_edges(spark: SparkSession, folder: str) -> DataFrame:
    """Per component, the edges of the forest, and how many of them are edges of the graph."""
    edges = graphs.doc_lines(spark, folder)
    forest = ar.spanning_forest(edges)
    real = forest.join(edges.distinct(), ["src", "dst"], "left_semi")
    counted = forest.groupBy("component").agg(F.count(F.lit(1)).alias("forest_edges"))
    return counted.join(real.groupBy("component").agg(F.count(F.lit(1)).alias("graph_edges")), "component", "left")


def cc_by_forest(spark: SparkSession, folder: str) -> DataFrame:
    """Components of the spanning forest alone."""
    return ar.connected_components(ar.spanning_forest(graphs.order_part(spark, folder)))


def certificate_accepts(spark: SparkSession, folder: str) -> DataFrame:
    """Right components: how many nodes, and no offence."""
    edges = graphs.order_part(spark, folder)
    assignments = ar.connected_components(edges)
    found = ar.offences(assignments, edges, ar.spanning_forest(edges))
    nodes = assignments.agg(F.count(F.lit(1)).alias("nodes"))
    return nodes.join(found.agg(F.count(F.lit(1)).alias("offences")), how="full")


def certificate_stale(spark: SparkSession, folder: str) -> DataFrame:
    """What is wrong with components from before the pending orders came."""
    edges = graphs.customer_order(spark, folder)
    before, _ = graphs.customer_order_pending(spark, folder)
    return ar.offences(ar.connected_components(before), edges, ar.spanning_forest(edges))


def single_linkage_orders(spark: SparkSession, folder: str) -> DataFrame:
    """Orders and parts that stay together when lines of fewer pieces are cut."""
    return ar.single_linkage(graphs.weighted_order_part(spark, folder), CUTOFFS)


def spanning_forest_weights(spark: SparkSession, folder: str) -> DataFrame:
    """How many edges of each weight a minimum spanning forest needs."""
    forest = ar.minimum_spanning_forest(graphs.weighted_order_part(spark, folder))
    within = F.array(*[F.lit(cutoff) for cutoff in CUTOFFS])
    each = forest.select(F.explode(F.filter(within, lambda cutoff: F.col("weight") <= cutoff)).alias("cutoff"))
    return each.groupBy("cutoff").agg(F.count(F.lit(1)).alias("edges"))


def queries() -> dict[str, Query]:
    named: dict[str, Query] = {
        query.__name__: query
        for query in (
            edge_file_parse,
            edge_lines_malformed,
            symmetrize,
            normalise,
            neighbour_min,
            adjacency_lists,
            adjacency_lists_split,
            ccf_step_join,
            ccf_step_array,
            ccf_step_array_split,
            new_pair_count,
            cc_pairs_no_roots,
            cc_pairs_by_component,
            cc_documents_all,
            cc_by_ccf_array,
            cc_by_ccf_join,
            cc_by_contraction,
            cc_part_supplier_hot,
            cc_doc_lines_hot,
            component_count,
            component_count_pairs,
            component_count_file,
            component_sizes,
            multi_graph_counts,
            unpivot_report,
            ordered_preview,
            write_read_assignments,
            cc_added_edges,
            cc_added_links,
            cc_stored_updates,
            cc_removed_edges,
            cc_removed_edges_forest,
            spanning_forest_edges,
            cc_by_forest,
            certificate_accepts,
            certificate_stale,
            single_linkage_orders,
            spanning_forest_weights,
            edge_lines_separated,
        )
    }
    named |= {f"cc_{name}": cc_query(edge_set) for name, edge_set in EDGE_SETS.items()}
    named |= {
        f"iteration_log_{name}": log_query(EDGE_SETS[name])
        for name in ("order_part", "bulk_order_part", "part_supplier", "doc_lines")
    }
    return named
