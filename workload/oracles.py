"""The expected results of :mod:`workload.queries` as SQL for DuckDB."""

from __future__ import annotations

from workload.graphs import EDGE_SQL, WEIGHTED_SQL

MULTI = ("order_part", "customer_order", "doc_lines")
PREVIEW_ROWS = 20
# Weights up to which edges count.
CUTOFFS = (0, 4, 20, 49)
# Edge sets that others start from or end with.
EARLIER = ("order_part_first_lines", "customer_order_decided")


def _canonical(edges: str) -> str:
    return f"""select distinct greatest(src, dst) as node, least(src, dst) as component
        from ({edges}) given where src <> dst"""


def _symmetric(edges: str) -> str:
    """Distinct edges in both directions."""
    return f"""select src, dst from ({edges}) given where src <> dst
        union select dst, src from ({edges}) given where src <> dst"""


def _components(edges: str) -> str:
    """CTEs up to ``cc(node, component)``: labels spread along edges while they get smaller."""
    return f"""with recursive sym as ({_symmetric(edges)}),
        cc(node, component) using key (node) as (
            select distinct src, src from sym
            union
            select old.node, min(new.component)
            from recurring.cc old join sym on sym.src = old.node join cc new on new.node = sym.dst
            where new.component < old.component group by old.node
        )"""


def _graph_components() -> str:
    """The same for several graphs at once: ``cc(graph, node, component)``."""
    edges = " union all ".join(
        f"select '{name}' as graph, src, dst from ({EDGE_SQL[name]}) given" for name in MULTI
    )
    return f"""with recursive e as ({edges}),
        sym as (select graph, src, dst from e where src <> dst
                union select graph, dst, src from e where src <> dst),
        cc(graph, node, component) using key (graph, node) as (
            select distinct graph, src, src from sym
            union
            select old.graph, old.node, min(new.component)
            from recurring.cc old
            join sym on sym.graph = old.graph and sym.src = old.node
            join cc new on new.graph = sym.graph and new.node = sym.dst
            where new.component < old.component group by old.graph, old.node
        )"""


def _cutoff_components() -> str:
    """``cc(cutoff, node, component)`` of the weighted edges up to each cut-off."""
    levels = ", ".join(f"({cutoff})" for cutoff in CUTOFFS)
    return f"""with recursive e as (
            select cutoff, src, dst from ({WEIGHTED_SQL}) given join (values {levels}) level(cutoff) on weight <= cutoff),
        sym as (select cutoff, src, dst from e union select cutoff, dst, src from e),
        cc(cutoff, node, component) using key (cutoff, node) as (
            select distinct cutoff, src, src from sym
            union
            select old.cutoff, old.node, min(new.component)
            from recurring.cc old
            join sym on sym.cutoff = old.cutoff and sym.src = old.node
            join cc new on new.cutoff = sym.cutoff and new.node = sym.dst
            where new.component < old.component group by old.cutoff, old.node
        )"""


def _cc(name: str) -> str:
    return f"{_components(EDGE_SQL[name])} select node, component from cc"


def _step(edges: str) -> str:
    """CTEs of one CCF step: ``sym``, ``minima``, ``emitted``."""
    return f"""with sym as ({_symmetric(edges)}),
        minima as (select src as node, least(src, min(dst)) as smallest from sym group by src),
        emitted as (
            select sym.dst as node, minima.smallest as component
            from sym join minima on minima.node = sym.src
            where minima.smallest < minima.node and sym.dst <> minima.smallest
        )"""


def _step_pairs(name: str) -> str:
    return f"""{_step(EDGE_SQL[name])}
        select node, component from emitted
        union select node, smallest from minima where smallest < node"""


def _log(name: str) -> str:
    """All steps: the working table is the previous step's pairs with their new-pair counts."""
    return f"""with recursive steps(step, node, component, fresh) as (
            select cast(0 as bigint), node, component, cast(1 as bigint)
            from ({_canonical(EDGE_SQL[name])}) given
            union all
            (with sym as (
                select step, node as k, component as v from steps
                where (select sum(fresh) from steps) > 0
                union all
                select step, component, node from steps where (select sum(fresh) from steps) > 0),
            minima as (select step, k, least(k, min(v)) as m from sym group by step, k),
            emitted as (
                select sym.step + 1 as step, sym.v as node, minima.m as component, 1 as fresh
                from sym join minima on minima.k = sym.k where minima.m < minima.k and sym.v <> minima.m
                union all
                select step + 1, k, m, 0 from minima where m < k)
            select step, node, component, cast(sum(fresh) as bigint)
            from emitted group by step, node, component)
        )
        select step as iteration, cast(sum(fresh) as bigint) as new_pairs, count(*) as pairs
        from steps where step > 0 group by step"""


def _stale(before: str, edges: str) -> str:
    """Offences of the components of ``before`` against ``edges``, a larger set."""
    return f"""{_components(edges)},
        old_sym as ({_symmetric(before)}),
        old_cc(node, component) using key (node) as (
            select distinct src, src from old_sym
            union
            select old.node, min(new.component)
            from recurring.old_cc old join old_sym on old_sym.src = old.node join old_cc new on new.node = old_sym.dst
            where new.component < old.component group by old.node
        )
        select 'node of an edge without a row' as reason, node, cast(null as bigint) as component
        from cc where node not in (select node from old_cc)
        union all
        select 'edge between labels', pair.node, pair.component from ({_canonical(edges)}) pair
        join old_cc a on a.node = pair.node join old_cc b on b.node = pair.component where a.component <> b.component
        union all
        select 'forest does not connect the node with its label', node, old_cc.component
        from old_cc join cc using (node) where cc.component <> old_cc.component"""


def oracle_sql() -> dict[str, str]:
    edges = EDGE_SQL["order_part"]
    documents = _components(EDGE_SQL["doc_lines"])
    count = "select count(distinct component) as components from cc"
    wide = f"""{_graph_components()},
        counts as (
            select graph, count(*) as nodes, count(distinct component) as components
            from cc group by graph
        )"""
    sql = {
        "edge_file_parse": edges,
        "edge_lines_malformed": f"{edges} where l_linenumber in (1, 2, 7)",
        "symmetrize": f"{edges} union all select dst, src from ({edges}) given",
        "normalise": _canonical(edges),
        "neighbour_min": f"""select src as node, least(src, min(dst)) as smallest
            from ({_symmetric(edges)}) sym group by src""",
        "adjacency_lists": f"""select src as node, cast(0 as bigint) as part, count(*) as degree,
            string_agg(cast(dst as varchar), ',' order by dst) as neighbours
            from ({_symmetric(edges)}) sym group by src""",
        "adjacency_lists_split": f"""select src as node, count(*) as degree, count(*) > 50 as several,
            string_agg(cast(dst as varchar), ',' order by dst) as neighbours
            from ({_symmetric(EDGE_SQL['part_supplier'])}) sym group by src""",
        "ccf_step_join": _step_pairs("order_part"),
        "ccf_step_array": _step_pairs("order_part"),
        "ccf_step_array_split": _step_pairs("part_supplier"),
        "new_pair_count": f"{_step(edges)} select count(*) as new_pairs from emitted",
        "cc_pairs_no_roots": f"{documents} select node, component from cc where node <> component",
        "cc_pairs_by_component": f"{documents} select component, node from cc where node <> component",
        "cc_documents_all": f"""{documents}
            select doc_id as node, coalesce(component, doc_id) as component
            from documents left join cc on node = doc_id""",
        "cc_by_ccf_array": _cc("order_part"),
        "cc_by_ccf_join": _cc("part_supplier"),
        "cc_by_contraction": _cc("order_part"),
        "cc_part_supplier_hot": _cc("part_supplier"),
        "cc_doc_lines_hot": _cc("doc_lines"),
        "component_count": f"{documents} {count}",
        "component_count_file": f"{_components(EDGE_SQL['customer_order'])} {count}",
        "component_count_pairs": f"{documents} {count}",
        "component_sizes": f"{documents} select component, count(*) as members from cc group by component",
        "multi_graph_counts": f"{wide} select graph, components from counts",
        "ordered_preview": f"""{documents} select node, component from cc
            order by component, node limit {PREVIEW_ROWS}""",
        "unpivot_report": f"""{wide}
            select graph, 'nodes' as measure, nodes as number from counts
            union all select graph, 'components', components from counts""",
        "write_read_assignments": _cc("customer_order"),
        "cc_added_edges": _cc("order_part"),
        "cc_added_links": f"""{_components(f"{EDGE_SQL['doc_lines']} union all {EDGE_SQL['doc_copies']}")}
            select node, component from cc""",
        "cc_stored_updates": _cc("customer_order"),
        "cc_removed_edges": _cc("customer_order_decided"),
        "cc_removed_edges_forest": _cc("order_part_first_lines"),
        "spanning_forest_edges": f"""{documents}
            select component, count(*) - 1 as forest_edges, count(*) - 1 as graph_edges from cc group by component""",
        "cc_by_forest": _cc("order_part"),
        "certificate_accepts": f"{_components(edges)} select count(*) as nodes, cast(0 as bigint) as offences from cc",
        "single_linkage_orders": f"{_cutoff_components()} select cutoff, node, component from cc",
        "spanning_forest_weights": f"""{_cutoff_components()}
            select cutoff, count(*) - count(distinct component) as edges from cc group by cutoff""",
        "edge_lines_separated": """
            select case l_linenumber when 5 then 'no second field' when 6 then 'first field is not an id' else 'edge' end as kind,
                count(*) as lines, (select count(*) from lineitem where l_linenumber in (3, 4)) as skipped
            from lineitem where l_linenumber not in (3, 4) group by kind""",
        "certificate_stale": _stale(EDGE_SQL["customer_order_decided"], EDGE_SQL["customer_order"]),
    }
    sql |= {f"cc_{name}": _cc(name) for name in EDGE_SQL if name not in EARLIER}
    sql |= {
        f"iteration_log_{name}": _log(name)
        for name in ("order_part", "bulk_order_part", "part_supplier", "doc_lines")
    }
    return sql
