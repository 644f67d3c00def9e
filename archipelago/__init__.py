"""Connected components of large graphs, as plain PySpark DataFrame jobs."""

from archipelago.operators import (
    adjacency_lists,
    by_component,
    ccf_step,
    component_count,
    component_sizes,
    neighbour_min,
    new_pair_count,
    normalise,
    ordered_preview,
    symmetrize,
    wide_to_long,
)
from archipelago.plans import (
    Update,
    added_edges,
    component_count_from_file,
    connected_components,
    iteration_log,
    minimum_spanning_forest,
    multi_graph,
    multi_graph_counts,
    offences,
    removed_edges,
    run_ccf,
    single_linkage,
    spanning_forest,
)
from archipelago.sources import (
    AssignmentStore,
    RoundTables,
    SeparatedLines,
    edges_from_columns,
    edges_from_shared_value,
    kind_and_id,
    parse_edge_lines,
    read_assignments,
    read_edge_file,
    read_edge_lines,
    separate_edge_lines,
    write_assignments,
)

__all__ = [
    "AssignmentStore",
    "RoundTables",
    "SeparatedLines",
    "Update",
    "added_edges",
    "adjacency_lists",
    "by_component",
    "ccf_step",
    "component_count",
    "component_count_from_file",
    "component_sizes",
    "connected_components",
    "edges_from_columns",
    "edges_from_shared_value",
    "iteration_log",
    "minimum_spanning_forest",
    "kind_and_id",
    "multi_graph",
    "multi_graph_counts",
    "neighbour_min",
    "new_pair_count",
    "normalise",
    "offences",
    "ordered_preview",
    "parse_edge_lines",
    "read_assignments",
    "read_edge_file",
    "read_edge_lines",
    "removed_edges",
    "run_ccf",
    "separate_edge_lines",
    "single_linkage",
    "spanning_forest",
    "symmetrize",
    "wide_to_long",
    "write_assignments",
]
