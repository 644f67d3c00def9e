from archipelago.plans.ccf_rounds import CcfRun, iteration_log, run_ccf
from archipelago.plans.certificate import offences
from archipelago.plans.connected import (
    component_count_from_file,
    connected_components,
    multi_graph,
    multi_graph_counts,
)
from archipelago.plans.contraction import contract
from archipelago.plans.forest import spanning_forest
from archipelago.plans.linkage import minimum_spanning_forest, single_linkage
from archipelago.plans.updates import Update, added_edges, removed_edges

__all__ = [
    "CcfRun",
    "Update",
    "added_edges",
    "component_count_from_file",
    "connected_components",
    "contract",
    "iteration_log",
    "minimum_spanning_forest",
    "multi_graph",
    "multi_graph_counts",
    "offences",
    "removed_edges",
    "run_ccf",
    "single_linkage",
    "spanning_forest",
]
