from archipelago.operators.ccf import ccf_step, dedup, emitted_pairs, new_pair_count
from archipelago.operators.components import component_count, component_sizes, with_roots, with_vertices
from archipelago.operators.lookup import lookup
from archipelago.operators.neighbours import adjacency_lists, neighbour_min
from archipelago.operators.pairs import as_edges, by_component, normalise, symmetrize
from archipelago.operators.reports import ordered_preview, wide_to_long

__all__ = [
    "adjacency_lists",
    "as_edges",
    "by_component",
    "ccf_step",
    "component_count",
    "component_sizes",
    "dedup",
    "emitted_pairs",
    "lookup",
    "neighbour_min",
    "new_pair_count",
    "normalise",
    "ordered_preview",
    "symmetrize",
    "wide_to_long",
    "with_roots",
    "with_vertices",
]
