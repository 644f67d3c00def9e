from archipelago.sources.assignment_store import AssignmentStore
from archipelago.sources.assignments import read_assignments, write_assignments
from archipelago.sources.edge_tables import edges_from_columns, edges_from_shared_value, kind_and_id
from archipelago.sources.edge_text import (
    SeparatedLines,
    parse_edge_lines,
    read_edge_file,
    read_edge_lines,
    separate_edge_lines,
)
from archipelago.sources.round_tables import RoundTables

__all__ = [
    "AssignmentStore",
    "RoundTables",
    "SeparatedLines",
    "edges_from_columns",
    "edges_from_shared_value",
    "kind_and_id",
    "parse_edge_lines",
    "read_assignments",
    "read_edge_file",
    "read_edge_lines",
    "separate_edge_lines",
    "write_assignments",
]
