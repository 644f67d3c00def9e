from archipelago.functions.expressions import has_field, id_field, is_edge_line, smallest_in_neighbourhood

__all__ = ["has_field", "id_field", "is_edge_line", "smallest_in_neighbourhood"]
