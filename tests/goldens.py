"""The published sample graph with its published first step, and what follows from it."""

TOY = [(1, 2), (2, 3), (2, 4), (4, 5), (6, 7), (7, 8)]
FIRST = {(2, 1), (3, 1), (3, 2), (4, 2), (4, 1), (5, 2), (5, 4), (7, 6), (8, 7), (8, 6)}
# Computed with tests/model.py.
SECOND = {(2, 1), (3, 1), (4, 1), (4, 2), (5, 1), (5, 2), (7, 6), (8, 6)}
LAST = {(2, 1), (3, 1), (4, 1), (5, 1), (7, 6), (8, 6)}
