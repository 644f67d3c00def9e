"""Plain Python models of the operators, for small graphs."""

from __future__ import annotations


def components(edges) -> dict[int, int]:
    """node -> smallest reachable id, for nodes with an edge to another node."""
    leader: dict[int, int] = {}

    def find(node):
        while leader[node] != node:
            node = leader[node]
        return node

    for a, b in edges:
        if a == b:
            continue
        leader.setdefault(a, a)
        leader.setdefault(b, b)
        low, high = sorted((find(a), find(b)))
        leader[high] = low
    return {node: find(node) for node in leader}


def step(pairs) -> tuple[set, int]:
    """The pairs after one CCF step, and the number of new pairs."""
    neighbours: dict[int, set] = {}
    for a, b in pairs:
        if a != b:
            neighbours.setdefault(a, set()).add(b)
            neighbours.setdefault(b, set()).add(a)
    result, new = set(), 0
    for node, others in neighbours.items():
        smallest = min(others)
        if smallest < node:
            rest = others - {smallest}
            result |= {(node, smallest)} | {(other, smallest) for other in rest}
            new += len(rest)
    return result, new


def counts(edges) -> list[int]:
    """New pairs per step, the last being 0."""
    pairs, log = set(edges), []
    while not log or log[-1]:
        pairs, new = step(pairs)
        log.append(new)
    return log
