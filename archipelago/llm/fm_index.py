"""An FM-index over a sequence of small numbers, with vectorised queries."""

from __future__ import annotations

import numpy as np

# Every so many positions of the sequence, the place of its suffix is kept.
SAMPLE = 8


def suffix_array(sequence: np.ndarray) -> np.ndarray:
    """Starts of the sorted suffixes; 0 separates runs, and each 0 differs from all others."""
    n = len(sequence)
    zeros = sequence == 0
    rank = np.where(zeros, np.cumsum(zeros) - 1, sequence + int(zeros.sum())).astype(np.int64)
    order = np.argsort(rank, kind="stable")
    ahead = 1
    while True:
        values = rank[order]
        new = np.concatenate(([0], np.cumsum(values[1:] != values[:-1])))
        rank[order] = new
        if n == 0 or new[-1] == n - 1:
            return order
        # Only suffixes that tie are compared further on; none of them reaches the end, which is a 0.
        tied = np.zeros(n, bool)
        tied[1:] = new[1:] == new[:-1]
        tied[:-1] |= tied[1:]
        at = np.flatnonzero(tied)
        own = order[at]
        again = np.lexsort((rank[own + ahead], rank[own]))
        order[at] = own[again]
        # Ranks leave room for the new order within a tie.
        rank[order] = np.maximum.accumulate(np.where(np.concatenate(([True], new[1:] != new[:-1])), np.arange(n), 0))
        second = np.full(n, -1, np.int64)
        second[at] = rank[own[again] + ahead]
        first = rank[order]
        differs = np.concatenate(([True], (first[1:] != first[:-1]) | (second[1:] != second[:-1])))
        rank[order] = np.cumsum(differs) - 1
        ahead *= 2


class WaveletMatrix:
    """Ranks of numbers in a sequence, bit by bit."""

    def __init__(self, sequence: np.ndarray, bits: int) -> None:
        self._levels = []
        for bit in range(bits - 1, -1, -1):
            ones = (sequence >> bit) & 1
            before = np.concatenate(([0], np.cumsum(ones)))
            zeros = len(sequence) - int(before[-1])
            self._levels.append((bit, before, zeros))
            sequence = np.concatenate((sequence[ones == 0], sequence[ones == 1]))

    def rank(self, value: np.ndarray, at: np.ndarray) -> np.ndarray:
        """How often each value occurs before the place."""
        begin = np.zeros_like(at)
        for bit, before, zeros in self._levels:
            one = ((value >> bit) & 1).astype(bool)
            at = np.where(one, zeros + before[at], at - before[at])
            begin = np.where(one, zeros + before[begin], begin - before[begin])
        return at - begin

    def value(self, at: np.ndarray) -> np.ndarray:
        """The number at each place."""
        found = np.zeros_like(at)
        for bit, before, zeros in self._levels:
            one = before[at + 1] - before[at]
            found |= one << bit
            at = np.where(one == 1, zeros + before[at], at - before[at])
        return found


class FMIndex:
    """Counts and finds phrases in a sequence of numbers from 1 up, where 0 separates runs."""

    def __init__(self, sequence: np.ndarray, sample: int = SAMPLE) -> None:
        if not len(sequence) or sequence[-1] != 0:
            sequence = np.append(sequence, 0)
        sequence = sequence.astype(np.int64)
        suffixes = suffix_array(sequence)
        self._size = len(sequence)
        self._bits = max(1, int(sequence.max()).bit_length())
        counts = np.bincount(sequence, minlength=(1 << self._bits) + 1)
        self._first = np.concatenate(([0], np.cumsum(counts)))
        before = sequence[suffixes - 1]
        self._tree = WaveletMatrix(before, self._bits)
        # The start of each run is sampled too, so that no walk has to pass a separator.
        kept = (suffixes % sample == 0) | (before == 0)
        self._samples = suffixes[kept]
        self._sampled = np.concatenate(([0], np.cumsum(kept)))

    def search(self, phrases: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Backward search of phrases, one a row, all of the same length: ranges of suffixes."""
        known = (phrases < 1 << self._bits).all(axis=1)
        phrases = np.where(known[:, None], phrases, 0)
        low = np.zeros(len(phrases), np.int64)
        high = np.where(known, self._size, 0)
        for column in range(phrases.shape[1] - 1, -1, -1):
            value = phrases[:, column]
            low = self._first[value] + self._tree.rank(value, low)
            high = np.where(known, self._first[value] + self._tree.rank(value, high), low)
            high = np.maximum(high, low)
        return low, high

    def locate(self, rows: np.ndarray) -> np.ndarray:
        """Where the suffixes of these rows start in the sequence."""
        out = np.zeros(len(rows), np.int64)
        todo, steps = np.arange(len(rows)), 0
        while len(todo):
            own = rows[todo]
            done = self._sampled[own + 1] > self._sampled[own]
            out[todo[done]] = self._samples[self._sampled[own[done]]] + steps
            todo, own = todo[~done], own[~done]
            value = self._tree.value(own)
            rows[todo] = self._first[value] + self._tree.rank(value, own)
            steps += 1
        return out
