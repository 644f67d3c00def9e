"""Plain Python versions of the operators, for small tables of (doc_id, text) rows."""

from __future__ import annotations

import hashlib
import math
import re
import zlib
from collections import Counter, defaultdict

WORD = re.compile(rb"[^\x20\x09-\x0D]+")
TOKEN = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
LOWER = str.maketrans(UPPER, UPPER.lower())


def utf8(text: str | None) -> bytes:
    return (text or "").encode()


def lower(text: str | None) -> str:
    return (text or "").translate(LOWER)


def held_out(doc_id) -> bool:
    return zlib.crc32(b"" if doc_id is None else str(doc_id).encode()) % 7 == 2


def ppm(rows, order: int) -> list[tuple]:
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score) per row."""
    counts, trie = Counter(), defaultdict(Counter)
    for doc_id, text in rows:
        if not held_out(doc_id):
            counts.update([*WORD.findall(lower(text).encode()), None])
            data = b"\0" * order + utf8(text) + b"\0"
            for i in range(order, len(data)):
                for k in range(order + 1):
                    trie[data[i - k : i]][data[i]] += 1
    total, kinds = sum(counts.values()), len(counts)

    def length(context: bytes, byte: int) -> float:
        out, excluded = 0.0, set()
        for k in range(order, -1, -1):
            seen = trie.get(context[order - k :])
            if seen is None:
                continue
            left = {b: n for b, n in seen.items() if b not in excluded}
            room = sum(left.values()) + len(left)
            if byte in left:
                return out + math.log10(left[byte] / room)
            if left:
                out += math.log10(len(left) / room)
            excluded |= set(seen)
        return out - math.log10(256 - len(excluded))

    out = []
    for doc_id, text in rows:
        tokens = [*WORD.findall(lower(text).encode()), None]
        base = sum(math.log10((counts[t] + 1) / (total + kinds + 1)) for t in tokens)
        data = b"\0" * order + utf8(text) + b"\0"
        score = sum(length(data[i - order : i], data[i]) for i in range(order, len(data)))
        known = sum(counts[t] > 0 for t in tokens)
        out.append((doc_id, held_out(doc_id), len(tokens), known, total, base, score))
    return out


def passages(rows, items, window: int = 10) -> list[tuple]:
    """(doc_id, n_words, hit words, item ids) per row."""
    phrases = defaultdict(set)
    for item_id, text in items:
        words = TOKEN.findall(lower(text))
        size = min(window, len(words))
        for i in range(len(words) - size + 1 if words else 0):
            phrases[tuple(words[i : i + size])].add(item_id)
    out = []
    for doc_id, text in rows:
        words, hit, found = TOKEN.findall(lower(text)), set(), set()
        for size in {len(p) for p in phrases}:
            for i in range(len(words) - size + 1):
                if (ids := phrases.get(tuple(words[i : i + size]))) is not None:
                    hit |= set(range(i, i + size))
                    found |= ids
        out.append((doc_id, len(words), hit, found - {None}))
    return out


def shingles(text: str | None, size: int = 5) -> frozenset:
    words = WORD.findall(lower(text).encode())
    return frozenset(tuple(words[i : i + size]) for i in range(max(len(words) - size + 1, 1))) if words else frozenset()


def near_groups(rows) -> list[int]:
    """For each row a number that rows share if links lead from one to the other."""
    sets = [shingles(text) for _, text in rows]
    group = list(range(len(rows)))

    def root(x: int) -> int:
        while group[x] != x:
            x = group[x]
        return x

    for a in range(len(rows)):
        for b in range(a):
            linked = sets[a] and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b])
            if linked or (rows[a][0] is not None and rows[a][0] == rows[b][0]):
                low, high = sorted((root(a), root(b)))
                group[high] = low
    return [root(x) for x in range(len(rows))]


def text_counts(text: str | None) -> tuple[int, int, int, int, int]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words."""
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    lines, seen, twice = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)], set(), 0
    for line in lines:
        twice += line in seen
        seen.add(line)
    windows = Counter(tuple(words[i : i + 8]) for i in range(len(words) - 7))
    covered = set()
    for i in range(len(words) - 7):
        if windows[tuple(words[i : i + 8])] > 1:
            covered |= set(range(i, i + 8))
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), twice, len(covered)


def without_repeats(rows, length: int = 50) -> list[tuple]:
    """(doc_id, n_bytes, spans, kept bytes) per row."""
    least: dict[bytes, float] = {}

    def rank(doc_id) -> float:
        return math.inf if doc_id is None else doc_id

    for doc_id, text in rows:
        data = utf8(text)
        for i in range(len(data) - length + 1):
            piece = data[i : i + length]
            least[piece] = min(least.get(piece, math.inf), rank(doc_id))
    out = []
    for doc_id, text in rows:
        data = utf8(text)
        gone = bytearray(len(data))
        for i in range(len(data) - length + 1):
            if least[data[i : i + length]] < rank(doc_id):
                gone[i : i + length] = b"\1" * length
        spans = [(m.start(), m.end()) for m in re.finditer(b"\1+", bytes(gone))]
        out.append((doc_id, len(data), spans, bytes(c for c, g in zip(data, gone, strict=True) if not g)))
    return out


def without_lines(rows, length: int = 40, documents: int = 5) -> list[tuple]:
    """(doc_id, n_lines, n_dropped, kept) per row."""
    white = " \t\n\x0b\x0c\r"
    holders = defaultdict(set)
    for doc_id, text in rows:
        for line in (text or "").split("\n"):
            holders[lower(line.strip(white))].add(doc_id)
    lost = {k: max((d for d in v if d is not None), default=None) for k, v in holders.items() if len(k) >= length and len(v) >= documents}
    out = []
    for doc_id, text in rows:
        lines = (text or "").split("\n")
        kept = [x for x in lines if not ((k := lower(x.strip(white))) in lost and (doc_id is None or lost[k] != doc_id))]
        out.append((doc_id, len(lines), len(lines) - len(kept), "\n".join(kept)))
    return out


def sha256(value: str | bytes) -> str:
    return hashlib.sha256(value.encode() if isinstance(value, str) else value).hexdigest()


def closest_part(z, part, least, starts, correction, bins=None, first_steps=None, enough=1e-9):
    """The minimum covariance determinant of the rows of ``z``: centre, inverse covariance, log determinant, distances.

    Of all ``starts`` (centre and covariance) the one with the smallest determinant after ``first_steps`` (when they have
    ended, without a number) is followed until the determinant gets smaller by no more than ``enough``. The closest ``part`` is
    exact, or whole bins of distance with ``bins`` bins in a factor of two.
    """
    import numpy as np

    def inverse_of(centre, cov):
        variances, axes = np.linalg.eigh(cov)
        variances = np.maximum(variances, least)
        return np.log(variances).sum(), centre, (axes / variances) @ axes.T

    def distances(centre, inverse):
        return np.einsum("ij,jk,ik->i", z - centre, inverse, z - centre)

    def step(estimate):
        distance = distances(*estimate[1:])
        if bins:
            bin_ = np.floor(bins * np.log2(1 + np.maximum(distance, 0)))
            own = z[np.searchsorted(np.sort(bin_), bin_) < part * len(z)]
        else:
            own = z[np.argsort(distance, kind="stable")[: int(np.ceil(part * len(z)))]]
        return inverse_of(own.mean(0), np.cov(own.T, bias=True) * correction)

    def to_the_end(estimate):
        for _ in range(100):
            before, estimate = estimate, step(estimate)
            if not before[0] - estimate[0] > enough:
                break
        return estimate

    found = [inverse_of(*start) for start in starts]
    if first_steps is None:
        found = [to_the_end(step(estimate)) for estimate in found]
    else:
        for _ in range(first_steps):
            found = [step(estimate) for estimate in found]
    best = min(found, key=lambda one: one[0])
    logdet, centre, inverse = best if first_steps is None else to_the_end(best)
    return centre, inverse, logdet, distances(centre, inverse)
