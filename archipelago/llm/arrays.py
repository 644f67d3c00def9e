"""Numpy helpers that work on whole Arrow string columns at once."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard

# Byte values outside words: white space (tab to carriage return, and the blank).
WHITE = (0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D)

_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 1 << 64)


def any_but_white() -> np.ndarray:
    """Per byte value, whether it belongs to a word that ends at white space."""
    inside = np.ones(256, np.uint8)
    inside[list(WHITE)] = 0
    return inside


def letters_and_digits() -> np.ndarray:
    """Per byte value, whether it is an ASCII letter or digit or part of a non-ASCII character."""
    inside = np.zeros(256, np.uint8)
    inside[0x80:] = 1
    for first, last in ((0x30, 0x39), (0x41, 0x5A), (0x61, 0x7A)):
        inside[first : last + 1] = 1
    return inside


def lower_case(data: np.ndarray) -> np.ndarray:
    """A-Z as a-z, everything else as it is."""
    table = np.arange(256, dtype=np.uint8)
    table[0x41:0x5B] += 0x20
    return table[data]


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string or binary column and where each row begins and ends; null is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    if column.null_count:
        column = column.fill_null(b"" if pa.types.is_binary(column.type) else "")
    _, limits, data = column.buffers()
    size = len(column)
    if size == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    limits = np.frombuffer(limits, np.int64 if wide else np.int32)[column.offset : column.offset + size + 1]
    limits = limits.astype(np.int64)
    everything = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return everything[limits[0] : limits[-1]], limits - limits[0]


def pieces(limits: np.ndarray, size: int) -> Iterator[tuple[int, int]]:
    """Ranges of rows with about ``size`` bytes each, a longer row alone."""
    first, rows = 0, len(limits) - 1
    while first < rows:
        end = int(np.searchsorted(limits, limits[first] + size, "right")) - 1
        end = min(max(end, first + 1), rows)
        yield first, end
        first = end


def text_pieces(column: pa.Array, size: int) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """First row, row after the last, bytes and limits of each piece of a string column."""
    data, limits = utf8(column)
    for first, end in pieces(limits, size):
        own = limits[first : end + 1]
        yield first, end, data[own[0] : own[-1]], own - own[0]


def mix(x: np.ndarray) -> np.ndarray:
    """Spread the bits of 64-bit values (the finalizer of splitmix64)."""
    x = x ^ (x >> np.uint64(30))
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def byte_values() -> np.ndarray:
    """A random 64-bit value for each byte value, the same everywhere."""
    return mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(_BASE))


def eight_bytes(data: np.ndarray) -> np.ndarray:
    """The eight bytes from each place on as one number; there are seven fewer than bytes."""
    if len(data) < 8:
        return np.zeros(0, np.uint64)
    return np.ndarray((len(data) - 7,), "<u8", np.ascontiguousarray(data), strides=(1,))


def words(
    data: np.ndarray, limits: np.ndarray, inside: np.ndarray
) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the words, and how many words each row has."""
    marks = inside[data]
    before, after = np.empty_like(marks), np.empty_like(marks)
    if len(marks):
        before[0], before[1:] = 0, marks[:-1]
        after[-1], after[:-1] = 0, marks[1:]
        edges = limits[1:-1]
        edges = edges[(edges > 0) & (edges < len(marks))]
        before[edges], after[edges - 1] = 0, 0
    starts = np.flatnonzero(marks > before)
    ends = np.flatnonzero(marks > after) + 1
    return starts, ends, np.diff(np.searchsorted(starts, limits))


def powers(base: int, size: int) -> np.ndarray:
    """1, base, base squared and so on, modulo 2 to the 64."""
    out = np.ones(size, np.uint64)
    # The first half times a power gives the second; one after the other, they would wait for each other.
    done = 1
    while done < size:
        more = min(done, size - done)
        np.multiply(out[:more], np.uint64(pow(base, done, 1 << 64)), out=out[done : done + more])
        done += more
    return out


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each span of bytes, which does not depend on where the span lies."""
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(byte_values()[data] * powers(_BASE, len(data)), out=sums[1:])
    shift = powers(_INVERSE, len(data) + 1)[starts]
    return mix((sums[ends] - sums[starts]) * shift + (ends - starts).astype(np.uint64))


def shingles(hashes: np.ndarray, counts: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of ``size`` consecutive words of a row, and how many each row has.

    A row with fewer words, but not none, has one, of all its words.
    """
    first = np.concatenate(([0], np.cumsum(counts)))[:-1]
    found = np.where(counts >= size, counts - size + 1, (counts > 0).astype(counts.dtype))
    at = np.repeat(first - np.concatenate(([0], np.cumsum(found)))[:-1], found) + np.arange(found.sum())
    length = np.repeat(np.minimum(counts, size), found)
    value = np.zeros(len(at), np.uint64)
    padded = np.concatenate((hashes, np.zeros(size, np.uint64)))
    for i in range(size):
        here = np.where(length > i, padded[at + i], np.uint64(0))
        value = value * np.uint64(_BASE) + here
    return mix(value + length.astype(np.uint64)), found


def release() -> None:
    """Give memory that is free inside this Python process back, as it lives on for other tasks."""
    import ctypes

    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim is not None:
        trim(0)


def pack(*arrays: np.ndarray, level: int = 1) -> bytes:
    """Arrays as one compressed value. Sorted 64-bit arrays are best stored as differences."""
    parts = [len(arrays).to_bytes(4, "little")]
    for array in arrays:
        kind = array.dtype.str.encode()
        parts += [bytes([len(kind)]), kind, len(array).to_bytes(8, "little"), array.tobytes()]
    return zstandard.ZstdCompressor(level=level).compress(b"".join(parts))


def unpack(value: bytes) -> list[np.ndarray]:
    """What :func:`pack` was given."""
    raw = zstandard.ZstdDecompressor().decompress(value)
    at, out = 4, []
    for _ in range(int.from_bytes(raw[:4], "little")):
        kind = np.dtype(raw[at + 1 : at + 1 + raw[at]].decode())
        at += 1 + raw[at]
        size = int.from_bytes(raw[at : at + 8], "little")
        out.append(np.frombuffer(raw, kind, size, at + 8))
        at += 8 + size * kind.itemsize
    return out


def differences(values: np.ndarray) -> np.ndarray:
    """Sorted values as steps from one to the next."""
    return np.diff(values, prepend=values.dtype.type(0))


def find(table: np.ndarray, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where each value stands in a sorted table, and whether it is there."""
    if not len(table):
        return np.zeros(len(values), np.int64), np.zeros(len(values), bool)
    at = np.minimum(np.searchsorted(table, values), len(table) - 1)
    return at, table[at] == values


def split_runs(part: np.ndarray, parts: int) -> list[np.ndarray]:
    """The places of each part, in their order."""
    order = np.argsort(part, kind="stable")
    return np.split(order, np.searchsorted(part[order], np.arange(1, parts)))


def merged(values: list[np.ndarray], counts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Distinct values and the sums of their counts."""
    if not values:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    found, at = np.unique(np.concatenate(values), return_inverse=True)
    return found, np.bincount(at, np.concatenate(counts), len(found)).astype(np.int64)
