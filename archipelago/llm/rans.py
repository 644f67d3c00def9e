"""Static range asymmetric numeral system over blocks of token ids.

A block codes its ids in ``LANES`` interleaved streams, id ``t * LANES + j`` in lane j, so that one numpy
operation moves all lanes a step. All lanes share one sequence of 32-bit words. Every ``INTERVAL``
steps the block keeps a checkpoint: the lanes' states, the place in the words, and the checksum of the
ids up to the next one, so that segments can be decoded by themselves and in parallel.

Block format (little endian): ``RANS``, version, number of ids, checksum of the frequency table, lanes,
interval, number of checkpoints, number of words; for each checkpoint its place, its checksum and its
states; the words; the checksum of all of that.
"""

from __future__ import annotations

import struct
import zlib
from dataclasses import dataclass

import numpy as np

# Fixed values of the format.
MAGIC = b"RANS"
VERSION = 1
SCALE = 20
LANES = 1024
INTERVAL = 256
_LOW = 1 << 31
_HEAD = "<4sHQIIIIQ"


@dataclass(frozen=True)
class Frequencies:
    """Frequencies of all ids, which sum to ``1 << SCALE``."""

    share: np.ndarray
    before: np.ndarray

    @staticmethod
    def of(share: np.ndarray) -> Frequencies:
        share = share.astype(np.uint64)
        return Frequencies(share, np.cumsum(share, dtype=np.uint64) - share)

    @staticmethod
    def from_counts(counts: np.ndarray) -> Frequencies:
        """Shares in proportion to the counts, at least 1 for every id that occurs."""
        total, size = int(counts.sum()), 1 << SCALE
        if not total:
            return Frequencies.of(np.zeros(len(counts), np.uint64))
        if np.count_nonzero(counts) > size:
            raise ValueError("more different ids than the table has room for")
        exact = counts * (size / total)
        share = np.where(counts > 0, np.maximum(np.floor(exact), 1), 0).astype(np.int64)
        over = int(share.sum()) - size
        if over < 0:
            share[np.argmax(share)] -= over
        while over > 0:
            large = np.argsort(-share, kind="stable")[: max(1, min(over, int((share > 1).sum())))]
            share[large] -= 1
            over = int(share.sum()) - size
        return Frequencies.of(share)

    def checksum(self) -> int:
        return zlib.crc32(self.share.astype("<u4").tobytes())


def id_checksum(ids: np.ndarray) -> int:
    """CRC-32 of ids as little-endian unsigned 32-bit integers."""
    return zlib.crc32(ids.astype("<u4").tobytes())


def encode(ids: np.ndarray, table: Frequencies, lanes: int = LANES, interval: int = INTERVAL) -> bytes:
    """One block."""
    n = len(ids)
    steps = -(-n // lanes)
    filler = int(np.argmax(table.share)) if n else 0
    padded = np.full(steps * lanes, filler, np.int64)
    padded[:n] = ids
    padded = padded.reshape(steps, lanes)
    state = np.full(lanes, _LOW, np.uint64)
    shift, low = np.uint64(63 - SCALE), np.uint64(0xFFFFFFFF)
    words: list[np.ndarray] = []
    states: list[np.ndarray] = []
    for t in range(steps - 1, -1, -1):
        share = table.share[padded[t]]
        full = state >= (share << shift)
        if full.any():
            words.append((state[full] & low).astype(np.uint32))
            state = np.where(full, state >> np.uint64(32), state)
        else:
            words.append(np.zeros(0, np.uint32))
        part = state // share
        state = (part << np.uint64(SCALE)) + (state - part * share) + table.before[padded[t]]
        if t % interval == 0:
            states.append(state)
    words.reverse()
    states.reverse()
    places = np.concatenate(([0], np.cumsum([len(w) for w in words], dtype=np.int64)))
    every = lanes * interval
    parts = [
        struct.pack("<QI", int(places[k * interval]), id_checksum(ids[k * every : (k + 1) * every]))
        + own.astype("<u8").tobytes()
        for k, own in enumerate(states)
    ]
    head = struct.pack(_HEAD, MAGIC, VERSION, n, table.checksum(), lanes, interval, len(states), int(places[-1]))
    body = head + b"".join(parts) + b"".join(w.astype("<u4").tobytes() for w in words)
    return body + struct.pack("<I", zlib.crc32(body))


class Decoder:
    """Reads blocks that share one frequency table."""

    def __init__(self, table: Frequencies) -> None:
        self._table = table
        self._checksum = table.checksum()
        self._ids = np.repeat(np.arange(len(table.share), dtype=np.int64), table.share.astype(np.int64))

    def segments(self, block: bytes) -> int:
        """How many segments can be decoded by themselves."""
        return struct.unpack_from(_HEAD, block)[6]

    def decode(self, block: bytes, first: int = 0, last: int | None = None) -> np.ndarray:
        """The ids of the segments from ``first`` up to ``last``; errors in what is read raise."""
        magic, version, n, checksum, lanes, interval, count, size = struct.unpack_from(_HEAD, block)
        if magic != MAGIC or version != VERSION:
            raise ValueError("not a block of this format")
        if zlib.crc32(block[:-4]) != struct.unpack("<I", block[-4:])[0]:
            raise ValueError("a block is damaged")
        if checksum != self._checksum:
            raise ValueError("a block belongs to another frequency table")
        last = count if last is None else last
        each = struct.calcsize("<QI") + 8 * lanes
        words = np.frombuffer(block, "<u4", size, struct.calcsize(_HEAD) + count * each).astype(np.uint64)
        found = [np.zeros(0, np.uint32)]
        every = lanes * interval
        for k in range(first, last):
            own = self._segment(block, struct.calcsize(_HEAD) + k * each, words, min(every, n - k * every), lanes)
            found.append(own)
        return np.concatenate(found)

    def _segment(self, block: bytes, at: int, words: np.ndarray, n: int, lanes: int) -> np.ndarray:
        place, checksum = struct.unpack_from("<QI", block, at)
        state = np.frombuffer(block, "<u8", lanes, at + 12).astype(np.uint64)
        share, before = self._table.share, self._table.before
        mask, scale, low = np.uint64((1 << SCALE) - 1), np.uint64(SCALE), np.uint64(_LOW)
        steps = -(-n // lanes)
        out = np.empty((steps, lanes), np.uint32)
        for t in range(steps):
            slot = state & mask
            ids = self._ids[slot.astype(np.int64)]
            out[t] = ids
            state = share[ids] * (state >> scale) + slot - before[ids]
            need = np.flatnonzero(state < low)
            if len(need):
                state[need] = (state[need] << np.uint64(32)) | words[place : place + len(need)]
                place += len(need)
        out = out.ravel()[:n]
        if id_checksum(out) != checksum:
            raise ValueError("a segment does not decode to its checksum")
        return out
