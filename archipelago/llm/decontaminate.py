"""Find benchmark passages in documents, with an FM-index for each shard of text.

A shard's words become numbers in the benchmark's vocabulary; other words separate runs, and runs too
short for any phrase are left out. Every phrase is searched backward in the shard's index, and
its occurrences are located by sampled suffixes and merged to spans.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from archipelago.llm.arrays import (
    find,
    letters_and_digits,
    lower_case,
    pack,
    release,
    span_hashes,
    text_pieces,
    unpack,
    words,
)
from archipelago.llm.fm_index import FMIndex
from archipelago.llm.tables import text_bytes, written

WINDOW = 10
# Bytes of text of a shard, and of benchmark items that are searched for at a time.
SHARD = 1 << 20
ITEMS = 1 << 23
# Blocks of items that one pass over the documents searches for.
PASS = 4

_SPANS = "array<struct<first:bigint,last:bigint,start:bigint,end:bigint>>"
_COLUMNS = f"n_words bigint, spans {_SPANS}, items array<bigint>"


def _words(data: np.ndarray, limits: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    data = lower_case(data)
    starts, ends, counts = words(data, limits, letters_and_digits())
    return span_hashes(data, starts, ends), starts, ends, counts


@dataclass(frozen=True)
class Phrases:
    """The windows of some benchmark items, over the vocabulary of these items."""

    vocabulary: np.ndarray
    windows: list[np.ndarray]  # by length; one phrase a row, words numbered from 1
    items: list[tuple[np.ndarray, np.ndarray]]  # by length: where each phrase's item ids begin, the ids

    @staticmethod
    def of(item_ids: list[int | None], texts: list[str | None], window: int = WINDOW) -> Phrases:
        """Windows of ``window`` words; an item of fewer words, but not none, is one window."""
        column = pa.array(texts, pa.string())
        groups: dict[int, dict[tuple, set]] = {}
        parts = list(text_pieces(column, ITEMS))
        hashed = [(first, *_words(data, limits)) for first, _, data, limits in parts]
        vocabulary = np.unique(np.concatenate([h for _, h, *_ in hashed] or [np.zeros(0, np.uint64)]))
        for first, hashes, _, _, counts in hashed:
            numbers = np.searchsorted(vocabulary, hashes) + 1
            at = 0
            for row, count in enumerate(counts.tolist()):
                own, at = numbers[at : at + count].tolist(), at + count
                size = min(count, window)
                for i in range(count - size + 1 if count else 0):
                    found = groups.setdefault(size, {}).setdefault(tuple(own[i : i + size]), set())
                    if item_ids[first + row] is not None:
                        found.add(item_ids[first + row])
        windows, items = [], []
        for _, group in sorted(groups.items()):
            windows.append(np.array(list(group), np.int64))
            sizes = np.array([len(ids) for ids in group.values()], np.int64)
            flat = np.array([i for ids in group.values() for i in sorted(ids)], np.int64)
            items.append((np.concatenate(([0], np.cumsum(sizes))), flat))
        return Phrases(vocabulary, windows, items)

    def packed(self) -> bytes:
        widths = np.array([w.shape[1] for w in self.windows], np.int64)
        each = [x for w, (begins, ids) in zip(self.windows, self.items, strict=True) for x in (w.ravel(), begins, ids)]
        return pack(self.vocabulary, widths, *each)

    @classmethod
    def unpacked(cls, value: bytes) -> Phrases:
        vocabulary, widths, *each = unpack(value)
        windows = [flat.reshape(-1, width) for flat, width in zip(each[::3], widths.tolist(), strict=True)]
        return cls(vocabulary, windows, list(zip(each[1::3], each[2::3], strict=True)))

    def occurrences(self, hashes: np.ndarray, counts: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray, int]]:
        """For each window length: the group's number, phrases found, the words they begin at, the length."""
        if not self.windows or not len(hashes):
            return
        number, known = find(self.vocabulary, hashes)
        # Runs of known words within a text.
        begin = known.copy()
        text_starts = np.concatenate(([0], np.cumsum(counts)))[:-1][counts > 0]
        first_of_text = np.zeros(len(known), bool)
        first_of_text[text_starts] = True
        begin[1:] &= ~known[:-1] | first_of_text[1:]
        run = np.cumsum(begin)
        sizes = np.bincount(run[known], minlength=int(run[-1]) + 1)
        kept = np.flatnonzero(known & (sizes[run] >= min(w.shape[1] for w in self.windows)))
        if not len(kept):
            return
        heads = np.flatnonzero(begin[kept])
        sequence = np.insert(number[kept] + 1, heads, 0)
        place = np.insert(kept, heads, -1)
        index = FMIndex(np.append(sequence, 0))
        for group, phrases in enumerate(self.windows):
            low, high = index.search(phrases)
            found = high - low
            phrase = np.repeat(np.arange(len(phrases)), found)
            shift = np.concatenate(([0], np.cumsum(found)))[:-1]
            rows = np.arange(int(found.sum())) + np.repeat(low - shift, found)
            yield group, phrase, place[index.locate(rows)], phrases.shape[1]


def _ranges(values: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row, first and last of the spans found so far."""
    row = np.repeat(np.arange(len(values)), values.value_lengths().to_numpy(zero_copy_only=False))
    flat = values.flatten()
    return row, flat.field("first").to_numpy(zero_copy_only=False), flat.field("last").to_numpy(zero_copy_only=False)


def _marked(docs: DataFrame, phrases: Phrases) -> DataFrame:
    """Add what some items' phrases hit to the columns ``n_words, spans, items``."""
    place = docs.columns.index("text")
    span = pa.struct([(name, pa.int64()) for name in ("first", "last", "start", "end")])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, end, data, limits in text_pieces(batch.column(place), SHARD):
                own = batch.slice(first, end - first)
                hashes, starts, ends, counts = _words(data, limits)
                text_ends = np.concatenate(([0], np.cumsum(counts)))
                text = np.repeat(np.arange(len(own)), counts)
                covered = np.zeros(len(hashes) + 1, np.int64)
                row, head, tail = _ranges(own.column(own.schema.get_field_index("spans")))
                np.add.at(covered, text_ends[row] + head, 1)
                np.add.at(covered, text_ends[row] + tail, -1)
                pairs = []
                for group, phrase, at, size in phrases.occurrences(hashes, counts):
                    np.add.at(covered, at, 1)
                    np.add.at(covered, at + size, -1)
                    begins, ids = phrases.items[group]
                    pair = np.unique(text[at] * len(phrases.windows[group]) + phrase)
                    texts, phrase = np.divmod(pair, len(phrases.windows[group]))
                    sizes = begins[phrase + 1] - begins[phrase]
                    shift = np.concatenate(([0], np.cumsum(sizes)))[:-1]
                    each = np.arange(int(sizes.sum())) + np.repeat(begins[phrase] - shift, sizes)
                    pairs.append(np.stack((np.repeat(texts, sizes), ids[each])))
                hit = np.cumsum(covered)[:-1] > 0
                # Spans: runs of hit words within a text.
                before = np.concatenate(([False], hit[:-1]))
                before[text_ends[:-1][counts > 0]] = False
                opens = np.flatnonzero(hit & ~before)
                after = np.concatenate((hit[1:], [False]))
                after[text_ends[1:][counts > 0] - 1] = False
                closes = np.flatnonzero(hit & ~after)
                of, base = text[opens], text_ends[text[opens]]
                values = pa.StructArray.from_arrays(
                    [pa.array(x) for x in (opens - base, closes + 1 - base, starts[opens] - limits[of], ends[closes] - limits[of])],
                    fields=list(span),
                )
                at = np.searchsorted(of, np.arange(len(own) + 1)).astype(np.int32)
                earlier = own.column(own.schema.get_field_index("items"))
                row = np.repeat(np.arange(len(own)), earlier.value_lengths().to_numpy(zero_copy_only=False))
                pairs.append(np.stack((row, earlier.flatten().to_numpy(zero_copy_only=False).astype(np.int64))))
                found = np.unique(np.concatenate(pairs, axis=1), axis=1)
                item_at = np.searchsorted(found[0], np.arange(len(own) + 1)).astype(np.int32)
                new = {
                    "n_words": pa.array(counts, pa.int64()),
                    "spans": pa.ListArray.from_arrays(pa.array(at), values),
                    "items": pa.ListArray.from_arrays(pa.array(item_at), pa.array(found[1])),
                }
                for name, column in new.items():
                    own = own.set_column(own.schema.get_field_index(name), name, column)
                yield own
        release()

    return docs.mapInArrow(run, docs.schema)


def contaminated(docs: DataFrame, benchmark: DataFrame, *keep: str) -> DataFrame:
    """The columns ``keep`` of each document, ``text``, and what the benchmark's windows hit in it.

    Words are runs of ASCII letters, digits and non-ASCII characters, with A-Z in lower case. A window is
    ten consecutive words of an item, or all of an item with fewer, but not none. ``n_words`` counts the document's
    words, ``spans`` are the merged runs of words inside any occurrence of a window (first word, word
    after the last, and the UTF-8 bytes they take up), ``items`` the ids of the items with occurring windows. Null
    texts have no words; items without id hit, but are not listed; rows with equal ``item_id`` are one item.
    Every row of ``docs`` gives a row; empty tables are fine. The benchmark's windows are made by tasks, in blocks of items of
    about ``ITEMS`` bytes; the driver holds one block at a time for each of the ``PASS`` that a pass over the documents looks for.
    """
    empty = {"n_words": F.lit(0).cast("bigint"), "spans": F.array().cast(_SPANS), "items": F.array().cast("array<bigint>")}
    marked = docs.select(*keep, "text", *[value.alias(name) for name, value in empty.items()])
    numbers, blocks = phrase_blocks(benchmark)
    for done, number in enumerate(numbers):
        if done and done % PASS == 0:
            marked = written(marked, "marked")
        payload = blocks.filter(F.col("block") == number).select("payload").first()["payload"]
        marked = _marked(marked, Phrases.unpacked(bytes(payload)))
    return marked if numbers else _marked(marked, Phrases.of([], []))


def phrase_blocks(benchmark: DataFrame) -> tuple[list[int], DataFrame]:
    """The numbers of the blocks that the benchmark's items are dealt to, and ``block, payload``: the windows of each."""
    items = benchmark.select(F.col("item_id").cast("bigint").alias("item_id"), "text").distinct()
    count = max(1, -(-text_bytes(items) // ITEMS))
    block = F.pmod(F.xxhash64("item_id", "text"), F.lit(count)).cast("int").alias("block")

    def run(key: tuple, group: pa.Table) -> pa.Table:
        phrases = Phrases.of(group["item_id"].to_pylist(), group["text"].to_pylist())
        return pa.table({"block": pa.array([key[0].as_py()], pa.int32()), "payload": pa.array([phrases.packed()], pa.binary())})

    made = items.select(block, "item_id", "text").groupBy("block").applyInArrow(run, "block int, payload binary")
    blocks = written(made, "phrases")
    # One number for each ITEMS bytes of the benchmark.
    return sorted(row["block"] for row in blocks.select("block").collect()), blocks


def hit_words(spans: str = "spans") -> Column:
    """Words inside spans."""
    return F.aggregate(spans, F.lit(0).cast("bigint"), lambda n, span: n + span["last"] - span["first"])


def drop_contaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows of ``docs`` that hold no window of the benchmark, with all their columns."""
    spare = {"n_words": "_n_words", "spans": "_spans", "items": "_items"}
    inner = docs.withColumnsRenamed({name: f"_kept_{name}" for name in spare if name in docs.columns})
    others = [name for name in inner.columns if name != "text"]
    clean = contaminated(inner, benchmark, *others).filter(F.size("spans") == 0).drop(*spare)
    back = {f"_kept_{name}": name for name in spare}
    return clean.withColumnsRenamed(back).select(*docs.columns)


def cut_spans(data: bytes, spans: list[tuple[int, int]]) -> bytes:
    """A text's bytes without some spans (start and end, ascending)."""
    parts, at = [], 0
    for start, end in spans:
        parts.append(data[at:start])
        at = end
    return b"".join([*parts, data[at:]])
