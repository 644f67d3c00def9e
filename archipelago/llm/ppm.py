"""Score documents with prediction by partial matching over bytes.

The model is a trie of byte contexts up to ``ORDER`` bytes with the counts of the bytes that followed
them in the training documents. A byte is predicted in its longest known context; if it never
followed that, an escape is coded (as often as the context has had new bytes) and the next
shorter context is tried, without the bytes that the longer one would have predicted. Contexts before
a document's first byte and the end after its last are zero bytes.

Nothing of the trie is ever in one place. Each shard of text reduces its events (context and byte in
one 64-bit number) to the distinct ones and deals them out by the context's last two bytes. What a part
receives includes whole subtries, so it can work out the code length of each event it was sent, and sends
these back to the shards. Only the counts of single contexts of one byte and of none (65,536
numbers at most) are shared with all parts. Word counts for the base score make the same journey.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from archipelago.llm.arrays import (
    any_but_white,
    differences,
    find,
    lower_case,
    merged,
    mix,
    pack,
    release,
    span_hashes,
    split_runs,
    text_pieces,
    unpack,
    words,
)
from archipelago.llm.tables import by_shard, from_ipc, part_count, text_bytes, text_shards, written

# Bytes of context; an event has one byte more, and they must fit into 64 bits.
ORDER = 5
# Contexts up to this length are shared with all parts.
SHARED = 1
# A document is held out if the checksum of its id is this, modulo HELD_OUT_OF.
HELD_OUT, HELD_OUT_OF = 2, 7

_PIECE = 1 << 19
_END = np.uint64(0x00E4D0FDEADBEEF1)  # the end token's hash


def _events(data: np.ndarray, limits: np.ndarray, order: int = ORDER) -> tuple[np.ndarray, np.ndarray]:
    """Each text's bytes and end with the ``order`` bytes before them, and where each text's begin."""
    rows = len(limits) - 1
    # Each text gets order + 1 zero bytes at its end: one for the end, the others start the next text.
    gap = order + 1
    size = len(data) + rows * gap
    spread = np.zeros(order + size, np.uint8)
    row = np.repeat(np.arange(rows), np.diff(limits))
    spread[order + np.arange(len(data)) + row * gap] = data
    events = np.zeros(size, np.uint64)
    for i in range(gap):
        events = (events << np.uint64(8)) | spread[i : i + size]
    begins = limits + np.arange(rows + 1) * gap
    kept = np.ones(size, bool)
    for i in range(1, gap):
        kept[begins[1:] - i] = False
    return events[kept], limits + np.arange(rows + 1)


def _tokens(data: np.ndarray, limits: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of each text's words and its end token, and where each text's begin."""
    data = lower_case(data)
    starts, ends, counts = words(data, limits, any_but_white())
    at = np.cumsum(counts)
    return np.insert(span_hashes(data, starts, ends), at, _END), np.concatenate(([0], at + np.arange(1, len(at) + 1)))


def _counted(values: np.ndarray, learn: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct values, and how often each occurs where ``learn`` is true."""
    known, counts = np.unique(values[learn], return_counts=True)
    others = np.unique(values[~learn])
    _, seen = find(known, others)
    others = others[~seen]
    found = np.concatenate((known, others))
    order = np.argsort(found, kind="stable")
    return found[order], np.concatenate((counts, np.zeros(len(others), np.int64)))[order]


def _shard_counts(shard: pa.Table) -> list[tuple[np.ndarray, np.ndarray]]:
    """Events and words of a shard, distinct, with their counts in training documents."""
    gathered: list[list[tuple[np.ndarray, np.ndarray]]] = [[], []]
    held_out = shard.column("held_out").to_numpy()
    for first, end, data, limits in text_pieces(shard.column("text"), _PIECE):
        learn = ~held_out[first:end]
        for kind, make in enumerate((_events, _tokens)):
            values, begins = make(data, limits)
            gathered[kind].append(_counted(values, np.repeat(learn, np.diff(begins))))
    return [merged([v for v, _ in parts], [c for _, c in parts]) for parts in gathered]


def _event_part(events: np.ndarray, parts: int) -> np.ndarray:
    """The part of an event: by the last ``SHARED + 1`` bytes of its context."""
    context = (events >> np.uint64(8)) & np.uint64((1 << 8 * (SHARED + 1)) - 1)
    return (mix(context + np.uint64(1)) % np.uint64(parts)).astype(np.int64)


def _deal(shards: DataFrame, parts: int) -> DataFrame:
    """``shard, part, payload``: what each shard sends to each part."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for number, shard in by_shard(batches):
            (events, e_counts), (tokens, t_counts) = _shard_counts(shard)
            to_parts = split_runs(_event_part(events, parts), parts)
            tokens_to = split_runs((tokens % np.uint64(parts)).astype(np.int64), parts)
            sent = [part for part in range(parts) if len(to_parts[part]) or len(tokens_to[part])]
            payloads = []
            for part in sent:
                e, t = to_parts[part], tokens_to[part]
                payloads.append(pack(differences(events[e]), e_counts[e], differences(tokens[t]), t_counts[t]))
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(np.full(len(sent), number)),
                    pa.array(np.array(sent, np.int32)),
                    pa.array(payloads, pa.binary()),
                ],
                names=["shard", "part", "payload"],
            )
        release()

    return shards.mapInArrow(run, "shard bigint, part int, payload binary")


def _sent(payload: bytes) -> list[np.ndarray]:
    events, e_counts, tokens, t_counts = unpack(payload)
    return [np.cumsum(events, dtype=np.uint64), e_counts, np.cumsum(tokens, dtype=np.uint64), t_counts]


class Trie:
    """Counts of contexts of all lengths.

    ``levels`` has, by context length from the longest to 0, the sorted events (contexts with the byte
    after them, all in training) and their counts. Each level's contexts must be in the next shorter one's.
    """

    def __init__(self, levels: dict[int, tuple[np.ndarray, np.ndarray]]) -> None:
        self.levels: dict[int, tuple[np.ndarray, ...]] = {}
        for k, (events, counts) in sorted(levels.items()):
            contexts, first = np.unique(events >> np.uint64(8), return_index=True)
            # What the shorter context has seen of the bytes that the longer one predicts.
            shorter = np.zeros(len(events), np.int64)
            if k:
                at, _ = find(levels[k - 1][0], events & _mask(k))
                shorter = levels[k - 1][1][at]
            sums = [np.add.reduceat(x, first) if len(first) else x[:0] for x in (counts, shorter)]
            kinds = np.diff(np.append(first, len(events)))
            self.levels[k] = (events, counts, contexts, sums[0], kinds, sums[1])

    def log10(self, events: np.ndarray) -> np.ndarray:
        """The log10 probability of each event's byte in its context."""
        out = np.zeros(len(events))
        todo = np.arange(len(events))
        gone_count, gone_kinds = np.zeros(len(events)), np.zeros(len(events))
        for k in sorted(self.levels, reverse=True):
            seen, count, contexts, total, kinds, shorter = self.levels[k]
            own = events[todo] & _mask(k + 1)
            at, known = find(contexts, own >> np.uint64(8))
            where, at = todo[known], at[known]
            left, new = total[at] - gone_count[where], kinds[at] - gone_kinds[where]
            place, hit = find(seen, own[known])
            room = left + new
            out[where[hit]] += np.log10(count[place[hit]] / room[hit])
            escaped = ~hit
            # Where all bytes of the context are excluded, nothing is coded.
            coded = escaped & (new > 0)
            out[where[coded]] += np.log10(new[coded] / room[coded])
            gone_count[where[escaped]] = shorter[at[escaped]]
            gone_kinds[where[escaped]] = kinds[at[escaped]]
            rest = np.ones(len(events), bool)
            rest[where[hit]] = False
            todo = todo[rest[todo]]
        out[todo] -= np.log10(256 - gone_kinds[todo])
        return out


def _mask(size: int) -> np.uint64:
    return np.uint64((1 << 8 * size) - 1)


def _shorter(events: np.ndarray, counts: np.ndarray, longest: int, last: int) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """The levels from ``longest`` down to ``last`` bytes of context."""
    levels = {}
    for k in range(longest, last - 1, -1):
        events, counts = merged([events & _mask(k + 1)], [counts])
        levels[k] = events, counts
    return levels


def _shared_counts(shards: DataFrame) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """The levels up to ``SHARED`` bytes of context: at most 256 events for each context."""
    size = 1 << 8 * (SHARED + 1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(size, np.int64)
        for _, shard in by_shard(batches):
            held_out = shard.column("held_out").to_numpy()
            for first, end, data, limits in text_pieces(shard.column("text"), _PIECE):
                events, begins = _events(data, limits, SHARED)
                learn = np.repeat(~held_out[first:end], np.diff(begins))
                total += np.bincount(events[learn].astype(np.int64), minlength=size)
        seen = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(seen), pa.array(total[seen])], names=["event", "n"])

    rows = shards.mapInArrow(run, "event bigint, n bigint").groupBy("event").agg(F.sum("n").alias("n"))
    found = sorted((row["event"], row["n"]) for row in rows.collect())
    events, counts = np.array([e for e, _ in found], np.uint64), np.array([n for _, n in found], np.int64)
    return _shorter(events, counts, SHARED, 0)


_ANSWER = "shard bigint, totals boolean, kinds bigint, tokens bigint, payload binary"


def _answer(dealt: DataFrame, shared: dict[int, tuple[np.ndarray, np.ndarray]]) -> DataFrame:
    """Code lengths and counts for each shard's events and words (``_ANSWER``), from all parts.

    A part also has a row of ``totals``: how many different words in training it knows, and how many all.
    """

    def run(key: tuple, group: pa.Table) -> pa.Table:
        sent = [_sent(payload) for payload in group.column("payload").to_pylist()]
        events, at = np.unique(np.concatenate([s[0] for s in sent]), return_inverse=True)
        counts = np.bincount(at, np.concatenate([s[1] for s in sent]), len(events)).astype(np.int64)
        seen = counts > 0
        trie = Trie(_shorter(events[seen], counts[seen], ORDER, SHARED + 1) | shared)
        lengths = trie.log10(events).astype(np.float32)
        tokens, t_at = np.unique(np.concatenate([s[2] for s in sent]), return_inverse=True)
        t_counts = np.bincount(t_at, np.concatenate([s[3] for s in sent]), len(tokens)).astype(np.int64)
        shards, payloads, e, t = group.column("shard").to_pylist(), [], 0, 0
        for own_events, _, own_tokens, _ in sent:
            answer = lengths[at[e : e + len(own_events)]], t_counts[t_at[t : t + len(own_tokens)]]
            payloads.append(pack(differences(own_events), answer[0], differences(own_tokens), answer[1]))
            e, t = e + len(own_events), t + len(own_tokens)
        own = len(shards)
        release()
        return pa.table(
            {
                "shard": pa.array([*shards, -1 - key[0].as_py()], pa.int64()),
                "totals": [False] * own + [True],
                "kinds": pa.array([0] * own + [int(np.count_nonzero(t_counts))], pa.int64()),
                "tokens": pa.array([0] * own + [int(t_counts.sum())], pa.int64()),
                "payload": pa.array([*payloads, None], pa.binary()),
            }
        )

    return dealt.groupBy("part").applyInArrow(run, _ANSWER)


class _Lookup:
    """Finds values that a sorted table has, by way of a hash table of about eight slots a value."""

    def __init__(self, table: np.ndarray) -> None:
        self._table = table
        bits = max(10, int(len(table) * 8).bit_length())
        self._shift = np.uint64(64 - bits)
        self._slots = np.zeros(1 << bits, np.int32)
        self._slots[self._slot(table)] = np.arange(len(table))

    def _slot(self, values: np.ndarray) -> np.ndarray:
        return ((values * np.uint64(0x9E3779B97F4A7C15)) >> self._shift).astype(np.int64)

    def find(self, values: np.ndarray) -> np.ndarray:
        at = self._slots[self._slot(values)]
        missed = np.flatnonzero(self._table[at] != values)
        at[missed] = np.searchsorted(self._table, values[missed])
        return at


_SCORED = """totals boolean, doc_id bigint, held_out boolean, n_tokens bigint, n_known bigint,
    log_counts double, score double"""


def _scored(shards: DataFrame, answers: DataFrame) -> DataFrame:
    """One row per document (``_SCORED``), and one row of totals per part.

    ``log_counts`` is the sum of log10(count + 1) over a document's tokens. On rows of totals, ``n_tokens``
    and ``n_known`` are all words in training and how many different ones.
    """

    def score(shard: pa.Table, sent: list[list[np.ndarray]]) -> pa.Table:
        tables = []
        for key in (0, 2):
            keys = np.concatenate([s[key] for s in sent])
            order = np.argsort(keys, kind="stable")
            tables.append((_Lookup(keys[order]), np.concatenate([s[key + 1] for s in sent])[order]))
        (events_at, lengths), (tokens_at, counts) = tables
        rows = shard.num_rows
        n_tokens, n_known = np.zeros(rows, np.int64), np.zeros(rows, np.int64)
        log_counts, total = np.zeros(rows), np.zeros(rows)
        for first, end, data, limits in text_pieces(shard.column("text"), _PIECE):
            values, begins = _events(data, limits)
            total[first:end] = np.add.reduceat(lengths[events_at.find(values)], begins[:-1], dtype=np.float64)
            values, begins = _tokens(data, limits)
            count = counts[tokens_at.find(values)]
            n_tokens[first:end] = np.diff(begins)
            n_known[first:end] = np.add.reduceat(count > 0, begins[:-1], dtype=np.int64)
            log_counts[first:end] = np.add.reduceat(np.log10(count + 1.0), begins[:-1])
        release()
        return pa.table(
            {
                "totals": pa.array(np.zeros(rows, bool)),
                "doc_id": shard.column("doc_id"),
                "held_out": shard.column("held_out"),
                "n_tokens": n_tokens,
                "n_known": n_known,
                "log_counts": log_counts,
                "score": total,
            }
        )

    def run(group: pa.Table) -> pa.Table:
        if group.column("totals")[0].as_py():
            row = group.to_pylist()[0]
            values = [[True], [None], [None], [row["tokens"]], [row["kinds"]], [0.0], [0.0]]
            kinds = [pa.bool_(), pa.int64(), pa.bool_(), pa.int64(), pa.int64(), pa.float64(), pa.float64()]
            names = ["totals", "doc_id", "held_out", "n_tokens", "n_known", "log_counts", "score"]
            return pa.table([pa.array(v, k) for v, k in zip(values, kinds, strict=True)], names=names)
        texts = [row for row, text in zip(group.column("payload"), group.column("text").to_pylist(), strict=True) if text]
        sent = [_sent(row.as_py()) for row, text in zip(group.column("payload"), group.column("text").to_pylist(), strict=True) if not text]
        return score(from_ipc([row.as_py() for row in texts]), sent)

    nothing = {"totals": F.lit(False), "kinds": F.lit(0).cast("bigint"), "tokens": F.lit(0).cast("bigint")}
    both = shards.withColumns(nothing).withColumn("text", F.lit(True)).unionByName(answers.withColumn("text", F.lit(False)))
    return both.groupBy("shard").applyInArrow(run, _SCORED)


def ppm_scores(docs: DataFrame) -> DataFrame:
    """``doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score`` for every document.

    ``score`` is the model's log10 probability of the text's UTF-8 bytes and its end. Documents learn, unless
    the checksum of their ``doc_id`` as text is 2 modulo 7 (a missing id counts as an empty text, and learns).
    ``base_score`` is that of single words (white space between, A-Z in lower case) and the text's end, with
    one added to every count. A null text is empty: it has its end alone. Every row gives a row; repeated rows
    count and learn each time. An empty table gives an empty result, and other columns are not read. Without
    any training document, all bytes are equally likely.
    """
    held_out = F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))) % HELD_OUT_OF == HELD_OUT
    given = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text", held_out.alias("held_out"))
    parts = part_count(text_bytes(docs))
    shards = text_shards(given)
    answers = _answer(_deal(shards, parts), _shared_counts(shards))
    rows = written(_scored(shards, answers), "scores")
    totals = rows.filter("totals").agg(
        F.coalesce(F.sum("n_tokens"), F.lit(0)).alias("tokens"), F.coalesce(F.sum("n_known"), F.lit(0)).alias("kinds")
    )
    tokens, kinds = totals.first()
    each = F.log10(F.lit(float(tokens + kinds + 1)))
    return rows.filter(~F.col("totals")).select(
        "doc_id",
        "held_out",
        "n_tokens",
        "n_known",
        F.lit(tokens).cast("bigint").alias("train_tokens"),
        (F.col("log_counts") - F.col("n_tokens") * each).alias("base_score"),
        "score",
    )
