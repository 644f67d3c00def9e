"""Token alignment of two tokenizers over the same texts, as Arrow tables inside Spark's tasks.

Both tokenizers cut the bytes of a text, so the ends of their tokens are comparable. Per piece of about a megabyte
of text:

1. Words (a blank and what follows it) are a list per document; distinct words are encoded once, and token lists
   are taken from there, flattened, with parent indices that lead back to word and document.
2. Byte ends are cumulative sums of token sizes, less the bytes of the documents before.
3. An Acero hash join on (document, end), from both sides, has one row for each byte offset where a token of
   either side ends. In order, with the gaps filled from below, each row is one link: the bytes since the row before
   belong to exactly one token of each side. Rows that both sides have end a group.
4. ``Table.group_by`` counts the piece's pairs of ids.

Spark adds up the partial counts of all pieces by pair, marks the largest of each id of the second side, and sends the
sums back to the pieces that hold the pair. A piece sends every pair once, however often it holds it.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from archipelago.llm.arrays import pack, pieces, release, unpack, utf8
from archipelago.llm.pretokens import PieceEncoder
from archipelago.llm.tables import written

# Bytes of text aligned at a time, unless a single text is longer, and those whose distinct words are encoded together.
PIECE = 1 << 20
BATCH = 1 << 21
# A pair of ids is one number: the first side's id, and in the lower bits the second side's.
_LOW_BITS = 32


def _byte_letters() -> dict[str, int]:
    """Which byte each letter of a byte-level vocabulary stands for.

    Bytes that print stand for themselves; the others take the code points from 256 on, in their order.
    """
    prints = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    others = [byte for byte in range(256) if byte not in prints]
    return {chr(byte): byte for byte in prints} | {chr(256 + i): byte for i, byte in enumerate(others)}


@dataclass
class Tokenizers:
    """Both tokenizers, and the bytes of all their tokens."""

    first: PieceEncoder
    second: object
    first_bytes: pa.Array
    second_bytes: pa.Array
    numbers: pa.Array

    @classmethod
    def load(cls, first_json: str, second_model: bytes) -> Tokenizers:
        """A byte-level BPE of the tokenizers library (see :class:`PieceEncoder`), and a sentencepiece model.

        Pieces of the model may have blanks in front only.
        """
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import sentencepiece
        from tokenizers import Tokenizer

        first = Tokenizer.from_str(first_json)
        letters = _byte_letters()
        names = {number: name for name, number in first.get_vocab(with_added_tokens=True).items()}
        entries = [names.get(i, "") for i in range(max(names) + 1)]
        plain = [bytes(letters.get(c, 0x3F) for c in name) for name in entries]
        second = sentencepiece.SentencePieceProcessor(model_proto=second_model)
        held = []
        for i in range(second.get_piece_size()):
            name = second.id_to_piece(i)
            if "▁" in name.lstrip("▁"):
                raise ValueError(f"piece {name!r} goes on after a blank")
            held.append(bytes([int(name[3:5], 16)]) if second.is_byte(i) else name.replace("▁", " ").encode())
        # Ids in decimal with what follows them: , or | on the first side, , or ; on the second.
        numbers = [f"{i}{mark}" for table, marks in ((plain, ",|"), (held, ",;")) for mark in marks for i in range(len(table))]
        tables = [pa.array(table, pa.large_binary()) for table in (plain, held)]
        return cls(PieceEncoder(first_json, 0), second, *tables, pa.array(numbers, pa.large_string()))

    def encode(self, words: pa.Array) -> tuple[pa.LargeListArray, pa.LargeListArray]:
        """The ids of words that begin with a blank; the second tokenizer puts that blank there by itself."""
        ids, sizes = self.first.encode(words)
        limits = np.concatenate(([0], np.cumsum(sizes)))
        # Without the end that the encoder puts after each word.
        inside = np.ones(len(ids), bool)
        inside[limits[1:] - 1] = False
        first = pa.LargeListArray.from_arrays(pa.array(limits - np.arange(len(limits))), pa.array(ids[inside].astype(np.int32)))
        return first, _lists(self.second.encode([word[1:] for word in words.to_pylist()], num_threads=1))


def _lists(ids: list[list[int]]) -> pa.ListArray:
    limits = np.concatenate(([0], np.cumsum(np.fromiter(map(len, ids), np.int64, len(ids)))))
    flat = np.fromiter(chain.from_iterable(ids), np.int32, int(limits[-1]))
    return pa.LargeListArray.from_arrays(pa.array(limits), pa.array(flat))


def _tokenizers(first_json: str, second_model: bytes) -> Tokenizers:
    """Those of this Python process, which serve all tasks that run in it."""
    key = (zlib.crc32(first_json.encode()), zlib.crc32(second_model))
    held = getattr(pc, "_aligned_tokenizers", None)
    if held is None or held[0] != key:
        held = (key, Tokenizers.load(first_json, second_model))
        pc._aligned_tokenizers = held
    return held[1]


def _safe_after_blank() -> np.ndarray:
    """Bytes after a blank of which it is sure that they begin no white space."""
    safe = np.zeros(256, bool)
    for first, last in ((0x21, 0x7E), (0xC3, 0xE0), (0xE4, 0xF4)):
        safe[first : last + 1] = True
    return safe


def word_lists(texts: pa.Array) -> pa.LargeListArray:
    """The words of each text, a list per row; joined, they are the text.

    A word begins where a text begins, and at a single blank with something visible after it: there both tokenizers
    begin a new token whatever stands around it.
    """
    data, limits = utf8(texts)
    heads = np.zeros(len(data) + 1, bool)
    blank = data == 0x20
    heads[:-1] = blank
    heads[1:-1] &= ~blank[:-1]
    heads[:-2] &= _safe_after_blank()[data[1:]]
    heads[-2:] = False
    heads[limits] = True
    starts = np.flatnonzero(heads)
    words = pa.Array.from_buffers(
        pa.large_string(), len(starts) - 1, [None, pa.py_buffer(starts), pa.py_buffer(np.ascontiguousarray(data))]
    )
    return pa.LargeListArray.from_arrays(pa.array(np.searchsorted(starts, limits)), words)


def _spelled(ids: pa.LargeListArray, table: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The joined bytes of each list of tokens, and where each begins and ends."""
    data, limits = utf8(table.take(ids.flatten()))
    return data, limits[ids.offsets.to_numpy()]


def _misspelled(words: pa.Array, ids: pa.LargeListArray, table: pa.Array) -> np.ndarray:
    """Whether the joined tokens of each word differ from the word."""
    (data, limits), (own, own_limits) = utf8(words), _spelled(ids, table)
    if np.array_equal(limits, own_limits) and np.array_equal(data, own):
        return np.zeros(len(words), bool)
    both = zip(limits[:-1], limits[1:], own_limits[:-1], own_limits[1:], strict=True)
    return np.array([not np.array_equal(data[a:b], own[c:d]) for a, b, c, d in both], bool)


@dataclass
class Piece:
    """The links of some documents, in order.

    ``pairs`` are the distinct pairs of ids, the most frequent first, ``counts`` how many links have them. ``links``
    are places in ``pairs``; ``ends`` has 1 where a token of the first side ends, 2 for the second, 3 for both.
    ``sizes`` are the links of each document.
    """

    pairs: np.ndarray
    counts: np.ndarray
    links: np.ndarray
    ends: np.ndarray
    sizes: np.ndarray


def _ends(words: pa.Table, ids: pa.LargeListArray, table: pa.Array, before: pa.Array, name: str) -> pa.Table:
    """``doc, end`` and the id of each token; ``words`` has the document and the dictionary place of each word."""
    per_word = ids.take(words["word"].combine_chunks())
    tokens, word = pc.list_flatten(per_word), pc.list_parent_indices(per_word)
    doc = words["doc"].combine_chunks().take(word)
    through = pc.cumulative_sum(pc.binary_length(table).take(tokens))
    return pa.table({"doc": doc, "end": pc.subtract(through, before.take(doc)), name: tokens})


@dataclass
class Encoded:
    """Texts as words, and both sides' ids of each distinct word.

    ``limits`` are the words of each text, ``words`` their places among the distinct ones. Texts that are ``lost`` have an odd
    word and are spelled otherwise by their tokens.
    """

    texts: pa.Array
    limits: np.ndarray
    words: pa.Array
    ids: tuple[pa.LargeListArray, pa.LargeListArray]
    lost: np.ndarray


def encode_texts(texts: pa.Array, tokenizers: Tokenizers) -> Encoded:
    """Texts (with a blank in front, or empty, which have no tokens) by both tokenizers."""
    lists = word_lists(texts)
    coded = lists.values.dictionary_encode()
    ids = tokenizers.encode(coded.dictionary)
    tables = tokenizers.first_bytes, tokenizers.second_bytes
    odd = _misspelled(coded.dictionary, ids[0], tables[0]) | _misspelled(coded.dictionary, ids[1], tables[1])
    limits, lost = lists.offsets.to_numpy(), np.zeros(len(texts), bool)
    if odd.any():
        # A text with an odd word: are its joined tokens another text?
        at = np.flatnonzero(odd[coded.indices.to_numpy()])
        for row in np.unique(np.searchsorted(limits, at, "right") - 1).tolist():
            own, text = coded.indices[limits[row] : limits[row + 1]], texts[row].as_py().encode()
            lost[row] = any(_spelled(side.take(own), t)[0].tobytes() != text for side, t in zip(ids, tables, strict=True))
    return Encoded(texts, limits, coded.indices, ids, lost)


def align(encoded: Encoded, tokenizers: Tokenizers, first: int = 0, end: int | None = None) -> Piece:
    """The links of the texts from ``first`` to before ``end``."""
    texts, lost = encoded.texts[first:end], encoded.lost[first:end]
    limits = encoded.limits[first : first + len(texts) + 1]
    lists = pa.LargeListArray.from_arrays(pa.array(limits - limits[0]), encoded.words[limits[0] : limits[-1]])
    words = pa.table({"doc": pc.list_parent_indices(lists), "word": pc.list_flatten(lists)})
    if lost.any():
        words = words.filter(pa.array(~lost[words["doc"].to_numpy()]))
    bytes_of = np.where(lost, 0, pc.binary_length(texts).to_numpy(zero_copy_only=False).astype(np.int64))
    before = pa.array(np.cumsum(bytes_of) - bytes_of)
    ids, tables = encoded.ids, (tokenizers.first_bytes, tokenizers.second_bytes)

    first = _ends(words, ids[0], tables[0], before, "first")
    second = _ends(words, ids[1], tables[1], before, "second")
    both = first.join(second, keys=["doc", "end"], join_type="full outer", use_threads=False).combine_chunks()
    place = pc.add(before.take(both["doc"].combine_chunks()), both["end"].combine_chunks())
    both = both.take(pc.sort_indices(place)).combine_chunks()
    ends = pc.add(pc.cast(pc.is_valid(both["first"]), pa.uint8()), pc.cast(pc.shift_left(pc.cast(pc.is_valid(both["second"]), pa.uint8()), 1), pa.uint8()))
    # The token that ends next is the one that an offset without an end of its own lies in.
    filled = [pc.cast(pc.fill_null_backward(both[name].combine_chunks()), pa.int64()) for name in ("first", "second")]
    pair = pc.bit_wise_or(pc.shift_left(filled[0], _LOW_BITS), filled[1])
    counted = pa.table({"pair": pair}).group_by("pair", use_threads=False).aggregate([([], "count_all")])
    counted = counted.sort_by([("count_all", "descending"), ("pair", "ascending")]).combine_chunks()
    links = pc.index_in(pair, value_set=counted["pair"].combine_chunks())
    sizes = np.bincount(both["doc"].to_numpy(), minlength=len(texts))
    return Piece(
        counted["pair"].to_numpy(), counted["count_all"].to_numpy(), links.to_numpy(), ends.to_numpy(), sizes
    )


def group_texts(piece: Piece, tokenizers: Tokenizers) -> pa.Array:
    """Per document ``a1,a2|b1;a3|b2,b3``: the ids of both sides up to each offset where both end."""
    pair = piece.pairs[piece.links]
    one, two = np.flatnonzero(piece.ends & 1), np.flatnonzero(piece.ends & 2)
    last = piece.ends == 3
    group = np.cumsum(last) - last
    groups = int(group[-1]) + 1 if len(group) else 0
    of_one, of_two = group[one], group[two]
    ones, twos = np.cumsum(np.bincount(of_one, minlength=groups)), np.cumsum(np.bincount(of_two, minlength=groups))
    sizes = len(tokenizers.first_bytes), len(tokenizers.second_bytes)
    order = np.zeros(len(one) + len(two), np.int64)
    # A group's tokens of the first side, then those of the second.
    order[np.arange(len(one)) + np.concatenate(([0], twos))[of_one]] = (pair[one] >> _LOW_BITS) + sizes[0] * last[one]
    low = pair[two] & ((1 << _LOW_BITS) - 1)
    order[np.arange(len(two)) + ones[of_two]] = 2 * sizes[0] + low + sizes[1] * last[two]
    data, limits = utf8(tokenizers.numbers.take(pa.array(order)))
    tokens = np.concatenate(([0], np.cumsum((piece.ends & 1) + (piece.ends >> 1), dtype=np.int64)))
    at = limits[tokens[np.concatenate(([0], np.cumsum(piece.sizes)))]]
    text = data.tobytes()
    # Without the mark after a document's last token.
    return pa.array([text[a : max(a, b - 1)].decode() for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)], pa.large_string())


_PIECES = "piece bigint, doc_ids array<bigint>, sizes array<bigint>, links binary, pairs array<bigint>, counts array<bigint>"


def _aligned_pieces(docs: DataFrame, first_json: str, second_model: bytes) -> DataFrame:
    """One row for each piece of text (``_PIECES``), numbered as they are written."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        number, tokenizers = TaskContext.get().partitionId() << 32, _tokenizers(first_json, second_model)
        for batch in batches:
            texts = pc.cast(batch.column(1), pa.large_string())
            _, limits = utf8(texts)
            for low, high in pieces(limits, BATCH):
                own = texts.slice(low, high - low)
                spaced = pc.binary_join_element_wise(pa.scalar(" ", pa.large_string()), own, pa.scalar("", pa.large_string()))
                has = pc.fill_null(pc.greater(pc.binary_length(own), 0), False)
                encoded = encode_texts(pc.if_else(has, spaced, pa.scalar("", pa.large_string())), tokenizers)
                release()
                for first, end in pieces(limits[low : high + 1], PIECE):
                    piece = align(encoded, tokenizers, first, end)
                    planes = np.ascontiguousarray(piece.links.astype("<u4").view(np.uint8).reshape(-1, 4).T).ravel()
                    values = [
                        [number],
                        [batch.column(0).slice(low + first, end - first).to_pylist()],
                        [piece.sizes],
                        [pack(planes, piece.ends, level=3)],
                        [piece.pairs],
                        [piece.counts],
                    ]
                    lists = pa.list_(pa.int64())
                    kinds = [pa.int64(), lists, lists, pa.binary(), lists, lists]
                    names = ["piece", "doc_ids", "sizes", "links", "pairs", "counts"]
                    yield pa.RecordBatch.from_arrays([pa.array(v, k) for v, k in zip(values, kinds, strict=True)], names=names)
                    number += 1
                    release()

    given = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text")
    return written(given.mapInArrow(run, _PIECES), "aligned-pieces")


def pair_counts(held: DataFrame) -> DataFrame:
    """``pair, count, best``: the links of each pair in all pieces, and whether no pair with its second id has more.

    A second id has at most as many pairs as the first vocabulary has ids, so a window over it is bounded.
    """
    totals = held.groupBy("pair").agg(F.sum("count").alias("count"))
    second = F.col("pair").bitwiseAND(F.lit((1 << _LOW_BITS) - 1))
    most = F.max("count").over(Window.partitionBy("_second"))
    return totals.withColumn("_second", second).select("pair", "count", (F.col("count") == most).alias("best"))


_ALIGNED = """doc_id bigint, n_a bigint, n_b bigint, n_groups bigint, n_links bigint, n_best bigint, count_sum bigint,
    groups string"""


def aligned(docs: DataFrame, first_json: str, second_model: bytes) -> DataFrame:
    """``doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups``: one row for each row of ``docs``.

    ``first_json`` is a byte-level BPE of the tokenizers library, which encodes the text with a blank in front;
    ``second_model`` is a sentencepiece model, which puts that blank there by itself. Strings of special tokens in a text are
    ordinary text. ``groups`` has the ids of both sides between offsets where both end, as ``a1,a2|b1;a3|b2,b3``.
    A link is a pair of tokens whose bytes overlap; a pair of ids counts as often as links in all documents have it.
    ``n_best`` are the links with no more frequent pair of the same second id, and ``count_sum`` adds up the
    counts over the links.

    Texts that are null or empty, or whose tokens don't spell the text, have no tokens: zeros and an empty ``groups``.
    Repeated rows count each time, a missing ``doc_id`` stays so, and other columns are not read. An empty table gives an
    empty result. Memory is bounded by ``PIECE`` or by the longest text.
    """
    held = _aligned_pieces(docs, first_json, second_model)
    sent = held.select("piece", F.inline(F.arrays_zip(F.col("pairs").alias("pair"), F.col("counts").alias("count"))))
    sums = sent.select("piece", "pair").join(pair_counts(sent.select("pair", "count")), "pair")
    sums = sums.select(F.col("piece").alias("to"), F.col("pair").alias("pair"), "count", "best")

    def finish(key: tuple, rows: pa.Table, answers: pa.Table) -> pa.Table:
        row = rows.to_pylist()[0]
        planes, ends = unpack(row["links"])
        links = np.ascontiguousarray(planes.reshape(4, -1).T).view("<u4").ravel()
        pairs = np.array(row["pairs"], np.int64)
        at = np.argsort(pairs)
        count, best = np.zeros(len(pairs), np.int64), np.zeros(len(pairs), np.int64)
        order = np.argsort(answers["pair"].to_numpy())
        count[at] = answers["count"].to_numpy()[order]
        best[at] = answers["best"].to_numpy(zero_copy_only=False)[order]
        piece = Piece(pairs, count, links, ends, np.array(row["sizes"], np.int64))
        limits = np.concatenate(([0], np.cumsum(piece.sizes)))

        def sums_of(values: np.ndarray) -> np.ndarray:
            return np.diff(np.concatenate(([0], np.cumsum(values, dtype=np.int64)))[limits])

        out = pa.table(
            {
                "doc_id": pa.array(row["doc_ids"], pa.int64()),
                "n_a": sums_of(ends & 1),
                "n_b": sums_of(ends >> 1),
                "n_groups": sums_of(ends == 3),
                "n_links": piece.sizes,
                "n_best": sums_of(best[links]),
                "count_sum": sums_of(count[links]),
                "groups": pc.cast(group_texts(piece, _tokenizers(first_json, second_model)), pa.string()),
            }
        )
        release()
        return out

    own = held.drop("counts").groupBy("piece")
    return own.cogroup(sums.groupBy("to")).applyInArrow(finish, _ALIGNED)
