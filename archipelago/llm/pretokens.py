"""Byte-level BPE over whole Arrow columns: equal pieces of text are encoded once.

The tokenizer cuts a text into pieces (words with the blank before them, numbers, punctuation, white
space) and encodes each piece by itself. Here the cuts are found for a whole column at once, and
only pieces not seen before are given to the tokenizer.
"""

from __future__ import annotations

import re
from collections.abc import Callable

import numpy as np
import pyarrow as pa

from archipelago.llm.arrays import mix, powers, utf8

_SPACE, _LETTER, _NUMBER, _OTHER = 0, 1, 2, 3
_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 1 << 64)
# Slots of the table of known pieces; it starts anew when half of them are taken, and what does not fit into an empty
# one is encoded half a table at a time.
_SLOTS = 1 << 21
# Words that the tokenizer gets as one text.
_TOGETHER = 500


class PieceEncoder:
    """Token ids of texts, with a memory of the pieces seen so far."""

    def __init__(self, tokenizer_json: str, end: int, added: bool = False) -> None:
        """With ``added``, strings of added tokens in a text are those tokens, else ordinary text."""
        from tokenizers import Tokenizer

        self._tokenizer = Tokenizer.from_str(tokenizer_json)
        self._tokenizer.encode_special_tokens = not added
        # Tokens that aren't special are cut out in either case.
        tokens = [t for t in self._tokenizer.get_added_tokens_decoder().values() if added or not t.special]
        if any(t.lstrip or t.rstrip or t.single_word for t in tokens):
            raise ValueError("added tokens that depend on what is beside them are not supported")
        # The longest of those that begin at a place.
        names = sorted((t.content for t in tokens), key=len, reverse=True)
        self._added = re.compile("|".join(map(re.escape, names))) if names else None
        self._end = end
        # What a tokenizer may do to a whole text depends on what is in it.
        about = (self._tokenizer.normalizer, self._tokenizer.truncation, self._tokenizer.padding)
        self._joinable = all(part is None for part in about)
        # The bytes of each id; a byte-level entry has a character for each.
        vocabulary = self._tokenizer.get_vocab(with_added_tokens=False)
        self._bytes = np.zeros(self._tokenizer.get_vocab_size() + max(vocabulary.values(), default=0) + 1, np.int64)
        self._bytes[list(vocabulary.values())] = list(map(len, vocabulary))
        self._kinds = np.full(0x110000, 255, np.uint8)
        self._values = mix(np.arange(1, 0x110001, dtype=np.uint64))
        self._forget()

    def _forget(self) -> None:
        self._keys = np.zeros(_SLOTS, np.uint64)
        self._places = np.zeros(_SLOTS, np.int32)
        self._count = 0
        self._starts = np.zeros(1 << 16, np.int64)
        self._sizes = np.zeros(1 << 16, np.int32)
        self._ids = np.zeros(1 << 18, np.uint32)
        self._used = 0

    def _kind_of(self, points: np.ndarray) -> np.ndarray:
        """The class of each code point, as the tokenizer sees it."""
        kinds = self._kinds[points]
        if (kinds == 255).any():
            cut = self._tokenizer.pre_tokenizer.pre_tokenize_str
            for point in np.unique(points[kinds == 255]).tolist():
                kind = _SPACE
                for other, beside in ((_LETTER, "a"), (_NUMBER, "1"), (_OTHER, "!")):
                    if len(cut(beside + chr(point))) == 1:
                        kind = other
                self._kinds[point] = kind
            kinds = self._kinds[points]
        return kinds

    def _found(self, text: str, limits: np.ndarray) -> list[tuple[int, int]]:
        """Where added tokens are, within rows."""
        if self._added is None or not self._added.search(text):
            return []
        rows = zip(limits[:-1].tolist(), limits[1:].tolist(), strict=True)
        return [m.span() for low, high in rows for m in self._added.finditer(text, low, high)]

    def _cuts(self, points: np.ndarray, limits: np.ndarray, found: list[tuple[int, int]]) -> np.ndarray:
        """Where pieces begin; each of ``found`` is one, and what is beside it is cut like a text of its own."""
        kinds = self._kind_of(points)
        n = len(points)
        head = np.zeros(n + 1, bool)
        head[limits] = True
        for span in found:
            head[list(span)] = True
        change = head[:n].copy()
        change[1:] |= kinds[1:] != kinds[:-1]
        space = kinds == _SPACE
        blank = points == 0x20
        # A blank goes with what follows it in the same text; of other white space the last character is
        # a piece of its own if something follows.
        begin = change.copy()
        begin[1:] &= ~(change[1:] & ~space[1:] & blank[:-1] & ~head[1:n])
        follows = np.zeros(n, bool)
        follows[:-1] = space[:-1] & ~space[1:] & ~head[1:n]
        begin |= follows
        # Contractions: an apostrophe at the start of a piece, with s, t, m, d, re, ve or ll after it.
        at = np.flatnonzero((points == 0x27) & begin)
        if len(at):
            at = at[~(blank[at] | space[at])]
            padded = np.concatenate((points, np.zeros(3, points.dtype)))
            inside = np.concatenate((head[:n], np.ones(4, bool)))
            first, second = padded[at + 1], padded[at + 2]
            one = ~inside[at + 1] & np.isin(first, [ord(c) for c in "stmd"])
            two = np.zeros(len(at), bool)
            for pair in ("re", "ve", "ll"):
                two |= (first == ord(pair[0])) & (second == ord(pair[1]))
            two &= ~inside[at + 1] & ~inside[at + 2]
            for chosen, size in ((one, 2), (two & ~one, 3)):
                where = at[chosen]
                begin[where + 1] = False
                after = where + size
                begin[after[after < n]] = True
        for first, last in found:
            begin[first + 1 : last] = False
        return np.flatnonzero(begin)

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        """Where a key is looked for first."""
        return (keys >> np.uint64(65 - _SLOTS.bit_length())).astype(np.int64)

    def _find(self, keys: np.ndarray) -> np.ndarray:
        """The place of each key in the memory, -1 for unknown ones."""
        out = np.full(len(keys), -1, np.int32)
        slot = self._slot(keys)
        todo = np.arange(len(keys))
        while len(todo):
            held = self._keys[slot]
            same = held == keys[todo]
            out[todo[same]] = self._places[slot[same]]
            on = ~same & (held != 0)
            todo, slot = todo[on], (slot[on] + 1) & (_SLOTS - 1)
        return out

    def _remember(self, keys: np.ndarray, pieces: list[str]) -> None:
        words = self._words(pieces)
        for chosen, encoded in ((words, self._encoded_together), (~words, self._encoded_apart)):
            at = np.flatnonzero(chosen)
            if len(at):
                self._put(keys[at], *encoded([pieces[i] for i in at.tolist()]))

    def _words(self, pieces: list[str]) -> np.ndarray:
        """Whether a piece is a blank and letters: one after the other, such pieces are cut as they are alone."""
        points = np.frombuffer("".join(pieces).encode("utf-32-le"), np.uint32).astype(np.int64)
        sizes = np.fromiter(map(len, pieces), np.int64, len(pieces))
        first = np.cumsum(sizes) - sizes
        fits = self._kind_of(points) == _LETTER
        fits[first] = points[first] == 0x20
        return np.logical_and.reduceat(fits, first) & (sizes > 1) & self._joinable

    def _encoded_apart(self, pieces: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of some pieces, one after the other, and how many each has."""
        ids = [one.ids for one in self._tokenizer.encode_batch_fast(pieces, add_special_tokens=False)]
        sizes = np.fromiter(map(len, ids), np.int32, len(ids))
        return np.fromiter((x for one in ids for x in one), np.uint32, int(sizes.sum())), sizes

    def _encoded_together(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The same for words: many are given to the tokenizer as one text, and told apart by the bytes of their ids."""
        texts = ["".join(words[i : i + _TOGETHER]) for i in range(0, len(words), _TOGETHER)]
        if self._added is not None and any(map(self._added.search, texts)):
            return self._encoded_apart(words)
        encoded = self._tokenizer.encode_batch_fast(texts, add_special_tokens=False)
        ids = np.concatenate([np.array(one.ids, np.uint32) for one in encoded])
        ends = np.cumsum(self._bytes[ids])
        limits = np.cumsum(np.fromiter((len(word.encode()) for word in words), np.int64, len(words)))
        last = np.searchsorted(ends, limits)
        # A tokenizer that has no ids for some bytes leaves them out.
        if not len(ends) or ends[-1] != limits[-1] or (ends[last] != limits).any():
            return self._encoded_apart(words)
        return ids, np.diff(last + 1, prepend=0).astype(np.int32)

    def _put(self, keys: np.ndarray, flat: np.ndarray, sizes: np.ndarray) -> None:
        """Into the memory: pieces by their keys, their ids one after the other, and how many each has."""
        first, self._count = self._count, self._count + len(keys)
        for name in ("_starts", "_sizes"):
            if self._count > len(getattr(self, name)):
                setattr(self, name, np.resize(getattr(self, name), 2 * self._count))
        if self._used + len(flat) > len(self._ids):
            self._ids = np.resize(self._ids, 2 * (self._used + len(flat)))
        self._sizes[first : self._count] = sizes
        self._starts[first : self._count] = self._used + np.concatenate(([0], np.cumsum(sizes)))[:-1]
        self._ids[self._used : self._used + len(flat)] = flat
        self._used += len(flat)
        places = np.arange(first, self._count, dtype=np.int32)
        slot = self._slot(keys)
        while len(keys):
            _, own = np.unique(slot, return_index=True)
            own = own[self._keys[slot[own]] == 0]
            self._keys[slot[own]], self._places[slot[own]] = keys[own], places[own]
            rest = np.ones(len(keys), bool)
            rest[own] = False
            keys, places, slot = keys[rest], places[rest], (slot[rest] + 1) & (_SLOTS - 1)

    def encode(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """All ids of the texts, each text's end included, and how many each text has."""
        data, limits = utf8(column)
        text = data.tobytes().decode()
        points = np.frombuffer(text.encode("utf-32-le"), np.uint32).astype(np.int64)
        # Where rows begin, in code points.
        leads = np.concatenate(([0], np.cumsum((data & 0xC0) != 0x80)))
        limits = leads[limits]
        cuts = self._cuts(points, limits, self._found(text, limits))
        sums = np.zeros(len(points) + 1, np.uint64)
        np.cumsum(self._values[points] * powers(_BASE, len(points)), out=sums[1:])
        ends = np.append(cuts[1:], len(points))
        keys = mix((sums[ends] - sums[cuts]) * powers(_INVERSE, len(points) + 1)[cuts] + (ends - cuts).astype(np.uint64))
        keys |= np.uint64(1)  # never 0
        ids, sizes = self._ids_of(keys, lambda at: [text[cuts[i] : ends[i]] for i in at.tolist()])
        # The end of each text, after its pieces.
        after = np.searchsorted(cuts, limits[1:])
        before = np.concatenate(([0], np.cumsum(sizes, dtype=np.int64)))[after]
        return np.insert(ids, before, np.uint32(self._end)), np.diff(np.concatenate(([0], before + np.arange(1, len(before) + 1))))

    def _ids_of(self, keys: np.ndarray, spelled: Callable[[np.ndarray], list[str]]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all pieces, one after the other, and how many each has; ``spelled`` gives the pieces at some places."""
        places = self._find(keys)
        unknown = np.flatnonzero(places < 0)
        if len(unknown):
            new, first = np.unique(keys[unknown], return_index=True)
            first = unknown[first]
            if 2 * (self._count + len(new)) > _SLOTS:
                self._forget()
                unknown = np.arange(len(keys))
                new, first = np.unique(keys, return_index=True)
                if 2 * (self._count + len(new)) > _SLOTS:
                    return self._ids_in_halves(keys, spelled)
            self._remember(new, spelled(first))
            places[unknown] = self._find(keys[unknown])
        sizes = self._sizes[places]
        total = np.concatenate(([0], np.cumsum(sizes, dtype=np.int64)))
        at = np.repeat(self._starts[places] - total[:-1], sizes) + np.arange(total[-1])
        return self._ids[at], sizes

    def _ids_in_halves(self, keys: np.ndarray, spelled: Callable[[np.ndarray], list[str]]) -> tuple[np.ndarray, np.ndarray]:
        """The same for more different pieces than the table can hold: one half of them after the other."""
        half = len(keys) // 2
        one = self._ids_of(keys[:half], spelled)
        two = self._ids_of(keys[half:], lambda at: spelled(at + half))
        return np.concatenate((one[0], two[0])), np.concatenate((one[1], two[1]))
