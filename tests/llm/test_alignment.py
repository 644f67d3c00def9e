"""Token alignment against a plain model of the contract."""

from __future__ import annotations

import random
from collections import Counter, defaultdict

import pyarrow as pa
import pytest

from archipelago.llm import alignment
from tests.llm.conftest import same

public_tokenizers = pytest.importorskip("public_tokenizers")


@pytest.fixture(scope="module")
def files():
    with open(public_tokenizers.path("byte_bpe_50k.json")) as first, open(public_tokenizers.path("piece_bpe_32k.model"), "rb") as second:
        return first.read(), second.read()


@pytest.fixture(scope="module")
def tokenizers(files):
    return alignment.Tokenizers.load(*files)


class Brute:
    """Whole texts, one at a time, token by token."""

    def __init__(self, files):
        import sentencepiece
        from tokenizers import Tokenizer

        self.a = Tokenizer.from_str(files[0])
        self.a.encode_special_tokens = True
        self.b = sentencepiece.SentencePieceProcessor(model_proto=files[1])
        letters = alignment._byte_letters()
        self.a_bytes = {i: bytes(letters[c] for c in name) for name, i in self.a.get_vocab(with_added_tokens=False).items() if "<|" not in name}

    def b_bytes(self, i):
        piece = self.b.id_to_piece(i)
        return bytes([int(piece[3:5], 16)]) if self.b.is_byte(i) else piece.replace("▁", " ").encode()

    def tokens(self, text):
        if not text:
            return [], []
        sides = []
        for ids, of in ((self.a.encode(" " + text, add_special_tokens=False).ids, self.a_bytes.__getitem__), (self.b.encode(text), self.b_bytes)):
            spans, at = [], 0
            for i in ids:
                spans.append((i, at, at + len(of(i))))
                at = spans[-1][2]
            if b"".join(of(i) for i in ids) != (" " + text).encode():
                return [], []
            sides.append(spans)
        return sides

    def rows(self, texts):
        """``n_a, n_b, n_groups, n_links, n_best, count_sum, groups`` of each text."""
        linked = []
        for text in texts:
            a, b = self.tokens(text)
            links, i, j = [], 0, 0
            while i < len(a) and j < len(b):
                links.append((a[i][0], b[j][0]))
                ends = a[i][2], b[j][2]
                i, j = i + (ends[0] <= ends[1]), j + (ends[1] <= ends[0])
            both = sorted({end for _, _, end in a} & {end for _, _, end in b})
            group_at = {}
            for side in range(2):
                low, ends = 0, iter(both)
                for i, x, _ in (a, b)[side]:
                    low = next(ends) if x == 0 or x == low else low
                    group_at.setdefault(low, ([], []))[side].append(str(i))
            groups = ["|".join(map(",".join, group_at[end])) for end in both]
            linked.append((a, b, links, ";".join(groups), len(both)))
        counts = Counter(link for _, _, links, _, _ in linked for link in links)
        best = defaultdict(int)
        for (_, b), n in counts.items():
            best[b] = max(best[b], n)
        return [
            (len(a), len(b), n, len(links), sum(counts[x] == best[x[1]] for x in links), sum(counts[x] for x in links), groups)
            for a, b, links, groups, n in linked
        ]


ODD = [None, "", " ", "   ", "a", " a", "a ", "a  b   c", "a\nb\t c\r\n d", "\n", "\0", "a▁b", "▁", "x ▁ y z", "  　x   y",
       "<|endoftext|> a <s> </s> <unk> <0x41> ⁇", "it's we'll 'S I'M", "café café ﬁ ẛ̣", "日本語 の 。", "\U0001f469‍\U0001f680 ok",
       "tab\t\t x  \n  y", "1234567 12 3", "﻿ bom", "x" * 300, "! ?? ...", "\u0085   ᠎ a", "\x1c \x1d x \x7f", "́ ́a"]


def test_odd_texts(spark, files):
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(ODD)], "doc_id bigint, text string")
    found = alignment.aligned(docs, *files).collect()
    same(found, [(i, *row) for i, row in enumerate(Brute(files).rows(ODD))])
    lost = {ODD[r.doc_id] for r in found if not r.n_a}
    assert lost == {None, "", "a▁b", "▁", "x ▁ y z"}


def test_random_texts(tokenizers, files):
    draw = random.Random(3)
    letters = "ab eé日の \n\t'’.,0129Zß 　 ́🙂​  "
    texts = ["".join(draw.choices(letters, k=draw.randint(1, 60))) for _ in range(1500)]
    encoded = alignment.encode_texts(pa.array([" " + t for t in texts], pa.large_string()), tokenizers)
    piece = alignment.align(encoded, tokenizers)
    expected = Brute(files).rows(texts)
    assert piece.sizes.tolist() == [row[3] for row in expected]
    assert alignment.group_texts(piece, tokenizers).to_pylist() == [row[6] for row in expected]
    assert piece.counts.sum() == len(piece.links)
    part = alignment.align(encoded, tokenizers, 700, 720)
    assert part.sizes.tolist() == [row[3] for row in expected[700:720]]
    assert alignment.group_texts(part, tokenizers).to_pylist() == [row[6] for row in expected[700:720]]


def test_whole_corpus(spark, docs, rows, files, monkeypatch):
    """Copies, nulls, repeated rows and long texts; extra columns with clashing names; several pieces per task."""
    monkeypatch.setattr(alignment, "PIECE", 2000)
    monkeypatch.setattr(alignment, "BATCH", 5000)
    found = alignment.aligned(docs, *files)
    expected = Brute(files).rows([r[1] for r in rows])
    same(found.collect(), [(r[0], *e) for r, e in zip(rows, expected, strict=True)])


def test_pair_counts_mark_ties(spark):
    low = 1 << alignment._LOW_BITS
    rows = [(5 * low + 1, 2), (6 * low + 1, 1), (6 * low + 1, 1), (7 * low + 1, 1), (7 * low + 2, 1)]
    found = alignment.pair_counts(spark.createDataFrame(rows, "pair bigint, count bigint")).collect()
    same(found, [(5 * low + 1, 2, True), (6 * low + 1, 2, True), (7 * low + 1, 1, False), (7 * low + 2, 1, True)])


def test_words_are_the_text():
    texts = ["", " a", "  a b  c ", " \n x\t y", " é 日 "]
    lists = alignment.word_lists(pa.array(texts, pa.large_string()))
    assert ["".join(words) for words in lists.to_pylist()] == texts
    assert lists.to_pylist()[2] == ["  a", " b  c "]


def test_empty_table(spark, no_docs, files):
    assert alignment.aligned(no_docs, *files).count() == 0


def test_only_texts_without_tokens(spark, files):
    docs = spark.createDataFrame([(1, None), (None, ""), (3, "▁")], "doc_id bigint, text string")
    same(alignment.aligned(docs, *files).collect(), [(i, 0, 0, 0, 0, 0, 0, "") for i in (1, None, 3)])
