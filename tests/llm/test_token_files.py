"""Token files in rANS blocks."""

from __future__ import annotations

import random
import struct
import zlib

import numpy as np
import pyarrow as pa
import pytest

from archipelago.llm import pretokens, rans, token_files
from archipelago.llm.pretokens import PieceEncoder

public = pytest.importorskip("public_tokenizers")
tokenizers = pytest.importorskip("tokenizers")


@pytest.fixture(scope="module")
def vocabulary():
    with open(public.path("byte_bpe_50k.json")) as file:
        return file.read()


@pytest.fixture(scope="module")
def plain(vocabulary):
    tokenizer = tokenizers.Tokenizer.from_str(vocabulary)
    tokenizer.encode_special_tokens = True
    return lambda text: [*tokenizer.encode(text or "", add_special_tokens=False).ids, 2]


def read(spark, docs, vocabulary, path):
    token_files.write_tokens(docs, vocabulary, path)
    return token_files.read_tokens(spark, path)


def test_round_trip(spark, docs, rows, vocabulary, plain, tmp_path, monkeypatch):
    monkeypatch.setattr(token_files, "BLOCK", 3000)
    found = read(spark, docs, vocabulary, str(tmp_path / "file")).orderBy("start").collect()
    start = 0
    in_order = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] is not None, r[1] or ""))
    assert len(found) == len(in_order)
    for row, (doc_id, text, *_) in zip(found, in_order, strict=True):
        ids = plain(text)
        raw = struct.pack(f"<{len(ids)}I", *ids)
        assert tuple(row) == (doc_id, start, len(ids), zlib.crc32(raw), raw)
        start += len(ids)


def test_empty_table(spark, no_docs, vocabulary, tmp_path):
    assert read(spark, no_docs, vocabulary, str(tmp_path / "file")).collect() == []


def test_driver_gives_memory_back(no_docs, vocabulary, tmp_path, monkeypatch):
    freed = []
    monkeypatch.setattr(token_files, "release", lambda: freed.append(1))
    token_files.write_tokens(no_docs, vocabulary, str(tmp_path / "file"))
    assert freed == [1]


def test_pieces_are_those_of_the_tokenizer(vocabulary, plain):
    import random

    draw = random.Random(1)
    letters = [*"aabcstrevlmd'''  \n\t\r1234.,!?-_éñ漢字١Ⅷ 　​🙂́ǅ", "'s", "'re", "'ll", "don't", "<|endoftext|>"]
    texts = ["".join(draw.choices(letters, k=draw.randint(0, 30))) for _ in range(3000)] + [None, "", " ", "\n\n x"]
    ids, counts = PieceEncoder(vocabulary, 2).encode(pa.array(texts, pa.string()))
    at = 0
    for text, count in zip(texts, counts.tolist(), strict=True):
        assert ids[at : at + count].tolist() == plain(text), text
        at += count


@pytest.mark.parametrize("slots", [4, 64, 1 << 10])
def test_texts_with_more_pieces_than_the_memory_holds(vocabulary, plain, monkeypatch, slots):
    """One long text of different numbers between short ones; known pieces are forgotten, never lost."""
    monkeypatch.setattr(pretokens, "_SLOTS", slots)
    draw = random.Random(slots)
    texts = ["a b a", None, " ".join(f"{draw.randrange(10**8):08d}" for _ in range(3000)), "", "a b c", "x y " * 50]
    encoder = PieceEncoder(vocabulary, 2)
    for _ in range(2):
        ids, counts = encoder.encode(pa.array(texts, pa.string()))
        expected = [plain(text) for text in texts]
        assert counts.tolist() == [len(own) for own in expected]
        assert ids.tolist() == [i for own in expected for i in own]


def test_added_tokens_are_those_of_the_tokenizer(spark, vocabulary, tmp_path):
    import random

    draw = random.Random(2)
    parts = ["<|endoftext|>", "<|endoftext|>", "<|endof", "text|>", " ", "  ", "\n", "a", "b's", "'ll", "'", "é", "12", "!", "<", "|>"]
    texts = ["".join(draw.choices(parts, k=draw.randint(0, 12))) for _ in range(2000)] + ["a <|endoftext|> b", "<|endof", "text|>"]
    library = tokenizers.Tokenizer.from_str(vocabulary)
    expected = [[*library.encode(text, add_special_tokens=False).ids, 2] for text in texts]
    assert expected[2000] == [64, 220, 50256, 275, 2]
    ids, counts = PieceEncoder(vocabulary, 2, added=True).encode(pa.array(texts, pa.string()))
    at = 0
    for text, count, wanted in zip(texts, counts.tolist(), expected, strict=True):
        assert ids[at : at + count].tolist() == wanted, text
        at += count
    docs = spark.createDataFrame(list(enumerate(texts[-50:])), "doc_id bigint, text string")
    found = read(spark, docs, vocabulary, str(tmp_path / "file")).orderBy("start").collect()
    assert [list(struct.unpack(f"<{r['n_tokens']}I", r["ids"])) for r in found] == expected[-50:]


def test_segments_decode_by_themselves():
    draw = np.random.default_rng(0)
    ids = draw.zipf(1.3, 20_000) % 1000
    table = rans.Frequencies.from_counts(np.bincount(ids, minlength=1200))
    assert int(table.share.sum()) == 1 << rans.SCALE
    block = rans.encode(ids, table, lanes=16, interval=100)
    decoder = rans.Decoder(table)
    assert decoder.decode(block).tolist() == ids.tolist()
    assert decoder.segments(block) == 13
    for k in (12, 0, 5):
        assert decoder.decode(block, k, k + 1).tolist() == ids[k * 1600 : (k + 1) * 1600].tolist()
    assert len(block) < 1.15 * -np.log2(table.share[ids] / (1 << rans.SCALE)).sum() / 8 + 13 * 140 + 100


@pytest.mark.parametrize("ids", [[], [5], [5] * 40_000])
def test_odd_blocks(ids):
    ids = np.array(ids, np.int64)
    table = rans.Frequencies.from_counts(np.bincount(ids, minlength=8))
    assert rans.Decoder(table).decode(rans.encode(ids, table)).tolist() == ids.tolist()


def test_damage_is_noticed():
    ids = np.arange(500) % 7
    table = rans.Frequencies.from_counts(np.bincount(ids))
    block = bytearray(rans.encode(ids, table, lanes=4, interval=8))
    block[-20] ^= 1
    with pytest.raises(ValueError, match="damaged"):
        rans.Decoder(table).decode(bytes(block))
    other = rans.Frequencies.from_counts(np.arange(1, 8))
    with pytest.raises(ValueError, match="another"):
        rans.Decoder(other).decode(rans.encode(ids, table))


class Counted:
    """A tokenizer that counts the texts it is given."""

    def __init__(self, tokenizer):
        self._tokenizer = tokenizer
        self.texts = 0

    def __getattr__(self, name):
        return getattr(self._tokenizer, name)

    def encode_batch_fast(self, texts, **options):
        self.texts += len(texts)
        return self._tokenizer.encode_batch_fast(texts, **options)


def test_words_are_encoded_together(vocabulary, plain):
    draw = random.Random(2)
    words = {"".join(draw.choices("etaoinshré漢", k=draw.randint(2, 12))) for _ in range(3000)}
    texts = [" ".join(["", *sorted(words)[i::3]]) for i in range(3)]
    encoder = PieceEncoder(vocabulary, 2)
    encoder._tokenizer = Counted(encoder._tokenizer)
    ids, counts = encoder.encode(pa.array(texts, pa.string()))
    expected = [plain(text) for text in texts]
    assert counts.tolist() == [len(one) for one in expected]
    assert ids.tolist() == [x for one in expected for x in one]
    assert encoder._tokenizer.texts < len(words) / 100


@pytest.mark.parametrize("added", ["b ca", " ab", "ca"])
def test_added_tokens_between_words(vocabulary, added):
    tokenizer = tokenizers.Tokenizer.from_str(vocabulary)
    tokenizer.add_tokens([added])
    texts = [" xb yy xb", " ca cab", " xab abc xb zca abab ca ab", " xb", " cay ab"]
    ids, _ = PieceEncoder(tokenizer.to_str(), 2, added=True).encode(pa.array(texts, pa.string()))
    expected = [[*tokenizer.encode(text, add_special_tokens=False).ids, 2] for text in texts]
    assert ids.tolist() == [x for one in expected for x in one]
