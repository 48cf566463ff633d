import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from pagegrain.llm import packing
from pagegrain.llm.queries import op2_packing

PATH = public_tokenizers.path("byte_bpe_50k.json")


def plain_ids(tokenizer, text):
    return np.array(tokenizer.encode(text or "", add_special_tokens=False).ids + [0], "<u4")


def check(rows, texts, window=1024):
    """Exact round trip: every id in one piece, sequences gapless and within the window; returns the padding."""
    tokenizer = Tokenizer.from_file(PATH)
    own, sequences = defaultdict(list), defaultdict(list)
    for r in rows:
        own[r["doc_id"]].append(r)
        sequences[r["sequence_id"]].append(r)
    assert set(own) == set(texts)
    for doc, text in texts.items():
        ids, at = plain_ids(tokenizer, text), 0
        for r in sorted(own[doc], key=lambda r: r["start"]):
            assert (r["start"], r["doc_tokens"]) == (at, len(ids))
            assert r["ids_crc32"] == zlib.crc32(ids[at : at + r["length"]].tobytes())
            at += r["length"]
        assert at == len(ids)
    padding = 0
    for pieces in sequences.values():
        at = 0
        for r in sorted(pieces, key=lambda r: r["offset"]):
            assert r["offset"] == at and r["length"] > 0
            at += r["length"]
        assert at <= window
        padding += 0 if at & (at - 1) == 0 else window - at
    return padding


def test_query_round_trip_and_padding(spark, sf):
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    assert check(op2_packing(spark, sf).collect(), texts) < 1024


@pytest.mark.parametrize("part", [3, 100_000])
def test_hot_length_long_and_empty_texts(docs, monkeypatch, part):
    monkeypatch.setattr(packing, "PART", part)
    texts = [None, "", " ", "a  b", "x <|endoftext|> y", "word " * 5000] + ["the same text"] * 300 + ["one two three four"] * 50
    rows = docs(texts, extra=["length", "sequence_id", "ids"])
    placed, pieces = packing.pack(rows, PATH, 64)
    assert check(placed.collect(), dict(enumerate(texts)), 64) < 64
    full = packing.with_ids(placed, pieces, 64)
    assert all(zlib.crc32(np.array(r["ids"], "<u4").tobytes()) == r["ids_crc32"] for r in full.collect())


def test_empty_table_and_repeated_rows(docs):
    assert packing.pack(docs([]), PATH)[0].count() == 0
    rows = packing.pack(docs(["same"] * 3, ids=[5, 5, None]), PATH)[0].collect()
    assert len(rows) == 3 and len({(r["sequence_id"], r["offset"]) for r in rows}) == 3


def test_words_equal_the_tokenizer_on_mixed_pieces():
    tokenizer, rng = Tokenizer.from_file(PATH), np.random.default_rng(1)
    words = packing.Words(tokenizer)
    pieces = ["a", "é", " ", "  ", "\n", "\n\n", "'s", "'", "23", "½", ".", "...", "-", "_", "Bar", "ß", "日本", "́", "\t", "\xa0", "　", "🙂", "\x1c", "\x85", "<|", "|>", "don't", "\r\n", "<|endoftext|>"]
    for _ in range(3000):
        text = "".join(rng.choice(pieces, rng.integers(0, 12)))
        assert words.ids(text).tolist() == plain_ids(tokenizer, text).tolist(), repr(text)


def test_words_of_mixed_scripts_equal_the_tokenizer():
    tokenizer, rng = Tokenizer.from_file(PATH), np.random.default_rng(3)
    words = packing.Words(tokenizer)
    assert words.ids("take 5 μg daily").tolist() == [20657, 642, 44415, 4445, 0]
    pieces = ["μ", "g", " μg", " μ", "µ", "Ω", "ж", "Bar", "é", "nº", "ª", "日", "ʼ", "א", "m²", "½", "5", " ", " k", "-", ".", "́", "_", "\n"]
    for _ in range(5000):
        text = "".join(rng.choice(pieces, rng.integers(1, 9)))
        assert words.ids(text).tolist() == plain_ids(tokenizer, text).tolist(), repr(text)


def test_runs_cut_no_word_of_mixed_scripts():
    words = packing.Words(Tokenizer.from_file(PATH))
    assert words.runs("ab μg cμd 5μgж x-y") == ["ab", " μg", " cμd", " 5μgж", " x", "-", "y"]


@pytest.mark.parametrize("scale", [1, 40])
def test_solver_uses_what_there_is(scale):
    rng = np.random.default_rng(2)
    histogram = np.zeros(129, np.int64)
    histogram[1:128] = rng.poisson(scale, 127)
    histogram[128], histogram[100] = 50, 5 * scale
    combos, uses = packing.solve(histogram, 128)
    used = np.zeros(129, np.int64)
    for parts, n in zip(combos, uses):
        assert parts.sum() == 128 and n > 0
        np.add.at(used, parts[parts > 0], n)
    assert (used <= histogram).all()
    weight = np.arange(129)
    assert (used * weight).sum() > 0.6 * (histogram * weight).sum()
