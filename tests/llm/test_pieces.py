import hashlib

import numpy as np
import public_tokenizers
import pytest
from sentencepiece import SentencePieceProcessor

from pagegrain.llm import pieces
from pagegrain.llm.queries import op11_pieces

PATH = public_tokenizers.path("piece_bpe_32k.model")
PARTS = ["a", "b", " ", "  ", "▁", "\n", "\t", "é", "日", "🙂", "the", "<s>", "</s>", "<unk>", "<0x41>", "ing", " ing", "\x00", "​", "ﬁ", "'", " '", ".", "..", "==", "    ", "0", "́", "\r\n"]


@pytest.fixture(scope="module")
def model():
    return SentencePieceProcessor(model_file=PATH)


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def test_query_equals_the_library_on_every_text(spark, sf, model):
    rows = {r["doc_id"]: r for r in op11_pieces(spark, sf).collect()}
    docs = spark.read.parquet(f"{sf}/documents.parquet").collect()
    assert len(rows) == len(docs)
    for r in docs:
        ids = model.encode(r["text"] or "") + [model.eos_id()]
        expected = (len(ids), sha(" ".join(map(str, ids))), sha(model.decode(ids)))
        assert (rows[r["doc_id"]]["n_tokens"], rows[r["doc_id"]]["ids_sha256"], rows[r["doc_id"]]["decoded_sha256"]) == expected


@pytest.mark.parametrize("hot, held", [(0, 1), (5, 3), (1 << 17, 100_000)])
def test_ids_do_not_depend_on_the_size_of_the_tables(docs, model, monkeypatch, hot, held):
    monkeypatch.setattr(pieces, "HOT", hot)
    monkeypatch.setattr(pieces.Segmented.__init__, "__defaults__", (None, held))
    rng = np.random.default_rng(5)
    texts = [None, "", " ", "\n", "   ", " \n a", "word " * 20_000, "x" * 300_000, "a\n\n  b\n"] + ["".join(rng.choice(PARTS, rng.integers(0, 12))) for _ in range(1500)] + ["the same text"] * 40
    encoded = pieces.encode(docs(texts, extra=["ids", "chunk", "n"]), PATH, decoded=True)
    decoded = {r["doc_id"]: r["text"] for r in pieces.decode(encoded, PATH).collect()}
    for r in encoded.collect():
        ids = model.encode(texts[r["doc_id"]] or "") + [2]
        assert r["ids"] == ids and decoded[r["doc_id"]] == r["decoded"] == model.decode(ids), repr(texts[r["doc_id"]])[:80]


def test_the_table_counts_what_tasks_cut(docs):
    texts = ["to be or  not\nto be", "\nto be", " be ▁ to", "to"]
    words = pieces.Pieces(PATH)
    counts = {}
    for text in texts:
        for chunk in words.chunks(text):
            counts[chunk] = counts.get(chunk, 0) + 1
    table = {r["chunk"]: (r["n"], bytes(r["ids"])) for r in pieces.chunk_table(docs(texts), PATH).collect()}
    assert table == {c: (n, words.segment(c)) for c, n in counts.items() if n > 1}
    assert counts["\nto"] == 2 and counts["be"] == 3 and counts[" be"] == 1


def test_decoding_any_ids_equals_the_library(spark, model):
    rng = np.random.default_rng(7)
    lists = [rng.choice([0, 1, 2, 28705, 259, 264, *range(3, 259)], rng.integers(0, 8)).tolist() for _ in range(2000)] + [[1, 264], [264, 2], [], [223, 1, 186]]
    rows = spark.createDataFrame([*enumerate(lists), (-1, None)], "doc_id long, ids array<int>")
    got = {r["doc_id"]: r["text"] for r in pieces.decode(rows, PATH).collect()}
    assert got == {**{i: model.decode(ids) for i, ids in enumerate(lists)}, -1: ""}


def test_empty_table_null_ids_and_repeated_rows(docs):
    assert pieces.encode(docs([]), PATH).count() == 0 and pieces.decode(pieces.encode(docs([]), PATH), PATH).count() == 0
    rows = pieces.encode(docs(["same"] * 3, ids=[5, 5, None]), PATH, end=False).collect()
    assert sorted(str(r["doc_id"]) for r in rows) == ["5", "5", "None"] and len({tuple(r["ids"]) for r in rows}) == 1
