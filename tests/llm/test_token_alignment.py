import hashlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
from sentencepiece import SentencePieceProcessor
from tokenizers import Tokenizer

from pagegrain.llm import pair_hash, token_alignment
from pagegrain.llm.packing import BYTE_CHARS
from pagegrain.llm.queries import op13_alignment

A, B = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
NAMES = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]


@pytest.fixture(scope="module")
def plain():
    """Brute force: rows of ids and texts to result rows."""
    first, second = Tokenizer.from_file(A), SentencePieceProcessor(model_file=B)
    first.encode_special_tokens = True
    back = {chr(c): b for b, c in BYTE_CHARS.items()}

    def b_bytes(i):
        piece = second.id_to_piece(i)
        return bytes([int(piece[3:-1], 16)]) if second.is_byte(i) else piece.replace("▁", " ").encode()

    def tokens(text):
        a = [(i, bytes(back[c] for c in first.id_to_token(i))) for i in first.encode(" " + text, add_special_tokens=False).ids] if text else []
        b = [(i, b_bytes(i)) for i in second.encode(text)] if text else []
        whole = (" " + (text or "")).encode()
        return (a, b) if b"".join(t for _, t in a) == b"".join(t for _, t in b) == whole else ([], [])

    def groups(a, b):
        out, i, j, at_a, at_b, ga, gb = [], 0, 0, 0, 0, [], []
        while i < len(a) or j < len(b):
            if at_a <= at_b:
                ga.append(a[i][0])
                at_a += len(a[i][1])
                i += 1
            else:
                gb.append(b[j][0])
                at_b += len(b[j][1])
                j += 1
            if at_a == at_b:
                out.append((ga, gb))
                ga, gb = [], []
        return out

    def run(rows):
        found = [(doc, *(t := tokens(text)), groups(*t)) for doc, text in rows]
        counts = Counter((ga[-1], gb[-1]) for *_, g in found for ga, gb in g)
        highest = {}
        for (_, b), n in counts.items():
            highest[b] = max(highest.get(b, 0), n)
        out = []
        for doc, a, b, g in found:
            links = [(ga[-1], gb[-1]) for ga, gb in g]
            text = ";".join(",".join(map(str, ga)) + "|" + ",".join(map(str, gb)) for ga, gb in g)
            sha = hashlib.sha256(text.encode()).hexdigest() if a else ""
            out.append((doc, len(a), len(b), len(g), len(links), sum(counts[x] == highest[x[1]] for x in links), sum(counts[x] for x in links), sha))
        return sorted(out, key=str)

    return run


def test_query_equals_brute_force(spark, sf, plain):
    docs = spark.read.parquet(f"{sf}/documents.parquet").collect()
    got = sorted([tuple(r[n] for n in NAMES) for r in op13_alignment(spark, sf).collect()], key=str)
    assert got == plain([(r["doc_id"], r["text"]) for r in docs])


def test_odd_texts_ties_and_repeated_rows(spark, tmp_path, plain, monkeypatch):
    monkeypatch.setattr(token_alignment, "HELD_PAIRS", 50)
    monkeypatch.setattr(token_alignment, "CHUNK", 64)
    monkeypatch.setattr(token_alignment, "FAN", 2)
    parts = ["a", "b", " ", "  ", "▁", "\n", "é", "日本", "🙂", "the", "<s>", "</s>", "<|endoftext|>", "<0x41>", "ing", "'s", "don't", ".", "5", "μg", "\x00"]
    rng = np.random.default_rng(4)
    texts = [None, "", " ", "\n", "a▁b", "<|endoftext|>", "long words " * 5000, "x" * 50_000] + ["".join(rng.choice(parts, rng.integers(0, 15))) for _ in range(600)] + ["the same"] * 30
    rows = [(None if i % 50 == 3 else i % 500, t) for i, t in enumerate(texts)]
    spark.createDataFrame([(*r, "x", "y") for r in rows], "doc_id long, text string, a string, key string").repartition(5).write.parquet(f"{tmp_path}/documents.parquet")
    assert sorted([tuple(r[n] for n in NAMES) for r in op13_alignment(spark, str(tmp_path)).collect()], key=str) == plain(rows)


def test_groups_give_the_ids_back(docs):
    texts = ["Straße und naïve cafés, 12345 times", None, "a▁b"]
    found = token_alignment.Alignment(docs(texts), A, B)
    rows = {r["doc_id"]: r for r in found.groups().collect()}
    assert rows[1]["a"] == rows[2]["a"] == rows[2]["b"] == [] and rows[2]["counts"] == []
    first, second = Tokenizer.from_file(A), SentencePieceProcessor(model_file=B)
    assert rows[0]["a"] == first.encode(" " + texts[0]).ids and rows[0]["b"] == second.encode(texts[0])
    assert rows[0]["a_ends"][-1] == len(rows[0]["a"]) and rows[0]["b_ends"][-1] == len(rows[0]["b"]) and len(rows[0]["counts"]) == len(rows[0]["best"]) == len(rows[0]["a_ends"])


def test_empty_table(docs):
    found = token_alignment.Alignment(docs([]), A, B)
    assert found.summaries().count() == 0 and found.groups().count() == 0 and len(found.counts.keys) == 0


def test_hash_is_perfect_and_unknown_keys_are_told(spark):
    rng = np.random.default_rng(1)
    keys = np.unique(rng.integers(0, 50_000, 40_000) << 32 | rng.integers(0, 32_000, 40_000))
    shards = pair_hash.shard_of(keys, 3)
    parts = [pair_hash.build(keys[shards == s]) for s in range(3)]
    hashed = pair_hash.PerfectHash([(np.packbits(bits).tobytes(), sizes.tolist()) for bits, sizes in parts])
    at = hashed(keys)
    assert hashed.n == len(keys) and (np.sort(at) == np.arange(len(keys))).all()
    dense = np.empty(len(keys), np.int64)
    dense[at] = keys
    counts = token_alignment.Counts(hashed, dense, np.ones(len(keys), np.int64))
    assert (counts.look_up(keys)[0] == 1).all()
    with pytest.raises(KeyError):
        counts.look_up(keys[:1] + 1)
    assert pair_hash.PerfectHash([])(keys[:0]).shape == (0,)


def test_linked_pairs_are_bounded_by_the_vocabularies(spark, sf):
    found = token_alignment.Alignment(spark.read.parquet(f"{sf}/documents.parquet"), A, B)
    bound = token_alignment.possible_pairs(A, B)
    assert 0 < len(found.counts.keys) <= bound < 500_000


def test_new_words_are_tokenised_together(monkeypatch):
    """As text by text, with few calls, and whatever the table holds."""
    rng = np.random.default_rng(8)
    words = ["the", "Straße", "don't", "a,b", "12", "x\ny", "x\n\ny\n", "日本", "é\t", "🙂!", "(see", "\x00", "ing", "'s"]
    texts = [" ".join(rng.choice(words, rng.integers(1, 12))) for _ in range(300)]
    texts += [None, "", " ", " a", "a ", "a  b", "\na", "a \n b", "a▁b", "▁", "a <|endoftext|> b", "<s> a", "x" * 3000]
    both = token_alignment.Aligner(A, B)
    alone = [tuple(ids.tobytes() for ids in both.tokens(text)) for text in texts]
    for held, new in ((600_000, 1 << 15), (5, 1 << 15), (600_000, 3)):
        monkeypatch.setattr(token_alignment, "HELD_WORDS", held)
        monkeypatch.setattr(token_alignment, "NEW_WORDS", new)
        table = token_alignment.WordTable(both)
        calls, plain = [], table._split
        monkeypatch.setattr(table, "_split", lambda w, calls=calls, plain=plain: calls.append(w) or plain(w))
        got = [pair for at in range(0, len(texts), 50) for pair in zip(*table.tokens(texts[at : at + 50]))]
        assert got == alone
        if held > len(words) and new > len(words):
            assert len(calls) <= -(-len(texts) // 50) and len(sum(calls, [])) == len(set(sum(calls, [])))


def test_words_whose_bytes_are_not_given_back_are_left_to_whole_texts(monkeypatch):
    both = token_alignment.Aligner(A, B)
    texts = ["one odd word", "two words", "odd", "three of them"]
    alone = [tuple(ids.tobytes() for ids in both.tokens(text)) for text in texts]
    table = token_alignment.WordTable(both)
    plain = table._split
    monkeypatch.setattr(table, "_split", lambda words: None if "odd" in words else plain(words))
    assert list(zip(*table.tokens(texts))) == alone and table.odd == {"odd"}
