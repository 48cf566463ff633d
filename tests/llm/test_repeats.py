import hashlib

import numpy as np
import pyarrow as pa
import pytest

from pagegrain.llm import column_bwt, fm_index, repeats
from pagegrain.llm.queries import op3_substring_dedup, op4_suffix_dedup


def brute(texts, window, words):
    """Every window in order of document and start against all seen before."""
    seen, out = set(), {}
    for doc, text in sorted(texts.items()):
        raw = (text or "").encode()
        symbols = raw.split() if words else raw
        gone = np.zeros(len(symbols), bool)
        for i in range(len(symbols) - window + 1):
            own = tuple(symbols[i : i + window]) if words else symbols[i : i + window]
            if own in seen:
                gone[i : i + window] = True
            seen.add(own)
        kept = b" ".join(w for w, g in zip(symbols, gone) if not g) if words else bytes(b for b, g in zip(symbols, gone) if not g)
        spans = int((np.diff(np.concatenate([[0], gone.astype(int)])) == 1).sum())
        out[doc] = (len(symbols), int(gone.sum()), spans, hashlib.sha256(kept).hexdigest())
    return out


def found(df):
    return {r["doc_id"]: (r["n"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in df.collect()}


def test_queries_equal_brute_force(spark, sf):
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    truth = brute(texts, 20, True)
    assert {r["doc_id"]: (r["n_words"], r["n_removed"], r["kept_sha256"]) for r in op3_substring_dedup(spark, sf).collect()} == {d: (n, g, k) for d, (n, g, _, k) in truth.items()}
    truth = brute(texts, 100, False)
    assert {r["doc_id"]: (r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in op4_suffix_dedup(spark, sf).collect()} == truth


@pytest.fixture
def planted(prose):
    passage, line = prose(1, 40), prose(2, 9)
    texts = [prose(10 + i, 30) for i in range(12)]
    texts[3] = texts[2]
    texts[5] = prose(50, 12) + " " + passage + " " + prose(51, 12)
    texts[6] = passage + "\n" + passage
    texts[7] = prose(52, 5) + "\t" + passage[: len(passage) // 2]
    texts += [f"{prose(60 + i, 6)} {line} {passage} {prose(90 + i, 6)}" for i in range(20)]
    texts += ["x " * 300, "x " * 80 + "y", "é" * 250, "\x00" * 130 + "aé" * 90, "", None, "one", texts[5].replace(" ", "  ")]
    return texts


@pytest.mark.parametrize("hot", [300, 4 << 20])
@pytest.mark.parametrize("size", [2_000, 1 << 20])
def test_planted_repeats(docs, planted, monkeypatch, hot, size):
    monkeypatch.setattr(repeats, "HOT_BYTES", hot)
    monkeypatch.setattr(repeats, "SHARD_BYTES", size)
    rows = docs(planted, extra=["n", "row", "anchor"]).repartition(3)
    texts = dict(enumerate(planted))
    assert found(fm_index.remove_repeated_words(rows, 8)) == brute(texts, 8, True)
    assert found(column_bwt.remove_repeated_bytes(rows, 40)) == brute(texts, 40, False)


def test_kept_text_and_spans(docs, planted):
    out = column_bwt.remove_repeated_bytes(docs(planted), 40, with_text=True).collect()
    for r in out:
        raw = (planted[r["doc_id"]] or "").encode()
        spans = list(zip(r["spans"][::2], r["spans"][1::2]))
        assert bytes(r["kept"]) == b"".join(raw[a:b] for a, b in zip([0] + [e for _, e in spans], [s for s, _ in spans] + [len(raw)]))


def test_repeated_rows_null_ids_and_empty_tables(docs, prose):
    text = prose(1, 40)
    same = fm_index.remove_repeated_words(docs([text, text, text], ids=[4, 4, None])).collect()
    assert len(same) == 3 and all(r["n_removed"] == 0 for r in same)
    later = {r["doc_id"]: r["n_removed"] for r in fm_index.remove_repeated_words(docs([text, text, text], ids=[4, 4, 9])).collect()}
    assert later == {4: 0, 9: 40}
    assert fm_index.remove_repeated_words(docs([])).count() == 0 == column_bwt.remove_repeated_bytes(docs([])).count()


def test_wavelet_ranks():
    rng = np.random.default_rng(1)
    symbols = rng.integers(0, 37, 1000)
    tree = fm_index.WaveletMatrix(symbols, 36)
    of, at = rng.integers(0, 37, 300), rng.integers(0, 1001, 300)
    assert tree.rank(of, at).tolist() == [int((symbols[:i] == c).sum()) for c, i in zip(of, at)]


def test_backward_search_counts_matches():
    fragments = [b"a b a b c".split(), b"b a b".split(), b"c".split()]
    index = fm_index.FMIndex(fragments, 2)
    code = {w: i + 1 for i, w in enumerate([b"a", b"b", b"c"])}
    for pattern in ([b"a"], [b"a", b"b"], [b"b", b"a", b"b"], [b"c", b"a"], [b"b", b"c"]):
        low, high = np.array([0]), np.array([len(index.words)])
        for w in reversed(pattern):
            low, high = index.step(np.array([code[w]]), low, high)
        n = sum(f[i : i + len(pattern)] == pattern for f in fragments for i in range(len(f)))
        assert int(high[0] - low[0]) == n


def test_collection_transform_and_prefixes():
    rng = np.random.default_rng(3)
    fragments = [bytes(rng.integers(97, 100, n).astype(np.uint8)) for n in rng.integers(1, 30, 40)]
    suffixes = sorted((f[i:], k, i) for k, f in enumerate(fragments) for i in range(len(f) + 1))
    transform, common, _ = column_bwt.collection(fragments)
    assert transform.tolist() == [fragments[k][i - 1] + 1 if i else 0 for _, k, i in suffixes]
    for at in range(1, len(suffixes)):
        a, b = suffixes[at - 1][0], suffixes[at][0]
        n = next((i for i, (x, y) in enumerate(zip(a, b)) if x != y), min(len(a), len(b)))
        assert common[at] == n


def test_thue_morse_words_stay_apart(docs):
    """Two words of 2,048 letters whose polynomial hashes modulo 2^64 are equal, whatever the letters' values."""
    word = "".join("ab"[bin(i).count("1") % 2] for i in range(2048))
    other = word.translate(str.maketrans("ab", "ba"))
    texts = [" ".join(f"word{i}" for i in range(19)) + " " + last for last in (word, other, word)]
    rows = {r["doc_id"]: r for r in fm_index.remove_repeated_words(docs(texts)).collect()}
    assert [rows[i]["n_removed"] for i in range(3)] == [0, 0, 20]


def test_rounds_sort_runs_only(monkeypatch):
    """A round of the column-wise construction sorts the runs of its stream, not all of it."""
    passage = bytes(np.random.default_rng(5).integers(97, 123, 60).astype(np.uint8))
    fragments = [passage[:n] + passage[-20:] for n in range(20, 60)] * 5
    sizes, plain = [], column_bwt._by_symbol
    monkeypatch.setattr(column_bwt, "_by_symbol", lambda symbols: sizes.append(len(symbols)) or plain(symbols))
    transform, common, length = column_bwt.collection(fragments)
    assert len(transform) == len(common) == sum(length) + len(fragments)
    streams = sum(len(fragments) + int(np.minimum(length, read).sum()) for read in range(int(length.max())))
    assert sum(sizes) < streams / 2


def test_texts_are_cut_for_anchors_once(docs, prose, monkeypatch):
    plans, plain = {}, repeats.stored
    monkeypatch.setattr(repeats, "stored", lambda df, name: plans.setdefault(name, df._jdf.queryExecution().sparkPlan().toString()) and plain(df, name))
    column_bwt.remove_repeated_bytes(docs([prose(1), prose(1), prose(2)])).collect()
    assert plans["cut"].count("Scan") == 2  # for the anchors, and for the texts themselves


def test_fragments_hold_every_window_of_one_anchor():
    rng = np.random.default_rng(6)
    for _ in range(50):
        first = np.concatenate([[0], np.cumsum(rng.integers(0, 30, 6))])
        values = rng.integers(1, 1 << 62, 4, dtype=np.uint64)[rng.integers(0, 4, first[-1])]
        text, start, length, anchor, _ = repeats.fragments(values, first, 8, 3)
        held = sorted((t, s + i) for t, s, n in zip(text.tolist(), start.tolist(), length.tolist()) for i in range(n - 7))
        assert held == [(t, i) for t, n in enumerate(np.diff(first).tolist()) for i in range(n - 7)]
        assert len(anchor) == len(text)


@pytest.mark.parametrize("size", [1, 2, 5, 20])
def test_anchors_of_others_are_told_across_batches(size):
    anchors, rows = pa.array([1, 2, 2, 3, 4, 4, 4, 4, 4, 5, 6, 6], pa.int64()), pa.array(range(12), pa.int64())
    table = pa.table({"anchor": anchors, "row": rows})
    batches = [table.slice(0, 0).combine_chunks().to_batches(), table.to_batches(size)]
    got = [r for b in repeats._shared(iter(sum(batches, []))) for r in b.column(1).to_pylist()]
    assert got == [1, 2, 4, 5, 6, 7, 8, 10, 11]
    assert sum(b.num_rows for b in repeats._shared(iter([]))) == 0


def test_spans_that_touch_are_one():
    text, start, end = np.array([2, 0, 0, 0, 2]), np.array([4, 9, 0, 3, 0]), np.array([6, 12, 5, 9, 3])
    cuts, begins, ends = repeats._joined(text, start, end, 4)
    assert cuts.tolist() == [0, 1, 1, 3, 3] and begins.tolist() == [0, 0, 4] and ends.tolist() == [12, 3, 6]
    cuts, begins, _ = repeats._joined(text[:0], start[:0], end[:0], 2)
    assert cuts.tolist() == [0, 0, 0] and len(begins) == 0
