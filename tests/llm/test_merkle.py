import hashlib
import zlib
from collections import defaultdict

import numpy as np
import pytest

from pagegrain.llm import bitmap_rank, merkle
from pagegrain.llm.queries import op12_merkle


def h(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf_of(row):
    return h(*["-" if v is None else f"{len(str(v).encode())}:{v}" for v in (row[c] for c in merkle.HASHED)])


def tree(leaves):
    """Root, and per leaf its (left, right) siblings by level."""
    paths, spans = [[] for _ in leaves], [[i] for i in range(len(leaves))]
    while len(leaves) > 1:
        above, merged = [], []
        for at in range(0, len(leaves), 16):
            run = leaves[at : at + 16]
            for i in range(len(run)):
                for leaf in spans[at + i]:
                    paths[leaf].append(("".join(run[:i]), "".join(run[i + 1 :])))
            above.append(h(*run))
            merged.append([leaf for span in spans[at : at + 16] for leaf in span])
        leaves, spans = above, merged
    return leaves[0], paths


def brute_force(rows):
    by_source = defaultdict(list)
    for r in rows:
        by_source[r["source"]].append(r)
    order = sorted(by_source, key=lambda s: (s is not None, (s or "").encode()))
    own = {}
    for s in order:
        ranked = sorted(by_source[s], key=lambda r: (r["doc_id"] is not None, r["doc_id"] or 0, leaf_of(r)))
        own[s] = (ranked, *tree([leaf_of(r) for r in ranked]))
    root, upper = tree([own[s][1] for s in order])
    out = []
    for s, above in zip(order, upper):
        ranked, subroot, paths = own[s]
        for r, path in zip(ranked, paths):
            told = dict(r)
            if r["doc_id"] is not None and r["text"] and zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0:
                told["text"] = "".join(c.lower() if "A" <= c <= "Z" else c for c in r["text"])
            folded = leaf_of(told)
            for left, right in path + above:
                folded = h(left, folded, right)
            proof = h(*[side for pair in path + above for side in pair])
            out.append((r["doc_id"], leaf_of(r), subroot, root, proof, folded, folded == root))
    return sorted(out, key=str)


NAMES = ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]


def query(spark, df, tmp_path):
    df.write.parquet(f"{tmp_path}/documents.parquet")
    return sorted([tuple(r[n] for n in NAMES) for r in op12_merkle(spark, str(tmp_path)).collect()], key=str)


def test_query_equals_brute_force(spark, sf):
    rows = [r.asDict() for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    got = sorted([tuple(r[n] for n in NAMES) for r in op12_merkle(spark, sf).collect()], key=str)
    assert got == brute_force(rows)
    assert 0 < sum(not r[-1] for r in got) < len(got)


def test_nulls_ties_and_repeated_rows(spark, tmp_path):
    rng, rows = np.random.default_rng(3), []
    for i in range(700):
        source = [None, "", "hot", "Zed", "é"][min(rng.integers(0, 9), 4)]
        doc = [None, int(rng.integers(-5, 5)), int(rng.integers(-(2**62), 2**62)), int(rng.integers(0, 3000))][rng.integers(0, 4)]
        text = [None, "", "Same", "A" * 3000 + str(i)][rng.integers(0, 4)]
        rows.append({"doc_id": doc, "text": text, "lang": None if i % 3 else "en", "source": source, "n_chars": None if i % 5 else i, "at": "x", "digest": "y"})
    rows += [dict(rows[0], doc_id=None, text="twin", source="hot")] * 40 + [dict(rows[0], doc_id=7, source="alone")]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, at string, digest string").repartition(5)
    assert query(spark, df, tmp_path) == brute_force(rows)


@pytest.mark.parametrize("n", [0, 1, 16, 17, 4096, 4097, 5000])
def test_sizes_around_a_group_of_slots(spark, tmp_path, n):
    rows = [{"doc_id": 3 * i, "text": f"T{i}", "lang": "en", "source": "s", "n_chars": i} for i in range(n)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    assert query(spark, df, tmp_path) == (brute_force(rows) if rows else [])


def test_rounds_of_small_groups_and_many_sources(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(merkle, "LEVELS", 1)
    monkeypatch.setattr(merkle, "SLOTS", 16)
    rows = [{"doc_id": i, "text": f"T{i}", "lang": "en", "source": f"s{i % 19 if i % 2 else 0}", "n_chars": i} for i in range(900)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    assert query(spark, df, tmp_path) == brute_force(rows)


def test_a_container_ranks_lists_and_bits():
    rng = np.random.default_rng(1)
    for n in (0, 1, 100, 4096, 4097, 65536):
        lows = np.sort(rng.choice(65536, n, replace=False))
        counts = np.where(rng.random(n) < 0.1, rng.integers(2, 9, n), 1)
        raw, extra = bitmap_rank.packed(lows, counts)
        assert len(raw) == min(2 * n, 8192)
        container = bitmap_rank.Container(raw, extra)
        before, same = container.rank(lows)
        assert (before == np.cumsum(counts) - counts).all() and (same == counts).all()
        assert (container.counts()[0] == lows).all() and (container.counts()[1] == counts).all()


def test_ranks_equal_a_sort(spark):
    rng = np.random.default_rng(2)
    keys = [*rng.integers(-(2**63), 2**63 - 1, 300).tolist(), *range(-70_000, 70_000, 7), *range(5000), None, None]
    rows = [(["a", "b", None][i % 3], k, i) for i, k in enumerate(keys)]
    ranked = bitmap_rank.rank_rows(spark.createDataFrame(rows, "g string, k long, row long"), ["g"], ["k", "row"]).collect()
    for g in ("a", "b", None):
        own = sorted([r for r in rows if r[0] == g], key=lambda r: (r[1] is not None, r[1] or 0, r[2]))
        assert {r["row"]: r["rank"] for r in ranked if r["g"] == g} == {r[2]: i for i, r in enumerate(own)}
