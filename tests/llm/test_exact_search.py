import math

import numpy as np
import pytest

from pagegrain.llm import exact_search
from pagegrain.llm.queries import op9_exact_topk


def brute(rows, k, scale=1024):
    ok = {i: [math.floor(scale * x) for x in v] for i, v in rows if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)}
    out = []
    for q in ok:
        if q % 100 == 0:
            best = sorted((-sum(a * b for a, b in zip(ok[q], v)), i) for i, v in ok.items() if i != q and len(v) == len(ok[q]))[:k]
            out += [(q, r + 1, i, -s) for r, (s, i) in enumerate(best)]
    return sorted(out)


def result(spark, rows, k=10):
    df = spark.createDataFrame([(i, v, 1) for i, v in rows], "vec_id long, embedding array<double>, score int")
    return sorted(tuple(r) for r in exact_search.exact_top_k(df, df.where("vec_id % 100 = 0"), k).collect())


def test_query_equals_brute_force(spark, sf):
    rows = [(r["vec_id"], r["embedding"]) for r in spark.read.parquet(f"{sf}/embeddings.parquet").collect()]
    assert sorted(tuple(r) for r in op9_exact_topk(spark, sf).collect()) == brute(rows, 10)


@pytest.mark.parametrize("block", [7, 4096])
def test_ties_copies_and_bad_vectors(spark, monkeypatch, block):
    monkeypatch.setattr(exact_search, "CELL_BLOCK", block)
    monkeypatch.setattr(exact_search, "QUERY_BLOCK", 2)
    rng = np.random.default_rng(2)
    rows = [(i, rng.normal(size=4).round(2).tolist()) for i in range(0, 120)]
    rows += [(200 + i, [0.5, 0.5, 0.5, 0.5]) for i in range(150)]  # one vector that many rows share, queries among them
    rows += [(1000, None), (1001, [0.1, None, 0.2, 0.3]), (1002, [float("nan")] * 4), (1003, [float("inf")] * 4), (None, [0.1] * 4), (1100, [1.0, 2.0]), (1101, [3.0, -1.0])]
    rows += [rows[5], rows[100]]
    assert result(spark, rows) == brute(rows, 10)


def test_few_and_no_candidates(spark):
    rows = [(0, [1.0, 0.0]), (3, [0.5, 0.5]), (100, [0.0, 0.0])]
    assert result(spark, rows) == brute(rows, 10)
    assert result(spark, []) == []
    assert result(spark, [(0, [1.0])]) == []
