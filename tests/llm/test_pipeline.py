import hashlib
import os

import pytest
from test_near_dedup import brute as near_brute
from test_packing import check as check_packing
from test_secrets import base as base_spans

import __spark_entry__
import corpus_pipeline
from pagegrain.llm import toxicity
from pagegrain.llm.common import stored
from pagegrain.llm.decontamination import words_of
from pagegrain.llm.queries import toxicity_model


@pytest.fixture(scope="module")
def stages(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    out = [("documents", docs)]
    for name, stage in corpus_pipeline.STAGES:
        docs = stored(stage(spark, docs, sf), f"test-{name}")
        out.append((name, docs))
    return out


def ids(df):
    return {r["doc_id"] for r in df.select("doc_id").collect()}


def test_columns_and_order(stages):
    assert [n for n, _ in stages[1:]] == ["toxicity", "near_dedup", "decontamination", "secrets", "packing"]
    assert all(df.dtypes == stages[0][1].dtypes for _, df in stages[1:-1])


def test_toxicity_stage_drops_rejected_documents(spark, sf, stages):
    scored = toxicity.score(stages[0][1], toxicity_model(spark, sf))
    assert ids(stages[1][1]) == ids(scored.where(f"score < {toxicity.THRESHOLD}"))


def test_near_dedup_stage_keeps_one_of_each_group(stages):
    truth = near_brute({r["doc_id"]: r["text"] for r in stages[1][1].collect()})
    assert ids(stages[2][1]) == {d for d, (_, _, kept) in truth.items() if kept}


def test_decontamination_stage_drops_holders_of_items(spark, sf, stages):
    bench = [" " + " ".join(words_of(r["text"])) + " " for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    clean = {r["doc_id"] for r in stages[2][1].collect() if not any(b in " " + " ".join(words_of(r["text"])) + " " for b in bench)}
    assert ids(stages[3][1]) == clean


def test_secrets_stage_keeps_documents_and_masks_spans(stages):
    before = {r["doc_id"]: r for r in stages[3][1].collect()}
    after = {r["doc_id"]: r for r in stages[4][1].collect()}
    assert set(before) == set(after)
    for d, row in after.items():
        assert not base_spans(row["text"])
        if not base_spans(before[d]["text"]):
            assert row == before[d]
        else:
            assert "[secret]" in row["text"] and row["n_chars"] == len(row["text"])


def test_packing_stage_holds_every_remaining_token(stages):
    assert check_packing(stages[5][1].collect(), {r["doc_id"]: r["text"] for r in stages[4][1].collect()}) < 1024


def test_run_gives_the_last_stage(spark, sf, stages):
    def digest(df):
        pieces = sorted((r["doc_id"], r["start"], r["doc_tokens"]) for r in df.collect() if r["start"] == 0)
        return hashlib.sha256(repr(pieces).encode()).hexdigest()

    assert digest(corpus_pipeline.run(spark, sf)) == digest(stages[5][1])
    assert "pipeline" in __spark_entry__.queries()


def test_stages_take_clashing_columns_nulls_and_empty_tables(spark, sf, docs):
    odd = docs(["password=12345678 " + "w " * 30, None, ""], extra=["_before", "score", "id", "kept"])
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, odd, sf).count() >= 3, name
        assert stage(spark, docs([]), sf).count() == 0, name


def test_eleven_queries_are_registered():
    names = set(__spark_entry__.queries())
    assert {f"op{n}" for n in range(1, 11)} <= {n.split("_")[0] for n in names} and "pipeline" in names
    assert os.path.exists(os.path.join(os.path.dirname(__spark_entry__.__file__), "corpus_pipeline.py"))
