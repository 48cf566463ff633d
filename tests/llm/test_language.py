import numpy as np

from pagegrain.llm import language
from pagegrain.llm.queries import op10_language


def test_held_out_accuracy(spark, sf):
    truth = {r["doc_id"]: r["lang"] for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    rows = op10_language(spark, sf).collect()
    assert len(rows) == len(truth)
    held = [r for r in rows if r["held_out"]]
    assert sum(r["lang_pred"] == truth[r["doc_id"]] for r in held) >= 0.95 * len(held)
    assert all(0 <= r["score"] <= 1 for r in rows)


def test_letterless_null_and_unlearnt(docs, spark, sf):
    texts = [None, "", "123 !?", "x", "the and of " * 20_000]
    model = language.fit(spark.read.parquet(f"{sf}/documents.parquet"))
    out = {r["doc_id"]: r for r in language.predict(docs(texts, extra=["score"]), model).collect()}
    assert [out[i]["lang_pred"] for i in range(3)] == ["und"] * 3 and [out[i]["score"] for i in range(3)] == [0.0] * 3
    assert out[3]["lang_pred"] in model["langs"] and out[4]["lang_pred"] == "en"
    none = language.fit(docs([None, "123"]))
    assert {r["lang_pred"] for r in language.predict(docs(texts), none).collect()} == {"und"}
    assert language.predict(docs([]), model).count() == 0


def test_clusters_and_rejection(docs):
    rows = docs(["aaa bbb aab"] * 3 + ["xyx yxx xxy", "zz zz zq"])
    model = language.fit(rows)
    assert model["langs"] == ["en"] * language.CLUSTERS
    far = language.predict(docs(["ükwök jöpmt", "aaa bbb aab"]), model).orderBy("doc_id").collect()
    assert far[0]["rejected"] and not far[1]["rejected"]
    assert far[0]["score"] < far[1]["score"]


def test_same_result_for_repeated_rows_and_any_split(docs):
    model = language.fit(docs(["abc def", "ghi jkl"]))
    out = language.predict(docs(["abc xyz"] * 3, ids=[7, 7, None]).repartition(3), model).select("lang_pred", "score").distinct()
    assert out.count() == 1


def test_every_language_is_learnt_however_many_copies(docs):
    """Rows far beyond the sample in few distinct texts: none is lost, no hot text fills the sample."""
    few = {f"l{k}": [f"{chr(97 + k) * 3} {chr(97 + (k + i) % 26) * 4}" for i in range(3)] for k in range(24)}
    rows = [(t, lang) for lang, texts in few.items() for t in texts for _ in range(20)]
    many = [f"word{chr(97 + i % 26)}{chr(97 + i // 26)} sky" for i in range(200)]
    frame = docs([]).sparkSession.createDataFrame(rows + [(t, "many") for t in many + [many[7]] * 400], "text string, lang string")
    model = language.fit(frame, per_language=10)
    assert set(model["langs"]) == {*few, "many"}
    out = language.predict(docs([texts[0] for texts in few.values()]), model).orderBy("doc_id").collect()
    assert [r["lang_pred"] for r in out] == list(few)
    assert model["langs"].count("many") == language.CLUSTERS


def test_copies_take_left_places_in_turns():
    assert language.dealt(np.array([5, 1, 9]), 10).tolist() == [5, 1, 4]
    assert language.dealt(np.array([500] * 4), 3).tolist() == [1, 1, 1, 0]
    assert language.dealt(np.array([2, 1]), 10).tolist() == [2, 1]
