import numpy as np
import pytest

from pagegrain.llm import toxicity
from pagegrain.llm.queries import op1_toxicity


def test_query_separates_held_out_labels(spark, sf):
    small = sf.replace("sf0.001", "sf0.01")
    labels = {r["doc_id"]: r["toxic"] for r in spark.read.parquet(f"{small}/labels.parquet").collect()}
    rows = op1_toxicity(spark, small).collect()
    assert len(rows) == spark.read.parquet(f"{small}/documents.parquet").count()
    held = [(r["score"], labels[r["doc_id"]], r["predicted"]) for r in rows if r["held_out"] and labels.get(r["doc_id"]) is not None]
    good, bad = [s for s, y, _ in held if y == 0], [s for s, y, _ in held if y == 1]
    assert np.mean([b > g for b in bad for g in good]) > 0.8
    assert sum(p for _, y, p in held if y == 0) <= 0.05 * len(good)
    assert all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.7) for r in rows)


def biased():
    """Insults stand mostly beside one group's name in the labelled texts."""
    rng = np.random.default_rng(4)
    words = ["walk", "house", "river", "music", "garden", "winter", "paper", "market"]
    texts, labels = [], []
    for i in range(240):
        base = list(rng.choice(words, 6))
        toxic = i % 3 == 0
        if toxic:
            base[2] = ["horrid", "vile"][i % 2]
        if toxic or i % 40 == 1:
            base[4] = "muslim"
        elif i % 5 == 0:
            base[4] = "christian"
        texts.append(" ".join(base))
        labels.append(int(toxic))
    return texts, labels


@pytest.fixture
def labelled(spark, docs):
    texts, labels = biased()
    return docs(texts), spark.createDataFrame(list(enumerate(labels)), "doc_id long, toxic int")


def test_swaps_take_weight_off_identity_terms(docs, labelled):
    probe = docs(["music muslim garden river", "music christian garden river", "music vile garden river"])
    scores = {}
    for weight in (0.0, 5.0):
        model = toxicity.fit(*labelled, swap_weight=weight)
        scores[weight] = [r["score"] for r in toxicity.score(probe, model).orderBy("doc_id").collect()]
    gap = {w: abs(s[0] - s[1]) for w, s in scores.items()}
    assert gap[5.0] < 0.5 * gap[0.0]
    assert scores[5.0][0] < 0.7 <= scores[5.0][2]


def test_labels_of_missing_and_null_texts_take_no_places(docs, spark):
    texts, labels = biased()
    nulls = list(range(1000, 2000))
    rows = docs(texts + [None] * len(nulls), ids=[*range(len(texts)), *nulls])
    useless = [(i, i % 2) for i in range(1000, 6000)]
    own = spark.createDataFrame(list(enumerate(labels)), "doc_id long, toxic int")
    more = spark.createDataFrame([*enumerate(labels), *useless], "doc_id long, toxic int")
    probe = docs(["music vile garden river", "music house garden river"])
    want, got = ([r["score"] for r in toxicity.score(probe, toxicity.fit(rows, known, per_class=40)).orderBy("doc_id").collect()] for known in (own, more))
    assert got == want and got[0] > got[1]


def test_swapper():
    swap = toxicity.swapper()
    assert swap("The Women sang, womenfolk too") == "The men sang, womenfolk too"
    assert swap("nothing here") is None and swap(None) is None


def test_edges(docs, spark, labelled):
    model = toxicity.fit(*labelled)
    texts = [None, "", "!!!", "vile " * 30_000, "house"]
    out = {r["doc_id"]: r["score"] for r in toxicity.score(docs(texts, extra=["score", "label"]), model).collect()}
    assert out[0] == out[1] == out[2] and out[3] > 0.7 > out[4]
    assert sorted(r["doc_id"] for r in toxicity.keep_clean(docs(texts, extra=["score"]), model).collect()) == [0, 1, 2, 4]
    assert toxicity.score(docs([]), model).count() == 0
    nothing = toxicity.fit(docs(["a"]), spark.createDataFrame([(0, None), (None, 1)], "doc_id long, toxic int"))
    assert [r["score"] for r in toxicity.score(docs(["a"]), nothing).collect()] == [0.0]


def test_features_do_not_depend_on_neighbours():
    texts = ["", "Gräßlich words", "", "x", "Gräßlich words"]
    raw = [t.encode() for t in texts]
    data, offsets = np.frombuffer(b"".join(raw), np.uint8), np.concatenate([[0], np.cumsum([len(r) for r in raw])])
    text, feature = toxicity.features(data, offsets)
    assert feature[text == 1].tolist() == feature[text == 4].tolist() and len(feature[text == 1]) > 5
    assert set(text) == {1, 3, 4}
