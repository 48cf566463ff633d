import numpy as np
import pytest

from pagegrain.llm import decontamination
from pagegrain.llm.decontamination import contaminated_pairs, keep_uncontaminated, question_and_answer, words_of
from pagegrain.llm.queries import op7_decontamination


def items(spark, texts):
    return spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts)], "item_id long, text string, score string")


def test_query_equals_whole_word_search(spark, sf):
    small = sf.replace("sf0.001", "sf0.01")
    bench = {r["item_id"]: " " + " ".join(words_of(r["text"])) + " " for r in spark.read.parquet(f"{small}/benchmark.parquet").collect()}
    docs = spark.read.parquet(f"{small}/documents.parquet").collect()
    want = {(d["doc_id"], i) for d in docs for whole in [" " + " ".join(words_of(d["text"])) + " "] for i, b in bench.items() if b in whole}
    got = {(r["doc_id"], r["item_id"]) for r in op7_decontamination(spark, small).collect()}
    assert want and got == want


@pytest.mark.parametrize("terms", [30, 50_000])
@pytest.mark.parametrize("maxima", [50, 1 << 24])
def test_retrieval_equals_scoring_every_item(monkeypatch, prose, terms, maxima):
    monkeypatch.setattr(decontamination, "MAXIMA", maxima)
    rng = np.random.default_rng(1)
    vocabulary = [f"w{i}" for i in range(80)]
    texts = [" ".join(rng.choice(vocabulary, rng.integers(3, 25))) for _ in range(70)]
    df = {w: sum(w in t.split() for t in texts) for w in vocabulary}
    average = np.mean([len(t.split()) for t in texts])
    postings = [(i, w, t.split().count(w), df[w], len(t.split())) for i, t in enumerate(texts) for w in set(t.split())]
    index = decontamination.Index(postings, list(enumerate(texts)), len(texts), average)
    impact = {}
    for i, w, tf, d, length in postings:
        impact[i, w] = np.log(1 + (len(texts) - d + 0.5) / (d + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * length / average))
    own = {i: sum(v for (j, _), v in impact.items() if j == i) for i in range(len(texts))}
    for _ in range(60):
        query = set(rng.choice(vocabulary, 25))
        want = {i for i in own if sum(impact.get((i, w), 0) for w in query) / own[i] >= 0.5}
        got = index.retrieve(np.array(sorted(index.terms[w] for w in query if w in index.terms)), 0.5)
        assert {i for i, _ in got} == want


def test_planted_passages(spark, docs, prose, monkeypatch):
    monkeypatch.setattr(decontamination, "SHARD_TERMS", 25)
    bench = [prose(1, 20) + "? " + prose(2, 12) + ".", prose(3, 30), prose(4, 200), None, "", "??", "short one", prose(3, 30)]
    texts = [
        prose(10, 300) + " " + bench[0] + " " + prose(11, 300),
        bench[0].upper().replace(" ", "\n"),
        bench[0].split("?")[0] + " " + prose(12, 40),  # the question alone
        prose(13, 63) + " " + bench[1],
        prose(14, 100) + " " + bench[2],
        prose(15, 500),
        None,
        "",
        " ".join(sorted(bench[1].split())),  # its words in another order
        "short one",
    ]
    rows = docs(texts + [texts[1]], ids=[*range(10), 1], extra=["score", "item_id"])
    out = contaminated_pairs(rows, items(spark, bench)).collect()
    assert sorted((r["doc_id"], r["item_id"]) for r in out) == [(0, 0), (1, 0), (3, 1), (3, 7), (4, 2), (9, 6)]
    assert all(r["score"] > 0.99 and r["question_overlap"] == r["answer_overlap"] == 1 for r in out)
    clean = keep_uncontaminated(rows, items(spark, bench))
    assert sorted(r["doc_id"] for r in clean.collect()) == [2, 5, 6, 7, 8] and clean.columns == rows.columns


@pytest.mark.parametrize("terms", [25, 50_000])
def test_a_pair_does_not_depend_on_other_items(spark, docs, prose, monkeypatch, terms):
    monkeypatch.setattr(decontamination, "SHARD_TERMS", terms)
    question, answer = prose(1, 15) + "? ", prose(2, 15) + "."
    held = " ".join([prose(20, 40), question + answer, prose(21, 60), question + answer])
    rows = docs([question + prose(22, 500) + " " + answer, held])
    alone = contaminated_pairs(rows, items(spark, [question + answer])).collect()
    beside = contaminated_pairs(rows, items(spark, [question + answer, prose(3, 2000), prose(4, 90)])).collect()
    both = [[(r["doc_id"], r["item_id"], r["n_passages"]) for r in found] for found in (alone, beside)]
    assert both[0] == both[1] and [p[0] for p in both[0]] == [1]


@pytest.mark.parametrize("terms", [1, 50_000])
def test_texts_of_one_id_count_apart(spark, docs, prose, monkeypatch, terms):
    monkeypatch.setattr(decontamination, "SHARD_TERMS", terms)
    texts = [prose(1, 20), prose(2, 20), prose(3, 20)]
    bench = spark.createDataFrame([(7, t) for t in texts], "item_id long, text string")
    found = contaminated_pairs(docs([" ".join(texts)]), bench).collect()
    assert [(r["item_id"], r["n_passages"]) for r in found] == [(7, 1)]


def test_empty_tables(spark, docs):
    assert contaminated_pairs(docs(["a b c"]), items(spark, [])).count() == 0
    assert contaminated_pairs(docs([]), items(spark, ["a b c"])).count() == 0
    assert keep_uncontaminated(docs(["a b c"]), items(spark, [None])).count() == 1


def test_question_and_answer():
    assert question_and_answer("What is it now? It is that thing.") == (["what", "is", "it", "now"], ["it", "is", "that", "thing"])
    assert question_and_answer("one two three four\nfive six seven")[1] == ["five", "six", "seven"]
    assert question_and_answer("a b c d. e f g.")[1] == ["e", "f", "g"]
    assert question_and_answer("a b c d")[0] == ["a", "b"] and question_and_answer("?") == ([], [])
