import numpy as np
import pytest


@pytest.fixture
def docs(spark):
    """Documents from texts, with nulls and clashing extra columns where asked."""

    def make(texts, ids=None, extra=()):
        ids = list(range(len(texts))) if ids is None else ids
        names = "doc_id long, text string, lang string, source string, n_chars long" + "".join(f", {c} string" for c in extra)
        rows = [(i, t, "en", "s", None if t is None else len(t), *["x"] * len(extra)) for i, t in zip(ids, texts)]
        return spark.createDataFrame(rows, names)

    return make


@pytest.fixture
def prose():
    """Random words from a generator; distinct seeds share no five words in a row."""

    def make(seed, words=60):
        rng = np.random.default_rng(seed)
        return " ".join("".join(rng.choice(list("abcdefghij"), rng.integers(3, 8))) for _ in range(words))

    return make
