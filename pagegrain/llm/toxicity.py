"""Toxicity classifier that is held to equal scores for texts that differ in an identity term only.

A text is the set of its words and their beginnings (hashed, lower-cased, four to eight bytes, so that
inflected forms share features). Logistic regression learns the labels. For each labelled text that
names an identity group, a counterfactual copy is made in which each identity term is swapped for
another of its list; the squared difference of the two scores' logits is part of the loss, so that the
terms themselves carry little weight, and a neutral mention of a group isn't held against a text.

The classifier is fitted on a bounded sample: at most ``per_class`` labelled texts of each label, those
with the smallest hashes. Features are made in Spark; the sample's feature numbers reach the driver.

Defined results: null and empty texts have no features and score as the classifier's base rate; if no
label could be learnt, every score is 0; rows are scored each, repeated rows alike; a null id stays
null; labelled rows with a null label, id or text teach nothing, and a document labelled twice counts
for each label; an empty table gives an empty result.
"""

from __future__ import annotations

import re

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagegrain.llm.common import buffers, record, spans_of, steps, stored
from pagegrain.llm.hashing import LOWER, VALUES, Sums

BITS = 18
PREFIXES = (4, 5, 6, 7, 8)
PER_CLASS = 4000
THRESHOLD = 0.7
RIDGE = 3e-3
LEAST_ODDS = 2.0
SWAP_WEIGHT = 1.0
ROUNDS = 120
LETTERS = np.array([b >= 128 or chr(b).isalpha() for b in range(256)])

# Identity terms, one list per group; a term is swapped for the next of its list.
IDENTITIES = [
    ["men", "women"],
    ["man", "woman"],
    ["boys", "girls"],
    ["muslim", "christian", "jewish", "hindu", "buddhist", "atheist"],
    ["muslims", "christians", "jews", "hindus", "buddhists", "atheists"],
    ["gay", "straight", "lesbian", "bisexual"],
    ["transgender", "cisgender"],
    ["black", "white", "asian", "latino"],
    ["african", "european", "american", "arab", "mexican", "chinese", "indian"],
    ["immigrants", "citizens", "refugees"],
    ["deaf", "blind", "disabled"],
    ["femmes", "hommes"],
    ["musulmans", "chrétiens", "juifs"],
    ["frauen", "männer"],
    ["muslime", "christen", "juden"],
    ["mujeres", "hombres"],
    ["musulmanes", "cristianos", "judíos"],
]


def swapper(identities: list[list[str]] | None = None):
    """Text to its counterfactual copy; None if it names no group."""
    after = {t: g[(i + 1) % len(g)] for g in identities or IDENTITIES for i, t in enumerate(g)}
    pattern = re.compile(r"\b(?:" + "|".join(sorted(map(re.escape, after), key=len, reverse=True)) + r")\b", re.IGNORECASE)

    def swapped(text: str | None) -> str | None:
        if text is None or not pattern.search(text):
            return None
        return pattern.sub(lambda m: after.get(m[0].lower(), m[0]), text)

    return swapped


def features(data: np.ndarray, offsets: np.ndarray, bits: int = BITS) -> tuple[np.ndarray, np.ndarray]:
    """(text number, feature number) of the distinct features of each text, in that order."""
    folded = LOWER[data]
    starts, ends = spans_of(LETTERS[folded], offsets)
    text = np.searchsorted(offsets, starts, "right") - 1
    # An empty text shares its offset with the next, so the last one at or before the start counts.
    sums, keys = Sums(VALUES[folded]), []
    for width in (0, *PREFIXES):
        keep = slice(None) if not width else np.flatnonzero(ends - starts > width)
        s = starts[keep]
        h = sums.of(s, ends[keep] if not width else s + width) + np.uint64(width)
        keys.append((text[keep] << bits) | (h >> np.uint64(64 - bits)).astype(np.int64))
    keys = np.unique(np.concatenate(keys))
    return keys >> bits, keys & ((1 << bits) - 1)


def _sampled(identities):
    swapped = swapper(identities)
    schema = pa.schema([("label", pa.int32()), ("own", pa.binary()), ("swapped", pa.binary())])

    def bytes_of(texts: list) -> list[bytes]:
        out = []
        for text in texts:
            if text is None:
                out.append(None)
                continue
            raw = np.frombuffer(text.encode(), np.uint8)
            out.append(features(raw, np.array([0, len(raw)]))[1].astype(np.int32).tobytes())
        return out

    def run(batches):
        for batch in batches:
            texts = batch.column(1).to_pylist()
            yield record(schema, batch.column(0).cast(pa.int32()), bytes_of(texts), bytes_of([swapped(t) for t in texts]))

    return run


def _rows(lists: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    return np.repeat(np.arange(len(lists)), [len(x) for x in lists]), np.concatenate(lists) if lists else np.zeros(0, np.int32)


def learn(labels: np.ndarray, own: list[np.ndarray], pairs: list[tuple[int, np.ndarray]], bits: int = BITS, ridge: float = RIDGE, swap_weight: float = SWAP_WEIGHT, rounds: int = ROUNDS) -> tuple[np.ndarray, float]:
    """Weights and base logit.

    Features enter with their log odds between the labels as value, and only where these exceed
    ``LEAST_ODDS``. The loss is logistic, either label weighing half, plus a ridge and the mean squared
    logit difference of swapped pairs (Adam, full batch).
    """
    n, size = len(labels), 1 << bits
    row, col = _rows(own)
    toxic = labels.sum()
    with_it, all_of = np.bincount(col, labels[row], size), np.bincount(col, minlength=size)
    prior = toxic / n
    odds = np.log((with_it + prior) / (toxic + 1)) - np.log((all_of - with_it + 1 - prior) / (n - toxic + 1))
    odds[(np.abs(odds) < LEAST_ODDS) | (all_of < 2)] = 0
    keep = odds[col] != 0
    row, col = row[keep], col[keep]
    weight = np.where(labels == 1, 0.5 / toxic, 0.5 / (n - toxic))
    at = np.array([p[0] for p in pairs], int)
    swap_row, swap_col = _rows([p[1] for p in pairs])
    v, base = np.zeros(size), 0.0
    first, second, first_base, second_base = np.zeros(size), np.zeros(size), 0.0, 0.0
    for t in range(1, rounds + 1):
        w = v * odds
        z = np.bincount(row, w[col], n)
        pull = (1 / (1 + np.exp(-np.clip(z + base, -40, 40))) - labels) * weight
        base_slope = float(pull.sum())
        slope = np.zeros(size)
        if len(at):
            gap = z[at] - np.bincount(swap_row, w[swap_col], len(at))
            push = 2 * swap_weight * gap / len(at)
            pull = pull + np.bincount(at, push, n)
            slope -= np.bincount(swap_col, push[swap_row], size)
        slope = (slope + np.bincount(col, pull[row], size)) * odds + ridge * v
        first, second = 0.9 * first + 0.1 * slope, 0.99 * second + 0.01 * slope * slope
        first_base, second_base = 0.9 * first_base + 0.1 * base_slope, 0.99 * second_base + 0.01 * base_slope**2
        rate = 0.05 * (1 - t / (rounds + 1))
        v = v - rate * (first / (1 - 0.9**t)) / (np.sqrt(second / (1 - 0.99**t)) + 1e-8)
        base -= rate * (first_base / (1 - 0.9**t)) / (np.sqrt(second_base / (1 - 0.99**t)) + 1e-8)
    return v * odds, base


def fit(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", label: str = "toxic", per_class: int = PER_CLASS, identities: list[list[str]] | None = None, swap_weight: float = SWAP_WEIGHT) -> dict:
    """The model, learnt from the labelled rows of ``docs``."""
    known = labels.select(F.col(doc_id).alias("id"), F.col(label).cast("int").alias("label")).where("id is not null and label in (0, 1)").distinct()
    rows = docs.select(F.col(doc_id).alias("id"), F.col(text).alias("text")).where("text is not null")
    # Ids alone are ranked, of rows that can teach; at most 2 * per_class of them are broadcast, so no text is shuffled.
    # Each task keeps the first ``per_class`` ids of a label, however many rows it has.
    able = known.join(rows.select("id"), "id", "left_semi")
    first, second = (able.where(F.col("label") == k).orderBy(F.xxhash64("id"), "id").limit(per_class) for k in (0, 1))
    chosen = first.unionByName(second)
    sample = rows.join(F.broadcast(chosen.select("id", "label")), "id").select("label", "text")
    sample = stored(sample.mapInArrow(_sampled(identities), "label int, own binary, swapped binary"), "toxicity-sample").collect()
    sample.sort(key=lambda r: (r["label"], r["own"]))
    y = np.array([r["label"] for r in sample], float)
    if not 0 < y.sum() < len(y):
        return {"w": None, "base": 0.0}
    own = [np.frombuffer(r["own"], np.int32) for r in sample]
    pairs = [(i, np.frombuffer(r["swapped"], np.int32)) for i, r in enumerate(sample) if r["swapped"] is not None]
    w, base = learn(y, own, pairs, swap_weight=swap_weight)
    return {"w": w.astype(np.float32), "base": base}


def score(docs: DataFrame, model: dict, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``doc_id, score`` for every row; no shuffle."""
    schema = pa.schema([("doc_id", pa.int64()), ("score", pa.float64())])
    scores = _scores(docs, model)

    def run(batches):
        for batch in batches:
            for rows, data, offsets in steps(iter([batch])):
                yield record(schema, rows.column(0), pa.array(scores(data, offsets)))

    return docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text")).mapInArrow(run, "doc_id long, score double")


def _scores(docs: DataFrame, model: dict):
    sent = docs.sparkSession.sparkContext.broadcast(model)  # 2**BITS weights, whatever the corpus

    def of(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        model, n = sent.value, len(offsets) - 1
        if model["w"] is None:
            return np.zeros(n)
        row, col = features(data, offsets)
        z = model["base"] + np.bincount(row, model["w"][col], n)
        return 1 / (1 + np.exp(-np.clip(z, -40, 40)))

    return of


def keep_clean(docs: DataFrame, model: dict, text: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """The rows, with all their columns, that score below ``threshold``; no shuffle."""
    scores = _scores(docs, model)

    @F.pandas_udf("double")
    def scored(texts):
        out = []
        for at in range(0, len(texts), 512):
            data, offsets = buffers(pa.Array.from_pandas(texts.iloc[at : at + 512], type=pa.large_string()))
            out.append(scores(data, offsets))
        return pd.Series(np.concatenate(out) if out else [], dtype=float)

    return docs.where(scored(F.col(text)) < threshold)
