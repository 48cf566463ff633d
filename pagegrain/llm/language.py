"""Language of a text by its nearest centroid.

A text is a vector of hashed byte n-grams (lower-cased; one to three bytes; ASCII characters that are
no letters count as spaces, of which no gram holds two in a row), weighted by 1 + log(count) and inverse document frequency and normalised.
Each language has a few centroids, found by clustering its own training vectors (k-means on the unit
sphere); a text takes the language of the centroid with the highest cosine. A text farther from its
centroid than almost all training vectors of that centroid is marked as rejected.

The classifier is fitted on a bounded sample: at most ``per_language`` labelled rows of each language,
the distinct texts with the smallest hashes first; copies take the places that distinct texts leave, in
turns, so no text crowds out another and each language with labelled rows is learnt. Clustering runs as
one Spark group per language; only counts of hashes by size, document frequencies and centroids reach
the driver.

Defined results: a null text, or one without any letter, is ``und`` with score 0 and is rejected, as is
every text if nothing could be learnt; rows are scored each, so repeated rows get equal results; a null
id stays null; rows without language or text teach nothing; equal cosines go to the language that sorts
first; an empty table gives an empty result.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pagegrain.llm.common import record, steps, stored

SIZE = 4096  # hashed n-grams
PER_LANGUAGE = 600
CLUSTERS = 4
ROUNDS = 12
REJECTED_SHARE = 0.002  # share of training vectors that the rejection distance leaves outside
UNKNOWN = "und"
LETTER = re.compile(r"[^\W\d_]")
FOLDED = bytes(b if b >= 128 or chr(b).isalpha() else 32 for b in range(256)).lower()
TABLE = np.frombuffer(FOLDED, np.uint8).astype(np.uint32)


def counts_of(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Hashed n-gram counts, one row per text; grams don't cross texts."""
    n = len(offsets) - 1
    b = TABLE[data]
    row = np.repeat(np.arange(n, dtype=np.int64) * SIZE, np.diff(offsets))
    out = np.zeros(n * SIZE, np.float32)
    key = np.zeros(len(b), np.uint32)
    for width in (1, 2, 3):
        if len(b) < width:
            break
        key = key[: len(b) - width + 1] * np.uint32(257) + b[width - 1 :] + np.uint32(1)
        place = ((key * np.uint32(2654435761)) >> np.uint32(20)).astype(np.int64)
        inside = row[: len(key)] == row[width - 1 :]
        for at in range(width - 1):  # runs of spaces and punctuation tell nothing
            inside &= (b[at : at + len(key)] != 32) | (b[at + 1 : at + 1 + len(key)] != 32)
        if width == 1:
            inside &= b != 32
        out += np.bincount(row[: len(key)][inside] + place[inside], minlength=n * SIZE)
    return out.reshape(n, SIZE)


def lowered(texts: pa.Array) -> pa.Array:
    """Lower case beyond ASCII as well; nulls stay."""
    return pa.array([t.lower() if t is not None else None for t in texts.to_pylist()], pa.large_string())


def vectors(counts: np.ndarray, idf: np.ndarray) -> np.ndarray:
    x = np.where(counts > 0, np.log1p(counts, dtype=np.float32), 0) * idf
    norm = np.sqrt((x * x).sum(1, keepdims=True))
    return (x / np.maximum(norm, 1e-9)).astype(np.float32)


def _sampled(batches):
    schema = pa.schema([("lang", pa.string()), ("nth", pa.int64()), ("copies", pa.int64()), ("counts", pa.binary())])
    for batch in batches:
        batch = pa.RecordBatch.from_arrays([*batch.columns[:3], lowered(batch.column(3))], ["lang", "nth", "copies", "text"])
        for rows, data, offsets in steps(iter([batch])):
            counts = np.minimum(counts_of(data, offsets), 65535).astype(np.uint16)
            yield record(schema, rows.column(0).cast(pa.string()), rows.column(1), rows.column(2), [c.tobytes() for c in counts])


def dealt(copies: np.ndarray, places: int) -> np.ndarray:
    """How many places each text takes: one, then one more in turns while it has copies and places are left."""
    taken = np.zeros(len(copies), np.int64)
    while places > 0 and len(left := np.flatnonzero(taken < copies)):
        taken[left[:places]] += 1
        places -= len(left)
    return taken


def _rows(rows: pa.Table, places: int) -> list[bytes]:
    """Counts of the sample's rows of one language, copies included."""
    rows = rows.sort_by("nth")
    taken = dealt(rows["copies"].to_numpy(), places)
    return [c for c, times in zip(rows["counts"].to_pylist(), taken.tolist()) for _ in range(times)]


def _frequencies(places: int):
    def run(key, rows):
        counts = np.stack([np.frombuffer(c, np.uint16) for c in _rows(rows, places)])
        return pa.table({"lang": [key[0].as_py()], "n": pa.array([len(counts)], pa.int64()), "df": [(counts > 0).sum(0).astype(np.int64).tobytes()]})

    return run


def clustered(x: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Unit centroids by k-means with cosine, started from far-apart vectors, and each vector's cluster."""
    start = [int(np.argmax(x @ x.mean(0)))]
    while len(start) < min(k, len(x)):
        start.append(int(np.argmin((x @ x[start].T).max(1))))
    centres = x[start]
    for _ in range(ROUNDS):
        own = np.argmax(x @ centres.T, 1)
        sums = np.stack([x[own == c].sum(0) if (own == c).any() else centres[c] for c in range(len(centres))])
        centres = sums / np.maximum(np.sqrt((sums * sums).sum(1, keepdims=True)), 1e-9)
    return centres, np.argmax(x @ centres.T, 1)


def _centroids(idf: np.ndarray, k: int, places: int):
    def run(key, rows):
        counts = np.stack([np.frombuffer(c, np.uint16) for c in sorted(_rows(rows, places))])
        x = vectors(counts.astype(np.float32), idf)
        centres, own = clustered(x, k)
        near = (x * centres[own]).sum(1)
        least = [float(np.quantile(near[own == c], REJECTED_SHARE)) - 1e-5 if (own == c).any() else 1.0 for c in range(len(centres))]
        return pa.table({"lang": [key[0].as_py()] * len(centres), "nth": pa.array(range(len(centres)), pa.int32()), "centre": [c.astype(np.float32).tobytes() for c in centres], "least": least})

    return run


def fit(labelled: DataFrame, text: str = "text", lang: str = "lang", per_language: int = PER_LANGUAGE, clusters: int = CLUSTERS) -> dict:
    """The model: languages, centroids, rejection cosines and idf."""
    rows = labelled.select(F.col(lang).alias("lang"), F.col(text).alias("text")).where("lang is not null and text is not null")
    rows = rows.where(F.col("text").rlike(r"\p{L}"))
    rows = rows.withColumn("place", F.pmod(F.xxhash64("text"), F.lit(1 << 62)))
    # Hashes of distinct texts are counted by their number of bits; texts go on below the least power of two
    # that has ``per_language`` of them, so that what is ranked is bounded and no language goes short.
    bits = rows.select("lang", "place").distinct().groupBy("lang", F.length(F.bin("place")).alias("bits")).count()
    bounds, passed = {}, {}
    for r in sorted(bits.collect()):  # 62 rows a language at most
        if passed.get(r["lang"], 0) < per_language:
            bounds[r["lang"]] = 1 << r["bits"]
            passed[r["lang"]] = passed.get(r["lang"], 0) + r["count"]
    below = F.create_map(*[c for lang, bound in bounds.items() for c in (F.lit(lang), F.lit(bound).cast("long"))])[F.col("lang")] if bounds else F.lit(0)
    texts = rows.where(F.col("place") < below).groupBy("lang", "place", "text").agg(F.count("*").alias("copies"))
    order = Window.partitionBy("lang").orderBy("place", "text")
    sample = texts.withColumn("nth", F.row_number().over(order).cast("long")).where(F.col("nth") <= per_language).select("lang", "nth", "copies", "text")
    sample = stored(sample.mapInArrow(_sampled, "lang string, nth long, copies long, counts binary"), "language-sample")
    n, df = 0, np.zeros(SIZE)
    for row in sample.groupBy("lang").applyInArrow(_frequencies(per_language), "lang string, n long, df binary").collect():
        n, df = n + row["n"], df + np.frombuffer(row["df"], np.int64)
    idf = (np.log((1 + n) / (1 + df)) + 0.1).astype(np.float32)
    found = sample.groupBy("lang").applyInArrow(_centroids(idf, clusters, per_language), "lang string, nth int, centre binary, least double").collect()
    found.sort(key=lambda r: (r["lang"], r["nth"]))
    centres = np.stack([np.frombuffer(r["centre"], np.float32) for r in found]) if found else np.zeros((0, SIZE), np.float32)
    return {"langs": [r["lang"] for r in found], "centres": centres, "least": np.array([r["least"] for r in found]), "idf": idf}


def predict(docs: DataFrame, model: dict, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``doc_id, lang_pred, score, rejected`` for every row; no shuffle."""
    schema = pa.schema([("doc_id", pa.int64()), ("lang_pred", pa.string()), ("score", pa.float64()), ("rejected", pa.bool_())])
    sent = docs.sparkSession.sparkContext.broadcast(model)  # a few centroids of fixed size per language

    def run(batches):
        model = sent.value
        for batch in batches:
            batch = pa.RecordBatch.from_arrays([batch.column(0), lowered(batch.column(1))], ["doc_id", "text"])
            for rows, data, offsets in steps(iter([batch])):
                for at in range(0, rows.num_rows, 256):
                    part, cut = rows.slice(at, 256), offsets[at : at + 257]
                    lettered = np.array([t is not None and LETTER.search(t) is not None for t in part.column(1).to_pylist()])
                    known = lettered & bool(model["langs"])
                    if model["langs"]:
                        near = vectors(counts_of(data[cut[0] : cut[-1]], cut - cut[0]), model["idf"]) @ model["centres"].T
                        best = np.argmax(near, 1)
                        score = np.clip(near[np.arange(len(near)), best].astype(float), 0, 1)
                        names = [model["langs"][b] if ok else UNKNOWN for b, ok in zip(best, known)]
                        far = score < model["least"][best]
                    else:
                        score, names, far = np.zeros(part.num_rows), [UNKNOWN] * part.num_rows, np.ones(part.num_rows, bool)
                    yield record(schema, part.column(0), names, pa.array(np.where(known, score, 0.0)), pa.array(far | ~known))

    return docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text")).mapInArrow(run, "doc_id long, lang_pred string, score double, rejected boolean")
