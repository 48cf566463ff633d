"""Benchmark decontamination: every training passage queries a BM25 index of the test items.

The index holds the items' terms with BM25 impacts (Spark counts terms, document frequencies and
lengths), each divided by the score the item gives itself, so that one threshold fits all items. Items
are grouped into blocks of ``BLOCK`` with the greatest impact of each term in each block.

A passage is two neighbouring chunks of a document's words, so every stretch of up to a chunk's length
lies within one passage; a chunk is an item's length rounded up to a power of two, ``CHUNK`` words at
least, so a shard has an index per such class and other items don't widen an item's passages. Chunks sum
the block maxima of their distinct terms: a passage whose sums stay below the threshold in every block
is done. The others run block-max WAND over the postings: cursors move by item, the pivot is the first
item that the terms' maxima let reach the threshold, and a block whose own maxima can't is skipped
whole. All items at or above the threshold are retrieved. A retrieved item counts if enough of its
question's and of its answer's word trigrams stand in the passage; an item under about six words must stand
there as a whole.

The index is cut into shards of about ``SHARD_TERMS`` postings; each is read to the driver, broadcast
and held against the corpus in turn, so that what is broadcast is bounded. Documents aren't shuffled.

Defined results: null and empty texts and items match nothing; items without words are left out; equal
items match each under their own id; repeated rows give equal rows once; a null document id is left out
of the pairs (a filter still judges the row); empty tables give an empty result.
"""

from __future__ import annotations

import re
from bisect import bisect_left

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagegrain.llm.common import record, stored

K1, B = 1.2, 0.75
THRESHOLD = 0.6  # share of an item's own score
OVERLAP = 0.6  # share of question's and of answer's trigrams
CHUNK = 64
BLOCK = 4  # items in a block, more if the block maxima of a shard would fill over MAXIMA numbers
MAXIMA = 16 << 20
SHARD_TERMS = 50_000
WORD = re.compile(r"\w+")


def words_of(text: str | None) -> list[str]:
    return WORD.findall(text.lower()) if text else []


def question_and_answer(text: str) -> tuple[list[str], list[str]]:
    """Cut at the first question mark, else at the last line, else at the last sentence; halves if a part is too short."""
    whole = words_of(text)
    for cut in (text.find("?") + 1, text.rstrip().rfind("\n"), text.rstrip(" .!\n").rfind(". ")):
        if cut > 0:
            question, answer = words_of(text[:cut]), words_of(text[cut:])
            if min(len(question), len(answer)) >= 3:
                return question, answer
    half = (len(whole) + 1) // 2
    return whole[:half], whole[half:]


def grams(words: list[str], size: int = 3) -> set:
    return {tuple(words[i : i + size]) for i in range(len(words) - size + 1)}


def parts_of(text: str) -> tuple[int, set, set]:
    """Gram size and the grams of question and answer; an item too short for both is one gram as a whole."""
    question, answer = question_and_answer(text)
    if min(len(question), len(answer)) < 3:
        whole = words_of(text)
        return len(whole), grams(whole, len(whole)), grams(whole, len(whole))
    return 3, grams(question), grams(answer)


def chunk_of(length: int) -> int:
    """Words in a chunk for an item of ``length`` words."""
    return max(CHUNK, 1 << (length - 1).bit_length())


class Index:
    """Postings of one shard and class, in order of item, with block maxima."""

    def __init__(self, postings: list[tuple], items: list[tuple], n: int, average: float, maxima: int | None = None):
        """postings: (item, term, tf, df, length); items: (item, text)."""
        self.items = [i for i, _ in sorted(items)]
        self.parts = [parts_of(t) for _, t in sorted(items)]
        number = {i: k for k, i in enumerate(self.items)}
        self.terms = {t: k for k, t in enumerate(sorted({p[1] for p in postings}))}
        item = np.array([number[p[0]] for p in postings], np.int64)
        term = np.array([self.terms[p[1]] for p in postings], np.int64)
        tf, df, length = (np.array([p[c] for p in postings], float) for c in (2, 3, 4))
        impact = np.log(1 + (n - df + 0.5) / (df + 0.5)) * tf * (K1 + 1) / (tf + K1 * (1 - B + B * length / average))
        impact /= np.bincount(item, impact, len(self.items))[item]
        order = np.lexsort((item, term))
        self.item, self.impact = item[order].tolist(), impact[order].tolist()
        self.first = np.searchsorted(term[order], np.arange(len(self.terms) + 1)).tolist()
        self.block = max(BLOCK, -(-len(self.items) * len(self.terms) // (maxima or MAXIMA)))
        blocks = -(-len(self.items) // self.block)
        self.block_max = np.zeros((len(self.terms) + 1, blocks), np.float32)  # the last row: words that no item has
        np.maximum.at(self.block_max, (term, item // self.block), np.nextafter(impact.astype(np.float32), np.float32(2)))
        self.top = self.block_max.max(1).astype(float).tolist()
        self.chunk = chunk_of(int(length.max())) if len(length) else CHUNK

    def retrieve(self, terms: np.ndarray, threshold: float) -> list[tuple[int, float]]:
        """Block-max WAND: (item number, score) of all items that score at least the threshold."""
        item, impact, first, block = self.item, self.impact, self.first, self.block
        cursors = [[item[first[t]], first[t], first[t + 1], t] for t in terms.tolist()]
        top = self.top
        found, end = [], len(self.items)
        threshold -= 1e-6
        while cursors:
            cursors.sort()
            total, pivot = 0.0, -1
            for k, c in enumerate(cursors):
                total += top[c[3]]
                if total >= threshold:
                    pivot = k
                    break
            if pivot < 0:
                break
            at = cursors[pivot][0]
            while pivot + 1 < len(cursors) and cursors[pivot + 1][0] == at:
                pivot += 1
            ahead = cursors[: pivot + 1]
            if float(self.block_max[[c[3] for c in ahead], at // block].sum(dtype=np.float64)) >= threshold:
                if ahead[0][0] == at:
                    score = sum(impact[c[1]] for c in ahead)
                    if score >= threshold:
                        found.append((at, score))
                    to = at + 1
                else:
                    to = at
            else:  # nothing in this block, up to where a further term begins
                to = min((at // block + 1) * block, cursors[pivot + 1][0] if pivot + 1 < len(cursors) else end)
                to = max(to, at + 1)
            for c in ahead:
                if c[0] < to:
                    c[1] = bisect_left(item, to, c[1], c[2])
                    c[0] = item[c[1]] if c[1] < c[2] else end
            cursors = [c for c in cursors if c[0] < end]
        return found

    def matches(self, words: list[str], threshold: float, overlap: float) -> dict[int, list]:
        """item number: [passages, best score, question overlap, answer overlap] of a whole text."""
        unknown, get = len(self.terms), self.terms.get
        numbers = np.array([get(w, -1) for w in words], np.int64)
        at = np.flatnonzero(numbers >= 0)
        out: dict[int, list] = {}
        if not len(at):
            return out
        keys = np.unique(at // self.chunk * unknown + numbers[at])
        chunk, term = keys // unknown, keys % unknown
        starts = np.flatnonzero(np.concatenate([[True], chunk[1:] != chunk[:-1]]))
        chunks = -(-len(words) // self.chunk)
        sums = np.zeros((chunks + 1, self.block_max.shape[1]))
        sums[chunk[starts]] = np.add.reduceat(self.block_max[term], starts, axis=0, dtype=np.float64)
        bounds = (sums[:-1] + sums[1:]).max(1)
        edges = np.searchsorted(chunk, np.arange(chunks + 2))
        for i in np.flatnonzero(bounds >= threshold - 1e-6):
            if chunks > 1 and i == chunks - 1:
                continue  # its words are the end of the passage before
            distinct = np.unique(term[edges[i] : edges[min(i + 2, chunks)]])
            passage: dict[int, set] = {}
            if self.block_max[distinct].sum(0, dtype=np.float64).max() < threshold - 1e-6:
                continue  # terms of both chunks had counted twice
            for k, score in self.retrieve(distinct, threshold):
                size, *both = self.parts[k]
                if size not in passage:
                    passage[size] = grams(words[i * self.chunk : (i + 2) * self.chunk], size)
                shares = [len(part & passage[size]) / len(part) for part in both]
                if min(shares) >= overlap:
                    seen = out.setdefault(k, [0, 0.0, 0.0, 0.0])
                    seen[0] += 1
                    seen[1:] = max(seen[1:], [min(1.0, score), *shares])
        return out


class Shard:
    """The indexes of a shard, one for each class of length."""

    def __init__(self, postings: list[tuple], items: list[tuple], n: int, average: float):
        """postings: (item, term, tf, df, length); items: (item, id, text)."""
        classes: dict[int, list] = {}
        for p in postings:
            classes.setdefault(chunk_of(p[4]), []).append(p)
        self.indexes = []
        for chunk in sorted(classes):
            there = {p[0] for p in classes[chunk]}
            index = Index(classes[chunk], [(i, t) for i, _, t in items if i in there], n, average, max(1, MAXIMA // len(classes)))
            ids = {i: own for i, own, _ in items if i in there}
            index.items = [ids[i] for i in index.items]
            self.indexes.append(index)

    def matches(self, text: str | None, threshold: float, overlap: float) -> dict[int, list]:
        """id: [passages, best score, question overlap, answer overlap]; the most and best of an id's texts."""
        words, out = words_of(text), {}
        for index in self.indexes:
            for k, (passages, *best) in index.matches(words, threshold, overlap).items():
                seen = out.setdefault(index.items[k], [0, 0.0, 0.0, 0.0])
                seen[:] = max(seen[0], passages), *max(seen[1:], best)
        return out


def _postings(batches):
    schema = pa.schema([("item", pa.int64()), ("term", pa.string()), ("tf", pa.int64()), ("length", pa.int64())])
    for batch in batches:
        out = []
        for item, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            counts: dict[str, int] = {}
            words = words_of(text)
            for w in words:
                counts[w] = counts.get(w, 0) + 1
            out += [(item, w, n, len(words)) for w, n in counts.items()]
        yield record(schema, *(map(list, zip(*out)) if out else [[] for _ in schema]))


def indexes(items: DataFrame, item_id: str = "item_id", text: str = "text"):
    """The shards of the index, one at a time; repeated rows count once, and an id's texts apart."""
    rows = items.select(F.col(item_id).cast("long").alias("id"), F.col(text).cast("string").alias("text")).where("id is not null and text is not null").distinct()
    rows = stored(rows.select(F.monotonically_increasing_id().alias("item"), "id", "text"), "items")
    postings = rows.select("item", "text").mapInArrow(_postings, "item long, term string, tf long, length long")
    postings = stored(postings, "postings")
    total = postings.agg(F.count("*").alias("terms"), F.sum("tf").alias("words"), F.count_distinct("item").alias("n")).first()
    if not total["n"]:
        return
    shards = -(-total["terms"] // SHARD_TERMS)
    df = postings.groupBy("term").agg(F.count("*").alias("df"))
    postings = postings.join(df, "term").select("item", "term", "tf", "df", "length", F.pmod(F.xxhash64("item"), F.lit(shards)).alias("shard"))
    postings = stored(postings, "postings")
    for shard in range(shards):
        own = [tuple(r)[:5] for r in postings.where(F.col("shard") == shard).collect()]
        if own:
            texts = rows.where(F.pmod(F.xxhash64("item"), F.lit(shards)) == shard).collect()
            yield Shard(own, [(r["item"], r["id"], r["text"]) for r in texts], total["n"], total["words"] / total["n"])


def contaminated_pairs(docs: DataFrame, items: DataFrame, threshold: float = THRESHOLD, overlap: float = OVERLAP, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "text") -> DataFrame:
    """``doc_id, item_id, n_passages, score, question_overlap, answer_overlap`` of each document and item that match."""
    schema = pa.schema([("doc_id", pa.int64()), ("item_id", pa.int64()), ("n_passages", pa.int64()), ("score", pa.float64()), ("question_overlap", pa.float64()), ("answer_overlap", pa.float64())])
    ddl = "doc_id long, item_id long, n_passages long, score double, question_overlap double, answer_overlap double"
    narrow = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text")).where("doc_id is not null")
    spark = docs.sparkSession
    found = spark.createDataFrame([], ddl)
    for index in indexes(items, item_id, item_text):
        sent = spark.sparkContext.broadcast(index)

        def run(batches, sent=sent):
            index = sent.value
            for batch in batches:
                for at in range(0, batch.num_rows, 512):
                    out = [(d, i, *m) for d, t in zip(*(batch.slice(at, 512).column(c).to_pylist() for c in (0, 1))) for i, m in index.matches(t, threshold, overlap).items()]
                    yield record(schema, *(map(list, zip(*out)) if out else [[] for _ in schema]))

        found = found.unionByName(narrow.mapInArrow(run, ddl))
    # Repeated rows and ids meet in one pair.
    best = F.max(F.struct("score", "question_overlap", "answer_overlap")).alias("best")
    return found.groupBy("doc_id", "item_id").agg(F.max("n_passages").alias("n_passages"), best).select("doc_id", "item_id", "n_passages", "best.*")


def keep_uncontaminated(docs: DataFrame, items: DataFrame, threshold: float = THRESHOLD, overlap: float = OVERLAP, text: str = "text") -> DataFrame:
    """The rows, with all their columns, that match no item; no shuffle."""
    for index in indexes(items):
        sent = docs.sparkSession.sparkContext.broadcast(index)

        @F.pandas_udf("boolean")
        def clean(texts, sent=sent):
            return pd.Series([not sent.value.matches(t, threshold, overlap) for t in texts], dtype=bool)

        docs = docs.where(clean(F.col(text)))
    return docs
