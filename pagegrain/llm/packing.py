"""Packing of tokenised documents into sequences by non-negative least squares.

A document is cut into full windows and a remainder. The lengths of the remainders form a histogram of
at most ``window`` numbers, the only thing the solver sees. Shallow combinations (one, two or three
lengths that fill the window exactly) are enumerated; how often to use each is a non-negative least
squares fit of the combinations to the histogram, solved by projected coordinate descent, rounded down
and trimmed to what there is. What the combinations don't use up (the residuals: rounding, and lengths
without enough partners) is laid end to end in order of length and cut at the window's borders, so that
only the last sequence is padded.

Pieces of a length are ranked inside hashed parts of bounded size plus the counts of the parts before,
so a length that a third of all pieces share is spread over many tasks. Which sequence a rank falls
into comes from a small table of capacities (its size depends on the window alone), looked up in each
task. Token ids stay in a stored table of pieces; only residual pieces, which are cut again, meet
their ids in a join.

Defined results: a null or empty text has the closing id only; repeated rows are packed each, as rows
of their own; a null id is an id like any other; an empty table gives an empty result.
"""

from __future__ import annotations

import re
import uuid
import zlib
from array import array
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pagegrain.llm.common import record, stored

WINDOW = 1024
CLOSING = 0
PART = 100_000  # pieces of one length ranked by one task
DEPTH = 3
SWEEPS = 12
CACHE = 600_000
# A single space before a character that is no white space always begins a new word of the tokenizer.
UNSAFE = re.compile(r" (?:\s|\Z)")
BOUNDARY = re.compile(r"(?= \S)")


# Runs of letters, with a space before, are single words of the tokenizer; so are cuts around them, except
# beside letters outside LATIN, with which they are one word and stay in one run.
LATIN = "A-Za-zÀ-ÖØ-öø-ɏ"
OTHER = rf"[^\W\d_{LATIN}]"  # all other letters, and numbers that are no digits
RUNS = re.compile(rf" ?[{LATIN}]++(?!{OTHER})| ?(?:[^{LATIN} ]++|(?<={OTHER})[{LATIN}]++|[{LATIN}]++(?={OTHER}))+| ")
LETTERS = re.compile(rf" ?[{LATIN}]+")
JOINED = re.compile(r"'|\s\s")  # contractions, and white space whose cut depends on what follows
# Byte-level tokenizers write printable bytes as themselves and the others from U+0100 on.
PRINTABLE = [*range(33, 127), *range(161, 173), *range(174, 256)]
BYTE_CHARS = {b: b for b in PRINTABLE} | {b: 256 + i for i, b in enumerate(sorted(set(range(256)) - set(PRINTABLE)))}


class Words(dict):
    """Ids of each run of a text, as bytes; a run is tokenised once while it is held."""

    def __init__(self, tokenizer):
        super().__init__()
        self.tokenizer, self.model = tokenizer, tokenizer.model
        kind = type(tokenizer.pre_tokenizer).__name__
        self.byte_level = kind == "ByteLevel" and not tokenizer.pre_tokenizer.add_prefix_space and tokenizer.normalizer is None

    def encode(self, text: str) -> bytes:
        return array("I", self.tokenizer.encode(text, add_special_tokens=False).ids).tobytes()

    def __missing__(self, run: str) -> bytes:
        if LETTERS.fullmatch(run):
            tokens = self.model.tokenize(run.encode().decode("latin-1").translate(BYTE_CHARS))
            out = array("I", [t.id for t in tokens]).tobytes()
        else:
            out = self.encode(run)
        if len(self) >= CACHE:
            self.clear()
        self[run] = out
        return out

    def runs(self, text: str) -> list[str]:
        """Cuts where the tokenizer always begins a new word."""
        if not JOINED.search(text):
            return RUNS.findall(text)
        pieces = BOUNDARY.split(text) if UNSAFE.search(text) else [w if i == 0 else " " + w for i, w in enumerate(text.split(" "))]
        return [run for p in pieces for run in ([p] if JOINED.search(p) else RUNS.findall(p)) if run]

    def ids(self, text: str | None) -> np.ndarray:
        """The text's ids and the closing id."""
        if not text:
            raw = b""
        elif not self.byte_level or "<|" in text:  # special tokens may span words
            raw = self.encode(text)
        else:
            raw = b"".join([self[run] for run in self.runs(text)])
        return np.frombuffer(raw + np.uint32(CLOSING).tobytes(), "<u4")


def tokenised(docs: DataFrame, tokenizer_path: str, window: int = WINDOW, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``row_id, doc_id, start, length, ids, ids_crc32, doc_tokens``: full windows and remainders of each row; no shuffle."""
    schema = pa.schema([("row_id", pa.int64()), ("doc_id", pa.int64()), ("start", pa.int64()), ("length", pa.int64()), ("ids", pa.binary()), ("ids_crc32", pa.int64()), ("doc_tokens", pa.int64())])

    def run(batches):
        from tokenizers import Tokenizer

        words = Words(Tokenizer.from_file(tokenizer_path))
        number = uuid.uuid4().int >> 65  # rows are numbered from a random start, once, before the table is stored
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                rows = batch.slice(at, 256)
                out: list[tuple] = []
                for doc, value in zip(rows.column(0).to_pylist(), rows.column(1).to_pylist()):
                    number = (number + 1) & (1 << 62) - 1
                    ids = words.ids(value)
                    for start in range(0, len(ids), window):
                        raw = ids[start : start + window].tobytes()
                        out.append((number, doc, start, len(raw) // 4, raw, zlib.crc32(raw), len(ids)))
                yield record(schema, *map(list, zip(*out)))

    narrow = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
    return narrow.mapInArrow(run, "row_id long, doc_id long, start long, length long, ids binary, ids_crc32 long, doc_tokens long")


def combinations(lengths: np.ndarray, window: int, depth: int = DEPTH) -> np.ndarray:
    """All multisets of one to ``depth`` (three at most) of the lengths that add up to the window; 0 fills empty places."""
    there = np.zeros(window + 1, bool)
    there[lengths] = True
    out = [np.array([[window, 0, 0]])] if there[window] else []
    if depth >= 2:
        a = lengths[(lengths * 2 <= window)]
        a = a[there[window - a]]
        out.append(np.stack([window - a, a, np.zeros_like(a)], 1))
    if depth >= 3:
        small, middle = np.meshgrid(lengths, lengths, indexing="ij")
        large = window - small - middle
        ok = (small <= middle) & (middle <= large)
        ok[ok] = there[large[ok]]
        out.append(np.stack([large[ok], middle[ok], small[ok]], 1))
    return np.concatenate([np.zeros((0, 3), int), *out])


def solve(histogram: np.ndarray, window: int, sweeps: int = SWEEPS) -> tuple[np.ndarray, np.ndarray]:
    """Combinations and how often each is used, never more than the histogram (index: length) allows.

    Coordinate descent on ``|A x - h|^2`` with ``x >= 0``: each step solves one combination's repeat
    count exactly against the present residual. It runs over the two-length combinations first, so
    that solutions with few combinations are found first, and rounding loses little.
    """
    combos = combinations(np.flatnonzero(histogram), window)
    rest, x = histogram.astype(float).tolist(), [0.0] * len(combos)
    rows = [tuple(int(v) for v in c if v) for c in combos]
    for _ in range(sweeps):
        moved = 0.0
        for j, parts in enumerate(rows):
            # A column holds the multiplicity of each length; its squared norm follows.
            if len(set(parts)) == len(parts):
                step = sum([rest[p] for p in parts]) / len(parts)
            else:
                norm = sum(parts.count(p) ** 2 for p in set(parts))
                step = sum([rest[p] for p in parts]) / norm
            step = max(step, -x[j])
            if step > 1e-6 or step < -1e-6:
                x[j] += step
                moved += abs(step)
                for p in parts:
                    rest[p] -= step
        if moved < 1e-3 * len(rows):
            break
    left, uses = histogram.astype(int).tolist(), np.zeros(len(rows), int)
    order = sorted(range(len(rows)), key=lambda j: -x[j])
    for rounding in (0.0, 1.0):  # rounded down first; what is left then goes to whole further uses
        for j in order:
            parts = rows[j]
            n = int(x[j]) if not rounding else max(left) and min(left[p] // parts.count(p) for p in parts)
            n = min([n, *(left[p] // parts.count(p) for p in parts)])
            if n > 0:
                uses[j] += n
                for p in parts:
                    left[p] -= n
    used = uses > 0
    return combos[used], uses[used]


class Plan:
    """For each length, capacities in order: the rank a slot begins at, its first sequence and its offset there."""

    def __init__(self, histogram: np.ndarray, window: int):
        combos, uses = solve(histogram, window)
        first = np.concatenate([[0], np.cumsum(uses)])
        self.window, self.sequences = window, int(first[-1])
        slots: dict[int, list[tuple[int, int, int]]] = {}
        used = np.zeros(window + 1, np.int64)
        for parts, n, at in zip(combos, uses, first):
            offset = 0
            for p in parts[parts > 0]:
                slots.setdefault(int(p), []).append((int(used[p]), int(at), offset))
                used[p] += n
                offset += int(p)
        self.used = used
        self.slots = {p: tuple(np.array(c, np.int64) for c in zip(*s)) for p, s in slots.items()}
        # Residual pieces lie end to end in order of falling length.
        rest = (histogram.astype(np.int64) - used) * np.arange(window + 1)
        self.rest_from = np.concatenate([np.cumsum(rest[::-1])[::-1][1:], [0]])

    def place(self, lengths: np.ndarray, ranks: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Sequence and offset; a residual's sequence is -1 and its offset its place among the residuals."""
        sequence, offset = np.full(len(lengths), -1, np.int64), np.zeros(len(lengths), np.int64)
        for p in np.unique(lengths):
            at = np.flatnonzero(lengths == p)
            rank = ranks[at]
            fits = rank < self.used[p]
            if fits.any():
                begins, firsts, offsets = self.slots[int(p)]
                slot = np.searchsorted(begins, rank[fits], "right") - 1
                sequence[at[fits]] = firsts[slot] + rank[fits] - begins[slot]
                offset[at[fits]] = offsets[slot]
            offset[at[~fits]] = self.rest_from[p] + (rank[~fits] - self.used[p]) * p
        return sequence, offset


PLACED = "row_id long, doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


def _placer(plan: Callable[[], Plan]):
    schema = pa.schema([(c.split()[0], pa.int64()) for c in PLACED.split(", ")])

    def run(batches):
        for batch in batches:
            length, rank = (np.asarray(batch.column(batch.schema.get_field_index(c))) for c in ("length", "rank"))
            sequence, offset = plan().place(length, rank)
            yield record(schema, *(batch.column(batch.schema.get_field_index(c)) for c in schema.names[:6]), sequence, offset)

    return run


def _cut(window: int, first_sequence: int):
    """Residual pieces cut at the window's borders."""
    schema = pa.schema([(c.split()[0], pa.int64()) for c in PLACED.split(", ")])

    def run(batches):
        for batch in batches:
            out: list[tuple] = []
            for row, doc, start, tokens, at, raw in zip(*(c.to_pylist() for c in batch.columns)):
                done, total = 0, len(raw) // 4
                while done < total:
                    n = min(total - done, window - (at + done) % window)
                    part = raw[4 * done : 4 * (done + n)]
                    out.append((row, doc, start + done, n, zlib.crc32(part), tokens, first_sequence + (at + done) // window, (at + done) % window))
                    done += n
            yield record(schema, *(map(list, zip(*out)) if out else [[] for _ in schema]))

    return run


def pack(docs: DataFrame, tokenizer_path: str, window: int = WINDOW, doc_id: str = "doc_id", text: str = "text") -> tuple[DataFrame, DataFrame]:
    """(placed pieces, stored table of first-cut pieces with ids): see ``with_ids`` for sequences with their tokens."""
    pieces = stored(tokenised(docs, tokenizer_path, window, doc_id, text), "pieces")
    counts = {r["length"]: r["count"] for r in pieces.groupBy("length").count().collect()}  # at most `window` rows
    histogram = np.zeros(window + 1, np.int64)
    for length, n in counts.items():
        histogram[length] = n
    plan = Plan(histogram, window)
    sent = docs.sparkSession.sparkContext.broadcast(plan)  # its size depends on the window alone

    parts = F.array(*[F.lit(max(1, -(-int(n) // PART))) for n in histogram])
    narrow = pieces.select("row_id", "doc_id", "start", "length", "ids_crc32", "doc_tokens")
    narrow = narrow.withColumn("part", F.pmod(F.xxhash64("row_id", "start"), F.get(parts, F.col("length").cast("int"))))
    before = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    sizes = narrow.groupBy("length", "part").agg(F.count("*").alias("n"))
    sizes = sizes.select("length", "part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("earlier"))
    ranked = narrow.withColumn("nth", F.row_number().over(Window.partitionBy("length", "part").orderBy("row_id", "start")))
    ranked = ranked.join(sizes, ["length", "part"]).withColumn("rank", F.col("earlier") + F.col("nth") - 1)
    placed = stored(ranked.mapInArrow(_placer(lambda: sent.value), PLACED), "placed")

    ids = pieces.where(F.col("length") < window).select("row_id", "start", "ids")
    rest = placed.where("sequence_id < 0").select("row_id", "doc_id", "start", "doc_tokens", "offset").join(ids, ["row_id", "start"])
    rest = rest.select("row_id", "doc_id", "start", "doc_tokens", "offset", "ids").mapInArrow(_cut(window, plan.sequences), PLACED)
    return placed.where("sequence_id >= 0").unionByName(rest), pieces


def with_ids(placed: DataFrame, pieces: DataFrame, window: int = WINDOW) -> DataFrame:
    """Placed pieces with their own token ids, as an array."""
    raw = pieces.select("row_id", (F.col("start") / window).cast("long").alias("nth"), F.col("start").alias("first"), "ids")
    joined = placed.withColumn("nth", (F.col("start") / window).cast("long")).join(raw, ["row_id", "nth"])

    @F.pandas_udf("array<long>")
    def cut(ids, skip, length):
        return ids.combine(skip, lambda raw, n: np.frombuffer(raw, "<u4")[n:]).combine(length, lambda x, n: x[:n].astype(np.int64))

    return joined.withColumn("ids", cut("ids", F.col("start") - F.col("first"), "length")).drop("nth", "first")
