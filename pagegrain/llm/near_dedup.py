"""Near-duplicates by SetSketch registers: banded candidates, joint estimate, check on the full sets.

A document is its set of five-word shingles. Its sketch has 128 registers; each holds the truncated
minimum of exponentially distributed hash values on a scale of powers of ``BASE``, so that sketches of
parts merge by the larger register, and equal registers tell of similar sets. Points are drawn in
rising order per shingle and stop where no register can still change, so the work is about the set's size.

1. Documents with equal sets are one class; only its smallest id goes on.
2. Registers are cut into 32 bands of four; classes with an equal band meet in a bucket. Every member
   is paired with the smallest id of all its buckets, then with the smallest of each bucket whose
   component is still another.
3. A pair whose similarity, estimated jointly from both sketches by maximum likelihood, is within six
   standard errors of the limit or above it is checked on the full sets. Links give components.
4. Buckets whose members lie in several components may hold links between members other than the
   smallest. Such buckets are cut into blocks, and block pairs compare sketches across components in
   bounded groups. A group of edited copies may hold very many pairs at 0.5 to 0.7, which no sketch of this
   length tells from the limit, so each set also has a parity bitmap: the bits in which two of them differ
   are at most the shingles in which the sets differ, so a pair with too many is no link for certain. Only
   pairs that pass the estimate and this bound leave the task, and are checked on the full sets.

So every pair with a common band is either checked or already in one component. At the limit of 0.75 a
pair has no common band with a chance of 5e-6, less above it.

Defined results: null texts, and texts without words, have an empty set and link with nothing; a null
id has no component and is kept; rows that repeat an id count as one document; an empty table gives an
empty result. Shingles are compared by 64-bit hashes.
"""

from __future__ import annotations

from hashlib import blake2b

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagegrain.llm.common import record, steps, stored
from pagegrain.llm.components import components
from pagegrain.llm.hashing import mix
from pagegrain.llm.shingles import shingle_sets

REGISTERS = 128
BAND = 4
BASE = 1.001
RATE = 20.0
LIMIT = 75  # per cent
MARGIN = 0.25  # six standard errors of an estimate near the limit
BLOCK = 512
PAIRS = 16384  # pairs estimated at once
SALT = 256  # partners that share one copy of a set
LEAST_BITS, MOST_BITS = 256, 1 << 14  # width of a parity bitmap
CHECKED_ROWS = 256  # full sets taken from a batch at once


def sketches(sets: list[np.ndarray], m: int = REGISTERS) -> np.ndarray:
    """Registers of each set, one row per set; empty sets have zeros."""
    out = np.zeros((len(sets), m), np.uint16)
    todo, reach = [i for i, s in enumerate(sets) if len(s)], np.log(m) + 10
    while todo:
        size = np.array([len(sets[i]) for i in todo])
        elements = mix(np.concatenate([sets[i] for i in todo]))
        row = np.repeat(np.arange(len(todo)), size)
        least = np.full(len(todo) * m, np.inf)
        last = (reach / (RATE * size))[row]
        # A random walk over the registers of its own for each shingle: start and odd step.
        start, step = (elements >> np.uint64(7)).astype(np.int64), (elements >> np.uint64(20)).astype(np.int64) | 1
        x = np.zeros(len(elements))
        for j in range(m):
            u = (mix(elements + np.uint64((j + 1) * 0x9E3779B97F4A7C15 & (1 << 64) - 1)) >> np.uint64(11)).astype(np.float64) + 1
            x = x - np.log(u * 2.0**-53) / (RATE * (m - j))
            on = x <= last
            if not on.all():
                elements, row, last, start, step, x = elements[on], row[on], last[on], start[on], step[on], x[on]
            if not len(x):
                break
            np.minimum.at(least, row * m + ((start + j * step) & (m - 1)), x)
        least = least.reshape(len(todo), m)
        full = np.isfinite(least).all(1)
        done = [i for i, ok in zip(todo, full) if ok]
        out[done] = np.clip(np.floor(1 - np.log(least[full]) / np.log(BASE)), 0, 65535).astype(np.uint16)
        todo, reach = [i for i, ok in zip(todo, full) if not ok], reach * 2
    return out


def band_keys(registers: np.ndarray) -> np.ndarray:
    """One 64-bit key for each band of each row."""
    packed = np.ascontiguousarray(registers).view(np.uint64).reshape(len(registers), -1)
    return mix(packed + (np.arange(packed.shape[1], dtype=np.uint64) + np.uint64(1)) * np.uint64(0xA0761D6478BD642F)).view(np.int64)


def parity_bits(shingles: np.ndarray) -> bytes:
    """A bitmap about four times as wide as the set is large: bit i is the parity of the shingles that fall on i.

    Bitmaps of two widths compare after the wider one is folded in half by XOR.
    """
    width = min(MOST_BITS, max(LEAST_BITS, 1 << (4 * len(shingles) - 1).bit_length())) if len(shingles) else LEAST_BITS
    at = (mix(shingles ^ np.uint64(0x8CB92BA72F3D8DD7)) & np.uint64(width - 1)).astype(np.int64)
    return np.packbits((np.bincount(at, minlength=width) & 1).astype(np.uint8)).tobytes()


class Parities:
    """The parity bitmaps of a block's rows, kept per width, the wider ones folded on first use."""

    def __init__(self, bitmaps: list[bytes]):
        self.bitmaps = bitmaps
        self.width = np.array([len(b) for b in bitmaps], np.int64)
        self.tables: dict[int, tuple[np.ndarray, np.ndarray]] = {}

    def _table(self, width: int) -> tuple[np.ndarray, np.ndarray]:
        if width not in self.tables:
            place = np.full(len(self.bitmaps), -1)
            # Sizes that allow a link differ by a third at most, so widths by one step.
            rows = []
            for at in np.flatnonzero((self.width == width) | (self.width == 2 * width)):
                bits = np.frombuffer(self.bitmaps[at], np.uint64)
                place[at] = len(rows)
                rows.append(bits if len(bits) * 8 == width else bits[: len(bits) // 2] ^ bits[len(bits) // 2 :])
            self.tables[width] = place, np.stack(rows)
        return self.tables[width]

    def allow(self, x: np.ndarray, y: np.ndarray, n: np.ndarray) -> np.ndarray:
        """Whether the rows' sets may reach the limit. At the limit they differ in (100 - LIMIT) / (100 + LIMIT) of their sizes' sum."""
        out = np.zeros(len(x), bool)
        width = np.minimum(self.width[x], self.width[y])
        for w in np.unique(width):
            place, bits = self._table(int(w))
            of = np.flatnonzero(width == w)
            # Some 4 MB of bitmaps at once.
            for part in np.array_split(of, max(1, len(of) * int(w) >> 22)):
                u, v = x[part], y[part]
                differ = np.bitwise_count(bits[place[u]] ^ bits[place[v]]).sum(1, dtype=np.int64)
                out[part] = differ * (100 + LIMIT) <= (n[u] + n[v]) * (100 - LIMIT)
        return out


def joint_estimate(k1: np.ndarray, k2: np.ndarray, n1: np.ndarray, n2: np.ndarray) -> np.ndarray:
    """Jaccard similarity of each pair of rows by maximum likelihood, given both set sizes."""
    larger, smaller = (k1 > k2).sum(1), (k1 < k2).sum(1)
    equal = k1.shape[1] - larger - smaller
    u = n1 / (n1 + n2)
    v = 1 - u
    most = np.minimum(u / v, v / u)
    share = lambda x: np.maximum(-np.log1p(-np.clip(x, 0, 1) * (BASE - 1) / BASE) / np.log(BASE), 1e-12)
    best, top = np.zeros(len(u)), np.full(len(u), -np.inf)
    for part in np.linspace(0, 1, 101):
        j = most * part
        p, q = share(u - v * j), share(v - u * j)
        value = larger * np.log(p) + smaller * np.log(q) + equal * np.log(np.maximum(1 - p - q, 1e-12))
        better = value > top
        best, top = np.where(better, j, best), np.where(better, value, top)
    return best


def _likely(k1, k2, n1, n2) -> np.ndarray:
    """Whether the sizes allow a link and the estimate is near or above the limit."""
    allowed = 100 * np.minimum(n1, n2) >= LIMIT * np.maximum(n1, n2)
    out = np.zeros(len(n1), bool)
    at = np.flatnonzero(allowed)
    for i in range(0, len(at), 8192):
        part = at[i : i + 8192]
        out[part] = joint_estimate(k1[part], k2[part], n1[part], n2[part]) >= LIMIT / 100 - MARGIN
    return out


def sketch_documents(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``doc_id, n, digest, sketch`` of every row; no shuffle."""
    schema = pa.schema([("doc_id", pa.int64()), ("n", pa.int64()), ("digest", pa.binary()), ("sketch", pa.binary())])

    def run(batches):
        for batch in batches:
            for rows, data, offsets in steps(iter([batch])):
                sets = shingle_sets(data, offsets)
                digests = [blake2b(s.tobytes(), digest_size=16).digest() if len(s) else None for s in sets]
                yield record(schema, rows.column(0), [len(s) for s in sets], digests, [k.tobytes() for k in sketches(sets)])

    narrow = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
    return narrow.mapInArrow(run, "doc_id long, n long, digest binary, sketch binary")


def _sets(docs: DataFrame, wanted: DataFrame, doc_id: str, text: str) -> DataFrame:
    """``id, set, bits``: the full sets of the wanted ids and their parity bitmaps."""
    schema = pa.schema([("id", pa.int64()), ("set", pa.binary()), ("bits", pa.binary())])

    def run(batches):
        for batch in batches:
            for rows, data, offsets in steps(iter([batch])):
                sets = shingle_sets(data, offsets)
                yield record(schema, rows.column(0), [s.tobytes() for s in sets], [parity_bits(s) for s in sets])

    narrow = docs.select(F.col(doc_id).cast("long").alias("id"), F.col(text).cast("string").alias("text"))
    # The same plan at every size: a merge join, whether or not the ids would fit a broadcast.
    return narrow.join(wanted.select("id").hint("merge"), "id", "left_semi").mapInArrow(run, "id long, set binary, bits binary")


def _matrix(column: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint16).reshape(len(column), -1)


def _estimated(batches):
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64())])
    for batch in batches:
        for at in range(0, batch.num_rows, 4096):
            r = batch.slice(at, 4096)
            ok = _likely(_matrix(r.column(2)), _matrix(r.column(4)), np.asarray(r.column(3)), np.asarray(r.column(5)))
            yield record(schema, np.asarray(r.column(0))[ok], np.asarray(r.column(1))[ok])


def likely_pairs(pairs: DataFrame, classes: DataFrame) -> DataFrame:
    """The pairs (``a``, ``b``) of class ids whose joint estimate is near or above the limit."""
    own = classes.select("id", "sketch", "n")
    both = pairs.join(own.toDF("a", "sketch_a", "n_a"), "a").join(own.toDF("b", "sketch_b", "n_b"), "b")
    return both.select("a", "b", "sketch_a", "n_a", "sketch_b", "n_b").mapInArrow(_estimated, "a long, b long")


def _checked(batches):
    """Rows come sorted by (a, salt, partner): the set of ``a`` first, then those of its partners."""
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64())])
    key, held = None, None
    for batch in (batch.slice(at, CHECKED_ROWS) for batch in batches for at in range(0, batch.num_rows, CHECKED_ROWS)):
        links = []
        for a, salt, b, own in zip(*(batch.column(i).to_pylist() for i in range(4))):
            if b is None:
                key, held = (a, salt), np.frombuffer(own, np.uint64)
            elif (a, salt) == key:
                other = np.frombuffer(own, np.uint64)
                if len(held) and len(other):
                    at = np.minimum(np.searchsorted(held, other), len(held) - 1)
                    common = int((held[at] == other).sum())
                    if 100 * common >= LIMIT * (len(held) + len(other) - common):
                        links.append((a, b))
        yield record(schema, [a for a, _ in links], [b for _, b in links])


def linked_pairs(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The pairs whose full sets reach the limit. A set moves once for each of its partners' groups."""
    many = pairs.groupBy("a").agg(F.ceil(F.count("*") / SALT).alias("salts"))
    salted = pairs.join(many, "a").select("a", F.pmod(F.xxhash64("b"), F.col("salts")).alias("salt"), "b")
    partner = salted.join(sets.select(F.col("id").alias("b"), "set"), "b").select("a", "salt", "b", "set")
    centre = salted.select("a", "salt").distinct().join(sets.select(F.col("id").alias("a"), "set"), "a").select("a", "salt", F.lit(None).cast("long").alias("b"), "set")
    rows = centre.unionByName(partner).repartition("a", "salt").sortWithinPartitions("a", "salt", F.col("b").asc_nulls_first())
    return rows.mapInArrow(_checked, "a long, b long")


def _across(table: pa.Table, starts: np.ndarray):
    """(a, b) of likely pairs within the groups of rows that begin at ``starts``, from different components."""
    i, j, ids, component, n, block = (np.asarray(table[c]) for c in ("i", "j", "id", "component", "n", "block"))
    k = _matrix(table["sketch"].combine_chunks())
    parities = Parities(table["bits"].to_pylist())
    held: list[tuple[np.ndarray, np.ndarray]] = []

    def likely():
        x, y = (np.concatenate(c) for c in zip(*held))
        held.clear()
        keep = (100 * n[y] >= LIMIT * n[x]) & (100 * n[x] >= LIMIT * n[y])
        x, y = x[keep], y[keep]
        for at in range(0, len(x), PAIRS):
            u, v = x[at : at + PAIRS], y[at : at + PAIRS]
            near = (k[u] == k[v]).sum(1) >= k.shape[1] * (LIMIT / 100 - MARGIN)
            u, v = u[near], v[near]
            near = parities.allow(u, v, n)
            u, v = u[near], v[near]
            ok = _likely(k[u], k[v], n[u], n[v])
            yield np.minimum(ids[u], ids[v])[ok], np.maximum(ids[u], ids[v])[ok]

    for start, end in zip(starts, [*starts[1:], len(ids)]):
        if i[start] == j[start]:
            x, y = (c + start for c in np.triu_indices(end - start, 1))
        else:
            of = block[start:end]
            x, y = (c.ravel() + start for c in np.meshgrid(np.flatnonzero(of == i[start]), np.flatnonzero(of == j[start])))
        other = component[x] != component[y]
        held.append((x[other], y[other]))
        if sum(len(c) for c, _ in held) >= PAIRS:
            yield from likely()
    if held:
        yield from likely()


def _block_pairs(batches):
    """Rows come sorted by (key, i, j); groups of such rows are bounded, and the last of a batch waits for the next."""
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64())])
    waiting = None
    for batch in batches:
        rows = pa.Table.from_batches([batch])
        rows = rows if waiting is None else pa.concat_tables([waiting, rows])
        if not rows.num_rows:
            continue
        key, i, j = (np.asarray(rows[c]) for c in ("key", "i", "j"))
        starts = np.flatnonzero(np.concatenate([[True], (key[1:] != key[:-1]) | (i[1:] != i[:-1]) | (j[1:] != j[:-1])]))
        waiting = rows.slice(int(starts[-1]))
        if len(starts) > 1:
            for a, b in _across(rows.slice(0, int(starts[-1])), starts[:-1]):
                yield record(schema, a, b)
    if waiting is not None:
        for a, b in _across(waiting, np.zeros(1, np.int64)):
            yield record(schema, a, b)


def _mixed_pairs(members: DataFrame, found: DataFrame, classes: DataFrame, sets: DataFrame) -> DataFrame:
    """Likely pairs of different components within a bucket."""
    known = members.join(found, "id", "left").select("key", "id", F.coalesce("component", "id").alias("component"))
    mixed = known.groupBy("key").agg(F.count("*").alias("members"), F.min("component").alias("low"), F.max("component").alias("high"))
    mixed = mixed.where("low <> high").select("key", F.ceil(F.col("members") / BLOCK).alias("blocks"))
    rows = known.join(mixed, "key").withColumn("block", F.pmod(F.xxhash64("id"), F.col("blocks")))
    rows = rows.withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))
    rows = rows.join(classes.select("id", "n", "sketch").join(sets.select("id", "bits"), "id"), "id")
    rows = rows.select("key", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), "id", "component", "n", "sketch", "bits", "block")
    # Work grows with pairs, not bytes, so the number of tasks isn't left to the rows' size.
    tasks = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = rows.repartition(tasks, "key", "i", "j").sortWithinPartitions("key", "i", "j")
    return rows.mapInArrow(_block_pairs, "a long, b long").distinct()


def near_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``doc_id, n_shingles, component_id, kept`` of every row."""
    own = stored(sketch_documents(docs, doc_id, text), "sketches")
    classes = own.where("doc_id is not null and n > 0").groupBy("digest")
    classes = stored(classes.agg(F.min("doc_id").alias("id"), F.first("n").alias("n"), F.first("sketch").alias("sketch")), "classes")

    def banded(batches):
        schema = pa.schema([("key", pa.int64()), ("id", pa.int64())])
        for batch in batches:
            for at in range(0, batch.num_rows, 4096):
                r = batch.slice(at, 4096)
                keys = band_keys(_matrix(r.column(1)))
                yield record(schema, keys.ravel(), np.repeat(np.asarray(r.column(0)), keys.shape[1]))

    bands = classes.select("id", "sketch").mapInArrow(banded, "key long, id long")
    buckets = bands.groupBy("key").agg(F.min("id").alias("least"), F.max("id").alias("most")).where("least <> most")
    members = stored(bands.join(buckets.select("key", "least"), "key").select("key", "id", "least"), "members")

    sets = stored(_sets(docs, members.select("id").distinct(), doc_id, text), "sets")
    centred = stored(members.where("id <> least").select(F.col("least").alias("a"), F.col("id").alias("b")).distinct(), "centred")
    # Each class first meets the smallest id of all its buckets, then those of other components.
    nearest = centred.groupBy("b").agg(F.min("a").alias("a")).select("a", "b")
    tested = stored(likely_pairs(nearest, classes), "pairs")
    links = stored(linked_pairs(tested, sets), "linked")
    found = stored(components(links), "components")
    of = lambda end: found.select(F.col("id").alias(end), F.col("component").alias(f"of_{end}"))
    apart = centred.join(of("a"), "a", "left").join(of("b"), "b", "left").where(F.coalesce("of_a", "a") != F.coalesce("of_b", "b"))
    again = stored(likely_pairs(apart.select("a", "b").join(nearest, ["a", "b"], "left_anti"), classes), "pairs")
    links = stored(links.unionByName(linked_pairs(again, sets)), "linked")
    found, tested = stored(components(links), "components"), tested.unionByName(again)
    more = stored(_mixed_pairs(members.select("key", "id"), found, classes, sets).join(tested, ["a", "b"], "left_anti"), "more-pairs")
    links = links.unionByName(linked_pairs(more, sets))
    found = stored(components(links), "components")

    named = classes.select("digest", "id").join(found, "id", "left").select("digest", F.coalesce("component", "id").alias("component"))
    out = own.select("doc_id", "n", "digest").join(named, "digest", "left")
    component = F.when(F.col("doc_id").isNotNull(), F.coalesce("component", "doc_id"))
    return out.select("doc_id", F.col("n").alias("n_shingles"), component.alias("component_id"), F.coalesce(component == F.col("doc_id"), F.lit(True)).alias("kept"))


def keep_one(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows, with all their columns, that are the smallest id of their component."""
    dropped = near_duplicates(docs, doc_id, text).where("not kept").select(F.col("doc_id").alias("_dropped")).distinct()
    return docs.join(dropped, docs[doc_id] == dropped["_dropped"], "left_anti")
