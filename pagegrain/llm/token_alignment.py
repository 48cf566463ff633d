"""Alignment of two tokenizers over a corpus, with corpus-wide counts of aligned pairs of ids.

A text's tokens of both kinds are byte ranges of the same bytes. Offsets where a token of either kind ends
cut them into groups; two tokens that end there are linked. One of two linked tokens is a suffix of the
other, so the pairs of ids that can ever be linked are counted by the vocabularies (``possible_pairs``),
whatever the corpus: that bounds all that is sent to tasks or to the driver here.

Texts are tokenised once, into a stored table of ids: they are cut at spaces, where words of both tokenizers
begin, and words a task has not met yet are tokenised together (``WordTable``). Tasks align them and hand on each distinct pair with
its count. The distinct pairs get a minimal perfect hash, built shard by shard (``pair_hash``); counts are
laid into dense vectors indexed by it, one per part of the table, which a tree of sums with ``FAN`` vectors
to a node brings down to one. The second pass aligns the stored ids again and looks counts up; keys beside
the counts verify every look-up.

Defined results: null and empty texts, and texts whose tokens do not give back their bytes (the marker of
the second tokenizer is read as a space), have no tokens and no links; repeated rows count as often as they
are there; a null id is an id like any other; an empty table gives an empty result; very long texts are
aligned whole.
"""

from __future__ import annotations

from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagegrain.llm.common import record, stored
from pagegrain.llm.packing import BYTE_CHARS, UNSAFE, Words
from pagegrain.llm.pair_hash import SHARD_KEYS, PerfectHash, build, shard_of
from pagegrain.llm.pieces import MARKER, Gather, Pieces, Segmented

CHUNK = 1 << 12  # numbers of one piece of a dense vector
FAN = 32
HELD_CHUNKS = 300_000
HELD_WORDS = 600_000
NEW_WORDS = 1 << 15  # tokenised in one call
HELD_PAIRS = 1 << 21
ROWS = 256


def _byte_tokens(tokenizer) -> list[bytes]:
    """Bytes of each id of a byte-level tokenizer."""
    back = {chr(c): b for b, c in BYTE_CHARS.items()}
    out = [b""] * tokenizer.get_vocab_size()
    for token, at in tokenizer.get_vocab(with_added_tokens=False).items():
        out[at] = bytes([back[c] for c in token])
    return out


class Aligner:
    """Both tokenizers, and the bytes of their ids."""

    def __init__(self, byte_path: str, piece_path: str):
        from tokenizers import Tokenizer

        tokenizer = Tokenizer.from_file(byte_path)
        tokenizer.encode_special_tokens = True
        self.words = Words(tokenizer)
        if type(tokenizer.pre_tokenizer).__name__ != "ByteLevel":
            raise ValueError("the first tokenizer is not byte-level")
        self.pieces = Pieces(piece_path)
        self.segmented = Segmented(self.pieces, held=HELD_CHUNKS)
        self.a, self.b = Gather(_byte_tokens(tokenizer)), Gather(self.pieces.bytes_of_ids())

    def tokens(self, text: str | None) -> tuple[np.ndarray, np.ndarray]:
        """Ids of both kinds; none if their bytes are not those of a space and the text."""
        none = np.zeros(0, "<u4")
        if not text:
            return none, none
        told = np.frombuffer((" " + text).encode(), np.uint8)
        a, b = self.words.ids(" " + text)[:-1], self.segmented.ids(text)
        same = all(len(got) == len(told) and (got == told).all() for got in (self.a(a), self.b(b)))
        return (a, b) if same else (none, none)

    def words_of(self, text: str | None) -> list[str] | None:
        """The text cut at spaces, where words of both tokenizers begin; nothing if it takes more than that to tell."""
        if not text or text[0].isspace() or not self.words.byte_level or "<|" in text or MARKER in text or UNSAFE.search(text):
            return None
        return text.split(" ")


class Ragged:
    """Lists of ids under numbers from 0, laid end to end."""

    def __init__(self):
        self.ids, self.sizes = np.zeros(0, "<u4"), np.zeros(0, np.int64)
        self.starts = self.sizes

    def add(self, ids: np.ndarray, sizes: np.ndarray) -> None:
        self.starts = np.concatenate([self.starts, len(self.ids) + np.cumsum(sizes) - sizes])
        self.ids, self.sizes = np.concatenate([self.ids, ids]), np.concatenate([self.sizes, sizes])

    def __call__(self, numbers: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Their ids end to end, and where each list ends."""
        sizes = self.sizes[numbers]
        ends = np.cumsum(sizes)
        return self.ids[np.repeat(self.starts[numbers] - ends + sizes, sizes) + np.arange(int(sizes.sum()))], ends


class WordTable:
    """Ids of both kinds of the words of many texts: those not met before are tokenised together, in one text.

    Only words whose tokens give back their bytes are here; a text with another one is tokenised as a whole.
    """

    def __init__(self, both: Aligner):
        self.both = both
        self.spaced = (both.a.sizes > 0) & (both.a.blob[np.minimum(both.a.starts, len(both.a.blob) - 1)] == 32)
        self.clear()

    def clear(self) -> None:
        self.number: dict[str, int] = {}
        self.odd: set[str] = set()
        self.kinds = (Ragged(), Ragged())

    def _split(self, words: list[str]) -> list[tuple[np.ndarray, np.ndarray]] | None:
        """Ids of both kinds and how many each word has; nothing if they don't give back the words."""
        both, told = self.both, " " + " ".join(words)
        a = np.array(both.words.tokenizer.encode_batch_fast([told], add_special_tokens=False)[0].ids, "<u4")
        lists = both.pieces.model.encode(words, num_threads=1)
        b = np.fromiter(chain.from_iterable(lists), "<u4")
        raw = np.frombuffer(told.encode(), np.uint8)
        same = all(len(got) == len(raw) and (got == raw).all() for got in (both.a(a), both.b(b)))
        first = np.flatnonzero(self.spaced[a])
        if not same or len(first) != len(words):
            return None
        return [(a, np.diff(np.append(first, len(a)))), (b, np.array(list(map(len, lists)), np.int64))]

    def _add(self, words: list[str]) -> None:
        found = self._split(words)
        if found is None and len(words) > 1:
            half = len(words) // 2
            self._add(words[:half])
            self._add(words[half:])
        elif found is None:
            self.odd.update(words)
        else:
            self.number.update(zip(words, range(len(self.number), len(self.number) + len(words))))
            for kind, own in zip(self.kinds, found):
                kind.add(*own)

    def tokens(self, texts: list[str | None]) -> tuple[list[bytes], list[bytes]]:
        """Ids of both kinds of each text, 32 bit each, as ``Aligner.tokens`` has them."""
        cut = [self.both.words_of(text) for text in texts]
        met = set().union(*(words for words in cut if words))
        if len(self.number) + len(self.odd) + len(met) > HELD_WORDS:
            self.clear()
        new = list(met.difference(self.number, self.odd))
        for at in range(0, len(new), NEW_WORDS):
            self._add(new[at : at + NEW_WORDS])
        cut = [None if words is None or (self.odd and not self.odd.isdisjoint(words)) else words for words in cut]
        numbers = np.fromiter(map(self.number.__getitem__, chain.from_iterable(filter(None, cut))), np.int64)
        lasts = np.cumsum([len(words) for words in cut if words], dtype=np.int64) - 1
        out = []
        for kind in self.kinds:
            ids, ends = kind(numbers)
            cuts = [0, *ends[lasts].tolist()]
            out.append([ids[a:b].tobytes() for a, b in zip(cuts[:-1], cuts[1:])])
        plain = zip(*out)
        pairs = [next(plain) if words else tuple(x.tobytes() for x in self.both.tokens(text)) for words, text in zip(cut, texts)]
        return [a for a, _ in pairs], [b for _, b in pairs]


def sizes_of(byte_path: str, piece_path: str) -> tuple[np.ndarray, np.ndarray]:
    both = Aligner(byte_path, piece_path)
    return both.a.sizes, both.b.sizes


def possible_pairs(byte_path: str, piece_path: str) -> int:
    """How many pairs of ids can be linked at all: one's bytes end with the other's."""
    both = Aligner(byte_path, piece_path)
    kinds = []
    for gather in (both.a, both.b):
        counts: dict[bytes, int] = {}
        for start, size in zip(gather.starts.tolist(), gather.sizes.tolist()):
            token = gather.blob[start : start + size].tobytes()
            if token:
                counts[token] = counts.get(token, 0) + 1
        kinds.append(counts)
    a, b = kinds
    total = sum(n * b.get(token[at:], 0) for token, n in a.items() for at in range(len(token)))
    return total + sum(n * a.get(token[at:], 0) for token, n in b.items() for at in range(1, len(token)))


def ends_together(a: np.ndarray, b: np.ndarray, a_sizes: np.ndarray, b_sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places of the linked tokens in both lists, pair by pair."""
    a_ends, b_ends = np.cumsum(a_sizes[a]), np.cumsum(b_sizes[b])
    at = np.searchsorted(b_ends, a_ends)
    linked = at < len(b_ends)
    linked[linked] = b_ends[at[linked]] == a_ends[linked]
    return np.flatnonzero(linked), at[linked]


def keys_of(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return a.astype(np.int64) << 32 | b.astype(np.int64)


def tokenised(docs: DataFrame, byte_path: str, piece_path: str, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``doc_id, a, b``: ids of both kinds, 32 bit each."""
    schema = pa.schema([("doc_id", pa.int64()), ("a", pa.binary()), ("b", pa.binary())])

    def run(batches):
        table = WordTable(Aligner(byte_path, piece_path))
        for part in _slices(batches):
            yield record(schema, part.column(0), *table.tokens(part.column(1).to_pylist()))

    narrow = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
    return narrow.mapInArrow(run, "doc_id long, a binary, b binary")


def _slices(batches):
    for batch in batches:
        for at in range(0, batch.num_rows, ROWS):
            yield batch.slice(at, ROWS)


def _ids(column: pa.Array) -> list[np.ndarray]:
    return [np.frombuffer(raw, "<u4") for raw in column.to_pylist()]


def pair_counts(tokens: DataFrame, sizes: tuple[np.ndarray, np.ndarray]) -> DataFrame:
    """``part, key, n``: pairs linked in each part of the table, and how often."""
    schema = pa.schema([("key", pa.int64()), ("n", pa.int64())])

    def run(batches):
        held = [(np.zeros(0, np.int64), np.zeros(0, np.int64))]

        def merged():
            keys, back = np.unique(np.concatenate([k for k, _ in held]), return_inverse=True)
            n = np.zeros(len(keys), np.int64)
            np.add.at(n, back, np.concatenate([c for _, c in held]))
            return keys, n

        waiting = 0
        for batch in _slices(batches):
            linked = []
            for a, b in zip(_ids(batch.column(0)), _ids(batch.column(1))):
                i, j = ends_together(a, b, *sizes)
                linked.append(keys_of(a[i], b[j]))
            held.append(np.unique(np.concatenate(linked), return_counts=True))
            waiting += len(held[-1][0])
            if waiting > HELD_PAIRS:
                held, waiting = [merged()], 0
        keys, n = merged()
        for at in range(0, len(keys), 1 << 16):
            yield record(schema, keys[at : at + (1 << 16)], n[at : at + (1 << 16)])

    return tokens.select("a", "b").mapInArrow(run, "key long, n long").select(F.spark_partition_id().alias("part"), "key", "n")


def perfect_hash(pairs: DataFrame) -> PerfectHash:
    """Hash of the distinct keys; each shard is built by a task, the driver gets a few bits per key."""
    distinct = pairs.select("key").distinct()
    shards = -(-distinct.count() // SHARD_KEYS)

    def number(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array(shard_of(batch.column(0).to_numpy(), shards)), batch.column(0)], names=["shard", "key"])

    def run(rows: pa.Table) -> pa.Table:
        bits, sizes = build(np.sort(rows["key"].to_numpy()))
        return pa.table({"shard": rows["shard"].slice(0, 1), "bits": pa.array([np.packbits(bits).tobytes()], pa.binary()), "sizes": pa.array([sizes], pa.list_(pa.int64()))})

    built = distinct.mapInArrow(number, "shard long, key long").groupBy("shard").applyInArrow(run, "shard long, bits binary, sizes array<long>")
    found = {r["shard"]: (bytes(r["bits"]), r["sizes"]) for r in built.collect()}
    return PerfectHash([found.get(s, (b"", [])) for s in range(shards)])


def dense_counts(pairs: DataFrame, hashed: PerfectHash) -> tuple[np.ndarray, np.ndarray]:
    """Keys and counts by number: a dense vector per part of the table, added up in a tree."""
    sent = pairs.sparkSession.sparkContext.broadcast(hashed)
    shape = "part long, chunk long, keys binary, n binary"
    schema = pa.schema([("part", pa.int64()), ("chunk", pa.int64()), ("keys", pa.binary()), ("n", pa.binary())])

    def lay(rows: pa.Table) -> pa.Table:
        key, n = rows["key"].to_numpy(), rows["n"].to_numpy()
        at = sent.value(key)
        out = []
        for chunk in np.unique(at // CHUNK):
            own = at // CHUNK == chunk
            keys, counts = np.full(CHUNK, -1, np.int64), np.zeros(CHUNK, np.int64)
            keys[at[own] % CHUNK], counts[at[own] % CHUNK] = key[own], n[own]
            out.append((rows["part"][0].as_py(), int(chunk), keys.tobytes(), counts.tobytes()))
        return pa.Table.from_batches([record(schema, *map(list, zip(*out)))])

    def add(rows: pa.Table) -> pa.Table:
        keys, counts = np.full(CHUNK, -1, np.int64), np.zeros(CHUNK, np.int64)
        for k, n in zip(rows["keys"].to_pylist(), rows["n"].to_pylist()):
            keys = np.maximum(keys, np.frombuffer(k, np.int64))
            counts += np.frombuffer(n, np.int64)
        first = (int(rows["part"][0].as_py()) // FAN, rows["chunk"][0].as_py(), keys.tobytes(), counts.tobytes())
        return pa.Table.from_batches([record(schema, *[[v] for v in first])])

    parts = (pairs.agg(F.max("part")).first()[0] or 0) + 1
    vectors = pairs.withColumn("part", F.col("part").cast("long")).groupBy("part").applyInArrow(lay, shape)
    while True:
        vectors = vectors.groupBy("chunk", F.floor(F.col("part") / FAN).alias("node")).applyInArrow(add, shape)
        parts = -(-parts // FAN)
        if parts == 1:
            break
    found = {r["chunk"]: (np.frombuffer(r["keys"], np.int64), np.frombuffer(r["n"], np.int64)) for r in vectors.collect()}
    empty = (np.zeros(0, np.int64), np.zeros(0, np.int64))
    keys, counts = (np.concatenate([empty[k], *[found[c][k] for c in sorted(found)]])[: hashed.n] for k in (0, 1))
    return keys, counts


class Counts:
    """Corpus-wide count of each linked pair, and whether it is the highest of its second id."""

    def __init__(self, hashed: PerfectHash, keys: np.ndarray, counts: np.ndarray):
        self.hashed, self.keys, self.counts = hashed, keys, counts
        b = keys & 0xFFFFFFFF
        highest = np.zeros(int(b.max(initial=-1)) + 1, np.int64)
        np.maximum.at(highest, b, counts)
        self.best = counts == highest[b]

    def look_up(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        at = self.hashed(keys)
        if (at < 0).any() or (self.keys[at] != keys).any():
            raise KeyError("a linked pair was not counted")
        return self.counts[at], self.best[at]


def _aligned(batches, sizes, counts: Counts):
    """Per row: id, ids of both kinds, ends of the groups in both, and count and best of each link."""
    for batch in _slices(batches):
        rows = []
        for doc, a, b in zip(batch.column(0).to_pylist(), _ids(batch.column(1)), _ids(batch.column(2))):
            i, j = ends_together(a, b, *sizes)
            rows.append((doc, a, b, i + 1, j + 1, keys_of(a[i], b[j])))
        n, best = counts.look_up(np.concatenate([r[-1] for r in rows]))
        cuts = np.cumsum([len(r[-1]) for r in rows])[:-1]
        yield [(*r[:-1], *looked) for r, *looked in zip(rows, np.split(n, cuts), np.split(best, cuts))]


class Alignment:
    """A corpus tokenised, aligned and counted; both results align the stored ids anew."""

    def __init__(self, docs: DataFrame, byte_path: str, piece_path: str, doc_id: str = "doc_id", text: str = "text"):
        self.sizes = sizes_of(byte_path, piece_path)
        self.tokens = stored(tokenised(docs, byte_path, piece_path, doc_id, text), "tokens")
        pairs = stored(pair_counts(self.tokens, self.sizes), "pairs")
        hashed = perfect_hash(pairs)
        self.counts = Counts(hashed, *dense_counts(pairs, hashed))
        self.sent = docs.sparkSession.sparkContext.broadcast(self.counts)

    def groups(self) -> DataFrame:
        """``doc_id, a, b, a_ends, b_ends, counts, best``: ids, where groups end among them, and each link's count."""
        schema = pa.schema([("doc_id", pa.int64()), *[(c, pa.list_(pa.int32())) for c in ("a", "b", "a_ends", "b_ends")], ("counts", pa.list_(pa.int64())), ("best", pa.list_(pa.bool_()))])
        sent, sizes = self.sent, self.sizes

        def run(batches):
            for rows in _aligned(batches, sizes, sent.value):
                yield record(schema, *map(list, zip(*rows)))

        return self.tokens.mapInArrow(run, "doc_id long, a array<int>, b array<int>, a_ends array<int>, b_ends array<int>, counts array<long>, best array<boolean>")

    def summaries(self) -> DataFrame:
        """``doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups``, the last as text: ``a1,a2|b1;a3|b2,b3``."""
        names = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum"]
        schema = pa.schema([*[(name, pa.int64()) for name in names], ("groups", pa.string())])
        sent, sizes = self.sent, self.sizes

        def run(batches):
            shown = Shown(sizes)
            for rows in _aligned(batches, sizes, sent.value):
                out = [(doc, len(a), len(b), len(i), len(i), int(best.sum()), int(n.sum()), shown(a, b, i, j)) for doc, a, b, i, j, n, best in rows]
                yield record(schema, *map(list, zip(*out)))

        return self.tokens.mapInArrow(run, ", ".join(f"{name} long" for name in names) + ", groups string")


class Shown:
    """Groups as text. Ids of both kinds, each before either of its separators, are rows of one table of characters."""

    def __init__(self, sizes: tuple[np.ndarray, np.ndarray]):
        strings = [f"{i}{sep}".encode() for size, seps in zip(sizes, (",|", ",;")) for i in range(len(size)) for sep in seps]
        self.first_b, width = 2 * len(sizes[0]), max(map(len, strings))
        self.table = np.array(strings, f"S{width}").view(np.uint8).reshape(len(strings), width)

    def __call__(self, a: np.ndarray, b: np.ndarray, a_ends: np.ndarray, b_ends: np.ndarray) -> str:
        """A token's place is its own and that of the other kind's tokens in groups before it."""
        if not len(a_ends):
            return ""
        a_sizes, b_sizes = np.diff(a_ends, prepend=0), np.diff(b_ends, prepend=0)
        a_last, b_last = np.zeros(len(a), np.int64), np.zeros(len(b), np.int64)
        a_last[a_ends - 1], b_last[b_ends - 1] = 1, 1
        order = np.empty(len(a) + len(b), np.int64)
        order[np.arange(len(a)) + np.repeat(b_ends - b_sizes, a_sizes)] = 2 * a.astype(np.int64) + a_last
        order[np.arange(len(b)) + np.repeat(a_ends, b_sizes)] = 2 * b.astype(np.int64) + b_last + self.first_b
        characters = self.table[order].ravel()
        return characters[characters > 0].tobytes()[:-1].decode()
