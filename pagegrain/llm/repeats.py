"""Windows that occur earlier in the corpus: how documents are cut, dealt out and put together again.

Two operators share this frame; they differ in symbols (words or bytes) and in the index that finds
equal windows within a shard.

1. Each window has an anchor, its gram with the smallest hash. Neighbouring windows with the same anchor
   form a fragment; equal windows have equal anchors, so they can only lie in fragments of one anchor.
2. Anchors that occur once in the corpus end there: their windows are unique. Anchors are shuffled once,
   sorted, and neighbours compared as a stream, so that a hot anchor is never held as a whole.
3. Equal fragments become one, with its first place in the corpus; every later copy is covered whole.
4. Where an anchor has several different fragments, these are dealt by anchor to shards of bounded size,
   and the shard's index reports windows that occur earlier (an anchor's only fragment has no other to
   share a window with). Fragments of one anchor that fill over ``HOT_BYTES`` would
   overfill a shard; they are cut into single windows, and equal windows meet in an aggregation.
5. Reported spans are gathered by document and cut out.

Documents that repeat an id with another text are told apart and ordered by a hash of the text; rows
that repeat id and text are one document and get equal results. A null id's text is kept whole and
covers nothing.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagegrain.llm.common import STEP_BYTES, buffers, record, steps, stored
from pagegrain.llm.hashing import VALUES, Sums, mix, sliding_min
from pagegrain.llm.shingles import word_hashes

PLACE_BITS = 31
PLACE = np.uint64((1 << PLACE_BITS) - 1)
SHARD_BYTES = 1 << 20
HOT_BYTES = 4 << 20  # fragments of one anchor that a shard still takes, estimated from their lengths
WORD_BYTES = 8
SALT = np.uint64(0xD1342543DE82EF95)  # tells texts apart in a hash of text number and anchor


@dataclass(frozen=True)
class Kind:
    """Symbols of a text: their 64-bit values, the texts' first symbols, and any run of them as bytes."""

    window: int
    gram: int
    words: bool

    def values(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        if self.words:
            hashes, _, _, first = word_hashes(data, offsets, lower=False)
            return hashes, first
        return VALUES[data], offsets

    def symbols(self, raw: bytes):
        return raw.split() if self.words else raw

    def joined(self, symbols) -> bytes:
        return b" ".join(symbols) if self.words else bytes(symbols)

    def without(self, symbols, spans: list[tuple[int, int]]) -> bytes:
        parts, at = [], 0
        for start, end in spans:
            parts.append(symbols[at:start])
            at = end
        parts.append(symbols[at:])
        return b" ".join(w for p in parts for w in p) if self.words else b"".join(parts)


def fragments(values: np.ndarray, first: np.ndarray, window: int, gram: int) -> tuple[np.ndarray, ...]:
    """Text number, start within the text, length, anchor and content hash of every fragment."""
    n = len(values)
    if n < window:
        return tuple(np.zeros(0, t) for t in (np.int64, np.int64, np.int64, np.uint64, np.uint64))
    sums = Sums(values)
    hashes = mix((sums.sums[gram:] - sums.sums[:-gram]) * sums.back[: n - gram + 1])
    # The smallest hash, of equal ones the leftmost: its place is carried in the low bits.
    least = sliding_min((hashes & ~PLACE) | np.arange(len(hashes), dtype=np.uint64), window - gram + 1)
    cuts = np.concatenate([[True], least[1:] != least[:-1]])
    cuts[first[first < len(least)]] = True
    starts = np.flatnonzero(cuts)
    nexts = np.append(starts[1:], len(least))
    text = np.searchsorted(first, starts, "right") - 1
    inside = starts + window <= first[1:][text]
    starts, text = starts[inside], text[inside]
    ends = np.minimum(nexts[inside] - 1 + window, first[1:][text])
    return text, starts - first[text], ends - starts, hashes[(least[starts] & PLACE).astype(np.int64)], sums.of(starts, ends)


def _identified(docs: DataFrame, doc_id: str, text: str) -> DataFrame:
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text"))
    return rows.select(F.xxhash64("doc_id", "text").alias("row"), "doc_id", "text")


def _anchors(kind: Kind):
    """(anchor, row), twice where a text holds the anchor more than once."""
    schema = pa.schema([("anchor", pa.int64()), ("row", pa.int64())])

    def run(batches):
        for batch in batches:
            for rows, data, offsets in steps(iter([batch])):
                values, first = kind.values(data, offsets)
                text, _, _, anchor, _ = fragments(values, first, kind.window, kind.gram)
                key = mix(anchor + text.astype(np.uint64) * SALT)
                order = key.argsort()
                text, anchor, key = text[order], anchor[order], key[order]
                if len(text) > 2:
                    keep = np.concatenate([[True, True], key[2:] != key[:-2]])
                    text, anchor = text[keep], anchor[keep]
                yield record(schema, anchor.view(np.int64), np.asarray(rows.column(0))[text])

    return run


def _shared(batches):
    """Of rows in order of anchor those whose anchor others have too; neighbours tell."""
    schema = pa.schema([("anchor", pa.int64()), ("row", pa.int64())])
    anchor, row, known = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, bool)  # the last row before a batch
    for batch in batches:
        if not batch.num_rows:
            continue
        anchor, row = (np.concatenate([x, np.asarray(c)]) for x, c in zip((anchor, row), batch.columns))
        same = np.concatenate([anchor[1:] == anchor[:-1], [False]])
        same[1:] |= same[:-1].copy()
        same[: len(known)] |= known
        yield record(schema, anchor[:-1][same[:-1]], row[:-1][same[:-1]])
        anchor, row, known = anchor[-1:], row[-1:], same[-1:]
    yield record(schema, anchor[known], row[known])


def _packed(batches):
    schema = pa.schema([("row", pa.int64()), ("doc_id", pa.int64()), ("packed", pa.binary())])
    press = zstandard.ZstdCompressor(3)
    for batch in batches:
        data, offsets = buffers(batch.column(2))
        yield record(schema, batch.column(0), batch.column(1), [press.compress(data[a:b]) for a, b in zip(offsets[:-1], offsets[1:])])


CUT = "row long, doc_id long, n long, digest string, packed binary, fragments array<struct<anchor:long,content:long,start:long,length:long>>"


def _cut(kind: Kind, whole: bool):
    """Texts with their fragments of shared anchors; texts without any are done and keep their digest only."""
    part = pa.struct([("anchor", pa.int64()), ("content", pa.int64()), ("start", pa.int64()), ("length", pa.int64())])
    schema = pa.schema([("row", pa.int64()), ("doc_id", pa.int64()), ("n", pa.int64()), ("digest", pa.string()), ("packed", pa.binary()), ("fragments", pa.list_(part))])

    def found_in(raws: list[bytes], shared: list[list[int]]) -> tuple[np.ndarray, np.ndarray, pa.StructArray]:
        """Symbols of several texts, how many fragments of shared anchors each has, and these."""
        data = np.frombuffer(b"".join(raws), np.uint8)
        values, first = kind.values(data, np.concatenate([[0], np.cumsum([len(r) for r in raws], dtype=np.int64)]))
        text, start, length, anchor, content = fragments(values, first, kind.window, kind.gram)
        owner = np.repeat(np.arange(len(shared)), [len(s) for s in shared]).astype(np.uint64)
        of = np.array([x for s in shared for x in s], np.int64).view(np.uint64)
        keep = np.isin(mix(anchor + text.astype(np.uint64) * SALT), mix(of + owner * SALT))
        columns = [pa.array(x[keep]) for x in (anchor.view(np.int64), content.view(np.int64), start, length)]
        return np.diff(first), np.bincount(text[keep], minlength=len(raws)), pa.StructArray.from_arrays(columns, fields=list(part))

    def run(batches):
        open_ = zstandard.ZstdDecompressor()
        for batch in batches:
            at, columns = 0, [c.to_pylist() for c in batch.columns]
            while at < batch.num_rows:
                raws, size = [], 0
                while at + len(raws) < batch.num_rows and size < STEP_BYTES:
                    raws.append(open_.decompress(columns[2][at + len(raws)]))
                    size += len(raws[-1])
                row, doc, packed, shared = (c[at : at + len(raws)] for c in columns)
                at += len(raws)
                marked = [i for i, s in enumerate(shared) if s]
                counts, held, found = found_in([raws[i] for i in marked], [shared[i] for i in marked])
                n, sizes = np.zeros(len(raws), np.int64), np.zeros(len(raws) + 1, np.int32)
                n[marked], sizes[1:][marked] = counts, held
                digests, kept = [None] * len(raws), list(packed)
                for i in set(range(len(raws))).difference(marked):
                    symbols = kind.symbols(raws[i])
                    n[i], digests[i] = len(symbols), hashlib.sha256(kind.joined(symbols)).hexdigest()
                    kept[i] = packed[i] if whole else None
                lists = pa.ListArray.from_arrays(pa.array(np.cumsum(sizes, dtype=np.int32)), found)
                yield record(schema, row, doc, n, digests, kept, lists)

    return run


def _contents(kind: Kind):
    """The symbols of first fragments, as bytes."""
    schema = pa.schema([("anchor", pa.int64()), ("hot", pa.bool_()), ("doc_id", pa.int64()), ("row", pa.int64()), ("start", pa.int64()), ("content", pa.binary())])

    def run(batches):
        open_ = zstandard.ZstdDecompressor()
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                of, (anchor, start, length, hot) = _listed(part.column(3))
                out, last, symbols = [], -1, None
                for i, a, b in zip(of.tolist(), start.to_pylist(), (np.asarray(start) + np.asarray(length)).tolist()):
                    if i != last:
                        last, symbols = i, kind.symbols(open_.decompress(part.column(2)[i].as_py()))
                    out.append(kind.joined(symbols[a:b]))
                yield record(schema, anchor, hot, part.column(1).take(of), part.column(0).take(of), start, out)

    return run


def _single_windows(kind: Kind):
    """Fragments as their single windows."""
    schema = pa.schema([("doc_id", pa.int64()), ("row", pa.int64()), ("start", pa.int64()), ("content", pa.binary())])

    def run(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                out = []
                for doc, row, start, content in zip(*(c.to_pylist() for c in batch.slice(at, 512).columns)):
                    symbols = kind.symbols(content)
                    out += [(doc, row, start + i, kind.joined(symbols[i : i + kind.window])) for i in range(len(symbols) - kind.window + 1)]
                yield record(schema, *(map(list, zip(*out)) if out else [[] for _ in schema]))

    return run


def _reported(kind: Kind, find: Callable):
    """Spans of a shard's windows that occur earlier, found by the shard's index."""
    schema = pa.schema([("row", pa.int64()), ("start", pa.int64()), ("end", pa.int64())])

    def run(rows: pa.Table) -> pa.Table:
        doc, row, start = (np.asarray(rows[c]) for c in ("doc_id", "row", "start"))
        contents = [kind.symbols(c) for c in rows["content"].to_pylist()]
        # One number per window that orders as (document, start).
        order = np.lexsort((row, doc))
        steps_ = np.concatenate([[0], np.cumsum((doc[order][1:] != doc[order][:-1]) | (row[order][1:] != row[order][:-1]))])
        place = np.empty(len(doc), np.int64)
        place[order] = steps_
        base = (place << PLACE_BITS) + start
        fragment, offset, group = find(contents, kind.window)
        own = base[fragment] + offset
        earliest = np.full(int(group.max()) + 1 if len(group) else 0, np.iinfo(np.int64).max)
        np.minimum.at(earliest, group, own)
        repeated = earliest[group] < own
        fragment, offset = fragment[repeated], offset[repeated]
        order = np.lexsort((offset, fragment))
        fragment, offset = fragment[order], offset[order]
        if not len(fragment):
            return schema.empty_table()
        begins = np.flatnonzero(np.concatenate([[True], (fragment[1:] != fragment[:-1]) | (offset[1:] != offset[:-1] + 1)]))
        lasts = np.concatenate([begins[1:] - 1, [len(offset) - 1]])
        of = fragment[begins]
        return pa.table([row[of], start[of] + offset[begins], start[of] + offset[lasts] + kind.window], schema=schema)

    return run


def _finished(kind: Kind, whole: bool):
    fields = [("doc_id", pa.int64()), ("n", pa.int64()), ("n_removed", pa.int64()), ("n_spans", pa.int64()), ("spans", pa.list_(pa.int64())), ("kept_sha256", pa.string())]
    schema = pa.schema(fields + [("kept", pa.binary())] * whole)

    def run(batches):
        open_ = zstandard.ZstdDecompressor()
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                of, (start, end) = _listed(part.column(4))
                cuts, start, end = _joined(np.asarray(of), np.asarray(start), np.asarray(end), part.num_rows)
                total = np.concatenate([[0], np.cumsum(end - start)])
                spans = list(zip(start.tolist(), end.tolist()))
                digests, texts = part.column(2).to_pylist(), []
                for i, packed in enumerate(part.column(3).to_pylist()):
                    texts.append(None if packed is None else kind.without(kind.symbols(open_.decompress(packed)), spans[cuts[i] : cuts[i + 1]]))
                    if packed is not None:
                        digests[i] = hashlib.sha256(texts[-1]).hexdigest()
                flat = pa.ListArray.from_arrays(pa.array(cuts * 2, pa.int32()), pa.array(np.stack([start, end], 1).ravel()))
                yield record(schema, part.column(0), part.column(1), np.diff(total[cuts]), np.diff(cuts), flat, digests, *[texts] * whole)

    return run


def _listed(lists: pa.ListArray) -> tuple[pa.Array, list[pa.Array]]:
    """Row number and fields of every struct in lists; null lists have none."""
    return pc.list_parent_indices(lists), lists.flatten().flatten()


def _joined(text: np.ndarray, start: np.ndarray, end: np.ndarray, texts: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Spans that touch or overlap made one: where each text's spans begin, their starts and ends."""
    order = np.lexsort((start, text))
    base = text[order] << PLACE_BITS
    reach = np.maximum.accumulate(base + end[order])
    begins = np.flatnonzero(np.concatenate([[True], (base + start[order])[1:] > reach[:-1]])[: len(text)])
    lasts = np.append(begins[1:], len(text))[: len(begins)] - 1
    cuts = np.searchsorted(text[order][begins], np.arange(texts + 1))
    return cuts, start[order][begins], reach[lasts] - base[lasts]


def remove_repeats(docs: DataFrame, kind: Kind, find: Callable, doc_id: str = "doc_id", text: str = "text", with_text: bool = False) -> DataFrame:
    """``doc_id, n, n_removed, n_spans, spans, kept_sha256`` of every row, and what is left (``kept``) if asked for.

    ``spans`` has the starts and ends of the removed runs in turn, in symbols.
    """
    rows = _identified(docs, doc_id, text)
    anchors = rows.where("doc_id is not null").select("row", "text").mapInArrow(_anchors(kind), "anchor long, row long")
    shared = anchors.repartition("anchor").sortWithinPartitions("anchor").mapInArrow(_shared, "anchor long, row long")
    own = shared.groupBy("row").agg(F.collect_set("anchor").alias("shared"))
    packed = rows.select("row", "doc_id", "text").mapInArrow(_packed, "row long, doc_id long, packed binary")
    cut = packed.join(own, "row", "left").select("row", "doc_id", "packed", F.when(F.col("doc_id").isNotNull(), F.col("shared")).alias("shared"))
    cut = stored(cut.mapInArrow(_cut(kind, with_text), CUT), "cut")

    # Repeated rows are one document.
    open_ = cut.where(F.size("fragments") > 0)
    places = open_.select("doc_id", "row", F.explode("fragments").alias("f")).select("doc_id", "row", "f.*")
    firsts = places.groupBy("anchor", "content").agg(F.min(F.struct("doc_id", "row", "start", "length")).alias("first"))
    firsts = stored(firsts.select("anchor", "content", "first.*"), "firsts")

    # A fragment that is the only one of its anchor has no other to share a window with.
    several = firsts.groupBy("anchor").agg(F.count("*").alias("many"), F.sum("length").alias("symbols")).where("many > 1")
    hot = F.col("symbols") * (WORD_BYTES if kind.words else 1) > HOT_BYTES
    wanted = firsts.join(several, "anchor").select("row", F.struct("anchor", "start", "length", hot.alias("hot")).alias("f"))
    wanted = wanted.groupBy("row").agg(F.collect_list("f").alias("wanted"))
    contents = "anchor long, hot boolean, doc_id long, row long, start long, content binary"
    texts = open_.select("row", "doc_id", "packed").join(wanted, "row").select("row", "doc_id", "packed", "wanted")
    first = stored(texts.mapInArrow(_contents(kind), contents), "contents")

    # Hot anchors: equal windows become one; the later ones are covered.
    order = F.struct("doc_id", "row", "start")
    single = first.where("hot").select("doc_id", "row", "start", "content")
    single = single.mapInArrow(_single_windows(kind), "doc_id long, row long, start long, content binary")
    least = single.groupBy("content").agg(F.min(order).alias("least"))
    later = single.join(least, "content").where(order > F.col("least")).select("row", "start", (F.col("start") + kind.window).alias("end"))

    dealt = first.where("not hot").drop("hot")
    size = dealt.agg(F.sum(F.octet_length("content")).alias("bytes")).first()["bytes"] or 0
    shards = max(1, -(-int(size) // SHARD_BYTES))
    dealt = dealt.withColumn("shard", F.pmod(F.xxhash64("anchor"), F.lit(shards)))
    found = stored(dealt.groupBy("shard").applyInArrow(_reported(kind, find), "row long, start long, end long"), "found")

    named = firsts.select("anchor", "content", F.col("row").alias("first_row"), F.col("start").alias("first_start"))
    copies = places.join(named, ["anchor", "content"]).where("row <> first_row or start <> first_start")
    copies = copies.select("row", "start", (F.col("start") + F.col("length")).alias("end"))
    spans = copies.unionByName(found).unionByName(later).groupBy("row").agg(F.collect_list(F.struct("start", "end")).alias("found"))
    spans = stored(spans, "spans")
    out = "doc_id long, n long, n_removed long, n_spans long, spans array<long>, kept_sha256 string" + ", kept binary" * with_text
    done = cut.join(spans, "row", "left") if with_text else open_.join(spans, "row", "left")
    done = done.select("doc_id", "n", "digest", "packed", "found").mapInArrow(_finished(kind, with_text), out)
    if with_text:
        return done
    clean = cut.where(F.size("fragments") == 0)
    empty = F.array().cast("array<long>")
    return done.unionByName(clean.select("doc_id", "n", F.lit(0).cast("long").alias("n_removed"), F.lit(0).cast("long").alias("n_spans"), empty.alias("spans"), F.col("digest").alias("kept_sha256")))
