"""Ranks of rows among their group by compressed bitmaps, without sorting the rows.

A 64-bit key falls into the container of its upper 48 bits. Tasks build a container per group from the
keys they hold, as a list of lower halves or as bits, whichever is shorter; containers of all tasks are
merged. Their counts are summed along the key's upper bits, 16 at a time, and turned into the number of
rows before each container: no step sums over more than 65,536 siblings. Rows then meet their container
in one pass over clustered partitions, and a popcount directory tells each row how many keys lie before
its own. Null keys come first.

Rows with equal keys get one rank; ``rank_rows`` ranks those again by a further key, in the same way.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pagegrain.llm.common import stored

LISTED = 4095  # a container with more keys is as short as bits
EXTRA = np.dtype([("low", "<u2"), ("rows", "<i8")])


class Container:
    """Distinct lower halves with a popcount directory, and how many further rows repeat some of them."""

    def __init__(self, bits: bytes, extra: bytes):
        if len(bits) == 8192:
            self.words, self.lows = np.frombuffer(bits, "<u8"), None
            self.directory = np.concatenate([[0], np.cumsum(np.bitwise_count(self.words).astype(np.int64))])
        else:
            self.lows = np.frombuffer(bits, "<u2")
        again = np.frombuffer(extra, EXTRA)
        self.again, self.further = again["low"], again["rows"]
        self.further_before = np.concatenate([[0], np.cumsum(self.further)])

    def rank(self, lows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rows before each key, and how many rows hold it."""
        if self.lows is None:
            word = self.words[lows >> 6] & ((np.uint64(1) << (lows & 63).astype(np.uint64)) - np.uint64(1))
            before = self.directory[lows >> 6] + np.bitwise_count(word)
        else:
            before = np.searchsorted(self.lows, lows)
        at = np.searchsorted(self.again, lows)
        same = np.ones(len(lows), np.int64)
        if len(self.again):
            found = np.minimum(at, len(self.again) - 1)
            same += np.where(self.again[found] == lows, self.further[found], 0)
        return before + self.further_before[at], same

    def counts(self) -> tuple[np.ndarray, np.ndarray]:
        lows = self.lows if self.lows is not None else np.flatnonzero(np.unpackbits(self.words.view(np.uint8), bitorder="little"))
        n = np.ones(len(lows), np.int64)
        n[np.searchsorted(lows, self.again)] += self.further
        return lows.astype(np.int64), n


def packed(lows: np.ndarray, counts: np.ndarray) -> tuple[bytes, bytes]:
    """A container's two parts, from distinct ascending lower halves and their numbers of rows."""
    if len(lows) > LISTED:
        bits = np.zeros(1 << 16, np.uint8)
        bits[lows] = 1
        raw = np.packbits(bits, bitorder="little").tobytes()
    else:
        raw = lows.astype("<u2").tobytes()
    extra = np.zeros(int((counts > 1).sum()), EXTRA)
    extra["low"], extra["rows"] = lows[counts > 1], counts[counts > 1] - 1
    return raw, extra.tobytes()


def _codes(columns: list[pa.Array], n: int) -> np.ndarray:
    """One number per row, equal where all columns are."""
    code = np.zeros(n, np.int64)
    for column in columns:
        own = np.asarray(column.dictionary_encode(null_encoding="encode").indices, np.int64)
        code = np.unique(code * (own.max(initial=0) + 1) + own, return_inverse=True)[1]
    return code


def _build(batches: Iterator[pa.RecordBatch], schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    """Containers of the keys of each batch; the last two columns are presence with upper bits, and lower bits."""
    for batch in batches:
        if not batch.num_rows:
            continue
        low = np.asarray(batch.column(batch.num_columns - 1), np.int64)
        order = np.lexsort((low, code := _codes(batch.columns[:-1], batch.num_rows)))
        code, low = code[order], low[order]
        new = np.flatnonzero(np.concatenate([[True], (code[1:] != code[:-1]) | (low[1:] != low[:-1])]))
        rows = np.diff(np.concatenate([new, [len(low)]]))
        firsts = np.flatnonzero(np.concatenate([[True], code[new][1:] != code[new][:-1]]))
        ends = np.concatenate([firsts[1:], [len(new)]])
        parts = [packed(low[new[a:b]], rows[a:b]) for a, b in zip(firsts, ends)]
        keys = [c.take(pa.array(order[new[firsts]])) for c in batch.columns[:-1]]
        yield pa.RecordBatch.from_arrays([*keys, pa.array([p[0] for p in parts], pa.binary()), pa.array([p[1] for p in parts], pa.binary()), pa.array(np.add.reduceat(rows, firsts), pa.int64())], schema=schema)


def _merge(schema: pa.Schema):
    def run(rows: pa.Table) -> pa.Table:
        total = np.zeros(1 << 16, np.int64)
        for bits, extra in zip(rows["bits"].to_pylist(), rows["extra"].to_pylist()):
            lows, n = Container(bits, extra).counts()
            total[lows] += n
        there = np.flatnonzero(total)
        raw, extra = packed(there, total[there])
        keys = rows.select(schema.names[:-3]).slice(0, 1).combine_chunks()
        return pa.Table.from_arrays([*keys.columns, pa.array([raw], pa.binary()), pa.array([extra], pa.binary()), pa.array([int(total.sum())], pa.int64())], schema=schema)

    return run


def containers(rows: DataFrame, group: list[str], key: str) -> DataFrame:
    """Merged containers with the number of rows of the group before each: ``_there, _upper, bits, extra, n, before``."""
    from pyspark.sql.pandas.types import to_arrow_schema

    keyed = rows.select(*group, *_split(key))
    shape = T.StructType([*keyed.schema.fields[:-1], T.StructField("bits", T.BinaryType()), T.StructField("extra", T.BinaryType()), T.StructField("n", T.LongType())])
    arrow, names = to_arrow_schema(shape), [*group, "_there", "_upper"]
    merged = keyed.mapInArrow(lambda batches: _build(batches, arrow), shape).groupBy(*names).applyInArrow(_merge(arrow), shape)
    merged = stored(merged, "containers")
    counts = merged.select(*names, F.shiftright("_upper", 32).alias("_c"), F.shiftright("_upper", 16).alias("_b"), "n")
    path, before = ["_there", "_c", "_b", "_upper"], None
    for depth in range(1, len(path) + 1):
        above, own = [*group, *path[: depth - 1]], path[depth - 1]
        level = counts.groupBy(*above, own).agg(F.sum("n").alias("n"))
        earlier = Window.partitionBy(*above).orderBy(own).rowsBetween(Window.unboundedPreceding, -1)
        level = level.select(*above, own, F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("own"))
        if before is None:
            before = level.withColumnRenamed("own", "before")
        else:
            before = _join(level, before, above).withColumn("before", F.col("before") + F.col("own")).drop("own")
    return _join(merged, before.drop("_c", "_b"), names)


def _join(left: DataFrame, right: DataFrame, on: list[str]) -> DataFrame:
    """An inner join where nulls meet nulls; the right side is unique in ``on``."""
    renamed = right.select([F.col(c).alias(f"_r_{c}" if c in on else c) for c in right.columns])
    match = F.lit(True)
    for c in on:
        match = match & left[c].eqNullSafe(F.col(f"_r_{c}"))
    return left.join(renamed, match).drop(*[f"_r_{c}" for c in on])


def _split(key: str) -> list[Column]:
    value = F.coalesce(F.col(key), F.lit(0).cast("long"))
    return [F.col(key).isNotNull().cast("int").alias("_there"), F.shiftright(value, 16).alias("_upper"), value.bitwiseAND(0xFFFF).cast("int").alias("_low")]


def rank_by(rows: DataFrame, group: list[str], key: str, rank: str, same: str) -> DataFrame:
    """Rows with ``rank``, how many rows of their group have a smaller key, and ``same``, how many have theirs."""
    from pyspark.sql.pandas.types import to_arrow_schema

    found = containers(rows, group, key)
    place = [*group, "_there", "_upper"]
    own = {f.name: f.dataType for f in rows.schema}
    other = [name for name in own if name not in group]
    asked = rows.select(*group, *_split(key), F.lit(1).alias("_kind"), *other, *[F.lit(None).cast(t).alias(n) for n, t in (("bits", "binary"), ("extra", "binary"), ("before", "long"))])
    given = found.select(*place, F.lit(-1).alias("_low"), F.lit(0).alias("_kind"), *[F.lit(None).cast(own[n]).alias(n) for n in other], "bits", "extra", "before")
    shape = T.StructType([*rows.schema.fields, T.StructField(rank, T.LongType()), T.StructField(same, T.LongType())])
    arrow, columns = to_arrow_schema(shape), rows.columns

    def run(batches):
        container, base = None, 0
        for batch in batches:
            kind = np.asarray(batch.column(batch.schema.get_field_index("_kind")))
            low = np.asarray(batch.column(batch.schema.get_field_index("_low")), np.int64)
            cuts = np.concatenate([[0], np.flatnonzero(kind == 0), [len(kind)]])
            before, equal = np.zeros(len(kind), np.int64), np.zeros(len(kind), np.int64)
            for at, end in zip(cuts[:-1], cuts[1:]):
                if at < end and kind[at] == 0:
                    bits, extra, base = (batch.column(batch.schema.get_field_index(c))[int(at)].as_py() for c in ("bits", "extra", "before"))
                    container, at = Container(bits, extra), at + 1
                if at < end:
                    n, equal[at:end] = container.rank(low[at:end])
                    before[at:end] = base + n
            keep = pa.array(np.flatnonzero(kind == 1))
            kept = [batch.column(batch.schema.get_field_index(c)).take(keep) for c in columns]
            yield pa.RecordBatch.from_arrays([*kept, pa.array(before).take(keep), pa.array(equal).take(keep)], schema=arrow)

    # Each container is read once, before the rows that ask it; neither is held longer than a batch.
    met = asked.unionByName(given).repartition(*place).sortWithinPartitions(*place, "_kind")
    return met.mapInArrow(run, shape)


def rank_rows(rows: DataFrame, group: list[str], keys: list[str], rank: str = "rank") -> DataFrame:
    """Rows with their 0-based place in their group, in the order of the keys, which are unique together.

    Only rows that share a key with others are ranked by the next key, within that key.
    """
    ranked = stored(rank_by(rows, group, keys[0], rank, "_same"), "ranked")
    tied = ranked.where("_same > 1")
    if len(keys) == 1 or tied.isEmpty():
        return ranked.drop("_same")
    outer = f"_outer{len(keys)}"
    inner = rank_rows(tied.withColumnRenamed(rank, outer).drop("_same"), [*group, keys[0]], keys[1:], rank)
    inner = inner.withColumn(rank, F.col(rank) + F.col(outer)).drop(outer)
    return ranked.where("_same = 1").drop("_same").unionByName(inner)
