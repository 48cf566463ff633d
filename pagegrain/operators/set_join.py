"""Best match of each word set among stored ones, by shared words over the larger size, without comparing all pairs.

Words are in one order of rarity for a host. Sets that share ``o`` of them must share ``w`` of the
rarest ``n - o + w`` words of each (``n`` their number), whatever ``w``: so they meet on a combination of
``w`` words. One word is enough where words are many. On a host of few words one word fits almost every set,
and wider combinations cut the candidates by both the words shared and those left.

How many words must be shared follows from the larger size. Each set therefore enters one family for the
power of two its own size lies in, and one for the next, where its partner is the larger; pairs of a family
need the same number of shared words or more, and have combinations of one width, chosen from measured
counts. Where even so many pairs would meet, high scores are looked for first; a set that has a match there
needs no lower one.
"""

from __future__ import annotations

import math

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagegrain.storage import broadcast_if_small, cut_lineage

WIDEST = 6
MOST_KEYS = 512  # combinations of one set in one family
LEVELS = (7 / 8, 3 / 4)
#: Expected candidates per set above which high scores are looked for first.
MANY = 500


def _needed(larger: Column, level: float, least: float) -> Column:
    """Fewest shared words for a score of ``level`` or more, or of more than ``least`` where that is the level."""
    return (F.floor(larger * level) + 1 if level == least else F.ceil(larger * level)).cast("int")


def _bucket(size: Column) -> Column:
    return F.floor(F.log2(size)).cast("int")


def _families(sets: DataFrame, level: float, least: float) -> DataFrame:
    """Sets with ``family`` and ``spare``, how many of their words may be missed there."""
    rows = sets.withColumn("family", F.explode(F.array(_bucket(F.col("size")), _bucket(F.col("size")) + 1)))
    larger = F.greatest("size", F.pow(F.lit(2), F.col("family")).cast("int"))
    needed = _needed(larger, level, least)
    return rows.withColumn("spare", F.size("common") - needed).withColumn("needed", needed).where("spare >= 0")


def _widths(asked: DataFrame, stored: DataFrame) -> DataFrame:
    """``domain, family, width, expected``: the width with the least keys and expected candidates."""

    def words(rows: DataFrame, name: str) -> DataFrame:
        prefix = F.explode(F.slice("common", F.lit(1), F.col("spare") + 1)).alias("word")
        return rows.select("domain", "family", prefix).groupBy("domain", "family", "word").agg(F.count("*").alias(name))

    def sizes(rows: DataFrame, name: str) -> DataFrame:
        return rows.groupBy("domain", "family").agg(
            F.count("*").alias(name), F.avg("spare").alias(f"spare_{name}"), F.max("spare").alias(f"most_{name}"), F.min("needed").alias(f"needed_{name}")
        )

    met = words(asked, "a").join(words(stored, "b").hint("merge"), ["domain", "family", "word"]).groupBy("domain", "family").agg(F.sum(F.col("a") * F.col("b")).alias("met"))
    both = sizes(asked, "a").join(sizes(stored, "b"), ["domain", "family"]).join(met, ["domain", "family"])
    told = both.select("domain", "family", "a", "b", "met", "spare_a", "spare_b", F.greatest("most_a", "most_b").alias("most"), F.least("needed_a", "needed_b").alias("needed"))
    return told.mapInArrow(_choose, "domain string, family int, width int, expected double, sets long")


def _choose(batches):
    """The cheapest width for each host and family, from their measured counts."""

    def combinations(n: float, k: int) -> float:
        return max(math.prod((n - i) / (i + 1) for i in range(k)), 0.0) if n > k - 1 else 0.0

    for batch in batches:
        out = []
        for row in batch.to_pylist():
            spare, pairs = (row["spare_a"] + row["spare_b"]) / 2, row["a"] * row["b"]
            # Sets of as many words drawn from this many would meet as often.
            vocabulary = (spare + 1) ** 2 * pairs / row["met"]
            options = [((row["a"] + row["b"]) * (spare + 1) + row["met"], 1, float(row["met"]))]
            for width in range(2, min(WIDEST, row["needed"]) + 1):
                keys = combinations(spare + width, width)
                if combinations(row["most"] + width, width) <= MOST_KEYS:
                    expected = pairs * keys**2 / max(combinations(vocabulary, width), 1.0)
                    options.append(((row["a"] + row["b"]) * keys + expected, width, expected))
            _, width, expected = min(options)
            out.append({"domain": row["domain"], "family": row["family"], "width": width, "expected": expected, "sets": row["a"]})
        schema = pa.schema([("domain", pa.string()), ("family", pa.int32()), ("width", pa.int32()), ("expected", pa.float64()), ("sets", pa.int64())])
        yield pa.RecordBatch.from_pylist(out, schema=schema)


def _keyed(rows: DataFrame, widths: DataFrame) -> DataFrame:
    """One row per combination of ``width`` of a set's rarest words, as a hash."""
    prefix, n = F.col("prefix"), F.size("prefix")

    def following(start: Column, key: Column | None) -> Column:
        places = F.when(start <= n, F.sequence(start, n)).otherwise(F.array().cast("array<int>"))
        return F.transform(places, lambda i: F.struct(i.alias("last"), (F.xxhash64(F.get(prefix, i - 1)) if key is None else F.xxhash64(key, F.get(prefix, i - 1))).alias("key")))

    wider = F.aggregate(
        F.when(F.col("width") > 1, F.sequence(F.lit(2), F.col("width"))).otherwise(F.array().cast("array<int>")),
        following(F.lit(1), None),
        lambda found, _: F.flatten(F.transform(found, lambda c: following(c["last"] + 1, c["key"]))),
    )
    placed = rows.join(widths, ["domain", "family"]).withColumn("prefix", F.slice("common", F.lit(1), F.col("spare") + F.col("width")))
    return placed.withColumn("key", F.explode(F.transform(wider, lambda c: c["key"]))).drop("prefix", "spare", "needed", "width", "expected", "sets")


def _matches(asked: DataFrame, stored: DataFrame, widths: DataFrame, level: float, least: float) -> DataFrame:
    widths = broadcast_if_small(widths)  # else Spark may take the sets for the smaller side
    a = _keyed(asked, widths)
    b = _keyed(stored, widths).select("domain", "family", "key", F.col("common").alias("b_common"), F.col("size").alias("b_size"), "task_id")
    larger = F.greatest("size", "b_size")
    pairs = a.join(b.hint("merge"), ["domain", "family", "key"]).where((_bucket(larger) == F.col("family")) & (F.least(F.size("common"), F.size("b_common")) >= _needed(larger, level, least)))
    shared = F.size(F.array_intersect("common", "b_common"))
    best = F.min(F.struct((-(shared / larger)).alias("minus"), "task_id")).alias("best")
    found = pairs.where(shared >= _needed(larger, level, least)).groupBy("domain", "common", "size").agg(best)
    return found.select("domain", "common", "size", (-F.col("best.minus")).alias("score"), F.col("best.task_id").alias("task_id"))


def best_overlaps(asked: DataFrame, stored: DataFrame, least: float) -> DataFrame:
    """``domain, common, size, score, task_id``: of each asked set that has one, the best match above ``least``.

    ``asked(domain, common, size)`` and ``stored(domain, common, size, task_id)`` hold distinct sets, of
    which ``common`` are the words that count, rarest first in the same order on both sides, and ``size`` the
    number of all words. Ties go to the smallest task id.
    """
    parts, rest = [], asked
    a, b = _families(rest, least, least), _families(stored, least, least)
    widths = cut_lineage(_widths(a, b))
    expected, sets = widths.agg(F.sum("expected"), F.sum("sets")).first()
    if (expected or 0) > MANY * (sets or 0):
        for level in LEVELS:
            high = _families(rest, level, least), _families(stored, level, least)
            parts.append(cut_lineage(_matches(*high, cut_lineage(_widths(*high)), level, least)))
            rest = cut_lineage(rest.join(parts[-1].hint("merge"), ["domain", "common", "size"], "left_anti"))
        a = _families(rest, least, least)
    out = _matches(a, b, widths, least, least)
    for part in parts:
        out = out.unionByName(part)
    return out
