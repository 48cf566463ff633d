"""Connected components of a table of links, by alternating star rounds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagegrain.llm.common import stored


def _state(links: DataFrame) -> tuple:
    row = links.agg(F.count("*").alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("h")).first()
    return row["n"], row["h"]


def components(links: DataFrame) -> DataFrame:
    """``id, component``: for each id in a link (``a``, ``b``), the smallest id it can reach.

    Each round hangs every id's larger neighbours on its smallest one, then every id and its smaller
    neighbours on the smallest of those; the links shrink towards stars, in about log(longest path)
    rounds. Minima are taken before the shuffle, the joins are plain equi-joins whose hot keys adaptive
    execution splits, and each round is written to the shared folder. Two numbers a round reach the driver.
    """
    links = links.select(F.least("a", "b").alias("b"), F.greatest("a", "b").alias("a")).where("a <> b").distinct()
    links = stored(links.select("a", "b"), "links")
    before = _state(links)
    while before[0]:
        both = links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.where("b > a").join(least, "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        # Every link now leads from a larger to a smaller id.
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(low, "a").select("a", "b", "m")
        small = small.select("a", F.col("m").alias("b")).unionByName(small.where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))).distinct()
        links = stored(small, "links")
        after = _state(links)
        if after == before:
            break
        before = after
    return links.select(F.col("a").alias("id"), F.col("b").alias("component")).unionByName(links.select(F.col("b").alias("id"), F.col("b").alias("component"))).distinct()
