"""Exact top-k by integer inner product over a vector-approximation file.

Equal vectors first become one class that keeps its k+1 smallest ids (all that any query can need), so
a vector that a third of the rows share is scanned once. The approximation file holds one byte per
component: the number of its cell on a uniform grid. For each pair of a query block and a cell block a
task bounds every product from the cells alone and passes on what may still reach the top k. The
(k+1)th lower bound over all blocks then drops the rest (k+1, as the query's own class may be one of
them). Exact vectors are read in the order of their bounds: first the k+1 best-bounded classes of each
query; the kth score these give is certain, and after them only classes whose bound reaches it are read.

Defined results: vectors that are null or hold null or non-finite components, and rows without id, take
no part; vectors of another dimension than the query's aren't its candidates; identical repeated rows
count once; ties go to the smaller id; an empty table gives an empty result. Components saturate at 64
bits; scores are exact while they fit 64 bits.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pagegrain.llm.common import record, stored

CELLS = 256
CELL_BLOCK = 4096  # classes in a block of the approximation file
QUERY_BLOCK = 512
TILE = 1 << 21  # bounds held at once


def usable(vector: Column) -> Column:
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != F.lit(float("inf"))))
    return vector.isNotNull() & F.coalesce(finite, F.lit(False))


def whole_parts(vectors: DataFrame, scale: int, vec_id: str, vector: str) -> DataFrame:
    """``vec_id, v``: usable vectors as floor(scale * x)."""
    rows = vectors.select(F.col(vec_id).cast("long").alias("vec_id"), F.col(vector).cast("array<double>").alias("x"))
    rows = rows.where(F.col("vec_id").isNotNull() & usable(F.col("x")))
    return rows.select("vec_id", F.transform("x", lambda x: F.floor(x * F.lit(float(scale))).cast("long")).alias("v"))


def _matrix(column: pa.ChunkedArray | pa.Array, dim: int) -> np.ndarray:
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return np.asarray(column.flatten(), np.int64).reshape(len(column), dim)


def _cells_of(low: int, width: int):
    def run(batches):
        schema = pa.schema([("class", pa.int64()), ("dim", pa.int32()), ("cells", pa.binary())])
        for batch in batches:
            dims = np.asarray(batch.column(1))
            values = batch.column(2).to_pylist()
            cells = [((np.array(v, np.int64) - low) // width).astype(np.uint8).tobytes() for v in values]
            yield record(schema, batch.column(0), pa.array(dims, pa.int32()), cells)

    return run


def _bounds(low: int, width: int, k: int):
    """For one query block and one cell block: the pairs that may still be among the k best."""
    schema = pa.schema([("query", pa.int64()), ("class", pa.int64()), ("low", pa.float64()), ("high", pa.float64())])

    def run(cells: pa.Table, queries: pa.Table) -> pa.Table:
        if not cells.num_rows or not queries.num_rows:
            return schema.empty_table()
        dim = cells["dim"][0].as_py()
        numbers = np.frombuffer(b"".join(cells["cells"].to_pylist()), np.uint8).reshape(cells.num_rows, dim)
        # Centre of a cell; whole parts lie within half a width less one half of it.
        centres = low + numbers.astype(np.float64) * width + (width - 1) / 2
        classes = np.asarray(cells["class"])
        exact = _matrix(queries["v"], dim).astype(np.float64)
        # Rounding of the float products, far below one half for usual sizes, is added to the slack.
        slack = np.abs(exact).sum(1) * (width - 1) / 2
        slack = slack + (np.abs(exact).sum(1) * max(abs(low), abs(low + width * CELLS)) + 1) * 1e-12
        ids, parts = np.asarray(queries["query"]), []
        step = max(1, TILE // len(classes))
        for at in range(0, len(ids), step):
            middle = exact[at : at + step] @ centres.T
            s = slack[at : at + step, None]
            if len(classes) > k + 1:
                limit = np.partition(middle, len(classes) - k - 1, axis=1)[:, len(classes) - k - 1, None] - s
            else:
                limit = np.full((len(middle), 1), -np.inf)
            q, c = np.nonzero(middle + s >= limit)
            parts.append((ids[at + q], classes[c], middle[q, c] - s[q, 0], middle[q, c] + s[q, 0]))
        return pa.table([np.concatenate(x) for x in zip(*parts)], schema=schema)

    return run


def exact_top_k(vectors: DataFrame, queries: DataFrame, k: int = 10, scale: int = 1024, vec_id: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """``query_id, rank, vec_id, score`` of each query's k best rows other than its own."""
    rows = whole_parts(vectors, scale, vec_id, vector)
    order = Window.partitionBy("v").orderBy("vec_id")
    members = rows.withColumn("nth", F.dense_rank().over(order)).where(F.col("nth") <= k + 1)
    classes = members.groupBy("v").agg(F.array_sort(F.collect_set("vec_id")).alias("ids"))
    classes = stored(classes.select(F.monotonically_increasing_id().alias("class"), F.size("v").alias("dim"), "v", "ids"), "classes")
    asked = whole_parts(queries, scale, vec_id, vector).distinct()
    asked = stored(asked.select(F.monotonically_increasing_id().alias("query"), F.col("vec_id").alias("query_id"), F.col("v").alias("q"), F.size("v").alias("dim")), "queries")

    range_ = classes.agg(F.min(F.array_min("v")).alias("low"), F.max(F.array_max("v")).alias("high"), F.count("*").alias("n")).first()
    low = range_["low"] if range_["low"] is not None else 0
    width = max(1, -(-((range_["high"] if range_["high"] is not None else 0) - low + 1) // CELLS))
    cell_blocks = max(1, -(-range_["n"] // CELL_BLOCK))
    query_blocks = max(1, -(-asked.count() // QUERY_BLOCK))

    cells = classes.select("class", "dim", "v").mapInArrow(_cells_of(low, width), "class long, dim int, cells binary")
    cells = cells.select("class", "dim", "cells", F.pmod(F.xxhash64("class"), F.lit(cell_blocks).cast("long")).alias("cell_block"), F.explode(F.sequence(F.lit(0), F.lit(query_blocks - 1))).alias("query_block"))
    blocks = asked.select("query", "dim", F.col("q").alias("v"), F.pmod(F.xxhash64("query"), F.lit(query_blocks)).cast("int").alias("query_block"), F.explode(F.sequence(F.lit(0).cast("long"), F.lit(cell_blocks - 1).cast("long"))).alias("cell_block"))
    keys = ["dim", "cell_block", "query_block"]
    near = cells.groupBy(*keys).cogroup(blocks.groupBy(*keys)).applyInArrow(_bounds(low, width, k), "query long, class long, low double, high double")
    near = stored(near, "bounds")

    by_low = Window.partitionBy("query").orderBy(F.col("low").desc())
    limit = near.withColumn("nth", F.row_number().over(by_low)).where(F.col("nth") <= k + 1)
    limit = limit.groupBy("query").agg(F.when(F.count("*") == k + 1, F.min("low")).otherwise(F.lit(float("-inf"))).alias("limit"))
    near = near.join(limit, "query").where("high >= limit").select("query", "class", "high")
    by_high = Window.partitionBy("query").orderBy(F.col("high").desc(), "class")
    near = stored(near.withColumn("nth", F.row_number().over(by_high)), "candidates")

    def read(pairs: DataFrame) -> DataFrame:
        product = F.aggregate(F.zip_with("q", "v", lambda a, b: a * b), F.lit(0).cast("long"), lambda a, b: a + b)
        out = pairs.join(classes.select("class", "v", "ids"), "class").join(asked.select("query", "query_id", "q"), "query")
        return out.select("query", "query_id", product.alias("score"), F.explode("ids").alias("vec_id")).where("vec_id <> query_id")

    def best(found: DataFrame) -> DataFrame:
        order = Window.partitionBy("query").orderBy(F.col("score").desc(), "vec_id")
        return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)

    first = stored(best(read(near.where(F.col("nth") <= k + 1))).select("query", "query_id", "vec_id", "score"), "first")
    certain = first.groupBy("query").agg(F.when(F.count("*") == k, F.min("score")).alias("least"))
    rest = near.where(F.col("nth") > k + 1).join(certain, "query", "left").where(F.col("least").isNull() | (F.col("high") >= F.col("least")))
    found = first.unionByName(read(rest.select("query", "class")).select("query", "query_id", "vec_id", "score"))
    return best(found).select("query_id", "rank", "vec_id", "score")
