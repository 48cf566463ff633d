"""A Merkle manifest of a table: a tree per source, a tree of their roots, and a proof for every row.

A leaf is the digest of a row's columns. Its place among the leaves of its source is a rank query on
bitmaps (``bitmap_rank``), so rows are never sorted. Places key slot arrays: three levels of the tree are
the slots of one group of at most 4,096 nodes, reduced 16 to one in place, and the groups' tops are the
nodes of the next round. A round divides the number of nodes by 4,096. On the way down each group gets
the siblings of its top once, and proves all its nodes from its own slots; paths are never stored per row.

Defined results: a null source is a source of its own and comes first; leaves with a null id come before
the others of their source; rows with the same id are ordered by their leaf, and repeated rows stand side by
side in any order, which gives each its own proof; an empty table gives an empty result; empty and very
long texts are hashed like any other; columns beside those hashed are not looked at.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagegrain.llm.bitmap_rank import rank_rows
from pagegrain.llm.common import stored
from pagegrain.operators.records import with_row_number

FAN = 16
LEVELS = 3
SLOTS = FAN**LEVELS
HASHED = ["doc_id", "source", "lang", "n_chars", "text"]


def leaf_digest(columns: dict[str, Column] | None = None) -> Column:
    """Digest of a row; ``columns`` stand in for some of the hashed ones."""
    parts = []
    for name in HASHED:
        value = (columns or {}).get(name, F.col(name)).cast("string")
        parts.append(F.when(value.isNull(), "-").otherwise(F.concat(F.octet_length(value).cast("string"), F.lit(":"), value)))
    return F.sha2(F.concat(*parts), 256)


def _digest(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


def _reduced(digests: list[str], single: bool) -> list[list[str]]:
    """Levels of a group's slots from its nodes up; a group of a whole tree ends with one node."""
    levels = [digests]
    while len(levels) <= LEVELS and not (single and len(levels[-1]) == 1):
        below = levels[-1]
        levels.append([_digest("".join(below[at : at + FAN])) for at in range(0, len(below), FAN)])
    return levels


def _slots(rows: pa.Table) -> tuple[np.ndarray, list[list[str]]]:
    """Order of a group's nodes and its levels. Only a whole tree has less than all slots in its first group."""
    at = rows["at"].to_numpy()
    order = np.argsort(at)
    digests = rows["digest"].to_pylist()
    single = at[order[0]] == 0 and len(at) < SLOTS
    return order, _reduced([digests[i] for i in order], single)


def _tops(nodes: DataFrame) -> DataFrame:
    """``tree, at, digest`` of the tops of groups of ``SLOTS`` nodes."""

    def run(rows: pa.Table) -> pa.Table:
        return pa.table({"tree": rows["tree"].slice(0, 1), "at": pa.array([int(rows["at"][0].as_py()) // SLOTS], pa.int64()), "digest": [_slots(rows)[1][-1][0]]})

    grouped = nodes.select("tree", "at", "digest", F.floor(F.col("at") / SLOTS).alias("slots")).groupBy("tree", "slots")
    return grouped.applyInArrow(run, "tree string, at long, digest string")


def reduce_trees(nodes: DataFrame) -> list[DataFrame]:
    """Rounds of ``tree, at, digest``, from the leaves to one node per tree; each is a stored table."""
    rounds = [nodes]
    while True:
        rounds.append(stored(_tops(rounds[-1]), "tops"))
        if (rounds[-1].agg(F.max("at")).first()[0] or 0) == 0:
            return rounds


PATH = "lefts array<string>, rights array<string>"


def _descend(nodes: DataFrame, above: DataFrame, extra: list[str], prove, shape: str) -> DataFrame:
    """Meet each group of nodes with the path of its top (``tree, at, lefts, rights`` and ``extra``)."""
    names = [c.split()[0] for c in shape.split(", ")]

    def run(rows: pa.Table, tops: pa.Table) -> pa.Table:
        if not rows.num_rows:
            return pa.table({name: [] for name in names})
        order, levels = _slots(rows)
        top = {name: tops[name][0].as_py() for name in ("lefts", "rights", *extra)}
        sides: list[list[tuple[str, str]]] = []  # of each node of each level: digests left and right of it in its run
        for level in levels[:-1]:
            runs = [level[at : at + FAN] for at in range(0, len(level), FAN)]
            sides.append([("".join(run[:i]), "".join(run[i + 1 :])) for run in runs for i in range(len(run))])
        paths = []
        for at in range(len(levels[0])):
            own = [sides[depth][at // FAN**depth] for depth in range(len(sides))]
            paths.append(([left for left, _ in own] + top["lefts"], [right for _, right in own] + top["rights"]))
        rows = rows.take(pa.array(order))
        return prove(rows, paths, top)

    own = nodes.withColumn("slots", F.floor(F.col("at") / SLOTS))
    tops = above.withColumnRenamed("at", "slots")
    return own.groupBy("tree", "slots").cogroup(tops.groupBy("tree", "slots")).applyInArrow(run, shape)


def _paths(nodes: DataFrame, above: DataFrame, extra: list[str]) -> DataFrame:
    kinds = ", ".join(f"{name} string" for name in extra)

    def prove(rows: pa.Table, paths, top) -> pa.Table:
        data = {"tree": rows["tree"], "at": rows["at"], "lefts": pa.array([p[0] for p in paths], pa.list_(pa.string())), "rights": pa.array([p[1] for p in paths], pa.list_(pa.string()))}
        return pa.table(data | {name: pa.array([top[name]] * len(paths), pa.string()) for name in extra})

    return _descend(nodes, above, extra, prove, f"tree string, at long, {PATH}" + (f", {kinds}" if extra else ""))


def manifest(docs: DataFrame, claimed: Column | None = None) -> DataFrame:
    """``doc_id, leaf, subroot, root, proof_sha256, folded_root``.

    ``claimed`` is a digest told of each row, checked by folding it with the siblings of the row's leaf; the
    leaf itself if not given.
    """
    leaf = leaf_digest()
    rows = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("tree"), leaf.alias("digest"),
        (leaf if claimed is None else claimed).alias("claimed"), F.monotonically_increasing_id().alias("row"),
    )
    rows = stored(rows.withColumn("early", F.conv(F.substring("digest", 1, 15), 16, 10).cast("long")), "leaves")
    leaves = rank_rows(rows, ["tree"], ["doc_id", "early", "row"], "at").select("tree", "at", "doc_id", "digest", "claimed")
    leaves = stored(leaves, "places")
    sources = reduce_trees(leaves.select("tree", "at", "digest"))
    subroots = stored(with_row_number(sources[-1].select("tree", "digest"), "tree", name="at"), "subroots")
    # The subroots are the leaves of one more tree; it has no name.
    upper = reduce_trees(subroots.select(F.lit("").alias("tree"), "at", "digest"))
    none = F.array().cast("array<string>")
    path = upper[-1].select("tree", "at", none.alias("lefts"), none.alias("rights"), F.col("digest").alias("root"))
    for nodes in upper[-2::-1]:
        path = _paths(nodes, path, ["root"])
    path = subroots.join(path.drop("tree"), "at").select("tree", F.lit(0).cast("long").alias("at"), "lefts", "rights", "root", F.col("digest").alias("subroot"))
    for nodes in sources[-2:0:-1]:
        path = _paths(nodes, path, ["root", "subroot"])

    def prove(rows: pa.Table, paths, top) -> pa.Table:
        folded, proofs = [], []
        for digest, (lefts, rights) in zip(rows["claimed"].to_pylist(), paths):
            proofs.append(_digest("".join([side for pair in zip(lefts, rights) for side in pair])))
            for left, right in zip(lefts, rights):
                digest = _digest(left + digest + right)
            folded.append(digest)
        same = {name: pa.array([top[name]] * len(paths), pa.string()) for name in ("subroot", "root")}
        return pa.table({"doc_id": rows["doc_id"], "leaf": rows["digest"], **same, "proof_sha256": proofs, "folded_root": folded})

    shape = "doc_id long, leaf string, subroot string, root string, proof_sha256 string, folded_root string"
    return _descend(leaves, stored(path, "paths"), ["root", "subroot"], prove, shape)
