"""Substring dedup on bytes: the transform of a collection, built column by column.

A shard's fragments are the documents of the collection. Round by round every fragment still unread
gives one more symbol, from its last to its first. The transform is one sequential stream in the order
of all suffixes read so far; a round reads it once, finds for each fragment where its suffix, longer by
one symbol, belongs (the symbol's rank among all before its last place), and writes the stream anew
with the next symbols merged in. The common prefixes of neighbouring suffixes are a second stream: a
new suffix shares one symbol more than the least prefix between its last place and the previous place
with the same symbol; its successor likewise. Fragments are kept in the order of their last places, so
that these prefixes are found in one pass. Streams are arrays in memory, as a shard is bounded.

At the end, neighbours with a common prefix of a whole window share that window. See ``repeats`` for how
documents reach the shards and for nulls, repeated rows and ids. A text shorter than a window is kept.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

from pagegrain.llm.repeats import Kind, remove_repeats

WINDOW = 100


def _by_symbol(symbols: np.ndarray) -> np.ndarray:
    """Places in order of symbol and place (Arrow counts symbols, which takes linear time)."""
    return pc.array_sort_indices(pa.array(symbols)).to_numpy().view(np.int64)


def collection(fragments: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Transform (0: a fragment's begin; else byte + 1), common prefixes with the row before, and lengths."""
    count = len(fragments)
    length = np.array([len(f) for f in fragments], np.int64)
    longest = int(length.max()) if count else 0
    # Columns from the end; bytes of UTF-8 are below 255, so one more still fits a byte.
    joined = np.frombuffer(b"".join(fragments), np.uint8)
    columns = np.zeros((longest + 1, count), np.uint8)
    owner = np.repeat(np.arange(count), length)
    last = np.cumsum(length)
    columns[last[owner] - 1 - np.arange(len(joined)), owner] = joined + 1
    transform, common = columns[0], np.zeros(count + 1, np.uint16)  # one more, for ranges up to the end
    on = at = np.arange(count)  # fragments in the order of their last places
    for read in range(1, longest + 1):
        going = length[on] >= read
        on, at = on[going], at[going]
        # Ranks by runs of equal symbols: repeats make them long, and only they are sorted.
        size = len(transform)
        begins = np.flatnonzero(np.concatenate([[True], transform[1:] != transform[:-1], [True]]))
        heads = transform[begins[:-1]]
        runs = _by_symbol(heads)
        nth = np.empty(len(runs), np.int32)
        nth[runs] = np.arange(len(runs), dtype=np.int32)
        earlier = np.cumsum(np.diff(begins)[runs])  # symbols in runs up to each, by symbol and place
        run = np.searchsorted(begins, at, "right") - 1
        # By symbol and last place, as the new places, from here on, but for the ranges.
        by = heads[run].argsort(kind="stable")
        on, at, run = on[by], at[by], run[by]
        symbol, own = heads[run], nth[run]
        to = earlier[own] + at - begins[run + 1] + count - int(np.count_nonzero(transform == 0))
        left, right = runs[np.maximum(own - 1, 0)], runs[np.minimum(own + 1, len(runs) - 1)]
        inner, outer = at > begins[run], at + 1 < begins[run + 1]
        has_before = inner | (own > 0) & (heads[left] == symbol)
        has_after = outer | (own + 1 < len(runs)) & (heads[right] == symbol)
        before, after = np.where(inner, at, begins[left + 1]) - 1, np.where(outer, at + 1, begins[right])

        # Ranges follow each other by last place, so that what lies between them is read once at most.
        ranges = np.empty((len(at), 3), np.int64)
        ranges[by] = np.stack([np.where(has_before, before + 1, at), at + 1, np.where(has_after, after, at) + 1], 1)
        least = np.minimum.reduceat(common, ranges.ravel()).reshape(-1, 3)[by] + np.uint16(1)

        old = np.ones(size + len(to) + 1, bool)
        old[to] = False
        shared = np.empty(len(old), np.uint16)
        shared[old] = common
        shared[to[has_after] + 1] = least[has_after, 1]
        shared[to] = np.where(has_before, least[:, 0], 0)
        out = np.empty(len(old) - 1, np.uint8)
        out[old[:-1]], out[to] = transform, columns[read][on]
        transform, common, at = out, shared, to
    return transform, common[:-1], length


def find(fragments: list[bytes], window: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(fragment, offset, group) of each window; windows with equal bytes share a group."""
    transform, common, length = collection(fragments)
    group = np.cumsum(common < window)
    order = _by_symbol(transform)
    follow = np.empty(len(transform), np.int64)
    follow[order] = np.arange(len(transform)) - int((transform == 0).sum()) + len(fragments)
    row, out = np.arange(len(fragments)), []
    for read in range(1, int(length.max()) + 1 if len(length) else 0):
        on = np.flatnonzero(length >= read)
        row[on] = follow[row[on]]
        if read >= window:
            out.append((on, length[on] - read, group[row[on]]))
    return tuple(np.concatenate(x) for x in zip(*out)) if out else tuple(np.zeros(0, np.int64) for _ in range(3))


def remove_repeated_bytes(docs: DataFrame, window: int = WINDOW, doc_id: str = "doc_id", text: str = "text", with_text: bool = False) -> DataFrame:
    return remove_repeats(docs, Kind(window, max(1, window * 2 // 5), False), find, doc_id, text, with_text)
