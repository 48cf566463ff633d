"""Substring dedup on words: a compressed FM-index per shard, searched backwards for matching statistics.

The shard's fragments are joined, each with its own end mark, and sorted by suffix. The Burrows-Wheeler
transform is held as a wavelet matrix of packed bits with counts per 64 of them. Each fragment is then
streamed from its last word to its first: one backward-search step (two ranks in each level) narrows
the rows that begin with what was read, and the number of words read is the matching statistic. From
``window`` words on, the rows' group of suffixes that share a window is reported.

See ``repeats`` for how documents reach the shards and for nulls, repeated rows and ids. A text of fewer
words than a window keeps them all.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame

from pagegrain.llm.repeats import Kind, remove_repeats

WINDOW = 20


class WaveletMatrix:
    """Ranks of symbols in a sequence; one packed bit vector per bit of a symbol."""

    def __init__(self, symbols: np.ndarray, most: int):
        self.levels, self.size = [], len(symbols)
        self.bits = max(1, int(most).bit_length())
        for level in range(self.bits - 1, -1, -1):
            bit = (symbols >> level) & 1
            padded = np.zeros(-(-(len(bit) + 1) // 64) * 64, np.uint8)
            padded[: len(bit)] = bit
            packed = np.packbits(padded, bitorder="little").view(np.uint64)
            before = np.concatenate([[0], np.cumsum(np.bitwise_count(packed).astype(np.int64))])
            self.levels.append((level, packed, before, len(bit) - int(bit.sum())))
            symbols = np.concatenate([symbols[bit == 0], symbols[bit == 1]])

    def _ones(self, packed: np.ndarray, before: np.ndarray, at: np.ndarray) -> np.ndarray:
        below = (np.uint64(1) << (at & 63).astype(np.uint64)) - np.uint64(1)
        return before[at >> 6] + np.bitwise_count(packed[at >> 6] & below)

    def mapped(self, symbol: np.ndarray, at: np.ndarray) -> np.ndarray:
        for level, packed, before, zeros in self.levels:
            ones = self._ones(packed, before, at)
            at = np.where((symbol >> level) & 1 == 1, zeros + ones, at - ones)
        return at

    def rank(self, symbol: np.ndarray, at: np.ndarray) -> np.ndarray:
        """How often each symbol stands before each place."""
        return self.mapped(symbol, at) - self.mapped(symbol, np.zeros_like(at))


def _dense(key: np.ndarray) -> np.ndarray:
    return np.unique(key, return_inverse=True)[1].astype(np.int64)


class FMIndex:
    """Index of fragments (lists of words); end marks differ, so no match crosses fragments."""

    def __init__(self, fragments: list[list[bytes]], window: int):
        count = len(fragments)
        code = {w: i for i, w in enumerate(sorted({w for f in fragments for w in f}))}
        self.length = np.array([len(f) for f in fragments], np.int64)
        self.first = np.concatenate([[0], np.cumsum(self.length + 1)])[:-1]
        text = np.empty(int(self.length.sum()) + count, np.int64)
        marks = self.first + self.length
        within = np.ones(len(text), bool)
        within[marks] = False
        text[marks] = np.arange(count)
        text[within] = np.array([code[w] for f in fragments for w in f], np.int64) + count
        self.words = np.where(within, text - count + 1, 0)  # end marks are 0

        # Suffix order by doubling; the ranks by a window's first words tell which suffixes share a window.
        rank, width, longest = _dense(text), 1, int(self.length.max()) + 1
        part, kept = 1, rank
        while width < longest:
            after = np.zeros(len(rank), np.int64)
            after[:-width] = rank[width:] + 1
            rank = _dense(rank * (len(rank) + 1) + after)
            width *= 2
            if width <= window:
                part, kept = width, rank
        order = np.argsort(rank)
        self.order = order
        rest = np.minimum(order + window - part, len(text) - 1)
        same = (kept[order[1:]] == kept[order[:-1]]) & (kept[rest[1:]] == kept[rest[:-1]])
        self.group = np.concatenate([[0], np.cumsum(~same)])

        transform = self.words[order - 1]
        self.before = np.concatenate([[0], np.cumsum(np.bincount(transform, minlength=len(code) + 1))])
        # Rows of end marks come first, one for each fragment, as in the transform.
        self.tree = WaveletMatrix(transform, len(code))

    def step(self, word: np.ndarray, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rows that begin with the word, and go on as the rows from ``low`` to ``high`` begin."""
        return self.before[word] + self.tree.rank(word, low), self.before[word] + self.tree.rank(word, high)


def find(fragments: list[list[bytes]], window: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(fragment, offset, group) of each window; windows with equal words share a group."""
    index = FMIndex(fragments, window)
    low, high = np.zeros(len(fragments), np.int64), np.full(len(fragments), len(index.words), np.int64)
    out = []
    for read in range(int(index.length.max())):
        on = np.flatnonzero(index.length > read)
        offset = index.length[on] - 1 - read
        low[on], high[on] = index.step(index.words[index.first[on] + offset], low[on], high[on])
        if read + 1 >= window:
            matched = on[high[on] > low[on]]
            out.append((matched, index.length[matched] - 1 - read, index.group[low[matched]]))
    return tuple(np.concatenate(x) for x in zip(*out)) if out else tuple(np.zeros(0, np.int64) for _ in range(3))


def remove_repeated_words(docs: DataFrame, window: int = WINDOW, doc_id: str = "doc_id", text: str = "text", with_text: bool = False) -> DataFrame:
    return remove_repeats(docs, Kind(window, max(1, window * 2 // 5), True), find, doc_id, text, with_text)
