"""Sets of hashed five-word shingles, for whole buffers of texts at once."""

from __future__ import annotations

from hashlib import blake2b

import numpy as np

from pagegrain.llm.common import spans_of
from pagegrain.llm.hashing import LOWER, VALUES, Sums, mix, words

SHINGLE = 5
#: Longer words are hashed by a keyed digest: a polynomial modulo 2^64 is the same for a Thue-Morse word and its complement.
LONG_WORD = 32
STEPS = np.random.default_rng(5).integers(1, 1 << 63, 64, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def word_hashes(data: np.ndarray, offsets: np.ndarray, lower: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Hash, start and end of each word, and the first word of each text."""
    starts, ends, first = words(data, offsets, spans_of)
    sums = Sums(VALUES[LOWER[data]] if lower else VALUES[data])
    hashes = sums.of(starts, ends)
    for at in np.flatnonzero(ends - starts > LONG_WORD):
        word = data[starts[at] : ends[at]]
        hashes[at] = int.from_bytes(blake2b((LOWER[word] if lower else word).tobytes(), digest_size=8).digest(), "little")
    return hashes, starts, ends, first


def runs(hashes: np.ndarray, width: int) -> np.ndarray:
    """Hash of each run of ``width`` consecutive words; a run may cross texts."""
    n = len(hashes) - width + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    out = np.full(n, width, np.uint64)
    for k in range(width):
        out = out + hashes[k : k + n] * STEPS[k]
    return mix(out)


def shingle_sets(data: np.ndarray, offsets: np.ndarray, width: int = SHINGLE) -> list[np.ndarray]:
    """The sorted distinct shingle hashes of each text; a text of fewer words has its whole sequence as one."""
    hashes, _, _, first = word_hashes(data, offsets, lower=True)
    whole = runs(hashes, width)
    out = []
    for a, b in zip(first[:-1], first[1:]):
        if b - a >= width:
            out.append(np.unique(whole[a : b - width + 1]))
        else:
            out.append(runs(hashes[a:b], int(b - a)) if b > a else np.zeros(0, np.uint64))
    return out
