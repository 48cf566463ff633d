"""64-bit hashes of words and byte strings, computed for a whole buffer at once.

A byte string's hash is a polynomial over random 64-bit values of its bytes, mixed with its
length. Prefix sums over the buffer give the hash of any stretch in constant time.
"""

from __future__ import annotations

import numpy as np

BASE = 0x9E3779B97F4A7C15
INVERSE = pow(BASE, -1, 1 << 64)
SPACES = np.zeros(256, bool)
SPACES[[9, 10, 11, 12, 13, 32]] = True
VALUES = np.random.default_rng(20_240_229).integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32

_powers: dict[int, np.ndarray] = {}


def powers(of: int, n: int) -> np.ndarray:
    known = _powers.get(of)
    if known is None or len(known) < n:
        known = np.full(max(n, 1 << 16), of, np.uint64)
        known[0] = 1
        _powers[of] = known = np.cumprod(known)
    return known[:n]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads every bit (splitmix finaliser)."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class Sums:
    """Prefix sums over a buffer of symbols' 64-bit values."""

    def __init__(self, values: np.ndarray):
        self.sums = np.zeros(len(values) + 1, np.uint64)
        np.cumsum(values * powers(BASE, len(values)), out=self.sums[1:])
        self.back = powers(INVERSE, len(values) + 1)

    def of(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """Hashes of the stretches [start, end)."""
        raw = (self.sums[ends] - self.sums[starts]) * self.back[starts]
        return mix(raw + (ends - starts).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))


def words(data: np.ndarray, offsets: np.ndarray, spans) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of words (runs without ASCII white space) and the index of the first word of each text."""
    starts, ends = spans(~SPACES[data], offsets)
    return starts, ends, np.searchsorted(starts, offsets)


def sliding_min(values: np.ndarray, width: int) -> np.ndarray:
    """Minimum of each ``width`` consecutive values; ``len(values) - width + 1`` of them."""
    out, done = values, 1
    while done < width:
        by = min(done, width - done)
        out = np.minimum(out[:-by], out[by:])
        done += by
    return out
