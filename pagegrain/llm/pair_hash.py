"""Minimal perfect hashing of 64-bit keys in shards, and dense vectors indexed by it.

Each shard is hashed level by level: a key whose slot no other key of the level wants sets that bit, the
others go to the next level. The rank of a key's bit among all set bits is its number, from 0 without
gaps. The bits say nothing of keys that were never hashed, so a dense vector of the keys verifies them.
"""

from __future__ import annotations

import numpy as np

GAMMA = 2  # slots per key of a level
SHARD_KEYS = 1 << 14


def mixed(keys: np.ndarray, seed: int) -> np.ndarray:
    x = keys.astype(np.uint64) + np.uint64((seed + 1) * 0x9E3779B97F4A7C15 % (1 << 64))
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def build(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Bits of all levels end to end, and how many each level has, for distinct keys."""
    levels, sizes = [], []
    while len(keys):
        size = GAMMA * len(keys)
        slot = (mixed(keys, len(sizes)) % np.uint64(size)).astype(np.int64)
        once = np.bincount(slot, minlength=size) == 1
        levels.append(once)
        sizes.append(size)
        keys = keys[~once[slot]]
    return np.concatenate([np.zeros(0, bool), *levels]), np.array(sizes, np.int64)


class PerfectHash:
    """Numbers of keys from the bits of all shards; the shard of a key is its hash modulo their number."""

    def __init__(self, shards: list[tuple[bytes, list[int]]]):
        self.n_shards, self.levels, self.firsts, total = len(shards), [], [], 0
        for bits, sizes in shards:
            flat = np.unpackbits(np.frombuffer(bits, np.uint8), count=int(sum(sizes))).astype(bool)
            ranks = np.cumsum(flat) - flat
            self.levels.append((flat, ranks, np.array(sizes, np.int64)))
            self.firsts.append(total)
            total += int(flat.sum())
        self.n = total

    def shard(self, keys: np.ndarray) -> np.ndarray:
        return shard_of(keys, self.n_shards)

    def __call__(self, keys: np.ndarray) -> np.ndarray:
        """Number of each key; -1 where no level has a bit for it, and any number for other unknown keys."""
        out = np.full(len(keys), -1, np.int64)
        if not self.n_shards:
            return out
        shards = self.shard(keys)
        for s in np.unique(shards):
            at, (flat, ranks, sizes) = np.flatnonzero(shards == s), self.levels[s]
            base = 0
            for level, size in enumerate(sizes):
                slot = base + (mixed(keys[at], level) % np.uint64(size)).astype(np.int64)
                hit = flat[slot]
                out[at[hit]] = self.firsts[s] + ranks[slot[hit]]
                at, base = at[~hit], base + size
                if not len(at):
                    break
        return out


def shard_of(keys: np.ndarray, shards: int) -> np.ndarray:
    return (mixed(keys, 1 << 20) % np.uint64(max(shards, 1))).astype(np.int64)
