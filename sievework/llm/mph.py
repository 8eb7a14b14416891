"""A minimal perfect hash over 128-bit keys, with a fingerprint and a count for each key.

The construction is that of Limasset et al., "Fast and scalable minimal perfect hashing for massive key
sets" (2017): keys that land alone on a bit of a level's bit array stay there, the others go on to the next
level; a key's index is the number of set bits before its own.
"""

from __future__ import annotations

import numpy as np

#: Bits of a level for each key that reaches it; the largest count that an index tells apart.
GAMMA, MOST = 2.0, (1 << 32) - 1
#: The constants of the SplitMix64 finaliser.
STEP, MIX_1, MIX_2 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * MIX_1
    x = (x ^ (x >> np.uint64(27))) * MIX_2
    return x ^ (x >> np.uint64(31))


def _place(h1: np.ndarray, h2: np.ndarray, level: int, size: int) -> np.ndarray:
    with np.errstate(over="ignore"):
        return (_mixed(h1 + STEP * np.uint64(level + 1)) ^ _mixed(h2 - STEP * np.uint64(level + 1))) % np.uint64(size)


def build(h1: np.ndarray, h2: np.ndarray, counts: np.ndarray) -> dict:
    """The index of distinct keys (h1, h2), both uint64: sizes of the levels, their bits, and arrays by index."""
    left, sizes, levels = np.arange(len(h1)), [], []
    slot, before = np.empty(len(h1), dtype=np.int64), 0
    while len(left):
        size = 64 * int(np.ceil(GAMMA * len(left) / 64))
        at = _place(h1[left], h2[left], len(sizes), size).astype(np.int64)
        alone = np.bincount(at, minlength=size) == 1
        stays = alone[at]
        slot[left[stays]] = before + (np.cumsum(alone) - 1)[at[stays]]
        before += int(alone.sum())
        sizes.append(size)
        levels.append(np.packbits(alone, bitorder="little"))
        left = left[~stays]
    fingerprints, by_slot = np.empty(len(h1), dtype="<u8"), np.empty(len(h1), dtype="<u4")
    fingerprints[slot], by_slot[slot] = h2, np.minimum(counts, MOST)
    bits = np.concatenate(levels) if levels else np.empty(0, dtype=np.uint8)
    return {"sizes": sizes, "bits": bits.tobytes(), "fingerprints": fingerprints.tobytes(), "counts": by_slot.tobytes()}


class Index:
    """What build() gave, ready for lookups."""

    def __init__(self, sizes, bits: bytes, fingerprints: bytes, counts: bytes):
        self.sizes = [int(s) for s in sizes]
        self.words = np.frombuffer(bits, dtype="<u8")
        self.before = np.concatenate([[0], np.cumsum(np.bitwise_count(self.words).astype(np.int64))])
        self.fingerprints, self.counts = np.frombuffer(fingerprints, dtype="<u8"), np.frombuffer(counts, dtype="<u4")

    def lookup(self, h1: np.ndarray, h2: np.ndarray) -> np.ndarray:
        """The counts of the keys; 0 for one that isn't in the index."""
        found, left, offset = np.zeros(len(h1), dtype=np.int64), np.arange(len(h1)), 0
        for level, size in enumerate(self.sizes):
            if not len(left):
                break
            at = _place(h1[left], h2[left], level, size).astype(np.int64) + offset
            word, bit = self.words[at >> 6], (at & 63).astype(np.uint64)
            is_set = (word >> bit) & np.uint64(1) == 1
            mine, word, bit = left[is_set], word[is_set], bit[is_set]
            slot = self.before[at[is_set] >> 6] + np.bitwise_count(word & ((np.uint64(1) << bit) - np.uint64(1)))
            same = self.fingerprints[slot] == h2[mine]
            found[mine[same]] = self.counts[slot[same]]
            left, offset = left[~is_set], offset + size
        return found
