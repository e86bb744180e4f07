"""A minimal perfect hash over a fixed set of byte strings, looked up for many strings at a time.

Levelled bit arrays: a level has ``GAMMA`` places for each key that is left; a key that is alone at its place stays there,
keys that meet go on to the next level with another hash. A key's slot is the number of places taken before its own, so
``n`` keys have the slots 0 to n - 1, and three levels find most of them. A string that is no key gets some slot or none, so
the caller compares it with the key of that slot.
"""

from __future__ import annotations

from collections.abc import Iterable, Sequence

import numpy as np
import xxhash

GAMMA = 1.5
LEVELS = 64


def hashes(strings: Iterable[bytes | str], n: int, seed: int = 0) -> np.ndarray:
    """XXH3 of each string (text as UTF-8)."""
    return np.fromiter((xxhash.xxh3_64_intdigest(s, seed) for s in strings), np.uint64, n)


def _places(h: np.ndarray, level: int, size: int) -> np.ndarray:
    x = (h ^ (h >> np.uint64(29)) ^ np.uint64((level + 1) * 0x9E3779B97F4A7C15 % 2**64)) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0x94D049BB133111EB)
    return ((x >> np.uint64(32)) * np.uint64(size) >> np.uint64(32)).astype(np.int64)


class PerfectHash:
    """Slots of distinct byte strings. Repeated keys are an error."""

    def __init__(self, keys: Sequence[bytes]) -> None:
        if len(set(keys)) != len(keys):
            raise ValueError("a perfect hash needs distinct keys")
        for seed in range(8):  # another one only where two keys share all 64 bits
            h = hashes(keys, len(keys), seed)
            if len(np.unique(h)) == len(h) and self._build(h):
                self.seed = seed
                return
        raise ValueError("no perfect hash found")

    def _build(self, h: np.ndarray) -> bool:
        self.levels: list[np.ndarray] = []  # the slot at each place, or -1
        used, left = 0, h
        while len(left):
            if len(self.levels) == LEVELS:
                return False
            size = int(GAMMA * len(left)) + 1
            at = _places(left, len(self.levels), size)
            alone = np.bincount(at, minlength=size) == 1
            slots = np.where(alone, used + np.cumsum(alone) - 1, -1).astype(np.int32)
            self.levels.append(slots)
            used += int(alone.sum())
            left = left[~alone[at]]
        return True

    def slots(self, strings: Sequence[bytes | str]) -> np.ndarray:
        """A slot for each string, or -1; certain only for the keys."""
        h = hashes(strings, len(strings), self.seed)
        out = np.full(len(h), -1, dtype=np.int64)
        open_ = np.arange(len(h))
        for level, slots in enumerate(self.levels):
            if not len(open_):
                break
            found = slots[_places(h[open_], level, len(slots))]
            out[open_] = found
            open_ = open_[found < 0]
        return out
