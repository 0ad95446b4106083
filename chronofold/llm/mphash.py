"""A minimal perfect hash over 128-bit keys in NumPy: levels of bit arrays, ranks by running popcount.

At each level the keys that fall alone into a slot take it; the others go on to the next level.  A key's index is the
number of taken slots before its own.  About 3.7 bits a key at ``GAMMA`` 1.5.  Keys that are left after
``LEVELS`` levels are kept in a sorted list.  A key outside the set gets some index or -1: callers compare fingerprints.
"""

from __future__ import annotations

import io

import numpy as np

GAMMA, LEVELS = 1.5, 24


def _mix(lo: np.ndarray, hi: np.ndarray, level: int) -> np.ndarray:
    with np.errstate(over="ignore"):
        x = lo ^ (hi * np.uint64(0x9E3779B97F4A7C15 + 2 * level))
        x = (x ^ (x >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(29))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(32))


class MinimalPerfectHash:
    def __init__(self, levels: list[np.ndarray], rest: np.ndarray):
        self.levels, self.rest, self.ranks, before = levels, rest, [], 0
        for taken in levels:
            counts = np.concatenate([[0], np.cumsum(np.bitwise_count(taken).astype(np.int64))])
            self.ranks.append(counts + before)
            before += int(counts[-1])
        self.size = before + len(rest)

    @classmethod
    def build(cls, lo: np.ndarray, hi: np.ndarray) -> MinimalPerfectHash:
        """``lo``, ``hi``: the halves of distinct keys."""
        levels = []
        while len(lo) and len(levels) < LEVELS:
            slots = -(-max(64, int(GAMMA * len(lo))) // 64) * 64
            at = (_mix(lo, hi, len(levels)) % np.uint64(slots)).astype(np.int64)
            alone = np.bincount(at, minlength=slots) == 1
            levels.append(np.packbits(alone, bitorder="little").view(np.uint64))
            left = ~alone[at]
            lo, hi = lo[left], hi[left]
        rest = np.stack([hi, lo], axis=1) if len(lo) else np.zeros((0, 2), np.uint64)
        return cls(levels, rest[np.lexsort((rest[:, 1], rest[:, 0]))])

    def index(self, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
        """The index of each key, -1 where no level has a slot for it."""
        out = np.full(len(lo), -1, np.int64)
        live = np.arange(len(lo))
        for level, (taken, ranks) in enumerate(zip(self.levels, self.ranks, strict=True)):
            if not len(live):
                return out
            at = _mix(lo[live], hi[live], level) % np.uint64(64 * len(taken))
            word, bit = (at >> np.uint64(6)).astype(np.int64), at & np.uint64(63)
            hit = (taken[word] >> bit) & np.uint64(1) == 1
            below = taken[word] & ((np.uint64(1) << bit) - np.uint64(1))
            out[live[hit]] = (ranks[word] + np.bitwise_count(below))[hit]
            live = live[~hit]
        for k, (hi_k, lo_k) in enumerate(self.rest):
            out[live[(hi[live] == hi_k) & (lo[live] == lo_k)]] = self.size - len(self.rest) + k
        return out

    def dump(self, **arrays: np.ndarray) -> bytes:
        out = io.BytesIO()
        np.savez(out, rest=self.rest, **{f"level{i}": x for i, x in enumerate(self.levels)}, **arrays)
        return out.getvalue()

    @classmethod
    def load(cls, blob: bytes) -> tuple[MinimalPerfectHash, dict[str, np.ndarray]]:
        with np.load(io.BytesIO(blob)) as z:
            data = {k: z[k] for k in z.files}
        n = sum(k.startswith("level") for k in data)
        return cls([data.pop(f"level{i}") for i in range(n)], data.pop("rest")), data
