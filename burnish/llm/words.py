"""Words of many texts at once, in numpy, over UTF-8 bytes.

A word is a run of bytes other than space and 0x09-0x0D. As these are ASCII, cutting
bytes cuts characters too.
"""

from __future__ import annotations

import numpy as np

SEPARATOR = np.zeros(256, bool)
SEPARATOR[[0x20, *range(0x09, 0x0E)]] = True

LOWER = np.arange(256, dtype=np.uint8)
LOWER[ord("A") : ord("Z") + 1] += 32

#: An odd multiplier and its inverse modulo 2**64.
BASE = 0x9E3779B97F4A7C15
INVERSE = pow(BASE, -1, 1 << 64)

_powers = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first n powers of the multiplier and of its inverse."""
    if len(_powers[0]) < n:
        for k, base in enumerate((BASE, INVERSE)):
            steps = np.full(max(n, 1 << 20), base, np.uint64)
            steps[0] = 1
            _powers[k] = np.cumprod(steps)
    return _powers[0][:n], _powers[1][:n]


def mixed(h: np.ndarray) -> np.ndarray:
    """Every bit of the result depends on every bit of h."""
    h = h ^ (h >> np.uint64(30))
    h = h * np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(27)
    h *= np.uint64(0x94D049BB133111EB)
    h ^= h >> np.uint64(31)
    return h


class Words:
    """doc, start and stop of every word of a slice, in order of place; for each
    text, the range first[k]:first[k + 1] of its words."""

    def __init__(self, data: np.ndarray, ends: np.ndarray, lower: bool = False):
        self.data = LOWER[data] if lower else data
        inside = ~SEPARATOR[data]
        before = np.empty_like(inside)
        before[1:] = inside[:-1]
        before[:1] = False
        begins = ends[:-1][ends[:-1] < len(data)]
        before[begins] = False
        self.start = np.flatnonzero(inside & ~before)
        after = np.empty_like(inside)
        after[:-1] = inside[1:]
        after[-1:] = False
        after[begins[begins > 0] - 1] = False
        self.stop = np.flatnonzero(inside & ~after) + 1
        self.first = np.searchsorted(self.start, ends)
        self.count = np.diff(self.first)
        self.doc = np.repeat(np.arange(len(ends) - 1), self.count)
        self.last = self.first[1:][self.doc] if len(self.doc) else np.zeros(0, np.int64)

    def __len__(self) -> int:
        return len(self.start)

    def hashes(self) -> np.ndarray:
        """A 64-bit hash of each word."""
        up, down = powers(len(self.data) + 1)
        total = np.zeros(len(self.data) + 1, np.uint64)
        np.cumsum((self.data.astype(np.uint64) + np.uint64(1)) * up[:-1], out=total[1:])
        return mixed((total[self.stop] - total[self.start]) * down[self.start] + (self.stop - self.start).astype(np.uint64))

    def codes(self) -> np.ndarray:
        """Equal words of the slice have equal codes from 1 on; others differ."""
        return np.unique(self.hashes(), return_inverse=True)[1] + 1


def sums(values: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Sum of values[bounds[k]:bounds[k + 1]] for each k."""
    total = np.concatenate([np.zeros(1, np.int64), np.cumsum(values, dtype=np.int64)])
    return np.diff(total[bounds])
