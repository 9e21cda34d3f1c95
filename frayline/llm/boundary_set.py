"""Sorted sets of 32-bit offsets in containers, as in Roaring bitmaps, with rank-select by cumulative cardinalities.

The upper 16 bits of a value name its container, the lower 16 are kept in the smallest of three forms: a sorted array (2
bytes a value), a bitmap (8 KiB) or runs (4 bytes each). ``select(k)`` finds the container by binary search over cumulative
cardinalities, then the value inside it: by index, by cumulative bit counts of the bitmap's words, or by cumulative run
lengths.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

WORDS = 1024  # 64-bit words of a bitmap container
_BIT = np.uint64(1) << np.arange(64, dtype=np.uint64)


@dataclass
class Array:
    values: np.ndarray

    def select(self, k: int) -> int:
        return int(self.values[k])

    def rank(self, x: int) -> int:
        return int(np.searchsorted(self.values, x, side="right"))


@dataclass
class Bitmap:
    words: np.ndarray

    def __post_init__(self) -> None:
        self.upto = np.cumsum(np.bitwise_count(self.words), dtype=np.int64)

    def select(self, k: int) -> int:
        w = int(np.searchsorted(self.upto, k, side="right"))
        left = k - (int(self.upto[w - 1]) if w else 0)
        return w * 64 + int(np.flatnonzero(self.words[w] & _BIT)[left])

    def rank(self, x: int) -> int:
        w, bit = divmod(x, 64)
        mask = np.uint64((1 << (bit + 1)) - 1)
        return (int(self.upto[w - 1]) if w else 0) + int(np.bitwise_count(self.words[w] & mask))


@dataclass
class Runs:
    starts: np.ndarray
    sizes: np.ndarray

    def __post_init__(self) -> None:
        self.upto = np.cumsum(self.sizes, dtype=np.int64)

    def select(self, k: int) -> int:
        r = int(np.searchsorted(self.upto, k, side="right"))
        return int(self.starts[r]) + k - (int(self.upto[r - 1]) if r else 0)

    def rank(self, x: int) -> int:
        r = int(np.searchsorted(self.starts, x, side="right")) - 1
        if r < 0:
            return 0
        return (int(self.upto[r - 1]) if r else 0) + min(x - int(self.starts[r]) + 1, int(self.sizes[r]))


def container(low: np.ndarray) -> Array | Bitmap | Runs:
    """The smallest form of sorted distinct 16-bit values."""
    edges = np.flatnonzero(np.diff(low) != 1) + 1
    if 4 * (len(edges) + 1) < min(2 * len(low), 8 * WORDS):
        begin = np.concatenate([[0], edges])
        return Runs(low[begin], np.diff(np.concatenate([begin, [len(low)]])))
    if 2 * len(low) <= 8 * WORDS:
        return Array(low.astype(np.uint16))
    bits = np.zeros(64 * WORDS, dtype=bool)
    bits[low] = True
    return Bitmap(np.packbits(bits, bitorder="little").view(np.uint64))


class BoundarySet:
    """A set of offsets below 2**32 made from sorted distinct values."""

    def __init__(self, values: np.ndarray) -> None:
        values = np.asarray(values, dtype=np.int64)
        high = values >> 16
        begin = np.concatenate([[0], np.flatnonzero(np.diff(high)) + 1]) if len(values) else np.empty(0, dtype=np.int64)
        ends = np.append(begin[1:], len(values)) if len(values) else begin
        self.keys = high[begin]
        self.containers = [container(values[a:b] & 0xFFFF) for a, b in zip(begin.tolist(), ends.tolist())]
        self.upto = ends

    def __len__(self) -> int:
        return int(self.upto[-1]) if len(self.upto) else 0

    def select(self, k: int) -> int:
        """The kth value, from 0."""
        if not 0 <= k < len(self):
            raise IndexError(k)
        c = int(np.searchsorted(self.upto, k, side="right"))
        before = int(self.upto[c - 1]) if c else 0
        return (int(self.keys[c]) << 16) + self.containers[c].select(k - before)

    def rank(self, x: int) -> int:
        """How many values are at most x."""
        c = int(np.searchsorted(self.keys, x >> 16))
        before = int(self.upto[c - 1]) if c else 0
        if c == len(self.keys) or self.keys[c] != x >> 16:
            return before
        return before + self.containers[c].rank(x & 0xFFFF)
