"""Static three-wise binary fuse filters over 64-bit digests.

A filter holds one byte for each cell; a key's fingerprint is the XOR of three cells in
consecutive segments.  Construction peels keys that own a cell of their own, all such keys of a round
at once, and then fills the cells in reverse order.  A key that was put in always passes; another one passes with
a chance of 1/256.
"""

from __future__ import annotations

import itertools
import math
from dataclasses import dataclass

import numpy as np

_MIX = (np.uint64(0xFF51AFD7ED558CCD), np.uint64(0xC4CEB9FE1A85EC53))
_STEP = 0x9E3779B97F4A7C15


def _mixed(keys: np.ndarray) -> np.ndarray:
    for factor in _MIX:
        keys = (keys ^ (keys >> np.uint64(33))) * factor
    return keys ^ (keys >> np.uint64(33))


@dataclass(frozen=True)
class Fuse:
    seed: int
    bits: int  # cells of a segment: 1 << bits
    segments: int  # segments a key can start in
    cells: np.ndarray

    def __contains__(self, key: int) -> bool:
        return bool(self.passes(np.array([key]))[0])

    def passes(self, keys: np.ndarray) -> np.ndarray:
        """Which of these signed 64-bit keys may have been put in."""
        if not len(self.cells):
            return np.zeros(len(keys), bool)
        spots, marks = _spots(keys, self.seed, self.bits, self.segments)
        return np.bitwise_xor.reduce(self.cells[spots], axis=0) == marks


def _spots(keys: np.ndarray, seed: int, bits: int, segments: int) -> tuple[np.ndarray, np.ndarray]:
    """The three cells of every key, and its fingerprint."""
    start = np.uint64((seed + 1) * _STEP % (1 << 64))
    one = _mixed(np.asarray(keys, np.int64).view(np.uint64) + start)
    two = _mixed(one ^ start)
    inside = np.uint64((1 << bits) - 1)
    first = ((one >> np.uint64(32)) * np.uint64(segments) >> np.uint64(32)) << np.uint64(bits)
    ahead = np.uint64(1 << bits)
    spots = np.stack(
        [first + (one & inside), first + ahead + (two & inside), first + ahead * np.uint64(2) + (two >> np.uint64(32) & inside)]
    )
    return spots.astype(np.int64), (_mixed(two) & np.uint64(255)).astype(np.uint8)


def build(keys: np.ndarray) -> Fuse:
    """The filter of these keys; repeated keys count once."""
    keys = np.unique(np.asarray(keys, np.int64))
    n = len(keys)
    if not n:
        return Fuse(0, 0, 1, np.zeros(0, np.uint8))
    # Segment length and room by the published rule for three cells a key.
    bits = int(math.log(n) / math.log(3.33) + 2.25) if n > 1 else 2
    room = max(1.125, 0.875 + 0.25 * math.log(1e6) / math.log(max(n, 2)))
    segments = max(1, math.ceil(n * room / (1 << bits)) - 2)
    size = (segments + 2) << bits
    for seed in itertools.count():
        spots, marks = _spots(keys, seed, bits, segments)
        order = _peeled(spots, size)
        if sum(len(k) for k, _ in order) == n:
            break
    cells = np.zeros(size, np.uint8)
    for key, spot in reversed(order):
        # The own cell is still zero, so the XOR of all three is that of the other two.
        cells[spot] = np.bitwise_xor.reduce(cells[spots[:, key]], axis=0) ^ marks[key]
    return Fuse(seed, bits, segments, cells)


def _peeled(spots: np.ndarray, size: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """Rounds of (keys, the cell each had alone)."""
    n = spots.shape[1]
    flat, owner = spots.ravel(), np.tile(np.arange(n), 3)
    degree = np.bincount(flat, minlength=size)
    # Sums of owners: where one key is left, the sum is its number.
    total = np.zeros(size, np.int64)
    np.add.at(total, flat, owner)
    order, ready = [], np.flatnonzero(degree == 1)
    while len(ready):
        key, at = np.unique(total[ready], return_index=True)
        order.append((key, ready[at]))
        touched = spots[:, key].ravel()
        np.subtract.at(degree, touched, 1)
        np.subtract.at(total, touched, np.tile(key, 3))
        touched = np.unique(touched)
        ready = touched[degree[touched] == 1]
    return order
