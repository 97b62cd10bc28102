"""Hash tables in numpy: 64-bit keys to 32-bit values, looked up for whole arrays at once."""

from __future__ import annotations

import numpy as np

_MIX = np.uint64(0x9E3779B97F4A7C15)


class HashTable64:
    """Open addressing with linear probes; absent keys give -1. Keys must be distinct."""

    def __init__(self, keys: np.ndarray, values: np.ndarray) -> None:
        keys, values = keys.astype(np.uint64), values.astype(np.int32)
        bits = max(4, int(np.ceil(np.log2(max(1, len(keys)) * 3))))
        self.shift, self.mask = np.uint64(64 - bits), (1 << bits) - 1
        self.keys, self.values = np.zeros(1 << bits, np.uint64), np.full(1 << bits, -1, np.int32)
        left, at = np.arange(len(keys)), (keys * _MIX >> self.shift).astype(np.int64)
        while len(left):
            free = self.values[at] < 0
            slot, first = np.unique(at[free], return_index=True)
            won = left[free][first]
            self.keys[slot], self.values[slot] = keys[won], values[won]
            done = np.zeros(len(keys), bool)
            done[won] = True
            stay = ~done[left]
            left, at = left[stay], at[stay]
            taken = self.values[at] >= 0
            at = np.where(taken, (at + 1) & self.mask, at)

    def get(self, keys: np.ndarray) -> np.ndarray:
        shape, keys = keys.shape, keys.astype(np.uint64, copy=False).ravel()
        at = (keys * _MIX >> self.shift).astype(np.int64)
        found = self.values[at]
        open_ = np.flatnonzero((found >= 0) & (self.keys[at] != keys))
        while len(open_):
            at[open_] = (at[open_] + 1) & self.mask
            found[open_] = self.values[at[open_]]
            open_ = open_[(found[open_] >= 0) & (self.keys[at[open_]] != keys[open_])]
        return found.reshape(shape)
