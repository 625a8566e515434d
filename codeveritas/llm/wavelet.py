"""A wavelet tree over an integer sequence, level by level, answering many range queries at once."""

from __future__ import annotations

import numpy as np


class WaveletTree:
    """Order statistics of ranges of a sequence of values from 0 to below `limit`.

    Level by level, from the highest bit down, the values with a zero bit stand before those with a
    one, each in their former order; the prefix counts of zeros lead a range to its part below.
    """

    def __init__(self, values: np.ndarray, limit: int):
        self.bits = max(int(limit - 1).bit_length(), 1)
        self.limit = limit
        self.zeros, self.split = [], []
        row = values.astype(np.int64)
        for bit in range(self.bits - 1, -1, -1):
            zero = (row >> bit & 1) == 0
            before = np.zeros(len(row) + 1, np.int64)
            np.cumsum(zero, out=before[1:])
            self.zeros.append(before)
            self.split.append(int(before[-1]))
            row = np.concatenate((row[zero], row[~zero]))

    def below(self, left: np.ndarray, right: np.ndarray, bound: np.ndarray) -> np.ndarray:
        """How many values of [left, right) are smaller than `bound`."""
        out = np.where(bound >= self.limit, right - left, 0)
        bound = np.minimum(bound, self.limit - 1)
        left, right = np.where(out > 0, 0, left), np.where(out > 0, 0, right)
        for level, bit in enumerate(range(self.bits - 1, -1, -1)):
            before, split = self.zeros[level], self.split[level]
            l0, r0 = before[left], before[right]
            one = (bound >> bit & 1) == 1
            out = out + np.where(one, r0 - l0, 0)
            left, right = np.where(one, left - l0 + split, l0), np.where(one, right - r0 + split, r0)
        return out

    def smallest(self, left: np.ndarray, right: np.ndarray, k: np.ndarray) -> np.ndarray:
        """The k-th smallest value of [left, right), from 0; ranges must hold more than k values."""
        value = np.zeros(len(left), np.int64)
        for level, bit in enumerate(range(self.bits - 1, -1, -1)):
            before, split = self.zeros[level], self.split[level]
            l0, r0 = before[left], before[right]
            one = k >= r0 - l0
            value = value | (one.astype(np.int64) << bit)
            k = np.where(one, k - (r0 - l0), k)
            left, right = np.where(one, left - l0 + split, l0), np.where(one, right - r0 + split, r0)
        return value

    def successor(self, left: np.ndarray, right: np.ndarray, bound: np.ndarray) -> np.ndarray:
        """The smallest value of [left, right) that is at least `bound`; -1 where there is none."""
        k = self.below(left, right, bound)
        some = k < right - left
        out = np.full(len(left), -1, np.int64)
        out[some] = self.smallest(left[some], right[some], k[some])
        return out
