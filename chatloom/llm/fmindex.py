"""An FM-index over word numbers: suffix array, wavelet matrix, batched backward search and sampled location."""

from __future__ import annotations

import numpy as np


def suffix_array(text: np.ndarray) -> np.ndarray:
    """Suffix order by prefix doubling; ends count as smaller than any word."""
    n = len(text)
    rank = np.unique(text, return_inverse=True)[1].astype(np.int64) + 1
    step = 1
    while True:
        following = np.zeros(n, np.int64)
        following[: max(0, n - step)] = rank[step:]
        key = rank * (n + 2) + following
        order = np.argsort(key, kind="stable")
        sorted_key = key[order]
        fresh = np.empty(n, np.int64)
        fresh[order] = np.concatenate(([1], 1 + np.cumsum(sorted_key[1:] != sorted_key[:-1])))
        rank = fresh
        if step >= n or rank.max() == n:
            return order
        step *= 2


class WaveletMatrix:
    """Rank and access on a sequence of small numbers, one bit level after the other."""

    def __init__(self, values: np.ndarray, sigma: int) -> None:
        self.bits = max(1, int(sigma - 1).bit_length())
        self.ones: list[np.ndarray] = []
        self.zeros: list[int] = []
        current = values
        for level in range(self.bits - 1, -1, -1):
            bit = (current >> level) & 1
            self.ones.append(np.concatenate(([0], np.cumsum(bit))).astype(np.int32))
            self.zeros.append(int(len(bit) - bit.sum()))
            current = np.concatenate((current[bit == 0], current[bit == 1]))

    def rank(self, symbols: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """Occurrences of each symbol before each end."""
        lo, hi = np.zeros(len(ends), np.int64), ends.astype(np.int64)
        for level, ones, zeros in zip(range(self.bits - 1, -1, -1), self.ones, self.zeros, strict=True):
            one = ((symbols >> level) & 1).astype(bool)
            a, b = ones[lo], ones[hi]
            lo, hi = np.where(one, zeros + a, lo - a), np.where(one, zeros + b, hi - b)
        return hi - lo

    def access_rank(self, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Symbol at each position and its occurrences before that position."""
        lo, hi = np.zeros(len(at), np.int64), at.astype(np.int64)
        symbols = np.zeros(len(at), np.int64)
        for ones, zeros in zip(self.ones, self.zeros, strict=True):
            a, b = ones[lo], ones[hi]
            one = (ones[hi + 1] - b).astype(bool)
            symbols = symbols * 2 + one
            lo, hi = np.where(one, zeros + a, lo - a), np.where(one, zeros + b, hi - b)
        return symbols, hi - lo


class FMIndex:
    """Index of a sequence of numbers from 1 to ``sigma - 1``; 0 separates texts and is never searched."""

    def __init__(self, text: np.ndarray, sigma: int, sample: int = 8) -> None:
        # Numbers move up by one to make room for an end that is smaller than all and occurs once, as stepping back needs.
        text, sigma = np.concatenate((text + 1, [0])).astype(np.int64), sigma + 1
        order = suffix_array(text)
        self.size = len(text)
        bwt = text[order - 1]
        self.first = np.concatenate(([0], np.cumsum(np.bincount(text, minlength=sigma)))).astype(np.int64)
        self.tree = WaveletMatrix(bwt, sigma)
        self.sampled = order % sample == 0
        self.rank_of_sample = np.cumsum(self.sampled) - 1
        self.positions = order[self.sampled]

    def search(self, patterns: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Suffix ranges of equally long patterns, a row each, found backwards from their last word."""
        lo, hi = np.zeros(len(patterns), np.int64), np.full(len(patterns), self.size, np.int64)
        for column in range(patterns.shape[1] - 1, -1, -1):
            word = patterns[:, column] + 1
            base = self.first[word]
            lo, hi = base + self.tree.rank(word, lo), base + self.tree.rank(word, hi)
        return lo, np.maximum(lo, hi)

    def locate(self, rows: np.ndarray) -> np.ndarray:
        """Text positions of suffix rows: steps back to the next sampled one."""
        rows, steps = rows.astype(np.int64).copy(), np.zeros(len(rows), np.int64)
        open_rows = np.flatnonzero(~self.sampled[rows])
        while len(open_rows):
            symbol, before = self.tree.access_rank(rows[open_rows])
            rows[open_rows] = self.first[symbol] + before
            steps[open_rows] += 1
            open_rows = open_rows[~self.sampled[rows[open_rows]]]
        return self.positions[self.rank_of_sample[rows]] + steps
