"""An FM-index over a sequence of word numbers, with whole-array operations.

The text is a sequence of segments, each closed by a separator 0. Separators count as distinct
symbols in order of position, so all suffixes differ and sort within a segment's length.
"""

from __future__ import annotations

import numpy as np

SAMPLE = 16


class BitRank:
    """A bit vector with the number of ones before any position."""

    def __init__(self, bits: np.ndarray) -> None:
        n = len(bits)
        padded = np.zeros((n // 64 + 1) * 64, dtype=np.uint8)
        padded[:n] = bits
        self.words = np.packbits(padded, bitorder="little").view(np.uint64)
        self.before = np.zeros(len(self.words) + 1, dtype=np.int64)
        np.cumsum(np.bitwise_count(self.words), out=self.before[1:])
        self.ones = int(self.before[-1])

    def rank(self, at: np.ndarray) -> np.ndarray:
        block, bit = at >> 6, (at & 63).astype(np.uint64)
        low = (np.uint64(1) << bit) - np.uint64(1)
        return self.before[block] + np.bitwise_count(self.words[block] & low)

    def get(self, at: np.ndarray) -> np.ndarray:
        return (self.words[at >> 6] >> (at & 63).astype(np.uint64)) & np.uint64(1) != 0


class WaveletTree:
    """A wavelet tree in its level-by-level form: symbols split by one bit after another, zeros first."""

    def __init__(self, symbols: np.ndarray, n_symbols: int) -> None:
        self.shifts = list(range(max(1, (n_symbols - 1).bit_length()) - 1, -1, -1))
        self.levels, self.zeros = [], []
        for shift in self.shifts:
            bits = (symbols >> shift) & 1
            self.levels.append(BitRank(bits))
            self.zeros.append(len(symbols) - self.levels[-1].ones)
            symbols = np.concatenate([symbols[bits == 0], symbols[bits == 1]])
        every = np.arange(n_symbols)
        self.first = self._descend(every, np.zeros(n_symbols, dtype=np.int64))

    def _descend(self, symbols: np.ndarray, at: np.ndarray) -> np.ndarray:
        for shift, level, zeros in zip(self.shifts, self.levels, self.zeros, strict=True):
            ones = level.rank(at)
            at = np.where((symbols >> shift) & 1, zeros + ones, at - ones)
        return at

    def rank(self, symbols: np.ndarray, at: np.ndarray) -> np.ndarray:
        """How often each symbol stands before its position."""
        return self._descend(symbols, at) - self.first[symbols]

    def read(self, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The symbol at each position, and its rank there."""
        symbols = np.zeros(len(at), dtype=np.int64)
        for shift, level, zeros in zip(self.shifts, self.levels, self.zeros, strict=True):
            bits, ones = level.get(at), level.rank(at)
            symbols |= bits.astype(np.int64) << shift
            at = np.where(bits, zeros + ones, at - ones)
        return symbols, at - self.first[symbols]


def suffix_order(text: np.ndarray) -> np.ndarray:
    """Start of each suffix in sorted order, by prefix doubling."""
    n = len(text)
    gaps = text == 0
    n_gaps = int(gaps.sum())
    rank = text.astype(np.int64) + n_gaps
    rank[gaps] = np.arange(n_gaps)
    step, width = 1, int(rank.max(initial=0)) + 2
    while True:
        after = np.zeros(n, dtype=np.int64)
        after[:-step] = rank[step:] + 1
        key = rank * width + after
        order = np.argsort(key, kind="stable")
        ordered = key[order]
        new = np.empty(n, dtype=np.int64)
        new[order] = np.cumsum(np.concatenate([[0], ordered[1:] != ordered[:-1]]))
        rank, step, width = new, step * 2, n + 2
        if n == 0 or rank[order[-1]] == n - 1:
            return order
        if step >= n:
            raise ValueError("the text does not end with a separator")


class FMIndex:
    """Counts and locates runs of word numbers (from 1) in a text that ends with a separator."""

    def __init__(self, text: np.ndarray, n_symbols: int, sample: int = SAMPLE) -> None:
        suffixes = suffix_order(text)
        before = text[suffixes - 1]
        self.tree = WaveletTree(before, n_symbols)
        self.starts = np.concatenate([[0], np.cumsum(np.bincount(text, minlength=n_symbols))])
        kept = (suffixes % sample == 0) | (before == 0)
        self.marks, self.samples = BitRank(kept), suffixes[kept]

    def search(self, patterns: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Backward search of patterns of one length: number, first and end row of those that occur."""
        which, last = np.arange(len(patterns)), patterns[:, -1]
        low, high = self.starts[last], self.starts[last + 1]
        for column in range(patterns.shape[1] - 2, -1, -1):
            alive = high > low
            which, low, high = which[alive], low[alive], high[alive]
            symbols = patterns[which, column]
            low = self.starts[symbols] + self.tree.rank(symbols, low)
            high = self.starts[symbols] + self.tree.rank(symbols, high)
        alive = high > low
        return which[alive], low[alive], high[alive]

    def locate(self, rows: np.ndarray) -> np.ndarray:
        """Text positions of rows: steps back through the text to a sampled suffix."""
        out = np.zeros(len(rows), dtype=np.int64)
        open_rows, steps = np.arange(len(rows)), 0
        while len(open_rows):
            at = rows[open_rows]
            known = self.marks.get(at)
            done = open_rows[known]
            out[done] = self.samples[self.marks.rank(rows[done])] + steps
            open_rows = open_rows[~known]
            symbols, ranks = self.tree.read(rows[open_rows])
            rows = rows.copy() if steps == 0 else rows
            rows[open_rows] = self.starts[symbols] + ranks
            steps += 1
        return out
