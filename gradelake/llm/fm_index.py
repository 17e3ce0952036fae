"""An FM-index over one sequence of small integers, for many patterns at once (numpy)."""

from __future__ import annotations

import numpy as np


def suffix_array(symbols: np.ndarray) -> np.ndarray:
    """Start positions of all suffixes in order; ranks double in length until all differ."""
    rank = np.unique(symbols, return_inverse=True)[1].astype(np.int64)
    n, step = len(rank), 1
    while True:
        after = np.full(n, -1, dtype=np.int64)
        after[: max(0, n - step)] = rank[step:]
        key = rank * (n + 1) + after + 1
        order = np.argsort(key, kind="stable")
        ordered = key[order]
        fresh = np.concatenate([[0], np.cumsum(ordered[1:] != ordered[:-1])])
        rank = np.empty(n, dtype=np.int64)
        rank[order] = fresh
        if fresh[-1] == n - 1:
            return order
        step *= 2


class WaveletTree:
    """rank(c, i) = occurrences of c in the first i symbols; one bit vector per level, most significant bit first."""

    def __init__(self, symbols: np.ndarray, width: int):
        self.levels = []
        for bit in range(width - 1, -1, -1):
            ones = (symbols >> bit) & 1
            before = np.concatenate([[0], np.cumsum(ones)]).astype(np.int64)
            zeros = len(symbols) - int(before[-1])
            self.levels.append((bit, before, zeros))
            symbols = np.concatenate([symbols[ones == 0], symbols[ones == 1]])

    def rank(self, c: np.ndarray, i: np.ndarray) -> np.ndarray:
        lo, hi = np.zeros_like(i), i.copy()
        for bit, before, zeros in self.levels:
            one = ((c >> bit) & 1).astype(bool)
            a, b = before[lo], before[hi]
            lo, hi = np.where(one, zeros + a, lo - a), np.where(one, zeros + b, hi - b)
        return hi - lo


class FMIndex:
    """Index of ``symbols``: ints of 1 or more, and 0 between pieces. Inside, all are one higher and a single 0 ends them."""

    def __init__(self, symbols: np.ndarray, sample: int = 16):
        symbols = np.concatenate([symbols + 1, [0]]).astype(np.int64)
        order = suffix_array(symbols)
        top = int(symbols.max())
        self.bwt = symbols[order - 1]
        self.tree = WaveletTree(self.bwt, max(1, top.bit_length()))
        self.first = np.concatenate([[0], np.cumsum(np.bincount(symbols, minlength=top + 1))]).astype(np.int64)
        self.top = top
        self.sampled = order % sample == 0
        self.sampled_before = np.concatenate([[0], np.cumsum(self.sampled)])
        self.places = order[self.sampled]

    def search(self, patterns: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Suffix ranges [lo, hi) of all patterns (rows, padded at the right), by backward search."""
        lo, hi = np.zeros(len(patterns), dtype=np.int64), np.full(len(patterns), len(self.bwt), dtype=np.int64)
        for step in range(patterns.shape[1] if len(patterns) else 0):
            at = lengths - 1 - step
            live = np.flatnonzero((at >= 0) & (lo < hi))
            c = patterns[live, at[live]] + 1
            known = c <= self.top
            hi[live[~known]] = lo[live[~known]]
            live, c = live[known], c[known]
            lo[live] = self.first[c] + self.tree.rank(c, lo[live])
            hi[live] = self.first[c] + self.tree.rank(c, hi[live])
        return lo, np.maximum(lo, hi)

    def locate(self, rows: np.ndarray) -> np.ndarray:
        """Text positions of suffix rows: step back through the text to the next sampled position."""
        out, steps, rows = np.empty(len(rows), dtype=np.int64), np.zeros(len(rows), dtype=np.int64), rows.copy()
        open_ = np.arange(len(rows))
        while len(open_):
            done = self.sampled[rows[open_]]
            hit = open_[done]
            out[hit] = self.places[self.sampled_before[rows[hit]]] + steps[hit]
            open_ = open_[~done]
            c = self.bwt[rows[open_]]
            rows[open_] = self.first[c] + self.tree.rank(c, rows[open_])
            steps[open_] += 1
        return out
