"""Weighted counts of points below and left of others, for many groups at once, on numpy arrays."""

from __future__ import annotations

import numpy as np


class CountTree:
    """Points sorted by their first coordinate, with their second coordinate split bit by bit.

    ``weight_below(lo, hi, y)`` adds up the weights of the points lo to hi - 1 (in sorted order) whose second coordinate is below y,
    for all queries at once: one step per bit, each reading two prefix sums.
    """

    def __init__(self, second: np.ndarray, weight: np.ndarray, top: int):
        """``top`` is the largest value that a point or a query has."""
        self.bits = max(1, int(top).bit_length())
        self.levels = []
        for bit in range(self.bits - 1, -1, -1):
            zero = (second >> bit) & 1 == 0
            places = np.concatenate([[0], np.cumsum(zero)])
            weights = np.concatenate([[0], np.cumsum(np.where(zero, weight, 0))])
            self.levels.append((places, weights))
            order = np.argsort(~zero, kind="stable")
            second, weight = second[order], weight[order]

    def weight_below(self, lo: np.ndarray, hi: np.ndarray, y: np.ndarray) -> np.ndarray:
        total = np.zeros(len(y), dtype=np.int64)
        for level, (places, weights) in enumerate(self.levels):
            one = (y >> (self.bits - 1 - level)) & 1 == 1
            low, high, zeros = places[lo], places[hi], places[-1]
            total += np.where(one, weights[hi] - weights[lo], 0)
            lo, hi = np.where(one, zeros + lo - low, low), np.where(one, zeros + hi - high, high)
        return total


#: Groups of no more boxes are counted pair by pair, which takes less time than the tree.
SMALL = 256


def overlap_degrees(group: np.ndarray, r1: np.ndarray, r2: np.ndarray, c1: np.ndarray, c2: np.ndarray, n: np.ndarray) -> np.ndarray:
    """For each box, how many other boxes of its group share a cell with it; ``n`` is how often the box occurs."""
    out = np.empty(len(group), dtype=np.int64)
    order = np.argsort(group, kind="stable")
    group, *sides = (x[order] for x in (group, r1, r2, c1, c2, n))
    starts = np.flatnonzero(np.diff(group, prepend=group[:1] - 1))
    sizes = np.diff(starts, append=len(group))
    for at, size in zip(starts[sizes <= SMALL].tolist(), sizes[sizes <= SMALL].tolist()):
        top, bottom, left, right, often = (x[at:at + size] for x in sides)
        meet = (top[:, None] <= bottom) & (top <= bottom[:, None]) & (left[:, None] <= right) & (left <= right[:, None])
        out[order[at:at + size]] = meet @ often - 1
    large = np.repeat(sizes > SMALL, sizes)
    out[order[large]] = degrees_by_tree(group[large], *[x[large] for x in sides])
    return out


def degrees_by_tree(group: np.ndarray, r1: np.ndarray, r2: np.ndarray, c1: np.ndarray, c2: np.ndarray, n: np.ndarray) -> np.ndarray:
    """``overlap_degrees`` of groups of any size, in any order.

    Two boxes are apart when one ends before the other starts, in rows or in columns. All boxes of the group, less those apart
    in rows and those apart in columns, plus those apart in both, are the ones that meet. Coordinates are ranked first, so
    their size does not matter. Groups don't see each other: ranges of the sorted points end at the group's border.
    """
    if not len(group):
        return np.zeros(0, dtype=np.int64)
    _, group = np.unique(group, return_inverse=True)
    _, rows = np.unique(np.concatenate([r1, r2]), return_inverse=True)
    _, cols = np.unique(np.concatenate([c1, c2]), return_inverse=True)
    r1, r2, c1, c2 = rows[: len(r1)], rows[len(r1):], cols[: len(c1)], cols[len(c1):]
    height, width = int(rows.max()) + 1, int(cols.max()) + 1
    last_row, last_col = height - 1, width - 1
    total = np.bincount(group, weights=n).astype(np.int64)[group]

    def before(ends: np.ndarray, starts: np.ndarray, size: int, others: list[tuple[np.ndarray, np.ndarray]]) -> list[np.ndarray]:
        """Weights of boxes of the group with ``ends`` < ``starts``; then of those also with the second pair in this order."""
        key = group * size + ends
        order = np.argsort(key, kind="stable")
        lo, hi = np.searchsorted(key[order], group * size), np.searchsorted(key[order], group * size + starts)
        added = np.concatenate([[0], np.cumsum(n[order])])
        return [added[hi] - added[lo]] + [CountTree(there[order], n[order], last_col).weight_below(lo, hi, here) for there, here in others]

    # "starts after" is "ends before" seen from the far border
    above, above_left, above_right = before(r2, r1, height, [(c2, c1), (last_col - c1, last_col - c2)])
    under, under_left, under_right = before(last_row - r1, last_row - r2, height, [(c2, c1), (last_col - c1, last_col - c2)])
    (left,), (right,) = before(c2, c1, width, []), before(last_col - c1, last_col - c2, width, [])
    return total - above - under - left - right + above_left + above_right + under_left + under_right - 1
