"""Median and median absolute deviation of every rectangle, kept up while it slides instead of sorted anew.

A strip's samples get ranks. For each of its output rows, two levels of counts over ranks tell which
are in the rectangle; a step to the right puts one column in and takes one out, so it costs the
rectangle's height, and an order statistic costs the square root of the strip's samples. The median
absolute deviation is found among the values on both sides of the median by halving, not by sorting.
"""

from __future__ import annotations

import numpy as np


class Ranked:
    """Which of a strip's ranked samples lie in each output row's rectangle."""

    def __init__(self, values: np.ndarray, rows: int):
        """``values`` ascending; ``rows`` rectangles, all empty."""
        self.values, self.rows = values, np.arange(rows)
        self.each = max(1, int(np.ceil(np.sqrt(len(values)))))
        bins = -(-len(values) // self.each) if len(values) else 1
        self.fine = np.zeros((rows, bins, self.each), np.int8)
        self.coarse = np.zeros((rows, bins), np.int32)
        self.upto = self.coarse

    def move(self, row: np.ndarray, rank: np.ndarray, by: int) -> None:
        """Puts samples in (1) or takes them out (-1); each (row, rank) once."""
        at = rank // self.each
        self.fine[row, at, rank % self.each] += by
        self.coarse += by * np.bincount(row * self.coarse.shape[1] + at, minlength=self.coarse.size).reshape(self.coarse.shape)

    def settle(self) -> np.ndarray:
        """How many samples each rectangle has, to be called after moves."""
        self.upto = np.cumsum(self.coarse, axis=1)
        return self.upto[:, -1]

    def value(self, k: np.ndarray) -> np.ndarray:
        """Each rectangle's k-th least value (from 0; any value where it has fewer)."""
        at = np.minimum((self.upto <= k[:, None]).sum(1), self.coarse.shape[1] - 1)
        left = k - self.upto[self.rows, at] + self.coarse[self.rows, at]
        within = (np.cumsum(self.fine[self.rows, at], axis=1, dtype=np.int32) <= left[:, None]).sum(1)
        return self.values[np.minimum(at * self.each + within, len(self.values) - 1)]

    def middle(self, n: np.ndarray) -> np.ndarray:
        return (self.value(np.maximum(n - 1, 0) // 2) + self.value(n // 2 - (n == 0))) / 2 if len(self.values) else np.full(len(n), np.nan)

    def deviation(self, n: np.ndarray, centre: np.ndarray, k: np.ndarray) -> np.ndarray:
        """The k-th least distance to ``centre``, which has as many values below as above, for a half at each side.

        Of the k + 1 nearest values some lie at or above the middle; how many is found by halving: one more
        as long as the next value above is nearer than the last one taken below.
        """
        half = n // 2
        low, high = np.maximum(0, k + 1 - half), np.minimum(n - half, k + 1)
        while (low < high).any():
            above = (low + high) // 2  # taken above; k - above + 1 below, the farthest of which is half - (k - above) - 1
            up = self.value(np.minimum(half + above, np.maximum(n - 1, 0))) - centre
            down = centre - self.value(np.clip(half - (k - above) - 1, 0, None))
            more = (up < down) & (low < high)
            low, high = np.where(more, above + 1, low), np.where(more | (low >= high), high, above)
        up = np.where(low > 0, self.value(np.clip(half + low - 1, 0, np.maximum(n - 1, 0))) - centre, -np.inf)
        down = np.where(k + 1 > low, centre - self.value(np.clip(half - (k + 1 - low), 0, None)), -np.inf)
        return np.maximum(up, down)


def _strip(h: np.ndarray, top: int, rows: int, down: int, across: int, centre: np.ndarray, spread: np.ndarray) -> None:
    first, last = max(0, top - down), min(len(h), top + rows + down)
    part = h[first:last]
    seen = ~np.isnan(part)
    order = np.argsort(part[seen], kind="stable")
    ranks = np.full(part.shape, -1, np.int64)
    own = np.empty(len(order), np.int64)
    own[order] = np.arange(len(order))
    ranks[seen] = own
    held = Ranked(part[seen][order], rows)
    if not len(order):
        return
    padded = np.full((rows + 2 * down, h.shape[1]), -1, np.int64)
    padded[first - top + down : last - top + down] = ranks
    columns = np.lib.stride_tricks.sliding_window_view(padded, 2 * down + 1, axis=0)  # row, column, sample

    def move(c: int, by: int) -> None:
        if 0 <= c < h.shape[1]:
            row, k = np.nonzero(columns[:, c] >= 0)
            held.move(row, columns[row, c, k], by)

    for c in range(min(across, h.shape[1])):
        move(c, 1)
    for c in range(h.shape[1]):
        move(c + across, 1)
        move(c - across - 1, -1)
        n = held.settle()
        middle = held.middle(n)
        mad = (held.deviation(n, middle, np.maximum(n - 1, 0) // 2) + held.deviation(n, middle, np.maximum(n // 2 - (n == 0), 0))) / 2
        centre[top : top + rows, c] = np.where(n > 0, middle, np.nan)
        spread[top : top + rows, c] = np.where(n > 0, mad, np.nan)


#: Counts that one strip may hold.
MOST = 1 << 24


def medians_and_deviations(h: np.ndarray, down: int, across: int) -> tuple[np.ndarray, np.ndarray]:
    """Median and median absolute deviation of the measured samples in the rectangle around each sample; NaN without any.

    Strips are as high as the rectangle, 64 rows at least, less where they would hold more than ``MOST`` counts.
    """
    centre, spread = np.full(h.shape, np.nan), np.full(h.shape, np.nan)
    rows = max(1, min(max(2 * down + 1, 64), h.shape[0]))
    while rows > 1 and rows * (rows + 2 * down) * h.shape[1] > MOST:
        rows //= 2
    for top in range(0, h.shape[0], rows):
        _strip(h, top, min(rows, h.shape[0] - top), down, across, centre, spread)
    return centre, spread
