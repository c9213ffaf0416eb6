"""Order statistics over all pairs of a series without holding the pairs.

A merge sort of runs counts the pairs i < j with x_i <= x_j, which gives
Kendall's S, and, on y - s t, how many pair slopes are at most s. The k-th slope
is found by random brackets: pairs drawn inside the current bracket propose a
narrower one around the wanted rank, counting confirms it, and when few pairs are
left inside, the flips between the two orders list them. Memory grows with the
length of a series, time with n log n and the brackets.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

#: Pairs drawn for a bracket; those that fall inside must be this many at least to propose one.
DRAWS, ENOUGH = 200_000, 400
#: A bracket is listed once it holds at most this many pairs for each value, or this many at all.
LISTED, LISTED_AT_LEAST = 8, 50_000
#: Series with at most this many pairs are worked on by their pairs, many series at once.
SMALL = 1 << 17


def _runs(x: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, int]]:
    """Levels of a merge sort of each row: (order, is in the right run, run length), blocks along the last axis.

    ``order`` has places in the row, sorted by value inside each block of two
    runs; equal values keep their order, so left ones come first.
    """
    rows, n = x.shape
    size = 1 << max(0, (n - 1).bit_length())
    filled = np.full((rows, size), np.nan)
    filled[:, :n] = x
    order = np.broadcast_to(np.arange(size), (rows, size)).copy()
    run = 1
    while run < size:
        blocks = order.reshape(rows, -1, 2 * run)
        values = np.take_along_axis(filled, order, axis=1).reshape(blocks.shape)
        inside = np.argsort(values, axis=2, kind="stable")
        order = np.take_along_axis(blocks, inside, axis=2).reshape(rows, size)
        yield order.reshape(blocks.shape), inside >= run, run
        run *= 2


def pairs_in_order(x: np.ndarray) -> np.ndarray:
    """Pairs i < j with x_i <= x_j in each row; NaN takes part in none."""
    total = np.zeros(len(x), dtype=np.int64)
    there = np.isfinite(x)
    pad = np.zeros((len(x), (1 << max(0, (x.shape[1] - 1).bit_length())) + 0), dtype=bool)
    pad[:, : x.shape[1]] = there
    for order, right, _ in _runs(x):
        known = np.take_along_axis(pad, order.reshape(len(x), -1), axis=1).reshape(order.shape)
        lefts = np.cumsum(known & ~right, axis=2)
        total += (lefts * (known & right)).sum(axis=(1, 2))
    return total


def listed_pairs(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places (a, b), a < b, of all pairs of one row with x_a <= x_b; the row has no NaN."""
    a, b = [], []
    n = len(x)
    for order, right, _ in _runs(x[None, :]):
        order, right = order[0], right[0]
        known = order < n
        lefts = np.cumsum(known & ~right, axis=1)
        at, place = np.nonzero(known & right)
        k = lefts[at, place]
        # the left places of each block in order, block after block
        left_rows, left_cols = np.nonzero(known & ~right)
        first = np.searchsorted(left_rows, np.arange(len(order)))
        b.append(np.repeat(order[at, place], k))
        step = np.arange(k.sum()) - np.repeat(np.cumsum(k) - k, k)
        a.append(order[left_rows, left_cols][np.repeat(first[at], k) + step] if len(left_rows) else np.zeros(0, dtype=np.int64))
    return (np.concatenate(a), np.concatenate(b)) if a else (np.zeros(0, dtype=np.int64),) * 2


def tie_sizes(y: np.ndarray) -> np.ndarray:
    """Sizes of the groups of equal values of each row, at one place of each group; zero elsewhere."""
    s = np.sort(y, axis=1)
    new = np.ones(s.shape, dtype=bool)
    new[:, 1:] = s[:, 1:] != s[:, :-1]
    new &= np.isfinite(s)
    group = np.cumsum(new, axis=1)  # 0 before the first value
    sizes = np.zeros((len(y), y.shape[1] + 1))
    np.add.at(sizes, (np.broadcast_to(np.arange(len(y))[:, None], group.shape), np.where(np.isfinite(s), group, 0)), 1.0)
    return sizes[:, 1:]


def kendall(y: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """S, its variance with ties, and the number of values of each row."""
    k = tie_sizes(y)
    n = k.sum(axis=1)
    tied = (k * (k - 1) / 2).sum(axis=1)
    s = 2.0 * pairs_in_order(y) - tied - n * (n - 1) / 2
    return s, (n * (n - 1) * (2 * n + 5) - (k * (k - 1) * (2 * k + 5)).sum(axis=1)) / 18, n


class PairSlopes:
    """Slopes of all pairs of each row of ``y`` at times ``t``: their number, and the one of any rank."""

    def __init__(self, y: np.ndarray, t: np.ndarray, seed: int = 0):
        self.y, self.t, self.seed = y, np.asarray(t, dtype=float), seed
        n = np.isfinite(y).sum(axis=1)
        self.count = n * (n - 1) // 2
        self.small = y.shape[1] * (y.shape[1] - 1) // 2 <= SMALL
        if self.small:
            i, j = np.triu_indices(y.shape[1], 1)
            self.ordered = np.sort((y[:, j] - y[:, i]) / (self.t[j] - self.t[i]), axis=1)

    def at(self, rank: np.ndarray) -> np.ndarray:
        """The slope of each row's 0-based rank; NaN where there is none."""
        rank = np.asarray(rank)
        there = (rank >= 0) & (rank < self.count)
        if self.small:
            if not self.ordered.shape[1]:
                return np.full(len(rank), np.nan)
            found = np.take_along_axis(self.ordered, np.where(there, rank, 0)[:, None], axis=1)[:, 0]
            return np.where(there, found, np.nan)
        out = np.full(len(rank), np.nan)
        for row in np.flatnonzero(there):
            ok = np.isfinite(self.y[row])
            out[row] = ranked_slope(self.y[row][ok], self.t[ok], int(rank[row]), self.seed)
        return out

    def median(self) -> np.ndarray:
        low, high = (self.count - 1) // 2, self.count // 2
        a = self.at(low)
        return np.where(low == high, a, (a + self.at(high)) / 2)


def _at_most(y: np.ndarray, t: np.ndarray, s: float) -> int:
    """Pairs whose slope is at most s."""
    return int(pairs_in_order((s * t - y)[None, :])[0])


def ranked_slope(y: np.ndarray, t: np.ndarray, rank: int, seed: int = 0) -> float:
    """Slope of a 0-based rank among all pairs of one series; times ascend."""
    n = len(y)
    rng = np.random.default_rng([seed, n, rank])
    steep = float(np.ptp(y)) / float(np.diff(t).min())
    low, high = np.nextafter(-steep, -np.inf) - 1e-300, steep
    below, upto = 0, n * (n - 1) // 2  # pairs at most low, at most high
    while upto - below > max(LISTED * n, LISTED_AT_LEAST):
        i = rng.integers(0, n - 1, DRAWS)
        j = rng.integers(0, n, DRAWS)
        i, j = np.minimum(i, j), np.maximum(i, j)
        some = (y[j] - y[i])[i < j] / (t[j] - t[i])[i < j]
        some = np.sort(some[(some > low) & (some <= high)])
        if len(some) >= ENOUGH:
            want, slack = (rank + 1 - below) / (upto - below) * len(some), 3 * np.sqrt(len(some))
            proposed = [some[int(np.clip(want - slack, 0, len(some) - 1))], some[int(np.clip(want + slack, 0, len(some) - 1))]]
        else:
            proposed = [low / 2 + high / 2]
        moved = False
        for s in proposed:
            if not low < s < high:
                continue
            c = _at_most(y, t, s)
            if c <= rank and s > low:
                low, below, moved = s, c, True
            elif c > rank and s < high:
                high, upto, moved = s, c, True
        if not moved:  # equal slopes fill the bracket: it is the drawn one if the rank lies among those equal to it
            middle = float(some[len(some) // 2]) if len(some) >= ENOUGH else low / 2 + high / 2
            width = max(abs(middle) * 1e-13, 1e-300)
            under, at_it = _at_most(y, t, middle - width), _at_most(y, t, middle + width)
            if under <= rank < at_it:
                return middle
            edge, c = (middle + width, at_it) if at_it <= rank else (middle - width, under)
            if not low < edge < high:
                break  # nothing lies between: the bracket is listed as it is
            low, below, high, upto = (edge, c, high, upto) if c <= rank else (low, below, edge, c)
    # pairs inside the bracket swap places between the orders of y - low t and y - high t
    order = np.lexsort((-t, y - low * t))
    a, b = listed_pairs((high * t - y)[order])
    i, j = np.minimum(order[a], order[b]), np.maximum(order[a], order[b])
    inside = (y[j] - y[i]) / (t[j] - t[i])
    k = min(max(rank - below, 0), len(inside) - 1)
    return float(np.partition(inside, k)[k])
