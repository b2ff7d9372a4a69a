"""Order statistics of many ranges of a sequence at once: a wavelet matrix over the ranks of the values."""

from __future__ import annotations

import numpy as np


class Ranges:
    """k-th smallest value, and number of values below a bound, of the places [left, right) of ``values``; each call answers a whole array of ranges.

    The ranks of the values are split bit by bit, highest first, zeros before ones in their order, so a range stays a range on every level.
    """

    def __init__(self, values: np.ndarray):
        self.kinds, ranks = np.unique(values, return_inverse=True)
        self.levels: list[tuple[int, np.ndarray, int]] = []
        for bit in range(max(len(self.kinds) - 1, 0).bit_length() - 1, -1, -1):
            one = (ranks >> bit) & 1
            before = np.concatenate([[0], np.cumsum(1 - one)]).astype(np.int64)
            self.levels.append((bit, before, int(before[-1])))
            ranks = np.concatenate([ranks[one == 0], ranks[one == 1]])

    def kth(self, left: np.ndarray, right: np.ndarray, k: np.ndarray) -> np.ndarray:
        """The value with k smaller or equal ones before it in order; ranges may not be empty and k lies inside."""
        left, right, k, rank = left.copy(), right.copy(), k.copy(), np.zeros(len(k), np.int64)
        for bit, before, zeros in self.levels:
            a, b = before[left], before[right]
            high = k >= b - a
            rank |= high.astype(np.int64) << bit
            k = np.where(high, k - (b - a), k)
            left = np.where(high, zeros + left - a, a)
            right = np.where(high, zeros + right - b, b)
        return self.kinds[rank] if len(self.kinds) else np.zeros(0)

    def below(self, left: np.ndarray, right: np.ndarray, bound: np.ndarray, inclusive: bool = False) -> np.ndarray:
        """How many values of each range lie below its bound (or at it, if inclusive)."""
        rank = np.searchsorted(self.kinds, bound, "right" if inclusive else "left")
        whole = rank >= len(self.kinds)
        left0, right0 = left, right
        found = np.zeros(len(bound), np.int64)
        for bit, before, zeros in self.levels:
            a, b = before[left], before[right]
            high = ((rank >> bit) & 1) == 1
            found += np.where(high, b - a, 0)
            left = np.where(high, zeros + left - a, a)
            right = np.where(high, zeros + right - b, b)
        return np.where(whole, right0 - left0, found)


def moments(values: np.ndarray, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Mean and variance of each range. A range is put together from stretches of 1, 2, 4, ... values, one for each bit of its length, so
    nothing is ever taken away from a sum and a far value elsewhere costs no digits."""
    mean, spread = values.astype(float), np.zeros(len(values))  # of the stretch of 2**j values from each place on
    at, length = left.astype(np.int64).copy(), (right - left).astype(np.int64)
    n, middle, squares = np.zeros(len(at)), np.zeros(len(at)), np.zeros(len(at))
    step = 1
    while step <= length.max(initial=0):
        on = np.flatnonzero(length & step)
        total, gap = n[on] + step, mean[at[on]] - middle[on]
        squares[on] += spread[at[on]] + gap * gap * n[on] * step / total
        middle[on] += gap * step / total
        n[on] = total
        at[on] += step
        if len(mean) <= step:
            break
        gap = mean[step:] - mean[:-step]
        spread = spread[:-step] + spread[step:] + gap * gap * step / 2
        mean = mean[:-step] + gap / 2
        step *= 2
    return middle, squares / np.maximum(n, 1)


QUANTILES = {"p25": 0.25, "median": 0.5, "p75": 0.75, "p95": 0.95, "p99": 0.99}
STATISTICS = ("count", "sum", "mean", "std", "min", "max", "range", *QUANTILES, "iqr", "outlier_count", "outlier_ratio")


def statistics(values: np.ndarray, left: np.ndarray, right: np.ndarray, ranges: Ranges | None = None) -> dict[str, np.ndarray]:
    """The 15 statistics of each range of ``values`` (no missing ones); those of an empty range are NaN, its counts 0.

    Quantiles interpolate between neighbours; outliers lie more than 1.5 interquartile ranges outside the quartiles.
    """
    count = right - left
    some = count > 0
    out = {name: np.full(len(left), np.nan) for name in STATISTICS}
    out["count"], out["outlier_count"] = count, np.zeros(len(left), np.int64)
    if not some.any():
        return out
    ranges = ranges or Ranges(values)
    a, b, n = left[some], right[some], count[some]
    mean, variance = moments(values, a, b)
    put = lambda name, x: out[name].__setitem__(some, np.asarray(x, out[name].dtype))
    put("sum", mean * n)
    put("mean", mean)
    put("min", ranges.kth(a, b, np.zeros(len(a), np.int64)))
    put("max", ranges.kth(a, b, n - 1))
    put("range", out["max"][some] - out["min"][some])
    put("std", np.where(out["range"][some] > 0, np.sqrt(variance), 0.0))
    for name, p in QUANTILES.items():
        at = p * (n - 1)
        k = np.floor(at).astype(np.int64)
        low, high = ranges.kth(a, b, k), ranges.kth(a, b, np.minimum(k + 1, n - 1))
        put(name, low + (high - low) * (at - k))
    q1, q3 = out["p25"][some], out["p75"][some]
    put("iqr", q3 - q1)
    reach = 1.5 * (q3 - q1)
    put("outlier_count", ranges.below(a, b, q1 - reach) + n - ranges.below(a, b, q3 + reach, inclusive=True))
    put("outlier_ratio", out["outlier_count"][some] / n)
    return out
