"""Word shingles of whole texts as 64-bit fingerprints, computed on the UTF-8 bytes of a batch."""

from __future__ import annotations

import numpy as np

from tablecare.llm.common import mix64, slices

_rng = np.random.Generator(np.random.PCG64(20))
_BYTE = _rng.integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BASE = 0x9E3779B97F4A7C15
_BASE_INVERSE = pow(_BASE, -1, 2**64)
_PLACE = _rng.integers(1, 2**63, 64, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_powers: dict[str, np.ndarray] = {}


def _power(n: int) -> tuple[np.ndarray, np.ndarray]:
    if "up" not in _powers or len(_powers["up"]) < n:
        size = max(1 << 16, 1 << (n - 1).bit_length())
        for name, base in (("up", _BASE), ("down", _BASE_INVERSE)):
            steps = np.full(size, base, np.uint64)
            steps[0] = 1
            _powers[name] = np.multiply.accumulate(steps)
    return _powers["up"], _powers["down"]


def forget() -> None:
    _powers.clear()


def words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Fingerprint of every word (A-Z lower-cased, split at ASCII white space) and the number of words per row."""
    n = len(data)
    if not n:
        return np.zeros(0, np.uint64), np.zeros(len(offsets) - 1, np.int64)
    blank = _SPACE[data]
    first, last = offsets[:-1], offsets[1:] - 1
    filled = offsets[1:] > offsets[:-1]
    before, after = np.empty(n, bool), np.empty(n, bool)
    before[1:], after[:-1] = blank[:-1], blank[1:]
    before[first[filled]] = True
    after[last[filled]] = True
    starts, ends = np.flatnonzero(~blank & before), np.flatnonzero(~blank & after) + 1
    up, down = _power(n + 1)
    total = np.zeros(n + 1, np.uint64)
    np.cumsum(_BYTE[_LOWER[data]] * up[:n], out=total[1:])
    marks = mix64((total[ends] - total[starts]) * down[starts])
    return marks, np.diff(np.searchsorted(starts, offsets))


def windows(marks: np.ndarray, counts: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Fingerprints of all shingles in row order, and how many each row has (a row shorter than ``width`` has its whole sequence)."""
    have = np.where(counts >= width, counts - width + 1, np.minimum(counts, 1))
    begin = np.cumsum(counts) - counts
    row = np.repeat(np.arange(len(counts)), have)
    place = np.arange(have.sum()) - np.repeat(np.cumsum(have) - have, have) + begin[row]
    long = np.minimum(counts, width)[row]
    padded = np.concatenate([marks, np.zeros(width, np.uint64)])
    value = long.astype(np.uint64) * _PLACE[63]
    for j in range(width):
        piece = padded[place + j] * _PLACE[j]
        value += piece if j == 0 else np.where(long > j, piece, np.uint64(0))
    return mix64(value), have


def sequence_keys(marks: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two fingerprints of each row's whole word sequence."""
    place = (np.arange(len(marks)) - np.repeat(np.cumsum(counts) - counts, counts)).astype(np.uint64)
    out, rows = [], counts > 0
    for k in (61, 62):
        each = mix64(marks ^ mix64(place * _PLACE[k] + _PLACE[k - 2]))
        sums = np.zeros(len(counts), np.uint64)
        if rows.any():
            sums[rows] = np.add.reduceat(each, (np.cumsum(counts) - counts)[rows])
        out.append(sums.view(np.int64))
    return out[0], out[1]


def sets(data: np.ndarray, offsets: np.ndarray, width: int) -> list[np.ndarray]:
    """Sorted distinct shingles of each row."""
    out = []
    for a, b in slices(offsets):
        part = offsets[a : b + 1]
        marks, counts = words(data[part[0] : part[-1]], part - part[0])
        value, have = windows(marks, counts, width)
        ends = np.cumsum(have)
        out += [np.unique(value[e - h : e]) for e, h in zip(ends, have)]
    return out
