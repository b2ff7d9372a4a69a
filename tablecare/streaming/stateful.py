"""Per-key state on streams: recent-value baselines and error-rate drift detectors, in event-time order.

State per key is a bounded list or a few numbers, beside the rows that wait for the watermark (``intime``). So results don't depend on
chunks, files, partitions or batches.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

from tablecare.streaming.intime import in_time


def trailing_scores(recent: np.ndarray, new: np.ndarray, span: int) -> np.ndarray:
    """Distance of each new value from the mean of the last ``span`` values up to itself, in their deviations; missing values are no part of them."""
    padded = np.concatenate([np.full(span, np.nan), recent[max(0, len(recent) - span) :], new])
    out = np.empty(len(new))
    first = len(padded) - len(new)
    for start in range(0, len(new), 10_000):
        stop = min(start + 10_000, len(new))
        frames = np.lib.stride_tricks.sliding_window_view(padded[first + start - span + 1 : first + stop], span)
        here = ~np.isnan(frames)
        n = here.sum(axis=1)
        safe = np.maximum(n, 1)
        mean = np.where(here, frames, 0).sum(axis=1) / safe
        std = np.sqrt((np.where(here, frames - mean[:, None], 0) ** 2).sum(axis=1) / safe)
        score = np.abs(new[start:stop] - mean) / np.where(std > 0, std, 1)
        out[start:stop] = np.where(np.isnan(new[start:stop]), np.nan, np.where((n > 2) & (std > 0), score, 0.0))
    return out


def zscore_stream(df: DataFrame, key: str, ts: str, value: str, row_id: str, span: int = 100, cut: float = 2.5, **order) -> DataFrame:
    """Anomaly score of each value against the last ``span`` values of its key; a missing value has none and no anomaly.

    ``order`` is passed on: delay, slice_seconds and buckets.
    """

    def step(memory: tuple | None, rows: pd.DataFrame) -> tuple[tuple, pd.DataFrame]:
        recent = np.array([np.nan if x is None else x for x in memory[0]] if memory else [], float)
        new = rows["v"].to_numpy(float, na_value=np.nan)
        scores = trailing_scores(recent, new, span)
        out = pd.DataFrame({row_id: rows["id"], "anomaly_score": pd.array(scores, "Float64").astype(object), "is_anomaly": scores > cut})
        return (np.concatenate([recent, new])[-span:].tolist(),), out

    return in_time(df, key, ts, value, row_id, step, "recent array<double>", "anomaly_score double, is_anomaly boolean", **order)


def ddm_step(state: tuple, error: float, start: int = 30, warn: float = 2.0, drift: float = 3.0) -> tuple[tuple, str]:
    """Drift detection method: the error rate against its best point so far; the state restarts after a drift."""
    n, p, low_p, low_s = state
    n += 1
    p += (error - p) / n
    s = math.sqrt(max(p * (1 - p), 0.0) / n)
    if n < start:
        return (n, p, low_p, low_s), "stable"
    if p + s <= low_p + low_s:
        low_p, low_s = p, s
    level = p + s
    if level > low_p + drift * low_s:
        return (0, 0.0, math.inf, math.inf), "drift"
    return (n, p, low_p, low_s), "warning" if level > low_p + warn * low_s else "stable"


def page_hinkley_step(state: tuple, x: float, start: int = 30, delta: float = 0.005, threshold: float = 50.0, decay: float = 0.9999) -> tuple[tuple, str]:
    """Page-Hinkley on a running mean; the state restarts after a drift. State: n, mean, sum, unused."""
    n, mean, total, _ = state
    n += 1
    mean += (x - mean) / n
    total = max(0.0, decay * total + (x - mean - delta))
    if n >= start and total > threshold:
        return (0, 0.0, 0.0, 0.0), "drift"
    return (n, mean, total, 0.0), "stable"


DETECTORS = {
    "ddm": (ddm_step, (0, 0.0, math.inf, math.inf)),
    "page_hinkley": (page_hinkley_step, (0, 0.0, 0.0, 0.0)),
}


def error_drift_stream(df: DataFrame, key: str, ts: str, error: str, row_id: str, detector: str = "ddm", **order) -> DataFrame:
    """Rows at which the detector of a key warns or finds a drift. ``order`` is passed on: delay, slice_seconds and buckets."""
    if detector not in DETECTORS:
        raise ValueError(f"unknown detector {detector}; there are {', '.join(DETECTORS)}")
    one, begin = DETECTORS[detector]

    def step(memory: tuple | None, rows: pd.DataFrame) -> tuple[tuple, pd.DataFrame]:
        now, places, marks = tuple(memory) if memory else begin, [], []
        for i, e in enumerate(rows["v"].to_numpy(float, na_value=np.nan).tolist()):
            if e != e:  # a missing error says nothing
                continue
            now, mark = one(now, e)
            if mark != "stable":
                places.append(i)
                marks.append(mark)
        return (int(now[0]), *map(float, now[1:])), pd.DataFrame({row_id: rows["id"].iloc[places].array, "state": marks})

    return in_time(df, key, ts, error, row_id, step, "n bigint, a double, b double, c double", "state string", **order)
