"""Trailing and sliding statistics, and counts, against plain versions."""

import datetime
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tablecare.functions.ranges import STATISTICS, Ranges, statistics
from tablecare.operators.windows import trailing_counts
from tablecare.streaming import windows as ws


def plain(x):
    if not len(x):
        return {n: 0 if n in ("count", "outlier_count") else None for n in STATISTICS}
    q = dict(zip(("p25", "median", "p75", "p95", "p99"), np.percentile(x, [25, 50, 75, 95, 99])))
    iqr = q["p75"] - q["p25"]
    far = sum(v < q["p25"] - 1.5 * iqr or v > q["p75"] + 1.5 * iqr for v in x)
    return {"count": len(x), "sum": sum(x), "mean": np.mean(x), "std": np.std(x), "min": min(x), "max": max(x), "range": max(x) - min(x), **q, "iqr": iqr, "outlier_count": far, "outlier_ratio": far / len(x)}


def same(got, want):
    return got is None if want is None else got == pytest.approx(want, rel=1e-9, abs=1e-9)


@pytest.mark.parametrize("kinds", [1, 2, 3, 8, 9, 1000])
def test_ranges_equal_sorting(kinds):
    rng = np.random.default_rng(kinds)
    values = rng.integers(0, kinds, 200).astype(float)
    ranges = Ranges(values)
    left = rng.integers(0, 200, 500)
    right = np.minimum(left + rng.integers(1, 80, 500), 200)
    k = rng.integers(0, 10**6, 500) % (right - left)
    assert ranges.kth(left, right, k).tolist() == [sorted(values[a:b])[i] for a, b, i in zip(left, right, k)]
    bound = rng.uniform(-1, kinds + 1, 500).round()
    assert ranges.below(left, right, bound).tolist() == [(values[a:b] < x).sum() for a, b, x in zip(left, right, bound)]
    assert ranges.below(left, right, bound, True).tolist() == [(values[a:b] <= x).sum() for a, b, x in zip(left, right, bound)]
    found = statistics(values * 1e6, left, right)
    for i in range(0, 500, 25):
        want = plain(values[left[i] : right[i]] * 1e6)
        assert all(same(found[s][i], want[s]) for s in STATISTICS)
    assert statistics(np.zeros(0), np.array([0]), np.array([0]))["count"].tolist() == [0]


@pytest.mark.parametrize("blocks", [1, 6])
def test_trailing_equals_plain_windows_and_keeps_rows_without_a_time(spark, blocks):
    random.seed(4)
    rows = [(i, random.choice(["a", "b", None]), random.choice([random.randint(0, 900), 300, 301]), random.choice([None, 5.0, random.gauss(0, 9), 1e9])) for i in range(300)]
    rows += [(1000, "a", None, 3.0), (1001, None, None, None), (1002, "c", -77, None)]
    df = spark.createDataFrame([(i, k, None if t is None else datetime.datetime(2024, 1, 1) + datetime.timedelta(seconds=t), v) for i, k, t, v in rows], "id long, k string, ts timestamp, v double")
    sizes = {"s": 10, "l": 60}
    got = {r.id: r.asDict() for r in ws.trailing(df, "ts", "v", sizes, ["k"], blocks=blocks).collect()}
    assert len(got) == len(rows)
    for i, k, t, v in rows:
        assert got[i]["v"] == v
        for name, seconds in sizes.items():
            if t is None:
                assert all(got[i][f"{s}_{name}"] is None for s in STATISTICS)
                continue
            want = plain([x for _, k2, t2, x in rows if k2 == k and t2 is not None and t - seconds <= t2 <= t and x is not None])
            for s in STATISTICS:
                assert same(got[i][f"{s}_{name}"], want[s]), (i, s, name)


def test_trailing_counts_keep_calls_without_a_time(spark):
    df = spark.createDataFrame([("a", "2024-01-01 00:00:00"), ("a", "2024-01-01 00:00:30"), ("a", None), (None, "2024-01-01 00:00:00")], "k string, at string").withColumn("ts", F.col("at").cast("timestamp"))
    got = sorted(((r.k, r["at"], r.calls) for r in trailing_counts(df, "k", "ts", 60).collect()), key=str)
    assert got == sorted([("a", "2024-01-01 00:00:00", 1), ("a", "2024-01-01 00:00:30", 2), ("a", None, None), (None, "2024-01-01 00:00:00", None)], key=str)


def test_sliding_windows_merge_their_panes(spark):
    rng = np.random.default_rng(2)
    rows = [(float(t), float(v)) for t, v in zip(rng.integers(0, 7200, 4000), rng.normal(50, 10, 4000))] + [(100.0, 1e4)] * 5 + [(200.0, None)]
    df = spark.createDataFrame(rows, "t double, v double").withColumn("ts", F.timestamp_micros((F.col("t") * 1e6 + 1_704_067_200_000_000).cast("long")))
    got = ws.window_statistics(df, "ts", "v", "30 minutes", "10 minutes").collect()
    assert len(got) == 14
    for r in got:
        start = r.window_start.replace(tzinfo=datetime.timezone.utc).timestamp() - 1_704_067_200
        x = np.sort([v for t, v in rows if v is not None and start <= t < start + 1800])
        want = plain(x)
        assert r["count"] == len(x) and all(r[s] == pytest.approx(want[s]) for s in ("sum", "mean", "std", "min", "max", "range"))
        for q, p in (("p25", 0.25), ("median", 0.5), ("p75", 0.75), ("p95", 0.95), ("p99", 0.99)):
            assert abs(np.searchsorted(x, r[q]) - p * len(x)) <= ws.RANK_ERROR * len(x) + 1
        assert abs(r.outlier_count - want["outlier_count"]) <= 2 * ws.RANK_ERROR * len(x) + 1
