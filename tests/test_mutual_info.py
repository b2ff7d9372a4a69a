"""Neighbour estimate of mutual information against a plain version and known values."""

import math

import numpy as np
import pytest

from tablecare.operators import features as fe


def psi(n):
    return -0.5772156649015329 + sum(1 / j for j in range(1, n))


def plain(x, y, k):
    x, y = (x - x.mean()) / x.std(), (y - y.mean()) / y.std()
    d = np.maximum(np.abs(x[:, None] - x), np.abs(y[:, None] - y))
    np.fill_diagonal(d, np.inf)
    r = np.sort(d, axis=1)[:, k - 1] * (1 - 1e-7)
    near = lambda a: [int(((a < a[i] + r[i]) & ~(a <= a[i] - r[i])).sum() if r[i] > 0 else (np.abs(a - a[i]) < 1e-12).sum()) for i in range(len(a))]
    return max(0.0, psi(len(x)) + psi(k) - np.mean([psi(n) for n in near(x)]) - np.mean([psi(n) for n in near(y)]))


@pytest.mark.parametrize("way", ["small", "large"])
def test_neighbour_estimate_equals_a_plain_one(spark, request, way):
    if way == "large":
        request.getfixturevalue("large")
    rng = np.random.default_rng(1)
    n = 300
    y = rng.normal(size=n)
    cols = {"linear": 2 * y + rng.normal(size=n) * 0.2, "free": rng.normal(size=n), "steps": np.round(y * 2), "flat": np.full(n, 3.0), "twice": np.repeat(y[: n // 2], 2)}
    rows = [tuple(float(v) for v in r) for r in zip(*cols.values(), y)] + [(None, 1.0, float("nan"), 3.0, 1.0, 2.0), (1.0, 1.0, 1.0, 3.0, 1.0, None)]
    df = spark.createDataFrame(rows, ", ".join(f"{c} double" for c in [*cols, "y"]))
    got = {r.feature: r.mutual_info for r in fe.mutual_info(df, list(cols), "y", "regression").collect()}
    assert got["flat"] == 0 and got["linear"] > 1 > 0.2 > got["free"]
    for c in ("linear", "free", "twice", "steps"):
        ok = [r for r in rows if r[list(cols).index(c)] is not None and not math.isnan(r[list(cols).index(c)]) and r[-1] is not None]
        assert got[c] == pytest.approx(plain(np.array([r[list(cols).index(c)] for r in ok]), np.array([r[-1] for r in ok]), 3), abs=1e-6)


def test_neighbour_estimate_of_normal_pairs(spark):
    rng = np.random.default_rng(2)
    x = rng.normal(size=4000)
    y = 0.8 * x + 0.6 * rng.normal(size=4000)
    df = spark.createDataFrame([(float(a), float(b)) for a, b in zip(x, y)], "x double, y double")
    assert fe.neighbour_mutual_info(df, ["x"], "y").first().mutual_info == pytest.approx(-0.5 * math.log(1 - 0.64), abs=0.06)
    assert fe.neighbour_mutual_info(df.limit(2), ["x"], "y").first().mutual_info == 0
    with pytest.raises(ValueError):
        fe.mutual_info(df, ["x"], "y", "guess")


def test_neighbours_are_searched_once_and_by_tasks_of_few_rows(spark, monkeypatch):
    """The marks are counted, cut and read; before, each of these passes searched all neighbours again, in as many tasks as the file had parts."""
    from tablecare.operators import nearest as ne
    from tablecare.session import settle

    monkeypatch.setattr(ne, "TASK_ROWS", 100, raising=False)
    searched, tasks = spark.sparkContext.accumulator(0), []

    def counted(batches):
        for pdf in batches:
            searched.add(len(pdf))
            yield pdf

    def watched(*args, **options):
        found = ne.nearest(*args, **options)
        return found.mapInPandas(counted, found.schema)

    def settled(df):
        done = settle(df)
        if "leaf" in df.columns:
            tasks.append(done.rdd.getNumPartitions())
        return done

    monkeypatch.setattr(fe, "nearest", watched)
    monkeypatch.setattr(ne, "settle", settled)
    df = spark.range(400, numPartitions=1).selectExpr("double(id % 37) AS a", "double(id % 37 + id % 5) AS y")
    fe.neighbour_mutual_info(df, ["a"], "y").collect()
    assert searched.value == 400 * 3
    assert tasks == [4]
