"""Nearest rows where coordinates are missing: the distance over the coordinates that both rows have, scaled up to all of them.

The squared distance is the mean squared difference of the shared coordinates times their full number, so it is never less than the squared
difference of any shared one. A row within a distance of a query therefore lies within it on every shared coordinate. Rows are put in
one sorted list per coordinate, each cut into blocks; a query visits, in the lists of its own coordinates, only the blocks that its reach
touches, and a pair is measured in the list of the first coordinate that both have. The reach is the k-th distance to a bounded sample, which
can only be too long. So the plan is one, whatever patterns of gaps there are.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tablecare.session import settle

BLOCK = 2048
SAMPLE = 2048
#: Squared distances that agree to so many decimal digits count as equal.
DIGITS = 9


def _points(series: pd.Series) -> np.ndarray:
    return np.array([[np.nan if x is None else x for x in v] for v in series], float).reshape(len(series), -1)


def squared(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """All distances between two sets of points with gaps (NaN); infinite where nothing is shared."""
    here, there = ~np.isnan(a), ~np.isnan(b)
    total, shared = np.zeros((len(a), len(b))), here.astype(float) @ there.T.astype(float)
    for i in range(a.shape[1]):
        gap = a[:, i, None] - b[None, :, i]
        total += np.where(np.isnan(gap), 0.0, gap * gap)
    return np.where(shared > 0, total * a.shape[1] / np.maximum(shared, 1), np.inf)


def nearest_points(asks: DataFrame, points: DataFrame, k: int, width: int, block: int = BLOCK, sample: int = SAMPLE) -> DataFrame:
    """(qid, cid, dist): the k nearest points of each query, and those that tie with the k-th.

    ``asks`` has qid and v, ``points`` cid and v, arrays of ``width`` doubles or nulls; points are distinct. ``dist`` is squared and rounded.
    """
    spark = points.sparkSession
    some = _points(pd.Series([r["v"] for r in points.orderBy(F.xxhash64("cid")).limit(sample).select("v").collect()], dtype=object)) if width else np.zeros((0, 0))
    if not len(some):
        return spark.createDataFrame([], "qid bigint, cid bigint, dist double")

    def reach(batches):
        for pdf in batches:
            if len(pdf):
                d = np.sort(squared(_points(pdf["v"]), some), axis=1)
                far = d[:, k - 1] if d.shape[1] >= k else np.full(len(d), np.inf)
                yield pdf.assign(reach=np.sqrt(far) * (1 + 1e-9) + 1e-9)

    asked = asks.mapInPandas(reach, "qid bigint, v array<double>, reach double")
    # Sorted lists: each point once per coordinate that it has, and the edges of the blocks of each list.
    lists = points.select("cid", "v", F.posexplode("v").alias("axis", "at")).where("at IS NOT NULL")
    sizes = {r["axis"]: r["n"] for r in lists.groupBy("axis").agg(F.count("*").alias("n")).collect()}
    edges = {}
    for axis, n in sizes.items():
        blocks = -(-n // block)
        probs = [i / blocks for i in range(1, blocks)]
        edges[axis] = sorted(set(lists.where(F.col("axis") == axis).agg(F.percentile_approx("at", probs, 10_000)).first()[0])) if probs else []
    lanes = F.array(*[F.array(*[F.lit(float(x)) for x in edges.get(i, [])]).cast("array<double>") for i in range(width)])

    def place(axis, at):  # edges at or below a value; the value's block
        return F.size(F.filter(F.get(lanes, axis), lambda e: e <= at))

    held = lists.withColumn("block", place(F.col("axis"), F.col("at")))
    routed = asked.select("qid", "v", "reach", F.posexplode("v").alias("axis", "at")).where("at IS NOT NULL")
    last = F.size(F.get(lanes, F.col("axis")))
    low = F.when(F.col("reach") < float("inf"), place(F.col("axis"), F.col("at") - F.col("reach"))).otherwise(0)
    high = F.when(F.col("reach") < float("inf"), place(F.col("axis"), F.col("at") + F.col("reach"))).otherwise(last)
    routed = settle(routed.withColumn("block", F.explode(F.sequence(low, high))).select("qid", "v", "axis", "block"))
    counts = routed.groupBy("axis", "block").agg(F.ceil(F.count("*") / block).cast("int").alias("nqb")).join(
        held.groupBy("axis", "block").agg(F.ceil(F.count("*") / block).cast("int").alias("ncb")), ["axis", "block"])
    # A value that many points share makes a long block; it is cut by hash on both sides.
    q = routed.join(counts, ["axis", "block"]).select("qid", "v", "axis", "block", F.pmod(F.xxhash64("qid"), F.col("nqb")).cast("int").alias("qb"), F.explode(F.sequence(F.lit(0), F.col("ncb") - 1)).alias("cb"))
    c = held.join(counts, ["axis", "block"]).select("cid", "v", "axis", "block", F.explode(F.sequence(F.lit(0), F.col("nqb") - 1)).alias("qb"), F.pmod(F.xxhash64("cid"), F.col("ncb")).cast("int").alias("cb"))

    def best(q: pd.DataFrame, c: pd.DataFrame) -> pd.DataFrame:
        out = []
        if len(q) and len(c):
            axis, y, ids = int(q["axis"].iloc[0]), _points(c["v"]), c["cid"].to_numpy()
            before = ~np.isnan(y[:, :axis])
            for start in range(0, len(q), 512):
                x, names = _points(q["v"].iloc[start : start + 512]), q["qid"].to_numpy()[start : start + 512]
                d = np.round(squared(x, y), DIGITS)
                if axis:  # the pair belongs to the list of an earlier coordinate
                    d[(~np.isnan(x[:, :axis])).astype(int) @ before.T.astype(int) > 0] = np.inf
                edge = np.partition(d, min(k, d.shape[1]) - 1, axis=1)[:, min(k, d.shape[1]) - 1]
                row, col = np.nonzero((d <= edge[:, None]) & np.isfinite(d))
                out.append(pd.DataFrame({"qid": names[row], "cid": ids[col], "dist": d[row, col]}))
        return pd.concat(out) if out else pd.DataFrame({"qid": [], "cid": [], "dist": []})

    keys = ["axis", "block", "qb", "cb"]
    return q.groupBy(*keys).cogroup(c.groupBy(*keys)).applyInPandas(best, "qid bigint, cid bigint, dist double")
