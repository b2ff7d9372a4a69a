"""Neighbour and chained imputation, isolation forests and synthetic minority rows."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tablecare.functions.moments import least_squares
from tablecare.functions.ordered import quantiles, row_numbers
from tablecare.functions.params import attach
from tablecare.operators.gapped import nearest_points
from tablecare.operators.nearest import nearest
from tablecare.session import settle


def knn_impute(df: DataFrame, target: str, features: list[str], k: int = 5) -> DataFrame:
    """Missing cells of one column to the mean of the k nearest donors, over the coordinates that both rows have.

    Donors are all rows with a value in the column, with gaps in their features or not (``operators.gapped``). Rows with equal coordinates
    have equal neighbours, so queries and donors are first reduced to distinct coordinates with counts and means; donors at equal
    coordinates share their weight. Donors at equal distance go in the order of their coordinates, gaps last. A row that shares no coordinate
    with any donor takes the column mean.
    """
    mean = df.agg(F.avg(target)).first()[0]
    if mean is None:
        return df
    # NaN is a gap; -0.0 and 0.0 are one place.
    point = F.array(*[F.when(~F.isnan(F.col(c).cast("double")), F.col(c).cast("double") + 0.0) for c in features]).cast("array<double>")
    name = lambda v: F.xxhash64(F.transform(v, lambda x: F.coalesce(x, F.lit(float("nan")))))  # noqa: E731 - a hash passes over nulls, wherever they stand
    rows = df.withColumn("qid", name(point))
    donors = settle(df.where(F.col(target).isNotNull()).groupBy(point.alias("v")).agg(F.avg(target).alias("m"), F.count(F.lit(1)).alias("n")).withColumn("cid", name("v")))
    filled = F.exists("v", lambda x: x.isNotNull())
    asks = settle(df.where(F.col(target).isNull()).select(point.alias("v")).distinct().where(filled).withColumn("qid", name("v")))
    found = nearest_points(asks, donors.where(filled).select("cid", "v"), k, len(features)).join(donors.select("cid", "v", "m", "n"), "cid")
    # Of each task at most k donor points and ties come here; those beyond k rows take no part.
    order = W.partitionBy("qid").orderBy("dist", F.transform("v", lambda x: F.coalesce(x, F.lit(float("inf")))))
    before = F.sum("n").over(order.rowsBetween(W.unboundedPreceding, -1))
    used = F.greatest(F.least(F.col("n"), F.lit(k) - F.coalesce(before, F.lit(0))), F.lit(0))
    values = found.withColumn("_u", used).groupBy("qid").agg((F.sum(F.col("m") * F.col("_u")) / F.sum("_u")).alias("_value"))
    given = attach(rows, values, ["qid"])
    return given.withColumn(target, F.when(F.col(target).isNotNull(), F.col(target)).otherwise(F.coalesce("_value", F.lit(mean)))).select(*df.columns)


def iterative_impute(df: DataFrame, cols: list[str], rounds: int = 10, tol: float = 1e-3) -> DataFrame:
    """Chained imputation: each column with gaps is predicted from the others by a linear fit, in rounds.

    Only coefficients change between rounds, so a round is one covariance pass per column and the rows are
    filled by expressions on the start values and the latest coefficients.
    """
    means = df.agg(*[F.avg(c).alias(c) for c in cols]).first().asDict()
    gaps = df.agg(*[F.count_if(F.col(c).isNull()).alias(c) for c in cols]).first().asDict()
    order = sorted([c for c in cols if gaps[c] and means[c] is not None], key=lambda c: gaps[c])
    usable = [c for c in cols if means[c] is not None]
    base = settle(df.withColumns({f"_miss_{c}": F.col(c).isNull() for c in order})
                  .withColumns({c: F.coalesce(F.col(c).cast("double"), F.lit(means[c])) for c in usable}))
    last: dict[str, tuple] = {}
    for i in range(rounds):
        moved = 0.0
        for c in order:
            xs = [x for x in usable if x != c]
            beta, b0 = least_squares(base.where(~F.col(f"_miss_{c}")), xs, c)
            guess = F.lit(b0)
            for b, x in zip(beta, xs):
                guess = guess + F.lit(b) * F.col(x)
            base = base.withColumn(c, F.when(F.col(f"_miss_{c}"), guess).otherwise(F.col(c)))
            new = (*beta, b0)
            moved = max([moved, *[abs(a - b) for a, b in zip(new, last.get(c, [math.inf] * len(new)))]])
            last[c] = new
        base = settle(base)
        if moved < tol:
            break
    return base.select(*df.columns)


def _path_c(n: float) -> float:
    """Mean path length of an unsuccessful search among n points."""
    return 0.0 if n <= 1 else 2.0 * (math.log(n - 1) + 0.5772156649015329) - 2.0 * (n - 1) / n if n > 2 else 1.0


def fit_isolation_forest(df: DataFrame, cols: list[str], trees: int = 100, sample: int = 256, seed: int = 42) -> list[dict]:
    """Trees on small random samples, grown in parallel; at most trees x 2 x sample nodes come back."""
    rows = df.select(*[F.col(c).cast("double").alias(c) for c in cols]).dropna()
    picked = settle(rows.orderBy(F.rand(seed)).limit(trees * sample).withColumn("_pos", F.monotonically_increasing_id()))
    pool = picked.count()
    # A small table has fewer rows than the trees want: each row then goes to several trees, chosen by hash.
    times = max(1, round(trees * min(sample, pool) / max(pool, 1)))
    if times == 1:
        spread = picked.withColumn("tree", F.pmod("_pos", F.lit(trees)).cast("int"))
    else:
        ranked = F.array_sort(F.transform(F.sequence(F.lit(0), F.lit(trees - 1)), lambda t: F.struct(F.xxhash64("_pos", t, F.lit(seed)).alias("h"), t.alias("t"))))
        spread = picked.withColumn("_t", F.explode(F.slice(ranked, 1, times))).withColumn("tree", F.col("_t.t").cast("int"))
    spread = spread.select("tree", *cols)
    depth = math.ceil(math.log2(max(2, min(sample, pool))))

    def grow(pdf: pd.DataFrame) -> pd.DataFrame:
        tree = int(pdf["tree"].iloc[0])
        rng = np.random.default_rng(seed * 1000 + tree)
        x = pdf[cols].to_numpy(float)
        nodes: list[list] = []

        def split(idx, level):
            at = len(nodes)
            nodes.append([-1, 0.0, -1, -1, level + _path_c(len(idx))])
            wide = [j for j in range(len(cols)) if len(idx) > 1 and x[idx, j].max() > x[idx, j].min()]
            if level < depth and wide:
                j = int(rng.choice(wide))
                cut = float(rng.uniform(x[idx, j].min(), x[idx, j].max()))
                left = split(idx[x[idx, j] < cut], level + 1)
                right = split(idx[x[idx, j] >= cut], level + 1)
                nodes[at] = [j, cut, left, right, 0.0]
            return at

        split(np.arange(len(x)), 0)
        f, c, left, right, p = zip(*nodes)
        return pd.DataFrame({"tree": [tree], "feature": [list(f)], "cut": [list(c)], "left": [list(left)], "right": [list(right)], "path": [list(p)], "size": [len(x)]})

    schema = "tree int, feature array<int>, cut array<double>, left array<int>, right array<int>, path array<double>, size int"
    return [r.asDict() for r in spread.groupBy("tree").applyInPandas(grow, schema).collect()]


def isolation_scores(df: DataFrame, cols: list[str], forest: list[dict], out: str = "score") -> DataFrame:
    """Anomaly score in (0, 1) per row; null where a column is missing."""
    trees = [{k: np.array(t[k]) for k in ("feature", "cut", "left", "right", "path")} for t in forest]
    norm = _path_c(sum(t["size"] for t in forest) / max(len(forest), 1)) or 1.0

    @F.pandas_udf(T.DoubleType())
    def score(values: pd.Series) -> pd.Series:
        x = np.stack(values.to_numpy()).astype(float) if len(values) else np.zeros((0, len(cols)))
        total = np.zeros(len(x))
        for t in trees:
            at = np.zeros(len(x), dtype=int)
            while True:
                inner = t["feature"][at] >= 0
                if not inner.any():
                    break
                rows = np.nonzero(inner)[0]
                here = at[rows]
                low = x[rows, t["feature"][here]] < t["cut"][here]
                at[rows] = np.where(low, t["left"][here], t["right"][here])
            total += t["path"][at]
        return pd.Series(np.power(2.0, -(total / max(len(trees), 1)) / norm))

    point = F.array(*[F.coalesce(F.col(c).cast("double"), F.lit(0.0)) for c in cols])
    there = F.lit(True)
    for c in cols:
        there = there & F.col(c).isNotNull()
    return df.withColumn(out, F.when(there, score(point)))


def isolation_flags(df: DataFrame, cols: list[str], contamination: float = 0.1, trees: int = 100, seed: int = 42) -> DataFrame:
    """Rows whose score is above the share cut are outliers."""
    scored = settle(isolation_scores(df, cols, fit_isolation_forest(df, cols, trees, seed=seed)))
    cut = quantiles(scored, ["score"], [1 - contamination])["score"][0]
    return scored.withColumn("outlier", F.coalesce(F.col("score") > F.lit(cut), F.lit(False)))


def smote(df: DataFrame, key: str, vector: str, label: str, minority, need: int | None = None, k: int = 5, seed: int = 42) -> DataFrame:
    """Synthetic minority rows between a row and one of its k nearest minority rows: (base, neighbour, vector).

    Without ``need`` the minority is filled up to the size of the rest.
    """
    few = df.where(F.col(label) == minority).select(F.col(key).alias("id"), F.transform(F.col(vector), lambda x: x.cast("double")).alias("v"))
    few = settle(few)
    n = few.count()
    if need is None:
        need = df.where(F.col(label) != minority).count() - n
    if n < 2 or need <= 0:
        return few.limit(0).select(F.col("id").alias("base"), F.col("id").alias("neighbour"), F.col("v").alias("vector"))
    near = nearest(few, few, "id", "id", "v", "v", min(k, n - 1), skip_self=True)
    lists = near.groupBy("qid").agg(F.transform(F.sort_array(F.collect_list(F.struct("rank", "cid"))), lambda s: s["cid"]).alias("friends"))
    numbered = row_numbers(few.withColumn("_h", F.xxhash64("id", F.lit(seed))), [], ["_h", "id"], "_at")
    # Every row gives need // n copies, the first need % n rows one more.
    copies = F.lit(need // n) + F.when(F.col("_at") <= need % n, 1).otherwise(0)
    bases = numbered.join(lists, F.col("id") == F.col("qid")).withColumn("_copies", copies).where("_copies > 0").select(
        "id", "v", "friends", F.explode(F.sequence(F.lit(1), F.col("_copies").cast("int"))).alias("_c"))
    draw = F.pmod(F.xxhash64("id", "_c", F.lit(seed)), F.size("friends")).cast("int")
    share = F.pmod(F.xxhash64("_c", "id", F.lit(seed + 1)), F.lit(1 << 20)) / float(1 << 20)
    made = bases.select(F.col("id").alias("base"), "v", F.get("friends", draw).alias("neighbour"), share.alias("_u"))
    other = few.select(F.col("id").alias("neighbour"), F.col("v").alias("_w"))
    return made.join(other, "neighbour").select("base", "neighbour", F.zip_with("v", "_w", lambda a, b: a + (b - a) * F.col("_u")).alias("vector"))
