"""Feature operators: dates, lags, rolling and weighted values, products, ratios, bins, encodings, text statistics."""

from __future__ import annotations

import math
from itertools import combinations, combinations_with_replacement

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tablecare.functions.columns import numeric_columns
from tablecare.functions.ordered import decayed_sums, framed, quantiles, running
from tablecare.functions.params import attach
from tablecare.operators.nearest import nearest
from tablecare.session import settle


def datetime_features(df: DataFrame, col: str, keep: bool = False) -> DataFrame:
    """21 date columns: parts, edges of month, quarter and year, weekend, and cycles; bad dates are null."""
    t = df.schema[col].dataType.typeName()
    at = F.col(col) if t in ("timestamp", "timestamp_ntz", "date") else F.try_to_timestamp(F.col(col))
    day = F.to_date(at)

    def flag(c: Column) -> Column:
        return F.when(at.isNotNull(), c.cast("int")).otherwise(0)

    def cycle(c: Column, n: int) -> tuple[Column, Column]:
        turn = 2 * math.pi * c / n
        return F.sin(turn), F.cos(turn)

    quarter_end = F.last_day(F.add_months(F.trunc(day, "quarter"), 2))
    parts = {
        "year": F.year(at), "month": F.month(at), "day": F.dayofmonth(at), "dayofweek": F.weekday(at),
        "quarter": F.quarter(at), "dayofyear": F.dayofyear(at), "weekofyear": F.weekofyear(at), "hour": F.hour(at),
        "is_weekend": flag(F.weekday(at) >= 5), "is_month_start": flag(F.dayofmonth(at) == 1),
        "is_month_end": flag(day == F.last_day(day)), "is_quarter_start": flag(day == F.trunc(day, "quarter")),
        "is_quarter_end": flag(day == quarter_end), "is_year_start": flag(F.dayofyear(at) == 1),
        "is_year_end": flag((F.month(at) == 12) & (F.dayofmonth(at) == 31)),
    }
    for name, c, n in (("month", F.month(at), 12), ("day", F.dayofmonth(at), 31), ("hour", F.hour(at), 24)):
        parts[f"{name}_sin"], parts[f"{name}_cos"] = cycle(c, n)
    out = df.withColumns({f"{col}_{k}": v for k, v in parts.items()})
    return out if keep else out.drop(col)


def lag_columns(c: str, lags) -> dict:
    return {f"{c}_lag_{n}": n for n in lags}


def rolling(c: str, n: int, w, stats=("mean", "std", "min", "max", "median")) -> dict[str, Column]:
    """Statistics of the last n rows, only when all n rows are there and filled."""
    frame = w.rowsBetween(-(n - 1), 0)
    full = F.count(c).over(frame) == n
    fns = {"mean": F.avg(c), "std": F.stddev_samp(c), "min": F.min(c), "max": F.max(c), "median": F.percentile(c, 0.5)}
    return {f"{c}_rolling_{s}_{n}": F.when(full, fns[s].over(frame)) for s in stats}


def lag_features(df: DataFrame, value: str, keys: list[str], order: list[str],
                 lags=(1, 2, 3, 7, 14, 30), windows=(3, 7, 14, 30), diffs=(1, 7),
                 stats=("mean", "std", "min", "max", "median")) -> DataFrame:
    """Lags, rolling statistics, differences and percent changes per key in a total order."""
    span = max([*lags, *[n - 1 for n in windows], *diffs], default=1)

    def build(w):
        cols = {f"{value}_lag_{n}": F.lag(value, n).over(w) for n in lags}
        for n in windows:
            cols.update(rolling(value, n, w, stats))
        for n in diffs:
            before = F.lag(value, n).over(w)
            cols[f"{value}_diff_{n}"] = F.col(value) - before
            cols[f"{value}_pct_change_{n}"] = F.try_divide(F.col(value) - before, before)
        return cols

    return framed(df, keys, order, span, build)


def ewm_features(df: DataFrame, value: str, keys: list[str], order: list[str], spans=(7, 30)) -> DataFrame:
    """Exponentially weighted mean and standard deviation with adjusted weights, per key.

    Weighted sums of x and x squared come from geometric sums; the sums of weights follow from the row number.
    """
    x = F.col(value).cast("double")
    outs, rates = {}, {}
    for s in spans:
        r = 1 - 2.0 / (s + 1)
        rates[s] = r
        outs[f"_a{s}"], outs[f"_b{s}"] = (x, r), (x * x, r)
    out = decayed_sums(df, keys, order, outs)
    n = F.col("_rn").cast("double")
    cols = {}
    for s, r in rates.items():
        w1 = (1 - F.pow(F.lit(r), n)) / (1 - r)
        w2 = (1 - F.pow(F.lit(r * r), n)) / (1 - r * r)
        mean = F.col(f"_a{s}") / w1
        var = F.greatest(F.col(f"_b{s}") / w1 - mean * mean, F.lit(0.0))
        cols[f"{value}_ewm_mean_{s}"] = mean
        cols[f"{value}_ewm_std_{s}"] = F.when(n > 1, F.sqrt(var * w1 * w1 / (w1 * w1 - w2)))
    return out.withColumns(cols).select(*df.columns, *cols)


def ema_features(df: DataFrame, value: str, keys: list[str], order: list[str], alpha: float = 0.1) -> DataFrame:
    """Running mean and deviation that start at 0 and 1 with the first row and move by alpha from the second."""
    r = 1 - alpha
    x = F.col(value).cast("double")
    head = df.withColumn("_one", F.lit(1))
    first = decayed_sums(head, keys, order, {"_m": (x, r)})
    n = F.col("_rn").cast("double")
    # The first row does not move the mean, so its decayed share is taken out again.
    start = first.groupBy(*keys).agg(F.max(F.when(F.col("_rn") == 1, x)).alias("_x1"))
    first = attach(first, start, keys)
    first = first.withColumn("_mean", alpha * (F.col("_m") - F.col("_x1") * F.pow(F.lit(r), n - 1))).drop("_m", "_rn", "_one")
    gap = F.when(F.lit(True), F.col(value) - F.col("_mean"))
    second = decayed_sums(first, keys, order, {"_v": (gap * gap, r)})
    x1 = F.col("_x1")
    var = alpha * (F.col("_v") - x1 * x1 * F.pow(F.lit(r), n - 1)) + F.pow(F.lit(r), n - 1)
    return second.withColumns({f"{value}_ema_mean": F.col("_mean"), f"{value}_ema_std": F.sqrt(F.greatest(var, F.lit(0.0)))}).select(
        *df.columns, f"{value}_ema_mean", f"{value}_ema_std")


def time_series_features(df: DataFrame, date: str, value: str, keys: list[str], order: list[str]) -> DataFrame:
    """Date parts with lags 1, 7, 14, 30 and rolling 7, 14, 30."""
    parts = {"year": F.year(date), "month": F.month(date), "day": F.dayofmonth(date), "dayofweek": F.weekday(date),
             "quarter": F.quarter(date), "weekofyear": F.weekofyear(date)}
    out = df.withColumns({f"{date}_{k}": c for k, c in parts.items()})
    return lag_features(out, value, keys, order, (1, 7, 14, 30), (7, 14, 30), (), ("mean", "std", "min", "max"))


def polynomial_columns(cols: list[str], degree: int = 2, cap: int | None = None) -> dict[str, Column]:
    out = {}
    for size in range(2, degree + 1):
        for combo in combinations_with_replacement(cols, size):
            c = F.col(combo[0])
            for other in combo[1:]:
                c = c * F.col(other)
            powers = {x: combo.count(x) for x in dict.fromkeys(combo)}
            out["_x_".join(x if n == 1 else f"{x}^{n}" for x, n in powers.items())] = c
    return dict(list(out.items())[:cap])


def interaction_columns(cols: list[str], cap: int | None = None) -> dict[str, Column]:
    """Product, sum and difference of all column pairs; a cap, if given, stops after the pair that reaches it."""
    out: dict[str, Column] = {}
    for a, b in combinations(cols, 2):
        out.update({f"{a}_times_{b}": F.col(a) * F.col(b), f"{a}_plus_{b}": F.col(a) + F.col(b),
                    f"{a}_minus_{b}": F.col(a) - F.col(b)})
        if cap is not None and len(out) >= cap:
            break
    return out


def ratio_columns(cols: list[str], cap: int | None = None) -> dict[str, Column]:
    """Ratios both ways; a zero or missing side gives 0, an infinite one gives 1e10 with its sign."""
    def ratio(a: str, b: str) -> Column:
        c = F.coalesce(F.col(a).cast("double") / F.nullif(F.col(b).cast("double"), F.lit(0.0)), F.lit(0.0))
        return F.when(c == float("inf"), 1e10).when(c == float("-inf"), -1e10).otherwise(c)

    out: dict[str, Column] = {}
    for a, b in combinations(cols, 2):
        out.update({f"{a}_div_{b}": ratio(a, b), f"{b}_div_{a}": ratio(b, a)})
        if cap is not None and len(out) >= cap:
            break
    return out


def log_columns(df: DataFrame, cols: list[str], cap: int | None = None) -> dict[str, Column]:
    """log1p and square root of columns without negatives, squares of all; one pass finds the minima."""
    low = df.agg(*[F.min(c).alias(c) for c in cols]).first()
    out: dict[str, Column] = {}
    for c in cols:
        if low[c] is not None and low[c] > 0:
            out[f"{c}_log"] = F.log1p(F.col(c))
        elif low[c] is not None and low[c] >= 0:
            out[f"{c}_log"] = F.log1p(F.col(c) + 1e-10)
        if low[c] is not None and low[c] >= 0:
            out[f"{c}_sqrt"] = F.sqrt(F.col(c))
        out[f"{c}_squared"] = F.col(c).cast("double") * F.col(c)
        if cap is not None and len(out) >= cap:
            break
    return out


ROW_STATISTICS = ("row_mean", "row_std", "row_max", "row_min", "row_median", "row_sum", "row_skew", "row_kurt",
                  "row_zeros", "row_positives", "row_negatives")


def row_statistics(df: DataFrame, cols: list[str]) -> DataFrame:
    """Statistics over the columns of one row; missing cells are skipped.

    Plain arithmetic in stages: each stage uses columns of the one before, so nothing is worked out twice.
    """
    x = {c: F.col(c).cast("double") for c in cols}
    zero = F.lit(0.0)
    total = lambda terms: sum(terms, zero)
    count = lambda cond: total(F.when(cond(v), 1.0).otherwise(0.0) for v in x.values())
    out = df.withColumns({
        "_n": count(lambda v: v.isNotNull()), "row_sum": total(F.coalesce(v, zero) for v in x.values()),
        "_sorted": F.sort_array(F.array_compact(F.array(*x.values()))),
        "row_zeros": count(lambda v: v == 0).cast("int"), "row_positives": count(lambda v: v > 0).cast("int"),
        "row_negatives": count(lambda v: v < 0).cast("int"),
    })
    n = F.col("_n")
    out = out.withColumn("row_mean", F.col("row_sum") / F.nullif(n, zero))
    out = out.withColumns({f"_d{i}": F.coalesce(v - F.col("row_mean"), zero) for i, v in enumerate(x.values())})
    square = [F.col(f"_d{i}") * F.col(f"_d{i}") for i in range(len(cols))]
    out = out.withColumns({
        "_m2": total(square), "_m3": total(q * F.col(f"_d{i}") for i, q in enumerate(square)), "_m4": total(q * q for q in square)})
    m2, m3, m4 = F.col("_m2"), F.col("_m3"), F.col("_m4")
    half = (n / 2).cast("int")
    at = lambda i: F.get("_sorted", i)
    spread = m2 > 0
    out = out.withColumns({
        "row_std": F.sqrt(m2 / F.nullif(n - 1, zero)), "row_max": F.get("_sorted", (n - 1).cast("int")), "row_min": at(F.lit(0)),
        "row_median": F.when(n % 2 == 1, at(half)).otherwise((at(half - 1) + at(half)) / 2),
        "row_skew": F.when((n > 2) & spread, F.sqrt(n * (n - 1)) / F.when(n > 2, n - 2) * (m3 / n) / F.pow(m2 / n, F.lit(1.5))),
        "row_kurt": F.when((n > 3) & spread, (n - 1) / F.when(n > 3, (n - 2) * (n - 3)) * ((n + 1) * ((m4 / n) / ((m2 / n) * (m2 / n)) - 3) + 6)),
    })
    return out.select(*df.columns, *ROW_STATISTICS)


def bin_edges(df: DataFrame, cols: list[str], bins: int = 10) -> dict[str, list[float]]:
    """Distinct inner quantile edges per column."""
    probs = [i / bins for i in range(bins + 1)]
    return {c: sorted(set(q)) for c, q in quantiles(df, cols, probs).items() if q[0] is not None}


def bin_columns(edges: dict[str, list[float]]) -> dict[str, Column]:
    """Ordinal bin codes; a value on an edge belongs to the bin above, the last bin is closed."""
    out = {}
    for c, e in edges.items():
        code = F.lit(0)
        for edge in e[1:-1]:
            code = code + F.when(F.col(c) >= edge, 1).otherwise(0)
        out[f"{c}_binned"] = F.when(F.col(c).isNotNull(), code)
    return out


def target_encoding(df: DataFrame, col: str, target: str) -> DataFrame:
    """Mean target per category: the fitted table."""
    return df.where(F.col(col).isNotNull()).groupBy(col).agg(F.avg(target).alias(f"{col}_target_encoded"))


def target_encode(df: DataFrame, col: str, target: str, fitted_on: DataFrame | None = None,
                  folds: int = 0, fold_key: list[str] | None = None) -> DataFrame:
    """Target means joined to rows; unseen values get the plain mean of the category means.

    With ``folds`` each row gets the mean over the other folds: totals minus its own fold, no self join.
    """
    source = fitted_on if fitted_on is not None else df
    out = f"{col}_target_encoded"
    if not folds:
        means = target_encoding(source, col, target)
        default = means.agg(F.avg(out)).first()[0]
        return attach(df, means, [col]).withColumn(out, F.coalesce(F.col(out), F.lit(default)))
    fold = F.pmod(F.xxhash64(*fold_key), F.lit(folds)).alias("_fold")
    rows = df.withColumn("_fold", fold)
    per = rows.groupBy(col, "_fold").agg(F.sum(target).alias("_s"), F.count(target).alias("_n"))
    whole = W.partitionBy(col)
    per = per.select(col, "_fold", ((F.sum("_s").over(whole) - F.col("_s")) / F.nullif(F.sum("_n").over(whole) - F.col("_n"), F.lit(0))).alias(out))
    default = df.agg(F.avg(target)).first()[0]
    return attach(rows, per, [col, "_fold"]).withColumn(out, F.coalesce(F.col(out), F.lit(default))).drop("_fold")


def text_statistics(col: str) -> dict[str, Column]:
    """Length, word and character counts and three ratios over whole texts."""
    c = F.col(col)
    count = lambda p: F.regexp_count(c, F.lit(p))
    words = F.filter(F.split(c, r"\s+"), lambda w: w != "")
    length = F.length(c)
    digits, upper, space = count(r"\d"), count("[A-Z]"), count(r"\s")
    return {
        f"{col}_length": length, f"{col}_word_count": F.size(words), f"{col}_unique_word_count": F.size(F.array_distinct(words)),
        f"{col}_digit_count": digits, f"{col}_upper_count": upper, f"{col}_lower_count": count("[a-z]"),
        f"{col}_space_count": space, f"{col}_punct_count": count(r"(?U)[^\w\s]"),
        f"{col}_digit_ratio": digits / (length + 1), f"{col}_upper_ratio": upper / (length + 1), f"{col}_space_ratio": space / (length + 1),
    }


def binned_mutual_info(df: DataFrame, cols: list[str], target: str, bins: int = 10) -> DataFrame:
    """Mutual information of quantile-binned columns with a class target, from joint counts.

    The usual library figure comes from a neighbour estimate; this one is the binned estimate.
    """
    edges = bin_edges(df, cols, bins)
    codes = bin_columns(edges)
    pairs = F.array(*[F.struct(F.lit(c).alias("feature"), codes[f"{c}_binned"].alias("bin")) for c in edges])
    joint = df.where(F.col(target).isNotNull()).select(F.explode(pairs).alias("r"), F.col(target).alias("y")).groupBy(
        "r.feature", "r.bin", "y").agg(F.count(F.lit(1)).cast("double").alias("n"))
    # At most bins x classes rows per feature from here on.
    f, fx, fy = W.partitionBy("feature"), W.partitionBy("feature", "bin"), W.partitionBy("feature", "y")
    n, nx, ny = F.sum("n").over(f), F.sum("n").over(fx), F.sum("n").over(fy)
    terms = joint.select("feature", (F.col("n") / n * F.log(F.col("n") * n / (nx * ny))).alias("t"))
    return terms.groupBy("feature").agg(F.sum("t").alias("mutual_info"))


def digamma(n: Column) -> Column:
    """Of numbers from 1 on: the asymptotic series six places further, less the steps to there."""
    x = n.cast("double") + 6
    series = F.log(x) - 1 / (2 * x) - 1 / (12 * x * x) + 1 / (120 * x**4) - 1 / (252 * x**6) + 1 / (240 * x**8)
    for i in range(6):
        series = series - 1 / (n.cast("double") + i)
    return series


#: In the plane few leaves touch, so a query looks at few rows when blocks are small.
PLANE_BLOCK = 512


def neighbour_mutual_info(df: DataFrame, cols: list[str], target: str, k: int = 3) -> DataFrame:
    """Mutual information of columns with a numeric target, by the distances of the k-th neighbours (feature, mutual_info; 0 at least).

    Both columns are scaled by their deviation. Of each row the k-th neighbour in the plane, by the larger difference, gives a radius; the
    rows nearer than that are counted on each axis alone (itself included; with radius 0 the equal ones). No noise is added, so the result
    is the same every time. Rows with a gap are left out; columns without spread, or with k rows or less, have 0.
    """
    out = None
    for c in cols:
        both = df.select(F.col(c).cast("double").alias("x"), F.col(target).cast("double").alias("y")).where("x IS NOT NULL AND y IS NOT NULL AND NOT isnan(x) AND NOT isnan(y)")
        n, dx, dy, mx, my = both.agg(F.count("*"), F.stddev_pop("x"), F.stddev_pop("y"), F.avg("x"), F.avg("y")).first()
        if n <= k or not dx or not dy:
            value = df.sparkSession.createDataFrame([(c, 0.0)], "feature string, mutual_info double")
        else:
            rows = settle(both.select(F.monotonically_increasing_id().alias("i"), ((F.col("x") - mx) / dx).alias("x"), ((F.col("y") - my) / dy).alias("y")))
            found = nearest(rows.withColumn("v", F.array("x", "y")), rows.withColumn("v", F.array("x", "y")), "i", "i", "v", "v", k, skip_self=True, block=PLANE_BLOCK, leaf_rows=PLANE_BLOCK // 2, metric="chebyshev")
            # A little less than the distance, so that its last digits don't decide whether the neighbour itself counts.
            radius = found.groupBy(F.col("qid").alias("i")).agg((F.max("dist") * (1 - 1e-7)).alias("r"))
            # Counting, cutting and reading the marks are passes of their own, and the search must not be done again in each.
            asks = settle(rows.join(radius, "i"))
            # On each axis: values below the upper bound, less values up to the lower one. Equal places go in the order of ``side``.
            axis = lambda name: F.array(*[F.struct(F.lit(name).alias("axis"), *x) for x in (
                (F.col(name).alias("at"), F.lit(1).alias("side"), F.lit(0).alias("sign")),
                ((F.col(name) + F.col("r")).alias("at"), F.when(F.col("r") > 0, 0).otherwise(2).alias("side"), F.lit(1).alias("sign")),
                ((F.col(name) - F.col("r")).alias("at"), F.when(F.col("r") > 0, 2).otherwise(0).alias("side"), F.lit(-1).alias("sign")))])
            marks = asks.select("i", F.explode(F.concat(axis("x"), axis("y"))).alias("e")).select("i", "e.*")
            counted = running(marks, ["axis"], ["at", "side", "i"], {"below": ("sum", (F.col("sign") == 0).cast("long"))})
            near = counted.where("sign <> 0").groupBy("axis", "i").agg(F.sum(F.col("sign") * F.col("below")).alias("n"))
            mean = near.agg((F.sum(digamma(F.greatest("n", F.lit(1)))) / n).alias("m"))
            both_n = digamma(F.lit(n)) + digamma(F.lit(k))
            value = mean.select(F.lit(c).alias("feature"), F.greatest(both_n - F.col("m"), F.lit(0.0)).alias("mutual_info"))
        out = value if out is None else out.unionByName(value)
    return out


def mutual_info(df: DataFrame, cols: list[str], target: str, task: str) -> DataFrame:
    """By neighbours for a numeric target (task regression), by binned counts for classes."""
    if task not in ("regression", "classification"):
        raise ValueError(f"task is regression or classification, not {task}")
    return neighbour_mutual_info(df, cols, target) if task == "regression" else binned_mutual_info(df, cols, target)


def variances(df: DataFrame, cols: list[str]) -> dict[str, float]:
    return df.agg(*[F.var_pop(F.coalesce(F.col(c).cast("double"), F.lit(0.0))).alias(c) for c in cols]).first().asDict()


def select_by_variance(df: DataFrame, cols: list[str], threshold: float, top: int) -> list[str]:
    """Columns over the threshold, the largest variances first when there are more than ``top``."""
    found = {c: v for c, v in variances(df, cols).items() if v is not None and v > threshold}
    if len(found) <= top:
        return [c for c in cols if c in found]
    return sorted(found, key=lambda c: -found[c])[:top]


class FeatureRegistry:
    """Named Column builders with dependencies, computed level by level in one select per level."""

    def __init__(self):
        self.features: dict[str, tuple] = {}

    def register(self, name: str, build, depends: tuple[str, ...] = (), description: str = "") -> None:
        self.features[name] = (build, tuple(depends), description)

    def levels(self, names: list[str]) -> list[list[str]]:
        depth: dict[str, int] = {}

        def visit(name, trail=()):
            if name in trail:
                raise ValueError(f"features depend on each other: {' > '.join([*trail, name])}")
            if name not in depth:
                depends = [x for x in self.features[name][1] if x in self.features]
                depth[name] = 1 + max((visit(x, (*trail, name)) for x in depends), default=-1)
            return depth[name]

        for n in names:
            if n not in self.features:
                raise ValueError(f"unknown feature {n}")
            visit(n)
        return [sorted(n for n, k in depth.items() if k == level) for level in range(max(depth.values(), default=-1) + 1)]

    def compute(self, df: DataFrame, names: list[str]) -> DataFrame:
        for level in self.levels(names):
            df = df.withColumns({n: self.features[n][0]() for n in level})
        return df


def sensor_columns(temperature: str, pressure: str) -> dict[str, Column]:
    t, p = F.col(temperature), F.col(pressure)
    return {
        "temp_pressure_ratio": F.when(p > 0, t / p).otherwise(0.0), "temp_squared": t * t,
        "pressure_log": F.log1p(F.abs(p)), "temp_celsius": (t - 32) * 5 / 9, "pressure_psi": p * 14.5038,
    }
