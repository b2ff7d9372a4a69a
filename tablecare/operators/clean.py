"""Cleaning operators: parameters are fitted in one pass over the whole table and applied as literals or a join."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tablecare.functions.columns import PRICE_WORDS, clip, has_word, is_missing, numeric_columns, sentinels_for
from tablecare.functions.ordered import few_group_quantile, group_quantiles, quantiles, row_numbers, running
from tablecare.functions.params import attach, fitted
from tablecare.functions.tails import probit
from tablecare.operators.profile import fences, outside, value_counts
from tablecare.session import is_small


def null_sentinels(df: DataFrame, cols: list[str] | None = None, sentinels=None) -> DataFrame:
    """Sentinel numbers to null in numeric columns."""
    cols = cols or numeric_columns(df)
    pick = (lambda c: sentinels_for(c, sentinels)) if sentinels else sentinels_for
    return df.withColumns({c: F.when(~F.col(c).isin(pick(c)), F.col(c)) for c in cols})


def group_medians(df: DataFrame, by: str, cols: list[str], positive: bool = False) -> DataFrame:
    """Exact median of each column per group: columns ``by`` and ``_med_<column>``."""
    values = {c: F.when(F.col(c) > 0, F.col(c)) if positive else F.col(c) for c in cols}
    if is_small(df):
        return df.where(F.col(by).isNotNull()).groupBy(by).agg(*[F.median(v).alias(f"_med_{c}") for c, v in values.items()])
    few = few_group_quantile(df, by, values, 0.5)
    if few is not None:
        schema = T.StructType([T.StructField(by, df.schema[by].dataType), *[T.StructField(f"_med_{c}", T.DoubleType()) for c in cols]])
        return df.sparkSession.createDataFrame(few, schema)
    long = df.where(F.col(by).isNotNull()).select(by, F.explode(F.array(*[
        F.struct(F.lit(c).alias("feature"), v.cast("double").alias("value")) for c, v in values.items()])).alias("r"))
    long = long.select(by, "r.feature", "r.value")
    found = group_quantiles(long, [by, "feature"], "value", [0.5], small=False)
    return found.groupBy(by).agg(*[
        F.max(F.when(F.col("feature") == c, F.col("quantiles")[0])).alias(f"_med_{c}") for c in cols])


def fix_negative_prices(df: DataFrame, cols: list[str] | None = None, by: str | None = "category",
                        positive: bool = True) -> DataFrame:
    """Negative prices to the median of their group, or of all positive values when there is no group column.

    A price whose group is missing or has no positive price stays as it is.
    """
    cols = cols or [c for c in numeric_columns(df) if has_word(c, PRICE_WORDS)]
    if not cols:
        return df
    if by and by in df.columns:
        usable = df if positive else df.withColumns({c: F.when(F.col(c) >= 0, F.col(c)) for c in cols})
        out = attach(df, group_medians(usable, by, cols, positive), [by])
        fixed = {c: F.when(F.col(c) < 0, F.coalesce(F.col(f"_med_{c}"), F.col(c))).otherwise(F.col(c)) for c in cols}
        return out.withColumns(fixed).select(*df.columns)
    above = df.select(*[F.when(F.col(c) > 0, F.col(c)).alias(c) for c in cols])
    med = quantiles(above, cols, [0.5])
    return df.withColumns({c: F.when(F.col(c) < 0, F.lit(med[c][0])).otherwise(F.col(c)) for c in cols})


def modes(df: DataFrame, cols: list[str]) -> dict:
    """Most frequent value per column, ties to the smallest; null when a column has no value."""
    out = {}
    for c in cols:
        row = df.where(~is_missing(df, c)).groupBy(c).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), c).first()
        out[c] = row[0] if row else None
    return out


def fit_fill(df: DataFrame, cols: list[str], method: str, value=None) -> dict:
    """The value that fills each column."""
    if method == "constant":
        return {c: value for c in cols}
    if method == "mode":
        return modes(df, cols)
    if method == "mean":
        row = df.agg(*[F.avg(F.when(~is_missing(df, c), F.col(c))).alias(c) for c in cols]).first()
        return row.asDict()
    if method == "median":
        return {c: q[0] for c, q in quantiles(df, cols, [0.5]).items()}
    raise ValueError(f"unknown fill method {method}")


def apply_fill(df: DataFrame, values: dict) -> DataFrame:
    return df.withColumns({
        c: F.when(is_missing(df, c), F.lit(v)).otherwise(F.col(c)) for c, v in values.items() if v is not None})


def fill(df: DataFrame, cols: list[str], method: str = "median", value=None) -> DataFrame:
    return apply_fill(df, fit_fill(df, cols, method, value))


def fill_by_group(df: DataFrame, cols: list[str], by: str) -> DataFrame:
    """Missing cells to the median of their group; a group without values stays null."""
    out = attach(df, group_medians(df, by, cols), [by])
    return out.withColumns({c: F.coalesce(F.col(c), F.col(f"_med_{c}")) for c in cols}).select(*df.columns)


def forward_fill(df: DataFrame, col: str, keys: list[str], order: list[str], out: str | None = None) -> DataFrame:
    """Last value seen so far in key order."""
    return running(df, keys, order, {out or col: ("last", F.col(col))})


def backward_fill(df: DataFrame, col: str, keys: list[str], order: list[str], out: str | None = None) -> DataFrame:
    """Next value in key order."""
    return running(df, keys, order, {out or col: ("last", F.col(col))}, descending=True)


def clip_quantiles(df: DataFrame, cols: list[str], low: float = 0.01, high: float = 0.99) -> DataFrame:
    bounds = quantiles(df, cols, [low, high])
    return df.withColumns({c: clip(F.col(c), *bounds[c]) for c in cols if bounds[c][0] is not None})


def clip_fences(df: DataFrame, cols: list[str]) -> DataFrame:
    """Clip to the IQR fences where the IQR is not zero."""
    bounds = {c: b for c, b in fences(df, cols).items() if b[1] > b[0]}
    return df.withColumns({c: clip(F.col(c), *bounds[c]) for c in bounds})


def remove_outliers(df: DataFrame, cols: list[str], factor: float = 1.5) -> DataFrame:
    """Rows inside all fences; a missing cell is no outlier."""
    bounds = fences(df, cols, factor)
    for c, b in bounds.items():
        df = df.where(~F.coalesce(outside(c, b), F.lit(False)))
    return df


def log_positive(df: DataFrame, cols: list[str]) -> DataFrame:
    """log1p of columns whose values are all positive."""
    low = df.agg(*[F.min(c).alias(c) for c in cols]).first()
    return df.withColumns({c: F.log1p(c) for c in cols if low[c] is not None and low[c] > 0})


def drop_duplicates(df: DataFrame) -> DataFrame:
    """One row per distinct row; whole rows are equal, so it does not matter which copy stays."""
    return df.dropDuplicates()


def rare_values(df: DataFrame, col: str, share: float = 0.01) -> DataFrame:
    """Values under the share of all rows (nulls counted in the total)."""
    total = df.count()
    counts = df.where(F.col(col).isNotNull()).groupBy(col).agg(F.count(F.lit(1)).alias("_n"))
    return counts.where(F.col("_n") / F.lit(total) < share).select(col)


def group_rare(df: DataFrame, col: str, share: float = 0.01, other: str = "Other") -> DataFrame:
    """Rare values to one label; the kept values (at most 1 / share) are the fitted table."""
    total = df.count()
    counts = df.where(F.col(col).isNotNull()).groupBy(col).agg(F.count(F.lit(1)).alias("_n"))
    # At most 1 / share values can reach the share, so this list is bounded whatever the table size.
    kept = [r[0] for r in counts.where(F.col("_n") / F.lit(total) >= share).collect()]
    keep = F.col(col).isNull() | F.col(col).isin(kept)
    return df.withColumn(col, F.when(keep, F.col(col)).otherwise(F.lit(other)))


def scale(df: DataFrame, cols: list[str], method: str = "minmax") -> DataFrame:
    """min-max, z-score (sample deviation) or robust scaling; columns without spread stay as they are."""
    out = {}
    if method == "robust":
        for c, (q1, q2, q3) in quantiles(df, cols, [0.25, 0.5, 0.75]).items():
            if q1 is not None and q3 > q1:
                out[c] = (F.col(c) - F.lit(q2)) / F.lit(q3 - q1)
        return df.withColumns(out) if out else df
    aggs = {"minmax": (F.min, F.max), "zscore": (F.avg, F.stddev_samp)}[method]
    row = df.agg(*[f(c).alias(f"{i}_{c}") for c in cols for i, f in enumerate(aggs)]).first()
    for c in cols:
        a, b = row[f"0_{c}"], row[f"1_{c}"]
        spread = None if a is None or b is None else (b - a if method == "minmax" else b)
        if spread:
            out[c] = (F.col(c) - F.lit(a)) / F.lit(spread)
    return df.withColumns(out) if out else df


def standardize(df: DataFrame, cols: list[str]) -> DataFrame:
    """Zero mean and unit population deviation; a constant column becomes zero."""
    row = df.agg(*[f(c).alias(f"{i}_{c}") for c in cols for i, f in enumerate((F.avg, F.stddev_pop))]).first()
    return df.withColumns({
        c: (F.col(c) - F.lit(row[f"0_{c}"])) / F.lit(row[f"1_{c}"] or 1.0) for c in cols if row[f"0_{c}"] is not None})


def quantile_share(df: DataFrame, col: str, out: str) -> DataFrame:
    """Mid-rank of each value over the row count, from 0 to 1.

    Ranks come from counts per distinct value and running totals; the values join back to the rows.
    """
    counts = df.where(F.col(col).isNotNull()).groupBy(col).agg(F.count(F.lit(1)).alias("_c"))
    ranked = running(counts, [], [col], {"_cum": ("sum", F.col("_c"))})
    total = df.select(F.count(col)).first()[0]
    share = (F.col("_cum") - (F.col("_c") + 1) / 2.0) / F.lit(max(total - 1, 1))
    return attach(df, ranked.select(col, share.alias(out)), [col])


def quantile_normal(df: DataFrame, col: str, out: str) -> DataFrame:
    """Rank shares mapped through the normal quantile, clipped at 1e-7 from both ends."""
    shared = quantile_share(df, col, "_share")
    bounded = F.least(F.greatest(F.col("_share"), F.lit(1e-7)), F.lit(1 - 1e-7))
    return shared.withColumn(out, probit(bounded)).drop("_share")


def power_value(c: Column, lam: float) -> Column:
    """Yeo-Johnson value for one lambda."""
    up = F.log1p(c) if abs(lam) < 1e-12 else (F.pow(c + 1, F.lit(lam)) - 1) / lam
    down = -F.log1p(-c) if abs(lam - 2) < 1e-12 else -(F.pow(1 - c, F.lit(2 - lam)) - 1) / (2 - lam)
    return F.when(c >= 0, up).otherwise(down)


def _power_variances(values: DataFrame, grid: list[float]) -> list[float]:
    """Population variance of the Yeo-Johnson values of one column for each lambda. A task gives one row of moments for every lambda; 25
    powers in one aggregate are too much code for the JVM to compile."""
    def powered(x: np.ndarray, lam: float) -> np.ndarray:
        out, up = np.empty(len(x)), ~(x < 0)
        out[up] = np.log1p(x[up]) if abs(lam) < 1e-12 else (np.power(x[up] + 1, lam) - 1) / lam
        out[~up] = -np.log1p(-x[~up]) if abs(lam - 2) < 1e-12 else -(np.power(1 - x[~up], 2 - lam) - 1) / (2 - lam)
        return out

    def merged(one, two):
        (n, mean, square), (m, other, more) = one, two
        if not n or not m:
            return two if m else one
        gap = other - mean
        return n + m, mean + gap * m / (n + m), square + more + gap * gap * n * m / (n + m)

    nothing = (0, np.zeros(len(grid)), np.zeros(len(grid)))

    def run(batches):
        held = nothing
        for batch in batches:
            x = batch.column(0).to_numpy(zero_copy_only=False)
            if len(x):
                with np.errstate(all="ignore"):
                    y = np.stack([powered(x, g) for g in grid])
                    held = merged(held, (len(x), y.mean(1), y.var(1) * len(x)))
        if held[0]:
            yield pa.RecordBatch.from_pydict({"n": [held[0]], "mean": [held[1].tolist()], "square": [held[2].tolist()]})

    whole = nothing
    for r in values.mapInArrow(run, "n bigint, mean array<double>, square array<double>").collect():
        whole = merged(whole, (r["n"], np.array(r["mean"]), np.array(r["square"])))
    return (whole[2] / max(whole[0], 1)).tolist()


def fit_power(df: DataFrame, col: str, rounds: int = 3) -> float:
    """Lambda of greatest likelihood: a grid in one aggregate, refined around the best."""
    import math

    low, high, best = -2.0, 4.0, 1.0
    c = F.col(col).cast("double")
    base = df.agg(F.count(c).alias("n"), F.sum(F.signum(c) * F.log1p(F.abs(c))).alias("j")).first()
    if not base["n"]:
        return best
    values = df.select(c.alias("c")).where("c IS NOT NULL")
    for _ in range(rounds):
        grid = [low + (high - low) * i / 24 for i in range(25)]
        scores = [(-0.5 * base["n"] * math.log(v) + (g - 1) * base["j"], g)
                  for g, v in zip(grid, _power_variances(values, grid)) if v > 0]
        if not scores:
            return best
        best = max(scores)[1]
        step = (high - low) / 24
        low, high = best - step, best + step
    return best


def label_codes(df: DataFrame, col: str, first_seen: list[str] | None = None) -> DataFrame:
    """Value to code from 0: in sorted order, or by first appearance in the given order."""
    if first_seen:
        values = df.where(F.col(col).isNotNull()).groupBy(col).agg(F.min(F.struct(*first_seen)).alias("_o"))
        return row_numbers(values, [], ["_o"], "_c").select(col, (F.col("_c") - 1).alias("code"))
    values = df.where(F.col(col).isNotNull()).select(col).distinct()
    return row_numbers(values, [], [col], "_c").select(col, (F.col("_c") - 1).alias("code"))


def label_encode(df: DataFrame, col: str, out: str | None = None, first_seen: list[str] | None = None) -> DataFrame:
    """Codes by join; unseen and missing values get -1."""
    joined = attach(df, label_codes(df, col, first_seen), [col])
    code = F.coalesce(F.col("code"), F.lit(-1).cast("bigint"))
    target = out or col
    return joined.withColumn("_code", code).drop("code", *([col] if target == col else [])).withColumnRenamed("_code", target)


ONE_HOT_LIMIT = 1000


class TooManyValues(RuntimeError):
    """More values than a table can have columns; a plan that is replayed stops here instead of leaving the column out."""


def one_hot(df: DataFrame, col: str, values: list | None = None) -> DataFrame:
    """One 0/1 column per fitted value; refuses columns with more values than a table can have columns."""
    if values is None:
        rows = df.where(F.col(col).isNotNull()).select(col).distinct().orderBy(col).take(ONE_HOT_LIMIT + 1)
        if len(rows) > ONE_HOT_LIMIT:
            raise TooManyValues(f"{col} has over {ONE_HOT_LIMIT} values; use label or target encoding")
        values = [r[0] for r in rows]
    hot = {f"{col}_{v}": F.when(F.col(col) == F.lit(v), 1).otherwise(0) for v in values}
    return df.withColumns(hot).drop(col)
