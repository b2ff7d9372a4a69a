"""Event-time windows, patterns, forecasts and trends, in stream and batch form."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tablecare.functions.ordered import group_quantiles, row_numbers
from tablecare.functions.params import attach
from tablecare.functions.ranges import QUANTILES, STATISTICS, Ranges, statistics


def with_watermark(df: DataFrame, ts: str, delay: str) -> DataFrame:
    return df.withWatermark(ts, delay) if df.isStreaming else df


def tumbling(df: DataFrame, ts: str, metric: str, value: str, slide: str = "15 seconds", keep: str = "60 seconds") -> DataFrame:
    """Count, sum, mean, min and max per metric and window; rows later than ``keep`` are dropped by the watermark."""
    v = F.col(value)
    return with_watermark(df, ts, keep).groupBy(F.window(ts, slide).alias("w"), F.col(metric).alias("metric")).agg(
        F.count(v).alias("count"), F.sum(v).alias("sum"), F.avg(v).alias("mean"), F.min(v).alias("min"), F.max(v).alias("max")).select(
        F.col("w.start").alias("window_start"), "metric", "count", "sum", "mean", "min", "max")


def split_values(df: DataFrame, value: str) -> tuple[DataFrame, DataFrame]:
    """(rows whose text value is a number, with the number; rejected rows)."""
    from tablecare.operators.profile import NUMBER_TEXT

    good = F.coalesce(F.col(value).rlike(NUMBER_TEXT), F.lit(False))
    return df.where(good).withColumn(value, F.col(value).cast("double")), df.where(~good)


#: Size of the quantile sketches; a quantile's rank is off by RANK_ERROR at most, with 99 % confidence for the stated size.
SKETCH, RANK_ERROR = 800, 0.01
GRID = 500


def window_statistics(df: DataFrame, ts: str, value: str, size: str, slide: str | None = None, keep: str = "1 hour", keys: tuple[str, ...] = ()) -> DataFrame:
    """The 15 statistics of sliding windows, on a stream (append mode) or a table.

    Rows are first summed per pane, a window of the length of the slide: moments and a mergeable quantile sketch (KLL). A window is merged
    from its panes, so a row is read once however many windows hold it, and the state holds a few kilobytes per open pane and window.
    Quantiles and the numbers of outliers come from the sketch: ranks are off by ``RANK_ERROR`` at most, but for one time in a hundred.
    """
    v = F.col(value).cast("double")
    # The condition names the time too, so that it stays behind the watermark, which sees all rows.
    there = F.when(F.col(ts).isNotNull(), F.col(value).isNotNull())
    panes = with_watermark(df, ts, keep).where(there).groupBy(F.window(ts, slide or size).alias("pane"), *keys).agg(
        F.count(v).alias("n"), F.sum(v).alias("s1"), F.avg(v).alias("m"), F.var_pop(v).alias("var"), F.min(v).alias("low"), F.max(v).alias("high"), F.kll_sketch_agg_double(v, SKETCH).alias("sketch"))
    merged = panes.groupBy(F.window(F.window_time("pane"), size, slide or size).alias("w"), *keys).agg(
        F.sum("n").alias("count"), F.sum("s1").alias("sum"), F.sum(F.col("n") * F.col("m")).alias("_s"), F.sum(F.col("n") * (F.col("var") + F.col("m") * F.col("m"))).alias("_s2"),
        F.min("low").alias("min"), F.max("high").alias("max"), F.kll_merge_agg_double("sketch", SKETCH).alias("_sketch"))
    mean = F.col("_s") / F.col("count")
    out = merged.withColumns({"mean": mean, "std": F.sqrt(F.greatest(F.col("_s2") / F.col("count") - mean * mean, F.lit(0.0))), "range": F.col("max") - F.col("min")})
    out = out.withColumns({n: F.kll_sketch_get_quantile_double("_sketch", F.lit(p)) for n, p in QUANTILES.items()}).withColumn("iqr", F.col("p75") - F.col("p25"))
    # The values at the middles of GRID equal shares stand for all; ranks of single values can only be asked at fixed bounds.
    grid = F.kll_sketch_get_quantile_double("_sketch", F.array(*[F.lit((i + 0.5) / GRID) for i in range(GRID)]))
    low, high = F.col("p25") - 1.5 * F.col("iqr"), F.col("p75") + 1.5 * F.col("iqr")
    far = F.size(F.filter(grid, lambda x: (x < low) | (x > high))) / F.lit(GRID)
    out = out.withColumn("outlier_count", F.round(F.col("count") * far).cast("long")).withColumn("outlier_ratio", F.col("outlier_count") / F.col("count"))
    return out.select(F.col("w.start").alias("window_start"), *keys, *STATISTICS)


def multi_window(df: DataFrame, ts: str, value: str, sizes: dict[str, int]) -> DataFrame:
    """15 statistics per window of several sizes (name to seconds), exact and in batch.

    Rows are keyed by (size, window); moments are one partial aggregate, quantiles go through counts per
    value, outliers are counted against the window's own fences.
    """
    us = F.unix_micros(F.col(ts).cast("timestamp"))
    keys = ["size", "window_start"]
    spread = F.array(*[F.struct(F.lit(n).alias("size"), F.timestamp_micros(F.floor(us / (s * 1_000_000)) * (s * 1_000_000)).alias("window_start"))
                       for n, s in sizes.items()])
    rows = df.where(F.col(value).isNotNull()).select(F.col(value).alias("v"), F.explode(spread).alias("w")).select("w.*", "v")
    moments = rows.groupBy(*keys).agg(
        F.count("v").alias("count"), F.sum("v").alias("sum"), F.avg("v").alias("mean"), F.stddev_pop("v").alias("std"),
        F.min("v").alias("min"), F.max("v").alias("max"))
    q = group_quantiles(rows, keys, "v", [0.25, 0.5, 0.75, 0.95, 0.99]).select(
        *keys, *[F.col("quantiles")[i].alias(n) for i, n in enumerate(("p25", "median", "p75", "p95", "p99"))])
    out = moments.join(q, keys).withColumns({"range": F.col("max") - F.col("min"), "iqr": F.col("p75") - F.col("p25")})
    low, high = F.col("p25") - 1.5 * F.col("iqr"), F.col("p75") + 1.5 * F.col("iqr")
    far = rows.join(out.select(*keys, low.alias("_lo"), high.alias("_hi")), keys).groupBy(*keys).agg(
        F.count_if((F.col("v") < F.col("_lo")) | (F.col("v") > F.col("_hi"))).alias("outlier_count"))
    return out.join(far, keys).withColumn("outlier_ratio", F.col("outlier_count") / F.col("count"))


def trailing(df: DataFrame, ts: str, value: str, sizes: dict[str, int], keys: list[str], blocks: int = 6) -> DataFrame:
    """The 15 statistics over the last seconds before each row (itself and rows of the same time included), for several sizes (name to seconds).

    A key's history is cut into blocks ``blocks`` times as long as the longest size; the rows of the last of these sizes lead in the next
    block. A task holds one block of a key, however long the history is, sorts it by time and answers the ranges of all its rows together
    (``functions.ranges``): the work grows with rows times the logarithm of a block's, not with the rows of a window. Missing values don't count.
    Rows without a time come back without statistics.
    """
    longest = max(sizes.values()) * 1_000_000
    at = F.unix_micros(F.col(ts).cast("timestamp"))
    length = longest * max(blocks, 1)
    home = F.floor(F.col("_at") / length)
    spread = F.when(F.pmod("_at", F.lit(length)) >= length - longest, F.array(home, home + 1)).otherwise(F.array(home))
    rows = df.withColumn("_at", at)
    led = rows.where("_at IS NOT NULL").withColumn("_home", home).withColumn("_block", F.explode(spread)).withColumn("_value", F.col(value).cast("double"))
    columns, made = df.columns, [(f"{s}_{name}", "bigint" if s in ("count", "outlier_count") else "double") for name in sizes for s in STATISTICS]

    def run(group: pa.Table) -> pa.Table:
        group = group.take(pa.compute.sort_indices(group, [("_at", "ascending")]))
        times, values = group.column("_at").to_numpy(), group.column("_value").to_numpy(zero_copy_only=False)
        there = ~np.isnan(values)
        before = np.concatenate([[0], np.cumsum(there)])
        own = group.column("_home").to_numpy() == group.column("_block").to_numpy()
        mine = times[own]
        right = before[np.searchsorted(times, mine, "right")]
        values = values[there]
        ranges = Ranges(values)
        out = [group.column(c).filter(pa.array(own)) for c in columns]
        for name, seconds in sizes.items():
            found = statistics(values, before[np.searchsorted(times, mine - seconds * 1_000_000, "left")], right, ranges)
            out += [pa.array(x, pa.int64()) if x.dtype.kind == "i" else pa.array(x, pa.float64(), mask=np.isnan(x)) for x in (found[s] for s in STATISTICS)]
        return pa.Table.from_arrays(out, names=[*columns, *[n for n, _ in made]])

    schema = T.StructType([*df.schema.fields, *[T.StructField(n, T.LongType() if k == "bigint" else T.DoubleType()) for n, k in made]])
    done = led.groupBy(*[F.col(k) for k in keys], "_block").applyInArrow(run, schema)
    return done.unionByName(rows.where("_at IS NULL").drop("_at"), allowMissingColumns=True)


def patterns(stats: DataFrame, sizes: dict[str, int]) -> DataFrame:
    """Trend and volatility across window sizes that end at the same time; all sizes must be there.

    ``sizes`` goes from the shortest to the longest window.
    """
    names = list(sizes)
    ends = stats.withColumn("window_end", F.timestamp_micros(
        F.unix_micros("window_start") + sum((F.when(F.col("size") == n, s * 1_000_000).otherwise(0) for n, s in sizes.items()), F.lit(0))))
    per = ends.groupBy("window_end").agg(
        F.count(F.lit(1)).alias("_n"),
        *[F.max(F.when(F.col("size") == n, F.col("mean"))).alias(f"_m{i}") for i, n in enumerate(names)],
        F.avg("mean").alias("avg_mean"), F.avg("std").alias("avg_std"))
    first, last = F.col("_m0"), F.col(f"_m{len(names) - 1}")
    return per.where(F.col("_n") == len(names)).select(
        "window_end", "avg_mean", "avg_std",
        F.when(last > first * 1.1, "increasing").when(last < first * 0.9, "decreasing").otherwise("stable").alias("trend"),
        F.when(F.col("avg_std") > F.col("avg_mean") * 0.3, "high").when(F.col("avg_std") < F.col("avg_mean") * 0.1, "low").otherwise("normal").alias("volatility"))


def forecast(df: DataFrame, value: str, keys: list[str], order: list[str], last: int = 10) -> DataFrame:
    """Linear extrapolation of the last rows per key, with slope and bounded fit quality.

    The rank limit runs before the shuffle, so a long key sends only ``last`` rows per task.
    """
    w = W.partitionBy(*keys).orderBy(*[F.desc(c) for c in order])
    tail = df.withColumn("_back", F.row_number().over(w)).where(F.col("_back") <= last)
    x, y = (-F.col("_back")).cast("double"), F.col(value).cast("double")
    fit = tail.groupBy(*keys).agg(F.count(y).alias("points"), F.regr_slope(y, x).alias("trend_slope"), F.regr_intercept(y, x).alias("_b"), F.regr_r2(y, x).alias("_r2"))
    # x counts back from -1, so the next row is at 0.
    return fit.where(F.col("points") >= 3).select(*keys, "points", F.col("_b").alias("next_value"), "trend_slope",
                                                  F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.col("_r2"))).alias("confidence"))


def trend_thirds(df: DataFrame, value: str, keys: list[str], order: list[str]) -> DataFrame:
    """Mean of the first third against the last third (rounded up) of each key, with a 10% band."""
    placed = row_numbers(df, keys, order, "_rn")
    sizes = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"))
    rows = attach(placed, sizes, keys)
    first = F.avg(F.when(F.col("_rn") <= F.floor(F.col("_n") / 3), F.col(value)))
    last = F.avg(F.when(F.col("_rn") > F.col("_n") - F.ceil(F.col("_n") / 3), F.col(value)))
    out = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), first.alias("first_third"), last.alias("last_third"))
    return out.withColumn("trend", F.when(F.col("n") < 3, "insufficient_data").when(F.col("last_third") > F.col("first_third") * 1.1, "upward")
                          .when(F.col("last_third") < F.col("first_third") * 0.9, "downward").otherwise("stable"))


def rolling_zscore(df: DataFrame, value: str, keys: list[str], order: list[str], span: int = 100, cut: float = 2.5) -> DataFrame:
    """Batch form: distance of each value from the mean of the last ``span`` values of its key, itself included."""
    from tablecare.functions.ordered import framed

    def build(w):
        frame = w.rowsBetween(-(span - 1), 0)
        return {"_n": F.count(value).over(frame), "_m": F.avg(value).over(frame), "_s": F.stddev_pop(value).over(frame)}

    out = framed(df, keys, order, span - 1, build)
    score = F.when((F.col("_n") > 2) & (F.col("_s") > 0), F.abs(F.col(value) - F.col("_m")) / F.col("_s")).otherwise(0.0)
    return out.withColumn("anomaly_score", score).withColumn("is_anomaly", F.col("anomaly_score") > cut).drop("_n", "_m", "_s")


def baseline_anomaly(value: Column, mean: float, std: float, cut: float = 3.0) -> Column:
    """Fixed-baseline form."""
    return F.abs(value - F.lit(mean)) / F.lit(std) > cut


def batch_summary(batch: DataFrame, cols: list[str], cut: float = 3.0) -> DataFrame:
    """One row for a micro-batch: size, complete rows, moments and ranges per column, share of rows beyond ``cut`` deviations."""
    whole = F.lit(True)
    for c in cols:
        whole = whole & F.col(c).isNotNull()
    aggs = [F.count(F.lit(1)).alias("rows"), F.count_if(whole).alias("valid_rows")]
    for c in cols:
        aggs += [F.avg(c).alias(f"{c}_mean"), F.stddev_pop(c).alias(f"{c}_std"), F.min(c).alias(f"{c}_min"), F.max(c).alias(f"{c}_max")]
    row = batch.agg(*aggs)
    stats = row.first()
    far = F.lit(False)
    for c in cols:
        if stats[f"{c}_std"]:
            far = far | F.coalesce(F.abs(F.col(c) - F.lit(stats[f"{c}_mean"])) / F.lit(stats[f"{c}_std"]) > cut, F.lit(False))
    rate = batch.agg(F.avg(far.cast("double")).alias("r")).first()["r"]
    return row.withColumn("anomaly_rate", F.lit(rate))
