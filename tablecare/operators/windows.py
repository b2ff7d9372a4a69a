"""Ranks, retention, trends, anomalies and rates over ordered logs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tablecare.functions.ordered import framed, row_numbers, running


def leaderboard(df: DataFrame, score: str, ties: list[str]) -> DataFrame:
    """Rank by score, highest first (equal scores share a rank), and the share of the best score."""
    counts = df.groupBy(score).agg(F.count(F.lit(1)).alias("_n"))
    cum = running(counts.withColumn("_neg", -F.col(score)), [], ["_neg"], {"_cum": ("sum", F.col("_n"))})
    ranks = cum.select(score, (F.col("_cum") - F.col("_n") + 1).alias("rank"))
    best = df.agg(F.max(score)).first()[0]
    from tablecare.functions.params import attach

    return attach(df, ranks, [score]).withColumn("relative", F.col(score) / F.lit(best))


def keep_versions(df: DataFrame, keys: list[str], order: list[str], keep_last: int, protected: Column) -> DataFrame:
    """Mark versions to remove: not protected and not among the newest ``keep_last`` of the rest.

    The rest is numbered from the newest on; the newest rows are those with the greatest position.
    """
    rest = df.where(~protected)
    numbered = row_numbers(rest, keys, order, "_rn")
    sizes = rest.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"))
    from tablecare.functions.params import attach

    marked = attach(numbered, sizes, keys).withColumn("removed", F.col("_rn") <= F.col("_n") - keep_last).drop("_rn", "_n")
    return marked.unionByName(df.where(protected).withColumn("removed", F.lit(False)))


def first_last(df: DataFrame, keys: list[str], order: list[str], cols: list[str]) -> DataFrame:
    """Earliest and latest value per key; map-side partial aggregates carry one row per key and task."""
    at = F.struct(*[F.col(c) for c in order])
    return df.groupBy(*keys).agg(*[x for c in cols for x in (F.min_by(c, at).alias(f"first_{c}"), F.max_by(c, at).alias(f"last_{c}"))])


def recent_trend(df: DataFrame, value: str, keys: list[str], order: list[str], band: float = 0.05) -> DataFrame:
    """Mean of the last 10 rows, and the last 3 against the 7 before them."""
    def build(w):
        return {
            "avg_10": F.avg(value).over(w.rowsBetween(-9, 0)), "_n": F.count(value).over(w.rowsBetween(-9, 0)),
            "_last": F.avg(value).over(w.rowsBetween(-2, 0)), "_prev": F.avg(value).over(w.rowsBetween(-9, -3)),
            "_first": F.first(value).over(w.rowsBetween(-9, 0)),
        }

    out = framed(df, keys, order, 9, build)
    # Short starts: under three rows the newest value stands for the recent mean, up to three the first for the earlier one.
    recent = F.when(F.col("_n") >= 3, F.col("_last")).otherwise(F.col(value))
    before = F.when(F.col("_n") > 3, F.col("_prev")).otherwise(F.col("_first"))
    change = F.when(before != 0, (recent - before) / before).otherwise(0.0)
    trend = F.when(F.col("_n") < 2, "stable").when(change < -band, "decreasing").when(change > band, "increasing").otherwise("stable")
    return out.withColumn("trend", trend).drop("_n", "_last", "_prev", "_first")


def training_anomalies(df: DataFrame, loss: str, keys: list[str], order: list[str]) -> DataFrame:
    """Loss over ten times the mean of the last 5, deviation of the last 20 under 0.001, NaN losses."""
    def build(w):
        return {"_rows": F.count(F.lit(1)).over(w.rowsBetween(-20, 0)),
                "_mean5": F.avg(loss).over(w.rowsBetween(-4, 0)), "_std20": F.stddev_pop(loss).over(w.rowsBetween(-19, 0))}

    out = framed(df, keys, order, 20, build)
    return out.withColumns({
        "explosion": F.coalesce((F.col("_rows") > 5) & (F.col(loss) > 10 * F.col("_mean5")), F.lit(False)),
        "stagnation": F.coalesce((F.col("_rows") > 20) & (F.col("_std20") < 0.001), F.lit(False)),
        "nan_loss": F.coalesce(F.isnan(loss), F.lit(False)),
    }).drop("_rows", "_mean5", "_std20")


def trailing_counts(df: DataFrame, key: str, ts: str, seconds: int, out: str = "calls") -> DataFrame:
    """Calls of a key in the ``seconds`` up to each call.

    Calls are first counted per exact time. Time is cut in blocks of an hour or more, and each count is sent
    also to the next block when it can still matter there, so a busy key spreads over its blocks. Calls without a time or a key have no count.
    """
    us = F.unix_micros(F.col(ts).cast("timestamp"))
    span = seconds * 1_000_000
    block = max(3600, seconds) * 1_000_000
    per = df.groupBy(key, us.alias("_us")).agg(F.count(F.lit(1)).alias("_n"))
    home = F.floor(F.col("_us") / block)
    led = per.withColumn("_home", home).withColumn(
        "_block", F.explode(F.when(F.col("_us") % block >= block - span, F.array(home, home + 1)).otherwise(F.array(home))))
    w = W.partitionBy(key, "_block").orderBy("_us").rangeBetween(-span, 0)
    counted = led.withColumn(out, F.sum("_n").over(w)).where("_home = _block").select(key, "_us", out)
    return df.withColumn("_us", us).join(counted, [key, "_us"], "left").drop("_us")


def run_summary(df: DataFrame, keys: list[str], value: str, order: list[str], ts: str) -> DataFrame:
    """Best and final value, steps, and mean seconds per step."""
    at = F.struct(*[F.col(c) for c in order])
    us = F.unix_micros(F.col(ts).cast("timestamp"))
    out = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("steps"), F.min(value).alias("best"), F.max(value).alias("worst"),
                                F.max_by(value, at).alias("final"), ((F.max(us) - F.min(us)) / 1e6).alias("_secs"))
    return out.withColumn("seconds_per_step", F.col("_secs") / F.col("steps")).drop("_secs")
