"""Drift tests between a reference and a current table; statistics in Spark, tails on the few result rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tablecare.functions.columns import melt_row, numeric_columns
from tablecare.functions.ordered import quantiles, running
from tablecare.functions.tails import chi2_p, ks_p
from tablecare.operators import sketches as sk
from tablecare.session import settle


def _sides(ref: DataFrame, cur: DataFrame, cols: list[str], text: bool) -> DataFrame:
    """Long counts (feature, value, n_ref, n_cur): one shuffle, pre-aggregated by value."""
    kind = "string" if text else "double"

    def long(df: DataFrame, side: int) -> DataFrame:
        pairs = F.array(*[F.struct(F.lit(c).alias("feature"), F.col(c).cast(kind).alias("value")) for c in cols])
        return df.select(F.explode(pairs).alias("r")).select("r.feature", "r.value", F.lit(side).alias("side"))

    both = long(ref, 0).unionByName(long(cur, 1)).where(F.col("value").isNotNull())
    if not text:
        both = both.where(~F.isnan("value"))
    return both.groupBy("feature", "value").agg(
        F.count_if(F.col("side") == 0).alias("n_ref"), F.count_if(F.col("side") == 1).alias("n_cur"))


def ks_test(ref: DataFrame, cur: DataFrame, cols: list[str], level: float = 0.05) -> DataFrame:
    """Two-sample Kolmogorov-Smirnov per column: greatest gap of the running shares over the joint values."""
    counts = _sides(ref, cur, cols, text=False)
    cum = running(counts, ["feature"], ["value"], {"c_ref": ("sum", F.col("n_ref")), "c_cur": ("sum", F.col("n_cur"))})
    cum = settle(cum.select("feature", "c_ref", "c_cur"))
    totals = cum.groupBy("feature").agg(F.max("c_ref").alias("n"), F.max("c_cur").alias("m"))
    gap = F.max(F.abs(F.col("c_ref") / F.col("n") - F.col("c_cur") / F.col("m"))).alias("statistic")
    out = cum.join(F.broadcast(totals), "feature").groupBy("feature", "n", "m").agg(gap)
    return out.withColumn("p_value", ks_p("statistic", F.col("n").cast("double"), F.col("m").cast("double"))).withColumn(
        "drifted", F.col("p_value") < level)


def chi2_table(counts: DataFrame, keys: list[str]) -> DataFrame:
    """Chi-square of a 2 x k count table (n_a, n_b per value) per key, with the Yates term at one degree."""
    if not keys:
        return chi2_table(counts.withColumn("_all", F.lit(1)), ["_all"]).drop("_all")
    totals = counts.groupBy(*keys).agg(F.sum("n_a").alias("_a"), F.sum("n_b").alias("_b"), F.count(F.lit(1)).alias("_k"))
    # One row per feature: bounded by the number of columns.
    joined = counts.join(F.broadcast(totals), keys)
    n, row = F.col("_a") + F.col("_b"), F.col("n_a") + F.col("n_b")

    def cell(obs: str, side: str) -> Column:
        e = row * F.col(side) / n
        gap = F.abs(F.col(obs) - e)
        gap = F.when(F.col("_k") == 2, gap - F.least(F.lit(0.5), gap)).otherwise(gap)
        return gap * gap / e

    out = joined.groupBy(*keys).agg(F.sum(cell("n_a", "_a") + cell("n_b", "_b")).alias("statistic"),
                                    (F.first("_k") - 1).alias("dof"), F.first(F.col("_a") + F.col("_b")).alias("n"))
    return out.withColumn("p_value", chi2_p("statistic", F.col("dof").cast("double")))


def chi2_test(ref: DataFrame, cur: DataFrame, cols: list[str], level: float = 0.05) -> DataFrame:
    """Chi-square contingency of value counts per text column; columns with one value are left out."""
    counts = _sides(ref, cur, cols, text=True).select("feature", "value", F.col("n_ref").alias("n_a"), F.col("n_cur").alias("n_b"))
    out = chi2_table(counts, ["feature"]).where(F.col("dof") > 0)
    return out.withColumn("drifted", F.col("p_value") < level)


def chi2_smoothed(ref: DataFrame, cur: DataFrame, col: str) -> DataFrame:
    """Fit of the current counts to the reference counts, one added to both, expected scaled to the current total."""
    counts = _sides(ref, cur, [col], text=True).select(
        "feature", "value", (F.col("n_cur") + 1).alias("o"), (F.col("n_ref") + 1).alias("e"))
    totals = counts.groupBy("feature").agg(F.sum("o").alias("_o"), F.sum("e").alias("_e"))
    e = F.col("e") * F.col("_o") / F.col("_e")
    out = counts.join(F.broadcast(totals), "feature").groupBy("feature").agg(
        F.sum((F.col("o") - e) * (F.col("o") - e) / e).alias("statistic"), (F.count(F.lit(1)) - 1).alias("dof"))
    return out.withColumn("p_value", chi2_p("statistic", F.col("dof").cast("double")))


def _psi_terms(shares: DataFrame, cut: float) -> DataFrame:
    a = F.when(F.col("p_cur") == 0, 0.0001).otherwise(F.col("p_cur"))
    e = F.when(F.col("p_ref") == 0, 0.0001).otherwise(F.col("p_ref"))
    return shares.groupBy("feature").agg(F.sum((a - e) * F.log(a / e)).alias("psi")).withColumn("drifted", F.col("psi") > cut)


def _bin_shares(df: DataFrame, edges: dict[str, list[float]]) -> DataFrame:
    """Share of rows per feature and bin, every bin present; bins are open left, closed right, ends unbounded."""
    pairs = []
    for c, inner in edges.items():
        code = F.lit(0)
        for x in inner:
            code = code + F.when(F.col(c) > x, 1).otherwise(0)
        pairs.append(F.struct(F.lit(c).alias("feature"), F.when(F.col(c).isNotNull(), code).alias("bin")))
    found = df.select(F.explode(F.array(*pairs)).alias("r")).select("r.*").where(F.col("bin").isNotNull())
    return found.groupBy("feature", "bin").agg(F.count(F.lit(1)).alias("n"))


def psi_of_sketches(ref: DataFrame, cur: DataFrame, bins: int = 10, cut: float = 0.25) -> DataFrame:
    """Population stability index from the sketches of both sides (``operators.sketches``); neither table is read again."""
    edges = sk.quantile_edges(ref, bins)
    if not edges:
        return ref.sparkSession.createDataFrame([], "feature string, psi double, drifted boolean")
    both = sk.shares(ref, edges, "p_ref").join(sk.shares(cur, edges, "p_cur"), ["feature", "bin"])
    return _psi_terms(both, cut)


def psi(ref: DataFrame, cur: DataFrame, cols: list[str], bins: int = 10, cut: float = 0.25, exact: bool = True) -> DataFrame:
    """Population stability index on quantile bins of the reference; repeated edges are merged. Not ``exact``: one pass a side, by sketches."""
    if not exact:
        return psi_of_sketches(settle(sk.sketch(ref, cols)), settle(sk.sketch(cur, cols)), bins, cut)
    probs = [i / bins for i in range(1, bins)]
    found = quantiles(ref, cols, [0.0, *probs, 1.0])
    edges = {c: sorted(set(q[1:-1])) for c, q in found.items() if q[0] is not None}
    spark = ref.sparkSession
    grid = spark.createDataFrame([(c, i) for c, e in edges.items() for i in range(len(e) + 1)], "feature string, bin int")
    a, b = _bin_shares(ref, edges), _bin_shares(cur, edges)
    full = grid.join(a.withColumnRenamed("n", "n_ref"), ["feature", "bin"], "left").join(
        b.withColumnRenamed("n", "n_cur"), ["feature", "bin"], "left").fillna(0, ["n_ref", "n_cur"])
    return _psi_terms(_shares(full), cut)


def _shares(counts: DataFrame) -> DataFrame:
    totals = counts.groupBy("feature").agg(F.sum("n_ref").alias("_r"), F.sum("n_cur").alias("_c"))
    return counts.join(F.broadcast(totals), "feature").select("feature", (F.col("n_ref") / F.col("_r")).alias("p_ref"),
                                                 (F.col("n_cur") / F.col("_c")).alias("p_cur"))


def psi_categories(ref: DataFrame, cur: DataFrame, cols: list[str], cut: float = 0.25) -> DataFrame:
    """Stability index over the values of text columns."""
    return _psi_terms(_shares(_sides(ref, cur, cols, text=True)), cut)


def mean_shift(ref: DataFrame, cur: DataFrame, cols: list[str], cut: float = 0.2) -> DataFrame:
    """Relative change of the mean over the absolute reference mean."""
    a = melt_row(ref.agg(*[F.avg(c).alias(c) for c in cols]), {c: {"mean_ref": c} for c in cols}, "feature")
    b = melt_row(cur.agg(*[F.avg(c).alias(c) for c in cols]), {c: {"mean_cur": c} for c in cols}, "feature")
    shift = F.abs(F.col("mean_cur") - F.col("mean_ref")) / (F.abs("mean_ref") + 1e-10)
    return a.join(b, "feature").withColumn("shift", shift).withColumn("shifted", F.col("shift") > cut)


def against_reference(stats: DataFrame, cur: DataFrame, cols: list[str]) -> DataFrame:
    """Current moments against stored ones (column, mean, std): mean over 3 deviations, deviation ratio out of 0.5 to 2."""
    row = cur.agg(*[x for c in cols for x in (F.avg(c).alias(f"m_{c}"), F.stddev_samp(c).alias(f"s_{c}"))])
    now = melt_row(row, {c: {"mean_cur": f"m_{c}", "std_cur": f"s_{c}"} for c in cols})
    z = F.when(F.col("std") > 0, F.abs(F.col("mean_cur") - F.col("mean")) / F.col("std"))
    ratio = F.when(F.col("std") > 0, F.col("std_cur") / F.col("std"))
    return now.join(stats.select("column", "mean", "std"), "column").select(
        "column", z.alias("z"), ratio.alias("std_ratio"),
        (F.coalesce(z > 3, F.lit(False)) | F.coalesce((ratio < 0.5) | (ratio > 2), F.lit(False))).alias("drifted"))


def page_hinkley(df: DataFrame, error: Column, keys: list[str], order: list[str], window: int = 100, delta: float = 0.05) -> DataFrame:
    """Cumulative error over the first-window mean against its running minimum, per key; flags over delta * window.

    Two running passes: positions with the sum, then the minimum of the sums. Long keys are cut in both.
    """
    base = df.withColumn("_e", error)
    numbered = running(base, keys, order, {"_rn": ("sum", F.lit(1).cast("bigint"))})
    numbered = settle(numbered)
    first = numbered.where(F.col("_rn") <= window).groupBy(*keys).agg(F.avg("_e").alias("_base"))
    from tablecare.functions.params import attach

    later = attach(numbered, first, keys).withColumn(
        "_step", F.when(F.col("_rn") > window, F.col("_e") - F.col("_base") - delta).otherwise(0.0))
    summed = running(later, keys, order, {"cumulative": ("sum", F.col("_step"))})
    low = running(settle(summed), keys, order, {"_low": ("min", F.least(F.col("cumulative"), F.lit(0.0)))})
    out = low.where(F.col("_rn") > window).withColumn("statistic", F.col("cumulative") - F.least(F.col("_low"), F.lit(0.0)))
    return out.withColumn("drift", F.col("statistic") > delta * window).drop("_e", "_base", "_step", "_low", "cumulative")


def page_hinkley_summary(points: DataFrame, keys: list[str]) -> DataFrame:
    return points.groupBy(*keys).agg(F.bool_or("drift").alias("drift_detected"), F.count_if("drift").alias("drift_points"),
                                     F.max("statistic").alias("max_statistic"))


def drift_score(tests: DataFrame) -> DataFrame:
    """Largest 1 - p over the features and the drifted share."""
    return tests.agg(F.max(1 - F.col("p_value")).alias("drift_score"), F.avg(F.col("drifted").cast("double")).alias("drift_share"))


def recent_vs_past(df: DataFrame, value: str, label: str, classes: list[str], keys: list[str], order: list[str],
                   drop_cut: float = 0.1) -> DataFrame:
    """Last 20 rows against the 80 before: mean drop, class share change and z of the recent mean, at every row."""
    from tablecare.functions.ordered import framed

    def build(w):
        recent, past, all_ = w.rowsBetween(-19, 0), w.rowsBetween(-99, -20), w.rowsBetween(-99, 0)
        cols = {"_n": F.count(F.lit(1)).over(all_), "_mr": F.avg(value).over(recent), "_mp": F.avg(value).over(past),
                "_sp": F.stddev_pop(value).over(past)}
        for i, c in enumerate(classes):
            hit = (F.col(label) == c).cast("double")
            cols[f"_d{i}"] = F.abs(F.avg(hit).over(recent) - F.avg(hit).over(past))
        return cols

    out = framed(df, keys, order, 99, build).where(F.col("_n") >= 100)
    change = sum((F.col(f"_d{i}") for i in range(len(classes))), F.lit(0.0))
    z = F.abs(F.col("_mr") - F.col("_mp")) / (F.col("_sp") + 1e-8)
    out = out.withColumns({"confidence_drop": F.col("_mp") - F.col("_mr"), "distribution_change": change, "feature_z": z})
    drift = (F.col("confidence_drop") > drop_cut) | (F.col("distribution_change") > 0.3) | (F.col("feature_z") > 3)
    return out.withColumn("drift", drift).drop("_n", "_mr", "_mp", "_sp", *[f"_d{i}" for i in range(len(classes))])
