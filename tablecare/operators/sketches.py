"""Stored, mergeable sketches of columns: quantiles of numbers (KLL) and distinct values (HLL), so that a table is read once.

Parts of a table, days or files, are sketched where they are and merged later; drift against a reference needs the reference's sketches
only. Ranks are off by ``RANK_ERROR`` at most (99 % confidence), distinct counts by about ``DISTINCT_ERROR`` (one deviation).
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SIZE, RANK_ERROR = 1600, 0.005
LOG_REGISTERS, DISTINCT_ERROR = 14, 0.008


def sketch(df: DataFrame, numbers: list[str], values: list[str] | tuple = ()) -> DataFrame:
    """A row per column: feature, rows, present, low, high, quantiles (sketch or null), kinds (sketch or null). One pass, no shuffle but of the sketches."""
    aggs = [F.count(F.lit(1)).alias("rows")]
    for i, c in enumerate([*numbers, *values]):
        number = i < len(numbers)
        x = F.col(c).cast("double") if number else F.col(c).cast("string")
        x = F.when(~F.isnan(x), x) if number else x
        aggs += [F.count(x).alias(f"n{i}"), F.hll_sketch_agg(x.cast("string"), F.lit(LOG_REGISTERS)).alias(f"h{i}")]
        if number:
            aggs += [F.min(x).alias(f"lo{i}"), F.max(x).alias(f"hi{i}"), F.kll_sketch_agg_double(x, SIZE).alias(f"q{i}")]
    row = df.agg(*aggs)
    none = lambda kind: F.lit(None).cast(kind)
    each = [F.struct(F.lit(c).alias("feature"), F.col("rows").alias("rows"), F.col(f"n{i}").alias("present"),
                     *[(F.col(f"{p}{i}") if i < len(numbers) else none(kind)).alias(name) for p, name, kind in (("lo", "low", "double"), ("hi", "high", "double"), ("q", "quantiles", "binary"))],
                     F.col(f"h{i}").alias("kinds")) for i, c in enumerate([*numbers, *values])]
    return row.select(F.explode(F.array(*each)).alias("e")).select("e.*")


def merge(sketches: DataFrame) -> DataFrame:
    """One row per column from the sketches of several parts."""
    return sketches.groupBy("feature").agg(F.sum("rows").alias("rows"), F.sum("present").alias("present"), F.min("low").alias("low"), F.max("high").alias("high"),
                                           F.when(F.sum(F.when(F.col("quantiles").isNotNull(), F.col("present"))) > 0, F.kll_merge_agg_double("quantiles", SIZE)).alias("quantiles"),
                                           F.hll_union_agg("kinds").alias("kinds"))


def distinct_counts(sketches: DataFrame) -> DataFrame:
    """column, distinct: as the exact ``distinct_counts``, by the sketches."""
    return sketches.select(F.col("feature").alias("column"), F.when(F.col("present") > 0, F.hll_sketch_estimate("kinds")).otherwise(0).cast("bigint").alias("distinct"))


def quantile_edges(sketches: DataFrame, bins: int) -> dict[str, list[float]]:
    """Inner edges of quantile bins per number column that has values; repeated ones are merged."""
    probs = F.array(*[F.lit(i / bins) for i in range(1, bins)])
    rows = sketches.where("quantiles IS NOT NULL AND present > 0").select("feature", F.kll_sketch_get_quantile_double("quantiles", probs).alias("e")).collect()
    return {r["feature"]: sorted(set(r["e"])) for r in rows}


def shares(sketches: DataFrame, edges: dict[str, list[float]], out: str) -> DataFrame:
    """feature, bin, ``out``: the share of values in each bin, open left and closed right."""
    parts = None
    for c, inner in edges.items():
        upto = F.array(F.lit(0.0), *[F.kll_sketch_get_rank_double("quantiles", F.lit(float(x))) for x in inner], F.lit(1.0))
        one = sketches.where((F.col("feature") == c) & F.col("quantiles").isNotNull() & (F.col("present") > 0)).select("feature", upto.alias("u"))
        one = one.select("feature", F.posexplode(F.transform(F.slice("u", 2, len(inner) + 1), lambda x, i: x - F.get(F.col("u"), i))).alias("bin", out))
        parts = one if parts is None else parts.unionByName(one)
    return parts
