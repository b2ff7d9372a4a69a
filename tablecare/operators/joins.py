"""Outer joins, alignment, lookups, sampling and set operations."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tablecare.functions.columns import hash_bucket
from tablecare.functions.params import attach


def outer_join(frames: list[DataFrame], key: str) -> DataFrame:
    """Full outer join of frames on one key; adaptive execution splits skewed keys of a single join."""
    return reduce(lambda a, b: a.join(b, key, "full_outer"), frames)


def group_back(df: DataFrame, by: list[str], stats: dict) -> DataFrame:
    """Group statistics joined back to the rows: partial aggregates first, then a checked broadcast."""
    return attach(df, df.groupBy(*by).agg(*[c.alias(n) for n, c in stats.items()]), by)


def map_default(df: DataFrame, col: str, mapping: dict, default, out: str) -> DataFrame:
    """Value lookup with a default."""
    schema = f"{col} {dict(df.dtypes)[col]}, _v double"
    table = df.sparkSession.createDataFrame([(k, float(v)) for k, v in mapping.items()], schema)
    return attach(df, table, [col]).withColumn(out, F.coalesce("_v", F.lit(float(default)))).drop("_v")


def aligned_counts(a: DataFrame, b: DataFrame, col: str) -> DataFrame:
    """Counts of a column on two sides, 0 where a value is absent; nulls are left out."""
    count = lambda df, n: df.where(F.col(col).isNotNull()).groupBy(F.col(col).alias("value")).agg(F.count(F.lit(1)).alias(n))
    both = count(a, "n_a").join(count(b, "n_b"), "value", "full_outer")
    return both.select("value", F.coalesce("n_a", F.lit(0)).alias("n_a"), F.coalesce("n_b", F.lit(0)).alias("n_b"))


def append(frames: list[DataFrame]) -> DataFrame:
    """Rows of all frames by column name; absent columns are null."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)


def column_sets(a: DataFrame, b: DataFrame) -> DataFrame:
    """Columns both frames have, and those only one has."""
    left, right = set(a.columns), set(b.columns)
    rows = [(c, "both" if c in left & right else "left" if c in left else "right") for c in sorted(left | right)]
    return a.sparkSession.createDataFrame(rows, "column string, side string")


def hash_sample(df: DataFrame, key: str, share: float) -> DataFrame:
    """Repeatable sample by key: rows of one key stay together."""
    return df.where(hash_bucket(F.col(key)) < int(share * 10000))


def seeded_sample(df: DataFrame, share: float, seed: int = 42) -> DataFrame:
    return df.sample(fraction=share, seed=seed)


def top_k(df: DataFrame, by: str, k: int, ties: list[str]) -> DataFrame:
    """Top rows by one column; each task keeps k rows, so nothing is sorted whole."""
    return df.orderBy(F.desc(by), *ties).limit(k)
