"""The helpers that cut long keys give what plain windows give."""

import math

import pandas as pd
import pytest
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tablecare.functions import ordered as od


@pytest.fixture(scope="module")
def rows(spark):
    """One key holds a third of the rows; values repeat and some are missing."""
    df = spark.range(900).select(
        F.col("id"), F.when(F.col("id") % 3 == 0, 0).otherwise(1 + F.col("id") % 20).alias("k"),
        F.when(F.col("id") % 7 != 0, (F.col("id") * 37 % 101).cast("double")).alias("v"))
    return df.cache()


def as_dict(df, col):
    return {r["id"]: r[col] for r in df.collect()}


def test_running_matches_window(large, rows):
    w = W.partitionBy("k").orderBy("id").rowsBetween(W.unboundedPreceding, 0)
    want = rows.withColumns({"s": F.sum("v").over(w), "m": F.min("v").over(w), "l": F.last("v", True).over(w)})
    got = od.running(rows, ["k"], ["id"], {"s": ("sum", F.col("v")), "m": ("min", F.col("v")), "l": ("last", F.col("v"))})
    for c in ("s", "m", "l"):
        assert as_dict(got, c) == as_dict(want, c)


def test_running_backwards(large, rows):
    w = W.partitionBy("k").orderBy(F.desc("id")).rowsBetween(W.unboundedPreceding, 0)
    want = rows.withColumn("l", F.last("v", True).over(w))
    got = od.running(rows, ["k"], ["id"], {"l": ("last", F.col("v"))}, descending=True)
    assert as_dict(got, "l") == as_dict(want, "l")


def test_framed_splits_the_hot_key(large, rows):
    build = lambda w: {"a": F.avg("v").over(w.rowsBetween(-6, 0)), "b": F.lag("v", 5).over(w)}
    want = rows.withColumns(build(W.partitionBy("k").orderBy("id")))
    got = od.framed(rows, ["k"], ["id"], 6, build)
    assert as_dict(got, "a") == as_dict(want, "a") and as_dict(got, "b") == as_dict(want, "b")
    large.conf.set("spark.tablecare.smallRows", "200")
    hot = od.long_keys(rows, ["k"])
    assert [r["k"] for r in hot.collect()] == [0]
    got = od.framed(rows, ["k"], ["id"], 6, build)
    assert as_dict(got, "a") == as_dict(want, "a")


def test_quantiles_are_exact_both_ways(spark, rows, monkeypatch):
    probs = [0, 0.01, 0.25, 0.5, 0.9, 1]
    want = rows.select("v").toPandas()["v"].dropna().quantile(probs).tolist()
    assert od.quantiles(rows, ["v"], probs, small=True)["v"] == pytest.approx(want)
    assert od.quantiles(rows, ["v"], probs, small=False)["v"] == pytest.approx(want)
    monkeypatch.setattr(od, "BRACKET_VALUES", 0)
    assert od.quantiles(rows, ["v"], probs, small=False)["v"] == pytest.approx(want)


def test_quantiles_of_empty_and_single(spark):
    df = spark.createDataFrame([(None,), (None,)], "v double")
    assert od.quantiles(df, ["v"], [0.5], small=False) == {"v": [None]}
    one = spark.createDataFrame([(4.0,), (None,)], "v double")
    assert od.quantiles(one, ["v"], [0.25, 0.5], small=False) == {"v": [4.0, 4.0]}


def test_group_quantiles(large, rows):
    want = rows.toPandas().groupby("k")["v"].quantile(0.3).to_dict()
    got = {r["k"]: r["quantiles"][0] for r in od.group_quantiles(rows, ["k"], "v", [0.3]).collect()}
    assert got.keys() == want.keys() and all(math.isclose(got[k], want[k]) for k in want)


def test_decayed_sums_cross_blocks(large, rows):
    full = rows.fillna(0, ["v"])
    got = od.decayed_sums(full, ["k"], ["id"], {"s": (F.col("v"), 0.9), "t": (F.col("v"), 0.25)})
    pdf = full.toPandas().sort_values("id")
    for name, r in (("s", 0.9), ("t", 0.25)):
        want = {}
        for _, part in pdf.groupby("k"):
            acc = 0.0
            for i, v in zip(part["id"], part["v"]):
                acc = v + r * acc
                want[i] = acc
        have = as_dict(got, name)
        assert all(math.isclose(have[i], want[i], rel_tol=1e-9, abs_tol=1e-9) for i in want)


def test_slices_grow_with_the_rows(large):
    from tablecare.functions.ordered import slice_count

    base = int(large.conf.get("spark.sql.shuffle.partitions"))
    assert slice_count(large.range(40 * base)) == base and slice_count(large.range(40 * base * 10)) == 10 * base


def test_hot_keys_have_a_fixed_limit(spark):
    from tablecare.functions.ordered import long_keys

    spark.conf.set("spark.tablecare.smallRows", "50")
    try:
        few = spark.range(20_000).selectExpr("if(id < 60, 0, id) AS k")
        assert [r[0] for r in long_keys(few, ["k"]).collect()] == [0]
        assert long_keys(spark.range(20_000).selectExpr("id AS k"), ["k"]) is None
    finally:
        spark.conf.unset("spark.tablecare.smallRows")


def test_columns_of_few_values_need_no_brackets(spark, monkeypatch):
    """Every bracket was a pass or a branch of its own; now all columns of few values are counted in one, others go the old way."""
    asked = []
    monkeypatch.setattr(od, "_bracketed_quantiles", lambda v, cols, probs, real=od._bracketed_quantiles: (asked.append(cols), real(v, cols, probs))[1])
    monkeypatch.setattr(od, "NARROW_VALUES", 100, raising=False)
    df = spark.range(3000, numPartitions=6).selectExpr(
        "IF(id % 11 = 0, NULL, double(id % 7 - 3)) AS few", "id * 2 AS many", "IF(id % 5 = 0, double('nan'), -0.0) AS zero", "CAST(NULL AS DOUBLE) AS none")
    cols, probs = ["few", "many", "zero", "none"], [0.0, 0.1, 0.25, 0.5, 0.99, 1.0]
    found = od.quantiles(df, cols, probs, small=False)
    assert asked == [["many"]]
    assert found == od.quantiles(df, cols, probs, small=True)
    monkeypatch.setattr(od, "BRACKET_VALUES", 5)  # too many counts to read
    assert od.quantiles(df.select("few"), ["few"], probs, small=False)["few"] == found["few"]
