"""Metrics and tests against published or hand-worked values."""

import math

import pytest
from pyspark.sql import functions as F

from tablecare.functions import tails
from tablecare.operators import drift as dr
from tablecare.operators import ensemble as en
from tablecare.operators import metrics as mt

# Twelve rows: A has 4 hits, 1 false alarm and 2 misses; B is wrong in the second row only. 30 of the 36 positive-negative pairs of P are in order.
Y = [1, 0, 1, 1, 0, 0, 1, 0, 1, 0, 0, 1]
A = [1, 0, 0, 1, 1, 0, 1, 0, 1, 0, 0, 0]
B = [1, 1, 1, 1, 0, 0, 1, 0, 1, 0, 0, 1]
P = [.92, .15, .38, .81, .64, .22, .77, .05, .58, .41, .33, .29]


@pytest.fixture(scope="module")
def scored(spark):
    return spark.createDataFrame(list(zip(Y, A, B, P)), "y int, a int, b int, p double").cache()


def test_tails():
    assert tails.chi2_upper(3.841459, 1) == pytest.approx(0.05, abs=1e-6)
    assert tails.chi2_upper(18.307038, 10) == pytest.approx(0.05, abs=1e-6)
    assert tails.t_two_sided(2.228139, 10) == pytest.approx(0.05, abs=1e-6)
    assert tails.normal_two_sided(1.959964) == pytest.approx(0.05, abs=1e-6)
    assert tails.ks_two_sample(0.0, 100, 100) == 1.0
    assert tails.ks_two_sample(0.1923, 100, 100) == pytest.approx(0.0497, abs=1e-3)


def test_binary_metrics(scored):
    row = mt.classification(scored, "y", "a").first()
    assert row["accuracy"] == 0.75 and row["precision_binary"] == pytest.approx(0.8) and row["recall_binary"] == pytest.approx(2 / 3)
    assert mt.auc(scored, "y", "p").first()[0] == pytest.approx(30 / 36)
    loss = scored.agg(mt.log_loss("y", "p")).first()[0]
    want = -sum(math.log(p if y else 1 - p) for y, p in zip(Y, P)) / 12
    assert loss == pytest.approx(want)


def test_multiclass(spark):
    df = spark.createDataFrame(list(zip([2, 0, 1, 1, 2, 0, 2, 1, 0, 2], [2, 0, 1, 2, 2, 0, 1, 1, 1, 2])), "y int, a int")
    row = mt.classification(df, "y", "a").first()
    assert row["accuracy"] == pytest.approx(0.7) and row["classes"] == 3


def test_one_vs_rest(scored):
    both = scored.withColumn("q", 1 - F.col("p"))
    out = {r["cls"]: r["roc_auc"] for r in mt.auc_one_vs_rest(both, "y", {1: "p", 0: "q"}).collect()}
    assert out[0] == pytest.approx(30 / 36) and out[1] == pytest.approx(30 / 36)


def test_regression(spark):
    y, p = [10.0, 12.5, 8.0, 15.0, 9.5], [11.0, 12.0, 8.5, 13.0, 9.5]
    df = spark.createDataFrame(list(zip(y, p)), "y double, p double")
    row = df.agg(*[c.alias(n) for n, c in mt.regression("y", "p").items()]).first()
    assert row["mae"] == pytest.approx(0.8) and row["max_error"] == pytest.approx(2.0)
    assert mt.median_error(df, "y", "p") == pytest.approx(0.5)


def test_mcnemar(scored):
    row = mt.mcnemar(scored, "y", "a", "b").first()
    assert (row["only_a"], row["only_b"], row["statistic"]) == (1, 3, 0.25) and row["p_value"] == pytest.approx(math.erfc(math.sqrt(0.125)), abs=1e-6)


def test_t_tests(spark):
    df = spark.createDataFrame([("a", float(x)) for x in (1, 2, 3, 4, 5)] + [("b", float(x)) for x in (2, 4, 6, 8, 10)], "arm string, v double")
    row = mt.t_test(df, "arm", "v", "a", "b").first()
    assert row["statistic"] == pytest.approx(-1.8973666) and row["p_value"] == pytest.approx(0.0943497, abs=1e-6)
    u = mt.mann_whitney(df, "arm", "v", "a", "b").first()
    assert u["statistic"] == 5.0


def test_ks_equal_and_shifted(spark):
    a = spark.range(200).select(F.col("id").cast("double").alias("x"))
    assert dr.ks_test(a, a, ["x"]).first()["statistic"] == 0.0
    b = a.select((F.col("x") + 100).alias("x"))
    one, two = dr.ks_test(a, b, ["x"]).first(), dr.ks_test(b, a, ["x"]).first()
    assert one["statistic"] == two["statistic"] == 0.5 and one["drifted"]


def test_psi(spark):
    a = spark.range(1000).select(F.col("id").cast("double").alias("x"), F.lit(1.0).alias("flat"))
    same = {r["feature"]: r["psi"] for r in dr.psi(a, a, ["x", "flat"]).collect()}
    assert same["x"] == pytest.approx(0.0) and same["flat"] == pytest.approx(0.0)
    b = a.select((F.col("x") * 0.5).alias("x"))
    assert dr.psi(a, b, ["x"]).first()["psi"] > 0.25


def test_page_hinkley_finds_the_step(spark):
    df = spark.range(200).select(F.lit("m").alias("k"), F.col("id"), F.when(F.col("id") < 100, 0.1).otherwise(0.4).alias("e"))
    pts = dr.page_hinkley(df, F.col("e"), ["k"], ["id"], window=50)
    row = dr.page_hinkley_summary(pts, ["k"]).first()
    assert row["drift_detected"] and pts.where("drift").agg(F.min("id")).first()[0] > 100


def test_weights_sum_to_one(scored):
    w = en.fitted_weights(scored, "y", ["a", "b", "p"])
    assert sum(w.values()) == pytest.approx(1.0) and min(w.values()) >= 0
    assert sum(en.normalized({"a": -1.0, "b": -2.0}).values()) == 1.0
    out = scored.select(en.hard_vote({c: F.col(c) for c in ("a", "b", "y")}).alias("v")).collect()
    assert [r["v"] for r in out] == [1.0 if a + b + y >= 2 else 0.0 for a, b, y in zip(A, B, Y)]


def test_permutation_meets_dealt_values_once_a_repeat(spark, monkeypatch):
    """Every column of every repeat had a join of its own."""
    from tablecare.operators import models as md

    df = spark.range(200).selectExpr("id AS k", "double(id % 7) AS a", "double(id % 11) AS b", "double(id % 7 > 3) AS label")
    model = md.train_forest(df, ["a", "b"], "label", trees=2, depth=3)
    joins, kind = [], type(df)
    monkeypatch.setattr(kind, "join", lambda self, *args, real=kind.join, **more: (joins.append(args), real(self, *args, **more))[1])
    found = {r.feature: r.importance for r in md.permutation_importance(df, ["a", "b"], "label", model, ["k"], repeats=2).collect()}
    assert len(joins) == 2
    assert found["a"] > 0.2 and found["b"] == 0.0


def test_named_permutation_deals_each_column_five_times(spark, tmp_path, monkeypatch):
    from tablecare.operators import models as md
    from tablecare.queries.catalog import QUERIES

    rows = [(i, 1, i % 7, i % 5, float(i % 11 + 1), float(i * 37 % 40000), 0.01 * (i % 4), 0.01 * (i % 3), "2020-01-01") for i in range(200)]
    spark.createDataFrame(rows, "l_orderkey long, l_linenumber int, l_partkey long, l_suppkey long, l_quantity double, l_extendedprice double, l_discount double, l_tax double, l_shipdate string").write.parquet(f"{tmp_path}/lineitem.parquet")
    dealt = []
    monkeypatch.setattr(md, "row_numbers", lambda df, keys, order, out, real=md.row_numbers: (dealt.append(order), real(df, keys, order, out))[1])
    found = QUERIES["met_permutation"](spark, str(tmp_path)).collect()
    assert dealt.count(["_h", "_i"]) == 5  # before, two
    assert {r.feature for r in found} == {"l_quantity", "l_extendedprice", "l_discount", "l_tax"}
