"""Checks on small frames with answers worked out by hand."""

import pytest
from pyspark.sql import functions as F

from tablecare.operators import profile as pf
from tablecare.operators import quality as ql


def test_retail_frame(spark):
    df = spark.createDataFrame([("12345678", 25.0, 0, "chemises"), ("invalid", -5.0, -999, "chemises"), ("00000000", 19.0, 15, "pantalons")],
                               "sku_code string, price double, stock_qty int, category string")
    row = ql.code_compliance(df).first()
    assert (row["codes"], row["compliant"], round(row["share"], 2)) == (3, 2, 66.67)
    f = pf.Facts(df)
    assert f.sentinel_columns() == ["stock_qty"] and f.negative_prices() == ["price"]
    assert ("high", "price_correction", "price", "group_median") in ql.recommendations(f)


def test_zero_is_spared_in_stock_columns(spark):
    df = spark.createDataFrame([(0, 0), (5, 7)], "stock_qty int, other int")
    f = pf.Facts(df, sentinels=(-999, 0))
    assert f.sentinel_columns() == ["other"]


def test_leakage_levels(spark):
    df = spark.range(100).select(F.col("id").cast("double").alias("target"), (F.col("id") * 2 + F.sin("id") * 0.01).alias("leaky"))
    corr = pf.target_correlations(df, "target").first()["corr"]
    assert ql_level(corr) == "high"
    assert [ql_level(x) for x in (None, 0.5, 0.7, 0.85, 0.95)] == ["none", "none", "low", "medium", "high"]


def ql_level(x):
    return pf.leakage_level(x)


def test_text_target_is_coded_by_first_appearance(spark):
    df = spark.createDataFrame([(1, 0.1, "yes"), (2, 1.0, "no"), (3, 0.2, "yes"), (4, 1.1, "no")], "id int, leaky double, target string")
    out = {r["column"]: r["corr"] for r in pf.target_correlations(df, "target", ["id"]).collect()}
    assert out["leaky"] > 0.95


def test_empty_single_constant_and_null_frames(spark):
    empty = spark.createDataFrame([], "a int, b string")
    r = ql.preprocess_report(pf.Facts(empty))
    assert (r.score, r.state) == (0.0, "invalid")
    one = spark.createDataFrame([(1, None)], "a int, b double")
    r = ql.preprocess_report(pf.Facts(one))
    assert r.state == "invalid" and ("all_null", "b", "issue", 0.0) in r.rows and ("constant", "a", "issue", 2.0) in r.rows
    good = spark.createDataFrame([(1, "a", 1.0), (2, "b", 2.0), (3, "c", 3.5), (4, "d", 4.5), (5, "e", 5.0)], "a int, b string, c double")
    r = ql.preprocess_report(pf.Facts(good))
    assert (r.score, r.state) == (100.0, "valid")


def test_nan_is_missing(spark):
    df = spark.createDataFrame([(1.0,), (float("nan"),), (None,)], "x double")
    p = pf.profile(df).first()
    assert (p["count"], p["nulls"], p["distinct"], p["q50"]) == (1, 2, 1, 1.0)


def test_duplicates_treat_nulls_as_equal(spark):
    df = spark.createDataFrame([(1, None), (1, None), (2, "x")], "a int, b string")
    assert pf.duplicate_count(df) == (3, 1)


def test_skew_matches_pandas(spark):
    df = spark.createDataFrame([(1.0,)] * 95 + [(100.0,)] * 5, "x double")
    assert pf.Facts(df).col["x"]["skew"] == pytest.approx(df.toPandas()["x"].skew())


def test_drift_risk_points(spark):
    df = spark.range(150).select(F.concat(F.lit("ID_"), "id").alias("a"), F.concat(F.lit("X"), "id").alias("b"), F.current_timestamp().alias("t"))
    assert ql.drift_risk(pf.Facts(df)) == "high"
    assert ql.drift_risk(pf.Facts(df.select("a", "t"))) == "medium"
    assert ql.drift_risk(pf.Facts(df.select("a"))) == "low"


def test_feature_types(spark):
    df = spark.range(40).select((F.col("id") % 5).cast("int").alias("ordinal"), (F.col("id") % 2).alias("flag"), (F.col("id") * 1.5).alias("amount"),
                                F.lit("2024-01-01").alias("day"), F.concat(F.lit("v"), F.col("id") % 4).alias("kind"), F.lit(None).cast("string").alias("none"))
    types = ql.feature_types(pf.Facts(df))
    assert types == {"ordinal": "ordinal", "flag": "binary", "amount": "numeric", "day": "datetime", "kind": "categorical"}


def test_sector_report_and_names(spark):
    df = spark.createDataFrame([(1.0, -1.0)], "`bad name` double, unit_price double")
    r = ql.sector_report(pf.Facts(df), "retail")
    assert r.state == "invalid" and ("column_name", "bad name", "medium", 0.0) in r.rows
    assert ql.column_map(["qty", "sale_price", "note"], "retail") == {"qty": "quantity", "sale_price": "unit_price"}


def test_rule_distinct_is_exact_near_limits(spark):
    df = spark.range(20000).select("id", (F.col("id") % 20).cast("string").alias("t"), F.col("id").cast("string").alias("u"))
    found = pf.rule_distinct(df, 20000, ["t", "u"])
    assert found["t"] == 20 and found["u"] == 20000


def test_codes_of_a_text_target_are_broadcast(spark):
    """A shuffle on the target would put all rows of a class into one task."""
    df = spark.range(100).selectExpr("IF(id % 10 = 9, NULL, chr(int(97 + id % 3))) AS t", "id")
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        coded = pf.target_codes(df, "t", ["id"])
        assert "BroadcastHashJoin" in coded._jdf.queryExecution().simpleString()
        assert {tuple(r) for r in coded.select("t", "_target").distinct().collect()} == {("a", 0.0), ("b", 1.0), ("c", 2.0), (None, None)}
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
