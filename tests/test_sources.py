"""Paths, options, datasets and the feature store."""

import pytest
from pyspark.sql import functions as F

from tablecare.operators import features as fe
from tablecare.operators import models as md
from tablecare.plans.auto_features import AutoFeatures
from tablecare.sources import databases as db
from tablecare.sources import datasets as ds
from tablecare.sources import files as fl
from tablecare.sources import feature_store as fs
from tablecare.sources.feature_store import FeatureStore


def test_paths_and_suffixes():
    assert fl.object_path("s3", "bucket", "/a/b.parquet") == "s3a://bucket/a/b.parquet"
    assert fl.object_path("azure", "box", "a.csv", "acct") == "abfss://box@acct.dfs.core.windows.net/a.csv"
    assert fl.format_of("/x/y.json") == "json"
    for bad in ("/x/y.feather", "/x/y.bin"):
        with pytest.raises(ValueError):
            fl.format_of(bad)


def test_jdbc_options():
    out = db.jdbc_options("jdbc:postgresql://h/d", table="t", partition="id", lower=0, upper=9, parts=3)
    assert out["dbtable"] == "t" and out["numPartitions"] == "3"
    with pytest.raises(ValueError):
        db.jdbc_options("u", query="select 1", partition="id")
    with pytest.raises(ValueError):
        db.jdbc_options("u")
    assert db.warehouse_options("snowflake", account="a", user="u", database="d", table="t")[1]["sfURL"] == "a.snowflakecomputing.com"
    with pytest.raises(ValueError):
        db.warehouse_options("mongodb", uri="x")


def test_dataset_versions(spark, tmp_path):
    df = spark.range(10).withColumn("t", F.lit("x"))
    a = ds.save_dataset(df, str(tmp_path), "d")
    b = ds.save_dataset(df.repartition(4).where("id >= 0"), str(tmp_path), "d")
    assert a["content"] == b["content"]
    c = ds.save_dataset(df.where("id < 5"), str(tmp_path), "d")
    assert c["content"] != a["content"] and ds.load_dataset(spark, str(tmp_path), "d").count() == 5
    with pytest.raises(ValueError):
        ds.load_dataset(spark, str(tmp_path), "none")


def test_time_travel_reads_one_snapshot(spark, tmp_path):
    store = FeatureStore(spark, str(tmp_path))
    store.register("f", "id", "ts", ["x"])
    for day in (1, 2, 3):
        store.write("f", spark.range(day).withColumn("x", F.lit(day)), f"2024-01-0{day} 00:00:00")
    assert store.read("f").count() == 3 and store.read("f", as_of="2024-01-02 12:00:00").count() == 2
    files = store.read("f", as_of="2024-01-02 12:00:00").inputFiles()
    assert files and all("snapshot_ts=2024-01-02" in f for f in files)
    with pytest.raises(ValueError):
        store.read("f", as_of="2023-01-01 00:00:00")


def test_registry_order_and_cycles(spark):
    reg = fe.FeatureRegistry()
    reg.register("c", lambda: F.col("b") + 1, ("b",))
    reg.register("b", lambda: F.col("a") + 1, ("a",))
    assert reg.levels(["c"]) == [["b"], ["c"]]
    assert spark.range(1).withColumn("a", F.lit(1)).transform(lambda d: reg.compute(d, ["c"])).first()["c"] == 3
    reg.register("a", lambda: F.col("c"), ("c",))
    with pytest.raises(ValueError):
        reg.levels(["c"])


def test_auto_features_reuses_the_fit(spark):
    df = spark.range(50).select((F.col("id") + 1).cast("double").alias("x"), (F.col("id") % 7).cast("double").alias("y"))
    plan = AutoFeatures(max_features=8).fit(df)
    assert len(plan.selected) == 8
    assert plan.transform(df.limit(3)).columns == plan.selected


def test_target_encoding_out_of_fold_differs_from_plain(spark):
    df = spark.range(100).select("id", F.concat(F.lit("c"), F.col("id") % 4).alias("c"), (F.col("id") % 10).cast("double").alias("y"))
    plain = fe.target_encode(df, "c", "y").select("c_target_encoded").distinct().count()
    folded = fe.target_encode(df, "c", "y", folds=4, fold_key=["id"]).select("c_target_encoded").distinct().count()
    assert plain <= 4 < folded
    unseen = spark.createDataFrame([(1, "zz", 0.0)], "id bigint, c string, y double")
    assert fe.target_encode(unseen, "c", "y", fitted_on=df).first()["c_target_encoded"] == pytest.approx(4.5)


def test_folds(spark):
    df = spark.range(103).select("id", (F.col("id") % 2).alias("y"))
    sizes = md.stratified_folds(df, "y", ["id"], 5).groupBy("y", "fold").count().collect()
    assert max(r["count"] for r in sizes) - min(r["count"] for r in sizes) <= 1
    assert md.fold_count(100) == 3 and md.fold_count(1000) == 5 and md.fold_count(10**6) == 10


def test_asof_ties_go_by_the_typed_id(spark):
    left = spark.createDataFrame([(1, "k", 10)], "id int, k string, t long")
    right = spark.createDataFrame([("k", 5, -3, "minus"), ("k", 5, 2, "two"), ("k", 5, 10, "ten")], "k string, t long, rid int, v string")
    texts = spark.createDataFrame([("k", 5, "x" * 30 + "a", "a"), ("k", 5, "x" * 30 + "b", "b")], "k string, t long, rid string, v string")
    for rows, want in ((right, "ten"), (right.where("rid < 10"), "two"), (right.where("rid < 0"), "minus"), (texts, "b")):
        got = fs.as_of(left, rows, "k", "t", "t", ["v"], ["id"], ["rid"]).first()
        assert got["asof_v"] == want


def test_a_read_scans_one_snapshot(spark, tmp_path):
    store = fs.FeatureStore(spark, f"{tmp_path}/store")
    store.register("s", "id", "t", ["a"])
    for day, a in (("2024-01-01", 1), ("2024-01-02", 2), ("2024-01-02", 3)):
        store.write("s", spark.createDataFrame([(7, a)], "id int, a int"), day)
    assert [store.read("s", as_of=d).first()["a"] for d in ("2024-01-01", "2024-01-02")] == [1, 3] and store.newest("s", "2023-12-31") is None
    files = store.read("s", as_of="2024-01-01").inputFiles()
    assert files and all("snapshot_ts=2024-01-01" in f for f in files)
