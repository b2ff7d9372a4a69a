"""Rewrites of stored tables, growing chains, and stored sketches."""

import datetime
import random

import pytest
from pyspark.sql import functions as F

from tablecare.operators import drift as dr
from tablecare.operators import govern as gv
from tablecare.operators import profile as pf
from tablecare.operators import sketches as sk


def stored(spark, path):
    rows = [(i, i % 10, datetime.datetime(2024, 1, 1 + i % 6, i % 24), f"2024-01-0{1 + i % 6}") for i in range(120)] + [(500, 77, datetime.datetime(2024, 1, 3), "2024-01-03")] * 2
    spark.createDataFrame(rows, "id int, user int, ts timestamp, day string").repartition("day").write.partitionBy("day").parquet(path)
    return rows


def files(spark, path):
    return {(str(r.day), r.f) for r in spark.read.parquet(path).select("day", F.input_file_name().alias("f")).distinct().collect()}


def contents(spark, path):
    return sorted((r.id, r.user, str(r.day)) for r in spark.read.parquet(path).collect())


def test_erasing_rewrites_only_the_touched_partitions(spark, tmp_path):
    path = f"{tmp_path}/events"
    rows = stored(spark, path)
    before = files(spark, path)
    gone = spark.createDataFrame([(77,), (77,), (None,)], "user int")
    assert gv.erase_stored(path, gone, "user", "day", f"{tmp_path}/staging") == 1
    want = sorted((i, None if u == 77 else u, d) for i, u, _, d in rows)
    assert sorted(contents(spark, path), key=str) == sorted(want, key=str)
    assert {f for f in before if f[0] != "2024-01-03"} == {f for f in files(spark, path) if f[0] != "2024-01-03"}
    assert not {f for f in before if f[0] == "2024-01-03"} & files(spark, path)
    assert gv.erase_stored(path, gone, "user", "day", f"{tmp_path}/staging") == 0  # nothing is left to do
    assert gv.erase_stored(path, gone.limit(0), "user", "day", f"{tmp_path}/staging") == 0


def test_retention_moves_rows_once_also_after_a_failed_run(spark, tmp_path):
    path, archive = f"{tmp_path}/events", f"{tmp_path}/archive"
    rows = stored(spark, path)
    # A run that failed after it wrote the archive.
    expired = gv.retention_split(spark.read.parquet(path), "ts", 2, F.lit("2024-01-05 06:00:00").cast("timestamp"))[0]
    expired.write.partitionBy("day").parquet(archive)
    untouched = {f for f in files(spark, path) if f[0] > "2024-01-03"}
    now = lambda text: F.lit(text).cast("timestamp")
    assert gv.retain_stored(spark, path, archive, "ts", 2, now("2024-01-05 06:00:00"), "day", f"{tmp_path}/staging") == 3
    assert untouched <= files(spark, path)
    assert gv.retain_stored(spark, path, archive, "ts", 2, now("2024-01-05 06:00:00"), "day", f"{tmp_path}/staging") == 0
    gv.retain_stored(spark, path, archive, "ts", 2, now("2024-01-05 12:00:00"), "day", f"{tmp_path}/staging")
    limit = datetime.datetime(2024, 1, 3, 12)
    assert contents(spark, archive) == sorted((i, u, d) for i, u, t, d in rows if t <= limit)
    assert contents(spark, path) == sorted((i, u, d) for i, u, t, d in rows if t > limit)


def test_chain_grows_by_batches(spark, tmp_path):
    random.seed(3)
    rows = [(random.choice(["a", "b", None]), i, f"e{i}") for i in range(200)]
    df = spark.createDataFrame(rows, "k string, n int, body string")
    args = (["k"], ["n"], ["n", "body"])
    whole = {r.n: r.chain_hash for r in gv.hash_chain(df, *args).collect()}
    store = gv.ChainStore(spark, f"{tmp_path}/chain", *args, segment=17)
    assert store.append(df.limit(0)) == 0 and store.heads() is None
    assert [store.append(df.where(f"n >= {a} AND n < {b}")) for a, b in ((0, 80), (0, 80), (60, 120), (120, 121), (121, 200))] == [80, 0, 40, 1, 79]
    assert {r.n: r.chain_hash for r in store.events().collect()} == whole and store.events().count() == 200
    # A run that failed after it wrote its events and before its heads: the version is written anew.
    store.events().limit(5).drop("version").write.parquet(f"{tmp_path}/chain/events/version=5")
    assert store.events().count() == 200
    more = spark.createDataFrame([("a", 300, "late"), ("c", 5, "new")], "k string, n int, body string")
    assert store.append(more) == 2 and store.events().count() == 202
    links = gv.verify_chain(store.events(), *args).where("NOT link_ok")
    assert links.count() == 0


def test_sketches_of_parts_merge_to_those_of_the_whole(spark):
    rng = random.Random(2)
    rows = [(rng.gauss(0, 1), float(i % 40), None if i % 9 == 0 else f"v{rng.randint(0, 3000)}", None) for i in range(20_000)]
    df = spark.createDataFrame(rows, "a double, b double, c string, d double")
    merged = sk.merge(sk.sketch(df.where("b < 20"), ["a", "b", "d"], ["c"]).unionByName(sk.sketch(df.where("b >= 20"), ["a", "b", "d"], ["c"])))
    by = {r.feature: r for r in merged.collect()}
    assert by["a"].rows == 20_000 and by["c"].present == sum(r[2] is not None for r in rows) and (by["b"].low, by["b"].high) == (0.0, 39.0) and by["d"].present == 0
    counts = {r.column: r["distinct"] for r in sk.distinct_counts(merged).collect()}
    assert counts["b"] == 40 and counts["d"] == 0 and abs(counts["c"] - len({r[2] for r in rows if r[2]})) <= 0.04 * 3000
    a = sorted(r[0] for r in rows)
    edges = sk.quantile_edges(merged, 10)
    assert "d" not in edges and all(abs(sum(x <= e for x in a) - (i + 1) * 2000) <= 2 * sk.RANK_ERROR * 20_000 for i, e in enumerate(edges["a"]))
    shifted = df.withColumn("a", F.col("a") + 0.5)
    exact, rough = ({r.feature: r.psi for r in dr.psi(df, shifted, ["a", "b"], exact=e).collect()} for e in (True, False))
    assert rough["a"] == pytest.approx(exact["a"], rel=0.1) and rough["b"] == pytest.approx(exact["b"], abs=0.01)
    none = pf.distinct_counts(df.select("c", "d"), exact=False)
    assert {r.column: r["distinct"] for r in none.collect()}["d"] == 0


def test_chains_of_a_task_are_walked_in_one_go(spark, monkeypatch):
    """One call for every key cost milliseconds a key; now sorted rows stream through, and the hash starts anew where a key does."""
    import hashlib

    plans = []
    monkeypatch.setattr(gv, "settle", lambda df, real=gv.settle: (plans.append(df._jdf.queryExecution().simpleString()), real(df))[1])
    df = spark.range(300).selectExpr("IF(id % 7 = 0, NULL, id % 7) AS k", "id AS n")
    found = {r.n: r.chain_hash for r in gv.hash_chain(df, ["k"], ["n"], ["n"], segment=10).collect()}
    want = {}
    for k in range(7):
        prev = ""
        for n in range(k, 300, 7):
            prev = want[n] = hashlib.sha256(f'{prev}:{{"n":{n}}}'.encode()).hexdigest()
    assert found == want
    assert not any("FlatMapGroups" in p for p in plans) and any("MapInArrow" in p for p in plans)
