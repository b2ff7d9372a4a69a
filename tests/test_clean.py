"""Cleaning, plans, neighbours and governance on small frames."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tablecare import tables as tb
from tablecare.operators import clean as cl
from tablecare.operators import govern as gv
from tablecare.operators import impute as im
from tablecare.operators import nearest as nn
from tablecare.operators.gapped import nearest_points
from tablecare.operators import project as pj
from tablecare.operators import text as tx
from tablecare.operators.profile import Facts
from tablecare.plans.auto_clean import auto_clean, basic_clean
from tablecare.plans.cleaning_plan import Step, from_rows, replay, to_rows


def test_auto_clean_leaves_no_sentinel(spark, sf):
    dirty = tb.dirty_lineitem(spark, sf)
    out, report = auto_clean(dirty, sector="retail", protect=("l_orderkey", "l_linenumber", "l_partkey"))
    f = Facts(out)
    assert not set(f.sentinel_columns()) & {"stock_qty", "price", "discount", "tax"}
    assert not f.negative_prices() and f.missing_cells == 0 and "empty_col" not in out.columns
    assert report["quality_after"] == 100.0
    again, _ = basic_clean(dirty.select("discount", "price", "category"))
    assert Facts(again, duplicates=False).missing_cells == 0


def test_plan_round_trip_and_skips(spark):
    df = spark.createDataFrame([(1.0, "a"), (None, "b")], "x double, t string")
    steps = from_rows([{"column": "x", "action": "fill_missing", "params": {"method": "mean"}}, {"column": "gone", "action": "clip_values"},
                       {"column": "x", "action": "no_such_action"}])
    assert from_rows(to_rows(steps)) == steps
    out, log = replay(df, steps)
    assert [r["x"] for r in out.orderBy("t").collect()] == [1.0, 1.0]
    assert [e["state"].split(":")[0] for e in log] == ["done", "skipped", "skipped"]


def test_group_without_values_stays_null(spark):
    df = spark.createDataFrame([("a", 1.0), ("a", None), ("b", None)], "category string, x double")
    out = {tuple(r) for r in cl.fill_by_group(df, ["x"], "category").collect()}
    assert out == {("a", 1.0), ("b", None)}


def test_scale_guards(spark):
    df = spark.createDataFrame([(5.0,), (5.0,)], "x double")
    for method in ("minmax", "zscore", "robust"):
        assert [r[0] for r in cl.scale(df, ["x"], method).collect()] == [5.0, 5.0]


def test_formats(spark):
    assert pj.spark_pattern("%Y-%m-%dT%H:%M") == "yyyy-MM-dd'T'HH:mm"
    df = spark.createDataFrame([("$1,200.50", "2024-02-03"), ("bad", "worse")], "p string, d string")
    rows = df.select(pj.currency(F.col("p"), 2.0).alias("p"), pj.date_text(F.col("d"), "%d.%m.%Y").alias("d")).collect()
    assert [tuple(r) for r in rows] == [(2401.0, "03.02.2024"), (None, None)]


def test_validate_input(spark):
    df = spark.createDataFrame([(1, None)], "a int, b double")
    with pytest.raises(ValueError):
        pj.validate_input(df, ["a", "c"])
    with pytest.raises(ValueError):
        pj.validate_input(df.limit(0), ["a"])
    assert {(r["column"], r["warning"]) for r in pj.validate_input(df, ["a"]).collect()} == {("b", "extra"), ("b", "all_null")}


def brute(x, ids, k):
    out = {}
    for i, a in zip(ids, x):
        d = sorted((float(((a - b) ** 2).sum()), j) for j, b in zip(ids, x) if j != i)
        out[i] = [j for _, j in d[:k]]
    return out


def test_nearest_is_exact_with_many_cells(spark):
    rng = np.random.default_rng(3)
    x = np.concatenate([rng.normal(0, 0.1, (150, 4)), rng.normal(0, 3, (150, 4))])
    df = spark.createDataFrame([(i, [float(v) for v in r]) for i, r in enumerate(x)], "id bigint, v array<double>")
    got = {}
    for r in nn.nearest(df, df, "id", "id", "v", "v", 5, skip_self=True, block=16, leaf_rows=25).orderBy("qid", "rank").collect():
        got.setdefault(r["qid"], []).append(r["cid"])
    assert got == brute(x, range(len(x)), 5)


def gapped(a, b):
    shared = [(x - y) ** 2 for x, y in zip(a, b) if x is not None and y is not None]
    return round(sum(shared) * len(a) / len(shared), 9) if shared else None


@pytest.mark.parametrize("gaps, width", [(0.0, 2), (0.3, 2), (0.4, 3)])
def test_knn_impute_matches_brute_force(spark, gaps, width):
    rng = np.random.default_rng(width)
    rows = []
    for i in range(160):
        point = [None if rng.random() < gaps else float(rng.integers(0, 6)) if j else float(np.round(rng.normal(), 2)) for j in range(width)]
        rows.append((i, *point, None if i % 4 == 0 else float(rng.integers(0, 50))))
    df = spark.createDataFrame(rows, "id int, " + ", ".join(f"x{j} double" for j in range(width)) + ", y double")
    got = {r["id"]: r["y"] for r in im.knn_impute(df, "y", [f"x{j}" for j in range(width)], 5).collect()}
    donors = {}
    for _, *point, y in rows:
        if y is not None:
            donors.setdefault(tuple(point), []).append(y)
    mean = np.mean([r[-1] for r in rows if r[-1] is not None])
    for i, *point, y in rows:
        if y is not None:
            assert got[i] == y
            continue
        near = sorted((d, tuple(np.inf if x is None else x for x in p), np.mean(v), len(v)) for p, v in donors.items() if (d := gapped(point, p)) is not None)
        left, total = 5, 0.0
        for _, _, m, n in near:
            total, left = total + m * min(n, left), left - min(n, left)
        assert got[i] == pytest.approx(total / (5 - left) if near else mean)


@pytest.mark.parametrize("block, sample", [(2048, 2048), (8, 5), (3, 40)])
def test_gapped_neighbours_in_short_blocks(spark, block, sample):
    rng = np.random.default_rng(block)
    point = lambda: [None if rng.random() < 0.35 else float(np.round(rng.normal() * 5, 1)) if j else float(rng.integers(0, 3)) for j in range(3)]
    points = list({tuple(point()) for _ in range(120)} - {(None, None, None)})
    asks = [p for p in (point() for _ in range(40)) if any(x is not None for x in p)]
    got = {}
    frames = (spark.createDataFrame(list(enumerate(map(list, x))), f"{n} bigint, v array<double>") for x, n in ((asks, "qid"), (points, "cid")))
    for r in nearest_points(*frames, 4, 3, block=block, sample=sample).collect():
        assert (r.cid, r.dist) not in got.setdefault(r.qid, set())
        got[r.qid].add((r.cid, r.dist))
    for i, a in enumerate(asks):
        want = sorted((d, j) for j, p in enumerate(points) if (d := gapped(a, p)) is not None)
        edge = want[:4][-1][0]
        assert {(j, d) for j, d in got[i] if d <= edge} == {(j, d) for d, j in want if d <= edge}


def test_iterative_impute_recovers_a_line(spark):
    df = spark.range(200).select(F.col("id").cast("double").alias("x"), F.when(F.col("id") % 4 != 0, F.col("id") * 2.0 + 1).alias("y"))
    out = im.iterative_impute(df, ["x", "y"]).collect()
    assert all(abs(r["y"] - (2 * r["x"] + 1)) < 1e-6 for r in out)


def test_isolation_flags_the_far_rows(spark):
    df = spark.range(500).select("id", F.when(F.col("id") < 5, 1000.0 + F.col("id")).otherwise(F.col("id") % 50).alias("x"))
    out = im.isolation_flags(df, ["x"], contamination=0.02, trees=30)
    assert out.where("id < 5 and not outlier").count() == 0 and 0 < out.where("outlier").count() <= 10


def test_smote_counts_and_segments(spark):
    df = spark.range(60).select("id", F.array((F.col("id") % 9).cast("double"), (F.col("id") % 4).cast("double")).alias("v"), (F.col("id") < 12).cast("int").alias("y"))
    out = im.smote(df, "id", "v", "y", 1).collect()
    assert len(out) == 36 and all(r["base"] < 12 and r["neighbour"] < 12 and r["base"] != r["neighbour"] for r in out)


def test_chain_in_segments(spark, sf):
    ev = tb.load(spark, sf, "events")
    args = (["user_id"], ["ts", "event_id"], ["event_id", "event_type"])
    one = {r["event_id"]: r["chain_hash"] for r in gv.hash_chain(ev, *args).collect()}
    cut = {r["event_id"]: r["chain_hash"] for r in gv.hash_chain(ev, *args, segment=17).collect()}
    assert one == cut and len(one) == ev.count()


def test_chunks_cover_the_text(spark):
    texts = ["", "x" * 999, "y" * 1000, "z" * 1001, "w" * 4321]
    df = spark.createDataFrame(list(enumerate(texts)), "id int, text string")
    for i, text in enumerate(texts):
        parts = tx.chunk(df.where(F.col("id") == i), "text").orderBy("chunk_index").collect()
        whole = parts[0]["chunk"] + "".join(p["chunk"][200:] for p in parts[1:])
        assert whole == text and parts[0]["chunk_total"] == len(parts)


def test_search_takes_more_than_a_thousand_queries(spark):
    docs = spark.range(3).select("id", F.array(F.lit(1.0)).alias("v"), F.lit("a").alias("t"))
    many = spark.range(1001).select(F.col("id").alias("query_id"), F.array(F.lit(1.0)).alias("query_vector"), F.array(F.lit("a")).alias("query_words"))
    assert tx.search(docs, many, "id", "v", "t", 3).groupBy("query_id").count().where("count = 3").count() == 1001


def test_power_variances_of_all_lambdas_come_in_one_row_a_task(spark):
    """25 powers in one aggregate were not compiled by the JVM."""
    import numpy as np

    values = [-3.5, -0.5, 0.0, 0.25, 7.0, 120.0]
    df = spark.createDataFrame([(v,) for v in [*values, None]], "c double").repartition(4)
    grid = [-1.0, 0.0, 0.5, 2.0, 3.0]
    found = cl._power_variances(df.where("c IS NOT NULL"), grid)
    want = [df.select(F.var_pop(cl.power_value(F.col("c"), g))).first()[0] for g in grid]
    assert np.allclose(found, want, rtol=1e-12)
    assert cl.fit_power(spark.createDataFrame([(float("nan"),)], "c double"), "c") == 1.0
