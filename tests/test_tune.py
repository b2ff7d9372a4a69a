"""Tuning scores every combination on every fold."""

import pytest
from pyspark.sql import functions as F

from tablecare.operators import models as md


def test_tuning_scores_folds_without_python_on_rows(spark):
    rows = [(float(i % 17), float((i * 7) % 5), float((i % 17) > 8 or i % 23 == 0), i % 3) for i in range(300)]
    df = spark.createDataFrame(rows, "x double, y double, label double, fold int")
    tree = md.available("classification", "label")["tree"]
    best, table = md.tune(df, ["x", "y"], "label", "classification", tree, {"maxDepth": [1, 4]})
    ready = md.assembler(["x", "y"]).transform(df).select(md.FEATURES, "label", "fold")
    want = [sum(md.cross_scores(ready, tree.copy({tree.maxDepth: d}), "classification", "label", 3)) / 3 for d in (1, 4)]
    assert [r.score for r in table.collect()] == pytest.approx(want)
    assert best.depth == max(zip(want, (1, 4)))[1] or want[0] == want[1]
    with pytest.raises(ValueError, match="rows lie in the folds"):
        md.tune(df.withColumn("fold", F.col("fold") * 2), ["x", "y"], "label", "classification", tree, {"maxDepth": [1]})


def test_leaderboard_tunes_fits_and_measures_every_model(spark):
    rows = [(float(i % 17), float((i * 7) % 5), float((i % 17) > 8 or i % 23 == 0), i % 3) for i in range(300)]
    df = spark.createDataFrame(rows, "x double, y double, label double, fold int")
    table, best = md.leaderboard(df, ["x", "y"], "label", "classification", ["tree", "bayes", "linear_svc"], grids={"tree": {"maxDepth": [1, 3]}}, metric="roc_auc", report=True)
    got = {r.model: r for r in table.collect()}
    ready = md.assembler(["x", "y"]).transform(df).select(md.FEATURES, "label", "fold")
    models = md.available("classification", "label")
    for name, tried in {"tree": [{"maxDepth": 1}, {"maxDepth": 3}], "bayes": [{}], "linear_svc": [{}]}.items():
        scores = []
        for params in tried:
            estimator = models[name].copy({models[name].getParam(n): v for n, v in params.items()})
            scores.append(sum(md.fold_score(ready, estimator, "classification", "label", i, metric="roc_auc") for i in range(3)) / 3)
        params = tried[scores.index(max(scores))]
        fitted = models[name].copy({models[name].getParam(n): v for n, v in params.items()}).fit(ready).transform(ready)
        hits = [(r.label, r.prediction) for r in fitted.collect()]
        true = sum(y == p == 1 for y, p in hits)
        r = got[name]
        assert r.score == pytest.approx(max(scores)) and r.params == str(params) and r.training_time > 0
        assert r.accuracy == pytest.approx(sum(y == p for y, p in hits) / 300)
        assert r.precision == pytest.approx(true / sum(p == 1 for _, p in hits)) and r.recall == pytest.approx(true / sum(y == 1 for y, _ in hits))
        assert (r.roc_auc is None) == (r.log_loss is None) == (name == "linear_svc")
        if name != "linear_svc":
            assert r.roc_auc == pytest.approx(md.judged(fitted, "classification", "label", "roc_auc"))
    assert [r["rank"] for r in sorted(got.values(), key=lambda r: -r.score)] == [1, 2, 3]
    assert best.transform(ready).count() == 300


def test_leaderboard_measures_regressions_and_several_classes(spark):
    rows = [(float(i % 17), float((i * 7) % 5), float(i % 17 * 2 + i % 3), float(i % 17 // 6), i % 3) for i in range(300)]
    df = spark.createDataFrame(rows, "x double, y double, amount double, kind double, fold int")
    table, _ = md.leaderboard(df, ["x", "y"], "amount", "regression", ["linear", "lasso"], grids={"lasso": {"regParam": [0.1, 50.0]}}, report=True)
    first, last = table.collect()
    assert first.model == "linear" and last.params == "{'regParam': 0.1}" and first.score < last.score and first.r2 > 0.9 and first.median_error is not None
    table, _ = md.leaderboard(df, ["x", "y"], "kind", "classification", ["tree"], report=True)
    row = table.first()
    assert row.accuracy == row.recall == row.recall_macro == row.roc_auc_ovr == 1 and row.log_loss < 1e-9


def test_the_named_leaderboard_has_parameters_and_metrics(spark, tmp_path):
    from tablecare.queries.catalog import QUERIES

    rows = [(i, 1, i % 7, i % 5, float(i % 11 + 1), float(i * 37 % 20000), 0.01 * (i % 4), 0.01 * (i % 3), "2020-01-01") for i in range(200)]
    spark.createDataFrame(rows, "l_orderkey long, l_linenumber int, l_partkey long, l_suppkey long, l_quantity double, l_extendedprice double, l_discount double, l_tax double, l_shipdate string").write.parquet(f"{tmp_path}/lineitem.parquet")
    found = {r.model: r for r in QUERIES["mlo_leaderboard"](spark, str(tmp_path)).collect()}
    assert set(found) == {"logistic", "tree", "bayes"} and all(r.accuracy is not None and r.f1 is not None and r.roc_auc is not None and r.log_loss is not None for r in found.values())
    assert "regParam" in found["logistic"].params and "maxDepth" in found["tree"].params and found["bayes"].params == "{}"
