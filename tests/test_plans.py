"""Plans that must hold at any size."""

import ast
from pathlib import Path

import pytest

from tablecare import tables as tb
from tablecare.plans.preprocess import Preprocess
from tablecare.queries import catalog

ROOT = Path(__file__).resolve().parents[1] / "tablecare"


def executed(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_scans_read_only_what_they_need(spark, sf):
    plan = executed(catalog.QUERIES["prj_clip_bounds"](spark, sf))
    assert "ReadSchema: struct<l_orderkey:bigint,l_linenumber:int,l_quantity:double>" in plan
    plan = executed(catalog.QUERIES["src_document_find"](spark, sf))
    assert "PushedFilters: [" in plan and "GreaterThanOrEqual(value,10" in plan


@pytest.mark.parametrize("name", ["fea_lag_rolling", "win_trend", "cln_negative_prices", "met_classification", "agg_target_balance", "fea_target_encode"])
def test_no_cross_join_or_single_partition_window(spark, sf, name):
    plan = executed(catalog.QUERIES[name](spark, sf))
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan
    if "Window" in plan:
        assert "Exchange SinglePartition" not in plan.split("Window")[-1]


def test_forbidden_calls_are_absent():
    banned = {"crossJoin", "localCheckpoint", "toPandas", "rdd"}
    for path in ROOT.rglob("*.py"):
        for node in ast.walk(ast.parse(path.read_text())):
            if isinstance(node, ast.Attribute):
                assert node.attr not in banned, f"{path.name}: {node.attr}"


def test_checkpoint_folder_comes_from_the_session(spark):
    from tablecare.session import ensure_checkpoint_dir

    ensure_checkpoint_dir(spark)
    before = spark.sparkContext.getCheckpointDir()
    ensure_checkpoint_dir(spark)
    assert before and spark.sparkContext.getCheckpointDir() == before
    assert tb.SPLIT_DATE == "1998-05-24"


def test_preprocessing_loses_no_column(spark):
    from tablecare.operators.clean import TooManyValues

    rows = [(i, f"city{i % 50}", (1, 5, 9)[i % 3], float(i), i % 2 == 0, None, f"some longer words number {i % 4} stand here") for i in range(400)]
    df = spark.createDataFrame(rows, "key int, city string, code int, x double, flag boolean, nothing string, body string")
    out = Preprocess(exclude=("key",)).fit(df).transform(df)
    assert {"key", "city", "x", "nothing", "body"} <= set(out.columns) and {"code_1", "code_5", "code_9"} <= set(out.columns)
    assert any(c.startswith("flag") for c in out.columns)
    terms = Preprocess(exclude=("key",), text="tfidf", text_terms=3).fit(df).transform(df)
    assert sum(c.startswith("body_tfidf_") for c in terms.columns) == 3 and "city" not in terms.columns
    many = spark.range(3000).selectExpr("id", "concat('v', id % 1500) AS c")
    with pytest.raises(TooManyValues):
        Preprocess(exclude=("id",), rare_share=0.0, kinds={"c": "categorical"}).fit(many)


def test_a_replayed_plan_does_not_swallow_too_many_values(spark):
    from tablecare.operators.clean import TooManyValues
    from tablecare.plans.cleaning_plan import Step, replay

    many = spark.range(3000).selectExpr("id", "concat('v', id % 1500) AS c")
    with pytest.raises(TooManyValues):
        replay(many, [Step("encode", "c", {"method": "onehot"})])


def test_feature_families_have_no_cap_of_their_own():
    from tablecare.operators import features as fe

    cols = [f"c{i}" for i in range(12)]
    assert len(fe.interaction_columns(cols)) == 66 * 3 and len(fe.ratio_columns(cols)) == 66 * 2 and len(fe.polynomial_columns(cols)) == 78
    assert len(fe.polynomial_columns(cols, cap=25)) == 25


def test_preprocess_takes_a_value_called_other(spark):
    rows = [("a",)] * 40 + [("Other",)] * 40 + [("b",)] * 40 + [("c",)]
    df = spark.createDataFrame([(*r, i, i % 2) for i, r in enumerate(rows)], "kind string, x long, flag int")
    out = Preprocess(rare_share=0.1, kinds={"kind": "categorical"}).fit(df).transform(df)
    names = [c for c in out.columns if c.startswith("kind_")]
    assert names == ["kind_a", "kind_b", "kind_Other"] and [out.agg({c: "sum"}).first()[0] for c in names] == [40.0, 40.0, 41.0]


def test_cleaning_takes_facts_that_are_there(spark, monkeypatch):
    from tablecare.operators.profile import Facts
    from tablecare.plans import auto_clean as ac

    df = spark.createDataFrame([("ab"[i % 2], None if i % 5 == 0 else float(i % 20)) for i in range(80)], "category string, x double")
    before = Facts(df)
    monkeypatch.setattr(ac, "Facts", lambda *a, **k: pytest.fail("facts were taken again"))
    out, report = ac.auto_clean(df, sector="retail", before=before)
    assert out.count() == before.rows - before.duplicates and report["steps"][0]["action"] == "remove_duplicates"
