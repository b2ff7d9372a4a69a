"""Medians of few groups from brackets, and copies counted by hashes first."""

import math
import statistics

import pytest

from tablecare.functions import ordered
from tablecare.operators import clean as cl
from tablecare.operators.profile import duplicate_count


def _rows(n=900):
    return [(None if i % 50 == 7 else "abc"[i % 3], None if i % 5 == 0 else float((i * 7919) % 1000), float(i % 4), None, -(i % 9)) for i in range(n)]


@pytest.fixture
def groups(spark):
    return spark.createDataFrame(_rows(), "g string, x double, few double, nothing double, whole int")


def _expected(rows, i):
    by = {}
    for r in rows:
        if r[0] is not None and r[i] is not None:
            by.setdefault(r[0], []).append(r[i])
    return {g: statistics.median(v) for g, v in by.items()}


@pytest.mark.parametrize("most", [100_000, 20])
def test_medians_of_few_groups_need_no_order_of_all_values(large, groups, monkeypatch, most):
    def never(*args, **kwargs):
        raise AssertionError("values were put in order")

    monkeypatch.setattr(cl, "group_quantiles", never)
    monkeypatch.setattr(ordered, "BRACKET_VALUES", most)  # with few values at once, brackets are narrowed
    monkeypatch.setattr(ordered, "SLACK", 0.02)
    found = {r["g"]: r for r in cl.group_medians(groups, "g", ["x", "few", "nothing", "whole"]).collect()}
    rows = _rows()
    assert set(found) == {"a", "b", "c"}
    for i, c in ((1, "x"), (2, "few"), (4, "whole")):
        assert {g: r[f"_med_{c}"] for g, r in found.items()} == _expected(rows, i)
    assert all(r["_med_nothing"] is None for r in found.values())


def test_many_groups_and_nans_go_the_general_way(large, spark, groups):
    many = spark.createDataFrame([(i % 150, float(i)) for i in range(600)], "g int, x double")
    assert ordered.few_group_quantile(many, "g", {"x": many["x"]}, 0.5) is None
    assert {r["g"]: r["_med_x"] for r in cl.group_medians(many, "g", ["x"]).collect()} == {g: g + 225.0 for g in range(150)}
    nans = spark.createDataFrame([("a", 1.0), ("a", math.nan), ("a", math.nan), ("b", 2.0)], "g string, x double")
    assert ordered.few_group_quantile(nans, "g", {"x": nans["x"]}, 0.5) is None
    found = {r["g"]: r["_med_x"] for r in cl.group_medians(nans, "g", ["x"]).collect()}
    assert math.isnan(found["a"]) and found["b"] == 2.0


@pytest.mark.parametrize("copies", [0, 3, 60])
def test_copies_are_counted_as_rows_not_hashes(spark, copies):
    rows = [(i, f"t{i}", float(i)) for i in range(80)] + [(i, f"t{i}", float(i)) for i in range(copies)]
    rows += [(None, None, math.nan), (None, None, math.nan), (500, "z", 0.0), (500, "z", -0.0)]
    assert duplicate_count(spark.createDataFrame(rows, "a int, b string, c double")) == (84 + copies, copies + 2)
    assert duplicate_count(spark.createDataFrame([], "a int")) == (0, 0)
