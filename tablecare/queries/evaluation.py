"""Drift, metric and A/B queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from tablecare import tables as tb
from tablecare.functions.columns import clip, rnd
from tablecare.operators import drift as dr
from tablecare.operators import metrics as mt
from tablecare.operators import sketches as sk
from tablecare.operators import profile as pf
from tablecare.operators import quality as ql
from tablecare.queries.quality import union
from tablecare.queries.features import work_folder
from tablecare.queries.registry import query, with_views

NUM = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]
SIDES = dict(early=tb.EARLY, late=tb.LATE)
S = dict(s=tb.SCORED_LINEITEM)


def _sides(spark, d):
    return tb.early_lineitem(spark, d), tb.late_lineitem(spark, d)


# erfc by its power series, enough for |x| up to about 4; beyond that the tail is under 1e-7.
def erfc_sql(x: str) -> str:
    return (f"(CASE WHEN {x} > 4 THEN 0 ELSE greatest(0, 1 - 2 / sqrt(pi()) * list_sum([pow(-1, k % 2) * exp((2 * k + 1) * ln({x}) - lgamma(k + 1)) / (2 * k + 1) "
            f"for k in range(0, 90)])) END)")


def _ks_sql(c):
    return f"""SELECT '{c}' AS feature, count_if(side = 0) AS n, count_if(side = 1) AS m, (SELECT max(abs(f0 - f1)) FROM
 (SELECT v, sum(count_if(side = 0)) OVER (ORDER BY v)::DOUBLE / (SELECT count(*) FROM early) AS f0, sum(count_if(side = 1)) OVER (ORDER BY v)::DOUBLE / (SELECT count(*) FROM late) AS f1
  FROM (SELECT {c} AS v, 0 AS side FROM early UNION ALL SELECT {c}, 1 FROM late) GROUP BY v)) AS statistic
 FROM (SELECT 0 AS side FROM early UNION ALL SELECT 1 FROM late)"""


_KS_P = """least(1, greatest(0, CASE WHEN sqrt(n::DOUBLE * m / (n + m)) * statistic < 0.2 THEN 1 ELSE
  2 * list_sum([(CASE WHEN k % 2 = 1 THEN 1 ELSE -1 END) * exp(-2.0 * k * k * (n::DOUBLE * m / (n + m)) * statistic * statistic) for k in range(1, 101)]) END))"""
_KS = union(_ks_sql(c) for c in NUM)


@query("drf_ks", with_views(f"""
SELECT feature, n, m, round(statistic, 8) AS statistic, round({_KS_P}, 5) + 0.0 AS p_value, {_KS_P} < 0.05 AS drifted FROM k""", **SIDES, k=_KS))
def drf_ks(spark, d):
    out = dr.ks_test(*_sides(spark, d), NUM)
    return out.withColumns({"statistic": rnd("statistic", 8), "p_value": rnd("p_value", 5)})


_CHI_CELLS = """SELECT coalesce(a.v, b.v) AS v, coalesce(a.n, 0) AS na, coalesce(b.n, 0) AS nb FROM (SELECT {c} AS v, count(*) AS n FROM {ta} GROUP BY 1) a
 FULL OUTER JOIN (SELECT {c} AS v, count(*) AS n FROM {tb} GROUP BY 1) b ON a.v = b.v"""


def _chi_sql(cells, corrected="0"):
    return f"""SELECT sum(power(greatest(abs(na - (na + nb) * ta / (ta + tb)) - {corrected}, 0), 2) / ((na + nb) * ta / (ta + tb))
  + power(greatest(abs(nb - (na + nb) * tb / (ta + tb)) - {corrected}, 0), 2) / ((na + nb) * tb / (ta + tb))) AS statistic, count(*) - 1 AS dof, max(ta + tb)::BIGINT AS n
 FROM (SELECT *, sum(na) OVER ()::DOUBLE AS ta, sum(nb) OVER ()::DOUBLE AS tb FROM ({cells}))"""


@query("drf_chi2", with_views(f"""
SELECT 'l_returnflag' AS feature, dof, n, round(statistic, 6) AS statistic, round(exp(-statistic / 2), 6) AS p_value, exp(-statistic / 2) < 0.05 AS drifted
FROM ({_chi_sql(_CHI_CELLS.format(c='l_returnflag', ta='early', tb='late'))})""", **SIDES))
def drf_chi2(spark, d):
    out = dr.chi2_test(*_sides(spark, d), ["l_returnflag"])
    return out.withColumns({"statistic": rnd("statistic"), "p_value": rnd("p_value")})


@query("drf_chi2_smoothed", """
SELECT 'o_orderpriority' AS feature, round(sum(power(o - e, 2) / e), 6) AS statistic, count(*) - 1 AS dof,
  round(exp(-sum(power(o - e, 2) / e) / 2) * (1 + sum(power(o - e, 2) / e) / 2), 6) AS p_value FROM
 (SELECT nb + 1 AS o, (na + 1) * (SELECT count(*) + 5 FROM orders WHERE o_orderstatus <> 'F')::DOUBLE / (SELECT count(*) + 5 FROM orders WHERE o_orderstatus = 'F') AS e FROM
  (SELECT o_orderpriority, count_if(o_orderstatus = 'F') AS na, count_if(o_orderstatus <> 'F') AS nb FROM orders GROUP BY 1))""")
def drf_chi2_smoothed(spark, d):
    o = tb.load(spark, d, "orders")
    out = dr.chi2_smoothed(o.where("o_orderstatus = 'F'"), o.where("o_orderstatus <> 'F'"), "o_orderpriority")
    return out.withColumns({"statistic": rnd("statistic"), "p_value": rnd("p_value")})


def _psi_sql(c):
    qs = ", ".join(f"quantile_cont({c}, {i / 10})" for i in range(1, 10))
    return f"""SELECT '{c}' AS feature, sum((a - x) * ln(a / x)) AS psi FROM
 (SELECT CASE WHEN coalesce(nb, 0) = 0 THEN 0.0001 ELSE nb::DOUBLE / (SELECT count(*) FROM late) END AS a, CASE WHEN coalesce(na, 0) = 0 THEN 0.0001 ELSE na::DOUBLE / (SELECT count(*) FROM early) END AS x
  FROM (SELECT unnest(range(0, (SELECT len(list_distinct([{qs}])) + 1 FROM early))) AS bin) g
  LEFT JOIN (SELECT len([q for q in e if q < {c}]) AS bin, count(*) AS na FROM early, (SELECT list_distinct([{qs}]) AS e FROM early) z GROUP BY 1) r USING (bin)
  LEFT JOIN (SELECT len([q for q in e if q < {c}]) AS bin, count(*) AS nb FROM late, (SELECT list_distinct([{qs}]) AS e FROM early) z GROUP BY 1) s USING (bin))"""


@query("drf_psi", with_views(f"""
SELECT feature, round(psi, 8) + 0.0 AS psi, psi > 0.25 AS drifted FROM ({union(_psi_sql(c) for c in NUM)})
UNION ALL SELECT 'l_returnflag', round(sum((a - x) * ln(a / x)), 8) + 0.0, sum((a - x) * ln(a / x)) > 0.25 FROM
 (SELECT count_if(side = 1)::DOUBLE / (SELECT count(*) FROM late) AS a, count_if(side = 0)::DOUBLE / (SELECT count(*) FROM early) AS x FROM
  (SELECT l_returnflag AS v, 0 AS side FROM early UNION ALL SELECT l_returnflag, 1 FROM late) GROUP BY v)""", **SIDES))
def drf_psi(spark, d):
    a, b = _sides(spark, d)
    out = dr.psi(a, b, NUM).unionByName(dr.psi_categories(a, b, ["l_returnflag"]))
    return out.withColumn("psi", rnd("psi", 8))


@query("drf_psi_sketches", with_views(f"SELECT feature, psi > 0.25 AS drifted, true AS near FROM ({union(_psi_sql(c) for c in NUM)})", **SIDES))
def drf_psi_sketches(spark, d):
    """The index from sketches that were stored for halves of the reference and merged; compared with the exact one."""
    a, b = _sides(spark, d)
    path = f"{work_folder(spark)}/sketches"
    for half in (0, 1):
        sk.sketch(a.where(F.col("l_orderkey") % 2 == half), NUM).write.mode("append").parquet(path)
    found = dr.psi_of_sketches(sk.merge(spark.read.parquet(path)), sk.sketch(b, NUM))
    exact = dr.psi(a, b, NUM).select("feature", F.col("psi").alias("exact"))
    return found.join(exact, "feature").select("feature", "drifted", (F.abs(F.col("psi") - F.col("exact")) <= 0.01 + 0.1 * F.col("exact")).alias("near"))


@query("drf_mean_shift", with_views(union(
    f"""SELECT '{c}' AS feature, round(a, 4) AS mean_ref, round(b, 4) AS mean_cur, round(abs(b - a) / (abs(a) + 1e-10), 6) AS shift, abs(b - a) / (abs(a) + 1e-10) > 0.2 AS shifted
 FROM (SELECT (SELECT avg({c}) FROM early) AS a, (SELECT avg({c}) FROM late) AS b)""" for c in NUM), **SIDES))
def drf_mean_shift(spark, d):
    out = dr.mean_shift(*_sides(spark, d), NUM)
    return out.withColumns({"mean_ref": rnd("mean_ref", 4), "mean_cur": rnd("mean_cur", 4), "shift": rnd("shift")})


@query("drf_reference_stats", with_views(union(
    f"""SELECT '{c}' AS "column", round(abs(mb - ma) / sa, 6) AS z, round(sb / sa, 6) AS std_ratio, (abs(mb - ma) / sa > 3 OR sb / sa < 0.5 OR sb / sa > 2) AS drifted FROM
 (SELECT (SELECT avg({c}) FROM early) AS ma, (SELECT stddev_samp({c}) FROM early) AS sa, (SELECT avg({c}) FROM late) AS mb, (SELECT stddev_samp({c}) FROM late) AS sb)""" for c in NUM), **SIDES))
def drf_reference_stats(spark, d):
    a, b = _sides(spark, d)
    out = dr.against_reference(pf.profile(a.select(*NUM)), b, NUM)
    return out.withColumns({"z": rnd("z"), "std_ratio": rnd("std_ratio")})


_PH = """
SELECT *, sum(step) OVER (PARTITION BY event_type ORDER BY rn) AS s FROM (
  SELECT event_type, rn, CASE WHEN rn > 100 THEN e - avg(CASE WHEN rn <= 100 THEN e END) OVER (PARTITION BY event_type) - 0.05 ELSE 0 END AS step FROM (
    SELECT event_type, abs(value - 20) AS e, row_number() OVER (PARTITION BY event_type ORDER BY ts, event_id) AS rn FROM events))"""


@query("drf_page_hinkley", with_views("""
SELECT event_type, bool_or(stat > 5) AS drift_detected, count_if(stat > 5) AS drift_points, round(max(stat), 4) AS max_statistic FROM
 (SELECT event_type, rn, s - least(0, min(s) OVER (PARTITION BY event_type ORDER BY rn)) AS stat FROM ph) WHERE rn > 100 GROUP BY 1""", ph=_PH))
def drf_page_hinkley(spark, d):
    points = dr.page_hinkley(tb.load(spark, d, "events"), F.abs(F.col("value") - 20), ["event_type"], ["ts", "event_id"])
    return dr.page_hinkley_summary(points, ["event_type"]).withColumn("max_statistic", rnd("max_statistic", 4))


@query("drf_score", with_views(f"""
SELECT round(max(1 - {_KS_P}), 5) AS drift_score, avg(({_KS_P} < 0.05)::INT) AS drift_share FROM k""", **SIDES, k=_KS))
def drf_score(spark, d):
    return dr.drift_score(dr.ks_test(*_sides(spark, d), NUM)).withColumn("drift_score", rnd("drift_score", 5))


TYPES = ["click", "view", "purchase", "signup", "error"]
_RP = "OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN {a} PRECEDING AND {b})"
_R, _P = _RP.format(a=19, b="CURRENT ROW"), _RP.format(a=99, b="20 PRECEDING")


@query("drf_recent_vs_past", with_views("""
SELECT event_id, round(mp - mr, 6) + 0.0 AS confidence_drop, round(change, 6) + 0.0 AS distribution_change, round(abs(mr - mp) / (sp + 1e-8), 6) + 0.0 AS feature_z FROM w WHERE n >= 100""",
    w=f"""SELECT event_id, count(*) {_RP.format(a=99, b='CURRENT ROW').replace('user_id', 'event_type')} AS n, avg(value) {_R.replace('user_id', 'event_type')} AS mr, avg(value) {_P.replace('user_id', 'event_type')} AS mp, stddev_pop(value) {_P.replace('user_id', 'event_type')} AS sp, """
      + " + ".join(f"abs(avg((user_id % 5 = {i})::INT) {_R.replace('user_id', 'event_type', 1)} - avg((user_id % 5 = {i})::INT) {_P.replace('user_id', 'event_type', 1)})" for i in range(5)) + " AS change FROM events"))
def drf_recent_vs_past(spark, d):
    ev = tb.load(spark, d, "events").withColumn("label", (F.col("user_id") % 5).cast("string"))
    out = dr.recent_vs_past(ev, "value", "label", [str(i) for i in range(5)], ["event_type"], ["ts", "event_id"])
    return out.select("event_id", *[rnd(c).alias(c) for c in ("confidence_drop", "distribution_change", "feature_z")])


@query("drf_job_gate", with_views(f"""
SELECT 'quality' AS gate, CASE WHEN 100 - least(20, dups * 100.0::DOUBLE / n) >= 50 THEN 'passed' ELSE 'failed' END AS state FROM
 (SELECT (SELECT count(*) FROM late) AS n, (SELECT count(*) FROM late) - (SELECT count(*) FROM (SELECT DISTINCT * FROM late)) AS dups)
UNION ALL SELECT 'drift', CASE WHEN bool_or({_KS_P} < 0.05) THEN 'failed' ELSE 'passed' END FROM k""", **SIDES, k=_KS))
def drf_job_gate(spark, d):
    a, b = _sides(spark, d)
    report = ql.preprocess_report(pf.Facts(b))
    drifted = dr.ks_test(a, b, NUM).agg(F.bool_or("drifted")).first()[0]
    rows = [("quality", "passed" if report.state == "valid" else "failed"), ("drift", "failed" if drifted else "passed")]
    return spark.createDataFrame(rows, "gate string, state string")


# Metrics.


_PER = """SELECT c, sum(tp) AS tp, sum(sup) AS sup, sum(hit) AS hit, CASE WHEN sum(hit) > 0 THEN sum(tp)::DOUBLE / sum(hit) ELSE 0 END AS p, CASE WHEN sum(sup) > 0 THEN sum(tp)::DOUBLE / sum(sup) ELSE 0 END AS r
 FROM (SELECT y_true AS c, (y_true = {p})::INT AS tp, 1 AS sup, 0 AS hit FROM s UNION ALL SELECT {p}, 0, 0, 1 FROM s) GROUP BY c"""
_CLS = """SELECT round(sum(tp)::DOUBLE / sum(sup), 6) AS accuracy, count_if(sup > 0) AS classes,
 round(max(CASE WHEN c = 1 THEN p END), 6) AS precision_binary, round(sum(p * sup) / sum(sup), 6) AS precision_weighted, round(avg(p), 6) AS precision_macro,
 round(max(CASE WHEN c = 1 THEN r END), 6) AS recall_binary, round(sum(r * sup) / sum(sup), 6) AS recall_weighted, round(avg(r), 6) AS recall_macro,
 round(max(CASE WHEN c = 1 THEN f END), 6) AS f1_binary, round(sum(f * sup) / sum(sup), 6) AS f1_weighted, round(avg(f), 6) AS f1_macro
FROM (SELECT *, CASE WHEN p + r > 0 THEN 2 * p * r / (p + r) ELSE 0 END AS f FROM per)"""


@query("met_classification", with_views(_CLS, **S, per=_PER.format(p="pred_a")))
def met_classification(spark, d):
    out = mt.classification(tb.scored_lineitem(spark, d), "y_true", "pred_a")
    return out.select("classes", *[rnd(c).alias(c) for c in out.columns if c != "classes"])


@query("met_confusion", with_views("""
SELECT tp, tn, fp, fn, round(tn::DOUBLE / (tn + fp), 6) AS specificity, round(tp::DOUBLE / (tp + fn), 6) AS sensitivity, round((tn::DOUBLE / (tn + fp) + tp::DOUBLE / (tp + fn)) / 2, 6) AS balanced_accuracy
FROM (SELECT count_if(y_true = 1 AND pred_a = 1) AS tp, count_if(y_true = 0 AND pred_a = 0) AS tn, count_if(y_true = 0 AND pred_a = 1) AS fp, count_if(y_true = 1 AND pred_a = 0) AS fn FROM s)""", **S))
def met_confusion(spark, d):
    out = mt.binary_counts(tb.scored_lineitem(spark, d), "y_true", "pred_a")
    return out.withColumns({c: rnd(c) for c in ("specificity", "sensitivity", "balanced_accuracy")})


@query("met_auc_logloss", with_views("""
SELECT round((sum(CASE WHEN y_true = 1 THEN rk END) - np * (np + 1) / 2) / (np * nn), 8) AS roc_auc,
  round(-avg(CASE WHEN y_true = 1 THEN ln(proba) ELSE ln(1 - proba) END), 6) AS log_loss FROM
 (SELECT *, rank() OVER (ORDER BY proba) + (count(*) OVER (PARTITION BY proba) - 1) / 2.0::DOUBLE AS rk, sum(y_true) OVER ()::DOUBLE AS np, sum(1 - y_true) OVER ()::DOUBLE AS nn FROM s) GROUP BY np, nn""", **S))
def met_auc_logloss(spark, d):
    s = tb.scored_lineitem(spark, d)
    loss = s.agg(mt.log_loss("y_true", "proba").alias("l")).first()[0]
    return mt.auc(s, "y_true", "proba").select(rnd("roc_auc", 8).alias("roc_auc"), F.round(F.lit(loss), 6).alias("log_loss"))


_REG = {
    "mse": ("avg(e * e)", 2), "rmse": ("sqrt(avg(e * e))", 4), "mae": ("avg(abs(e))", 4), "r2": ("1 - sum(e * e) / (var_pop(y) * count(*))", 6), "max_error": ("max(abs(e))", 4),
    "explained_variance": ("1 - var_pop(e) / var_pop(y)", 6), "mape": ("avg(abs(e) / abs(y))", 6), "mean_residual": ("avg(e)", 4), "std_residual": ("stddev_pop(e)", 4),
    "within_5pct": ("avg((abs(e) <= abs(y) * 0.05)::INT)", 6), "within_10pct": ("avg((abs(e) <= abs(y) * 0.1)::INT)", 6), "within_20pct": ("avg((abs(e) <= abs(y) * 0.2)::INT)", 6),
}


@query("met_regression", with_views("SELECT " + ", ".join(f"round({x}, {k}) + 0.0 AS {n}" for n, (x, k) in _REG.items())
       + ", round(median(abs(e)), 4) AS median_ae FROM (SELECT actual AS y, actual - forecast_a AS e FROM s)", **S))
def met_regression(spark, d):
    s = tb.scored_lineitem(spark, d)
    row = s.agg(*[c.alias(n) for n, c in mt.regression("actual", "forecast_a").items()])
    med = mt.median_error(s, "actual", "forecast_a")
    return row.select(*[rnd(n, k).alias(n) for n, (_, k) in _REG.items()], F.round(F.lit(med), 4).alias("median_ae"))


@query("met_weighted", with_views("""
SELECT round(sum(w * e * e) / sum(w), 2) AS mse, round(sum(w * abs(e)) / sum(w), 4) AS mae, round(1 - sum(w * e * e) / sum(w * power(y - m, 2)), 6) AS r2, round(avg(abs(e) / abs(y)) * 100, 6) AS mape_pct
FROM (SELECT actual AS y, actual - forecast_a AS e, l_linenumber AS w, sum(l_linenumber * actual) OVER () / sum(l_linenumber) OVER () AS m FROM s)""", **S))
def met_weighted(spark, d):
    row = tb.scored_lineitem(spark, d).agg(*[c.alias(n) for n, c in mt.weighted_performance("actual", "forecast_a", "l_linenumber").items()])
    return row.select(rnd("mse", 2).alias("mse"), rnd("mae", 4).alias("mae"), rnd("r2").alias("r2"), rnd("mape_pct").alias("mape_pct"))


_CMP = ["mae", "mape", "within_10pct"]
_cmp_sql = {"mae": "avg(abs({e}))", "mape": "avg(abs({e}) / abs(actual))", "within_10pct": "avg((abs({e}) <= abs(actual) * 0.1)::INT)"}


@query("met_compare", with_views(union(
    f"SELECT '{m}' AS metric, round(a, 5) AS a, round(b, 5) AS b, round(b - a, 5) + 0.0 AS diff, round((b - a) / abs(a) * 100, 4) + 0.0 AS pct FROM (SELECT {_cmp_sql[m].format(e='(actual - forecast_a)')} AS a, {_cmp_sql[m].format(e='(actual - forecast_b)')} AS b FROM s)"
    for m in _CMP) + " UNION ALL SELECT 'accuracy', round(a, 5), round(b, 5), round(b - a, 5) + 0.0, round((b - a) / abs(a) * 100, 4) + 0.0 FROM (SELECT avg((y_true = pred_a)::INT) AS a, avg((y_true = pred_b)::INT) AS b FROM s)", **S))
def met_compare(spark, d):
    s = tb.scored_lineitem(spark, d)

    def rows(pred, forecast):
        metrics = mt.regression("actual", forecast)
        aggs = [metrics[m].alias(m) for m in _CMP] + [F.avg((F.col("y_true") == F.col(pred)).cast("double")).alias("accuracy")]
        return mt.as_rows(s.agg(*aggs), [*_CMP, "accuracy"])

    out = mt.compare(rows("pred_a", "forecast_a"), rows("pred_b", "forecast_b"))
    # Five digits: the error of B lies on the edge of the sixth, where the order of a sum decides.
    return out.withColumns({"a": rnd("a", 5), "b": rnd("b", 5), "diff": rnd("diff", 5), "pct": rnd("pct", 4)})


@query("met_mcnemar", with_views(f"""
SELECT only_a, only_b, round(st, 6) AS statistic, round({erfc_sql('sqrt(st / 2)')}, 6) + 0.0 AS p_value FROM (SELECT *, power(abs(only_a - only_b) - 1, 2)::DOUBLE / (only_a + only_b) AS st FROM
 (SELECT count_if(y_true = pred_a AND y_true <> pred_b) AS only_a, count_if(y_true <> pred_a AND y_true = pred_b) AS only_b FROM s))""", **S))
def met_mcnemar(spark, d):
    out = mt.mcnemar(tb.scored_lineitem(spark, d), "y_true", "pred_a", "pred_b")
    return out.withColumns({"statistic": rnd("statistic"), "p_value": rnd("p_value")})


@query("met_paired_t", with_views("""
SELECT count(*) AS n, round(avg(x), 4) + 0.0 AS mean_difference, round(avg(x) / (stddev_samp(x) / sqrt(count(*))), 6) + 0.0 AS statistic, round(avg(x) / stddev_pop(x), 6) + 0.0 AS effect_size,
  round(avg(x) - 1.96 * stddev_pop(x) / sqrt(count(*)), 4) + 0.0 AS ci_lower, round(avg(x) + 1.96 * stddev_pop(x) / sqrt(count(*)), 4) + 0.0 AS ci_upper
FROM (SELECT (actual - forecast_a) - (actual - forecast_b) AS x FROM s)""", **S))
def met_paired_t(spark, d):
    """The t tail has no SQL form, so the query leaves p_value out; the unit tests check it."""
    out = mt.paired_t(tb.scored_lineitem(spark, d), F.col("actual") - F.col("forecast_a"), F.col("actual") - F.col("forecast_b"))
    return out.select("n", *[rnd(c, k).alias(c) for c, k in (("mean_difference", 4), ("statistic", 6), ("effect_size", 6), ("ci_lower", 4), ("ci_upper", 4))])


ARM = "CASE WHEN ('0x' || md5(user_id::VARCHAR)[1:8])::BIGINT % 10000 < 1000 THEN 'challenger' ELSE 'champion' END"
E_ = dict(e=f"SELECT *, {ARM} AS arm FROM events")
_ARMS = dict(**E_, m="""SELECT count_if(arm = 'champion') AS n_a, count_if(arm = 'challenger') AS n_b, avg(value) FILTER (arm = 'champion') AS mean_a, avg(value) FILTER (arm = 'challenger') AS mean_b,
  stddev_pop(value) FILTER (arm = 'champion') AS std_a, stddev_pop(value) FILTER (arm = 'challenger') AS std_b, var_samp(value) FILTER (arm = 'champion') AS va, var_samp(value) FILTER (arm = 'challenger') AS vb,
  median(value) FILTER (arm = 'champion') AS median_a, median(value) FILTER (arm = 'challenger') AS median_b FROM e""")
_TSTAT = "(mean_a - mean_b) / sqrt(((n_a - 1) * va + (n_b - 1) * vb) / (n_a + n_b - 2) * (1.0::DOUBLE / n_a + 1.0::DOUBLE / n_b))"


def _arms(spark, d):
    return mt.route(tb.load(spark, d, "events"), "user_id", 0.1)


@query("met_t_test", with_views(f"""
SELECT n_a, n_b, round(mean_a, 6) AS mean_a, round(mean_b, 6) AS mean_b, round(std_a, 6) AS std_a, round(std_b, 6) AS std_b, round({_TSTAT}, 6) + 0.0 AS statistic,
  round((mean_b - mean_a) / sqrt((std_a * std_a + std_b * std_b) / 2), 6) + 0.0 AS effect_size,
  round(mean_b - mean_a - 1.96 * sqrt(std_a * std_a / n_a + std_b * std_b / n_b), 6) + 0.0 AS ci_lower, round(mean_b - mean_a + 1.96 * sqrt(std_a * std_a / n_a + std_b * std_b / n_b), 6) + 0.0 AS ci_upper FROM m""", **_ARMS))
def met_t_test(spark, d):
    out = mt.t_test(_arms(spark, d), "arm", "value", "champion", "challenger").drop("p_value")
    return out.select("n_a", "n_b", *[rnd(c).alias(c) for c in out.columns if c not in ("n_a", "n_b")])


@query("met_mann_whitney", with_views(f"""
SELECT n_a, n_b, round(u, 2) AS statistic, round(1 - 2 * u / (n_a * n_b), 6) + 0.0 AS effect_size, round(z, 6) + 0.0 AS z, round(least(1, {erfc_sql('(abs(z) / sqrt(2))')}), 5) + 0.0 AS p_value FROM
 (SELECT *, (greatest(u, n_a::DOUBLE * n_b - u) - n_a::DOUBLE * n_b / 2 - 0.5) / sqrt(n_a::DOUBLE * n_b / 12 * ((n_a + n_b + 1) - t / ((n_a + n_b)::DOUBLE * (n_a + n_b - 1)))) AS z FROM
  (SELECT count_if(arm = 'champion') AS n_a, count_if(arm = 'challenger') AS n_b, sum(CASE WHEN arm = 'champion' THEN rk END) - count_if(arm = 'champion')::DOUBLE * (count_if(arm = 'champion') + 1) / 2 AS u,
     sum(k::DOUBLE * k - 1) AS t FROM (SELECT arm, rank() OVER (ORDER BY value) + (count(*) OVER (PARTITION BY value) - 1) / 2.0::DOUBLE AS rk, count(*) OVER (PARTITION BY value) AS k FROM e)))""", **E_))
def met_mann_whitney(spark, d):
    out = mt.mann_whitney(_arms(spark, d), "arm", "value", "champion", "challenger")
    return out.withColumns({"statistic": rnd("statistic", 2), "effect_size": rnd("effect_size"), "z": rnd("z"), "p_value": rnd("p_value", 5)})


@query("met_chi_square", f"""
SELECT round(statistic, 6) AS statistic, dof, n, round(exp(-statistic / 2), 6) AS p_value, round(sqrt(statistic / n), 6) AS cramers_v FROM
 ({_chi_sql("SELECT l_returnflag AS v, count_if(l_linestatus = 'F') AS na, count_if(l_linestatus = 'O') AS nb FROM lineitem GROUP BY 1")})""")
def met_chi_square(spark, d):
    out = mt.chi_square(tb.load(spark, d, "lineitem"), "l_linestatus", "l_returnflag", "F", "O")
    return out.withColumns({c: rnd(c) for c in ("statistic", "p_value", "cramers_v")})


_Z = "(rt - rc) / sqrt(p * (1 - p) * (1.0::DOUBLE / n_c + 1.0::DOUBLE / n_t))"


@query("met_z_prop", with_views(f"""
SELECT n_c, n_t, s_c, s_t, round(rc, 6) AS rate_c, round(rt, 6) AS rate_t, round(z, 6) + 0.0 AS z, round({erfc_sql('(abs(z) / sqrt(2))')}, 5) + 0.0 AS p_value,
  CASE WHEN {erfc_sql('(abs(z) / sqrt(2))')} < 0.05 THEN CASE WHEN rt > rc THEN 'treatment' ELSE 'control' END END AS winner
FROM (SELECT *, {_Z} AS z FROM (SELECT *, s_c::DOUBLE / n_c AS rc, s_t::DOUBLE / n_t AS rt, (s_c + s_t)::DOUBLE / (n_c + n_t) AS p FROM
 (SELECT count_if(arm = 'champion') AS n_c, count_if(arm = 'challenger') AS n_t, count_if(arm = 'champion' AND event_type = 'purchase') AS s_c, count_if(arm = 'challenger' AND event_type = 'purchase') AS s_t FROM e)))""", **E_))
def met_z_prop(spark, d):
    out = mt.two_proportions(_arms(spark, d), "arm", F.col("event_type") == "purchase", "champion", "challenger")
    return out.withColumns({"rate_c": rnd("rate_c"), "rate_t": rnd("rate_t"), "z": rnd("z"), "p_value": rnd("p_value", 5)})


_CURVE = dict(**S, c="""SELECT proba AS score, sum(count_if(y_true = 1)) OVER (ORDER BY proba DESC)::DOUBLE AS tp, sum(count_if(y_true = 0)) OVER (ORDER BY proba DESC)::DOUBLE AS fp FROM s GROUP BY proba""",
              pts="SELECT score, fp / (SELECT count_if(y_true = 0) FROM s) AS fpr, tp / (SELECT count_if(y_true = 1) FROM s) AS tpr, tp / (tp + fp) AS precision FROM c")


@query("met_curves", with_views("SELECT round(score, 6) AS score, round(fpr, 6) AS fpr, round(tpr, 6) AS tpr, round(precision, 6) AS precision FROM pts", **_CURVE))
def met_curves(spark, d):
    out = mt.curve_points(tb.scored_lineitem(spark, d), "y_true", "proba")
    return out.select(*[rnd(c).alias(c) for c in out.columns])


@query("met_pr_auc", with_views("""
SELECT round(sum((tpr - r0) * (precision + p0) / 2), 6) AS pr_auc FROM (SELECT tpr, precision, coalesce(lag(tpr) OVER (ORDER BY score DESC), 0) AS r0, coalesce(lag(precision) OVER (ORDER BY score DESC), 1) AS p0 FROM pts)""", **_CURVE))
def met_pr_auc(spark, d):
    return mt.pr_area(mt.curve_points(tb.scored_lineitem(spark, d), "y_true", "proba")).withColumn("pr_auc", rnd("pr_auc"))


@query("met_residuals", with_views("""
SELECT least(greatest(floor((x + 11000) / 1100), 0), 19)::BIGINT AS bin, model, count(*) AS n, round(avg(x), 4) + 0.0 AS mean_residual FROM
 (SELECT 'a' AS model, actual - forecast_a AS x FROM s UNION ALL SELECT 'b', actual - forecast_b FROM s) GROUP BY 1, 2""", **S))
def met_residuals(spark, d):
    """Residuals of both models, binned before anyone looks at them."""
    s = tb.scored_lineitem(spark, d).select(F.explode(F.array(
        F.struct(F.lit("a").alias("model"), (F.col("actual") - F.col("forecast_a")).alias("x")),
        F.struct(F.lit("b").alias("model"), (F.col("actual") - F.col("forecast_b")).alias("x")))).alias("r")).select("r.*")
    bin_ = clip(F.floor((F.col("x") + 11000) / 1100), 0, 19).cast("bigint")
    return s.groupBy(bin_.alias("bin"), "model").agg(F.count(F.lit(1)).alias("n"), rnd(F.avg("x"), 4).alias("mean_residual"))


@query("met_confidence", with_views("""
SELECT round(avg(t), 6) AS mean_confidence, round(stddev_pop(t), 6) AS std_confidence, round(min(t), 6) AS min_confidence, round(max(t), 6) AS max_confidence,
  round(avg((t >= 0.7)::INT), 6) AS high_share, round(avg((t < 0.7)::INT), 6) AS low_share FROM (SELECT greatest(proba, 1 - proba) AS t FROM s)""", **S))
def met_confidence(spark, d):
    out = mt.confidence(tb.scored_lineitem(spark, d).withColumn("other", 1 - F.col("proba")), ["proba", "other"])
    return out.select(*[rnd(c).alias(c) for c in out.columns])


@query("abt_route", with_views("SELECT user_id, arm, count(*) AS n FROM e GROUP BY 1, 2", **E_))
def abt_route(spark, d):
    return _arms(spark, d).groupBy("user_id", "arm").agg(F.count(F.lit(1)).alias("n"))


@query("abt_analyze", with_views(f"""
SELECT n_a, n_b, round(mean_a, 6) AS mean_a, round(mean_b, 6) AS mean_b, round(std_a, 6) AS std_a, round(std_b, 6) AS std_b, round(median_a, 6) AS median_a, round(median_b, 6) AS median_b,
  round({_TSTAT}, 6) + 0.0 AS statistic, round(mean_b - mean_a, 6) + 0.0 AS improvement FROM m""", **_ARMS))
def abt_analyze(spark, d):
    out = mt.analyze_arms(_arms(spark, d), "arm", "value").drop("p_value", "winner", "effect_size")
    return out.select("n_a", "n_b", *[rnd(c).alias(c) for c in out.columns if c not in ("n_a", "n_b")])
