"""Profiling and quality queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from tablecare import tables as tb
from tablecare.functions.columns import melt_row, numeric_columns, rnd, sample_skewness, sentinels_for
from tablecare.operators import profile as pf
from tablecare.operators import sketches as sk
from tablecare.operators import quality as ql
from tablecare.operators.project import flag_numeric_text
from tablecare.plans.auto_clean import auto_clean
from tablecare.queries.registry import query, with_views
from tablecare.queries.sqlfacts import (
    CUSTOMER, DIRTY, LINEITEM, ORDERS, duplicates_sql, facts_sql, totals_sql)

NUM = [c for c, k in LINEITEM.items() if k == "numeric"]
MEASURES = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]


def union(parts) -> str:
    return "\nUNION ALL ".join(parts)


DIRTY_FACTS = dict(dirty=tb.DIRTY_LINEITEM, facts=facts_sql("dirty", DIRTY), dup=duplicates_sql("dirty"), t=totals_sql())
# The retail local statistics look at sentinels per column as the other reports do.

_TYPES = {"l_orderkey": "bigint", "l_partkey": "bigint", "l_suppkey": "bigint", "l_linenumber": "int",
          "l_quantity": "double", "l_extendedprice": "double", "l_discount": "double", "l_tax": "double",
          "l_returnflag": "string", "l_linestatus": "string", "l_shipdate": "timestamp_ntz"}


def _profile_sql(view, cols, types):
    rows = []
    for c, kind in cols.items():
        if kind == "numeric":
            more = (f"round(avg({c}), 4) + 0.0 AS mean, round(stddev_samp({c}), 4) + 0.0 AS std, min({c})::DOUBLE AS min, "
                    f"max({c})::DOUBLE AS max, round(quantile_cont({c}::DOUBLE, 0.25), 6) + 0.0 AS q25, "
                    f"round(quantile_cont({c}::DOUBLE, 0.5), 6) + 0.0 AS q50, round(quantile_cont({c}::DOUBLE, 0.75), 6) + 0.0 AS q75, "
                    f"min({c}) < 0 AS has_negative")
        else:
            more = ("NULL::DOUBLE AS mean, NULL::DOUBLE AS std, NULL::DOUBLE AS min, NULL::DOUBLE AS max, "
                    "NULL::DOUBLE AS q25, NULL::DOUBLE AS q50, NULL::DOUBLE AS q75, NULL::BOOLEAN AS has_negative")
        rows.append(f"SELECT '{c}' AS \"column\", '{types[c]}' AS dtype, count({c}) AS count, count(*) - count({c}) AS nulls, "
                    f"(count(*) - count({c}))::DOUBLE / count(*) AS null_share, count(DISTINCT {c}) AS \"distinct\", {more} FROM {view}")
    return union(rows)


def _profile_rounded(df):
    return pf.profile(df).withColumns({
        **{c: rnd(c, 4) for c in ("mean", "std")}, **{c: rnd(c) for c in ("q25", "q50", "q75")}})


@query("agg_profile", _profile_sql("lineitem", LINEITEM, _TYPES))
def agg_profile(spark, d):
    return _profile_rounded(tb.load(spark, d, "lineitem"))


def _top_sql(view, cols):
    return union(
        f"SELECT '{c}' AS \"column\", v AS value, n, rank FROM (SELECT {c}::VARCHAR AS v, count(*) AS n, "
        f"row_number() OVER (ORDER BY count(*) DESC, {c}::VARCHAR) AS rank FROM {view} GROUP BY {c}) WHERE rank <= 10"
        for c in cols)


@query("agg_top_values", _top_sql("orders", ["o_orderstatus", "o_orderpriority"]))
def agg_top_values(spark, d):
    df = pf.top_values(tb.load(spark, d, "orders"), ["o_orderstatus", "o_orderpriority"])
    return df.withColumn("rank", F.col("rank").cast("bigint"))


@query("agg_missing", with_views("""
SELECT "column", missing, round(missing * 100.0::DOUBLE / n_rows, 6) AS missing_pct,
       CASE WHEN missing::DOUBLE / n_rows > 0.5 THEN 'critical' WHEN missing::DOUBLE / n_rows > 0.35 THEN 'warning' ELSE 'ok' END AS tier,
       CASE WHEN missing::DOUBLE / n_rows > 0.5 THEN 15 WHEN missing::DOUBLE / n_rows > 0.35 THEN 5 ELSE 0 END AS penalty
FROM facts""", dirty=tb.DIRTY_LINEITEM, facts=facts_sql("dirty", DIRTY)))
def agg_missing(spark, d):
    df = tb.dirty_lineitem(spark, d)
    from tablecare.functions.columns import is_missing

    row = df.agg(F.count(F.lit(1)).alias("rows"), *[F.count_if(is_missing(df, c)).alias(c) for c in df.columns])
    long = melt_row(row, {c: {"missing": c, "rows": "rows"} for c in df.columns})
    share = F.col("missing") / F.col("rows")
    return long.select(
        "column", "missing", F.round(share * 100, 6).alias("missing_pct"),
        F.when(share > 0.5, "critical").when(share > 0.35, "warning").otherwise("ok").alias("tier"),
        F.when(share > 0.5, 15).when(share > 0.35, 5).otherwise(0).alias("penalty"))


@query("agg_duplicates", with_views("""
SELECT (SELECT count(*) FROM dirty) AS n_rows, dups AS duplicates,
       round(dups * 100.0::DOUBLE / (SELECT count(*) FROM dirty), 6) AS pct,
       CASE WHEN dups = 0 THEN 0 WHEN dups::DOUBLE / (SELECT count(*) FROM dirty) > 0.1 THEN 10
            WHEN dups::DOUBLE / (SELECT count(*) FROM dirty) > 0.05 THEN 5 ELSE 2 END AS penalty
FROM dup""", dirty=tb.DIRTY_ORDERS, dup=duplicates_sql("dirty")))
def agg_duplicates(spark, d):
    df = tb.dirty_orders(spark, d)
    groups = df.groupBy(*df.columns).agg(F.count(F.lit(1)).alias("n"))
    dups = F.col("n_rows") - F.col("groups")
    share = dups / F.col("n_rows")
    return groups.agg(F.sum("n").alias("n_rows"), F.count(F.lit(1)).alias("groups")).select(
        "n_rows", dups.alias("duplicates"), F.round(share * 100, 6).alias("pct"),
        F.when(dups == 0, 0).when(share > 0.1, 10).when(share > 0.05, 5).otherwise(2).alias("penalty"))


@query("agg_constant_cols", with_views("""
SELECT "column", CASE WHEN missing = n_rows THEN 'all_null' ELSE 'constant' END AS state
FROM facts WHERE missing = n_rows OR n_distinct = 1""", dirty=tb.DIRTY_LINEITEM, facts=facts_sql("dirty", DIRTY)))
def agg_constant_cols(spark, d):
    found = pf.distinct_counts(tb.dirty_lineitem(spark, d)).where(F.col("distinct") <= 1)
    return found.select("column", F.when(F.col("distinct") == 0, "all_null").otherwise("constant").alias("state"))


_IQR = union(
    f"SELECT '{c}' AS \"column\", round(q1 - 1.5 * (q3 - q1), 6) + 0.0 AS lower, round(q3 + 1.5 * (q3 - q1), 6) + 0.0 AS upper, "
    f"count_if({c} < q1 - 1.5 * (q3 - q1) OR {c} > q3 + 1.5 * (q3 - q1)) AS outliers, "
    f"round(count_if({c} < q1 - 1.5 * (q3 - q1) OR {c} > q3 + 1.5 * (q3 - q1))::DOUBLE / count(*), 6) AS share "
    f"FROM lineitem, (SELECT quantile_cont({c}::DOUBLE, 0.25) AS q1, quantile_cont({c}::DOUBLE, 0.75) AS q3 FROM lineitem) q GROUP BY q1, q3"
    for c in NUM)


@query("agg_iqr_outliers", f"""
SELECT *, CASE WHEN share > 0.15 THEN 'critical' WHEN share > 0.05 THEN 'warning' ELSE 'ok' END AS level FROM ({_IQR})""")
def agg_iqr_outliers(spark, d):
    df = pf.outlier_counts(tb.load(spark, d, "lineitem")).drop("rows")
    return df.withColumns({c: rnd(c) for c in ("lower", "upper", "share")}).withColumn(
        "level", F.when(F.col("share") > 0.15, "critical").when(F.col("share") > 0.05, "warning").otherwise("ok"))


@query("agg_zscore_outliers", union(
    f"SELECT '{c}' AS \"column\", count_if(abs({c} - m) / s > 3) AS outliers FROM lineitem, "
    f"(SELECT avg({c}) AS m, stddev_pop({c}) AS s FROM lineitem) q" for c in MEASURES))
def agg_zscore_outliers(spark, d):
    return pf.zscore_outliers(tb.load(spark, d, "lineitem"), MEASURES)


@query("agg_high_cardinality", with_views("""
SELECT "column", n_distinct AS "distinct", n_distinct > 20 AS over_20, n_distinct::DOUBLE / n_rows > 0.5 AS over_half,
       n_distinct::DOUBLE / n_rows > 0.9 AS over_ninety FROM facts WHERE kind = 'text'""", facts=facts_sql("customer", CUSTOMER)))
def agg_high_cardinality(spark, d):
    df = tb.load(spark, d, "customer")
    rows = df.agg(F.count(F.lit(1)).alias("n")).first()["n"]
    out = pf.distinct_counts(df, [c for c, k in CUSTOMER.items() if k == "text"])
    share = F.col("distinct") / F.lit(rows)
    return out.select("column", "distinct", (F.col("distinct") > 20).alias("over_20"),
                      (share > 0.5).alias("over_half"), (share > 0.9).alias("over_ninety"))


@query("agg_high_cardinality_sketches", with_views("""
SELECT "column", true AS near, n_distinct > 20 AS over_20 FROM facts WHERE kind = 'text'""", facts=facts_sql("customer", CUSTOMER)))
def agg_high_cardinality_sketches(spark, d):
    """Distinct counts from sketches of halves of the table, merged; within four times the stated error of the exact ones."""
    df, cols = tb.load(spark, d, "customer"), [c for c, k in CUSTOMER.items() if k == "text"]
    halves = [sk.sketch(df.where(F.col("c_custkey") % 2 == h), [], cols) for h in (0, 1)]
    rough = sk.distinct_counts(sk.merge(halves[0].unionByName(halves[1])))
    exact = pf.distinct_counts(df, cols).withColumnRenamed("distinct", "exact")
    near = F.abs(F.col("distinct") - F.col("exact")) <= 4 * sk.DISTINCT_ERROR * F.col("exact") + 1
    return rough.join(exact, "column").select("column", near.alias("near"), (F.col("distinct") > 20).alias("over_20"))


_TEXT_EVENTS = ("SELECT event_id::VARCHAR AS event_id, user_id::VARCHAR AS user_id, event_type, "
                "value::VARCHAR AS value, props FROM events")


def text_events(spark, d):
    ev = tb.load(spark, d, "events")
    return ev.select(F.col("event_id").cast("string"), F.col("user_id").cast("string"), "event_type",
                     F.col("value").cast("string"), "props")


@query("agg_numeric_text", with_views(union(
    f"SELECT '{c}' AS \"column\", count_if({c} IS NOT NULL AND TRY_CAST({c} AS DOUBLE) IS NULL) AS not_numbers, "
    f"count_if({c} IS NOT NULL AND TRY_CAST({c} AS DOUBLE) IS NULL) = 0 AS numeric_only FROM te"
    for c in ("event_id", "user_id", "event_type", "value", "props")), te=_TEXT_EVENTS))
def agg_numeric_text(spark, d):
    return flag_numeric_text(text_events(spark, d))


_SENT = [c for c, k in DIRTY.items() if k == "numeric"]


@query("agg_sentinels", with_views("""
SELECT "column", sentinels, CASE WHEN sentinels > 0 THEN 2 ELSE 0 END AS points,
       (SELECT least(10, 2 * count_if(sentinels > 0)) FROM facts) AS total_penalty
FROM facts WHERE kind = 'numeric'""", dirty=tb.DIRTY_LINEITEM, facts=facts_sql("dirty", DIRTY)))
def agg_sentinels(spark, d):
    df = tb.dirty_lineitem(spark, d)
    cols = numeric_columns(df)
    counts = [F.count_if(F.col(c).isin(sentinels_for(c))).alias(c) for c in cols]
    row = df.agg(*counts)
    hits = F.lit(0)
    for c in cols:
        hits = hits + F.when(F.col(c) > 0, 1).otherwise(0)
    row = row.withColumn("_total", F.least(F.lit(10), 2 * hits).cast("bigint"))
    return melt_row(row, {c: {"sentinels": c, "total_penalty": "_total"} for c in cols}).withColumn(
        "points", F.when(F.col("sentinels") > 0, 2).otherwise(0))


@query("agg_negative_prices", with_views("""
SELECT 'price' AS "column", count_if(price < 0) AS negatives, round(count_if(price < 0) * 100.0::DOUBLE / count(*), 6) AS pct,
       CASE WHEN count_if(price < 0) > 0 THEN 5 ELSE 0 END AS penalty FROM dirty""", dirty=tb.DIRTY_LINEITEM))
def agg_negative_prices(spark, d):
    df = tb.dirty_lineitem(spark, d)
    n = F.count_if(F.col("price") < 0)
    return df.agg(F.lit("price").alias("column"), n.alias("negatives"),
                  F.round(n * 100 / F.count(F.lit(1)), 6).alias("pct"), F.when(n > 0, 5).otherwise(0).alias("penalty"))


_CODES = ("SELECT CASE WHEN p_partkey % 3 = 0 THEN lpad(p_partkey::VARCHAR, 8, '0') WHEN p_partkey % 3 = 1 "
          "THEN lpad(p_partkey::VARCHAR, 13, '0') ELSE 'X' || p_partkey::VARCHAR END AS sku_code FROM part")


@query("agg_gs1", with_views("""
SELECT count(sku_code) AS codes, count_if(regexp_full_match(trim(sku_code), '[0-9]+') AND length(trim(sku_code)) IN (8, 12, 13, 14)) AS compliant,
       round(count_if(regexp_full_match(trim(sku_code), '[0-9]+') AND length(trim(sku_code)) IN (8, 12, 13, 14)) * 100.0::DOUBLE / count(sku_code), 6) AS share
FROM codes""", codes=_CODES))
def agg_gs1(spark, d):
    key = F.col("p_partkey").cast("string")
    codes = tb.load(spark, d, "part").select(
        F.when(F.col("p_partkey") % 3 == 0, F.lpad(key, 8, "0")).when(F.col("p_partkey") % 3 == 1, F.lpad(key, 13, "0"))
        .otherwise(F.concat(F.lit("X"), key)).alias("sku_code"))
    return ql.code_compliance(codes).withColumn("share", rnd("share"))


@query("agg_skew", union(
    f"SELECT '{c}' AS \"column\", round(skewness({c}), 6) + 0.0 AS skew, stddev_samp({c}) = 0 AS zero_variance, "
    f"coalesce(abs(skewness({c})) > 2, false) AS high_skew FROM lineitem" for c in NUM))
def agg_skew(spark, d):
    df = tb.load(spark, d, "lineitem")
    row = df.agg(*[x for c in NUM for x in (sample_skewness(F.col(c).cast("double")).alias(f"k_{c}"),
                                            (F.stddev_samp(c) == 0).alias(f"z_{c}"))])
    out = melt_row(row, {c: {"skew": f"k_{c}", "zero_variance": f"z_{c}"} for c in NUM})
    return out.select("column", rnd("skew").alias("skew"), "zero_variance",
                      F.coalesce(F.abs("skew") > 2, F.lit(False)).alias("high_skew"))


@query("agg_target_balance", """
SELECT count(*) AS classes, max(n)::DOUBLE / min(n) AS ratio, max(n)::DOUBLE / min(n) > 20 AS severe,
       (SELECT count(*) - count(l_returnflag) FROM lineitem) AS target_missing
FROM (SELECT l_returnflag, count(*) AS n FROM lineitem WHERE l_returnflag IS NOT NULL GROUP BY 1)""")
def agg_target_balance(spark, d):
    counts = tb.load(spark, d, "lineitem").groupBy("l_returnflag").agg(F.count(F.lit(1)).alias("n"))
    seen = F.col("l_returnflag").isNotNull()
    most, least = F.max(F.when(seen, F.col("n"))), F.min(F.when(seen, F.col("n")))
    return counts.agg(F.count_if(seen).alias("classes"), (most / least).alias("ratio"), (most / least > 20).alias("severe"),
                      F.coalesce(F.sum(F.when(~seen, F.col("n"))), F.lit(0)).alias("target_missing"))


_LEAK_ORDER = "l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_shipdate"


@query("agg_leakage", with_views(union(
    f"SELECT '{c}' AS \"column\", round(abs(corr({c}, code)), 6) AS corr FROM coded" for c in NUM), coded=f"""
SELECT l.*, c.code FROM lineitem l JOIN (
  SELECT l_returnflag, row_number() OVER (ORDER BY first) - 1 AS code FROM (
    SELECT l_returnflag, min(row({_LEAK_ORDER})) AS first FROM lineitem GROUP BY 1)) c USING (l_returnflag)"""))
def agg_leakage(spark, d):
    df = tb.load(spark, d, "lineitem")
    out = pf.target_correlations(df, "l_returnflag", _LEAK_ORDER.split(", "))
    return out.withColumn("corr", rnd("corr"))


@query("agg_corr_matrix", union(
    f"SELECT '{a}' AS a, '{b}' AS b, round(corr({a}, {b}), 6) + 0.0 AS corr FROM lineitem"
    for i, a in enumerate(MEASURES) for b in MEASURES[i + 1:]))
def agg_corr_matrix(spark, d):
    return pf.correlations(tb.load(spark, d, "lineitem"), MEASURES).withColumn("corr", rnd("corr"))


@query("agg_order_corr", with_views(union(
    f"SELECT '{c}' AS \"column\", round(corr({c}, pos), 6) + 0.0 AS corr, abs(corr({c}, pos)) > 0.99 AS leak_hint FROM p"
    for c in ("event_id", "user_id", "value")), p="SELECT *, row_number() OVER (ORDER BY ts, event_id) AS pos FROM events"))
def agg_order_corr(spark, d):
    out = pf.order_correlation(tb.load(spark, d, "events"), ["event_id", "user_id", "value"], ["ts", "event_id"])
    return out.withColumn("corr", rnd("corr"))


_RISK = {"lineitem": LINEITEM, "orders": ORDERS, "customer": CUSTOMER}


def _risk_sql(t, cols):
    text = [c for c, k in cols.items() if k == "text"]
    date = 2 if "datetime" in cols.values() else 0
    wide = " + ".join([f"(count(DISTINCT {c}) > 100)::INT" for c in text] or ["0"])
    return f"SELECT '{t}' AS table_name, CASE WHEN p >= 4 THEN 'high' WHEN p >= 2 THEN 'medium' ELSE 'low' END AS risk FROM (SELECT {wide} + {date} AS p FROM {t})"


@query("agg_drift_risk", union(_risk_sql(t, c) for t, c in _RISK.items()))
def agg_drift_risk(spark, d):
    out = None
    for t in _RISK:
        df = tb.load(spark, d, t)
        text = [c for c, k in _RISK[t].items() if k == "text"]
        points = (2 if "datetime" in _RISK[t].values() else 0) + (2 if len(numeric_columns(df)) > 50 else 0)
        score = pf.distinct_counts(df, text).agg((F.count_if(F.col("distinct") > 100) + points).alias("p"))
        row = score.select(F.lit(t).alias("table_name"), F.when(F.col("p") >= 4, "high").when(F.col("p") >= 2, "medium")
                           .otherwise("low").alias("risk"))
        out = row if out is None else out.unionByName(row)
    return out


_STATS = """SELECT n_rows AS "rows", n_cols AS columns, n_numeric AS numeric_columns, n_text AS text_columns,
  round(missing_share, 6) AS missing_share, round(duplicate_share, 6) AS duplicate_share,
  round(quality_score, 6) AS quality_score, round(complexity_score, 6) AS complexity_score, round(outlier_share, 6) AS outlier_share,
  n_sentinel > 0 AS has_sentinels, n_negative > 0 AS has_negative_prices, n_wide AS high_cardinality, n_constant AS constant_columns
FROM s"""
_S = """SELECT *, 100 - least(30, missing_share * 100) - least(20, duplicate_share * 100) AS quality_score,
  (CASE WHEN n_cols > 50 THEN 0.3 ELSE 0 END + CASE WHEN missing_share > 0.3 THEN 0.3 ELSE 0 END
   + CASE WHEN n_sentinel > 0 THEN 0.2 ELSE 0 END + CASE WHEN n_negative > 0 THEN 0.2 ELSE 0 END)::DOUBLE AS complexity_score FROM t"""


@query("agg_local_stats", with_views(_STATS, **DIRTY_FACTS, s=_S))
def agg_local_stats(spark, d):
    stats = ql.local_stats(pf.Facts(tb.dirty_lineitem(spark, d)))
    return ql.one_row(spark, {k: round(v, 6) if isinstance(v, float) else v for k, v in stats.items()})


def _report(parts, score, state="'valid'", extra=None):
    views = dict(DIRTY_FACTS)
    views.update(extra or {})
    views["rows_"] = union(parts)
    return with_views(f"""SELECT "check", "column", severity, penalty::DOUBLE AS penalty FROM rows_
UNION ALL SELECT 'score', NULL, {state}, round(({score})::DOUBLE, 6) FROM t""", **views)


def _rule(check, severity, penalty, where, column='"column"', source="facts"):
    return f"SELECT '{check}' AS \"check\", {column} AS \"column\", {severity} AS severity, {penalty} AS penalty FROM {source} WHERE {where}"


_MISS, _OUT, _DIST = "missing::DOUBLE / n_rows", "outliers::DOUBLE / n_rows", "n_distinct::DOUBLE / n_rows"
_CONST_RULE = "n_distinct = 1"

_pre = [
    _rule("duplicate_rows", "'warning'", "round(least(20, duplicate_share * 100), 6)", "dups > 0", "NULL", "t"),
    _rule("missing", "'issue'", "5", f"{_MISS} > 0.5"),
    _rule("missing", "'warning'", "0", f"{_MISS} > 0.2 AND {_MISS} <= 0.5"),
    _rule("all_null", "'issue'", "0", "missing = n_rows"),
    _rule("constant", "'issue'", "2", _CONST_RULE),
    _rule("outliers", "'warning'", "0", f"kind = 'numeric' AND {_OUT} > 0.1"),
    _rule("high_cardinality", "'warning'", "0", "kind = 'text' AND n_distinct > 20"),
]
_pre_score = ("greatest(0, 100 - least(20, duplicate_share * 100) - 2 * n_constant "
              f"- 5 * (SELECT count_if({_MISS} > 0.5) FROM facts))")


@query("qly_preprocess_report", _report(
    _pre, _pre_score, f"CASE WHEN n_empty > 0 OR n_constant > 0 OR {_pre_score} < 50 THEN 'invalid' ELSE 'valid' END"))
def qly_preprocess_report(spark, d):
    return ql.preprocess_report(pf.Facts(tb.dirty_lineitem(spark, d))).table(spark)


_assess = [
    _rule("missing", "'critical'", "15", f"{_MISS} > 0.5"),
    _rule("missing", "'medium'", "5", f"{_MISS} > 0.35 AND {_MISS} <= 0.5"),
    _rule("outliers", "'high'", "5", f"kind = 'numeric' AND {_OUT} > 0.15"),
    _rule("outliers", "'medium'", "2", f"kind = 'numeric' AND {_OUT} > 0.05 AND {_OUT} <= 0.15"),
    _rule("high_cardinality", "'medium'", "3", f"kind = 'text' AND {_DIST} > 0.9"),
    _rule("duplicates", "'medium'", "CASE WHEN duplicate_share > 0.1 THEN 10 WHEN duplicate_share > 0.05 THEN 5 ELSE 2 END", "dups > 0", "NULL", "t"),
    _rule("sentinels", "'medium'", "2", "sentinels > 0"),
    _rule("negative_prices", "'high'", "5", "negatives > 0"),
    _rule("zero_variance", "'high'", "0", "std = 0"),
    _rule("high_skew", "'low'", "0", "abs(skew) > 2"),
]
_assess_score = ("greatest(0, 100 - (SELECT coalesce(sum(penalty), 0) FROM rows_ WHERE \"check\" NOT IN ('sentinels', 'negative_prices')) "
                 "- least(10, 2 * n_sentinel) - least(15, 5 * n_negative))")


@query("qly_assessment", _report(_assess, _assess_score, "CASE WHEN (SELECT count_if(kind = 'text' AND n_distinct > 100) FROM facts) + 2 >= 4 THEN 'high' ELSE 'medium' END"))
def qly_assessment(spark, d):
    return ql.assessment(pf.Facts(tb.dirty_lineitem(spark, d))).table(spark)


_mon = [
    _rule("missing_values", "'medium'", "10", "missing_cells > 0", "NULL", "t"),
    _rule("duplicate_rows", "'low'", "5", "dups > 0", "NULL", "t"),
    _rule("outliers", "'warning'", "0", f"kind = 'numeric' AND {_OUT} > 0.01"),
    _rule("constant_column", "'warning'", "0", _CONST_RULE),
    _rule("high_cardinality", "'warning'", "0", f"kind = 'text' AND {_DIST} > 0.5"),
]


@query("qly_monitor_score", _report(_mon, "100 - (SELECT coalesce(sum(penalty), 0) FROM rows_)"))
def qly_monitor_score(spark, d):
    return ql.monitor_report(pf.Facts(tb.dirty_lineitem(spark, d))).table(spark)


_prof = [
    _rule("missing", f"CASE WHEN {_MISS} > 0.5 THEN 'critical' ELSE 'warning' END", "0", f"{_MISS} > 0.35"),
    _rule("constant", "'issue'", "0", _CONST_RULE),
    _rule("outliers", f"CASE WHEN {_OUT} > 0.15 THEN 'critical' ELSE 'warning' END", "0", f"kind = 'numeric' AND {_OUT} > 0.05"),
    _rule("sentinels", "'issue'", "0", "sentinels > 0"),
    _rule("negative_prices", "'issue'", "0", "negatives > 0"),
    _rule("high_cardinality", "'issue'", "0", f"kind = 'text' AND {_DIST} > 0.9"),
]
_prof_score = """greatest(0, 100 - least(CASE WHEN missing_share > 0.5 THEN 40 WHEN missing_share > 0.35 THEN 30 ELSE 20 END, missing_share * 100)
 - least(20, duplicate_share * 100) - least(30, 5 * (SELECT count(*) FROM rows_ WHERE "check" <> 'outliers'))
 - least(20, 3 * (SELECT count(*) FROM rows_ WHERE "check" = 'outliers')) - least(10, 2 * n_sentinel))"""


@query("qly_profiler_score", _report(_prof, _prof_score))
def qly_profiler_score(spark, d):
    return ql.profiler_report(pf.Facts(tb.dirty_lineitem(spark, d))).table(spark)


@query("qly_simple_scores", with_views("""
SELECT greatest(0, 100 - CASE WHEN missing_share > 0.3 THEN 20 WHEN missing_share > 0.1 THEN 10 ELSE 0 END
         - CASE WHEN dups > 0 THEN 10 ELSE 0 END - 5 * n_constant
         - 5 * (SELECT count_if(kind = 'text' AND n_distinct::DOUBLE / n_rows > 0.5) FROM facts))::DOUBLE AS dashboard,
       round(greatest(0, 100 - least(30, worst_missing * 100) - duplicate_share * 20 - outlier_share * 10), 6) AS worst_column
FROM t""", **DIRTY_FACTS))
def qly_simple_scores(spark, d):
    scores = ql.simple_scores(pf.Facts(tb.dirty_lineitem(spark, d)))
    return ql.one_row(spark, {k: round(v, 6) for k, v in scores.items()})


@query("qly_trend", with_views("""
SELECT count(*) AS checks, round(avg(score), 6) AS avg_score, round(min(score), 6) AS min_score, round(max(score), 6) AS max_score,
       count_if(errors > 0) AS error_issues, count_if(high > 0) AS high_value_issues
FROM (SELECT *, row_number() OVER (ORDER BY day DESC) AS rn FROM daily) WHERE rn <= 10""", daily="""
SELECT date_trunc('day', ts) AS day, count_if(event_type = 'error') AS errors, count_if(value > 100) AS high,
       100 - count_if(event_type = 'error') * 50.0::DOUBLE / count(*) - count_if(value > 100) * 50.0::DOUBLE / count(*) AS score
FROM events GROUP BY 1"""))
def qly_trend(spark, d):
    from tablecare.operators.health import quality_trend

    n = F.count(F.lit(1))
    errors, high = F.count_if(F.col("event_type") == "error"), F.count_if(F.col("value") > 100)
    checks = tb.load(spark, d, "events").groupBy(F.date_trunc("day", "ts").alias("at")).agg(
        (100 - errors * 50.0 / n - high * 50.0 / n).alias("score"),
        F.array_compact(F.array(F.when(errors > 0, F.lit("errors")), F.when(high > 0, F.lit("high_value")))).alias("issues"))
    t = quality_trend(checks, 10)
    return t.select("checks", rnd("avg_score").alias("avg_score"), rnd("min_score").alias("min_score"),
                    rnd("max_score").alias("max_score"),
                    F.coalesce(F.col("issues")["errors"], F.lit(0)).alias("error_issues"),
                    F.coalesce(F.col("issues")["high_value"], F.lit(0)).alias("high_value_issues"))


_rec_missing = f"(SELECT sum(CASE WHEN {_MISS} > 0.5 THEN 15 WHEN {_MISS} > 0.35 THEN 5 ELSE 0 END) FROM facts)"
_rec_out = f"(SELECT sum(CASE WHEN {_OUT} > 0.15 THEN 5 WHEN {_OUT} > 0.05 THEN 2 ELSE 0 END) FROM facts WHERE kind = 'numeric')"


@query("qly_recommend", with_views(f"""
SELECT 'high' AS priority, 'sentinel_handling' AS category, "column", 'null_and_group_median' AS action FROM facts WHERE sentinels > 0
UNION ALL SELECT 'high', 'price_correction', "column", 'group_median' FROM facts WHERE negatives > 0
UNION ALL SELECT 'medium', 'imputation_strategy', NULL, 'group_median'
UNION ALL SELECT 'high', 'missing_data', NULL, 'impute' FROM t WHERE {_rec_missing} > 10
UNION ALL SELECT 'medium', 'outliers', NULL, 'clip' FROM t WHERE {_rec_out} > 5
UNION ALL SELECT 'low', 'best_practices', NULL, 'review'
UNION ALL SELECT 'high', 'suggest:handle_sentinels', "column", NULL FROM facts WHERE sentinels > 0
UNION ALL SELECT 'high', 'suggest:fix_negative_prices', "column", NULL FROM facts WHERE negatives > 0
UNION ALL SELECT 'high', 'suggest:remove_column', "column", NULL FROM facts WHERE {_MISS} > 0.5
UNION ALL SELECT 'medium', 'suggest:fill_missing', "column", CASE WHEN kind = 'numeric' THEN 'median' ELSE 'mode' END FROM facts WHERE {_MISS} > 0 AND {_MISS} <= 0.5
UNION ALL SELECT 'low', 'suggest:handle_outliers', "column", 'clip' FROM facts WHERE kind = 'numeric' AND {_OUT} > 0.05
UNION ALL SELECT 'medium', 'suggest:encode', "column", 'target_encoding' FROM facts WHERE kind = 'text' AND n_distinct > 100
""", **DIRTY_FACTS))
def qly_recommend(spark, d):
    f = pf.Facts(tb.dirty_lineitem(spark, d))
    rows = ql.recommendations(f) + [(p, f"suggest:{a}", c, m) for p, a, c, m in ql.suggestions(f)]
    return spark.createDataFrame(rows, "priority string, category string, column string, action string")


@query("qly_mode_decision", with_views("""
SELECT round(score, 6) AS heavy_score, score > 0.5 AS use_heavy,
  CASE WHEN quality_score > 93 AND n_negative = 0 AND missing_share < 0.35 THEN 'local' WHEN missing_share > 0.35 THEN 'interactive'
       WHEN missing_share > 0.15 OR n_rows > 100000 THEN 'hybrid' ELSE 'automated' END AS mode,
  CASE WHEN quality_score > 93 AND n_negative = 0 AND missing_share < 0.35 THEN 'low' WHEN missing_share > 0.35 THEN 'high'
       WHEN missing_share > 0.15 OR n_rows > 100000 THEN 'medium' ELSE 'low' END AS risk
FROM (SELECT *, (CASE WHEN missing_share > 0.35 THEN 0.3 ELSE 0 END + CASE WHEN quality_score < 70 THEN 0.3 ELSE 0 END
  + CASE WHEN complexity_score > 0.8 THEN 0.2 ELSE 0 END + CASE WHEN n_sentinel > 0 THEN 0.1 ELSE 0 END
  + CASE WHEN n_negative > 0 THEN 0.2 ELSE 0 END)::DOUBLE AS score FROM s)""", **DIRTY_FACTS, s=_S))
def qly_mode_decision(spark, d):
    stats = ql.local_stats(pf.Facts(tb.dirty_lineitem(spark, d)))
    return ql.one_row(spark, ql.mode_decision(stats, "retail"))


@query("agg_feature_types", """
SELECT 'doc_id' AS "column", 'numeric' AS feature_type UNION ALL
SELECT 'text', 'text' UNION ALL
SELECT 'lang', CASE WHEN avg(length(lang)) > 50 THEN 'text' WHEN count(DISTINCT lang) = 2 THEN 'binary' WHEN count(DISTINCT lang) < 20 THEN 'categorical' ELSE 'text' END FROM documents UNION ALL
SELECT 'source', CASE WHEN avg(length(source)) > 50 THEN 'text' WHEN count(DISTINCT source) = 2 THEN 'binary' WHEN count(DISTINCT source) < 20 THEN 'categorical' ELSE 'text' END FROM documents UNION ALL
SELECT 'n_chars', CASE WHEN count(DISTINCT n_chars) = 2 THEN 'binary' WHEN count(DISTINCT n_chars) < 10 THEN 'categorical' ELSE 'numeric' END FROM documents""")
def agg_feature_types(spark, d):
    types = ql.feature_types(pf.Facts(tb.load(spark, d, "documents"), duplicates=False))
    return spark.createDataFrame(list(types.items()), "column string, feature_type string")


def _task_sql(c):
    return f"""SELECT '{c}' AS target, CASE WHEN count(TRY_CAST({c} AS DOUBLE)) = 0 OR count(DISTINCT {c}) = 2
  OR (count(DISTINCT {c}) < 20 AND count(DISTINCT {c}) < count(*) * 0.05) THEN 'classification'
  WHEN count_if(TRY_CAST({c} AS DOUBLE) <> floor(TRY_CAST({c} AS DOUBLE))) = 0 AND (count(DISTINCT {c}) < 20 OR count(DISTINCT {c}) < sqrt(count(*)))
  THEN 'classification' ELSE 'regression' END AS task FROM lineitem"""


_TASKS = ["l_returnflag", "l_linenumber", "l_quantity", "l_extendedprice", "l_discount"]


@query("agg_detect_task", union(_task_sql(c) for c in _TASKS))
def agg_detect_task(spark, d):
    df = tb.load(spark, d, "lineitem")
    return spark.createDataFrame([(c, ql.detect_task(df, c)) for c in _TASKS], "target string, task string")


@query("agg_target_analysis", """
SELECT 'o_orderstatus' AS target, 'classification' AS target_type, o_orderstatus AS value, count(*)::DOUBLE AS n FROM orders GROUP BY o_orderstatus
UNION ALL SELECT 'o_totalprice', 'regression', 'mean', round(avg(o_totalprice), 4) FROM orders
UNION ALL SELECT 'o_totalprice', 'regression', 'std', round(stddev_samp(o_totalprice), 4) FROM orders
UNION ALL SELECT 'o_totalprice', 'regression', 'skew', round(skewness(o_totalprice), 6) + 0.0 FROM orders""")
def agg_target_analysis(spark, d):
    df = tb.load(spark, d, "orders")
    out = pf.target_analysis(df, "o_orderstatus").unionByName(pf.target_analysis(df, "o_totalprice"))
    return out.withColumn("n", F.when(F.col("value").isin("mean", "std"), rnd("n", 4)).otherwise(rnd("n")))


@query("agg_time_regularity", with_views("""
SELECT user_id, count(gap) AS gaps, round(stddev_samp(gap) / avg(gap), 6) AS spread, coalesce(stddev_samp(gap) / avg(gap) < 0.1, false) AS regular
FROM g GROUP BY user_id""", g="""SELECT user_id, (epoch_us(ts) - epoch_us(lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id))) / 1e6::DOUBLE AS gap FROM events"""))
def agg_time_regularity(spark, d):
    out = pf.time_regularity(tb.load(spark, d, "events"), ["user_id"], "ts", ["event_id"])
    return out.withColumn("spread", rnd("spread"))


_CLEANED = f"""
SELECT l_orderkey, l_linenumber, l_partkey, category, coalesce(discount, median(discount) OVER (PARTITION BY category)) AS discount,
  coalesce(tax, median(tax) OVER (PARTITION BY category)) AS tax, coalesce(stock, median(stock) OVER (PARTITION BY category)) AS stock_qty,
  price, constant_col, l_shipdate
FROM (SELECT DISTINCT * EXCLUDE (stock_qty), CASE WHEN stock_qty IN (-999, -1, 9999) THEN NULL ELSE stock_qty END AS stock FROM dirty)"""


@query("qly_before_after", with_views("""
SELECT b.n_rows - a.n_rows AS rows_removed, 2::BIGINT AS columns_removed, b.missing_cells::BIGINT AS missing_before, a.missing::BIGINT AS missing_after,
  round((b.missing_cells - a.missing) * 100.0::DOUBLE / greatest(b.missing_cells, 1), 6) AS missing_reduction_pct,
  round(least(100, 70 + (b.missing_cells - a.missing) * 100.0::DOUBLE / greatest(b.missing_cells, 1) * 0.3), 6) AS quality_score, true AS passed
FROM (SELECT n_rows, missing_cells FROM t) b, (SELECT count(*) AS n_rows, 0 AS missing FROM c) a""",
    **DIRTY_FACTS, c=_CLEANED))
def qly_before_after(spark, d):
    dirty = tb.dirty_lineitem(spark, d)
    before = pf.Facts(dirty)
    cleaned, _ = auto_clean(dirty, sector="retail", protect=("l_orderkey", "l_linenumber", "l_partkey"), before=before)
    out = ql.one_row(spark, ql.before_after(before, pf.Facts(cleaned, duplicates=False)))
    return out.select("rows_removed", "columns_removed", "missing_before", "missing_after", "missing_reduction_pct",
                      "quality_score", "passed")


@query("qly_sector_check", with_views("""
SELECT 'expected_columns' AS "check", 'sku,quantity' AS "column", 'warning' AS severity, 0.0::DOUBLE AS penalty
UNION ALL SELECT 'negative_prices', "column", 'high', 0.0 FROM facts WHERE negatives > 0
UNION ALL SELECT 'sentinels', "column", 'warning', 0.0 FROM facts WHERE sentinels > 0
UNION ALL SELECT 'score', NULL, CASE WHEN n_negative > 0 THEN 'invalid' ELSE 'valid' END,
  greatest(20, 70 - least(50, (n_negative + 0.5 * (1 + n_sentinel)) * 5))::DOUBLE FROM t""", **DIRTY_FACTS))
def qly_sector_check(spark, d):
    return ql.sector_report(pf.Facts(tb.dirty_lineitem(spark, d), duplicates=False), "retail").table(spark)


@query("agg_group_dict", """
SELECT l_returnflag, l_linestatus, sum(l_quantity) AS l_quantity_sum, round(avg(l_extendedprice), 4) AS l_extendedprice_mean,
       max(l_tax) AS l_tax_max, count(DISTINCT l_partkey) AS l_partkey_nunique FROM lineitem GROUP BY 1, 2""")
def agg_group_dict(spark, d):
    from tablecare.operators.project import aggregate

    out = aggregate(tb.load(spark, d, "lineitem"), ["l_returnflag", "l_linestatus"], {
        "l_quantity": "sum", "l_extendedprice": "mean", "l_tax": "max", "l_partkey": "nunique"})
    return out.withColumn("l_extendedprice_mean", rnd("l_extendedprice_mean", 4))


@query("agg_job_metrics", with_views("""
SELECT 'prediction' AS part, NULL AS value, 'total' AS metric, count(*)::DOUBLE AS amount FROM s
UNION ALL SELECT 'prediction', pred_a::VARCHAR, 'count', count(*)::DOUBLE FROM s GROUP BY pred_a
UNION ALL SELECT 'prediction', NULL, 'mean', round(avg(pred_a), 6) FROM s
UNION ALL SELECT 'prediction', NULL, 'std', round(stddev_samp(pred_a), 6) FROM s
UNION ALL SELECT 'prediction', NULL, 'min', min(pred_a)::DOUBLE FROM s
UNION ALL SELECT 'prediction', NULL, 'max', max(pred_a)::DOUBLE FROM s
UNION ALL SELECT 'prediction', NULL, 'median', median(pred_a)::DOUBLE FROM s
UNION ALL SELECT 'proba_1', NULL, 'mean', round(avg(proba), 6) FROM s
UNION ALL SELECT 'proba_1', NULL, 'std', round(stddev_samp(proba), 6) FROM s
UNION ALL SELECT 'proba_1', NULL, 'min', round(min(proba), 6) FROM s
UNION ALL SELECT 'proba_1', NULL, 'max', round(max(proba), 6) FROM s
UNION ALL SELECT 'job', NULL, 'error_rate', round(count_if(proba > 0.98)::DOUBLE / count(*), 6) FROM s""", s=tb.SCORED_LINEITEM))
def agg_job_metrics(spark, d):
    from tablecare.operators.health import job_metrics

    scored = tb.scored_lineitem(spark, d).select(
        F.col("pred_a").alias("prediction"), F.col("proba").alias("proba_1"),
        F.when(F.col("proba") > 0.98, F.lit("out of range")).alias("prediction_error"))
    return job_metrics(scored).withColumn("amount", rnd("amount"))


@query("agg_fingerprint")
def agg_fingerprint(spark, d):
    """Fingerprints depend on Spark's own hash, so SQL elsewhere cannot repeat them."""
    from tablecare.sources.datasets import fingerprint

    df = tb.load(spark, d, "orders")
    print_ = fingerprint(df)
    described = pf.profile(df).select(F.sha2(F.to_json(F.struct("*")), 256).alias("h"))
    shape = described.agg(F.sha2(F.concat_ws(",", F.sort_array(F.collect_list("h"))), 256).alias("profile_hash"))
    return shape.withColumns({"rows": F.lit(print_["rows"]), "content_hash": F.lit(print_["content"])})


@query("agg_histogram", with_views("""
SELECT b.bin::INT AS bin, round(lo + b.bin * (hi - lo) / 30, 4) AS low, round(lo + (b.bin + 1) * (hi - lo) / 30, 4) AS high, coalesce(n, 0) AS n
FROM range(30) b(bin) CROSS JOIN m LEFT JOIN (SELECT least(floor((l_extendedprice - lo) / ((hi - lo) / 30)), 29) AS bin, count(*) AS n FROM lineitem, m GROUP BY 1) x ON x.bin = b.bin""",
    m="SELECT min(l_extendedprice) AS lo, max(l_extendedprice) AS hi FROM lineitem"))
def agg_histogram(spark, d):
    out = pf.histogram(tb.load(spark, d, "lineitem"), "l_extendedprice")
    return out.withColumns({"low": rnd("low", 4), "high": rnd("high", 4)})


@query("agg_imbalance", """
SELECT count(*) AS classes, max(n)::DOUBLE / min(n) AS ratio,
       CASE WHEN max(n)::DOUBLE / min(n) < 3 THEN 'none' WHEN max(n)::DOUBLE / min(n) < 10 THEN 'smote' ELSE 'smoteenn' END AS method
FROM (SELECT toxic, count(*) AS n FROM labels GROUP BY 1)""")
def agg_imbalance(spark, d):
    return pf.imbalance(tb.load(spark, d, "labels"), "toxic")


@query("qly_prep_choice", with_views(f"""
SELECT CASE WHEN missing_share = 0 THEN 'none' WHEN missing_share < 0.05 THEN 'median_mode' WHEN missing_share < 0.2 THEN 'iterative' ELSE 'drop_and_forest' END AS impute,
  'iqr_clip' AS outliers, CASE WHEN (SELECT count_if(kind = 'numeric' AND {_OUT} > 0.05) FROM facts) > 0 THEN 'robust' ELSE 'standard' END AS scaling,
  (SELECT count_if(kind <> 'numeric' AND n_distinct <= 20) FROM facts) AS onehot_columns,
  (SELECT count_if(kind <> 'numeric' AND n_distinct > 20) FROM facts) AS target_encoded_columns,
  'target_encoding' AS wide_encoding, 'none' AS selection FROM t""", **DIRTY_FACTS))
def qly_prep_choice(spark, d):
    return ql.one_row(spark, ql.preparation_choice(pf.Facts(tb.dirty_lineitem(spark, d))))
