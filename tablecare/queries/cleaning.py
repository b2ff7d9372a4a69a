"""Projection, cleaning and plan queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from tablecare import tables as tb
from tablecare.functions.columns import SENTINELS, clip, rnd
from tablecare.operators import clean as cl
from tablecare.operators import profile as pf
from tablecare.operators import project as pj
from tablecare.operators import quality as ql
from tablecare.plans.auto_clean import auto_clean, clean_from_recommendations
from tablecare.plans.cleaning_plan import Step, replay
from tablecare.queries.quality import _TEXT_EVENTS, text_events, union
from tablecare.queries.registry import query, with_views
from tablecare.queries.sqlfacts import CUSTOMER, facts_sql

DIRTY = dict(dirty=tb.DIRTY_LINEITEM)


@query("prj_entity_features", "SELECT c_custkey, c_acctbal, c_mktsegment FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders)")
def prj_entity_features(spark, d):
    ids = tb.load(spark, d, "orders").select(F.col("o_custkey").alias("c_custkey"))
    return pj.entity_features(tb.load(spark, d, "customer"), "c_custkey", ["c_acctbal", "c_mktsegment"], ids)


@query("prj_drop_sparse_cols", with_views("SELECT * EXCLUDE (sparse_tax, empty_col) FROM dirty", **DIRTY))
def prj_drop_sparse_cols(spark, d):
    return pj.drop_sparse(tb.dirty_lineitem(spark, d))


@query("prj_rename_drop", "SELECT o_orderkey, o_custkey AS customer_id, o_totalprice, o_orderdate, o_orderpriority FROM orders")
def prj_rename_drop(spark, d):
    out, _ = replay(tb.load(spark, d, "orders"), [
        Step("rename_column", "o_custkey", {"new_name": "customer_id"}), Step("remove_column", "o_orderstatus")])
    return out


@query("prj_convert_dtype", """
SELECT event_id, TRY_CAST(k AS DOUBLE) AS k_float, coalesce(TRY_CAST(bad AS DOUBLE), 0)::BIGINT AS k_int, value::VARCHAR IS NOT NULL AS has_text,
       TRY_CAST(day AS TIMESTAMP) AS day_time
FROM (SELECT *, CASE WHEN event_id % 5 = 0 THEN 'x' || k ELSE k END AS bad, CASE WHEN event_id % 7 = 0 THEN 'no date' ELSE strftime(ts, '%Y-%m-%d') END AS day
      FROM (SELECT *, props->>'$.k' AS k FROM events))""")
def prj_convert_dtype(spark, d):
    k = F.get_json_object("props", "$.k")
    ev = tb.load(spark, d, "events").withColumn("k", k)
    bad = F.when(F.col("event_id") % 5 == 0, F.concat(F.lit("x"), F.col("k"))).otherwise(F.col("k"))
    day = F.when(F.col("event_id") % 7 == 0, "no date").otherwise(F.date_format("ts", "yyyy-MM-dd"))
    return ev.select("event_id", pj.convert(F.col("k"), "float").alias("k_float"), pj.convert(bad, "int").alias("k_int"),
                     pj.convert(F.col("value"), "str").isNotNull().alias("has_text"),
                     pj.convert(day, "datetime").cast("timestamp_ntz").alias("day_time"))


@query("prj_clip_bounds", """
SELECT l_orderkey, l_linenumber, CASE WHEN l_quantity < 5 THEN 5 WHEN l_quantity > 40 THEN 40 ELSE l_quantity END AS l_quantity FROM lineitem""")
def prj_clip_bounds(spark, d):
    li = tb.load(spark, d, "lineitem")
    return li.select("l_orderkey", "l_linenumber", clip(F.col("l_quantity"), 5.0, 40.0).alias("l_quantity"))


@query("prj_currency", "SELECT p_partkey, round(p_retailprice * 1.1, 4) AS price FROM part")
def prj_currency(spark, d):
    text = F.concat(F.lit("$"), F.format_number("p_retailprice", 2))
    return tb.load(spark, d, "part").select("p_partkey", rnd(pj.currency(text, 1.1), 4).alias("price"))


@query("prj_date_format", "SELECT o_orderkey, strftime(o_orderdate, '%d/%m/%Y') AS day, strftime(o_orderdate, '%Y-%m') AS month FROM orders")
def prj_date_format(spark, d):
    return tb.load(spark, d, "orders").select(
        "o_orderkey", pj.date_text(F.col("o_orderdate"), "%d/%m/%Y").alias("day"), pj.date_text(F.col("o_orderdate"), "%Y-%m").alias("month"))


PLAN = [
    Step("handle_sentinels", "stock_qty"),
    Step("fix_negative_prices", "price", {"by": "category"}),
    Step("fill_missing", "stock_qty", {"method": "median"}),
    Step("fill_missing", "discount", {"method": "median"}),
    Step("fill_missing", "tax", {"method": "mean"}),
    Step("remove_column", "empty_col"),
    Step("remove_column", "no_such_column"),
    Step("handle_outliers", "price", {"method": "clip"}),
    Step("normalize", "stock_qty", {"method": "minmax"}),
    Step("clip_values", "discount", {"min": 0.02, "max": 0.08}),
    Step("rename_column", "constant_col", {"new_name": "flag"}),
]

_PRICE = "CASE WHEN price < 0 THEN median(CASE WHEN price > 0 THEN price END) OVER (PARTITION BY category) ELSE price END"


@query("pln_replay", with_views("""
SELECT l_orderkey, l_linenumber, l_partkey, category, l_shipdate, flag, sparse_tax,
  CASE WHEN d < 0.02 THEN 0.02 WHEN d > 0.08 THEN 0.08 ELSE d END AS discount,
  round(t, 6) AS tax, round((s - (SELECT min(s) FROM b)) / ((SELECT max(s) FROM b) - (SELECT min(s) FROM b)), 6) AS stock_qty,
  round(CASE WHEN p < q1 THEN q1 WHEN p > q2 THEN q2 ELSE p END, 4) AS price
FROM b, (SELECT quantile_cont(p, 0.01) AS q1, quantile_cont(p, 0.99) AS q2 FROM b) q""", **DIRTY, a=f"""
SELECT * EXCLUDE (stock_qty, price), CASE WHEN stock_qty IN (-999, -1, 9999) THEN NULL ELSE stock_qty END AS s0, {_PRICE} AS p FROM dirty""", b="""
SELECT *, constant_col AS flag, coalesce(s0, (SELECT median(s0) FROM a)) AS s, coalesce(discount, (SELECT median(discount) FROM a)) AS d,
  coalesce(tax, (SELECT avg(tax) FROM a)) AS t FROM a"""))
def pln_replay(spark, d):
    out, _ = replay(tb.dirty_lineitem(spark, d), PLAN)
    return out.withColumns({"tax": rnd("tax"), "stock_qty": rnd("stock_qty"), "price": rnd("price", 4)})


@query("prj_confidence_filter", with_views("""
SELECT l_orderkey, l_linenumber, round(greatest(proba, 1 - proba), 6) AS confidence_score FROM s WHERE greatest(proba, 1 - proba) >= 0.8""", s=tb.SCORED_LINEITEM))
def prj_confidence_filter(spark, d):
    scored = tb.scored_lineitem(spark, d).withColumn("proba_0", 1 - F.col("proba"))
    return pj.confident(scored, ["proba", "proba_0"], 0.8).select("l_orderkey", "l_linenumber", rnd("confidence_score").alias("confidence_score"))


@query("prj_event_search", """
SELECT event_id, user_id, event_type, value FROM events WHERE event_type = 'purchase' AND ts >= TIMESTAMP '2024-01-05' AND ts <= TIMESTAMP '2024-01-25'
ORDER BY ts DESC, event_id DESC LIMIT 50 OFFSET 20""")
def prj_event_search(spark, d):
    found = pj.event_search(tb.load(spark, d, "events"), {"event_type": "purchase", "user_id": None}, start="2024-01-05 00:00:00",
                            end="2024-01-25 00:00:00", limit=50, offset=20, ties=("event_id",))
    return found.select("event_id", "user_id", "event_type", "value")


@query("prj_infer_numeric", with_views("SELECT event_id::DOUBLE AS event_id, user_id::DOUBLE AS user_id, event_type, value::DOUBLE AS value, props FROM te", te=_TEXT_EVENTS))
def prj_infer_numeric(spark, d):
    return pj.infer_numeric(text_events(spark, d))


@query("prj_flatten_json", "SELECT event_id, (props->>'$.k')::BIGINT AS props_k, NULL::VARCHAR AS props_text FROM events")
def prj_flatten_json(spark, d):
    ev = tb.load(spark, d, "events").select("event_id", "props")
    return pj.flatten_json(ev, "props", "k bigint")


@query("prj_json_path", """
SELECT event_id, (props->>'$.k')::DOUBLE AS k, value / CASE WHEN (props->>'$.k')::DOUBLE = 0 THEN 1 ELSE (props->>'$.k')::DOUBLE END AS cost_per_unit,
  (props->>'$.k')::DOUBLE / CASE WHEN value = 0 THEN 1 ELSE value END AS efficiency FROM events""")
def prj_json_path(spark, d):
    k = F.get_json_object("props", "$.k").cast("double")
    ev = tb.load(spark, d, "events").withColumn("k", k)
    guard = lambda c: F.when(c == 0, 1.0).otherwise(c)
    return ev.select("event_id", "k", (F.col("value") / guard(F.col("k"))).alias("cost_per_unit"),
                     (F.col("k") / guard(F.col("value"))).alias("efficiency"))


@query("prj_numeric_vector", """
SELECT vec_id, len(embedding) + 2 AS n, round(vec_id + label + list_sum(embedding::DOUBLE[]), 6) AS total FROM embeddings""")
def prj_numeric_vector(spark, d):
    out = pj.numeric_vector(tb.load(spark, d, "embeddings"), ["vec_id", "label"], ["embedding"])
    return out.select("vec_id", F.size("vector").cast("bigint").alias("n"),
                      rnd(F.aggregate("vector", F.lit(0.0), lambda a, x: a + x)).alias("total"))


@query("prj_validate_input", """
SELECT 'p_name' AS "column", 'extra' AS warning, NULL AS detail UNION ALL SELECT 'p_type', 'extra', NULL
UNION ALL SELECT 'p_size', 'dtype', 'int instead of double'""")
def prj_validate_input(spark, d):
    return pj.validate_input(tb.load(spark, d, "part"), ["p_partkey", "p_brand", "p_size", "p_retailprice"],
                             {"p_size": "double", "p_retailprice": "double"})


@query("prj_schema_check", with_views("""
SELECT 'schema_mismatch' AS "check", 'c_name' AS "column", 'high' AS severity, 15.0::DOUBLE AS penalty UNION ALL SELECT 'missing_column', 'c_age', 'high', 20
UNION ALL SELECT 'outliers', "column", 'warning', 0 FROM facts WHERE kind = 'numeric' AND outliers::DOUBLE / n_rows > 0.01
UNION ALL SELECT 'constant_column', "column", 'warning', 0 FROM facts WHERE n_distinct = 1
UNION ALL SELECT 'high_cardinality', "column", 'warning', 0 FROM facts WHERE kind = 'text' AND n_distinct::DOUBLE / n_rows > 0.5
UNION ALL SELECT 'score', NULL, 'valid', 65 - CASE WHEN sum(missing) > 0 THEN 10 ELSE 0 END FROM facts""", facts=facts_sql("customer", CUSTOMER)))
def prj_schema_check(spark, d):
    """The expected schema beside the other checks of the production score."""
    df = tb.load(spark, d, "customer")
    issues = pj.schema_issues(df, {"c_custkey": "double", "c_name": "double", "c_nationkey": "bigint", "c_acctbal": "double", "c_age": "int"})
    return ql.monitor_report(pf.Facts(df), issues).table(spark)


@query("prj_missing_pattern", with_views("""
SELECT concat_ws(',', CASE WHEN discount IS NULL THEN 'discount' END, CASE WHEN tax IS NULL THEN 'tax' END, CASE WHEN sparse_tax IS NULL THEN 'sparse_tax' END) AS missing_columns, count(*) AS n
FROM dirty GROUP BY 1""", **DIRTY))
def prj_missing_pattern(spark, d):
    return pj.missing_patterns(tb.dirty_lineitem(spark, d), ["discount", "tax", "sparse_tax"])


_KINDS = {"l_orderkey": 1, "l_partkey": 1, "l_suppkey": 1, "l_linenumber": 1, "l_quantity": 1, "l_extendedprice": 1, "l_discount": 1,
          "l_tax": 1, "l_returnflag": 0, "l_linestatus": 0, "l_shipdate": 2}


@query("prj_column_kinds", union(
    f"SELECT '{c}' AS \"column\", " + {
        1: f"CASE WHEN count(DISTINCT {c}) = 2 THEN 'binary' WHEN count(DISTINCT {c}) < 10 THEN 'categorical_numeric' ELSE 'continuous' END",
        0: "max('categorical')", 2: "max('datetime')"}[k] + " AS kind FROM lineitem" for c, k in _KINDS.items()))
def prj_column_kinds(spark, d):
    kinds = ql.column_types(pf.Facts(tb.load(spark, d, "lineitem"), duplicates=False))
    return spark.createDataFrame(list(kinds.items()), "column string, kind string")


@query("cln_sentinels", with_views("SELECT l_orderkey, l_linenumber, CASE WHEN stock_qty IN (-999, -1, 9999) THEN NULL ELSE stock_qty END AS stock_qty FROM dirty", **DIRTY))
def cln_sentinels(spark, d):
    return cl.null_sentinels(tb.dirty_lineitem(spark, d), ["stock_qty"]).select("l_orderkey", "l_linenumber", "stock_qty")


@query("cln_negative_prices", with_views(f"SELECT l_orderkey, l_linenumber, category, round({_PRICE}, 4) AS price FROM dirty", **DIRTY))
def cln_negative_prices(spark, d):
    out = cl.fix_negative_prices(tb.dirty_lineitem(spark, d))
    return out.select("l_orderkey", "l_linenumber", "category", rnd("price", 4).alias("price"))


@query("cln_fill", with_views("""
SELECT l_orderkey, l_linenumber, coalesce(discount, (SELECT median(discount) FROM dirty)) AS discount,
  round(coalesce(tax, (SELECT avg(tax) FROM dirty)), 6) AS tax,
  coalesce(sparse_tax, (SELECT sparse_tax FROM dirty WHERE sparse_tax IS NOT NULL GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 1)) AS sparse_tax,
  coalesce(empty_col, 7.0) AS empty_col FROM dirty""", **DIRTY))
def cln_fill(spark, d):
    df = tb.dirty_lineitem(spark, d)
    out = cl.fill(cl.fill(cl.fill(cl.fill(df, ["discount"], "median"), ["tax"], "mean"), ["sparse_tax"], "mode"), ["empty_col"], "constant", 7.0)
    return out.select("l_orderkey", "l_linenumber", "discount", rnd("tax").alias("tax"), "sparse_tax", "empty_col")


@query("cln_fill_by_group", with_views("""
SELECT l_orderkey, l_linenumber, category, coalesce(discount, median(discount) OVER (PARTITION BY category)) AS discount,
  coalesce(tax, median(tax) OVER (PARTITION BY category)) AS tax FROM dirty""", **DIRTY))
def cln_fill_by_group(spark, d):
    out = cl.fill_by_group(tb.dirty_lineitem(spark, d), ["discount", "tax"], "category")
    return out.select("l_orderkey", "l_linenumber", "category", "discount", "tax")


_GAPS = "SELECT event_id, user_id, ts, CASE WHEN event_id % 3 = 0 THEN NULL ELSE value END AS value FROM events"


@query("cln_ffill_bfill", with_views("""
SELECT event_id, user_id,
  last_value(value IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS ffill,
  first_value(value IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS bfill FROM g""", g=_GAPS))
def cln_ffill_bfill(spark, d):
    ev = tb.load(spark, d, "events").select("event_id", "user_id", "ts", F.when(F.col("event_id") % 3 != 0, F.col("value")).alias("value"))
    out = cl.forward_fill(ev, "value", ["user_id"], ["ts", "event_id"], "ffill")
    out = cl.backward_fill(out, "value", ["user_id"], ["ts", "event_id"], "bfill")
    return out.select("event_id", "user_id", "ffill", "bfill")


def _q(c, p):
    return f"(SELECT quantile_cont({c}, {p}) FROM lineitem)"


@query("cln_clip_quantiles", f"""
SELECT l_orderkey, l_linenumber, round(CASE WHEN l_extendedprice < a THEN a WHEN l_extendedprice > b THEN b ELSE l_extendedprice END, 4) AS clipped,
  CASE WHEN l_quantity < c THEN c WHEN l_quantity > e THEN e ELSE l_quantity END AS winsorized
FROM lineitem, (SELECT quantile_cont(l_extendedprice, 0.01) AS a, quantile_cont(l_extendedprice, 0.99) AS b,
                       quantile_cont(l_quantity, 0.05) AS c, quantile_cont(l_quantity, 0.95) AS e FROM lineitem) q""")
def cln_clip_quantiles(spark, d):
    li = tb.load(spark, d, "lineitem").select("l_orderkey", "l_linenumber", F.col("l_extendedprice").alias("clipped"), F.col("l_quantity").alias("winsorized"))
    out = cl.clip_quantiles(cl.clip_quantiles(li, ["clipped"]), ["winsorized"], 0.05, 0.95)
    return out.withColumn("clipped", rnd("clipped", 4))


_FENCE = """(SELECT q1 - {f} * (q3 - q1) AS lo, q3 + {f} * (q3 - q1) AS hi FROM
 (SELECT quantile_cont(l_extendedprice, 0.25) AS q1, quantile_cont(l_extendedprice, 0.75) AS q3 FROM lineitem)) q"""


@query("cln_remove_outliers", f"SELECT l_orderkey, l_linenumber, l_extendedprice FROM lineitem, {_FENCE.format(f=0.5)} WHERE l_extendedprice BETWEEN lo AND hi")
def cln_remove_outliers(spark, d):
    li = tb.load(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_extendedprice")
    return cl.remove_outliers(li, ["l_extendedprice"], 0.5)


@query("cln_log_transform", "SELECT l_orderkey, l_linenumber, round(ln(1 + l_extendedprice), 6) AS l_extendedprice, l_discount FROM lineitem")
def cln_log_transform(spark, d):
    li = tb.load(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_extendedprice", "l_discount")
    return cl.log_positive(li, ["l_extendedprice", "l_discount"]).withColumn("l_extendedprice", rnd("l_extendedprice"))


@query("cln_clip_fences", with_views("""
SELECT l_orderkey, l_linenumber, round(CASE WHEN x < lo THEN lo WHEN x > hi THEN hi ELSE x END, 4) AS x
FROM s, (SELECT q1 - 1.5 * (q3 - q1) AS lo, q3 + 1.5 * (q3 - q1) AS hi FROM (SELECT quantile_cont(x, 0.25) AS q1, quantile_cont(x, 0.75) AS q3 FROM s)) q""",
    s="SELECT l_orderkey, l_linenumber, l_extendedprice * l_extendedprice / 10000 AS x FROM lineitem"))
def cln_clip_fences(spark, d):
    li = tb.load(spark, d, "lineitem").select("l_orderkey", "l_linenumber", (F.col("l_extendedprice") * F.col("l_extendedprice") / 10000).alias("x"))
    return cl.clip_fences(li, ["x"]).withColumn("x", rnd("x", 4))


@query("cln_dedup", with_views("SELECT DISTINCT * FROM dirty", dirty=tb.DIRTY_ORDERS))
def cln_dedup(spark, d):
    return cl.drop_duplicates(tb.dirty_orders(spark, d))


@query("cln_rare_other", """
SELECT p_partkey, CASE WHEN n::DOUBLE / (SELECT count(*) FROM part) < 0.04 THEN 'Other' ELSE p_brand END AS p_brand
FROM part JOIN (SELECT p_brand, count(*) AS n FROM part GROUP BY 1) USING (p_brand)""")
def cln_rare_other(spark, d):
    return cl.group_rare(tb.load(spark, d, "part").select("p_partkey", "p_brand"), "p_brand", 0.04)


@query("cln_scale", """
SELECT l_orderkey, l_linenumber, round((l_quantity - lo) / (hi - lo), 6) AS minmax, round((l_extendedprice - m) / s, 6) + 0.0 AS zscore,
  round((l_discount - q2) / (q3 - q1), 6) + 0.0 AS robust
FROM lineitem, (SELECT min(l_quantity) AS lo, max(l_quantity) AS hi, avg(l_extendedprice) AS m, stddev_samp(l_extendedprice) AS s,
  quantile_cont(l_discount, 0.25) AS q1, median(l_discount) AS q2, quantile_cont(l_discount, 0.75) AS q3 FROM lineitem) q""")
def cln_scale(spark, d):
    li = tb.load(spark, d, "lineitem").select("l_orderkey", "l_linenumber", F.col("l_quantity").alias("minmax"),
                                              F.col("l_extendedprice").alias("zscore"), F.col("l_discount").alias("robust"))
    for c in ("minmax", "zscore", "robust"):
        li = cl.scale(li, [c], c)
    return li.withColumns({c: rnd(c) for c in ("minmax", "zscore", "robust")})


@query("cln_pipeline_scale", """
SELECT l_orderkey, l_linenumber, round((l_extendedprice - m) / s, 6) + 0.0 AS standard, rank_share
FROM (SELECT l_orderkey, l_linenumber, l_extendedprice, round((rank() OVER (ORDER BY l_extendedprice) + count(*) OVER (PARTITION BY l_extendedprice) / 2.0::DOUBLE - 0.5 - 1)
  / (count(*) OVER () - 1), 6) AS rank_share FROM lineitem),
 (SELECT avg(l_extendedprice) AS m, stddev_pop(l_extendedprice) AS s FROM lineitem) q""")
def cln_pipeline_scale(spark, d):
    """Standard scaling beside the rank shares that the quantile scaler maps through the normal curve."""
    li = tb.load(spark, d, "lineitem").select("l_orderkey", "l_linenumber", F.col("l_extendedprice").alias("standard"),
                                              F.col("l_extendedprice").alias("x"))
    out = cl.quantile_share(cl.standardize(li, ["standard"]), "x", "rank_share")
    return out.select("l_orderkey", "l_linenumber", rnd("standard").alias("standard"), rnd("rank_share").alias("rank_share"))


@query("cln_power_normal")
def cln_power_normal(spark, d):
    """Quantile-to-normal and Yeo-Johnson values: SQL has no normal quantile and no likelihood search."""
    li = tb.load(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_extendedprice")
    lam = cl.fit_power(li, "l_extendedprice")
    out = cl.quantile_normal(li, "l_extendedprice", "normal")
    return out.withColumn("power", cl.power_value(F.col("l_extendedprice"), lam))


@query("cln_label_encode", """
SELECT o_orderkey, dense_rank() OVER (ORDER BY o_orderpriority) - 1 AS priority_code, f.code AS status_code
FROM orders JOIN (SELECT o_orderstatus, row_number() OVER (ORDER BY first) - 1 AS code FROM
  (SELECT o_orderstatus, min(o_orderkey) AS first FROM orders GROUP BY 1)) f USING (o_orderstatus)""")
def cln_label_encode(spark, d):
    o = tb.load(spark, d, "orders")
    out = cl.label_encode(o, "o_orderpriority", "priority_code")
    return cl.label_encode(out, "o_orderstatus", "status_code", ["o_orderkey"]).select("o_orderkey", "priority_code", "status_code")


@query("cln_onehot", """
SELECT o_orderkey, (o_orderstatus = 'F')::INT AS o_orderstatus_F, (o_orderstatus = 'O')::INT AS o_orderstatus_O, (o_orderstatus = 'P')::INT AS o_orderstatus_P FROM orders""")
def cln_onehot(spark, d):
    return cl.one_hot(tb.load(spark, d, "orders").select("o_orderkey", "o_orderstatus"), "o_orderstatus")


KEYS = ("l_orderkey", "l_linenumber", "l_partkey")
_RETAIL = """
SELECT DISTINCT * EXCLUDE (stock_qty), CASE WHEN stock_qty IN (-999, -1, 9999) THEN NULL ELSE stock_qty END AS s FROM dirty"""


@query("pln_auto_clean", with_views(f"""
SELECT l_orderkey, l_linenumber, l_partkey, category, coalesce(discount, median(discount) OVER (PARTITION BY category)) AS discount,
  coalesce(tax, median(tax) OVER (PARTITION BY category)) AS tax, coalesce(s, median(s) OVER (PARTITION BY category)) AS stock_qty,
  round({_PRICE}, 4) AS price, constant_col, l_shipdate FROM r""", **DIRTY, r=_RETAIL))
def pln_auto_clean(spark, d):
    out, _ = auto_clean(tb.dirty_lineitem(spark, d), sector="retail", protect=KEYS)
    return out.withColumn("price", rnd("price", 4))


@query("pln_from_recommend", with_views(f"""
SELECT l_orderkey, l_linenumber, category, coalesce(discount, median(discount) OVER (PARTITION BY category)) AS discount,
  coalesce(tax, median(tax) OVER (PARTITION BY category)) AS tax, coalesce(s, median(s) OVER (PARTITION BY category)) AS stock_qty,
  round({_PRICE}, 4) AS price FROM (SELECT * EXCLUDE (stock_qty), CASE WHEN stock_qty IN (-999, -1, 9999) THEN NULL ELSE stock_qty END AS s FROM dirty)""", **DIRTY))
def pln_from_recommend(spark, d):
    df = tb.dirty_lineitem(spark, d)
    out, _ = clean_from_recommendations(pf.Facts(df, duplicates=False), protect=KEYS)
    return out.select("l_orderkey", "l_linenumber", "category", "discount", "tax", "stock_qty", rnd("price", 4).alias("price"))
