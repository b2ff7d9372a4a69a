"""Feature, window, feature store, join, sort and set queries."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from tablecare import tables as tb
from tablecare.functions.columns import rnd
from tablecare.operators import features as fe
from tablecare.operators import joins as jn
from tablecare.operators import profile as pf
from tablecare.operators import windows as wn
from tablecare.plans.auto_features import AutoFeatures
from tablecare.queries.quality import union
from tablecare.queries.registry import query, with_views
from tablecare.session import shared_folder
from tablecare.sources.feature_store import FeatureStore, as_of, feature_history, latest_view

EV = ["ts", "event_id"]
ROW = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"]
NUM = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]


def work_folder(spark) -> str:
    """A fresh folder beside the checkpoints."""
    return f"{shared_folder(spark)}/tablecare-{uuid.uuid4().hex}"


def _cyc(fn, part, n):
    return f"round({fn}(2 * pi() * date_part('{part}', ts) / {n}), 6) + 0.0"


@query("fea_datetime", f"""
SELECT event_id, year(ts) AS ts_year, month(ts) AS ts_month, day(ts) AS ts_day, isodow(ts) - 1 AS ts_dayofweek, quarter(ts) AS ts_quarter,
  dayofyear(ts) AS ts_dayofyear, week(ts) AS ts_weekofyear, hour(ts) AS ts_hour, (isodow(ts) >= 6)::BIGINT AS ts_is_weekend,
  (day(ts) = 1)::BIGINT AS ts_is_month_start, (ts::DATE = last_day(ts))::BIGINT AS ts_is_month_end,
  (ts::DATE = date_trunc('quarter', ts)::DATE)::BIGINT AS ts_is_quarter_start,
  (ts::DATE = last_day(date_trunc('quarter', ts) + INTERVAL 2 MONTH))::BIGINT AS ts_is_quarter_end,
  (dayofyear(ts) = 1)::BIGINT AS ts_is_year_start, (month(ts) = 12 AND day(ts) = 31)::BIGINT AS ts_is_year_end,
  {_cyc('sin', 'month', 12)} AS ts_month_sin, {_cyc('cos', 'month', 12)} AS ts_month_cos, {_cyc('sin', 'day', 31)} AS ts_day_sin,
  {_cyc('cos', 'day', 31)} AS ts_day_cos, {_cyc('sin', 'hour', 24)} AS ts_hour_sin, {_cyc('cos', 'hour', 24)} AS ts_hour_cos FROM events""")
def fea_datetime(spark, d):
    out = fe.datetime_features(tb.load(spark, d, "events").select("event_id", "ts"), "ts")
    cycles = [c for c in out.columns if c.endswith(("_sin", "_cos"))]
    whole = [c for c in out.columns if c not in cycles and c != "event_id"]
    return out.withColumns({**{c: rnd(c) for c in cycles}, **{c: F.col(c).cast("bigint") for c in whole}})


_W = "OVER (PARTITION BY user_id ORDER BY ts, event_id{f})"


def _frame(n, stop=0):
    return _W.format(f=f" ROWS BETWEEN {n} PRECEDING AND CURRENT ROW")


def _roll(c, n, fn):
    call = f"{fn}({c})" if fn != "median" else f"quantile_cont({c}, 0.5)"
    return f"CASE WHEN count({c}) {_frame(n - 1)} = {n} THEN round({call} {_frame(n - 1)}, 6) + 0.0 END"


_STATS = {"mean": "avg", "std": "stddev_samp", "min": "min", "max": "max", "median": "median"}
_lag = [f"lag(value, {n}) {_W.format(f='')} AS value_lag_{n}" for n in (1, 2, 3, 7, 14, 30)]
_lag += [f"{_roll('value', n, fn)} AS value_rolling_{s}_{n}" for n in (3, 7, 14, 30) for s, fn in _STATS.items()]


@query("fea_lag_rolling", f"SELECT event_id, {', '.join(_lag)} FROM events")
def fea_lag_rolling(spark, d):
    out = fe.lag_features(tb.load(spark, d, "events").select("event_id", "user_id", "ts", "value"), "value", ["user_id"], EV, diffs=())
    return out.drop("user_id", "ts", "value").withColumns({c: rnd(c) for c in out.columns if "rolling" in c})


_daily_order = "OVER (PARTITION BY o_orderpriority ORDER BY day{f})"


def _dr(n, fn):
    f = _daily_order.format(f=f" ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW")
    return f"CASE WHEN count(total) {f} = {n} THEN round({fn}(total) {f}, {0 if 'std' in fn else 4}) + 0.0 END"


_ts_cols = [f"lag(total, {n}) {_daily_order.format(f='')} AS total_lag_{n}" for n in (1, 7, 14, 30)]
_ts_cols += [f"{_dr(n, fn)} AS total_rolling_{s}_{n}" for n in (7, 14, 30) for s, fn in
             (("mean", "avg"), ("std", "stddev_samp"), ("min", "min"), ("max", "max"))]


@query("fea_time_series", with_views(f"""
SELECT o_orderpriority, day, total, year(day) AS day_year, month(day) AS day_month, day(day) AS day_day, isodow(day) - 1 AS day_dayofweek,
  quarter(day) AS day_quarter, week(day) AS day_weekofyear, {', '.join(_ts_cols)} FROM daily""",
    daily="SELECT o_orderpriority, date_trunc('day', o_orderdate)::TIMESTAMP AS day, sum(o_totalprice::DECIMAL(18,2))::DOUBLE AS total FROM orders GROUP BY 1, 2"))
def fea_time_series(spark, d):
    daily = tb.load(spark, d, "orders").groupBy("o_orderpriority", F.date_trunc("day", "o_orderdate").cast("timestamp_ntz").alias("day")).agg(
        F.sum(F.col("o_totalprice").cast("decimal(18,2)")).cast("double").alias("total"))
    out = fe.time_series_features(daily, "day", "total", ["o_orderpriority"], ["day"])
    whole = [c for c in out.columns if c.startswith("day_")]
    return out.withColumns({**{c: rnd(c, 0 if "std" in c else 4) for c in out.columns if "rolling" in c},
                            **{c: F.col(c).cast("bigint") for c in whole}})


def _ewm_sql(span):
    r = 1 - 2.0 / (span + 1)
    w = f"pow({r!r}, len(xs) - i)"
    return f"""list_sum([{w} * xs[i] for i in range(1, len(xs) + 1)]) / list_sum([{w} for i in range(1, len(xs) + 1)])"""


def _ewm_std(span):
    r = 1 - 2.0 / (span + 1)
    w = f"pow({r!r}, len(xs) - i)"
    sw, sw2 = (f"list_sum([pow({w}, {k}) for i in range(1, len(xs) + 1)])" for k in (1, 2))
    sq = f"list_sum([{w} * pow(xs[i] - m{span}, 2) for i in range(1, len(xs) + 1)])"
    return f"CASE WHEN len(xs) > 1 THEN sqrt({sq} / {sw} * {sw} * {sw} / ({sw} * {sw} - {sw2})) END"


@query("fea_ewm", with_views(f"""
SELECT event_id, round(m7, 5) + 0.0 AS value_ewm_mean_7, round({_ewm_std(7)}, 4) + 0.0 AS value_ewm_std_7,
  round(m30, 5) + 0.0 AS value_ewm_mean_30, round({_ewm_std(30)}, 4) + 0.0 AS value_ewm_std_30
FROM (SELECT *, {_ewm_sql(7)} AS m7, {_ewm_sql(30)} AS m30 FROM l)""",
    l="SELECT event_id, list(value) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS xs FROM events"))
def fea_ewm(spark, d):
    out = fe.ewm_features(tb.load(spark, d, "events").select("event_id", "user_id", "ts", "value"), "value", ["user_id"], EV)
    return out.select("event_id", *[rnd(c, 5 if "mean" in c else 4).alias(c) for c in out.columns if "_ewm_" in c])


@query("fea_diff_pct", f"""
SELECT event_id, round(value - lag(value, 1) {_W.format(f='')}, 6) + 0.0 AS value_diff_1, round(value - lag(value, 7) {_W.format(f='')}, 6) + 0.0 AS value_diff_7,
  (value - lag(value, 1) {_W.format(f='')}) / nullif(lag(value, 1) {_W.format(f='')}, 0) + 0.0 AS value_pct_change_1,
  (value - lag(value, 7) {_W.format(f='')}) / nullif(lag(value, 7) {_W.format(f='')}, 0) + 0.0 AS value_pct_change_7 FROM events""")
def fea_diff_pct(spark, d):
    out = fe.lag_features(tb.load(spark, d, "events").select("event_id", "user_id", "ts", "value"), "value", ["user_id"], EV, (), ())
    return out.select("event_id", *[rnd(c).alias(c) for c in out.columns if "_diff_" in c],
                      *[(F.col(c) + 0.0).alias(c) for c in out.columns if "_pct_" in c])


def _li(spark, d):
    return tb.load(spark, d, "lineitem").select(*ROW, *NUM)


def _poly_sql():
    out = []
    for i, a in enumerate(NUM):
        for b in NUM[i:]:
            name = f"{a}^2" if a == b else f"{a}_x_{b}"
            out.append(f"round({a} * {b}, 4) + 0.0 AS \"{name}\"")
    return ", ".join(out)


@query("fea_polynomial", f"SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, {_poly_sql()} FROM lineitem")
def fea_polynomial(spark, d):
    cols = fe.polynomial_columns(NUM)
    return _li(spark, d).select(*ROW, *[rnd(c, 4).alias(n) for n, c in cols.items()])


_PAIRS = [(a, b) for i, a in enumerate(NUM) for b in NUM[i + 1:]]


@query("fea_interaction", "SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, " + ", ".join(
    f"round({a} * {b}, 4) + 0.0 AS {a}_times_{b}, round({a} + {b}, 4) + 0.0 AS {a}_plus_{b}, round({a} - {b}, 4) + 0.0 AS {a}_minus_{b}" for a, b in _PAIRS) + " FROM lineitem")
def fea_interaction(spark, d):
    cols = fe.interaction_columns(NUM)
    return _li(spark, d).select(*ROW, *[rnd(c, 4).alias(n) for n, c in cols.items()])


@query("fea_ratio", "SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, " + ", ".join(
    f"coalesce({a} / nullif({b}, 0), 0) AS {a}_div_{b}, coalesce({b} / nullif({a}, 0), 0) AS {b}_div_{a}" for a, b in _PAIRS) + " FROM lineitem")
def fea_ratio(spark, d):
    return _li(spark, d).select(*ROW, *[c.alias(n) for n, c in fe.ratio_columns(NUM).items()])


_logs = []
for _c in NUM:
    _logs.append(f"round(ln(1 + {_c}{'' if _c in ('l_quantity', 'l_extendedprice') else ' + 1e-10'}), 6) + 0.0 AS {_c}_log")
    _logs.append(f"round(sqrt({_c}), 6) AS {_c}_sqrt, round({_c} * {_c}, 4) AS {_c}_squared")


@query("fea_log", f"SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, {', '.join(_logs)} FROM lineitem")
def fea_log(spark, d):
    li = _li(spark, d)
    cols = fe.log_columns(li, NUM)
    return li.select(*ROW, *[rnd(c, 4 if n.endswith("squared") else 6).alias(n) for n, c in cols.items()])


_ARR = f"[{', '.join(NUM)}]"


@query("fea_row_stats", f"""
SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, round(list_avg(v), 6) AS row_mean, round(list_stddev_samp(v), 6) AS row_std, list_max(v) AS row_max, list_min(v) AS row_min,
  round(list_median(v), 6) AS row_median, round(list_sum(v), 6) AS row_sum, round(list_skewness(v), 4) AS row_skew, round(list_kurtosis(v), 4) AS row_kurt,
  ((l_quantity = 0)::INT + (l_extendedprice = 0)::INT + (l_discount = 0)::INT + (l_tax = 0)::INT)::BIGINT AS row_zeros,
  ((l_quantity > 0)::INT + (l_extendedprice > 0)::INT + (l_discount > 0)::INT + (l_tax > 0)::INT)::BIGINT AS row_positives,
  0::BIGINT AS row_negatives
FROM (SELECT *, {_ARR} AS v FROM lineitem)""")
def fea_row_stats(spark, d):
    out = fe.row_statistics(_li(spark, d), NUM).drop(*NUM)
    return out.withColumns({
        **{c: rnd(c) for c in ("row_mean", "row_std", "row_median", "row_sum")}, **{c: rnd(c, 4) for c in ("row_skew", "row_kurt")},
        **{c: F.col(c).cast("bigint") for c in ("row_zeros", "row_positives", "row_negatives")}})


def _bins_sql(c):
    qs = ", ".join(f"quantile_cont({c}, {i / 10})" for i in range(1, 10))
    return (f"(SELECT [x for x in list_distinct(qs) if x > lo AND x < hi] FROM "
            f"(SELECT [{qs}] AS qs, min({c}) AS lo, max({c}) AS hi FROM lineitem))")


@query("fea_quantile_bins", with_views("""
SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, len([x for x in e1 if x <= l_quantity]) AS l_quantity_binned,
  len([x for x in e2 if x <= l_extendedprice]) AS l_extendedprice_binned, len([x for x in e3 if x <= l_tax]) AS l_tax_binned FROM lineitem, e""",
    e="SELECT " + ", ".join(f"{_bins_sql(c)} AS e{i + 1}" for i, c in enumerate(["l_quantity", "l_extendedprice", "l_tax"]))))
def fea_quantile_bins(spark, d):
    li = _li(spark, d)
    cols = fe.bin_columns(fe.bin_edges(li, ["l_quantity", "l_extendedprice", "l_tax"]))
    return li.select(*ROW, *[c.cast("bigint").alias(n) for n, c in cols.items()])


@query("fea_target_encode", """
SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, round(m, 6) AS l_returnflag_target_encoded
FROM lineitem JOIN (SELECT l_returnflag, avg(l_discount) AS m FROM lineitem GROUP BY 1) USING (l_returnflag)""")
def fea_target_encode(spark, d):
    out = fe.target_encode(tb.load(spark, d, "lineitem"), "l_returnflag", "l_discount")
    return out.select(*ROW, rnd("l_returnflag_target_encoded").alias("l_returnflag_target_encoded"))


@query("fea_text_stats", r"""
SELECT doc_id, length(text) AS text_length, len(list_filter(regexp_split_to_array(text, '\s+'), lambda w: w <> '')) AS text_word_count,
  len(list_distinct(list_filter(regexp_split_to_array(text, '\s+'), lambda w: w <> ''))) AS text_unique_word_count,
  len(regexp_extract_all(text, '[0-9]')) AS text_digit_count, len(regexp_extract_all(text, '[A-Z]')) AS text_upper_count,
  len(regexp_extract_all(text, '[a-z]')) AS text_lower_count, len(regexp_extract_all(text, '\s')) AS text_space_count,
  len(regexp_extract_all(text, '[^\p{L}\p{M}\p{Nd}\p{Pc}\s]')) AS text_punct_count,
  round(len(regexp_extract_all(text, '[0-9]'))::DOUBLE / (length(text) + 1), 6) AS text_digit_ratio,
  round(len(regexp_extract_all(text, '[A-Z]'))::DOUBLE / (length(text) + 1), 6) AS text_upper_ratio,
  round(len(regexp_extract_all(text, '\s'))::DOUBLE / (length(text) + 1), 6) AS text_space_ratio FROM documents""")
def fea_text_stats(spark, d):
    cols = fe.text_statistics("text")
    out = tb.load(spark, d, "documents").select("doc_id", *[c.alias(n) for n, c in cols.items()])
    return out.select("doc_id", *[rnd(c).alias(c) if c.endswith("ratio") else F.col(c).cast("bigint").alias(c) for c in cols])


def _mi_sql(c):
    return f"""SELECT '{c}' AS feature, round(sum(n / t * ln(n * t / (nx * ny))), 6) + 0.0 AS mutual_info FROM
  (SELECT n, sum(n) OVER () AS t, sum(n) OVER (PARTITION BY b) AS nx, sum(n) OVER (PARTITION BY y) AS ny FROM
   (SELECT len([x for x in e if x <= {c}]) AS b, l_returnflag AS y, count(*)::DOUBLE AS n FROM lineitem, (SELECT {_bins_sql(c)} AS e) q GROUP BY 1, 2))"""


@query("fea_mutual_info", union(_mi_sql(c) for c in NUM))
def fea_mutual_info(spark, d):
    return fe.binned_mutual_info(tb.load(spark, d, "lineitem"), NUM, "l_returnflag").withColumn("mutual_info", rnd("mutual_info"))


def _near_sql(c):
    bounds = lambda a: f"CASE WHEN r > 0 THEN b.{a} < p.{a} + r AND NOT b.{a} <= p.{a} - r ELSE b.{a} = p.{a} END"
    psi = "(-0.577215664901532860607 + list_sum(list_prepend(0.0, [1.0::DOUBLE / j for j in range(1, ({0})::BIGINT)])))"
    return f"""SELECT '{c}' AS feature, round(greatest(0, any_value({psi.format('t')}) + {psi.format('3')} - avg({psi.format('nx')} + {psi.format('ny')})), 5) + 0.0 AS mutual_info FROM
 (SELECT p.i, any_value(p.t) AS t, count_if({bounds('x')}) AS nx, count_if({bounds('y')}) AS ny FROM
  (SELECT a.i, any_value(a.x) AS x, any_value(a.y) AS y, any_value(a.t) AS t, min(greatest(abs(a.x - b.x), abs(a.y - b.y)), 3)[3] * (1 - 1e-7) AS r FROM v_{c} a JOIN v_{c} b ON a.i <> b.i GROUP BY a.i) p, v_{c} b GROUP BY p.i)"""


_NEAR = ("p_partkey", "p_size")


@query("fea_mutual_info_regression", with_views(union(_near_sql(c) for c in _NEAR), **{f"v_{c}": f"""
SELECT p_partkey AS i, ({c} - avg({c}) OVER ()) / stddev_pop({c}) OVER () AS x, (p_retailprice - avg(p_retailprice) OVER ()) / stddev_pop(p_retailprice) OVER () AS y, count(*) OVER () AS t FROM part""" for c in _NEAR}))
def fea_mutual_info_regression(spark, d):
    """Neighbour estimate for a numeric target; ranks on each axis come from running counts."""
    return fe.mutual_info(tb.load(spark, d, "part"), list(_NEAR), "p_retailprice", "regression").withColumn("mutual_info", rnd("mutual_info", 5))


@query("fea_variance_select", """
SELECT "column", round(v, 4) AS variance FROM (
  SELECT 'l_quantity' AS "column", var_pop(l_quantity) AS v FROM lineitem UNION ALL SELECT 'l_extendedprice', var_pop(l_extendedprice) FROM lineitem
  UNION ALL SELECT 'l_discount', var_pop(l_discount) FROM lineitem UNION ALL SELECT 'l_tax', var_pop(l_tax) FROM lineitem) WHERE v > 0.0008 ORDER BY v DESC LIMIT 2""")
def fea_variance_select(spark, d):
    li = tb.load(spark, d, "lineitem")
    values = fe.variances(li, NUM)
    picked = fe.select_by_variance(li, NUM, 0.0008, 2)
    return spark.createDataFrame([(c, float(values[c])) for c in picked], "column string, variance double").withColumn("variance", rnd("variance", 4))


@query("fea_registry", """
SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice * (1 - l_discount) AS net,
  l_extendedprice * (1 - l_discount) * (1 + l_tax) AS gross, l_extendedprice * (1 - l_discount) * (1 + l_tax) / l_quantity AS unit FROM lineitem""")
def fea_registry(spark, d):
    reg = fe.FeatureRegistry()
    reg.register("unit", lambda: F.col("gross") / F.col("l_quantity"), ("gross",))
    reg.register("gross", lambda: F.col("net") * (1 + F.col("l_tax")), ("net",))
    reg.register("net", lambda: F.col("l_extendedprice") * (1 - F.col("l_discount")))
    out = reg.compute(_li(spark, d), ["unit"])
    return out.select(*ROW, "net", "gross", "unit")


@query("pln_auto_features", """
SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, round(l_extendedprice * l_extendedprice, 2) AS "l_extendedprice^2",
  round(l_quantity * l_extendedprice, 2) AS l_quantity_x_l_extendedprice FROM lineitem""")
def pln_auto_features(spark, d):
    li = _li(spark, d)
    plan = AutoFeatures(max_features=2).fit(li, numeric=["l_quantity", "l_extendedprice"], families=("polynomial", "ratio"))
    return plan.transform(li, keep=ROW).select(*ROW, *[rnd(c, 2).alias(c) for c in plan.selected])


@query("fea_sensor", """
SELECT event_id, CASE WHEN user_id > 0 THEN value / user_id ELSE 0 END AS temp_pressure_ratio, round(value * value, 4) AS temp_squared,
  round(ln(1 + abs(user_id)), 6) AS pressure_log, round((value - 32) * 5 / 9, 6) + 0.0 AS temp_celsius, round(user_id * 14.5038, 6) AS pressure_psi
FROM (SELECT event_id, value, user_id::DOUBLE AS user_id FROM events)""")
def fea_sensor(spark, d):
    ev = tb.load(spark, d, "events").select("event_id", "value", F.col("user_id").cast("double").alias("user_id"))
    cols = fe.sensor_columns("value", "user_id")
    return ev.select("event_id", *[c.alias(n) if n.endswith("ratio") else rnd(c, 4 if n == "temp_squared" else 6).alias(n) for n, c in cols.items()])


# Feature store.


@query("fst_register", """SELECT 'customer' AS name, 2 AS version, '["c_acctbal", "c_mktsegment"]' AS features, count(*) AS "rows" FROM customer""")
def fst_register(spark, d):
    """Definitions are appended; the newest one per name counts."""
    store = FeatureStore(spark, work_folder(spark))
    store.register("customer", "c_custkey", "ts", ["c_acctbal"])
    store.register("customer", "c_custkey", "ts", ["c_acctbal", "c_mktsegment"], 2)
    store.write("customer", tb.load(spark, d, "customer"), "2024-01-01 00:00:00")
    n = store.read("customer").count()
    return store.definitions().select("name", "version", "features").withColumn("rows", F.lit(n))


@query("fst_write_read", "SELECT c_custkey, c_acctbal, c_mktsegment FROM customer")
def fst_write_read(spark, d):
    store = FeatureStore(spark, work_folder(spark))
    store.register("customer", "c_custkey", "ts", ["c_acctbal", "c_mktsegment"])
    store.write("customer", tb.load(spark, d, "customer"), "2024-01-01 00:00:00")
    return store.read("customer")


@query("fst_time_travel", """
SELECT o_custkey, count(*) AS n_orders, round(sum(o_totalprice::DECIMAL(18,2))::DOUBLE, 2) AS total FROM orders WHERE o_orderdate < TIMESTAMP '1997-01-01' GROUP BY 1""")
def fst_time_travel(spark, d):
    store = FeatureStore(spark, work_folder(spark))
    store.register("orders", "o_custkey", "ts", ["n_orders", "total"])
    orders = tb.load(spark, d, "orders")
    for year in (1996, 1997, 1998):
        part = orders.where(F.col("o_orderdate") < F.lit(f"{year}-01-01").cast("timestamp_ntz"))
        part = part.groupBy("o_custkey").agg(F.count(F.lit(1)).alias("n_orders"),
                                             F.round(F.sum(F.col("o_totalprice").cast("decimal(18,2)")).cast("double"), 2).alias("total"))
        store.write("orders", part, f"{year}-01-01 00:00:00")
    return store.read("orders", as_of="1997-06-30 00:00:00")


@query("fst_outer_join", """
SELECT coalesce(c_custkey, o_custkey) AS c_custkey, c_mktsegment, n_orders FROM customer
FULL OUTER JOIN (SELECT o_custkey, count(*) AS n_orders FROM orders GROUP BY 1) o ON c_custkey = o_custkey""")
def fst_outer_join(spark, d):
    store = FeatureStore(spark, work_folder(spark))
    store.register("customer", "c_custkey", "ts", ["c_mktsegment"])
    store.register("orders", "o_custkey", "ts", ["n_orders"])
    store.write("customer", tb.load(spark, d, "customer"), "2024-01-01 00:00:00")
    store.write("orders", tb.load(spark, d, "orders").groupBy("o_custkey").agg(F.count(F.lit(1)).alias("n_orders")), "2024-01-01 00:00:00")
    return store.read_many(["customer", "orders"])


@query("fst_latest_view", """
SELECT user_id, ts, event_type, value FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS rn FROM events)
WHERE rn = 1 AND ts > (SELECT max(ts) FROM events) - INTERVAL 12 HOUR""")
def fst_latest_view(spark, d):
    ev = tb.load(spark, d, "events")
    newest = ev.agg(F.max("ts")).first()[0]
    return latest_view(ev, "user_id", EV, ["event_type", "value"], F.lit(newest) - F.expr("INTERVAL 12 HOURS"))


@query("fst_stats", """
SELECT 'c_acctbal' AS "column", count(c_acctbal) AS count, count(DISTINCT c_acctbal) AS "distinct", round(avg(c_acctbal), 4) AS mean, round(stddev_samp(c_acctbal), 4) AS std,
  min(c_acctbal) AS min, max(c_acctbal) AS max, round(median(c_acctbal), 4) AS q50 FROM customer""")
def fst_stats(spark, d):
    store = FeatureStore(spark, work_folder(spark))
    store.register("customer", "c_custkey", "ts", ["c_acctbal"])
    store.write("customer", tb.load(spark, d, "customer"), "2024-01-01 00:00:00")
    out = store.statistics("customer").where(F.col("column") == "c_acctbal")
    return out.select("column", "count", "distinct", rnd("mean", 4).alias("mean"), rnd("std", 4).alias("std"), "min", "max", rnd("q50", 4).alias("q50"))


@query("fst_history", """
SELECT user_id AS entity, ts, 'value' AS feature, value FROM events WHERE user_id = 7 AND ts BETWEEN TIMESTAMP '2024-01-03' AND TIMESTAMP '2024-01-20'""")
def fst_history(spark, d):
    return feature_history(tb.load(spark, d, "events"), "user_id", 7, "ts", "value", "2024-01-03 00:00:00", "2024-01-20 00:00:00")


_ASOF_L = "SELECT o_orderkey, o_custkey % 150 AS user_id, TIMESTAMP '2024-01-01' + INTERVAL 1 MINUTE * (o_orderkey % 43200) AS at FROM orders"


@query("fst_asof", with_views("""
SELECT l.o_orderkey, l.user_id, l.at, e.value AS asof_value, e.event_id AS asof_event_id
FROM l ASOF LEFT JOIN events e ON l.user_id = e.user_id AND l.at >= e.ts""", l=_ASOF_L))
def fst_asof(spark, d):
    left = tb.load(spark, d, "orders").select(
        "o_orderkey", (F.col("o_custkey") % 150).alias("user_id"),
        F.expr("timestamp_ntz '2024-01-01 00:00:00' + make_dt_interval(0, 0, cast(o_orderkey % 43200 as int), 0)").alias("at"))
    return as_of(left, tb.load(spark, d, "events"), "user_id", "at", "ts", ["value", "event_id"], ["o_orderkey"], ["event_id"])


# Joins.


@query("jon_full_outer", """
SELECT coalesce(c_custkey, o_custkey) AS key, c_acctbal, total FROM customer FULL OUTER JOIN
 (SELECT o_custkey, sum(o_totalprice::DECIMAL(18,2))::DOUBLE AS total FROM orders WHERE o_orderpriority = '1-URGENT' GROUP BY 1) o ON c_custkey = o_custkey""")
def jon_full_outer(spark, d):
    cust = tb.load(spark, d, "customer").select(F.col("c_custkey").alias("key"), "c_acctbal")
    orders = tb.load(spark, d, "orders").where("o_orderpriority = '1-URGENT'").groupBy(F.col("o_custkey").alias("key")).agg(
        F.sum(F.col("o_totalprice").cast("decimal(18,2)")).cast("double").alias("total"))
    return jn.outer_join([cust, orders], "key")


@query("jon_semi", "SELECT c_custkey, c_name FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders WHERE o_orderpriority = '1-URGENT')")
def jon_semi(spark, d):
    ids = tb.load(spark, d, "orders").where("o_orderpriority = '1-URGENT'").select(F.col("o_custkey").alias("c_custkey"))
    return tb.load(spark, d, "customer").join(ids, "c_custkey", "left_semi").select("c_custkey", "c_name")


@query("jon_group_back", """
SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, round(l_extendedprice - avg(l_extendedprice) OVER (PARTITION BY l_returnflag), 4) + 0.0 AS off_mean FROM lineitem""")
def jon_group_back(spark, d):
    out = jn.group_back(tb.load(spark, d, "lineitem"), ["l_returnflag"], {"m": F.avg("l_extendedprice")})
    return out.select(*ROW, rnd(F.col("l_extendedprice") - F.col("m"), 4).alias("off_mean"))


@query("jon_map_default", "SELECT p_partkey, CASE p_brand WHEN 'Brand#1' THEN 1.5 WHEN 'Brand#2' THEN 2.5 ELSE 0.5 END::DOUBLE AS weight FROM part")
def jon_map_default(spark, d):
    out = jn.map_default(tb.load(spark, d, "part"), "p_brand", {"Brand#1": 1.5, "Brand#2": 2.5}, 0.5, "weight")
    return out.select("p_partkey", "weight")


@query("jon_align_counts", """
SELECT coalesce(a.v, b.v) AS value, coalesce(a.n, 0) AS n_a, coalesce(b.n, 0) AS n_b FROM
 (SELECT o_orderpriority AS v, count(*) AS n FROM orders WHERE o_orderstatus = 'F' AND o_orderpriority <> '5-LOW' GROUP BY 1) a
 FULL OUTER JOIN (SELECT o_orderpriority AS v, count(*) AS n FROM orders WHERE o_orderstatus <> 'F' AND o_orderpriority <> '1-URGENT' GROUP BY 1) b ON a.v = b.v""")
def jon_align_counts(spark, d):
    o = tb.load(spark, d, "orders")
    return jn.aligned_counts(o.where("o_orderstatus = 'F' and o_orderpriority <> '5-LOW'"),
                             o.where("o_orderstatus <> 'F' and o_orderpriority <> '1-URGENT'"), "o_orderpriority")


# Windows.


@query("win_leaderboard", """
SELECT s_suppkey, s_acctbal, rank() OVER (ORDER BY s_acctbal DESC) AS rank, round(s_acctbal / max(s_acctbal) OVER (), 6) + 0.0 AS relative FROM supplier""")
def win_leaderboard(spark, d):
    out = wn.leaderboard(tb.load(spark, d, "supplier"), "s_acctbal", ["s_suppkey"])
    return out.select("s_suppkey", "s_acctbal", "rank", rnd("relative").alias("relative"))


@query("win_keep_last_n", """
SELECT o_orderkey, o_custkey, coalesce(rn > 3, false) AS removed FROM orders LEFT JOIN
 (SELECT o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) AS rn FROM orders
  WHERE NOT (o_orderstatus = 'F' OR o_orderdate >= TIMESTAMP '1998-06-01')) USING (o_orderkey)""")
def win_keep_last_n(spark, d):
    keep = (F.col("o_orderstatus") == "F") | (F.col("o_orderdate") >= F.lit("1998-06-01").cast("timestamp_ntz"))
    out = wn.keep_versions(tb.load(spark, d, "orders"), ["o_custkey"], ["o_orderdate", "o_orderkey"], 3, keep)
    return out.select("o_orderkey", "o_custkey", "removed")


@query("win_first_last", """
SELECT user_id, arg_min(value, (ts, event_id)) AS first_value, arg_max(value, (ts, event_id)) AS last_value FROM events GROUP BY 1""")
def win_first_last(spark, d):
    return wn.first_last(tb.load(spark, d, "events"), ["user_id"], EV, ["value"])


_T = "OVER (PARTITION BY event_type ORDER BY ts, event_id ROWS BETWEEN {a} PRECEDING AND {b})"


@query("win_trend", with_views("""
SELECT event_id, round(a10, 6) + 0.0 AS avg_10, CASE WHEN n < 2 THEN 'stable' WHEN change < -0.05 THEN 'decreasing' WHEN change > 0.05 THEN 'increasing' ELSE 'stable' END AS trend
FROM (SELECT *, CASE WHEN prev <> 0 THEN (rec - prev) / prev ELSE 0 END AS change FROM
  (SELECT event_id, a10, n, CASE WHEN n >= 3 THEN l3 ELSE value END AS rec, CASE WHEN n > 3 THEN p7 ELSE f END AS prev FROM w))""", w=f"""
SELECT event_id, value, avg(value) {_T.format(a=9, b='CURRENT ROW')} AS a10, count(value) {_T.format(a=9, b='CURRENT ROW')} AS n,
  avg(value) {_T.format(a=2, b='CURRENT ROW')} AS l3, avg(value) {_T.format(a=9, b='3 PRECEDING')} AS p7, first_value(value) {_T.format(a=9, b='CURRENT ROW')} AS f FROM events"""))
def win_trend(spark, d):
    out = wn.recent_trend(tb.load(spark, d, "events"), "value", ["event_type"], EV)
    return out.select("event_id", rnd("avg_10").alias("avg_10"), "trend")


@query("win_anomalies", f"""
SELECT event_id, coalesce(count(*) {_T.format(a=20, b='CURRENT ROW')} > 5 AND value > 10 * avg(value) {_T.format(a=4, b='CURRENT ROW')}, false) AS explosion,
  coalesce(count(*) {_T.format(a=20, b='CURRENT ROW')} > 20 AND stddev_pop(value) {_T.format(a=19, b='CURRENT ROW')} < 0.001, false) AS stagnation, false AS nan_loss FROM events""")
def win_anomalies(spark, d):
    out = wn.training_anomalies(tb.load(spark, d, "events"), "value", ["event_type"], EV)
    return out.select("event_id", "explosion", "stagnation", "nan_loss")


@query("win_rate_flag", """
SELECT event_id, user_id, calls, calls > 2 AS over_limit FROM (SELECT event_id, user_id,
  count(*) OVER (PARTITION BY user_id ORDER BY epoch_us(ts) RANGE BETWEEN 3600000000 PRECEDING AND CURRENT ROW) AS calls FROM events)""")
def win_rate_flag(spark, d):
    out = wn.trailing_counts(tb.load(spark, d, "events"), "user_id", "ts", 3600)
    return out.select("event_id", "user_id", "calls", (F.col("calls") > 2).alias("over_limit"))


@query("win_run_summary", """
SELECT event_type, count(*) AS steps, min(value) AS best, max(value) AS worst, arg_max(value, (ts, event_id)) AS final,
  round((epoch_us(max(ts)) - epoch_us(min(ts))) / 1e6 / count(*), 6) AS seconds_per_step FROM events GROUP BY 1""")
def win_run_summary(spark, d):
    out = wn.run_summary(tb.load(spark, d, "events"), ["event_type"], "value", EV, "ts")
    return out.withColumn("seconds_per_step", rnd("seconds_per_step"))


# Sorts, limits and sets.


@query("srt_sort", "SELECT o_orderkey, o_totalprice, o_orderdate FROM orders ORDER BY o_orderdate, o_totalprice DESC, o_orderkey")
def srt_sort(spark, d):
    return tb.load(spark, d, "orders").select("o_orderkey", "o_totalprice", "o_orderdate").orderBy("o_orderdate", F.desc("o_totalprice"), "o_orderkey")


@query("srt_limit", "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_orderkey LIMIT 100")
def srt_limit(spark, d):
    return tb.load(spark, d, "orders").select("o_orderkey", "o_totalprice").orderBy("o_orderkey").limit(100)


@query("srt_top_k", "SELECT p_partkey, p_retailprice FROM part ORDER BY p_retailprice DESC, p_partkey LIMIT 20")
def srt_top_k(spark, d):
    return jn.top_k(tb.load(spark, d, "part").select("p_partkey", "p_retailprice"), "p_retailprice", 20, ["p_partkey"])


@query("srt_hash_sample", "SELECT o_orderkey, o_custkey FROM orders WHERE ('0x' || md5(o_orderkey::VARCHAR)[1:8])::BIGINT % 10000 < 1000")
def srt_hash_sample(spark, d):
    return jn.hash_sample(tb.load(spark, d, "orders").select("o_orderkey", "o_custkey"), "o_orderkey", 0.1)


@query("set_union", """
SELECT event_id, value, NULL::VARCHAR AS props FROM events WHERE event_type = 'click' UNION ALL SELECT event_id, NULL, props FROM events WHERE event_type <> 'click'""")
def set_union(spark, d):
    ev = tb.load(spark, d, "events")
    return jn.append([ev.where("event_type = 'click'").select("event_id", "value"), ev.where("event_type <> 'click'").select("event_id", "props")])


@query("set_intersect_except", """
SELECT 'both' AS side, o_custkey FROM (SELECT o_custkey FROM orders WHERE o_orderstatus = 'F' INTERSECT SELECT o_custkey FROM orders WHERE o_orderstatus = 'P')
UNION ALL SELECT 'only_f', o_custkey FROM (SELECT o_custkey FROM orders WHERE o_orderstatus = 'F' EXCEPT SELECT o_custkey FROM orders WHERE o_orderstatus = 'P')""")
def set_intersect_except(spark, d):
    o = tb.load(spark, d, "orders")
    f, p = (o.where(F.col("o_orderstatus") == s).select("o_custkey") for s in "FP")
    both = f.intersect(p).select(F.lit("both").alias("side"), "o_custkey")
    return both.unionByName(f.exceptAll(f.join(p, "o_custkey", "left_semi")).distinct().select(F.lit("only_f").alias("side"), "o_custkey"))
