"""Streaming queries: each drains the whole table through Structured Streaming, or runs the batch form of a stream operator."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import functions as F

from tablecare import tables as tb
from tablecare.functions.columns import rnd
from tablecare.functions.ranges import STATISTICS
from tablecare.operators import models as md
from tablecare.operators.features import ema_features
from tablecare.queries.features import EV, work_folder
from tablecare.queries.learning import X, labelled
from tablecare.queries.quality import union
from tablecare.queries.registry import query, with_views
from tablecare.streaming import ingest as ig
from tablecare.streaming import windows as ws
from tablecare.streaming.intime import drained_in_time
from tablecare.streaming.learning import OnlineLogistic, prequential
from tablecare.streaming.stateful import error_drift_stream, zscore_stream


def messages(spark, d):
    """events as messages: key, JSON value, time; every ninth value lacks a required field."""
    ev = ig.table_stream(spark, d, "events")
    value = F.when(F.col("event_id") % 9 == 0, F.to_json(F.struct("event_id", "event_type"))).otherwise(
        F.to_json(F.struct("event_id", "user_id", "event_type", "value")))
    return ev.select(F.col("user_id").cast("string").alias("key"), value.alias("value"), F.col("ts").alias("timestamp"))


RECORD = "event_id bigint, user_id bigint, event_type string, value double"


@query("str_ingest", "SELECT user_id::VARCHAR AS key, event_id, user_id, event_type, value FROM events WHERE event_id % 9 <> 0")
def str_ingest(spark, d):
    good, _ = ig.parse(messages(spark, d), RECORD, ["event_id", "user_id", "value"])
    return ig.drained(spark, good, work_folder(spark)).select("key", "event_id", "user_id", "event_type", "value")


@query("str_validate", "SELECT CASE WHEN event_id % 9 <> 0 THEN 'valid' ELSE 'rejected' END AS part, count(*) AS n FROM events GROUP BY 1")
def str_validate(spark, d):
    good, bad = ig.parse(messages(spark, d), RECORD, ["event_id", "user_id", "value"])
    out = None
    for name, part in (("valid", good), ("rejected", bad)):
        rows = ig.drained(spark, part, work_folder(spark)).agg(F.count(F.lit(1)).alias("n")).select(F.lit(name).alias("part"), "n")
        out = rows if out is None else out.unionByName(rows)
    return out


@query("str_tumbling", """
SELECT time_bucket(INTERVAL 15 SECONDS, ts) AS window_start, event_type AS metric, count(value) AS count, round(sum(value), 4) AS sum, round(avg(value), 6) AS mean, min(value) AS min, max(value) AS max
FROM events GROUP BY 1, 2""")
def str_tumbling(spark, d):
    stream = ws.tumbling(ig.table_stream(spark, d, "events"), "ts", "event_type", "value")
    out = ig.newest_update(ig.drained(spark, stream, work_folder(spark), "update"), ["window_start", "metric"])
    return out.withColumns({"window_start": F.col("window_start").cast("timestamp_ntz"), "sum": rnd("sum", 4), "mean": rnd("mean")})


SIZES = {"1min": 60, "5min": 300, "15min": 900, "1hour": 3600}
_Q = {"p25": 0.25, "median": 0.5, "p75": 0.75, "p95": 0.95, "p99": 0.99}


def _multi(name, secs):
    b = f"time_bucket(INTERVAL {secs} SECONDS, ts)"
    return f"""SELECT '{name}' AS size, w AS window_start, count(*) AS count, round(sum(value), 4) AS sum, round(avg(value), 6) AS mean, round(stddev_pop(value), 6) AS std, min(value) AS min, max(value) AS max,
  round(max(value) - min(value), 4) AS range, {', '.join(f'round(max({q}), 6) AS {q}' for q in _Q)}, round(max(p75 - p25), 6) + 0.0 AS iqr,
  count_if(value < p25 - 1.5 * (p75 - p25) OR value > p75 + 1.5 * (p75 - p25)) AS outlier_count,
  round(count_if(value < p25 - 1.5 * (p75 - p25) OR value > p75 + 1.5 * (p75 - p25))::DOUBLE / count(*), 6) AS outlier_ratio
 FROM (SELECT value, {b} AS w FROM events) JOIN (SELECT {b} AS w, {', '.join(f'quantile_cont(value, {p}) AS {q}' for q, p in _Q.items())} FROM events GROUP BY 1) q USING (w) GROUP BY w"""


@query("str_multi_window", union(_multi(n, s) for n, s in SIZES.items()))
def str_multi_window(spark, d):
    out = ws.multi_window(tb.load(spark, d, "events"), "ts", "value", SIZES)
    exact = ("size", "window_start", "count", "min", "max", "outlier_count")
    return out.select("size", F.col("window_start").cast("timestamp_ntz").alias("window_start"), "count", "min", "max", "outlier_count",
                      *[rnd(c, 4 if c in ("sum", "range") else 6).alias(c) for c in out.columns if c not in exact])


TRAILING = {"1min": 60, "5min": 300, "15min": 900, "60min": 3600}


def _back(name):
    q = ", ".join(f"round(quantile_cont(value, {p}) OVER w_{name}, 6) + 0.0 AS {n}_{name}" for n, p in _Q.items())
    fences = [f"(quantile_cont(value, 0.{q}) OVER w_{name}) {s} 1.5 * ((quantile_cont(value, 0.75) OVER w_{name}) - (quantile_cont(value, 0.25) OVER w_{name}))" for q, s in (("25", "-"), ("75", "+"))]
    return f"""count(value) OVER w_{name} AS count_{name}, round(sum(value) OVER w_{name}, 4) + 0.0 AS sum_{name}, round(avg(value) OVER w_{name}, 6) + 0.0 AS mean_{name}, round(stddev_pop(value) OVER w_{name}, 5) + 0.0 AS std_{name},
 min(value) OVER w_{name} AS min_{name}, max(value) OVER w_{name} AS max_{name}, round((max(value) OVER w_{name}) - (min(value) OVER w_{name}), 4) + 0.0 AS range_{name}, {q},
 round((quantile_cont(value, 0.75) OVER w_{name}) - (quantile_cont(value, 0.25) OVER w_{name}), 6) + 0.0 AS iqr_{name}, list(value) OVER w_{name} AS l_{name}, {fences[0]} AS lo_{name}, {fences[1]} AS hi_{name}"""


_FAR = "len(list_filter(l_{0}, lambda x: x < lo_{0} OR x > hi_{0}))"
_TRAILING_SQL = ("SELECT *EXCLUDE (" + ", ".join(f"l_{n}, lo_{n}, hi_{n}" for n in TRAILING) + "), " + ", ".join(f"{_FAR.format(n)} AS outlier_count_{n}, round({_FAR.format(n)}::DOUBLE / count_{n}, 6) AS outlier_ratio_{n}" for n in TRAILING)
                 + " FROM (SELECT event_id, " + ", ".join(_back(n) for n in TRAILING) + " FROM events WINDOW "
                 + ", ".join(f"w_{n} AS (PARTITION BY event_type ORDER BY ts RANGE BETWEEN INTERVAL {s} SECONDS PRECEDING AND CURRENT ROW)" for n, s in TRAILING.items()) + ")")


@query("str_trailing", _TRAILING_SQL)
def str_trailing(spark, d):
    """The 15 statistics of the last 1, 5, 15 and 60 minutes before each event of its type."""
    out = ws.trailing(tb.load(spark, d, "events").select("event_id", "event_type", "ts", "value"), "ts", "value", TRAILING, ["event_type"])
    digits = {"sum": 4, "range": 4, "std": 5}
    exact = ("count", "min", "max", "outlier_count")
    return out.drop("event_type", "ts", "value").withColumns({f"{s}_{n}": rnd(f"{s}_{n}", digits.get(s, 6)) for n in TRAILING for s in STATISTICS if s not in exact})


_SLIDE = "SELECT event_type, value, unnest([time_bucket(INTERVAL 30 MINUTES, ts) - i * INTERVAL 30 MINUTES for i in range(12)]) AS w FROM events WHERE value IS NOT NULL"


@query("str_sliding", f"""
SELECT w AS window_start, event_type, count(*) AS count, round(sum(value), 4) + 0.0 AS sum, round(avg(value), 6) + 0.0 AS mean, round(stddev_pop(value), 4) + 0.0 AS std, min(value) AS min, max(value) AS max,
 round(max(value) - min(value), 4) + 0.0 AS range, true AS quantiles_near, true AS outliers_near FROM ({_SLIDE}) GROUP BY ALL""")
def str_sliding(spark, d):
    """Six-hour windows every half hour on a stream. Quantiles come from sketches: their ranks among the window's rows are checked against the stated error."""
    stream = ig.table_stream(spark, d, "events")
    found = drained_in_time(stream, "ts", lambda s: ws.window_statistics(s, "ts", "value", "6 hours", "30 minutes", keys=("event_type",)), f"{work_folder(spark)}/out")
    rows = tb.load(spark, d, "events").where("value IS NOT NULL").select("event_type", "value", F.window(F.col("ts").cast("timestamp"), "6 hours", "30 minutes")["start"].alias("window_start"))
    low, high = F.col("p25") - 1.5 * F.col("iqr"), F.col("p75") + 1.5 * F.col("iqr")
    ranks = [F.count_if(F.col("value") < F.col(q)).alias(f"below_{q}") for q in _Q] + [F.count_if(F.col("value") <= F.col(q)).alias(f"upto_{q}") for q in _Q]
    truth = rows.join(found.select("window_start", "event_type", *_Q, low.alias("low"), high.alias("high")), ["window_start", "event_type"]).groupBy("window_start", "event_type").agg(
        *ranks, F.count_if((F.col("value") < F.col("low")) | (F.col("value") > F.col("high"))).alias("far"))
    near = F.lit(True)
    for q, p in _Q.items():  # the rank asked for lies among the ranks that rows equal to the quantile have, but for the error
        near = near & (F.col(f"below_{q}") <= (p + ws.RANK_ERROR) * F.col("count") + 1) & (F.col(f"upto_{q}") >= (p - ws.RANK_ERROR) * F.col("count") - 1)
    out = found.join(truth, ["window_start", "event_type"]).withColumns({"quantiles_near": near, "outliers_near": F.abs(F.col("outlier_count") - F.col("far")) <= 2 * ws.RANK_ERROR * F.col("count") + 1})
    return out.select(F.col("window_start").cast("timestamp_ntz").alias("window_start"), "event_type", "count", rnd("sum", 4).alias("sum"), rnd("mean").alias("mean"), rnd("std", 4).alias("std"), "min", "max",
                      rnd("range", 4).alias("range"), "quantiles_near", "outliers_near")


# Four files: up to the 10th; from the 20th but for a fifth of the last days; a tenth of these; and the rest, most of it behind the
# watermark by then. Spark drops rows by the watermark that held in the batch before, so the third file lets that of the second take effect.
LAST = "ts >= TIMESTAMP '2024-01-26 00:00:00' AND event_id % 10"
FILES = {"a": "ts < TIMESTAMP '2024-01-11 00:00:00'", "b": f"ts >= TIMESTAMP '2024-01-20 00:00:00' AND NOT ({LAST} < 2)", "m": f"{LAST} = 1"}
FILES["c"] = " AND NOT ".join(f"({rows})" for rows in ("TRUE", *FILES.values()))


@query("str_late_rows", f"""
SELECT time_bucket(INTERVAL 1 DAY, ts) AS window_start, event_type AS metric, count(value) AS count, round(sum(value), 4) + 0.0 AS sum
FROM (SELECT *, ({FILES['c']}) AS late, max(ts) FILTER (({FILES['a']}) OR ({FILES['b']})) OVER () AS top FROM events)
WHERE NOT late OR time_bucket(INTERVAL 1 DAY, ts) + INTERVAL 1 DAY > date_trunc('milliseconds', top) - INTERVAL 5 DAYS GROUP BY ALL""")
def str_late_rows(spark, d):
    """Daily windows of a stream of four files; rows of the last one count only where their window is still open."""
    base = work_folder(spark)
    events = tb.load(spark, d, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    for rows in FILES.values():
        # Each part is a batch of its own, of as many files as its rows make.
        events.where(rows).write.mode("append").parquet(f"{base}/events")
        stream = ig.file_stream(spark, f"{base}/events", events.schema)
        out = ig.drained(spark, ws.tumbling(stream, "ts", "event_type", "value", slide="1 day", keep="5 days"), f"{base}/out", "update")
    out = ig.newest_update(out, ["window_start", "metric"])
    return out.select(F.col("window_start").cast("timestamp_ntz").alias("window_start"), "metric", "count", rnd("sum", 4).alias("sum"))


DAYS = {"6hour": 21600, "12hour": 43200, "1day": 86400}


@query("str_patterns", with_views("""
SELECT window_end, round(avg_mean, 6) AS avg_mean, round(avg_std, 6) AS avg_std, CASE WHEN m1 > m0 * 1.1 THEN 'increasing' WHEN m1 < m0 * 0.9 THEN 'decreasing' ELSE 'stable' END AS trend,
  CASE WHEN avg_std > avg_mean * 0.3 THEN 'high' WHEN avg_std < avg_mean * 0.1 THEN 'low' ELSE 'normal' END AS volatility FROM
 (SELECT e AS window_end, count(*) AS n, avg(m) AS avg_mean, avg(s) AS avg_std, max(m) FILTER (k = '6hour') AS m0, max(m) FILTER (k = '1day') AS m1 FROM w GROUP BY 1) WHERE n = 3""",
    w=union(f"SELECT '{n}' AS k, time_bucket(INTERVAL {s} SECONDS, ts) + INTERVAL {s} SECONDS AS e, avg(value) AS m, stddev_pop(value) AS s FROM events GROUP BY 2" for n, s in DAYS.items())))
def str_patterns(spark, d):
    out = ws.patterns(ws.multi_window(tb.load(spark, d, "events"), "ts", "value", DAYS), DAYS)
    return out.withColumns({"window_end": F.col("window_end").cast("timestamp_ntz"), "avg_mean": rnd("avg_mean"), "avg_std": rnd("avg_std")})


@query("str_forecast", """
SELECT user_id, count(*) AS points, round(regr_intercept(value, x), 5) + 0.0 AS next_value, round(regr_slope(value, x), 5) + 0.0 AS trend_slope, round(greatest(0, least(1, regr_r2(value, x))), 5) + 0.0 AS confidence FROM
 (SELECT user_id, value, -row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS x FROM events) WHERE x >= -10 GROUP BY 1 HAVING count(*) >= 3""")
def str_forecast(spark, d):
    out = ws.forecast(tb.load(spark, d, "events"), "value", ["user_id"], EV)
    return out.withColumns({c: rnd(c, 5) for c in ("next_value", "trend_slope", "confidence")})


@query("str_trend_thirds", """
SELECT user_id, n, round(a, 6) AS first_third, round(b, 6) AS last_third, CASE WHEN n < 3 THEN 'insufficient_data' WHEN b > a * 1.1 THEN 'upward' WHEN b < a * 0.9 THEN 'downward' ELSE 'stable' END AS trend FROM
 (SELECT user_id, max(c) AS n, avg(value) FILTER (rn <= c // 3) AS a, avg(value) FILTER (rn > c - ceil(c / 3.0::DOUBLE)) AS b FROM
  (SELECT user_id, value, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS rn, count(*) OVER (PARTITION BY user_id) AS c FROM events) GROUP BY 1)""")
def str_trend_thirds(spark, d):
    out = ws.trend_thirds(tb.load(spark, d, "events"), "value", ["user_id"], EV)
    return out.withColumns({"first_third": rnd("first_third"), "last_third": rnd("last_third")})


_ZW = "OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN 99 PRECEDING AND CURRENT ROW)"
_ZSQL = f"""SELECT event_id, user_id, round(score, 6) + 0.0 AS anomaly_score, score > 2.5 AS is_anomaly FROM
 (SELECT event_id, user_id, CASE WHEN count(value) {_ZW} > 2 AND stddev_pop(value) {_ZW} > 0 THEN abs(value - avg(value) {_ZW}) / stddev_pop(value) {_ZW} ELSE 0 END AS score FROM events)"""


@query("str_zscore", _ZSQL)
def str_zscore(spark, d):
    out = ws.rolling_zscore(tb.load(spark, d, "events"), "value", ["user_id"], EV)
    return out.select("event_id", "user_id", rnd("anomaly_score").alias("anomaly_score"), "is_anomaly")


@query("str_zscore_state", _ZSQL)
def str_zscore_state(spark, d):
    """The stream form with per-key state gives the rows of the batch form. A user has few events, so slices are a quarter of a year long."""
    out = drained_in_time(ig.table_stream(spark, d, "events"), "ts", lambda s: zscore_stream(s, "user_id", "ts", "value", "event_id", slice_seconds=90 * 86_400), f"{work_folder(spark)}/out")
    return out.select("event_id", "user_id", rnd("anomaly_score").alias("anomaly_score"), "is_anomaly")


@query("str_batch_summary", """
SELECT count(*) AS "rows", count(value) AS valid_rows, round(avg(value), 6) AS value_mean, round(stddev_pop(value), 6) AS value_std, min(value) AS value_min, max(value) AS value_max,
  round((SELECT avg((abs(value - m) / s > 3)::INT) FROM events, (SELECT avg(value) AS m, stddev_pop(value) AS s FROM events) q), 6) AS anomaly_rate FROM events""")
def str_batch_summary(spark, d):
    out = ig.drained(spark, ig.table_stream(spark, d, "events"), work_folder(spark), transform=lambda b: ws.batch_summary(b, ["value"]))
    return out.drop("batch_id").withColumns({c: rnd(c) for c in ("value_mean", "value_std", "anomaly_rate")})


@query("str_score")
def str_score(spark, d):
    """A fitted model scores the stream of the same table."""
    model = md.train_forest(labelled(spark, d), X, "label", trees=5, depth=4)
    scored = md.score(ig.table_stream(spark, d, "lineitem"), model, "forest").select("l_orderkey", "l_linenumber", "prediction", "model_id", "model_version")
    return ig.drained(spark, scored, work_folder(spark)).drop("batch_id")


@query("str_ema", with_views("""
SELECT event_id, round(m, 5) + 0.0 AS value_ema_mean, round(sqrt(pow(0.9, len(g) - 1) + list_sum([CASE WHEN i = 1 THEN 0 ELSE 0.1 * pow(0.9, len(g) - i) * g[i] END for i in range(1, len(g) + 1)])), 5) + 0.0 AS value_ema_std
FROM (SELECT event_id, m, list((value - m) * (value - m)) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS g FROM a)""", a="""
SELECT event_id, user_id, ts, value, list_sum([CASE WHEN i = 1 THEN 0 ELSE 0.1 * pow(0.9, len(xs) - i) * xs[i] END for i in range(1, len(xs) + 1)]) AS m FROM
 (SELECT *, list(value) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS xs FROM events)"""))
def str_ema(spark, d):
    out = ema_features(tb.load(spark, d, "events").select("event_id", "user_id", "ts", "value"), "value", ["user_id"], EV)
    return out.select("event_id", rnd("value_ema_mean", 5).alias("value_ema_mean"), rnd("value_ema_std", 5).alias("value_ema_std"))


# The detectors' rules as recursions over the errors of a type in order; each restarts after a drift.
_DRIFT_SQL = """WITH RECURSIVE e AS MATERIALIZED (SELECT event_type AS k, event_id, (value > 20)::INT::DOUBLE AS x, row_number() OVER (PARTITION BY event_type ORDER BY ts, event_id) AS i FROM events WHERE value IS NOT NULL),
ddm AS (
 SELECT event_type AS k, 0::BIGINT AS i, NULL::BIGINT AS event_id, 0::BIGINT AS n, 0.0::DOUBLE AS p, 'infinity'::DOUBLE AS lp, 'infinity'::DOUBLE AS ls, 'stable' AS state FROM events GROUP BY 1
 UNION ALL
 SELECT k, i, event_id, CASE WHEN drift THEN 0 ELSE n END, CASE WHEN drift THEN 0.0 ELSE p END, CASE WHEN drift THEN 'infinity'::DOUBLE ELSE lp END, CASE WHEN drift THEN 'infinity'::DOUBLE ELSE ls END,
  CASE WHEN n < 30 THEN 'stable' WHEN drift THEN 'drift' WHEN p + s > lp + 2 * ls THEN 'warning' ELSE 'stable' END
 FROM (SELECT *, n >= 30 AND p + s > lp + 3 * ls AS drift FROM
  (SELECT *EXCLUDE (lp, ls), CASE WHEN n >= 30 AND p + s <= lp + ls THEN p ELSE lp END AS lp, CASE WHEN n >= 30 AND p + s <= lp + ls THEN s ELSE ls END AS ls FROM
   (SELECT *, sqrt(greatest(p * (1 - p), 0.0) / n) AS s FROM (SELECT e.k, e.i, e.event_id, d.n + 1 AS n, d.p + (e.x - d.p) / (d.n + 1) AS p, d.lp, d.ls FROM ddm d JOIN e ON e.k = d.k AND e.i = d.i + 1))))),
ph AS (
 SELECT event_type AS k, 0::BIGINT AS i, NULL::BIGINT AS event_id, 0::BIGINT AS n, 0.0::DOUBLE AS m, 0.0::DOUBLE AS t, false AS drift FROM events GROUP BY 1
 UNION ALL
 SELECT k, i, event_id, CASE WHEN n >= 30 AND t > 50 THEN 0 ELSE n END, CASE WHEN n >= 30 AND t > 50 THEN 0.0 ELSE m END, CASE WHEN n >= 30 AND t > 50 THEN 0.0 ELSE t END, n >= 30 AND t > 50
 FROM (SELECT *, greatest(0.0, 0.9999::DOUBLE * t0 + (x - m - 0.005::DOUBLE)) AS t FROM
  (SELECT e.k, e.i, e.event_id, e.x, p.n + 1 AS n, p.m + (e.x - p.m) / (p.n + 1) AS m, p.t AS t0 FROM ph p JOIN e ON e.k = p.k AND e.i = p.i + 1)))
SELECT event_id, k AS event_type, state, 'ddm' AS detector FROM ddm WHERE state <> 'stable' UNION ALL SELECT event_id, k, 'drift', 'page_hinkley' FROM ph WHERE drift"""


@query("str_error_drift", _DRIFT_SQL)
def str_error_drift(spark, d):
    """Both detectors over the events of each type in the order of their times."""
    ev = ig.table_stream(spark, d, "events").withColumn("error", (F.col("value") > 20).cast("double"))
    out = None
    for name in ("ddm", "page_hinkley"):
        rows = drained_in_time(ev, "ts", lambda s: error_drift_stream(s, "event_type", "ts", "error", "event_id", name), f"{work_folder(spark)}/out")
        rows = rows.withColumn("detector", F.lit(name))
        out = rows if out is None else out.unionByName(rows)
    return out


@query("str_progress", "SELECT 'events_progress' AS name, count(*) AS input_rows, NULL::VARCHAR AS error FROM events")
def str_progress(spark, d):
    """Rows counted by the progress of a drained query; throughput depends on the machine and is left out."""
    log = ig.ProgressLog()
    spark.streams.addListener(log)
    try:
        q = ig.drain(ig.table_stream(spark, d, "events"), work_folder(spark), name="events_progress")
        log.wait(q.runId)
    finally:
        spark.streams.removeListener(log)
    return spark.createDataFrame(log.rows(), ig.TOTALS).where("name = 'events_progress'").select("name", "input_rows", "error")


@query("str_user_fn", "SELECT event_id, value * 2 AS doubled, upper(event_type) AS kind FROM events")
def str_user_fn(spark, d):
    """A user function over the batches of messages, on executors."""
    def run(batches):
        for pdf in batches:
            yield pd.DataFrame({"event_id": pdf["event_id"], "doubled": pdf["value"] * 2, "kind": pdf["event_type"].str.upper()})

    stream = ig.table_stream(spark, d, "events").select("event_id", "value", "event_type").mapInPandas(run, "event_id bigint, doubled double, kind string")
    return ig.drained(spark, stream, work_folder(spark)).drop("batch_id")


def _event_rows(spark, d):
    return tb.load(spark, d, "events").withColumn("label", (F.col("event_type") == "purchase").cast("double")).withColumn("user", F.col("user_id").cast("double"))


def _event_batches(spark, d, parts: int = 8):
    """events cut by time into files, one file per batch."""
    path = f"{work_folder(spark)}/events"
    _event_rows(spark, d).repartitionByRange(parts, "ts").write.parquet(path)
    return ig.file_stream(spark, path, spark.read.parquet(path).schema, files_per_batch=1)


@query("str_prequential")
def str_prequential(spark, d):
    base = work_folder(spark)
    model = OnlineLogistic(["value", "user"], "label")
    rows = prequential(_event_batches(spark, d), model, f"{base}/checkpoint")
    return spark.createDataFrame(rows, "batch bigint, rows bigint, accuracy double")


@query("str_incremental")
def str_incremental(spark, d):
    """A model that is stopped after some batches and goes on from its saved state in a second run."""
    base = work_folder(spark)
    model = lambda: OnlineLogistic(["value", "user"], "label", replay_path=f"{base}/replay", state_path=f"{base}/state")
    stream = _event_batches(spark, d)
    first = model()

    def half(batch, batch_id):
        if batch_id < 4:
            first.learn(batch, batch_id)

    stream.writeStream.trigger(availableNow=True).option("checkpointLocation", f"{base}/first").foreachBatch(half).start().awaitTermination()
    second = model().restore(spark)
    prequential(stream, second, f"{base}/second")  # reads all batches again; those learned already are passed over
    return second.predict(tb.load(spark, d, "events").withColumn("user", F.col("user_id").cast("double"))).select("event_id", "proba", "prediction")


@query("str_replay", "SELECT 500::BIGINT AS n, true AS from_every_batch")
def str_replay(spark, d):
    """Size of the replay buffer after a whole stream, and whether every batch is in it."""
    base = work_folder(spark)
    model = OnlineLogistic(["value", "user"], "label", steps=1, replay_path=f"{base}/replay", buffer_size=500, state_path=f"{base}/state")
    prequential(_event_batches(spark, d), model, f"{base}/checkpoint")
    kept = model.buffer(spark).select("value", "user", "label")
    rows = _event_rows(spark, d).join(kept.groupBy("value", "user", "label").agg(F.count("*").alias("k")), ["value", "user", "label"])
    seen = rows.agg(F.countDistinct(F.floor(F.unix_micros(F.col("ts").cast("timestamp")) / 432_000_000_000)).alias("spans")).first()["spans"]
    return kept.agg(F.count("*").alias("n")).withColumn("from_every_batch", F.lit(seen >= 6))
