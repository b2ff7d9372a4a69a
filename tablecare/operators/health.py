"""Model health, alerts, usage, bills and audit summaries over log tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tablecare.functions.columns import melt_row
from tablecare.functions.ordered import quantiles
from tablecare.functions.params import attach


def quality_trend(checks: DataFrame, last: int = 10) -> DataFrame:
    """Scores and issue counts of the newest checks; ``checks`` has at, score and an array of issues."""
    recent = checks.orderBy(F.desc("at")).limit(last)
    issues = F.aggregate(
        F.flatten(F.collect_list("issues")), F.create_map().cast("map<string,bigint>"),
        lambda m, x: F.map_concat(F.map_filter(m, lambda k, v: k != x),
                                  F.create_map(x, F.coalesce(F.try_element_at(m, x), F.lit(0).cast("bigint")) + 1)))
    return recent.agg(F.count(F.lit(1)).alias("checks"), F.avg("score").alias("avg_score"), F.min("score").alias("min_score"),
                      F.max("score").alias("max_score"), issues.alias("issues"))


def job_metrics(predictions: DataFrame, bins: int | None = None) -> DataFrame:
    """Totals, distribution and statistics of a prediction table: (part, value, metric, amount).

    The distribution has a count per prediction, or, with ``bins`` (for continuous predictions), per range of equal width, named by its low end.
    """
    pred = F.col("prediction").cast("double")
    proba = [c for c in predictions.columns if c.startswith("proba_")]
    aggs = {"prediction": {"total": F.count(F.lit(1)), "mean": F.avg(pred), "std": F.stddev_samp(pred),
                           "min": F.min(pred), "max": F.max(pred)}}
    for c in proba:
        aggs[c] = {"mean": F.avg(c), "std": F.stddev_samp(c), "min": F.min(c), "max": F.max(c)}
    if "prediction_error" in predictions.columns:
        aggs["job"] = {"error_rate": F.count("prediction_error") / F.count(F.lit(1))}
    flat = [(p, m, c) for p, ms in aggs.items() for m, c in ms.items()]
    row = predictions.agg(*[c.cast("double").alias(f"v{i}") for i, (_, _, c) in enumerate(flat)])
    stats = row.select(F.explode(F.array(*[
        F.struct(F.lit(p).alias("part"), F.lit(None).cast("string").alias("value"), F.lit(m).alias("metric"),
                 F.col(f"v{i}").alias("amount")) for i, (p, m, _) in enumerate(flat)])).alias("r")).select("r.*")
    middle = quantiles(predictions, ["prediction"], [0.5])["prediction"][0]
    median = predictions.sparkSession.createDataFrame([("prediction", None, "median", middle)], stats.schema)
    value = F.col("prediction").cast("string")
    if bins:
        low, high = predictions.agg(F.min(pred), F.max(pred)).first()
        if low is not None:
            width = (high - low) / bins or 1.0
            value = (F.lit(low) + F.least(F.floor((pred - F.lit(low)) / F.lit(width)), F.lit(bins - 1)) * F.lit(width)).cast("string")
    counts = predictions.groupBy(value.alias("value")).agg(F.count(F.lit(1)).cast("double").alias("amount"))
    return stats.unionByName(median).unionByName(counts.select(F.lit("prediction").alias("part"), "value", F.lit("count").alias("metric"), "amount"))


# Metric, test, threshold, alert name, severity.
ALERT_RULES = [
    ("accuracy", "<", 0.8, "low_accuracy", "high"),
    ("drift_score", ">", 0.5, "data_drift", "medium"),
    ("latency", ">", 1.0, "high_latency", "medium"),
    ("quality_score", "<", 70.0, "poor_data_quality", "high"),
    ("billing_amount", ">", 1000.0, "high_billing", "high"),
]


def check_alerts(metrics: DataFrame, rules=ALERT_RULES) -> DataFrame:
    """Triggered alerts of metric rows: one array of hits per row, exploded; no rule join."""
    hits = []
    for name, test, limit, alert, severity in rules:
        if name in metrics.columns:
            c = F.col(name)
            hit = c < limit if test == "<" else c > limit
            hits.append(F.when(hit, F.struct(F.lit(alert).alias("alert"), F.lit(severity).alias("severity"),
                                             c.cast("double").alias("value"), F.lit(float(limit)).alias("threshold"))))
    names = {r[0] for r in rules}
    keys = [c for c in metrics.columns if c not in names]
    return metrics.select(*keys, F.explode(F.array_compact(F.array(*hits))).alias("a")).select(*keys, "a.*")


def alert_summary(alerts: DataFrame) -> DataFrame:
    return alerts.groupBy("alert", "severity").agg(F.count(F.lit(1)).alias("n"))


def user_activity(events: DataFrame, user: int, since, last: int = 10) -> tuple[DataFrame, DataFrame]:
    """Counts by type since a time, and the newest events of a user."""
    mine = events.where((F.col("user_id") == user) & (F.col("ts") >= F.lit(since).cast(events.schema["ts"].dataType)))
    counts = mine.groupBy("event_type").agg(F.count(F.lit(1)).alias("n"))
    return counts, mine.orderBy(F.desc("ts"), F.desc("event_id")).limit(last)


# Plan, monthly price, predictions a month, calls a day, storage GB, GPU hours; -1 has no limit.
PLANS = [
    ("trial", 0.0, 500, 50, 0, 0),
    ("free", 0.0, 1000, 100, 1, 0),
    ("starter", 49.0, 10000, 1000, 10, 0),
    ("professional", 299.0, 100000, 10000, 100, 10),
    ("enterprise", 999.0, -1, -1, 1000, 100),
]
PLAN_SCHEMA = "plan string, monthly_price double, max_predictions bigint, max_calls bigint, max_storage bigint, max_gpu bigint"
# Price per unit over the limit.
OVERAGE = {"calls": 0.001, "predictions": 0.01, "gpu_hours": 2.0, "storage": 0.1}


def plan_table(spark: SparkSession) -> DataFrame:
    return F.broadcast(spark.createDataFrame(PLANS, PLAN_SCHEMA))


def usage(events: DataFrame, tenant: str, period: str, measures: dict[str, Column]) -> DataFrame:
    """Totals per tenant and period start."""
    return events.groupBy(F.col(tenant).alias("tenant"), F.date_trunc(period, "ts").alias("period")).agg(
        *[c.alias(n) for n, c in measures.items()])


def bills(usage_rows: DataFrame, subscriptions: DataFrame) -> DataFrame:
    """Base price and overage of each subscribed tenant; a limit of zero or less charges nothing."""
    spark = usage_rows.sparkSession
    joined = subscriptions.join(plan_table(spark), "plan").join(usage_rows, "tenant", "left")

    def over(use: str, limit: str, rate: float) -> Column:
        u = F.coalesce(F.col(use).cast("double"), F.lit(0.0))
        return F.when((F.col(limit) > 0) & (u > F.col(limit)), (u - F.col(limit)) * rate).otherwise(0.0)

    limits = {"calls": "max_calls", "predictions": "max_predictions", "gpu_hours": "max_gpu", "storage": "max_storage"}
    parts = [over(u, lim, OVERAGE[u]) for u, lim in limits.items() if u in usage_rows.columns]
    extra = parts[0]
    for p in parts[1:]:
        extra = extra + p
    return joined.withColumn("overage", extra).withColumn("total", F.col("monthly_price") + F.col("overage"))


def performance_summary(log: DataFrame, keys: list[str], as_of: Column, days: int = 7) -> DataFrame:
    """Averages of the last days, drift rate, first and newest accuracy, degradation and status per model."""
    recent = F.col("ts") > as_of - F.expr(f"INTERVAL {days} DAYS")
    acc = F.when(recent, F.col("accuracy"))
    drift = F.avg(F.when(recent, F.col("drifted").cast("double")))
    out = log.groupBy(*keys).agg(
        F.count_if(recent).alias("records"),
        F.avg(acc).alias("avg_accuracy"), F.min(acc).alias("min_accuracy"), F.max(acc).alias("max_accuracy"),
        F.coalesce(drift, F.lit(0.0)).alias("drift_rate"),
        F.min_by("accuracy", "ts").alias("baseline_accuracy"), F.max_by("accuracy", "ts").alias("current_accuracy"))
    status = F.when(F.col("records") == 0, "no_data").when(F.col("avg_accuracy") < 0.8, "degraded").when(
        F.col("drift_rate") > 0.2, "drift_detected").otherwise("healthy")
    return out.withColumn("degradation", F.col("baseline_accuracy") - F.col("current_accuracy")).withColumn("status", status)


def retrain_decision(models: DataFrame, drift_cut=0.5, loss_cut=0.1, floor=0.8, min_rows=1000, max_age=30) -> DataFrame:
    """Reasons to retrain from drift score, accuracy loss, accuracy floor, new rows and age in days."""
    loss = F.when(F.col("baseline_accuracy") > 0,
                  (F.col("baseline_accuracy") - F.col("current_accuracy")) / F.col("baseline_accuracy")).otherwise(0.0)
    reasons = F.concat_ws(
        ";", F.when(F.col("drift_score") > drift_cut, "drift"), F.when(loss > loss_cut, "degradation"),
        F.when(F.col("current_accuracy") < floor, "accuracy_floor"), F.when(F.col("new_rows") > min_rows, "new_data"),
        F.when(F.col("age_days") > max_age, "age"))
    return models.withColumn("loss", loss).withColumn("reasons", reasons).withColumn("retrain", F.length("reasons") > 0)


def retrain_stats(runs: DataFrame) -> DataFrame:
    """Success share and mean duration of retraining runs (status, start_time, end_time)."""
    secs = F.unix_micros(F.col("end_time").cast("timestamp")) - F.unix_micros(F.col("start_time").cast("timestamp"))
    n = F.count(F.lit(1))
    good = F.count_if(F.col("status") == "success")
    return runs.agg(n.alias("total"), good.alias("successful"), F.count_if(F.col("status") == "failed").alias("failed"),
                    (good / n).alias("success_rate"), (F.avg(secs) / 1e6).alias("avg_seconds"))


# Unit prices and priority factors of a scoring job.
UNIT_COST = {"cpu_hours": 0.05, "memory_gb_hours": 0.01, "predictions": 0.01 / 1000, "storage_gb": 0.023}
PRIORITY = {"low": 0.8, "normal": 1.0, "high": 1.5, "critical": 2.0}


def job_cost(jobs: DataFrame) -> DataFrame:
    """Cost of each job row from its resource totals and its priority."""
    base = sum((F.coalesce(F.col(c).cast("double"), F.lit(0.0)) * p for c, p in UNIT_COST.items() if c in jobs.columns), F.lit(0.0))
    factor = F.lit(1.0)
    for name, f in PRIORITY.items():
        factor = F.when(F.col("priority") == name, f).otherwise(factor)
    return jobs.withColumn("cost", F.round(base * factor, 4))


def compare_versions(a: DataFrame, b: DataFrame) -> DataFrame:
    """Metric rows (metric, value) of two versions: differences, relative changes, absent metrics as 0."""
    a = a.select("metric", F.col("value").alias("value_a"))
    b = b.select("metric", F.col("value").alias("value_b"))
    both = a.join(b, "metric", "full_outer")
    va, vb = F.coalesce("value_a", F.lit(0.0)), F.coalesce("value_b", F.lit(0.0))
    return both.select("metric", va.alias("value_a"), vb.alias("value_b"), (vb - va).alias("diff"),
                       F.when(F.col("value_a") != 0, (vb - va) / F.col("value_a")).alias("relative"))


def version_verdict(diffs: DataFrame, cost_diff: float = 0.0, efficiency: float = 1.0) -> DataFrame:
    """Mean relative improvement and the recommendation it gives."""
    rate = F.coalesce(F.avg("relative"), F.lit(0.0))
    return diffs.agg(rate.alias("improvement")).withColumn(
        "recommendation",
        F.when(F.col("improvement") > 0.1, "strongly_b").when((F.col("improvement") > 0) & F.lit(cost_diff <= 0), "b")
        .when((F.col("improvement") > 0.05) & F.lit(efficiency > 1), "b_for_value").otherwise("a"))


def compliance(requests: DataFrame, consents: DataFrame) -> DataFrame:
    """Completion rate and mean days per request type, grant rate, and the score from 100, from real rows."""
    by_type = requests.groupBy("request_type").agg(
        F.count(F.lit(1)).alias("total"), F.count_if(F.col("completed")).alias("completed"),
        F.avg("days").alias("avg_days"))
    by_type = by_type.withColumn("completion_rate", F.col("completed") / F.col("total"))
    loss = F.sum((1 - F.col("completion_rate")) * 50 + F.when(F.col("avg_days") > 30, 10).otherwise(0))
    score = by_type.agg(F.coalesce(loss, F.lit(0.0)).alias("loss"))
    grant = consents.agg(F.coalesce(F.avg(F.col("granted").cast("double")) * 100, F.lit(0.0)).alias("grant_rate")).first()[0]
    bonus = 5 if grant > 80 else 0
    total = score.select(F.greatest(F.lit(0.0), F.least(F.lit(100.0), 100 - F.col("loss") + bonus)).alias("score"))
    per = by_type.select(F.col("request_type").alias("item"), "total", "completed", "completion_rate", "avg_days")
    none = F.lit(None)
    return per.unionByName(total.select(F.lit("score").alias("item"), none.cast("bigint").alias("total"), none.cast("bigint").alias("completed"),
                                        F.col("score").alias("completion_rate"), F.lit(float(grant)).alias("avg_days")))


def shadow_check(log: DataFrame, keys: list[str]) -> DataFrame:
    """Mean latency, error rate and accuracy against 1000 ms, 1% and 0.8; the last failing limit is the reason."""
    out = log.groupBy(*keys).agg(F.count(F.lit(1)).alias("predictions"), F.avg("latency_ms").alias("avg_latency_ms"),
                                 F.avg(F.col("error").cast("double")).alias("error_rate"), F.avg("accuracy").alias("avg_accuracy"))
    reason = F.when(F.col("avg_accuracy") < 0.8, "accuracy").when(F.col("avg_latency_ms") > 1000, "latency").when(
        F.col("error_rate") > 0.01, "errors")
    return out.withColumn("reason", reason).withColumn("acceptable", F.col("reason").isNull())
