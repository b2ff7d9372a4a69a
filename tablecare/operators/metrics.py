"""Evaluation metrics and tests; every metric is an aggregate over rows or over counts per class or score."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tablecare.functions.columns import hash_bucket
from tablecare.functions.ordered import running
from tablecare.functions.tails import chi2_p, normal_p, t_p
from tablecare.operators.drift import chi2_table
from tablecare.session import settle


def _div(a: Column, b: Column) -> Column:
    """Zero where the divisor is zero."""
    return F.when(b != 0, a / F.nullif(b, F.lit(0))).otherwise(0.0)


def confusion(df: DataFrame, y: str, pred: str) -> DataFrame:
    return df.groupBy(F.col(y).alias("y"), F.col(pred).alias("pred")).agg(F.count(F.lit(1)).alias("n"))


def classification(df: DataFrame, y: str, pred: str) -> DataFrame:
    """Accuracy, and precision, recall and F1: of class 1 when binary, weighted and macro over all classes."""
    cm = confusion(df, y, pred)
    cells = cm.select(F.explode(F.array(
        F.struct(F.col("y").alias("c"), F.when(F.col("y") == F.col("pred"), F.col("n")).otherwise(0).alias("tp"), F.col("n").alias("sup"), F.lit(0).cast("bigint").alias("hit")),
        F.struct(F.col("pred").alias("c"), F.lit(0).cast("bigint").alias("tp"), F.lit(0).cast("bigint").alias("sup"), F.col("n").alias("hit")))).alias("r")).select("r.*")
    per = cells.groupBy("c").agg(F.sum("tp").alias("tp"), F.sum("sup").alias("sup"), F.sum("hit").alias("hit"))
    per = per.withColumns({"p": _div(F.col("tp"), F.col("hit")), "r": _div(F.col("tp"), F.col("sup"))})
    per = per.withColumn("f", _div(2 * F.col("p") * F.col("r"), F.col("p") + F.col("r")))
    n = F.sum("sup")
    aggs = [(F.sum("tp") / n).alias("accuracy"), F.count_if(F.col("sup") > 0).alias("classes")]
    for short, name in (("p", "precision"), ("r", "recall"), ("f", "f1")):
        aggs += [F.max(F.when(F.col("c") == 1, F.col(short))).alias(f"{name}_binary"),
                 (F.sum(F.col(short) * F.col("sup")) / n).alias(f"{name}_weighted"), F.avg(short).alias(f"{name}_macro")]
    return per.agg(*aggs)


def binary_counts(df: DataFrame, y: str, pred: str) -> DataFrame:
    hit = lambda a, b: F.count_if((F.col(y) == a) & (F.col(pred) == b))
    out = df.agg(hit(1, 1).alias("tp"), hit(0, 0).alias("tn"), hit(0, 1).alias("fp"), hit(1, 0).alias("fn"))
    spec, sens = _div(F.col("tn"), F.col("tn") + F.col("fp")), _div(F.col("tp"), F.col("tp") + F.col("fn"))
    return out.withColumns({"specificity": spec, "sensitivity": sens, "balanced_accuracy": (spec + sens) / 2})


def score_counts(df: DataFrame, y: str, score: str) -> DataFrame:
    """Counts per distinct score with running counts from the highest score down."""
    counts = df.groupBy(F.col(score).alias("score")).agg(F.count_if(F.col(y) == 1).alias("pos"), F.count_if(F.col(y) == 0).alias("neg"))
    return running(counts, [], ["score"], {"tp": ("sum", F.col("pos")), "fp": ("sum", F.col("neg"))}, descending=True)


def auc(df: DataFrame, y: str, score: str) -> DataFrame:
    """Area under the ROC curve from counts per score: pairs won, ties for half."""
    cum = score_counts(df, y, score)
    # Positives strictly above a score beat its negatives; those at the score tie.
    won = F.sum(F.col("neg") * ((F.col("tp") - F.col("pos")) + F.col("pos") / 2.0))
    return cum.agg((won / (F.sum("pos") * F.sum("neg"))).alias("roc_auc"))


def log_loss(y: str, proba: str, eps: float = 1e-15) -> Column:
    p = F.least(F.greatest(F.col(proba), F.lit(eps)), F.lit(1 - eps))
    return -F.avg(F.when(F.col(y) == 1, F.ln(p)).otherwise(F.ln(1 - p)))


def auc_one_vs_rest(df: DataFrame, y: str, proba: dict) -> DataFrame:
    """AUC of each class score against the rest; one keyed pass for all classes."""
    parts = F.array(*[F.struct(F.lit(k).alias("cls"), (F.col(y) == k).cast("int").alias("hit"), F.col(c).alias("score")) for k, c in proba.items()])
    counts = df.select(F.explode(parts).alias("r")).groupBy("r.cls", "r.score").agg(
        F.count_if(F.col("r.hit") == 1).alias("pos"), F.count_if(F.col("r.hit") == 0).alias("neg"))
    cum = running(counts, ["cls"], ["score"], {"tp": ("sum", F.col("pos"))}, descending=True)
    won = F.sum(F.col("neg") * ((F.col("tp") - F.col("pos")) + F.col("pos") / 2.0))
    return cum.groupBy("cls").agg((won / (F.sum("pos") * F.sum("neg"))).alias("roc_auc"))


def regression(y: str, pred: str) -> dict[str, Column]:
    """Regression metrics as aggregates, all but the median error in one pass."""
    yt, res = F.col(y).cast("double"), (F.col(y) - F.col(pred)).cast("double")
    sq, ab = F.avg(res * res), F.abs(res)
    within = lambda t: F.avg((ab <= F.abs(yt) * t).cast("double"))
    return {
        "mse": sq, "rmse": F.sqrt(sq), "mae": F.avg(ab), "r2": 1 - F.sum(res * res) / (F.var_pop(yt) * F.count(yt)),
        "max_error": F.max(ab), "explained_variance": 1 - F.var_pop(res) / F.var_pop(yt),
        "mape": F.when(F.count_if(yt == 0) == 0, F.avg(ab / F.nullif(F.abs(yt), F.lit(0.0)))),
        "mean_residual": F.avg(res), "std_residual": F.stddev_pop(res),
        "within_5pct": within(0.05), "within_10pct": within(0.10), "within_20pct": within(0.20),
    }


def median_error(df: DataFrame, y: str, pred: str) -> float:
    from tablecare.functions.ordered import quantiles

    return quantiles(df.select(F.abs(F.col(y) - F.col(pred)).alias("e")), ["e"], [0.5])["e"][0]


def weighted_performance(y: str, pred: str, weight: str) -> dict[str, Column]:
    """Weighted accuracy for labels or errors for amounts; percent error leaves out zero actuals."""
    w, yt = F.col(weight).cast("double"), F.col(y).cast("double")
    res = yt - F.col(pred)
    mean = F.sum(w * yt) / F.sum(w)
    sse = F.sum(w * res * res)
    sst = F.sum(w * yt * yt) - F.sum(w) * mean * mean
    return {
        "mse": sse / F.sum(w), "mae": F.sum(w * F.abs(res)) / F.sum(w), "r2": 1 - sse / sst,
        "mape_pct": F.avg(F.when(yt != 0, F.abs(res) / F.nullif(F.abs(yt), F.lit(0.0)))) * 100,
    }


def compare(a: DataFrame, b: DataFrame) -> DataFrame:
    """Metric rows (metric, value) of two models: difference and percent change."""
    both = a.select("metric", F.col("value").alias("a")).join(b.select("metric", F.col("value").alias("b")), "metric", "full_outer")
    return both.withColumns({"diff": F.col("b") - F.col("a"),
                             "pct": F.when(F.col("a") != 0, (F.col("b") - F.col("a")) / F.abs("a") * 100)})


def as_rows(row: DataFrame, names: list[str]) -> DataFrame:
    return row.select(F.explode(F.array(*[F.struct(F.lit(n).alias("metric"), F.col(n).cast("double").alias("value")) for n in names])).alias("r")).select("r.*")


def mcnemar(df: DataFrame, y: str, a: str, b: str) -> DataFrame:
    """Rows only one model gets right, the corrected statistic and its tail."""
    ra, rb = F.col(y) == F.col(a), F.col(y) == F.col(b)
    out = df.agg(F.count_if(ra & ~rb).alias("only_a"), F.count_if(~ra & rb).alias("only_b"))
    n = F.col("only_a") + F.col("only_b")
    gap = F.abs(F.col("only_a") - F.col("only_b")) - 1
    out = out.withColumn("statistic", F.when(n > 0, gap * gap / F.nullif(n, F.lit(0))).otherwise(0.0))
    return out.withColumn("p_value", F.when(n > 0, chi2_p("statistic", F.lit(1.0))).otherwise(1.0))


def paired_t(df: DataFrame, a: Column, b: Column) -> DataFrame:
    """Paired t test of two residual columns; effect size and interval use the population deviation."""
    d = a - b
    out = df.agg(F.count(d).alias("n"), F.avg(d).alias("mean_difference"), F.stddev_samp(d).alias("_s"), F.stddev_pop(d).alias("_p"))
    root = F.sqrt(F.col("n").cast("double"))
    se = F.col("_p") / root
    out = out.withColumns({
        "statistic": F.col("mean_difference") / (F.col("_s") / root), "effect_size": _div(F.col("mean_difference"), F.col("_p")),
        "ci_lower": F.col("mean_difference") - 1.96 * se, "ci_upper": F.col("mean_difference") + 1.96 * se})
    return out.withColumn("p_value", t_p("statistic", (F.col("n") - 1).cast("double"))).drop("_s", "_p")


def arm_moments(df: DataFrame, arm: str, value: str, a, b) -> DataFrame:
    """One row with the moments of two arms."""
    aggs = []
    for s, k in (("a", a), ("b", b)):
        v = F.when(F.col(arm) == k, F.col(value).cast("double"))
        aggs += [F.count(v).alias(f"n_{s}"), F.avg(v).alias(f"mean_{s}"), F.var_samp(v).alias(f"_v{s}"), F.stddev_pop(v).alias(f"std_{s}")]
    return df.agg(*aggs)


def t_test(df: DataFrame, arm: str, value: str, a, b) -> DataFrame:
    """Two-sample t test with equal variances, Cohen d and the 1.96 interval from population variances."""
    m = arm_moments(df, arm, value, a, b)
    na, nb = F.col("n_a"), F.col("n_b")
    pooled = ((na - 1) * F.col("_va") + (nb - 1) * F.col("_vb")) / (na + nb - 2)
    gap = F.col("mean_b") - F.col("mean_a")
    va, vb = F.col("std_a") * F.col("std_a"), F.col("std_b") * F.col("std_b")
    se = F.sqrt(va / na + vb / nb)
    out = m.withColumns({
        "statistic": -gap / F.sqrt(pooled * (1 / na + 1 / nb)), "effect_size": _div(gap, F.sqrt((va + vb) / 2)),
        "ci_lower": gap - 1.96 * se, "ci_upper": gap + 1.96 * se})
    return out.withColumn("p_value", t_p("statistic", (na + nb - 2).cast("double"))).drop("_va", "_vb")


def mann_whitney(df: DataFrame, arm: str, value: str, a, b) -> DataFrame:
    """U of the first arm from mid-ranks of counts per value, with the tie-corrected normal tail."""
    rows = df.where(F.col(arm).isin(a, b) & F.col(value).isNotNull())
    counts = rows.groupBy(F.col(value).alias("v")).agg(F.count_if(F.col(arm) == a).alias("a"), F.count_if(F.col(arm) == b).alias("b"))
    cum = running(counts, [], ["v"], {"cum": ("sum", F.col("a") + F.col("b"))})
    ties = (F.col("a") + F.col("b")).cast("double")
    rank = F.col("cum") - (ties - 1) / 2
    out = cum.agg(F.sum("a").alias("n_a"), F.sum("b").alias("n_b"), F.sum(F.col("a") * rank).alias("_r"),
                  F.sum(ties * ties * ties - ties).alias("_t"))
    na, nb = F.col("n_a").cast("double"), F.col("n_b").cast("double")
    n = na + nb
    u = F.col("_r") - na * (na + 1) / 2
    sigma = F.sqrt(na * nb / 12 * ((n + 1) - F.col("_t") / (n * (n - 1))))
    z = (F.greatest(u, na * nb - u) - na * nb / 2 - 0.5) / sigma
    out = out.withColumns({"statistic": u, "effect_size": 1 - 2 * u / (na * nb), "z": z})
    return out.withColumn("p_value", F.least(F.lit(1.0), normal_p("z"))).drop("_r", "_t")


def chi_square(df: DataFrame, arm: str, outcome: str, a, b) -> DataFrame:
    """Chi-square of outcome counts by arm, with Cramer V (two arms, so the smaller side is one)."""
    counts = df.groupBy(F.col(outcome).alias("value")).agg(F.count_if(F.col(arm) == a).alias("n_a"), F.count_if(F.col(arm) == b).alias("n_b"))
    return chi2_table(counts.where("n_a + n_b > 0"), []).withColumn("cramers_v", F.sqrt(F.col("statistic") / F.col("n")))


def two_proportions(df: DataFrame, arm: str, success: Column, control, treatment) -> DataFrame:
    """z test of success rates and the winner at 95%."""
    is_c, is_t = F.col(arm) == control, F.col(arm) == treatment
    m = df.agg(F.count_if(is_c).alias("n_c"), F.count_if(is_t).alias("n_t"), F.count_if(is_c & success).alias("s_c"), F.count_if(is_t & success).alias("s_t"))
    pooled = (F.col("s_c") + F.col("s_t")) / (F.col("n_c") + F.col("n_t"))
    se = F.sqrt(pooled * (1 - pooled) * (1 / F.col("n_c") + 1 / F.col("n_t")))
    rc, rt = F.col("s_c") / F.col("n_c"), F.col("s_t") / F.col("n_t")
    out = m.withColumns({"rate_c": rc, "rate_t": rt, "z": F.when(se > 0, (rt - rc) / se)})
    out = out.withColumn("p_value", normal_p("z"))
    return out.withColumn("winner", F.when(F.col("p_value") < 0.05, F.when(F.col("rate_t") > F.col("rate_c"), "treatment").otherwise("control")))


def curve_points(df: DataFrame, y: str, score: str) -> DataFrame:
    """ROC and precision-recall points per distinct score."""
    cum = settle(score_counts(df, y, score))
    total = cum.agg(F.sum("pos").alias("p"), F.sum("neg").alias("n")).first()
    return cum.select("score", (F.col("fp") / F.lit(total["n"])).alias("fpr"), (F.col("tp") / F.lit(total["p"])).alias("tpr"),
                      (F.col("tp") / (F.col("tp") + F.col("fp"))).alias("precision"))


def pr_area(points: DataFrame) -> DataFrame:
    """Trapezoid area under precision over recall, from the point (0, 1) on.

    Each point needs the one before it; the running last value gives it without one long sort.
    """
    before = running(points.withColumn("_neg", -F.col("score")), [], ["_neg"], {"_n": ("sum", F.lit(1).cast("bigint"))})
    prev = before.select((F.col("_n") + 1).alias("_n"), F.col("tpr").alias("r0"), F.col("precision").alias("p0"))
    joined = before.join(prev, "_n", "left")
    r0, p0 = F.coalesce("r0", F.lit(0.0)), F.coalesce("p0", F.lit(1.0))
    return joined.agg(F.sum((F.col("tpr") - r0) * (F.col("precision") + p0) / 2).alias("pr_auc"))


def confidence(df: DataFrame, proba: list[str], threshold: float = 0.7) -> DataFrame:
    top = F.greatest(*[F.col(c) for c in proba]) if len(proba) > 1 else F.col(proba[0])
    return df.agg(F.avg(top).alias("mean_confidence"), F.stddev_pop(top).alias("std_confidence"), F.min(top).alias("min_confidence"),
                  F.max(top).alias("max_confidence"), F.avg((top >= threshold).cast("double")).alias("high_share"),
                  F.avg((top < threshold).cast("double")).alias("low_share"))


def route(df: DataFrame, key: str, share: float) -> DataFrame:
    """Arm by key bucket: the challenger gets the first ``share`` of 10000 buckets."""
    return df.withColumn("arm", F.when(hash_bucket(F.col(key)) < int(share * 10000), "challenger").otherwise("champion"))


def analyze_arms(df: DataFrame, arm: str, value: str, test: str = "t_test", level: float = 0.95, min_gain: float = 0.02,
                 min_samples: int = 100) -> DataFrame:
    """Arm moments and medians, the test, the improvement and the winner."""
    from tablecare.functions.ordered import quantiles

    fn = mann_whitney if test == "mann_whitney" else t_test
    tested = fn(df, arm, value, "champion", "challenger").select("statistic", "effect_size", "p_value").first()
    m = arm_moments(df, arm, value, "champion", "challenger").drop("_va", "_vb")
    split = df.select(F.when(F.col(arm) == "champion", F.col(value)).alias("a"), F.when(F.col(arm) == "challenger", F.col(value)).alias("b"))
    med = quantiles(split, ["a", "b"], [0.5])
    out = m.withColumns({
        **{k: F.lit(v) for k, v in tested.asDict().items()},
        "median_a": F.lit(med["a"][0]), "median_b": F.lit(med["b"][0]), "improvement": F.col("mean_b") - F.col("mean_a")})
    sure = (F.col("p_value") < 1 - level) & (F.col("n_a") >= min_samples) & (F.col("n_b") >= min_samples)
    return out.withColumn("winner", F.when(sure & (F.col("improvement") > min_gain), "challenger").when(sure & (F.col("improvement") < -min_gain), "champion"))
