"""Quality reports: rules over the column facts of a table, as small report tables."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tablecare.functions.columns import CODE_LENGTHS, CODE_WORDS, PRICE_WORDS, STOCK_WORDS, has_word
from tablecare.operators.profile import Facts

REPORT = "check string, column string, severity string, penalty double"

# Fixed thresholds of the checks.
MISSING_WARNING, MISSING_CRITICAL = 0.35, 0.50
OUTLIER_WARNING, OUTLIER_CRITICAL = 0.05, 0.15
CARDINALITY_HIGH = 0.9
MAX_CATEGORIES = 20


@dataclass
class Report:
    """Rows of findings and a score."""

    rows: list[tuple] = field(default_factory=list)
    score: float = 100.0
    state: str = "valid"

    def add(self, check: str, column: str | None, severity: str, penalty: float = 0.0) -> None:
        self.rows.append((check, column, severity, round(float(penalty), 6)))

    def table(self, spark: SparkSession) -> DataFrame:
        rows = [*self.rows, ("score", None, self.state, round(float(self.score), 6))]
        return spark.createDataFrame(rows, REPORT)


def preprocess_report(f: Facts) -> Report:
    """Duplicate, missing, constant, outlier and text checks with a score from 100."""
    r = Report()
    if not f.rows:
        r.add("empty", None, "issue", 100.0)
        r.score, r.state = 0.0, "invalid"
        return r
    issues, bad, penalty = 0, False, 0.0
    if f.duplicates:
        p = min(20.0, f.duplicate_share * 100)
        r.add("duplicate_rows", None, "warning", p)
        penalty += p
    twice = sorted({c for c in f.columns if f.columns.count(c) > 1})
    if twice:
        r.add("duplicate_columns", ",".join(twice), "issue", 10)
        penalty, issues, bad = penalty + 10, issues + 1, True
    for c in f.columns:
        share = f.missing_of(c)
        if share > 0.5:
            r.add("missing", c, "issue", 5)
            penalty, issues = penalty + 5, issues + 1
        elif share > 0.2:
            r.add("missing", c, "warning")
    empty = [c for c in f.columns if f.col[c]["missing"] == f.rows]
    for c in empty:
        r.add("all_null", c, "issue")
    constant = f.constant_columns()
    for c in constant:
        r.add("constant", c, "issue", 2)
    penalty += 2 * len(constant)
    issues += bool(empty) + bool(constant)
    bad = bad or bool(empty) or bool(constant)
    for c in f.numeric:
        if f.outlier_share(c) > 0.1:
            r.add("outliers", c, "warning")
    for c in f.text:
        if f.col[c]["distinct"] > MAX_CATEGORIES:
            r.add("high_cardinality", c, "warning")
        if f.col[c]["distinct"] and not f.col[c]["words_only"]:
            r.add("numeric_text", c, "warning")
    r.score = max(0.0, 100.0 - penalty)
    r.state = "invalid" if bad or r.score < 50 or issues > 5 else "valid"
    return r


def assessment(f: Facts, target: dict | None = None) -> Report:
    """Nine checks with alerts and warnings; ``target`` carries imbalance and missing counts if given."""
    r = Report()
    penalty = 0.0

    def hit(check, column, severity, points=0.0):
        nonlocal penalty
        r.add(check, column, severity, points)
        penalty += points

    for c in f.columns:
        share = f.missing_of(c)
        if share > MISSING_CRITICAL:
            hit("missing", c, "critical", 15)
        elif share > MISSING_WARNING:
            hit("missing", c, "medium", 5)
    for c in f.numeric:
        share = f.outlier_share(c)
        if share > OUTLIER_CRITICAL:
            hit("outliers", c, "high", 5)
        elif share > OUTLIER_WARNING:
            hit("outliers", c, "medium", 2)
    for c in f.text:
        if f.distinct_share(c) > CARDINALITY_HIGH:
            hit("high_cardinality", c, "medium", 3)
    if f.duplicates:
        share = f.duplicate_share
        hit("duplicates", None, "medium", 10 if share > 0.10 else 5 if share > 0.05 else 2)
    sentinel = f.sentinel_columns()
    for c in sentinel:
        r.add("sentinels", c, "medium", 2)
    penalty += min(10, 2 * len(sentinel))
    negative = f.negative_prices()
    for c in negative:
        r.add("negative_prices", c, "high", 5)
    penalty += min(15, 5 * len(negative))
    if target:
        if target.get("imbalance", 0) > 20:
            hit("class_imbalance", target["name"], "high", 10)
        if target.get("missing", 0):
            hit("target_missing", target["name"], "critical", 15)
    for c in f.numeric:
        if f.col[c]["std"] == 0:
            r.add("zero_variance", c, "high")
        if f.col[c]["skew"] is not None and abs(f.col[c]["skew"]) > 2:
            r.add("high_skew", c, "low")
    r.score = max(0.0, min(100.0, 100.0 - penalty))
    r.state = drift_risk(f)
    return r


def drift_risk(f: Facts) -> str:
    """Points for wide text columns, many numeric columns and date columns."""
    points = sum(f.col[c]["distinct"] > 100 for c in f.text)
    points += 2 if len(f.numeric) > 50 else 0
    points += 2 if any(k == "datetime" for k in f.kinds.values()) else 0
    return "high" if points >= 4 else "medium" if points >= 2 else "low"


def monitor_report(f: Facts, schema_issues: list[tuple] = ()) -> Report:
    """Production score: 10 for missing cells, 5 for duplicates, 15 or 20 per schema issue."""
    r = Report()
    penalty = 0.0
    if f.missing_cells:
        r.add("missing_values", None, "medium", 10)
        penalty += 10
    if f.duplicates:
        r.add("duplicate_rows", None, "low", 5)
        penalty += 5
    for c in f.numeric:
        if f.outlier_share(c) > 0.01:
            r.add("outliers", c, "warning")
    for check, column, points in schema_issues:
        r.add(check, column, "high", points)
        penalty += points
    for c in f.constant_columns():
        r.add("constant_column", c, "warning")
    for c in f.text:
        if f.distinct_share(c) > 0.5:
            r.add("high_cardinality", c, "warning")
    r.score = max(0.0, 100.0 - penalty)
    return r


def profiler_report(f: Facts) -> Report:
    """Score with capped penalties by missing share, duplicates, issues, anomalies and sentinels."""
    r = Report()
    issues = anomalies = 0
    for c in f.columns:
        share = f.missing_of(c)
        if share > MISSING_WARNING:
            r.add("missing", c, "critical" if share > MISSING_CRITICAL else "warning")
            issues += 1
        if f.col[c]["distinct"] == 1:
            r.add("constant", c, "issue")
            issues += 1
    for c in f.numeric:
        share = f.outlier_share(c)
        if share > OUTLIER_WARNING:
            r.add("outliers", c, "critical" if share > OUTLIER_CRITICAL else "warning")
            anomalies += 1
    sentinel, negative = f.sentinel_columns(), f.negative_prices()
    for c in sentinel:
        r.add("sentinels", c, "issue")
    for c in negative:
        r.add("negative_prices", c, "issue")
    issues += len(sentinel) + len(negative)
    for c in f.text:
        if f.distinct_share(c) > CARDINALITY_HIGH:
            r.add("high_cardinality", c, "issue")
            issues += 1
    missing = f.missing_share * 100
    cap = 40 if missing > MISSING_CRITICAL * 100 else 30 if missing > MISSING_WARNING * 100 else 20
    lost = min(cap, missing) + min(20, f.duplicate_share * 100) + min(30, issues * 5) + min(20, anomalies * 3)
    lost += min(10, len(sentinel) * 2)
    r.score = max(0.0, 100.0 - lost)
    return r


def simple_scores(f: Facts) -> dict[str, float]:
    """The dashboard score and the worst-column score."""
    missing = f.missing_share * 100
    board = 100 - (20 if missing > 30 else 10 if missing > 10 else 0) - (10 if f.duplicates else 0)
    board -= 5 * sum(f.distinct_share(c) > 0.5 for c in f.text) + 5 * len(f.constant_columns())
    worst = 100.0 - min(max((f.missing_of(c) * 100 for c in f.columns), default=0), 30)
    worst -= f.duplicate_share * 20 + f.all_outlier_share() * 10
    return {"dashboard": max(float(board), 0.0), "worst_column": max(worst, 0.0)}


def local_stats(f: Facts) -> dict:
    """Shares, score, complexity and flags that choose how to clean."""
    sentinel, negative = bool(f.sentinel_columns()), bool(f.negative_prices())
    score = 100.0 - min(30, f.missing_share * 100) - min(20, f.duplicate_share * 100)
    complexity = (0.3 if len(f.columns) > 50 else 0) + (0.3 if f.missing_share > 0.3 else 0)
    complexity += (0.2 if sentinel else 0) + (0.2 if negative else 0)
    return {
        "rows": f.rows, "columns": len(f.columns), "numeric_columns": len(f.numeric), "text_columns": len(f.text),
        "missing_share": f.missing_share, "duplicate_share": f.duplicate_share, "quality_score": score,
        "complexity_score": complexity, "outlier_share": f.all_outlier_share(),
        "has_sentinels": sentinel, "has_negative_prices": negative,
        "high_cardinality": sum(f.col[c]["distinct"] > MAX_CATEGORIES for c in f.text),
        "constant_columns": len(f.constant_columns()),
    }


def mode_decision(stats: dict, sector: str = "general", complexity_cut: float = 0.8) -> dict:
    """Weighted score for heavy cleaning (over 0.5), and the rule-based mode."""
    score = 0.3 * (stats["missing_share"] > 0.35) + 0.3 * (stats["quality_score"] < 70)
    score += 0.2 * (stats["complexity_score"] > complexity_cut)
    if sector == "retail":
        score += 0.1 * stats["has_sentinels"] + 0.2 * stats["has_negative_prices"]
    critical = sector in ("finance", "healthcare", "banking", "insurance")
    light = (stats["quality_score"] > 93 and not stats["has_negative_prices"]
             and stats["missing_share"] < 0.35 and not critical)
    if light:
        mode, risk = "local", "low"
    elif critical or stats["missing_share"] > 0.35:
        mode, risk = "interactive", "high"
    elif stats["missing_share"] > 0.15 or stats["rows"] > 100000:
        mode, risk = "hybrid", "medium"
    else:
        mode, risk = "automated", "low"
    return {"heavy_score": round(score, 6), "use_heavy": score > 0.5, "mode": mode, "risk": risk}


def recommendations(f: Facts, retail: bool = True) -> list[tuple]:
    """(priority, category, column, action) rows from the facts; the order is the order of work."""
    out = []
    if retail:
        out += [("high", "sentinel_handling", c, "null_and_group_median") for c in f.sentinel_columns()]
        out += [("high", "price_correction", c, "group_median") for c in f.negative_prices()]
        if "category" in f.columns:
            out.append(("medium", "imputation_strategy", None, "group_median"))
    missing = sum(15 if f.missing_of(c) > MISSING_CRITICAL else 5 if f.missing_of(c) > MISSING_WARNING else 0 for c in f.columns)
    outliers = sum(5 if f.outlier_share(c) > OUTLIER_CRITICAL else 2 if f.outlier_share(c) > OUTLIER_WARNING else 0 for c in f.numeric)
    types = 3 * sum(f.distinct_share(c) > CARDINALITY_HIGH for c in f.text)
    if missing > 10:
        out.append(("high", "missing_data", None, "impute"))
    if outliers > 5:
        out.append(("medium", "outliers", None, "clip"))
    if types > 5:
        out.append(("medium", "data_types", None, "encode"))
    out.append(("low", "best_practices", None, "review"))
    return out


def suggestions(f: Facts) -> list[tuple]:
    """(priority, action, column, method) fixes per column."""
    out = [("high", "handle_sentinels", c, None) for c in f.sentinel_columns()]
    out += [("high", "fix_negative_prices", c, None) for c in f.negative_prices()]
    for c in f.columns:
        share = f.missing_of(c)
        if share > 0.5:
            out.append(("high", "remove_column", c, None))
        elif share > 0:
            out.append(("medium", "fill_missing", c, "median" if c in f.numeric else "mode"))
        if c in f.numeric and f.outlier_share(c) > 0.05:
            out.append(("low", "handle_outliers", c, "clip"))
        if c in f.text and f.col[c]["distinct"] > 100:
            out.append(("medium", "encode", c, "target_encoding"))
    return out


def preparation_choice(f: Facts, task: str = "classification", problem: str | None = None) -> dict:
    """Impute, outlier, scale, encode and select methods from the facts."""
    share = f.missing_share
    impute = "none" if share == 0 else "median_mode" if share < 0.05 else "iterative" if share < 0.2 else "drop_and_forest"
    robust = any(f.outlier_share(c) > 0.05 for c in f.numeric)
    other = [c for c in f.columns if c not in f.numeric]
    return {
        "impute": impute, "outliers": "none" if problem == "fraud_detection" else "iqr_clip",
        "scaling": "robust" if robust else "standard",
        "onehot_columns": sum(f.col[c]["distinct"] <= 20 for c in other),
        "target_encoded_columns": sum(f.col[c]["distinct"] > 20 for c in other),
        "wide_encoding": "target_encoding" if task == "classification" else "frequency_encoding",
        "selection": "mutual_info" if len(f.columns) > 100 else "none",
    }


def column_types(f: Facts) -> dict[str, str]:
    """binary, categorical_numeric, continuous, datetime or categorical."""
    out = {}
    for c in f.columns:
        n = f.col[c]["distinct"]
        if c in f.numeric:
            out[c] = "binary" if n == 2 else "categorical_numeric" if n < 10 else "continuous"
        else:
            out[c] = "datetime" if f.kinds[c] == "datetime" else "categorical"
    return out


def feature_types(f: Facts, max_categories: int = MAX_CATEGORIES) -> dict[str, str]:
    """numeric, categorical, datetime, text, binary or ordinal; all-null columns are skipped."""
    out = {}
    for c in f.columns:
        s = f.col[c]
        if s["missing"] == f.rows:
            continue
        if f.kinds[c] == "datetime":
            out[c] = "datetime"
        elif f.kinds[c] == "text":
            if not s["no_date"]:
                out[c] = "datetime"
            elif has_word(c, ("text", "description", "comment", "review")) or s["len"] > 50 or s["words"] > 5:
                out[c] = "text"
            else:
                out[c] = "binary" if s["distinct"] == 2 else "categorical" if s["distinct"] < max_categories else "text"
        elif f.kinds[c] == "numeric":
            whole = isinstance(f.df.schema[c].dataType, T.IntegralType)
            if s["distinct"] == 2:
                out[c] = "binary"
            elif s["distinct"] < 10 and whole:
                steps = s["distinct"] > 1 and s["max"] - s["min"] + 1 == s["distinct"]
                out[c] = "ordinal" if steps else "categorical"
            else:
                out[c] = "numeric"
        else:
            out[c] = "categorical"
    return out


def detect_task(df: DataFrame, target: str) -> str:
    """classification or regression, from distinct and integer-valued counts of the target."""
    if isinstance(df.schema[target].dataType, T.StringType):
        number = F.col(target).try_cast("double")
    else:
        number = F.col(target).cast("double")
    row = df.agg(F.count(F.lit(1)).alias("n"), F.count(number).alias("numbers"),
                 F.countDistinct(target).alias("distinct"),
                 F.count_if(number != F.floor(number)).alias("parts")).first()
    n, distinct = row["n"], row["distinct"]
    if not row["numbers"] or distinct == 2 or (distinct < 20 and distinct < n * 0.05):
        return "classification"
    if isinstance(df.schema[target].dataType, T.StringType):
        return "classification"
    if not row["parts"] and (distinct < 20 or distinct < n ** 0.5):
        return "classification"
    return "regression"


def code_compliance(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """Share of product codes that are all digits with a standard length; 100 when there are none."""
    cols = columns or [f.name for f in df.schema.fields
                       if isinstance(f.dataType, T.StringType) and has_word(f.name, CODE_WORDS)]
    spark = df.sparkSession
    if not cols:
        return spark.createDataFrame([(0, 0, 100.0)], "codes bigint, compliant bigint, share double")
    good = [F.count_if(F.trim(c).rlike("^[0-9]+$") & F.length(F.trim(c)).isin(list(CODE_LENGTHS))) for c in cols]
    codes = [F.count(c) for c in cols]
    agg = df.agg(sum(codes[1:], codes[0]).alias("codes"), sum(good[1:], good[0]).alias("compliant"))
    return agg.withColumn("share", F.when(F.col("codes") == 0, 100.0).otherwise(F.col("compliant") / F.col("codes") * 100))


# Fixed lists: expected columns and name maps by sector.
EXPECTED = {
    "finance": ["amount", "date", "currency", "transaction_id"],
    "retail": ["sku", "price", "quantity", "category"],
}
RENAMES = {
    "finance": {"amt": "amount", "dt": "date", "curr": "currency", "tx_id": "transaction_id", "acct": "account", "bal": "balance"},
    "sante": {"pat_id": "patient_id", "diag": "diagnosis", "med": "medication", "dos": "date_of_service", "prov": "provider"},
    "retail": {"prod": "product", "qty": "quantity", "price": "unit_price", "cat": "category", "inv": "inventory"},
}


def sector_report(f: Facts, sector: str) -> Report:
    """Expected columns, negative amounts or prices, sentinels and name rules; score from 70."""
    r = Report(score=70.0)
    names = [c.lower() for c in f.columns]
    issues = warnings = 0
    lacking = [c for c in EXPECTED.get(sector, []) if c not in names]
    if lacking:
        r.add("expected_columns", ",".join(lacking), "warning")
        warnings += 1
    if sector == "finance":
        for c in f.numeric:
            if has_word(c, ("amount", "balance")) and f.col[c]["neg"]:
                r.add("negative_amount", c, "warning")
                warnings += 1
    if sector == "sante":
        for check, words in (("patient_identifier", ("patient", "id")), ("date_column", ("date",))):
            if not any(has_word(c, words) for c in names):
                r.add(check, None, "warning")
                warnings += 1
    if sector == "retail":
        for c in f.negative_prices():
            r.add("negative_prices", c, "high")
            issues += 1
        for c in f.sentinel_columns():
            r.add("sentinels", c, "warning")
            warnings += 1
    for c in f.columns:
        if not c.replace("_", "").replace("-", "").isalnum():
            r.add("column_name", c, "medium")
    r.score = max(20.0, 70.0 - min(50.0, (issues + 0.5 * warnings) * 5))
    r.state = "invalid" if issues else "valid"
    return r


def column_map(columns: list[str], sector: str) -> dict[str, str]:
    """Rename map: exact abbreviation first, then the first abbreviation or standard name inside the name."""
    names = RENAMES.get(sector, {})
    out = {}
    for c in columns:
        low = c.lower()
        if low in names:
            out[c] = names[low]
            continue
        inside = [std for abbr, std in names.items() if abbr in low or std in low]
        if inside:
            out[c] = inside[0]
    return out


def before_after(before: Facts, after: Facts, retail: bool = True) -> dict:
    """Rows, columns, missing cells and duplicates removed, with scores and a verdict."""
    lost = before.missing_cells - after.missing_cells
    share = lost / max(before.missing_cells, 1) * 100
    gain = share if before.missing_cells else 0.0
    score = min(100.0, 70 + gain * 0.3)
    basic = min(100.0, 60 + share * 0.4)
    heavy = after.missing_cells > before.rows * len(before.columns) * 0.3
    passed = after.missing_share <= 0.5 and not (retail and after.negative_prices())
    verdict = "ready_with_exceptions" if retail and score > 93 else "ready" if passed else "critical_issues"
    return {
        "rows_removed": before.rows - after.rows, "columns_removed": len(before.columns) - len(after.columns),
        "missing_before": before.missing_cells, "missing_after": after.missing_cells,
        "duplicates_removed": before.duplicates - after.duplicates, "missing_reduction_pct": round(share, 6),
        "quality_score": round(score, 6), "basic_score": round(basic - (10 if heavy else 0), 6),
        "sentinels_left": len(after.sentinel_columns()) if retail else 0,
        "passed": passed, "verdict": verdict,
    }


def one_row(spark: SparkSession, values: dict) -> DataFrame:
    """A dict of plain values as a one-row table."""
    kinds = {bool: T.BooleanType(), int: T.LongType(), float: T.DoubleType(), str: T.StringType()}
    schema = T.StructType([T.StructField(k, kinds[type(v)]) for k, v in values.items()])
    return spark.createDataFrame([tuple(values.values())], schema)
