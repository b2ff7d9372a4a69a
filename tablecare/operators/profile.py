"""Column facts, profiles, duplicate counts and correlations: the shared passes behind every check."""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tablecare.functions.columns import (
    clip, has_word, is_missing, kind_of, melt_row, numeric_columns, rnd, sample_kurtosis, sample_skewness,
    sentinels_for, text_columns, PRICE_WORDS, SENTINELS)
from tablecare.functions.ordered import quantiles, row_numbers, running
from tablecare.functions.params import attach
from tablecare.session import together


AGG_BATCH = 36


def gather(df: DataFrame, aggs: dict[str, Column]) -> dict:
    """Named aggregates as a dict, a few columns per pass.

    One pass with too many aggregates compiles to a method the JVM will not optimise, and every pass reads
    only its own columns, so several passes cost less than one.
    """
    names = list(aggs)
    parts = [names[i:i + AGG_BATCH] for i in range(0, len(names), AGG_BATCH)]
    rows = together(*[lambda part=part: df.agg(*[aggs[n].alias(n) for n in part]).first().asDict() for part in parts])
    return {k: v for row in rows for k, v in row.items()}


# Text that can be a number, and text that can start a date: a cheap test before a parse that may fail.
NUMBER_TEXT = r"^\s*[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?[dDfF]?\s*$|^\s*[+-]?([iI]nf(inity)?|[nN]a[nN])\s*$"
DATE_TEXT = r"^\s*[+-]?[0-9]{4}"


def value_counts(df: DataFrame, cols: list[str] | None = None) -> DataFrame:
    """Long table (column, value as text, n); one shuffle of pre-aggregated counts for all columns."""
    cols = cols or df.columns
    pairs = F.array(*[
        F.struct(F.lit(c).alias("column"),
                 F.when(~is_missing(df, c), F.col(f"`{c}`").cast("string")).alias("value")) for c in cols
    ])
    long = df.select(F.explode(pairs).alias("r")).select("r.*")
    return long.groupBy("column", "value").agg(F.count(F.lit(1)).alias("n"))


def distinct_counts(df: DataFrame, cols: list[str] | None = None, exact: bool = True) -> DataFrame:
    """Distinct non-missing values per column, exact or approximate."""
    cols = cols or df.columns
    if exact:
        rows = list(exact_distinct(df, cols).items())
        return df.sparkSession.createDataFrame(rows, "column string, distinct bigint")
    from tablecare.operators import sketches as sk

    present = df.select(*[F.when(~is_missing(df, c), F.col(f"`{c}`")).cast("string").alias(c) for c in cols])
    return sk.distinct_counts(sk.sketch(present, [], cols))


def exact_distinct(df: DataFrame, cols: list[str]) -> dict[str, int]:
    """One pass per column, side by side: each reads and shuffles its own column, pre-aggregated.

    Several distinct counts in one aggregate would copy every row once per column and shuffle on all of them.
    """
    one = lambda c: df.agg(F.countDistinct(F.when(~is_missing(df, c), F.col(f"`{c}`")))).first()[0]
    return dict(zip(cols, map(int, together(*[lambda c=c: one(c) for c in cols]))))


# Rules compare distinct counts with fixed small numbers and with these shares of the rows.
RULE_SHARES = (0.5, 0.9)
FEW_VALUES = 5000


def rough_distinct(df: DataFrame) -> dict[str, int]:
    """Distinct counts from a sketch over value hashes: one small binary buffer per column."""
    sketch = lambda c: F.hll_sketch_estimate(F.hll_sketch_agg(F.when(~is_missing(df, c), F.xxhash64(f"`{c}`")), 12))
    return {c: int(n or 0) for c, n in gather(df, {c: sketch(c) for c in df.columns}).items()}


def rule_distinct(df: DataFrame, rows: int, text: list[str], rough: dict[str, int] | None = None) -> dict[str, int]:
    """Distinct counts exact wherever a rule can turn on them.

    A cheap approximate pass finds the wide columns. Narrow columns, and text columns near a rule share, are
    then counted exactly; for the others the approximation is far from every limit.
    """
    rough = dict(rough or rough_distinct(df))
    near = [c for c, n in rough.items() if n < FEW_VALUES or (
        c in text and rows and any(abs(n / rows - s) < 0.15 for s in RULE_SHARES))]
    rough.update(exact_distinct(df, near))
    return rough


def profile(df: DataFrame, exact: bool = True) -> DataFrame:
    """One row per column: counts, nulls, distinct values, moments, range and quartiles."""
    numeric = numeric_columns(df)
    quarters = [0.25, 0.5, 0.75]
    aggs = {"rows": F.count(F.lit(1))}
    for i, c in enumerate(df.columns):
        value = F.when(~is_missing(df, c), F.col(f"`{c}`"))
        aggs[f"n{i}"] = F.count(value)
        if c in numeric:
            d = value.cast("double")
            aggs.update({f"a{i}": F.avg(d), f"s{i}": F.stddev_samp(d), f"lo{i}": F.min(d), f"hi{i}": F.max(d)})
    def quartiles() -> dict:
        if exact or not numeric:
            return quantiles(df, numeric, quarters)
        rough = df.agg(*[F.percentile_approx(F.col(f"`{c}`").cast("double"), quarters, 10000).alias(c) for c in numeric]).first()
        return {c: list(rough[c] or [None] * 3) for c in numeric}

    row, counted, found = together(lambda: gather(df, aggs), lambda: distinct_counts(df, exact=exact).collect(), quartiles)
    distinct = {r["column"]: r["distinct"] for r in counted}
    rows = []
    for i, (c, t) in enumerate(df.dtypes):
        n, q = int(row[f"n{i}"]), found.get(c, [None] * 3)
        low = row.get(f"lo{i}")
        rows.append((c, t, n, row["rows"] - n, (row["rows"] - n) / row["rows"] if row["rows"] else None, distinct[c],
                     row.get(f"a{i}"), row.get(f"s{i}"), low, row.get(f"hi{i}"), *q, None if low is None else low < 0))
    return df.sparkSession.createDataFrame(
        rows, "column string, dtype string, count bigint, nulls bigint, null_share double, distinct bigint, mean double, "
              "std double, min double, max double, q25 double, q50 double, q75 double, has_negative boolean")


def top_values(df: DataFrame, cols: list[str], k: int = 10) -> DataFrame:
    """Most frequent values per column, ties by value; rank 1 is the mode."""
    from pyspark.sql import Window as W

    # row_number <= k is pushed below the shuffle as a per-task group limit, so a wide column stays cheap.
    counts = value_counts(df, cols).where("value is not null")
    w = W.partitionBy("column").orderBy(F.desc("n"), "value")
    return counts.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


# Equal values of these types have equal hashes: negative zero hashes as zero, and all NaNs alike.
HASHED_ALIKE = (T.IntegralType, T.FractionalType, T.DateType, T.TimestampType, T.TimestampNTZType, T.BooleanType, T.StringType)
MANY_COPIES = 0.25


def duplicate_count(df: DataFrame) -> tuple[int, int]:
    """(rows, rows beyond the first copy); nulls are equal and map-side counting absorbs hot copies.

    Hashes of whole rows are counted first. Only rows whose hash comes again can be copies, and only those are compared as they are; with
    many of them all rows are.
    """
    hashed = df.withColumn("_hash", F.xxhash64(*[F.col(f"`{c}`") for c in df.columns]))
    hashes = hashed.groupBy("_hash").agg(F.count(F.lit(1)).alias("_n"))
    if all(isinstance(f.dataType, HASHED_ALIKE) for f in df.schema.fields) and "_hash" not in df.columns:
        row = hashes.agg(F.sum("_n").alias("rows"), F.sum(F.when(F.col("_n") > 1, F.col("_n"))).alias("again")).first()
        rows, again = int(row["rows"] or 0), int(row["again"] or 0)
        if not again:
            return rows, 0
        if again <= rows * MANY_COPIES:
            some = attach(hashed, hashes.where(F.col("_n") > 1).select("_hash"), ["_hash"], "left_semi").drop("_hash")
            groups = some.groupBy(*df.columns).agg(F.count(F.lit(1)).alias("_n"))
            return rows, again - int(groups.count())
    groups = df.groupBy(*df.columns).agg(F.count(F.lit(1)).alias("_n"))
    row = groups.agg(F.coalesce(F.sum("_n"), F.lit(0)).alias("rows"), F.count(F.lit(1)).alias("groups")).first()
    return int(row["rows"]), int(row["rows"] - row["groups"])


def fences(df: DataFrame, cols: list[str], factor: float = 1.5) -> dict[str, tuple[float, float]]:
    """Tukey fences per column; columns without values are left out."""
    out = {}
    for c, (q1, q3) in quantiles(df, cols, [0.25, 0.75]).items():
        if q1 is not None:
            out[c] = (q1 - factor * (q3 - q1), q3 + factor * (q3 - q1))
    return out


def outside(c: str, bounds: tuple[float, float]) -> Column:
    return (F.col(f"`{c}`") < F.lit(bounds[0])) | (F.col(f"`{c}`") > F.lit(bounds[1]))


def outlier_counts(df: DataFrame, cols: list[str] | None = None, factor: float = 1.5) -> DataFrame:
    """IQR outliers per numeric column with the fences."""
    cols = cols or numeric_columns(df)
    bounds = fences(df, cols, factor)
    cols = [c for c in cols if c in bounds]
    row = df.agg(F.count(F.lit(1)).alias("rows"), *[F.count_if(outside(c, bounds[c])).alias(c) for c in cols])
    long = melt_row(row, {c: {"outliers": c, "rows": "rows"} for c in cols})
    low = F.create_map(*[x for c in cols for x in (F.lit(c), F.lit(bounds[c][0]))])
    high = F.create_map(*[x for c in cols for x in (F.lit(c), F.lit(bounds[c][1]))])
    return long.withColumns({
        "lower": low[F.col("column")], "upper": high[F.col("column")],
        "share": F.col("outliers") / F.col("rows")})


def zscore_outliers(df: DataFrame, cols: list[str], cut: float = 3.0) -> DataFrame:
    """Values more than ``cut`` population deviations from the mean, per column."""
    stats = df.agg(*[f(F.col(c)).alias(f"{p}{c}") for c in cols for p, f in (("m_", F.avg), ("s_", F.stddev_pop))]).first()
    row = df.agg(*[
        (F.count_if(F.abs(F.col(c) - F.lit(stats[f"m_{c}"])) / F.lit(stats[f"s_{c}"]) > cut) if stats[f"s_{c}"]
         else F.lit(0).cast("bigint")).alias(c) for c in cols])
    return melt_row(row, {c: {"outliers": c} for c in cols})


def histogram(df: DataFrame, col: str, bins: int = 30) -> DataFrame:
    """Equal-width bins between the column minimum and maximum."""
    low, high = df.agg(F.min(col).cast("double"), F.max(col).cast("double")).first()
    if low is None:
        return df.sparkSession.createDataFrame([], "bin int, low double, high double, n bigint")
    width = (high - low) / bins or 1.0
    at = F.least(F.floor((F.col(col) - low) / width), F.lit(bins - 1)).cast("int")
    found = df.where(F.col(col).isNotNull()).groupBy(at.alias("bin")).agg(F.count(F.lit(1)).alias("n"))
    all_bins = df.sparkSession.range(bins).select(F.col("id").cast("int").alias("bin"))
    return all_bins.join(found, "bin", "left").select(
        "bin", (F.lit(low) + F.col("bin") * width).alias("low"),
        (F.lit(low) + (F.col("bin") + 1) * width).alias("high"), F.coalesce("n", F.lit(0)).alias("n"))


def correlations(df: DataFrame, cols: list[str]) -> DataFrame:
    """Pearson matrix over complete pairs, all pairs of columns in one aggregate."""
    pairs = list(combinations(cols, 2))
    row = df.agg(*[F.corr(a, b).alias(f"c{i}") for i, (a, b) in enumerate(pairs)])
    structs = [F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), F.col(f"c{i}").alias("corr")) for i, (a, b) in enumerate(pairs)]
    return row.select(F.explode(F.array(*structs)).alias("r")).select("r.*")


def target_codes(df: DataFrame, target: str, order: list[str]) -> DataFrame:
    """Text target to numbers by first appearance in the given order; the value table is broadcast when it is small, or joined."""
    first = df.where(F.col(target).isNotNull()).groupBy(target).agg(F.min(F.struct(*order)).alias("_first"))
    codes = row_numbers(first, [], ["_first"], "_code").select(target, (F.col("_code") - 1).cast("double").alias("_target"))
    return attach(df, codes, [target])


def target_correlations(df: DataFrame, target: str, order: list[str] | None = None) -> DataFrame:
    """Absolute correlation of every numeric column with the target."""
    cols = [c for c in numeric_columns(df) if c != target]
    if kind_of(df, target) == "numeric":
        coded = df.withColumn("_target", F.col(target).cast("double"))
    else:
        coded = target_codes(df, target, order)
    row = coded.agg(*[F.abs(F.corr(c, "_target")).alias(c) for c in cols])
    return melt_row(row, {c: {"corr": c} for c in cols})


def leakage_level(corr: float | None) -> str:
    """Risk from the largest absolute correlation."""
    if corr is None or corr < 0.70:
        return "none"
    return "low" if corr < 0.85 else "medium" if corr < 0.95 else "high"


def order_correlation(df: DataFrame, cols: list[str], order: list[str]) -> DataFrame:
    """Correlation of columns with the row position in a given order; near one hints at a leak."""
    placed = row_numbers(df, [], order, "_at")
    row = placed.agg(*[F.corr(F.col(c).cast("double"), F.col("_at").cast("double")).alias(c) for c in cols])
    return melt_row(row, {c: {"corr": c} for c in cols}).withColumn("leak_hint", F.abs("corr") > 0.99)


def missing_counts(df: DataFrame) -> tuple[int, dict[str, int]]:
    """(rows, missing cells per column) in one pass."""
    row = df.agg(F.count(F.lit(1)).alias("rows"), *[F.count_if(is_missing(df, c)).alias(f"m{i}") for i, c in enumerate(df.columns)]).first()
    return int(row["rows"]), {c: int(row[f"m{i}"]) for i, c in enumerate(df.columns)}


class Facts:
    """Per-column facts of a table in a few passes; small, so rules run on it without touching rows again."""

    def __init__(self, df: DataFrame, sentinels=SENTINELS, duplicates: bool = True):
        self.df = df
        self.columns = list(df.columns)
        self.kinds = {c: kind_of(df, c) for c in df.columns}
        self.numeric = [c for c in df.columns if self.kinds[c] == "numeric"]
        self.text = [c for c in df.columns if self.kinds[c] == "text"]
        aggs = {"rows": F.count(F.lit(1))}
        for i, c in enumerate(df.columns):
            col = F.col(f"`{c}`")
            aggs[f"miss{i}"] = F.count_if(is_missing(df, c))
            if c in self.numeric:
                d = col.cast("double")
                aggs.update({f"mean{i}": F.avg(d), f"std{i}": F.stddev_samp(d), f"skew{i}": F.skewness(d),
                             f"min{i}": F.min(d), f"max{i}": F.max(d), f"neg{i}": F.count_if(col < 0),
                             f"sent{i}": F.count_if(col.isin(sentinels_for(c, sentinels)))})
            if c in self.text:
                number = col.rlike(NUMBER_TEXT)
                date = col.rlike(DATE_TEXT) & F.try_to_timestamp(col).isNotNull()
                aggs.update({f"len{i}": F.avg(F.length(col)), f"words{i}": F.avg(F.regexp_count(col, F.lit(r"\S+"))),
                             f"words_only{i}": F.count_if(~number), f"no_date{i}": F.count_if(~date)})
        row, rough, outliers, dups = together(
            lambda: gather(df, aggs), lambda: rough_distinct(df), self._outliers,
            lambda: duplicate_count(df)[1] if duplicates else 0)
        self.rows = int(row["rows"])
        self.duplicates = dups
        distinct = rule_distinct(df, self.rows, self.text, rough)
        self.col: dict[str, dict] = {}
        for i, c in enumerate(df.columns):
            n, g = self.rows - int(row[f"miss{i}"]), row.get(f"skew{i}")
            corrected = g * (n * (n - 1)) ** 0.5 / (n - 2) if g is not None and g == g and n > 2 else None
            self.col[c] = {
                "kind": self.kinds[c], "missing": int(row[f"miss{i}"]), "distinct": distinct.get(c, 0),
                "outliers": int(outliers.get(c, 0)), "skew": corrected,
                **{k: row.get(f"{k}{i}") for k in ("mean", "std", "min", "max", "neg", "sent",
                                                   "len", "words", "words_only", "no_date")},
            }

    def _outliers(self) -> dict[str, int]:
        """Values outside the Tukey fences per numeric column."""
        bounds = fences(self.df, self.numeric)
        return gather(self.df, {c: F.count_if(outside(c, b)) for c, b in bounds.items()})

    @property
    def missing_cells(self) -> int:
        return sum(f["missing"] for f in self.col.values())

    @property
    def missing_share(self) -> float:
        return self.missing_cells / (self.rows * len(self.columns)) if self.rows and self.columns else 0.0

    @property
    def duplicate_share(self) -> float:
        return self.duplicates / self.rows if self.rows else 0.0

    def missing_of(self, c: str) -> float:
        return self.col[c]["missing"] / self.rows if self.rows else 0.0

    def outlier_share(self, c: str) -> float:
        return self.col[c]["outliers"] / self.rows if self.rows else 0.0

    def distinct_share(self, c: str) -> float:
        return self.col[c]["distinct"] / self.rows if self.rows else 0.0

    def sentinel_columns(self) -> list[str]:
        return [c for c in self.numeric if self.col[c]["sent"]]

    def negative_prices(self) -> list[str]:
        return [c for c in self.numeric if has_word(c, PRICE_WORDS) and self.col[c]["neg"]]

    def constant_columns(self) -> list[str]:
        return [c for c in self.columns if self.col[c]["distinct"] == 1]

    def all_outlier_share(self) -> float:
        if not self.rows or not self.numeric:
            return 0.0
        return sum(self.col[c]["outliers"] for c in self.numeric) / (self.rows * len(self.numeric))


def target_analysis(df: DataFrame, target: str) -> DataFrame:
    """Class counts of a text or narrow numeric target, or moments of a wide numeric one."""
    numeric = kind_of(df, target) == "numeric"
    distinct = df.select(F.countDistinct(target)).first()[0] if numeric else None
    if numeric and distinct >= 10:
        d = F.col(target).cast("double")
        row = df.agg(F.avg(d).alias("mean"), F.stddev_samp(d).alias("std"), sample_skewness(d).alias("skew"))
        long = melt_row(row, {k: {"n": k} for k in ("mean", "std", "skew")}, "value")
        return long.select(F.lit(target).alias("target"), F.lit("regression").alias("target_type"), "value", "n")
    kind = "classification" if not numeric else "binary_classification" if distinct == 2 else "multiclass_classification"
    counts = df.where(F.col(target).isNotNull()).groupBy(F.col(target).cast("string").alias("value")).agg(
        F.count(F.lit(1)).cast("double").alias("n"))
    return counts.select(F.lit(target).alias("target"), F.lit(kind).alias("target_type"), "value", "n")


def time_regularity(df: DataFrame, keys: list[str], ts: str, ties: list[str], cut: float = 0.1) -> DataFrame:
    """Per key, the spread of the time gaps over their mean; regular when under ``cut``."""
    from tablecare.functions.ordered import framed

    # The gap needs one earlier row, so long keys are cut with a lead-in of one.
    at = F.unix_micros(F.col(ts).cast("timestamp"))
    gaps = framed(df.select(*keys, ts, *ties), keys, [ts, *ties], 1, lambda w: {"_gap": (at - F.lag(at).over(w)) / 1e6})
    ratio = F.stddev_samp("_gap") / F.avg("_gap")
    return gaps.groupBy(*keys).agg(F.count("_gap").alias("gaps"), ratio.alias("spread"),
                                   F.coalesce(ratio < cut, F.lit(False)).alias("regular"))


def imbalance(df: DataFrame, label: str) -> DataFrame:
    """Class ratio and the balancing method it calls for."""
    counts = df.where(F.col(label).isNotNull()).groupBy(label).agg(F.count(F.lit(1)).alias("n"))
    ratio = F.max("n") / F.min("n")
    return counts.agg(F.count(F.lit(1)).alias("classes"), ratio.alias("ratio"),
                      F.when(ratio < 3, "none").when(ratio < 10, "smote").otherwise("smoteenn").alias("method"))
