"""Projections, filters, casts, formats and schema checks."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tablecare.functions.columns import clip, is_missing, melt_row


def entity_features(df: DataFrame, key: str, features: list[str], ids: list | DataFrame | None = None) -> DataFrame:
    """Entity key and requested features, for the requested ids: a literal list or a table of ids."""
    out = df.select(key, *features)
    if ids is None:
        return out
    if isinstance(ids, DataFrame):
        return out.join(ids.select(key).distinct(), key, "left_semi")
    return out.where(F.col(key).isin(list(ids)))


def sparse_columns(df: DataFrame, share: float = 0.5) -> list[str]:
    row = df.agg(F.count(F.lit(1)).alias("n"), *[F.count_if(is_missing(df, c)).alias(f"m{i}") for i, c in enumerate(df.columns)]).first()
    return [c for i, c in enumerate(df.columns) if row["n"] and row[f"m{i}"] / row["n"] > share]


def drop_sparse(df: DataFrame, share: float = 0.5) -> DataFrame:
    """Drop columns whose missing share passes the limit; one counting pass."""
    return df.drop(*sparse_columns(df, share))


def convert(c: Column, kind: str) -> Column:
    """float and datetime give null for bad values, int gives 0."""
    if kind == "float":
        return c.try_cast("double")
    if kind == "int":
        return F.coalesce(c.try_cast("double"), F.lit(0.0)).cast("bigint")
    if kind == "str":
        return c.cast("string")
    if kind == "datetime":
        return F.try_to_timestamp(c.cast("string"))
    raise ValueError(f"unknown type {kind}")


def currency(c: Column, rate: float = 1.0) -> Column:
    """Amount text without currency signs and thousands marks, times a rate."""
    return F.regexp_replace(c.cast("string"), r"[$€£¥,\s]", "").try_cast("double") * F.lit(float(rate))


# Strftime codes and their Spark patterns.
STRFTIME = {"%Y": "yyyy", "%y": "yy", "%m": "MM", "%d": "dd", "%H": "HH", "%M": "mm", "%S": "ss",
            "%b": "MMM", "%B": "MMMM", "%j": "DDD", "%p": "a", "%I": "hh", "%%": "%"}


def spark_pattern(strftime: str) -> str:
    """A strftime pattern as a Spark date pattern; other letters are quoted."""
    out, i = [], 0
    while i < len(strftime):
        code = strftime[i:i + 2]
        if code in STRFTIME:
            out.append(STRFTIME[code])
            i += 2
        elif strftime[i] == "%":
            raise ValueError(f"no Spark pattern for {code}")
        else:
            out.append(f"'{strftime[i]}'" if strftime[i].isalpha() else strftime[i])
            i += 1
    return "".join(out)


def date_text(c: Column, strftime: str) -> Column:
    return F.date_format(F.try_to_timestamp(c.cast("string")), spark_pattern(strftime))


def confident(df: DataFrame, proba: list[str], threshold: float) -> DataFrame:
    """Rows whose top class probability reaches the threshold, with ``confidence_score``."""
    top = F.greatest(*[F.col(c) for c in proba]) if len(proba) > 1 else F.col(proba[0])
    return df.withColumn("confidence_score", top).where(F.col("confidence_score") >= threshold)


def event_search(df: DataFrame, equal: dict | None = None, time: str = "ts", start=None, end=None,
                 limit: int | None = None, offset: int = 0, ties: tuple[str, ...] = ()) -> DataFrame:
    """Equality and date filters, newest first, with an optional page."""
    conds = [F.col(c) == v for c, v in (equal or {}).items() if v is not None]
    if start is not None:
        conds.append(F.col(time) >= F.lit(start).cast(df.schema[time].dataType))
    if end is not None:
        conds.append(F.col(time) <= F.lit(end).cast(df.schema[time].dataType))
    out = df.where(reduce(lambda a, b: a & b, conds)) if conds else df
    out = out.orderBy(F.desc(time), *[F.desc(t) for t in ties])
    out = out.offset(offset) if offset else out
    return out.limit(limit) if limit is not None else out


def flag_numeric_text(df: DataFrame) -> DataFrame:
    """Per text column, values that are not numbers; a column is numeric when there are none."""
    cols = [f.name for f in df.schema.fields if isinstance(f.dataType, T.StringType)]
    from tablecare.operators.profile import NUMBER_TEXT

    row = df.agg(*[F.count_if(~F.col(c).rlike(NUMBER_TEXT)).alias(c) for c in cols])
    return melt_row(row, {c: {"not_numbers": c} for c in cols}).withColumn("numeric_only", F.col("not_numbers") == 0)


def infer_numeric(df: DataFrame) -> DataFrame:
    """Cast text columns to double when every value parses."""
    clean = [r["column"] for r in flag_numeric_text(df).where("numeric_only").collect()]
    return df.withColumns({c: F.col(c).cast("double") for c in clean})


def flatten(df: DataFrame, sep: str = "_") -> DataFrame:
    """Nested struct columns to prefixed columns, all levels, row by row."""
    while any(isinstance(f.dataType, T.StructType) for f in df.schema.fields):
        out = []
        for f in df.schema.fields:
            if isinstance(f.dataType, T.StructType):
                out += [F.col(f"`{f.name}`.`{g.name}`").alias(f"{f.name}{sep}{g.name}") for g in f.dataType.fields]
            else:
                out.append(F.col(f"`{f.name}`"))
        df = df.select(*out)
    return df


def flatten_json(df: DataFrame, column: str, schema: str, sep: str = "_") -> DataFrame:
    """A JSON text column to prefixed columns; text that is not an object is kept in ``<column>_text``."""
    parsed = F.from_json(F.col(column), schema)
    is_object = F.trim(F.col(column)).startswith("{")
    kept = F.when(~is_object, F.col(column))
    return flatten(df.withColumn(f"{column}{sep}text", kept).withColumn(column, parsed), sep)


def numeric_vector(df: DataFrame, scalars: list[str], lists: list[str], out: str = "vector") -> DataFrame:
    """Numbers and lists of numbers in one array per row."""
    parts = [F.array(*[F.col(c).cast("double") for c in scalars])] if scalars else []
    parts += [F.transform(F.col(c), lambda x: x.cast("double")) for c in lists]
    return df.withColumn(out, F.concat(*parts))


def validate_input(df: DataFrame, features: list[str], dtypes: dict[str, str] | None = None) -> DataFrame:
    """Check a scoring input: raises on empty input or missing features, returns warnings as rows."""
    lacking = [c for c in features if c not in df.columns]
    if lacking:
        raise ValueError(f"missing features: {lacking}")
    if df.isEmpty():
        raise ValueError("input is empty")
    kinds = dict(df.dtypes)
    rows = [(c, "extra", None) for c in df.columns if c not in features]
    rows += [(c, "dtype", f"{kinds[c]} instead of {t}") for c, t in (dtypes or {}).items() if c in kinds and kinds[c] != t]
    seen = df.agg(*[F.count(F.when(~is_missing(df, c), 1)).alias(c) for c in df.columns]).first()
    rows += [(c, "all_null", None) for c in df.columns if seen[c] == 0]
    return df.sparkSession.createDataFrame(rows, "column string, warning string, detail string")


# Pairs of types that pass for each other.
WIDENS = {frozenset(("bigint", "double")), frozenset(("int", "bigint")), frozenset(("float", "double")),
          frozenset(("string", "varchar"))}


def schema_issues(df: DataFrame, expected: dict[str, str]) -> list[tuple[str, str, int]]:
    """(issue, column, points): 20 for a missing column, 15 for a type that does not widen."""
    kinds = dict(df.dtypes)
    out = []
    for c, want in expected.items():
        if c not in kinds:
            out.append(("missing_column", c, 20))
        elif kinds[c] != want and frozenset((kinds[c], want)) not in WIDENS:
            out.append(("schema_mismatch", c, 15))
    return out


def missing_patterns(df: DataFrame, cols: list[str]) -> DataFrame:
    """Counts per combination of missing columns."""
    flags = [F.when(is_missing(df, c), F.lit(c)) for c in cols]
    return df.groupBy(F.concat_ws(",", *flags).alias("missing_columns")).agg(F.count(F.lit(1)).alias("n"))


def complete_rows(df: DataFrame, cols: list[str] | None = None) -> DataFrame:
    return df.dropna(subset=cols)


AGGREGATES = {
    "sum": F.sum, "mean": F.avg, "avg": F.avg, "min": F.min, "max": F.max, "count": F.count, "std": F.stddev_samp,
    "var": F.var_samp, "median": F.median, "nunique": F.countDistinct, "first": F.first, "last": F.last,
}


def aggregate(df: DataFrame, keys: list[str], ops: dict[str, str | list[str]]) -> DataFrame:
    """Group by keys with a dict of column to operation names; outputs are ``<column>_<operation>``."""
    cols = []
    for c, names in ops.items():
        for name in [names] if isinstance(names, str) else names:
            cols.append(AGGREGATES[name](c).alias(f"{c}_{name}"))
    return df.groupBy(*keys).agg(*cols)
