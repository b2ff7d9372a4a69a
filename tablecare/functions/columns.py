"""Column expressions used by several operators."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Sentinel numbers, and the words that mark special columns by name.
SENTINELS = (-999, -1, 9999)
STOCK_WORDS = ("stock", "quantity", "qty", "inventory", "count", "units")
PRICE_WORDS = ("price", "prix")
CODE_WORDS = ("sku", "upc", "ean", "gtin", "barcode", "product_code")
CODE_LENGTHS = (8, 12, 13, 14)


def is_missing(df: DataFrame, name: str) -> Column:
    """Null, or NaN in a fractional column."""
    if isinstance(df.schema[name].dataType, (T.DoubleType, T.FloatType)):
        return F.col(name).isNull() | F.isnan(name)
    return F.col(name).isNull()


def has_word(name: str, words) -> bool:
    return any(w in name.lower() for w in words)


def sentinels_for(name: str, sentinels=SENTINELS) -> list:
    """Zero is a real amount in stock-like columns."""
    return [s for s in sentinels if s != 0 or not has_word(name, STOCK_WORDS)]


def numeric_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema.fields if isinstance(f.dataType, T.NumericType)]


def text_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema.fields if isinstance(f.dataType, T.StringType)]


def time_columns(df: DataFrame) -> list[str]:
    kinds = (T.TimestampType, T.TimestampNTZType, T.DateType)
    return [f.name for f in df.schema.fields if isinstance(f.dataType, kinds)]


def kind_of(df: DataFrame, name: str) -> str:
    kind = df.schema[name].dataType
    if isinstance(kind, T.NumericType):
        return "numeric"
    if isinstance(kind, T.StringType):
        return "text"
    if isinstance(kind, (T.TimestampType, T.TimestampNTZType, T.DateType)):
        return "datetime"
    if isinstance(kind, T.BooleanType):
        return "boolean"
    return "other"


def clip(c: Column, low=None, high=None) -> Column:
    """Bound a column; nulls stay null."""
    out = c
    if low is not None:
        out = F.when(c < low, F.lit(low)).otherwise(out)
    if high is not None:
        out = F.when(c > high, F.lit(high)).otherwise(out)
    return out


def rnd(c, digits: int = 6) -> Column:
    """Round and turn negative zero into zero."""
    return F.round(c, digits) + F.lit(0.0)


def sample_skewness(c: Column) -> Column:
    """Bias-corrected skewness from the population value; null under three rows or without spread."""
    n = F.count(c).cast("double")
    g = F.skewness(c)
    return F.when((n > 2) & (F.var_pop(c) > 0), g * F.sqrt(n * (n - 1)) / F.when(n > 2, n - 2))


def sample_kurtosis(c: Column) -> Column:
    """Bias-corrected excess kurtosis; null under four rows or without spread."""
    n = F.count(c).cast("double")
    scale = (n - 1) / F.when(n > 3, (n - 2) * (n - 3))
    return F.when((n > 3) & (F.var_pop(c) > 0), scale * ((n + 1) * F.kurtosis(c) + 6))


def hash_bucket(c: Column, buckets: int = 10000) -> Column:
    """Stable bucket from the first eight hex digits of md5."""
    return F.conv(F.substring(F.md5(c.cast("string")), 1, 8), 16, 10).cast("bigint") % buckets


def total(cols: list[Column]) -> Column:
    return reduce(lambda a, b: a + b, cols)


def squared_distance(a: Column, b: Column) -> Column:
    """Squared Euclidean distance of two number arrays."""
    parts = F.zip_with(a, b, lambda x, y: (x.cast("double") - y.cast("double")) * (x.cast("double") - y.cast("double")))
    return F.aggregate(parts, F.lit(0.0), lambda acc, x: acc + x)


def dot(a: Column, b: Column) -> Column:
    parts = F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double"))
    return F.aggregate(parts, F.lit(0.0), lambda acc, x: acc + x)


def melt_row(df: DataFrame, fields: dict[str, dict[str, str]], name: str = "column") -> DataFrame:
    """One aggregate row to one row per key: ``fields[key][out] = source column``."""
    structs = [
        F.struct(F.lit(key).alias(name), *[F.col(f"`{src}`").alias(out) for out, src in outs.items()])
        for key, outs in fields.items()
    ]
    return df.select(F.explode(F.array(*structs)).alias("r")).select("r.*")
