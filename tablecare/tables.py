"""The test tables and the derived views the queries run on."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Fixed split of the lineitem ship dates into an early and a late half.
SPLIT_DATE = "1998-05-24"

DIRTY_LINEITEM = """
SELECT l_orderkey, l_linenumber, l_partkey, l_returnflag AS category,
       CASE WHEN l_orderkey % 10 = 0 THEN NULL ELSE l_discount END AS discount,
       CASE WHEN l_orderkey % 5 < 2 THEN NULL ELSE l_tax END AS tax,
       CASE WHEN l_orderkey % 5 < 3 THEN NULL ELSE l_tax END AS sparse_tax,
       CASE WHEN l_partkey % 50 = 0 THEN -999 ELSE l_quantity END AS stock_qty,
       CASE WHEN l_orderkey % 97 = 0 THEN -l_extendedprice ELSE l_extendedprice END AS price,
       1 AS constant_col, CAST(NULL AS DOUBLE) AS empty_col, l_shipdate
FROM lineitem
"""

DIRTY_ORDERS = "SELECT * FROM orders UNION ALL SELECT * FROM orders WHERE o_orderkey % 100 = 0"

SCORED_LINEITEM = """
SELECT l_orderkey, l_linenumber,
       CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END AS y_true,
       CASE WHEN l_discount > 0.05 THEN 1 ELSE 0 END AS pred_a,
       CASE WHEN l_tax > 0.04 THEN 1 ELSE 0 END AS pred_b,
       (l_quantity - 0.5) / 50 AS proba,
       l_extendedprice AS actual,
       l_extendedprice * (1 + l_discount - 0.05) AS forecast_a,
       l_extendedprice * (1 + l_tax - 0.04) AS forecast_b
FROM lineitem
"""

EARLY = f"SELECT * FROM lineitem WHERE l_shipdate < TIMESTAMP '{SPLIT_DATE} 00:00:00'"
LATE = f"SELECT * FROM lineitem WHERE l_shipdate >= TIMESTAMP '{SPLIT_DATE} 00:00:00'"


def nan_to_null(df: DataFrame) -> DataFrame:
    """Missing is null or NaN: turn NaN into null once, at load."""
    fractional = [f.name for f in df.schema.fields if isinstance(f.dataType, (T.DoubleType, T.FloatType))]
    return df.withColumns({c: F.when(~F.isnan(c), F.col(c)) for c in fractional}) if fractional else df


def load(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def views(spark: SparkSession, folder: str, *names: str) -> None:
    for name in names:
        load(spark, folder, name).createOrReplaceTempView(name)


def derived(spark: SparkSession, folder: str, sql: str, *names: str) -> DataFrame:
    """Run view SQL over the named base tables."""
    views(spark, folder, *names)
    return spark.sql(sql)


def dirty_lineitem(spark, folder):
    return derived(spark, folder, DIRTY_LINEITEM, "lineitem")


def dirty_orders(spark, folder):
    return derived(spark, folder, DIRTY_ORDERS, "orders")


def scored_lineitem(spark, folder):
    return derived(spark, folder, SCORED_LINEITEM, "lineitem")


def early_lineitem(spark, folder):
    return derived(spark, folder, EARLY, "lineitem")


def late_lineitem(spark, folder):
    return derived(spark, folder, LATE, "lineitem")
