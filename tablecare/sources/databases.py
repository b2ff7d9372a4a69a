"""Options for database and warehouse sources, parameterised SQL, document filters and table descriptions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def jdbc_options(url: str, table: str | None = None, query: str | None = None, partition: str | None = None,
                 lower=None, upper=None, parts: int | None = None, fetch: int = 10000, **more) -> dict[str, str]:
    """Reader options; a table can be read in parallel by ranges of a partition column, a query cannot."""
    if (table is None) == (query is None):
        raise ValueError("give a table or a query")
    out = {"url": url, "fetchsize": str(fetch), **{k: str(v) for k, v in more.items()}}
    if query is not None:
        if partition:
            raise ValueError("a partitioned read needs a table; wrap the query as '(select ...) as t'")
        return {**out, "query": query}
    out["dbtable"] = table
    if partition:
        if lower is None or upper is None or not parts:
            raise ValueError("a partitioned read needs lower, upper and parts")
        out.update(partitionColumn=partition, lowerBound=str(lower), upperBound=str(upper), numPartitions=str(parts))
    return out


def read_jdbc(spark: SparkSession, limit: int | None = None, **options) -> DataFrame:
    df = spark.read.format("jdbc").options(**jdbc_options(**options)).load()
    return df if limit is None else df.limit(limit)


def write_jdbc(df: DataFrame, url: str, table: str, if_exists: str = "append", batch: int = 10000, **more) -> None:
    mode = {"append": "append", "replace": "overwrite", "fail": "errorifexists"}[if_exists]
    df.write.format("jdbc").options(url=url, dbtable=table, batchsize=str(batch), truncate="true", **more).mode(mode).save()


def warehouse_options(kind: str, **given) -> tuple[str, dict[str, str]]:
    """(data source name, options) of the Spark connectors for warehouses and MongoDB."""
    if kind == "bigquery":
        need, source = ("project", "table"), "bigquery"
        out = {"parentProject": given.get("project"), "table": given.get("table"), "query": given.get("query")}
    elif kind == "snowflake":
        need, source = ("account", "user", "database"), "snowflake"
        out = {"sfURL": f"{given.get('account')}.snowflakecomputing.com", "sfUser": given.get("user"), "sfDatabase": given.get("database"),
               "sfSchema": given.get("schema", "PUBLIC"), "sfWarehouse": given.get("warehouse"), "dbtable": given.get("table"), "query": given.get("query")}
    elif kind == "databricks":
        need, source = ("host", "http_path"), "jdbc"
        out = {"url": f"jdbc:databricks://{given.get('host')}:443;httpPath={given.get('http_path')}", "dbtable": given.get("table"), "query": given.get("query")}
    elif kind == "mongodb":
        need, source = ("uri", "database", "collection"), "mongodb"
        out = {"connection.uri": given.get("uri"), "database": given.get("database"), "collection": given.get("collection")}
    else:
        raise ValueError(f"unknown warehouse {kind}")
    lacking = [n for n in need if not given.get(n) and not (n == "table" and given.get("query"))]
    if lacking:
        raise ValueError(f"{kind} needs {', '.join(lacking)}")
    return source, {k: str(v) for k, v in out.items() if v is not None}


def run_sql(spark: SparkSession, text: str, args: dict | None = None, limit: int | None = None) -> DataFrame:
    """SQL text with named parameters; values never become part of the text."""
    df = spark.sql(text, args=args) if args else spark.sql(text)
    return df if limit is None else df.limit(limit)


_TESTS = {
    "$eq": lambda c, v: c == v, "$ne": lambda c, v: c != v, "$gt": lambda c, v: c > v, "$gte": lambda c, v: c >= v,
    "$lt": lambda c, v: c < v, "$lte": lambda c, v: c <= v, "$in": lambda c, v: c.isin(list(v)), "$nin": lambda c, v: ~c.isin(list(v)),
    "$exists": lambda c, v: c.isNotNull() if v else c.isNull(),
}


def document_filter(filter_: dict) -> Column:
    """A document filter ({field: value or {$op: value}}, $and, $or) as a condition."""
    conds = []
    for name, want in filter_.items():
        if name in ("$and", "$or"):
            parts = [document_filter(f) for f in want]
            conds.append(reduce((lambda a, b: a & b) if name == "$and" else (lambda a, b: a | b), parts))
        elif isinstance(want, dict):
            conds += [_TESTS[op](F.col(name), v) for op, v in want.items()]
        else:
            conds.append(F.col(name) == want)
    return reduce(lambda a, b: a & b, conds, F.lit(True))


def find_documents(df: DataFrame, filter_: dict | None = None, projection: dict | None = None, limit: int | None = None) -> DataFrame:
    """find() on a document table: filter, projection of kept or dropped fields, limit; ``_id`` becomes text."""
    out = df.where(document_filter(filter_)) if filter_ else df
    if projection:
        keep = [k for k, v in projection.items() if v]
        out = out.select(*keep) if keep else out.drop(*[k for k, v in projection.items() if not v])
    if "_id" in out.columns:
        out = out.withColumn("_id", F.col("_id").cast("string"))
    return out if limit is None else out.limit(limit)


def sql_type(kind: T.DataType) -> str:
    """Column type for CREATE TABLE."""
    if isinstance(kind, T.IntegralType):
        return "BIGINT"
    if isinstance(kind, (T.FractionalType, T.DecimalType)):
        return "DOUBLE"
    if isinstance(kind, T.BooleanType):
        return "BOOLEAN"
    if isinstance(kind, (T.TimestampType, T.TimestampNTZType, T.DateType)):
        return "TIMESTAMP"
    return "STRING"


def create_table(df: DataFrame, name: str) -> str:
    cols = ", ".join(f"`{f.name}` {sql_type(f.dataType)}" for f in df.schema.fields)
    return f"CREATE TABLE IF NOT EXISTS {name} ({cols})"


def table_info(spark: SparkSession, names: list[str]) -> DataFrame:
    """Columns, types, nullability and row count of each table."""
    out = None
    for name in names:
        df = spark.table(name)
        cols = F.array(*[F.struct(F.lit(f.name).alias("column"), F.lit(f.dataType.simpleString()).alias("data_type"),
                                  F.lit(f.nullable).alias("nullable")) for f in df.schema.fields])
        row = df.agg(F.count(F.lit(1)).alias("rows")).select(F.lit(name).alias("table_name"), F.explode(cols).alias("c"), "rows").select(
            "table_name", "c.*", "rows")
        out = row if out is None else out.unionByName(row)
    return out
