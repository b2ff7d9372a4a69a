"""Readers and writers by suffix, object-store paths, and the audit export."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SUFFIXES = {".csv": "csv", ".parquet": "parquet", ".json": "json", ".orc": "orc"}


def format_of(path: str) -> str:
    tail = path.rstrip("/").rsplit("/", 1)[-1]
    for suffix, name in SUFFIXES.items():
        if tail.endswith(suffix):
            return name
    if tail.endswith(".feather"):
        raise ValueError("Spark has no feather reader; convert the file to parquet first")
    raise ValueError(f"no reader for {path}")


def read_by_suffix(spark: SparkSession, path: str, schema: str | None = None) -> DataFrame:
    """csv, parquet, json or orc by suffix; give a schema to save the inference pass."""
    kind = format_of(path)
    reader = spark.read
    if schema:
        reader = reader.schema(schema)
    if kind == "csv":
        reader = reader.option("header", "true")
        if not schema:
            reader = reader.option("inferSchema", "true")
    return reader.format(kind).load(path)


def write_by_suffix(df: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """A directory of part files, written by the executors."""
    writer = df.write.mode(mode)
    kind = format_of(path)
    if kind == "csv":
        writer = writer.option("header", "true")
    writer.format(kind).save(path)


def object_path(store: str, container: str, key: str, account: str | None = None) -> str:
    """Path of an object for the Hadoop connectors."""
    key = key.lstrip("/")
    if store == "s3":
        return f"s3a://{container}/{key}"
    if store == "azure":
        if not account:
            raise ValueError("Azure paths need an account")
        return f"abfss://{container}@{account}.dfs.core.windows.net/{key}"
    if store == "gcs":
        return f"gs://{container}/{key}"
    raise ValueError(f"unknown store {store}")


def split_target(df: DataFrame, target: str) -> tuple[DataFrame, DataFrame]:
    """Features and target of a table as two lazy projections of one scan."""
    if target not in df.columns:
        raise ValueError(f"no column {target}")
    return df.drop(target), df.select(target)


def audit_export(df: DataFrame, path: str, tenant, kind: str = "json.gz", only_types: list[str] | None = None) -> None:
    """One tenant's events as json, csv or gzip json."""
    rows = df.where(F.col("tenant") == tenant)
    if only_types:
        rows = rows.where(F.col("event_type").isin(only_types))
    if kind == "csv":
        rows.write.mode("errorifexists").option("header", "true").csv(path)
    elif kind in ("json", "json.gz"):
        writer = rows.write.mode("errorifexists")
        if kind == "json.gz":
            writer = writer.option("compression", "gzip")
        writer.json(path)
    else:
        raise ValueError(f"unknown export format {kind}")
