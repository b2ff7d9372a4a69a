"""Feature sets as partitioned parquet snapshots with a metadata table."""

from __future__ import annotations

import datetime as dt
import json
from urllib.parse import quote

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from tablecare.functions.ordered import running
from tablecare.operators.profile import profile

META = ("name string, version int, entity_key string, time_key string, features string, partition_by string, "
        "registered_at timestamp")
SNAPSHOT = "name string, snapshot_ts string, path string, fields string, written_at timestamp"


class FeatureStore:
    """Snapshots live under base/data/<name>/snapshot_ts=..., definitions under base/meta."""

    def __init__(self, spark: SparkSession, base: str):
        self.spark, self.base = spark, base

    def register(self, name: str, entity_key: str, time_key: str, features: list[str], version: int = 1,
                 partition_by: list[str] | None = None) -> None:
        row = (name, version, entity_key, time_key, json.dumps(features), json.dumps(partition_by or []),
               dt.datetime.now(dt.timezone.utc))
        self.spark.createDataFrame([row], META).coalesce(1).write.mode("append").json(f"{self.base}/meta")

    def definitions(self) -> DataFrame:
        """The newest definition of each name."""
        rows = self.spark.read.schema(META).json(f"{self.base}/meta")
        newest = F.max_by(F.struct(*rows.columns), F.struct("registered_at", "version")).alias("d")
        return rows.groupBy("name").agg(newest).select("d.*")

    def definition(self, name: str):
        row = self.definitions().where(F.col("name") == name).first()
        if row is None:
            raise ValueError(f"no feature set {name}")
        return row

    def write(self, name: str, df: DataFrame, snapshot_ts: str) -> None:
        """Write one snapshot; the time column is added when absent. A rerun replaces the same snapshot only."""
        d = self.definition(name)
        if d["time_key"] not in df.columns:
            df = df.withColumn(d["time_key"], F.lit(snapshot_ts).cast("timestamp"))
        path = f"{self.base}/data/{name}/snapshot_ts={quote(snapshot_ts, safe='')}"
        writer = df.write.mode("overwrite")
        by = json.loads(d["partition_by"])
        (writer.partitionBy(*by) if by else writer).parquet(path)
        row = (name, snapshot_ts, path, df.schema.json(), dt.datetime.now(dt.timezone.utc))
        self.spark.createDataFrame([row], SNAPSHOT).coalesce(1).write.mode("append").json(f"{self.base}/snapshots")

    def snapshots(self, name: str) -> DataFrame:
        """snapshot_ts, path and schema of every snapshot, from the metadata; a snapshot written again counts once, as last written."""
        rows = self.spark.read.schema(SNAPSHOT).json(f"{self.base}/snapshots").where(F.col("name") == name)
        return rows.groupBy("snapshot_ts").agg(F.max_by(F.struct("path", "fields"), "written_at").alias("s")).select("snapshot_ts", "s.*")

    def newest(self, name: str, as_of: str | None = None) -> str | None:
        """Newest snapshot name, at or before a time when given."""
        found = self._newest(name, as_of)
        return found["snapshot_ts"] if found else None

    def _newest(self, name: str, as_of: str | None):
        rows = self.snapshots(name)
        return (rows if as_of is None else rows.where(F.col("snapshot_ts") <= as_of)).orderBy(F.desc("snapshot_ts")).first()

    def read(self, name: str, features: list[str] | None = None, as_of: str | None = None) -> DataFrame:
        """The newest snapshot at or before ``as_of``: one folder is listed and read, with the schema it was written with."""
        d = self.definition(name)
        found = self._newest(name, as_of)
        if found is None:
            raise ValueError(f"no snapshot of {name} at {as_of}")
        wanted = features or json.loads(d["features"])
        return self.spark.read.schema(StructType.fromJson(json.loads(found["fields"]))).parquet(found["path"]).select(d["entity_key"], *wanted)

    def read_many(self, names: list[str], as_of: str | None = None) -> DataFrame:
        """Feature sets joined by full outer join on their entity key."""
        key = self.definition(names[0])["entity_key"]
        out = self.read(names[0], as_of=as_of)
        for n in names[1:]:
            k = self.definition(n)["entity_key"]
            out = out.join(self.read(n, as_of=as_of).withColumnRenamed(k, key), key, "full_outer")
        return out

    def statistics(self, name: str) -> DataFrame:
        return profile(self.read(name))


def latest_view(df: DataFrame, key: str, order: list[str], cols: list[str], ttl_from: Column | None = None) -> DataFrame:
    """Newest values per entity; entities whose newest row is older than the time to live are left out."""
    at = F.struct(*[F.col(c) for c in order])
    out = df.groupBy(key).agg(F.max_by(F.struct(*[order[0], *cols]), at).alias("v")).select(key, "v.*")
    return out if ttl_from is None else out.where(F.col(order[0]) > ttl_from)


def feature_history(df: DataFrame, key: str, entity, ts: str, feature: str, start, end) -> DataFrame:
    """Values of one feature of one entity between two times, oldest first."""
    t = df.schema[ts].dataType
    rows = df.where((F.col(key) == entity) & F.col(ts).between(F.lit(start).cast(t), F.lit(end).cast(t)))
    return rows.select(F.col(key).alias("entity"), ts, F.lit(feature).alias("feature"), F.col(feature).alias("value")).orderBy(ts)


def as_of(left: DataFrame, right: DataFrame, key: str, left_ts: str, right_ts: str, cols: list[str],
          left_id: list[str], right_id: list[str]) -> DataFrame:
    """Newest right row at or before each left time, per key.

    Both sides go into one ordered stream and the last right row is carried forward; there is no join, and a
    key with very many rows is cut into pieces like every ordered operator here.
    """
    pack = F.struct(*[F.col(c) for c in cols])
    # Ties are ordered by the typed id columns themselves, so long ids keep their tail and negative numbers their place.
    a = left.select(key, F.col(left_ts).cast("timestamp").alias("_t"), F.lit(1).alias("_side"),
                    *[F.col(c).alias(f"_l{i}") for i, c in enumerate(left_id)], F.struct(*left.columns).alias("_left"))
    b = right.select(key, F.col(right_ts).cast("timestamp").alias("_t"), F.lit(0).alias("_side"),
                     *[F.col(c).alias(f"_r{i}") for i, c in enumerate(right_id)], pack.alias("_right"))
    both = a.unionByName(b, allowMissingColumns=True)
    order = ["_t", "_side", *[f"_r{i}" for i in range(len(right_id))], *[f"_l{i}" for i in range(len(left_id))]]
    carried = running(both, [key], order, {"_found": ("last", F.col("_right"))})
    return carried.where(F.col("_side") == 1).select("_left.*", *[F.col(f"_found.{c}").alias(f"asof_{c}") for c in cols])
