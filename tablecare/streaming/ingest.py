"""Stream sources, parsing, validation, sinks and named pipelines."""

from __future__ import annotations

import time
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.listener import StreamingQueryListener


def kafka_options(servers: str, topic: str, group: str | None = None, start: str = "latest", batch: int | None = None) -> dict[str, str]:
    out = {"kafka.bootstrap.servers": servers, "subscribe": topic, "startingOffsets": start, "includeHeaders": "true", "failOnDataLoss": "true"}
    if group:
        out["groupIdPrefix"] = group
    if batch:
        out["maxOffsetsPerTrigger"] = str(batch)
    return out


def kafka_messages(spark: SparkSession, **options) -> DataFrame:
    """Key, value text, broker time, partition, offset and headers of a topic."""
    df = spark.readStream.format("kafka").options(**kafka_options(**options)).load()
    return df.select(F.col("key").cast("string"), F.col("value").cast("string"), "timestamp", "partition", "offset", "headers")


def file_stream(spark: SparkSession, folder: str, schema, pattern: str | None = None, files_per_batch: int | None = None) -> DataFrame:
    """Parquet files of a folder as a stream; new files are new batches."""
    reader = spark.readStream.schema(schema)
    if pattern:
        reader = reader.option("pathGlobFilter", pattern)
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    return reader.parquet(folder)


def table_stream(spark: SparkSession, folder: str, table: str) -> DataFrame:
    """One table file as a stream, with timestamps that take a watermark."""
    schema = spark.read.parquet(f"{folder}/{table}.parquet").schema
    df = file_stream(spark, folder, schema, f"{table}.parquet")
    return df.withColumns({n: F.col(n).cast("timestamp") for n, t in df.dtypes if t == "timestamp_ntz"})


def parse(messages: DataFrame, schema: str, required: list[str]) -> tuple[DataFrame, DataFrame]:
    """JSON values to columns: (records with all required fields, rejected messages)."""
    parsed = messages.withColumn("record", F.from_json("value", schema))
    whole = F.col("record").isNotNull()
    for name in required:
        whole = whole & F.col(f"record.{name}").isNotNull()
    meta = [c for c in messages.columns if c != "value"]
    return parsed.where(whole).select(*meta, "record.*"), parsed.where(~whole).select(*messages.columns)


def batch_writer(path: str, transform: Callable[[DataFrame], DataFrame] | None = None):
    """A foreachBatch sink that writes each batch to its own folder, so a repeated batch replaces itself."""
    def write(batch: DataFrame, batch_id: int) -> None:
        out = transform(batch) if transform else batch
        out.write.mode("overwrite").parquet(f"{path}/batch_id={batch_id}")
    return write


def drain(stream: DataFrame, path: str, mode: str = "append", transform: Callable[[DataFrame], DataFrame] | None = None,
          name: str | None = None):
    """Process everything that is there now, with a checkpoint beside the output; returns the finished query."""
    writer = stream.writeStream.outputMode(mode).option("checkpointLocation", f"{path}-checkpoint").trigger(availableNow=True)
    if name:
        writer = writer.queryName(name)
    query = writer.foreachBatch(batch_writer(path, transform)).start()
    query.awaitTermination()
    return query


def drained(spark: SparkSession, stream: DataFrame, path: str, mode: str = "append", **options) -> DataFrame:
    drain(stream, path, mode, **options)
    return spark.read.parquet(path)


def newest_update(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Last emitted row per key of an update-mode output."""
    rest = [c for c in rows.columns if c not in keys]
    return rows.groupBy(*keys).agg(F.max_by(F.struct(*rest), "batch_id").alias("v")).select(*keys, "v.*").drop("batch_id")


def start(stream: DataFrame, path: str, every: str = "10 seconds", mode: str = "append", name: str | None = None, kind: str = "parquet"):
    """A running pipeline to files or a topic with periodic triggers and a checkpoint."""
    writer = stream.writeStream.format(kind).outputMode(mode).option("checkpointLocation", f"{path}-checkpoint").trigger(processingTime=every)
    if name:
        writer = writer.queryName(name)
    return writer.start(path) if kind != "kafka" else writer.option("topic", path).start()


class Pipelines:
    """Named pipelines: built lazily, started and stopped by name."""

    def __init__(self, spark: SparkSession):
        self.spark = spark
        self.builders: dict[str, Callable[[], object]] = {}
        self.running: dict[str, object] = {}

    def add(self, name: str, build: Callable[[], object]) -> None:
        """``build`` starts a streaming query and returns it."""
        self.builders[name] = build

    def start(self, name: str) -> None:
        if name not in self.builders:
            raise ValueError(f"no pipeline {name}")
        if name not in self.running:
            self.running[name] = self.builders[name]()

    def stop(self, name: str) -> None:
        query = self.running.pop(name, None)
        if query is not None:
            query.stop()

    def stop_all(self) -> None:
        for name in list(self.running):
            self.stop(name)

    def active(self) -> list[str]:
        return sorted(n for n, q in self.running.items() if q.isActive)


TOTALS = "name string, batches bigint, input_rows bigint, duration_ms bigint, error string"
PROGRESS = "name string, batch_id bigint, input_rows bigint, rows_per_second double, duration_ms bigint, error string"


def progress_rows(query) -> list[tuple]:
    """Counts, throughput and duration of the recent batches of a query (the last 100 by default; ``ProgressLog`` has the totals)."""
    error = query.exception()
    return [(query.name, p["batchId"], p["numInputRows"], p.get("processedRowsPerSecond"), p["durationMs"].get("triggerExecution"),
             str(error) if error else None) for p in query.recentProgress]


class ProgressLog(StreamingQueryListener):
    """Totals of all queries of a session by name: batches, rows, milliseconds and the last error, however many batches there are."""

    def __init__(self):
        self.totals: dict[str, list] = {}
        self.names: dict[str, str] = {}
        self.ended: set[str] = set()

    def rows(self) -> list[tuple]:
        return [(name, *t) for name, t in sorted(self.totals.items())]

    def wait(self, run_id, seconds: float = 60.0) -> None:
        """Events come after the query's own end; the last one of a run says that it ended."""
        end = time.monotonic() + seconds
        while str(run_id) not in self.ended:
            if time.monotonic() > end:
                raise TimeoutError(f"no end of {run_id} seen")
            time.sleep(0.05)

    def onQueryStarted(self, event):
        self.names[str(event.runId)] = event.name
        self.totals.setdefault(event.name, [0, 0, 0, None])

    def onQueryProgress(self, event):
        p = event.progress
        total = self.totals.setdefault(p.name, [0, 0, 0, None])
        total[0] += 1
        total[1] += p.numInputRows
        total[2] += p.durationMs.get("triggerExecution") or 0

    def onQueryIdle(self, event):
        pass

    def onQueryTerminated(self, event):
        if event.exception:
            self.totals.setdefault(self.names.get(str(event.runId)), [0, 0, 0, None])[3] = event.exception
        self.ended.add(str(event.runId))
