"""Per-key work in event-time order on streams: rows wait in state until the watermark has passed them.

Time is cut into slices, and keys are dealt to buckets by hash, because every call of the state costs milliseconds, however few rows a key has.
A bucket's rows are put into the slice of their time as they come, chunk by chunk, and a timer is set to the slice's end.
When the watermark has passed it, no more row of the slice can come: its rows are sorted and handed on key by key, and leave the state. So the
order doesn't depend on how rows are cut into files and batches, and a task holds one slice of one bucket, not what a batch brings of it. Rows that
come after the watermark has passed them are late and dropped by Spark; ``delay`` is how late a row may be. Rows without a time have no
place in the order and are dropped.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.streaming import StatefulProcessor
from pyspark.sql.streaming.stateful_processor import StatefulProcessorHandle

from tablecare.streaming import ingest as ig

PROVIDER = "spark.sql.streaming.stateStore.providerClass"
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
OUT_ROWS = 50_000
#: The time of the marks that end a stream; rows of this time or later are none.
LAST = "9999-01-01 00:00:00"


class InTime(StatefulProcessor):
    """Calls ``step(memory, rows)`` with the rows of a key in order of (time, id), slice after slice, for each key of a bucket.

    ``memory`` is None at first, then what the last call returned as its first result, values of ``memory_schema``; the second result is the
    frame to emit, without the key. ``rows`` has the columns t (microseconds), id and v.
    """

    def __init__(self, step: Callable[[tuple | None, pd.DataFrame], tuple[tuple, pd.DataFrame]], memory_schema: pa.Schema, key: str, columns: list[str], ts: str, row_id: str, value: str,
                 slice_us: int):
        self.step, self.memory_schema, self.key, self.columns = step, memory_schema, key, columns
        self.ts, self.row_id, self.value, self.slice_us = ts, row_id, value, slice_us

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.memory = handle.getValueState("memory", "keys binary")
        self.open = handle.getValueState("open", "slices array<bigint>, parts array<int>")
        self.chunks = handle.getMapState("chunks", "slice bigint, part int", "rows binary")

    def _opened(self) -> dict[int, int]:
        found = self.open.get()
        return dict(zip(found[0], found[1])) if found else {}

    def _memories(self) -> dict:
        """What each key of the bucket remembers; a missing key is None."""
        found = self.memory.get()
        if not found:
            return {}
        keys, *values = (c.to_pylist() for c in pa.ipc.open_stream(found[0]).read_all().columns)
        return dict(zip(keys, zip(*values)))

    def _remember(self, memories: dict) -> None:
        columns = [pa.array([m[i] for m in memories.values()], f.type) for i, f in enumerate(self.memory_schema)]
        self.memory.update((_packed(["key", *self.memory_schema.names], [pa.array(list(memories)), *columns]),))

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        opened = self._opened()
        for pdf in rows:
            pdf = pdf[pdf[self.ts].notna()]
            if not len(pdf):
                continue
            times = pdf[self.ts].astype("datetime64[us]").astype("int64").to_numpy()
            slices = times // self.slice_us
            for s in np.unique(slices).tolist():
                here = slices == s
                columns = [pa.array(times[here]), pa.Array.from_pandas(pdf[self.key][here]), pa.Array.from_pandas(pdf[self.row_id][here]), pa.Array.from_pandas(pdf[self.value][here], type=pa.float64())]
                if s not in opened:
                    self.handle.registerTimer(-(-(s + 1) * self.slice_us // 1000))
                self.chunks.updateValue((s, opened.get(s, 0)), (_packed(["t", "key", "id", "v"], columns),))
                opened[s] = opened.get(s, 0) + 1
        if opened:
            self.open.update((list(opened), list(opened.values())))
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        opened = self._opened()
        due = sorted(s for s in opened if -(-(s + 1) * self.slice_us // 1000) <= expiredTimerInfo.getExpiryTimeInMs())
        memories = self._memories() if due else {}
        for s in due:
            parts = []
            for part in range(opened.pop(s)):
                parts.append(pa.ipc.open_stream(self.chunks.getValue((s, part))[0]).read_all())
                self.chunks.removeKey((s, part))
            rows = pa.concat_tables(parts, promote_options="permissive").to_pandas()
            at, keys = pd.factorize(rows.pop("key"), use_na_sentinel=False)
            rows = rows.assign(_at=at).sort_values(["_at", "t", "id"], kind="stable", ignore_index=True)
            ends = np.searchsorted(rows.pop("_at").to_numpy(), np.arange(len(keys) + 1))
            outs = []
            for i, k in enumerate(keys):
                name = None if pd.isna(k) else k
                memories[name], out = self.step(memories.get(name), rows.iloc[ends[i] : ends[i + 1]].reset_index(drop=True))
                if len(out):
                    outs.append(out.assign(**{self.key: [name] * len(out)})[self.columns])
            for out in _together(outs):
                yield out
        if due:
            self._remember(memories)
        if due and opened:
            self.open.update((list(opened), list(opened.values())))
        elif due:
            self.open.clear()

    def close(self) -> None:
        pass


def _packed(names: list[str], columns: list[pa.Array]) -> bytes:
    batch = pa.record_batch(columns, names=names)
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, batch.schema) as writer:
        writer.write_batch(batch)
    return sink.getvalue().to_pybytes()


def _together(frames: list[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """The rows of many small or a few large frames, at most ``OUT_ROWS`` in one."""
    held, n = [], 0
    for frame in frames:
        for start in range(0, len(frame), OUT_ROWS):
            part = frame.iloc[start : start + OUT_ROWS]
            if held and n + len(part) > OUT_ROWS:
                yield pd.concat(held, ignore_index=True)
                held, n = [], 0
            held.append(part)
            n += len(part)
    if held:
        yield pd.concat(held, ignore_index=True)


def in_time(df: DataFrame, key: str, ts: str, value: str, row_id: str, step, memory: str, out: str, *, delay: str = "0 seconds", slice_seconds: int = 86_400,
            buckets: int = 1024) -> DataFrame:
    """``row_id``, ``key`` and the columns of ``out`` for the rows that ``step`` emits; see ``InTime``. Needs the RocksDB state store.

    ``buckets`` is fixed for the life of a stream: keys of a bucket share its state.
    """
    kinds = dict(df.dtypes)
    if df.sparkSession.conf.get(PROVIDER, None) != ROCKSDB:
        raise ValueError(f"set {PROVIDER} to {ROCKSDB}")
    schema = f"{row_id} {kinds[row_id]}, {key} {kinds[key]}, {out}"
    columns = [row_id, key, *[c.split()[0] for c in out.split(", ")]]
    processor = InTime(step, to_arrow_schema(T.StructType.fromDDL(memory)), key, columns, ts, row_id, value, slice_seconds * 1_000_000)
    # This filter names the time, so it stays behind the watermark, which sees the marks of the end.
    rows = df.withWatermark(ts, delay).where(F.col(ts) < F.lit(LAST).cast("timestamp"))
    # Rows without a key are a bucket of their own, so that missing keys change no type of the others.
    bucket = F.when(F.col(key).isNull(), -1).otherwise(F.pmod(F.xxhash64(key), F.lit(buckets)).cast("int")).alias("_bucket")
    return rows.select(bucket, key, ts, value, row_id).groupBy("_bucket").transformWithStateInPandas(processor, schema, "append", "EventTime")




def with_end(stream: DataFrame, ts: str, folder: str) -> DataFrame:
    """The stream, and marks once ``end`` has been called: a time behind all others, by which the watermark passes every row."""
    return stream.unionByName(ig.file_stream(stream.sparkSession, folder, stream.schema, files_per_batch=1))


def end(spark: SparkSession, schema, ts: str, folder: str) -> None:
    """A stream that has ended takes no more rows. The first mark moves the watermark, the batch of the second one works with it."""
    columns = [F.lit(LAST).cast("timestamp").alias(ts) if f.name == ts else F.lit(None).cast(f.dataType).alias(f.name) for f in schema]
    for _ in range(2):
        spark.range(1).select(*columns).coalesce(1).write.mode("append").parquet(folder)


#: A finite stream's settings: the marks make the batches that the watermark needs, and a batch's changes are saved as a log.
FINITE = {PROVIDER: ROCKSDB, "spark.sql.streaming.noDataMicroBatches.enabled": "false", "spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled": "true"}


def drained_in_time(stream: DataFrame, ts: str, build: Callable[[DataFrame], DataFrame], path: str) -> DataFrame:
    """What a finite stream gives: all that is there now, then its end. ``build`` is the work on the stream, by ``in_time``."""
    spark, marks = stream.sparkSession, f"{path}-marks"
    before = {k: spark.conf.get(k, None) for k in FINITE}
    try:
        for k, v in FINITE.items():
            spark.conf.set(k, v)
        # An empty table makes the folder of marks.
        spark.createDataFrame([], stream.schema).coalesce(1).write.mode("append").parquet(marks)
        ig.drain(build(with_end(stream, ts, marks)), path)
        end(spark, stream.schema, ts, marks)
        ig.drain(build(with_end(stream, ts, marks)), path)
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)
    return spark.read.parquet(path).drop("batch_id")
