"""Scratch tables in the shared folder, connected components, and Arrow text buffers, used by the operators of this subpackage."""

from __future__ import annotations

import ctypes
import gc
import tempfile
import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tablecare.session import shared_folder

_local: dict[str, str] = {}


def scratch_root(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir; one temporary folder per local application where it is unset."""
    sc = spark.sparkContext
    if spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir") or not sc.master.startswith("local["):
        return shared_folder(spark).rstrip("/")
    return "file://" + _local.setdefault(sc.applicationId, tempfile.mkdtemp(prefix="tablecare-llm-"))


BATCH_KEY, BATCH_ROWS = "spark.sql.execution.arrow.maxRecordsPerBatch", "10000"


def modest_batches(spark: SparkSession, rows: int = 1000) -> None:
    """Texts go to Python in batches of ``rows``, unless the session has a value of its own: Spark's default holds 10,000 texts at a time."""
    if spark.conf.get(BATCH_KEY, BATCH_ROWS) == BATCH_ROWS:
        spark.conf.set(BATCH_KEY, str(rows))


def release_memory() -> None:
    """Give free memory of a Python worker back at the end of a task; the worker lives on for other stages."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (OSError, AttributeError):  # not every C library has it
        pass


class Workspace:
    """Tables written once to the shared folder, so that lineage is cut and a lost executor costs no recomputation."""

    def __init__(self, spark: SparkSession):
        self.spark = spark
        self.root = f"{scratch_root(spark)}/llm-{uuid.uuid4().hex}"
        self.made = 0

    def put(self, df: DataFrame, label: str) -> DataFrame:
        self.made += 1
        path = f"{self.root}/{self.made:03d}-{label}"
        df.write.parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def folder(self, label: str) -> str:
        self.made += 1
        return f"{self.root}/{self.made:03d}-{label}"

    def finish(self, df: DataFrame) -> DataFrame:
        """Keep only this table: write it, and delete the workspace's other tables."""
        kept = Workspace(self.spark).put(df, "result")
        path = self.spark._jvm.org.apache.hadoop.fs.Path(self.root)
        path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)
        return kept


def components(ws: Workspace, edges: DataFrame) -> DataFrame:
    """(node, component) for every node of ``edges`` (columns a, b); component is the smallest reachable node.

    Large-star and small-star rounds: each points nodes at the smallest neighbour, so stars form in a logarithmic number of rounds.
    A round is two grouped minima and two joins; nothing is gathered on the driver but two numbers. Minima and edges are stored before
    they are joined, so that a join alone deals out the edges and Spark can split those of a hub over several tasks.
    """
    pairs = edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()
    state, seen = ws.put(pairs, "edges"), None
    while True:
        now = state.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == seen or not now[0]:
            break
        seen = now
        near = state.select(F.col("v").alias("x"), F.col("v").alias("y")).union(state.select("u", "v")).groupBy("x").agg(F.min("y").alias("m"))
        near = ws.put(near, "near")
        large = ws.put(state.join(near, F.col("v") == F.col("x")).select("u", F.col("m").alias("v")).distinct(), "large")
        low = ws.put(large.groupBy("u").agg(F.min("v").alias("m")), "low")
        small = large.join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u > v").union(low.select("u", F.col("m").alias("v")))
        state = ws.put(small.distinct(), "edges")
    return state.select(F.col("u").alias("node"), F.col("v").alias("component")).union(
        state.select(F.col("v").alias("node"), F.col("v").alias("component"))).groupBy("node").agg(F.min("component").alias("component"))


def smallest_hashes(rows: DataFrame, group: str, id_col: str, most: int, counts: dict[str, int]) -> DataFrame:
    """The ``most`` rows of each group with the smallest hash of their id; ``counts`` are the rows per group, a table that fits a plan.

    Rows far above the group's quantile are left out first, so that what meets in a group's task doesn't grow with the table.
    """
    place = F.pmod(F.xxhash64(id_col), F.lit(2**61 - 1))
    shares = F.create_map(*[F.lit(x) for g, n in counts.items() for x in (g, int(min(1.0, 2 * most / n + 64 / n) * (2**61 - 1)))])
    few = rows.withColumn("_hash", place).where(F.col("_hash") <= F.element_at(shares, F.col(group))) if counts else rows.limit(0).withColumn("_hash", place)
    rank = F.row_number().over(Window.partitionBy(group).orderBy("_hash", id_col))
    return few.withColumn("_place", rank).where(F.col("_place") <= most).drop("_hash", "_place")


def text_buffers(column) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes and offsets (one more than rows) of an Arrow string column; a null is an empty text."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks() if column.num_chunks != 1 else column.chunk(0)
    column = column.cast(pa.large_string()).fill_null("")
    buffers = column.buffers()
    offsets = np.frombuffer(buffers[1], np.int64)[column.offset : column.offset + len(column) + 1] if len(column) else np.zeros(1, np.int64)
    data = np.frombuffer(buffers[2], np.uint8)[offsets[0] : offsets[-1]] if buffers[2] is not None else np.zeros(0, np.uint8)
    return data, offsets - offsets[0]


def slices(offsets: np.ndarray, most: int = 1 << 20):
    """Row ranges of about ``most`` bytes each (one row at least), which bounds the arrays made at a time."""
    start, n = 0, len(offsets) - 1
    while start < n:
        stop = max(start + 1, int(np.searchsorted(offsets, offsets[start] + most, "right")) - 1)
        yield start, stop
        start = stop


def mix64(x: np.ndarray) -> np.ndarray:
    """The bijective 64-bit finalizer of splitmix."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")
