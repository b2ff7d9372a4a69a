"""Session settings shared by the operators."""

from __future__ import annotations

import tempfile
from concurrent.futures import ThreadPoolExecutor

from pyspark.sql import DataFrame, SparkSession

SMALL_ROWS_KEY = "spark.tablecare.smallRows"
BLOCK_ROWS_KEY = "spark.tablecare.blockRows"


def get_spark(app: str = "tablecare", master: str | None = None, **conf) -> SparkSession:
    """Session with the settings the operators rely on; cluster settings win when present."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    defaults = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.ui.enabled": "false",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
    }
    for key, value in {**defaults, **conf}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def small_rows(spark: SparkSession) -> int:
    """Row count up to which one task may sort or hold a whole key (a checked bound)."""
    return int(spark.conf.get(SMALL_ROWS_KEY, "1000000"))


def block_rows(spark: SparkSession) -> int:
    """Rows per block when a long ordered key is cut into pieces."""
    return int(spark.conf.get(BLOCK_ROWS_KEY, "500000"))


def shared_folder(spark: SparkSession) -> str:
    """The folder the cluster names in spark.checkpoint.dir; a temporary one only in local mode."""
    sc = spark.sparkContext
    folder = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir")
    if folder is None:
        if not sc.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder all executors share")
        folder = tempfile.mkdtemp(prefix="tablecare-")
    return folder


def together(*calls):
    """Results of independent passes over a table, submitted side by side so small jobs do not wait in line."""
    with ThreadPoolExecutor(max_workers=4) as pool:
        return [f.result() for f in [pool.submit(c) for c in calls]]


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(shared_folder(spark))


def settle(df: DataFrame) -> DataFrame:
    """Write the frame once to the shared checkpoint folder so later jobs see the same rows."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


# A plan estimated above this many bytes per allowed row is large without a count.
BYTES_PER_ROW = 10_000


def estimated_bytes(df: DataFrame) -> int | None:
    """The optimizer's size estimate of a plan; None where the session does not show it."""
    try:
        return int(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes().toString())
    except AttributeError:
        return None


def is_small(df: DataFrame, limit: int | None = None) -> bool:
    """Whether the frame has few enough rows for single-task work.

    The estimate may only say "large", which saves a count over big inputs; "small" is always counted.
    """
    most = small_rows(df.sparkSession)
    limit = most if limit is None else min(limit, most)
    if limit <= 0:
        return False
    size = estimated_bytes(df)
    if size is not None and size > limit * BYTES_PER_ROW:
        return False
    return df.count() <= limit
