"""Small fitted tables: kept on the driver and broadcast only when their size is checked."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tablecare.session import settle

BROADCAST_ROWS = 50000


def fitted(params: DataFrame, limit: int = BROADCAST_ROWS) -> DataFrame:
    """Fit once. Up to ``limit`` rows become a broadcast table; more are written once and joined by shuffle.

    At most limit + 1 rows reach the driver.
    """
    rows = params.take(limit + 1)
    if len(rows) <= limit:
        return F.broadcast(params.sparkSession.createDataFrame(rows, params.schema))
    return settle(params)


def attach(df: DataFrame, params: DataFrame, keys: list[str], how: str = "left") -> DataFrame:
    """Join fitted parameters back to rows; adaptive skew handling covers a hot key on the shuffle way."""
    return df.join(fitted(params), keys, how)
