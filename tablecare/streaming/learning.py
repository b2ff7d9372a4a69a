"""Models that learn batch by batch: gradient sums are Spark aggregates, only coefficients live on the driver."""

from __future__ import annotations

import math

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

STATE = "version bigint, last_batch bigint, w array<double>, count bigint, mean array<double>, m2 array<double>"


class OnlineLogistic:
    """Logistic regression with a running scaler, a replay buffer of a fixed size and a few gradient steps per batch.

    The buffer (``replay_path``, ``buffer_size`` rows at most) is a uniform sample of all rows seen: every row draws a priority once, and the
    rows with the largest ones stay. Buffer and model are written to two places in turn, so a run that fails while it writes leaves the
    version before whole.
    """

    def __init__(self, cols: list[str], label: str, rate: float = 0.5, steps: int = 5, replay_path: str | None = None, buffer_size: int = 1000, state_path: str | None = None):
        self.cols, self.label, self.rate, self.steps = cols, label, rate, steps
        self.w = [0.0] * (len(cols) + 1)
        self.count, self.mean, self.m2 = 0, [0.0] * len(cols), [0.0] * len(cols)
        self.replay_path, self.buffer_size, self.state_path = replay_path, buffer_size, state_path
        self.version = 0
        self.last_batch = -1
        self.history: list[tuple[int, int, float | None]] = []

    def _scaled(self) -> list:
        out = []
        for c, m, m2 in zip(self.cols, self.mean, self.m2):
            std = math.sqrt(m2 / self.count) if self.count and m2 > 0 else 1.0
            out.append((F.col(c).cast("double") - F.lit(m)) / F.lit(std))
        return out

    def _margin(self):
        z = F.lit(self.w[0])
        for w, x in zip(self.w[1:], self._scaled()):
            z = z + F.lit(w) * x
        return z

    def predict(self, df: DataFrame) -> DataFrame:
        p = 1 / (1 + F.exp(-self._margin()))
        return df.withColumns({"proba": p, "prediction": (p > 0.5).cast("int")})

    def _update_scaler(self, df: DataFrame) -> None:
        row = df.agg(F.count(F.lit(1)).alias("n"), *[f(F.col(c).cast("double")).alias(f"{k}{i}") for i, c in enumerate(self.cols)
                                                     for k, f in (("m", F.avg), ("v", F.var_pop))]).first()
        n = row["n"]
        for i in range(len(self.cols)):
            gap = row[f"m{i}"] - self.mean[i]
            total = self.count + n
            self.m2[i] += row[f"v{i}"] * n + gap * gap * self.count * n / total
            self.mean[i] += gap * n / total
        self.count += n

    def _step(self, df: DataFrame) -> None:
        err = 1 / (1 + F.exp(-self._margin())) - F.col(self.label)
        row = df.agg(F.avg(err).alias("g0"), *[F.avg(err * x).alias(f"g{i + 1}") for i, x in enumerate(self._scaled())]).first()
        self.w = [w - self.rate * (row[f"g{i}"] or 0.0) for i, w in enumerate(self.w)]

    def save(self, spark: SparkSession) -> None:
        """The model after a version, in place of the one two versions before."""
        row = (self.version, self.last_batch, self.w, self.count, self.mean, self.m2)
        spark.createDataFrame([row], STATE).coalesce(1).write.mode("overwrite").parquet(f"{self.state_path}/slot={self.version % 2}")

    def restore(self, spark: SparkSession) -> OnlineLogistic:
        """Go on from the newest saved version, if there is one."""
        for slot in (0, 1):
            try:
                row = spark.read.schema(STATE).parquet(f"{self.state_path}/slot={slot}").first()
            except AnalysisException as e:
                if e.getCondition() != "PATH_NOT_FOUND":
                    raise
                row = None
            if row is not None and row["version"] > self.version:
                self.version, self.last_batch, self.w, self.count, self.mean, self.m2 = (list(x) if isinstance(x, list) else x for x in row)
        return self

    def buffer(self, spark: SparkSession) -> DataFrame | None:
        """The rows kept for replay, with their priorities."""
        return spark.read.parquet(f"{self.replay_path}/slot={self.version % 2}") if self.replay_path and self.version else None

    def _refill(self, rows: DataFrame, old: DataFrame | None, version: int, batch_id: int) -> None:
        drawn = rows.withColumn("_priority", F.rand(seed=batch_id * 1_000_003 + 17))
        every = drawn if old is None else drawn.unionByName(old)
        every.orderBy(F.desc("_priority")).limit(self.buffer_size).write.mode("overwrite").parquet(f"{self.replay_path}/slot={version % 2}")

    def learn(self, batch: DataFrame, batch_id: int) -> None:
        """Score the batch with the model so far, then learn from it and from the replay buffer.

        A batch that comes again after a restart is not learned twice. With ``state_path`` the model is saved after each batch.
        """
        if batch_id <= self.last_batch:
            return
        rows = batch.select(*self.cols, self.label).dropna().persist()
        try:
            if rows.isEmpty():
                return
            accuracy = None
            if self.count:
                accuracy = self.predict(rows).agg(F.avg((F.col("prediction") == F.col(self.label)).cast("double"))).first()[0]
            self.history.append((batch_id, rows.count(), accuracy))
            self._update_scaler(rows)
            old = self.buffer(batch.sparkSession)
            train = rows if old is None else rows.unionByName(old.select(*self.cols, self.label))
            for _ in range(self.steps):
                self._step(train)
            if self.replay_path:
                self._refill(rows, old, self.version + 1, batch_id)
            self.version += 1
            self.last_batch = batch_id
            if self.state_path:
                self.save(batch.sparkSession)
        finally:
            rows.unpersist()


def prequential(stream: DataFrame, model: OnlineLogistic, checkpoint: str) -> list[tuple[int, int, float | None]]:
    """Test-then-train over a stream: (batch, rows, accuracy before learning)."""
    query = stream.writeStream.trigger(availableNow=True).option("checkpointLocation", checkpoint).foreachBatch(model.learn).start()
    query.awaitTermination()
    return model.history
