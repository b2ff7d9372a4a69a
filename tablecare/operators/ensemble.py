"""Voting, stacking, blending, dynamic choice and fitted weights over model outputs."""

from __future__ import annotations

import numpy as np
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tablecare.operators.models import FEATURES, assembler
from tablecare.operators.nearest import nearest
from tablecare.session import settle


def normalized(scores: dict[str, float]) -> dict[str, float]:
    """Fold scores to weights: negative ones count as zero, all zero gives equal weights."""
    floor = {k: max(0.0, v) for k, v in scores.items()}
    total = sum(floor.values())
    return {k: v / total if total else 1.0 / len(floor) for k, v in floor.items()}


def soft_vote(proba: dict[str, Column], weights: dict[str, float] | None = None) -> Column:
    """Weighted mean of the class-1 probabilities."""
    w = weights or {k: 1.0 for k in proba}
    total = sum(w.values())
    out = F.lit(0.0)
    for k, c in proba.items():
        out = out + c * (w[k] / total)
    return out


def hard_vote(preds: dict[str, Column], weights: dict[str, float] | None = None) -> Column:
    """Class with the greatest total weight; the smallest class wins a tie."""
    w = weights or {k: 1.0 for k in preds}
    votes = F.array(*[F.struct(c.cast("double").alias("c"), F.lit(float(w[k])).alias("w")) for k, c in preds.items()])
    classes = F.array_distinct(F.transform(votes, lambda v: v["c"]))
    totals = F.transform(classes, lambda c: F.struct(
        F.aggregate(F.filter(votes, lambda v: v["c"] == c), F.lit(0.0), lambda a, v: a + v["w"]).alias("w"), (-c).alias("neg")))
    return -F.array_max(totals)["neg"]


def accuracy_weights(df: DataFrame, y: str, preds: list[str]) -> dict[str, float]:
    row = df.agg(*[F.avg((F.col(y) == F.col(p)).cast("double")).alias(p) for p in preds]).first()
    return normalized(row.asDict())


def simplex(v: np.ndarray) -> np.ndarray:
    """Nearest point with non-negative parts that sum to one."""
    u = np.sort(v)[::-1]
    cut = (np.cumsum(u) - 1) / np.arange(1, len(v) + 1)
    k = np.nonzero(u > cut)[0][-1]
    return np.maximum(v - cut[k], 0.0)


def fitted_weights(df: DataFrame, y: str, preds: list[str], steps: int = 2000) -> dict[str, float]:
    """Weights that minimise the squared error, from one aggregate of cross products; projected descent on the driver."""
    cols = [*preds, y]
    pairs = [(a, b) for i, a in enumerate(cols) for b in cols[i:]]
    row = df.agg(*[F.avg(F.col(a).cast("double") * F.col(b)).alias(f"s{i}") for i, (a, b) in enumerate(pairs)]).first()
    at = {p: row[f"s{i}"] for i, p in enumerate(pairs)}
    q = np.array([[at.get((a, b), at.get((b, a))) for b in preds] for a in preds])
    p = np.array([at[(a, y)] for a in preds])
    w = np.full(len(preds), 1.0 / len(preds))
    rate = 1.0 / max(np.linalg.eigvalsh(q)[-1], 1e-12)
    for _ in range(steps):
        w = simplex(w - rate * (q @ w - p))
    return dict(zip(preds, (float(x) for x in w)))


def _proba(df: DataFrame, model, out: str) -> DataFrame:
    scored = model.transform(df)
    value = F.get(vector_to_array("probability"), F.lit(1)) if "probability" in scored.columns else F.col("prediction")
    return scored.withColumn(out, value).select(*df.columns, out)


def held_out(df: DataFrame, models: dict, folds: int, fold: str = "fold") -> DataFrame:
    """Class-1 probability of each model for every row, from models that did not see the row's fold."""
    parts = None
    for i in range(folds):
        part = df.where(F.col(fold) == i)
        for name, est in models.items():
            part = _proba(part, est.fit(df.where(F.col(fold) != i)), f"p_{name}")
        parts = part if parts is None else parts.unionByName(part)
    return parts


def stack(df: DataFrame, models: dict, cols: list[str], label: str, folds: int = 3, fold: str = "fold", layers: int = 1):
    """Out-of-fold predictions feed a logistic regression; more layers repeat it on the predictions.

    Returns a function that scores new assembled rows.
    """
    ready = settle(assembler(cols).transform(df).select(FEATURES, label, fold))
    names = [f"p_{n}" for n in models]
    levels = []
    current = ready
    for _ in range(layers):
        levels.append({n: e.fit(current) for n, e in models.items()})
        outs = settle(held_out(current, models, folds, fold))
        current = assembler(names).transform(outs.drop(FEATURES)).select(FEATURES, label, fold)
    meta = LogisticRegression(featuresCol=FEATURES, labelCol=label, maxIter=50).fit(current)

    def predict(rows: DataFrame) -> DataFrame:
        keep = rows.columns
        out = assembler(cols).transform(rows)
        for level in levels:
            for n, m in level.items():
                out = _proba(out, m, f"p_{n}")
            out = assembler(names).transform(out.drop(FEATURES)).drop(*names)
        return meta.transform(out).select(*keep, "prediction", F.get(vector_to_array("probability"), F.lit(1)).alias("proba"))

    return predict


def blend(df: DataFrame, models: dict, cols: list[str], label: str, key: list[str], share: float = 0.2):
    """Base models on the larger part, a logistic regression on the hash-chosen rest."""
    ready = assembler(cols).transform(df)
    rest = F.pmod(F.xxhash64(*key), F.lit(1000)) < int(share * 1000)
    fitted = {n: e.fit(ready.where(~rest)) for n, e in models.items()}
    names = [f"p_{n}" for n in models]

    def base(rows: DataFrame) -> DataFrame:
        for n, m in fitted.items():
            rows = _proba(rows, m, f"p_{n}")
        return assembler(names).transform(rows.drop(FEATURES))

    meta = LogisticRegression(featuresCol=FEATURES, labelCol=label, maxIter=50).fit(base(ready.where(rest)))

    def predict(rows: DataFrame) -> DataFrame:
        out = meta.transform(base(assembler(cols).transform(rows)))
        return out.select(*rows.columns, "prediction", F.get(vector_to_array("probability"), F.lit(1)).alias("proba"))

    return predict


def dynamic_choice(rows: DataFrame, known: DataFrame, key: str, vector: str, label: str, preds: list[str], k: int = 10) -> DataFrame:
    """For each row the model with the best accuracy among its k nearest known rows; the first model wins a tie."""
    near = nearest(rows, known, key, key, vector, vector, k)
    hits = known.select(F.col(key).alias("cid"), *[(F.col(p) == F.col(label)).cast("double").alias(f"_h{i}") for i, p in enumerate(preds)])
    local = near.join(hits, "cid").groupBy("qid").agg(*[F.avg(f"_h{i}").alias(f"_a{i}") for i in range(len(preds))])
    joined = rows.join(local, rows[key] == local["qid"])
    options = F.array(*[F.struct(F.col(f"_a{i}").alias("a"), F.lit(-i).alias("order"), F.lit(p).alias("model"), F.col(p).cast("double").alias("prediction"))
                        for i, p in enumerate(preds)])
    best = F.array_max(options)
    return joined.select(key, best["model"].alias("model"), best["prediction"].alias("prediction"), best["a"].alias("local_accuracy"))


def online_weights(df: DataFrame, batch: str, y: str, preds: list[str], recent: int = 10, floor: float = 0.1) -> DataFrame:
    """Weights per batch from the mean accuracy of the batches before it, at least the floor, summing to one."""
    from pyspark.sql import Window as W

    per = df.groupBy(batch).agg(*[F.avg((F.col(p) == F.col(y)).cast("double")).alias(p) for p in preds])
    # One row per batch and model; a batch number is a small ordered key, windowed per model.
    long = per.select(batch, F.explode(F.array(*[F.struct(F.lit(p).alias("model"), F.col(p).alias("accuracy")) for p in preds])).alias("r")).select(batch, "r.*")
    w = W.partitionBy("model").orderBy(batch).rowsBetween(-(recent - 1), 0)
    raw = long.withColumn("_w", F.greatest(F.avg("accuracy").over(w), F.lit(floor)))
    return raw.withColumn("weight", F.col("_w") / F.sum("_w").over(W.partitionBy(batch))).drop("_w")
