"""Cross products of number arrays: one small matrix per task, added up on the driver."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def gram(df: DataFrame, vector: str, width: int) -> np.ndarray:
    """X'X of an array column of fixed width; Arrow batches are reduced in each task, then summed by cell."""
    def per_task(batches):
        total = np.zeros((width, width))
        for pdf in batches:
            if len(pdf):
                x = np.stack(pdf[vector].to_numpy()).astype(float)
                total += x.T @ x
        yield pd.DataFrame({"cells": [total.ravel().tolist()]})

    parts = df.select(vector).mapInPandas(per_task, "cells array<double>")
    cells = parts.select(F.posexplode("cells").alias("i", "v")).groupBy("i").agg(F.sum("v").alias("v"))
    out = np.zeros(width * width)
    for r in cells.collect():
        out[r["i"]] = r["v"]
    return out.reshape(width, width)


def least_squares(df: DataFrame, xs: list[str], y: str) -> tuple[list[float], float]:
    """Coefficients and intercept of a linear fit over complete rows, from one pass of covariances."""
    rows = df.select(*[F.col(c).cast("double").alias(c) for c in [*xs, y]]).dropna()
    aggs = [F.avg(c).alias(f"m_{c}") for c in [*xs, y]]
    pairs = [(a, b) for i, a in enumerate(xs) for b in [*xs[i:], y]]
    aggs += [F.covar_pop(a, b).alias(f"s{i}") for i, (a, b) in enumerate(pairs)]
    row = rows.agg(*aggs).first()
    at = {p: row[f"s{i}"] or 0.0 for i, p in enumerate(pairs)}
    cov = np.array([[at[(a, b)] if (a, b) in at else at[(b, a)] for b in xs] for a in xs])
    beta = np.linalg.lstsq(cov, np.array([at[(a, y)] for a in xs]), rcond=None)[0]
    if row[f"m_{y}"] is None:
        return [0.0] * len(xs), 0.0
    return [float(b) for b in beta], float(row[f"m_{y}"] - sum(b * row[f"m_{x}"] for b, x in zip(beta, xs)))
