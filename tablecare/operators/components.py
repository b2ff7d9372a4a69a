"""Truncated singular value decomposition of wide sparse rows: a randomised range finder with tall-skinny QR.

Rows are (id, places, weights): sparse vectors over ``width`` columns. What meets on the driver are matrices of the columns or less by the
number of components and a few more: 65,536 columns by 60 are 31 MB. The rows themselves, and their sketches, stay on executors.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MOST_COLUMNS = 65_536
EXTRA, ROUNDS, SEED = 10, 2, 5
GROUPS = 64


def _products(places, weights, right: np.ndarray) -> np.ndarray:
    """Sparse rows times a matrix."""
    ends = places.offsets.to_numpy()
    out = np.zeros((len(places), right.shape[1]))
    flat, w = places.flatten().to_numpy(zero_copy_only=False), weights.flatten().to_numpy(zero_copy_only=False)
    for a in range(0, len(out), 256):  # a few rows' products at a time
        b = min(a + 256, len(out))
        x, y = ends[a] - ends[0], ends[b] - ends[0]
        filled = np.flatnonzero(np.diff(ends[a : b + 1]))
        if len(filled):
            out[a + filled] = np.add.reduceat(right[flat[x:y]] * w[x:y, None], ends[a + filled] - ends[a])
    return out


def tall_qr(rows: DataFrame, right: np.ndarray) -> np.ndarray:
    """The triangular factor R of (rows times ``right``), which has few columns: tasks factor what they read, groups of tasks factor their factors."""
    width = right.shape[1]

    def upper(pieces):
        r = np.zeros((0, width))
        for y in pieces:
            r = np.linalg.qr(np.vstack([r, y]), mode="r")
        return r

    def run(batches):
        r = upper(_products(b.column(0), b.column(1), right) for b in batches if b.num_rows)
        if len(r):
            yield pa.record_batch([pa.array([r.ravel().tolist()], pa.list_(pa.float64()))], names=["r"])

    def again(group: pa.Table) -> pa.Table:
        r = upper(np.array(x).reshape(-1, width) for x in group.column("r").to_pylist())
        return pa.table({"r": pa.array([r.ravel().tolist()], pa.list_(pa.float64()))})

    factors = rows.select("places", "weights").mapInArrow(run, "r array<double>")
    few = factors.groupBy(F.pmod(F.xxhash64("r"), F.lit(GROUPS))).applyInArrow(again, "r array<double>").collect()
    return upper(np.array(x["r"]).reshape(-1, width) for x in few)


def _gathered(rows: DataFrame, right: np.ndarray, columns: int) -> np.ndarray:
    """Transpose of the rows times (rows times ``right``): a sum per column, taken in each task first."""
    width = right.shape[1]

    def run(batches):
        total = np.zeros((columns, width))
        for b in batches:
            if b.num_rows:
                y = _products(b.column(0), b.column(1), right)
                owner = np.repeat(np.arange(b.num_rows), np.diff(b.column(0).offsets.to_numpy()))
                places, weights = b.column(0).flatten().to_numpy(zero_copy_only=False), b.column(1).flatten().to_numpy(zero_copy_only=False)
                for a in range(0, len(places), 1 << 20):
                    here, by, times = places[a : a + (1 << 20)], owner[a : a + (1 << 20)], weights[a : a + (1 << 20)]
                    for j in range(width):
                        total[:, j] += np.bincount(here, y[by, j] * times, minlength=columns)
        seen = np.flatnonzero(total.any(axis=1))
        if len(seen):
            ends = np.arange(len(seen) + 1, dtype=np.int32) * width
            yield pa.record_batch([pa.array(seen, pa.int32()), pa.ListArray.from_arrays(pa.array(ends), pa.array(total[seen].ravel()))], names=["place", "v"])

    parts = rows.select("places", "weights").mapInArrow(run, "place int, v array<double>")
    sums = parts.groupBy("place").agg(F.array(*[F.sum(F.get("v", F.lit(i))) for i in range(width)]).alias("v")).collect()
    out = np.zeros((columns, width))
    for r in sums:
        out[r["place"]] = r["v"]
    return out


def truncated_svd(rows: DataFrame, columns: int, components: int, rounds: int = ROUNDS) -> tuple[np.ndarray, np.ndarray]:
    """(singular values, right vectors as columns), largest first, at most ``components``.

    A random matrix is put through the rows (range), made orthogonal by the triangular factor, and put back; each further round sharpens the
    subspace. The sign of a vector is chosen so that its largest component is positive.
    """
    if columns > MOST_COLUMNS:
        raise ValueError(f"over {MOST_COLUMNS} columns")
    width = min(components + EXTRA, columns)
    right = np.random.default_rng(SEED).normal(size=(columns, width))
    back = np.zeros((columns, 0))
    for _ in range(rounds + 1):
        r = tall_qr(rows, right)
        if not len(r):
            return np.zeros(0), np.zeros((columns, 0))
        # Columns that the range doesn't fill are left out.
        u, s, vt = np.linalg.svd(r)
        good = s > s[0] * 1e-12 if len(s) else np.zeros(0, bool)
        if not good.any():
            return np.zeros(0), np.zeros((columns, 0))
        mix = vt[: len(s)][good].T / s[good]
        back = _gathered(rows, right @ mix, columns)  # the rows' transpose times an orthonormal basis of the range
        right = np.linalg.qr(back)[0]
    vectors, values, _ = np.linalg.svd(back, full_matrices=False)
    keep = min(components, int((values > values.max(initial=0) * 1e-10).sum()))
    vectors = vectors[:, :keep]
    sign = np.sign(vectors[np.abs(vectors).argmax(axis=0), np.arange(keep)]) if keep else np.ones(0)
    return values[:keep], vectors * sign


def project(rows: DataFrame, vectors: np.ndarray, out: str = "components") -> DataFrame:
    """id and the row's coordinates on the vectors."""
    kind = dict(rows.dtypes)["id"]

    def run(batches):
        for b in batches:
            y = _products(b.column(1), b.column(2), vectors) if b.num_rows else np.zeros((0, vectors.shape[1]))
            ends = np.arange(len(y) + 1, dtype=np.int32) * vectors.shape[1]
            yield pa.record_batch([b.column(0), pa.ListArray.from_arrays(pa.array(ends), pa.array(y.ravel()))], names=["id", out])

    return rows.select("id", "places", "weights").mapInArrow(run, f"id {kind}, {out} array<double>")
