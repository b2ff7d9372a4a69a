"""Language identification by the nearest of several centroids per language, with rejection of texts far from all of them.

A text becomes a vector of its n-grams (1 to 4 bytes of UTF-8, ASCII lower-cased, runs of ASCII non-letters as one blank) hashed into
``BUCKETS`` places, weighted log(1 + count) * idf and normalised to length 1. Document frequencies are counted over every labelled row.
Only the centroids are fitted on a bounded sample: the ``fit_rows`` labelled rows per language with the smallest hash of their id.
Spherical k-means gives ``centroids`` centres per language. A text takes the language of the centre with the largest cosine; ties go to
the smaller language name. It is rejected when that cosine is below the limit of the centre's language for texts of its length: the ``low``
quantile of the cosines that sample rows have with centres fitted without them. Fewer rows than show that quantile (three of them below
it) give an estimate of the lowest cosine possible instead. A language that passages of known ones quote at length isn't told by this.

Null texts and texts without a letter give ``und``, score 0, and are rejected. When nothing was learned, texts with letters give ``und``
with score 0 and are not rejected. Repeated rows are judged row by row. Columns other than the named ones play no part. Very long texts
are read whole; vectors have a fixed size. Null ids are never part of the sample.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tablecare.llm.common import modest_batches, release_memory, slices, smallest_hashes, text_buffers

BUCKETS = 8192
MAX_LANGUAGES = 512
_MAP = np.full(256, 32, np.uint8)
_MAP[128:] = np.arange(128, 256)
_MAP[97:123] = np.arange(97, 123)
_MAP[65:91] = np.arange(97, 123)
_SHORT = np.array([0, 8, 32, 128, 1 << 62])  # text lengths in grams at which rejection limits change


@dataclass
class Model:
    """Learned languages (one per centre), unit centres, idf, and rejection limits per centre and length class."""

    languages: list[str]
    centres: np.ndarray
    idf: np.ndarray
    limits: np.ndarray


def counts(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Gram counts, one row of BUCKETS per text."""
    rows = len(offsets) - 1
    row = np.repeat(np.arange(rows), np.diff(offsets))
    # Every text gets a blank before and after, so that word ends show; runs of blanks count once.
    at = np.arange(len(data)) + 2 * row + 1
    text = np.full(len(data) + 2 * rows, 32, np.uint8)
    owner = np.repeat(np.arange(rows), np.diff(offsets) + 2)
    text[at] = _MAP[data]
    keep = np.ones(len(text), bool)
    keep[1:] = (text[1:] != 32) | (text[:-1] != 32) | (owner[1:] != owner[:-1])
    text, owner = text[keep].astype(np.uint32), owner[keep]
    out = np.zeros(rows * BUCKETS, np.int64)
    gram = np.zeros(len(text), np.uint32)
    for n in range(1, 5):
        gram = gram[: len(text) - n + 1] * np.uint32(256) + text[n - 1 :] if len(text) >= n else gram[:0]
        if n == 1:
            fine = text != 32
        else:
            fine = owner[: len(gram)] == owner[n - 1 :]
        place = ((gram ^ np.uint32(n * 0x51ED27)) * np.uint32(0x9E3779B1)) >> np.uint32(19)
        out += np.bincount((owner[: len(gram)] * BUCKETS + place)[fine], minlength=len(out))
    return out.reshape(rows, BUCKETS)


def _pieces(offsets: np.ndarray):
    for a, b in slices(offsets):
        for k in range(a, b, 96):
            yield k, min(b, k + 96)


def vectors(found: np.ndarray, idf: np.ndarray) -> np.ndarray:
    out = np.log1p(found, dtype=np.float32)
    out *= idf.astype(np.float32)
    return out / np.maximum(np.linalg.norm(out, axis=1, keepdims=True), 1e-12)


def _document_frequency(column_at: int):
    def run(batches):
        total, rows = np.zeros(BUCKETS, np.int64), 0
        for batch in batches:
            data, offsets = text_buffers(batch.column(column_at))
            for a, b in _pieces(offsets):
                part = offsets[a : b + 1]
                total += (counts(data[part[0] : part[-1]], part - part[0]) > 0).sum(axis=0)
            rows += batch.num_rows
        where = np.flatnonzero(total)
        release_memory()
        yield pa.record_batch([pa.array(np.append(where, -1).astype(np.int32)), pa.array(np.append(total[where], rows))], names=["place", "n"])

    return run


def _sample_vectors(idf: np.ndarray):
    def run(batches):
        for batch in batches:
            data, offsets = text_buffers(batch.column(1))
            for a, b in _pieces(offsets):
                part = offsets[a : b + 1]
                found = counts(data[part[0] : part[-1]], part - part[0])
                yield pa.record_batch([batch.column(0).slice(a, b - a), pa.array([v.tobytes() for v in vectors(found, idf)], pa.binary()),
                                       pa.array(found.sum(axis=1))], names=["language", "vector", "grams"])
        release_memory()

    return run


def _cluster(x: np.ndarray, grams: np.ndarray, k: int) -> np.ndarray:
    """Spherical k-means: start from the mean and the rows farthest from all centres, 12 rounds."""
    unit = lambda v: v / max(np.linalg.norm(v), 1e-12)
    long = x[grams >= np.median(grams)]
    c = [unit(long.mean(axis=0))]
    while len(c) < min(k, len(long)):
        c.append(long[np.argmin((long @ np.array(c).T).max(axis=1))])
    c = np.array(c)
    for _ in range(12):
        near = (x @ c.T).argmax(axis=1)
        c = np.array([unit(x[near == j].mean(axis=0)) if (near == j).any() else c[j] for j in range(len(c))])
    return c


def _unseen(x: np.ndarray, grams: np.ndarray, k: int, folds: int = 4) -> np.ndarray:
    """Each row's largest cosine with centres fitted without its fold; a row alone has its own."""
    if len(x) < 2:
        return np.ones(len(x))
    fold, out = np.arange(len(x)) % folds, np.empty(len(x))
    for i in range(min(folds, len(x))):
        rest = fold != i
        out[~rest] = (x[~rest] @ _cluster(x[rest], grams[rest], k).T).max(axis=1)
    return out


def _low_end(close: np.ndarray, low: float) -> float:
    """The ``low`` quantile, or with too few rows for it the lowest value less its distance from the next one."""
    if low * len(close) >= 3:
        return float(np.quantile(close, low))
    least = np.sort(close)[:2]
    return max(0.0, float(2 * least[0] - least[1])) if len(least) > 1 else 0.5 * float(least[0])


def _centres(k: int, low: float):
    """Centres of one language's sample, and its limits per length class."""

    def run(group: pa.Table) -> pa.Table:
        x = np.frombuffer(b"".join(group.column("vector").to_pylist()), np.float32).reshape(-1, BUCKETS)
        grams = group.column("grams").to_numpy()
        order = np.lexsort((x @ x.sum(axis=0), grams))
        x, grams = x[order], grams[order]
        c = _cluster(x, grams, k)
        close = _unseen(x, grams, k)
        kind = np.searchsorted(_SHORT, grams, "right") - 1
        limits, least = [], 1.0
        for j in range(len(_SHORT) - 2, -1, -1):  # a shorter text never has a higher limit than a longer one
            mine = close[kind == j]
            least = min(least, _low_end(mine, low)) if len(mine) else least * 0.5
            limits.append(least)
        return pa.table({"language": pa.array([group.column("language")[0].as_py()] * len(c), pa.string()),
                         "centre": pa.array([v.astype(np.float32).tobytes() for v in c], pa.binary()),
                         "limits": pa.array([limits[::-1]] * len(c), pa.list_(pa.float64()))})

    return run


def fit(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "lang", *, centroids: int = 4,
        fit_rows: int = 800, low: float = 0.01) -> Model:
    """Learn from the rows whose label is not null and whose text holds something."""
    modest_batches(docs.sparkSession)
    rows = docs.select(F.col(id_col).alias("id"), F.col(label_col).cast("string").alias("language"), F.col(text_col).alias("text")).where(
        "language IS NOT NULL AND text IS NOT NULL AND text <> ''")
    found = rows.select("text").mapInArrow(_document_frequency(0), "place int, n long").groupBy("place").agg(F.sum("n").alias("n")).collect()  # BUCKETS + 1 rows at most
    seen = {r.place: r.n for r in found}
    df = np.array([seen.get(i, 0) for i in range(BUCKETS)], float)
    idf = np.log((1 + seen.get(-1, 0)) / (1 + df)) + 1
    named = rows.where("id IS NOT NULL").select("id", "language")
    counted = {r["language"]: r["count"] for r in named.groupBy("language").count().limit(MAX_LANGUAGES + 1).collect()}
    if len(counted) > MAX_LANGUAGES:
        raise ValueError(f"over {MAX_LANGUAGES} labels can't be learned")
    chosen = smallest_hashes(named, "language", "id", fit_rows, counted)  # at most MAX_LANGUAGES * fit_rows ids, so they are broadcast
    sample = rows.join(F.broadcast(chosen), ["id", "language"], "left_semi")
    made = sample.select("language", "text").mapInArrow(_sample_vectors(idf), "language string, vector binary, grams long")
    learned = made.groupBy("language").applyInArrow(_centres(centroids, low), "language string, centre binary, limits array<double>").collect()
    learned = sorted(((r.language, bytes(r.centre), tuple(r.limits)) for r in learned))
    return Model([r[0] for r in learned], np.array([np.frombuffer(r[1], np.float32) for r in learned]).reshape(-1, BUCKETS), idf,
                 np.array([r[2] for r in learned]).reshape(-1, len(_SHORT) - 1))


def _has_letter(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    mapped = _MAP[data]
    run = np.concatenate([[0], np.cumsum((mapped != 32) & (data < 128))])
    out = run[offsets[1:]] > run[offsets[:-1]]
    for i in np.flatnonzero(~out & (offsets[1:] > offsets[:-1])):
        out[i] = any(map(str.isalpha, data[offsets[i] : offsets[i + 1]].tobytes().decode("utf-8", "replace")))
    return out


def judge(column, model: Model) -> tuple[list[str], np.ndarray, np.ndarray]:
    """Language, score and rejection of every text of an Arrow string column."""
    data, offsets = text_buffers(column)
    letters = _has_letter(data, offsets)
    languages, score, rejected = ["und"] * (len(offsets) - 1), np.zeros(len(offsets) - 1), ~letters
    if not model.languages:
        return languages, score, rejected
    for a, b in _pieces(offsets):
        part = offsets[a : b + 1]
        found = counts(data[part[0] : part[-1]], part - part[0])
        near = vectors(found, model.idf) @ model.centres.T
        best = near.argmax(axis=1)
        cosine = np.clip(near[np.arange(b - a), best].astype(float), 0, 1)
        kind = np.searchsorted(_SHORT, found.sum(axis=1), "right") - 1
        score[a:b] = np.where(letters[a:b], cosine, 0)
        rejected[a:b] |= cosine < model.limits[best, kind]
        for i in range(a, b):
            if letters[i]:
                languages[i] = model.languages[best[i - a]]
    return languages, score, rejected


def predict(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id_col, lang_pred, score, rejected for every row; only the text is looked at."""

    def run(batches):
        for batch in batches:
            languages, score, rejected = judge(batch.column(1), model)
            yield pa.record_batch([batch.column(0), pa.array(languages, pa.string()), pa.array(score), pa.array(rejected)], names=names)
        release_memory()

    modest_batches(docs.sparkSession)
    rows = docs.select(id_col, text_col)
    names = [id_col, "lang_pred", "score", "rejected"]
    return rows.mapInArrow(run, f"`{id_col}` {rows.schema[0].dataType.simpleString()}, lang_pred string, score double, rejected boolean")


def keep_known(docs: DataFrame, model: Model, text_col: str = "text") -> DataFrame:
    """The rows of ``docs``, with all their columns, whose text is not rejected."""
    at = docs.columns.index(text_col)

    def run(batches):
        for batch in batches:
            yield batch.filter(pc.invert(pa.array(judge(batch.column(at), model)[2])))
        release_memory()

    modest_batches(docs.sparkSession)
    return docs.mapInArrow(run, docs.schema)
