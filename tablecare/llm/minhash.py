"""MinHash near-duplicates: circulant signatures, bands, and an exact check of the Jaccard similarity on full shingle sets.

A signature needs two permutations only. The first (sigma) relabels shingles into a universe of 2**32; the second (pi) is shifted
circularly by one place for each coordinate: coordinate k is the smallest pi((sigma(s) - k) mod 2**32) over the shingles s.
Bands of ``rows`` coordinates put documents into buckets, and links are found by comparing sorted fingerprints of all shingles, exactly.
Hot groups are handled without pairs in Spark:

* documents with the same word sequence collapse to one class before banding; buckets with the same members are kept once;
* each member of a bucket is first compared with the bucket's hub, in blocks of members, so that a large group of close copies costs one
  pass. The hub is the member whose buckets are the largest together (ties to the smallest class): the text that copies were made of shares
  a bucket with more of them than any copy does, also where copies are linked with it and not with each other;
* what the hub's links don't join is compared inside its bucket only, in blocks: each member that is not in the hub's component with the
  bucket's members that are not in its own. Buckets of at most ``SMALL`` list these pairs, each once whatever buckets it shares; larger
  ones are compared in blocks. Chains of buckets cost nothing: a document meets only those it shares a band with.

Fingerprints are made and shuffled of documents that share a bucket; the texts of others are read once and go nowhere. Sets whose sizes
alone rule a link out are not intersected.

Row order plays no part. Empty and null texts have no shingles and link with nothing. A null id is never linked (component null, kept).
Rows that repeat an id count as one document. Columns besides id and text are ignored. An empty table gives an empty result.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tablecare.llm import shingles
from tablecare.llm.common import Workspace, components, mix64, modest_batches, release_memory, slices, text_buffers
from tablecare.llm.exact import bit_exponent, bit_table, flagged

BANDS, ROWS = 32, 4
BLOCK_DOCS, BLOCK_SHINGLES = 600, 2_000_000
#: Members that meet their hub at a time, and the size up to which a bucket's open pairs are listed.
HUB_BLOCK, SMALL = 200, 32


def circulant(values: np.ndarray, have: np.ndarray, size: int) -> np.ndarray:
    """Signatures (rows with shingles, ``size``) as uint32; ``values`` are the shingles row by row, ``have`` their numbers."""
    sigma = (mix64(values ^ np.uint64(0x5851F42D4C957F2D)) >> np.uint64(32)).astype(np.uint32)
    begin = (np.cumsum(have) - have)[have > 0]
    out = np.empty((len(begin), size), np.uint32)
    x, t = np.empty_like(sigma), np.empty_like(sigma)
    for k in range(size):
        np.subtract(sigma, np.uint32(k), out=x)
        for shift, factor in ((16, 0x85EBCA6B), (13, 0xC2B2AE35), (16, 0)):
            np.right_shift(x, np.uint32(shift), out=t)
            np.bitwise_xor(x, t, out=x)
            if factor:
                np.multiply(x, np.uint32(factor), out=x)
        out[:, k] = np.minimum.reduceat(x, begin)
    return out


def band_keys(signatures: np.ndarray, bands: int, rows: int) -> np.ndarray:
    keys = np.zeros((len(signatures), bands), np.uint64)
    for b in range(bands):
        key = np.full(len(signatures), b + 1, np.uint64)
        for r in range(rows):
            key = mix64(key * np.uint64(0x9E3779B97F4A7C15) + signatures[:, b * rows + r])
        keys[:, b] = key
    return keys.view(np.int64)


def signature_table(docs: DataFrame, id_col: str, text_col: str, width: int, bands: int, rows: int) -> DataFrame:
    """One row per document: id, keys of its word sequence (s1, s2), number of shingles, band keys."""

    def run(batches):
        for batch in batches:
            data, offsets = text_buffers(batch.column(1))
            for a, b in slices(offsets):
                part = offsets[a : b + 1]
                marks, counts = shingles.words(data[part[0] : part[-1]], part - part[0])
                value, have = shingles.windows(marks, counts, width)
                s1, s2 = shingles.sequence_keys(marks, counts)
                ends = np.cumsum(have)
                sizes = np.array([len(np.unique(value[e - h : e])) for e, h in zip(ends, have)], np.int64)
                full = have > 0
                keys = band_keys(circulant(value, have, bands * rows), bands, rows) if full.any() else np.zeros((0, bands), np.int64)
                ends = np.concatenate([[0], np.cumsum(np.where(full, bands, 0))]).astype(np.int32)
                yield pa.record_batch([batch.column(0).slice(a, b - a), pa.array(s1), pa.array(s2), pa.array(sizes),
                                       pa.ListArray.from_arrays(pa.array(ends), pa.array(keys.ravel()))], names=["id", "s1", "s2", "n", "bands"])
        shingles.forget()
        release_memory()

    modest_batches(docs.sparkSession)
    narrow = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    return narrow.mapInArrow(run, "id long, s1 long, s2 long, n long, bands array<long>")


def _common(left: list[np.ndarray], right: list[np.ndarray]) -> np.ndarray:
    """Sizes of all intersections, exactly: 0/1 matrices over the shared shingles, multiplied some columns at a time."""
    every = np.concatenate([*left, *right]) if left or right else np.zeros(0, np.uint64)
    kinds, where = np.unique(every, return_inverse=True)
    shared = np.bincount(where, minlength=len(kinds)) > 1
    column = np.where(shared, np.cumsum(shared) - 1, -1)[where]
    sizes = np.array([len(x) for x in (*left, *right)])
    row = np.repeat(np.arange(len(sizes)), sizes)
    row, column = row[column >= 0], column[column >= 0]
    out = np.zeros((len(left), len(right)), np.float64)
    step = max(1, min(int(shared.sum()), 8_000_000 // max(1, len(sizes))))
    order = np.argsort(column, kind="stable")
    row, column = row[order], column[order]
    for a in range(0, int(shared.sum()), step):
        i, j = np.searchsorted(column, [a, a + step])
        grid = np.zeros((len(sizes), step), np.float32)
        grid[row[i:j], column[i:j] - a] = 1
        out += grid[: len(left)] @ grid[len(left) :].T
    return out.astype(np.int64)


def _forest(adjacent: np.ndarray, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Edges that join the same rows as the full graph: each row to the first of its part."""
    n = len(left)
    label = np.arange(n + len(right))
    i, j = np.nonzero(adjacent)
    j = j + n
    while True:
        low = np.minimum(label[i], label[j])
        fresh = label.copy()
        np.minimum.at(fresh, i, low)
        np.minimum.at(fresh, j, low)
        fresh = np.minimum(fresh, fresh[fresh])
        if (fresh == label).all():
            break
        label = fresh
    ids = np.concatenate([left, right])
    moved = label != np.arange(len(label))
    return ids[moved], ids[label[moved]]


def fingerprints(docs: DataFrame, width: int) -> DataFrame:
    """id, keys of the word sequence, and the sorted distinct shingles (as bytes) of rows (id, text)."""

    def run(batches):
        for batch in batches:
            data, offsets = text_buffers(batch.column(1))
            for a, b in slices(offsets):
                part = offsets[a : b + 1]
                marks, counts = shingles.words(data[part[0] : part[-1]], part - part[0])
                value, have = shingles.windows(marks, counts, width)
                s1, s2 = shingles.sequence_keys(marks, counts)
                ends = np.cumsum(have)
                sets = [np.unique(value[e - h : e]).tobytes() for e, h in zip(ends, have)]
                yield pa.record_batch([batch.column(0).slice(a, b - a), pa.array(s1), pa.array(s2), pa.array(sets, pa.binary())], names=["id", "s1", "s2", "prints"])
        shingles.forget()
        release_memory()

    return docs.select("id", "text").mapInArrow(run, "id long, s1 long, s2 long, prints binary")


def _sets(column) -> list[np.ndarray]:
    return [np.frombuffer(x, np.uint64) for x in column.to_pylist()]


def _to_hub(share: tuple[int, int]):
    """Members of a block (side 1) that are linked to the bucket's hub (side 0)."""

    def run(group: pa.Table) -> pa.Table:
        side, ids, sets = group.column("side").to_numpy(), group.column("id").to_numpy(), _sets(group.column("prints"))
        hub, rows = sets[int(np.flatnonzero(side == 0)[0])], np.flatnonzero(side == 1)
        sizes = np.array([len(sets[k]) for k in rows], np.int64)
        every = np.concatenate([sets[k] for k in rows]) if len(rows) else np.zeros(0, np.uint64)
        met = hub[np.minimum(np.searchsorted(hub, every), len(hub) - 1)] == every
        both = np.add.reduceat(met, np.cumsum(sizes) - sizes) if len(rows) else sizes
        near = both * share[1] >= share[0] * (sizes + len(hub) - both)
        return pa.table({"a": pa.array(ids[rows][near], pa.int64()), "b": pa.array(np.full(int(near.sum()), ids[side == 0][0]), pa.int64())})

    return run


def _rest(share: tuple[int, int]):
    """Links between a bucket's movers (side 0) and members (side 1) of other components."""

    def run(group: pa.Table) -> pa.Table:
        side, ids, part, n = (group.column(c).to_numpy() for c in ("side", "id", "part", "n"))
        sets = _sets(group.column("prints"))
        a, b = np.flatnonzero(side == 0), np.flatnonzero(side == 1)
        fits = np.minimum(n[a][:, None], n[b][None, :]) * share[1] >= share[0] * np.maximum(n[a][:, None], n[b][None, :])
        open_ = fits & (part[a][:, None] != part[b][None, :])
        a, b, open_ = a[open_.any(axis=1)], b[open_.any(axis=0)], open_[open_.any(axis=1)][:, open_.any(axis=0)]
        if not len(a):
            return pa.table({"a": pa.array([], pa.int64()), "b": pa.array([], pa.int64())})
        both = _common([sets[k] for k in a], [sets[k] for k in b])
        near = open_ & (both > 0) & (both * share[1] >= share[0] * (n[a][:, None] + n[b][None, :] - both))
        u, v = _forest(near, ids[a], ids[b])
        return pa.table({"a": pa.array(u, pa.int64()), "b": pa.array(v, pa.int64())})

    return run


def _prints(ws: Workspace, docs: DataFrame, id_col: str, text_col: str, width: int, classes: DataFrame, inside: DataFrame) -> DataFrame:
    """class, prints of the classes that share a bucket. A table of bits of their ids, of bounded size, keeps other texts out of the shuffle."""
    wanted = ws.put(inside.select("class").distinct().join(classes.select("class", "first", "s1", "s2"), "class"), "wanted")
    exponent = bit_exponent(wanted.count())
    bits = ws.put(bit_table(wanted.select(F.col("first").alias("id")).distinct(), ["id"], exponent), "bits")
    rows = flagged(docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")).where("id IS NOT NULL"), ["id"], bits, exponent).where("_again")
    made = fingerprints(rows, width).groupBy("id", "s1", "s2").agg(F.first("prints").alias("prints"))
    return ws.put(made.join(wanted.withColumnRenamed("first", "id"), ["id", "s1", "s2"]).select("class", "prints"), "prints")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", *, width: int = 5, share: tuple[int, int] = (80, 100),
                    bands: int = BANDS, rows: int = ROWS, block: int = BLOCK_DOCS) -> DataFrame:
    """Per row of ``docs``: id_col, n_shingles, component_id (smallest reachable id), kept (id is component_id, or id is null).

    Documents are linked when share[1] * |A & B| >= share[0] * |A | B| on the full sets of ``width``-word shingles. With 32 bands of
    4 rows a pair of similarity 0.8 misses all buckets with probability 5e-8, one of 0.85 with 6e-11.
    """
    spark = docs.sparkSession
    ws = Workspace(spark)
    signed = ws.put(signature_table(docs, id_col, text_col, width, bands, rows), "signatures")
    usable = signed.where("id IS NOT NULL AND n > 0")
    classes = usable.groupBy("s1", "s2").agg(F.min("id").alias("first"), F.first("n").alias("n"), F.min_by("bands", "id").alias("bands"))
    classes = ws.put(classes.withColumn("class", F.monotonically_increasing_id()), "classes")
    members = classes.select("class", "n", F.explode("bands").alias("key"))
    buckets = members.groupBy("key").agg(F.count("*").alias("size"), F.sum(F.xxhash64("class").cast("decimal(38,0)")).alias("kind")).where("size > 1")
    buckets = ws.put(buckets.groupBy("size", "kind").agg(F.min("key").alias("key")).select("key", "size"), "buckets")
    placed = ws.put(members.join(buckets, "key"), "members")
    weight = placed.groupBy("class").agg(F.sum("size").alias("weight"))
    hubs = placed.join(weight, "class").groupBy("key").agg(F.max(F.struct("weight", -F.col("class"), "n")).alias("hub"))
    inside = ws.put(placed.join(hubs.select("key", (-F.col("hub")["col2"]).alias("hub"), F.col("hub")["n"].alias("hub_n")), "key").select("key", "class", "n", "hub", "hub_n", "size"), "inside")
    fits = lambda a, b: F.least(a, b) * share[1] >= F.greatest(a, b) * share[0]
    prints = _prints(ws, docs, id_col, text_col, width, classes, inside)
    stars = inside.where((F.col("class") != F.col("hub")) & fits(F.col("n"), F.col("hub_n"))).select("class", "hub", "n").distinct()
    loads = ws.put(stars.groupBy("hub").agg(F.greatest(F.ceil(F.count("*") / min(block, HUB_BLOCK)), F.ceil(F.sum("n") / BLOCK_SHINGLES)).cast("int").alias("blocks")), "hubs")
    dealt = stars.join(loads, "hub").select("class", "hub", F.pmod(F.xxhash64("class"), F.col("blocks")).cast("int").alias("block"))
    each = dealt.join(prints, "class").select("hub", "block", F.col("class").alias("id"), "prints", F.lit(1).alias("side"))
    heads = loads.select(F.col("hub").alias("class"), F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block")).join(prints, "class")
    heads = heads.select(F.col("class").alias("hub"), "block", F.col("class").alias("id"), "prints", F.lit(0).alias("side"))
    linked = ws.put(heads.unionByName(each).groupBy("hub", "block").applyInArrow(_to_hub(share), "a long, b long"), "linked")
    links = [linked]

    # What is not in the hub's component is compared inside its bucket.
    parts = ws.put(components(ws, linked), "parts").withColumnRenamed("component", "part")
    known = ws.put(inside.join(parts.withColumnRenamed("node", "class"), "class", "left").withColumn("part", F.coalesce("part", "class")), "known")
    hub_part = parts.select(F.col("node").alias("hub"), F.col("part").alias("hub_part"))
    known = known.join(hub_part, "hub", "left").withColumn("mover", F.col("part") != F.coalesce("hub_part", "hub"))
    known = ws.put(known.select("key", "class", "n", "part", "mover", "size"), "places")
    few = known.where(F.col("size") <= min(SMALL, block)).select("key", "class", "n", "part", "mover")
    others = few.select("key", F.col("class").alias("other"), F.col("n").alias("other_n"), F.col("part").alias("other_part"))
    pairs = few.where("mover").join(others, "key").where((F.col("part") != F.col("other_part")) & fits(F.col("n"), F.col("other_n")))
    pairs = ws.put(pairs.select(F.least("class", "other").alias("hub"), F.greatest("class", "other").alias("class")).distinct(), "pairs")
    if pairs.limit(1).count():
        ends = pairs.join(prints, "class").select("hub", F.col("class").alias("id"), "prints", F.lit(1).alias("side"))
        begins = pairs.select(F.col("hub").alias("class")).distinct().join(prints, "class").select(F.col("class").alias("hub"), F.col("class").alias("id"), "prints", F.lit(0).alias("side"))
        links.append(begins.unionByName(ends).groupBy("hub").applyInArrow(_to_hub(share), "a long, b long"))
    known = known.where(F.col("size") > min(SMALL, block)).drop("size")
    open_ = ws.put(known.groupBy("key").agg(F.count_if("mover").alias("movers"), F.sum(F.when(F.col("mover"), F.col("n"))).alias("mover_load"), F.count("*").alias("all"), F.sum("n").alias("load")).where("movers > 0").select(
        "key", F.greatest(F.ceil(F.col("movers") / block), F.ceil(F.col("mover_load") / BLOCK_SHINGLES)).cast("int").alias("columns"),
        F.greatest(F.ceil(F.col("all") / block), F.ceil(F.col("load") / BLOCK_SHINGLES)).cast("int").alias("lines")), "open")
    if open_.limit(1).count():
        here = known.join(open_, "key").withColumns({"line": F.pmod(F.xxhash64("class"), F.col("lines")).cast("int"), "column": F.pmod(F.xxhash64("class", F.lit(1)), F.col("columns")).cast("int")})
        moving = here.where("mover").withColumn("line", F.explode(F.sequence(F.lit(0), F.col("lines") - 1))).withColumn("side", F.lit(0))
        standing = here.withColumn("column", F.explode(F.sequence(F.lit(0), F.col("columns") - 1))).withColumn("side", F.lit(1))
        cells = moving.unionByName(standing).join(prints, "class").select("key", "line", "column", F.col("class").alias("id"), "part", "n", "prints", "side")
        links.append(cells.groupBy("key", "line", "column").applyInArrow(_rest(share), "a long, b long"))
    found = links[0]
    for more in links[1:]:
        found = found.union(more)
    names = classes.select("class", "first")
    found = found.join(names.select(F.col("class").alias("a"), F.col("first").alias("_a")), "a").join(names.select(F.col("class").alias("b"), F.col("first").alias("_b")), "b").select(F.col("_a").alias("a"), F.col("_b").alias("b"))
    copies = usable.join(classes.select("s1", "s2", "first"), ["s1", "s2"]).where("id <> first").select(F.col("id").alias("a"), F.col("first").alias("b"))
    part = components(ws, found.union(copies))
    result = signed.join(part.withColumnRenamed("node", "id"), "id", "left").select(
        F.col("id").alias(id_col), F.col("n").alias("n_shingles"), F.coalesce("component", "id").alias("component_id"),
        F.coalesce(F.col("component") == F.col("id"), F.lit(True)).alias("kept"))
    return ws.finish(result)
