"""Approximate nearest neighbours by a hash-prefix forest.

Every tree gives each vector a hash string of 62 bits, the signs of random projections around the median of a bounded sample. A tree is
the sorted array of its strings; the rows that share a prefix with a query are one range of it. A query descends every tree to its longest
prefix match and then ascends all trees at the same pace, one bit at a time, until the ranges hold enough candidates: ``candidates`` rows,
or ``share`` of all rows, whichever is more (rows met in several trees count each time, and at the root every row is a candidate).
Candidates are compared by their exact cosine in double precision.

Spark holds a sorted array in cells: the rows of one tree with the same leading ``depth`` bits, where the depth follows from the number of
rows, so that a cell has about ``cell_rows``. A cell with more (many near copies share long prefixes) is dealt into parts, each a sorted
array of its own. One pass counts the matches of a query per prefix length, which gives the length to ascend to; the second sends queries
to the cells under that prefix and returns the best of each. Queries are dealt into blocks as well, so no group grows with the table.

Only the medians are fitted on a sample, the ``sample_rows`` rows with the smallest hash; every row is indexed. On isotropic data nearest
neighbours are hardly nearer than the rest, and the share decides the recall; 0.9 and more is measured in the tests.

Rows that repeat an id and its vector are indexed once. Rows of an id with several vectors count together as one candidate, are dealt over
the parts of a cell by their vectors, and are reduced to the best one before the nearest ids are taken.

Vectors that are null, zero, hold null or non-finite components or have another length than most take no part, nor do null ids. Rows with a
query's own id are no candidates of it. Repeated ids are returned once, with their best score. Ties go to the smaller id. Fewer candidates than ``k``
are all returned. Other columns are ignored. An empty table gives an empty result.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tablecare.llm.common import Workspace
from tablecare.llm.vectors import matrix, unit, usable

BITS = 62


class Hashes:
    """Projections and thresholds of all trees."""

    def __init__(self, sample: np.ndarray, trees: int, seed: int = 3):
        rng = np.random.Generator(np.random.PCG64(seed))
        self.planes = rng.normal(size=(trees, sample.shape[1], BITS))
        self.cuts = np.stack([np.median(sample @ p, axis=0) for p in self.planes])

    def strings(self, x: np.ndarray, tree: int) -> np.ndarray:
        bits = x @ self.planes[tree] > self.cuts[tree]
        return bits.astype(np.int64) @ (np.int64(1) << np.arange(BITS - 1, -1, -1, dtype=np.int64))


def _hash(hashes: Hashes):
    def run(batches):
        for batch in batches:
            x = unit(matrix(batch.column(1)))
            for tree in range(len(hashes.planes)) if len(x) else ():
                yield pa.record_batch([pa.array(np.full(len(x), tree, np.int32)), pa.array(hashes.strings(x, tree)), *batch.columns[:1], *batch.columns[2:]],
                                      names=["tree", "string", "id", *batch.schema.names[2:]])

    return run


def _ranges(strings: np.ndarray, asked: np.ndarray, length: np.ndarray | int):
    """First and past-the-last place of the rows that share ``length`` leading bits with each asked string."""
    shift = np.asarray(BITS - length, np.int64)
    low = (asked >> shift) << shift
    return np.searchsorted(strings, low), np.searchsorted(strings, low + (np.int64(1) << shift) - 1, "right")


def _count(depth: int):
    """For each query of a cell part, the ids (an id's rows together count 1) per prefix length from ``depth`` on, up to the last length that has any."""

    def run(group: pa.Table) -> pa.Table:
        query = group.column("query").to_numpy(zero_copy_only=False)
        strings = group.column("string").to_numpy()
        order = np.argsort(strings[~query])
        rows, asked = strings[~query][order], strings[query]
        weight = np.concatenate([[0.0], np.cumsum(group.column("weight").to_numpy()[~query][order])])
        ids = group.column("id").to_numpy()[query]
        counts = np.stack([np.subtract(*(weight[x] for x in _ranges(rows, asked, n)[::-1])) for n in range(depth, BITS + 1)], axis=1) if len(asked) else np.zeros((0, 1))
        at, length = np.nonzero(counts)
        return pa.table({"id": pa.array(ids[at], pa.int64()), "bits": pa.array((length + depth).astype(np.int32)), "n": pa.array(counts[at, length], pa.float64())})

    return run


def _search(k: int):
    """The best ``k`` rows of a cell part for each of its queries, by the exact cosine."""

    def run(group: pa.Table) -> pa.Table:
        query = group.column("query").to_numpy(zero_copy_only=False)
        strings, ids = group.column("string").to_numpy(), group.column("id").to_numpy()
        x = unit(matrix(group.column("v")))
        order = np.flatnonzero(~query)
        order = order[np.argsort(strings[order], kind="stable")]
        rows, own, asked = x[order], ids[order], np.flatnonzero(query)
        alone = len(np.unique(own)) == len(own)
        low, high = _ranges(strings[order], strings[asked], group.column("bits").to_numpy()[asked])
        out_q, out_v, out_s = [], [], []
        for a, b in np.unique(np.stack([low, high]), axis=1).T if len(asked) else ():
            mine = asked[(low == a) & (high == b)]
            by_id = np.argsort(own[a:b], kind="stable")
            first = np.flatnonzero(np.diff(own[a:b][by_id], prepend=own[a:b][by_id][:1] - 1)) if b > a else by_id
            for part in range(0, len(mine), 256):
                some = mine[part : part + 256]
                score = x[some] @ rows[a:b].T
                score[ids[some][:, None] == own[None, a:b]] = -np.inf
                each = score if alone or b == a else np.maximum.reduceat(score[:, by_id], first, axis=1)  # the best row of each id
                kth = max(0, each.shape[1] - k)
                least = np.partition(each, kth, axis=1)[:, kth] - 1e-9 if b > a else None
                for i, q in enumerate(some if b > a else ()):
                    near = np.flatnonzero((score[i] >= least[i]) & (score[i] > -np.inf))
                    exact = (rows[a + near] * x[q]).sum(axis=1)  # one fixed order of addition: equal vectors have equal scores
                    best = np.lexsort((own[a + near], -exact))
                    _, top = np.unique(own[a + near][best], return_index=True)
                    best = best[np.sort(top)][:k]
                    out_q.append(np.full(len(best), ids[q]))
                    out_v.append(own[a + near][best])
                    out_s.append(exact[best])
        join = lambda x, kind: pa.array(np.concatenate(x) if x else np.zeros(0), kind)
        return pa.table({"query_id": join(out_q, pa.int64()), "vec_id": join(out_v, pa.int64()), "score": join(out_s, pa.float64())})

    return run


def nearest(rows: DataFrame, queries: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", *, k: int = 5, trees: int = 16, candidates: int = 2000,
            share: float = 1.2, cell_rows: int = 8192, query_rows: int = 8192, sample_rows: int = 4096) -> DataFrame:
    """query_id, rank (from 1), vec_id, score for every usable row of ``queries`` (columns as ``rows``)."""
    ws = Workspace(rows.sparkSession)
    pick = lambda df: df.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).cast("array<double>").alias("v")).where("id IS NOT NULL")
    base = ws.put(usable(pick(rows)).dropDuplicates(["id", "v"]), "distinct")
    several = ws.put(base.groupBy("id").agg(F.count("*").alias("n")).where("n > 1"), "several")
    base = base.join(several, "id", "left").withColumn("row", F.monotonically_increasing_id())
    base = ws.put(base.select("row", "id", "v", (1 / F.coalesce("n", F.lit(1))).alias("weight")), "rows")
    total, width, ids = base.agg(F.count("*"), F.max(F.size("v")), F.sum("weight")).first()
    empty = "query_id long, rank int, vec_id long, score double"
    if not total:
        return rows.sparkSession.createDataFrame([], empty)
    asked = ws.put(usable(pick(queries), width=width).dropDuplicates(["id"]), "queries")
    bound = max(64, min(sample_rows, 8_000_000 // width))
    sample = base.orderBy(F.xxhash64("id", "v")).limit(bound).select("v").collect()
    hashes = Hashes(unit(np.array([r.v for r in sample], float)), trees)
    depth = max(0, int(np.ceil(np.log2(total / cell_rows))))
    schema = "tree int, string long, id long"
    cell = F.shiftright("string", BITS - depth) if depth else F.lit(0).cast("long")
    index = ws.put(base.select("id", "v", "row", "weight").mapInArrow(_hash(hashes), schema + ", row long, weight double").withColumn("cell", cell), "index")
    asking = ws.put(asked.select("id", "v").mapInArrow(_hash(hashes), schema).withColumn("cell", cell), "asking")
    cells = ws.put(index.groupBy("tree", "cell").agg(F.sum("weight").alias("n"), F.ceil(F.count("*") / (2 * cell_rows)).cast("int").alias("parts")), "cells")
    index = index.join(cells.select("tree", "cell", "parts"), ["tree", "cell"]).withColumn("part", F.pmod(F.xxhash64("row"), F.col("parts")).cast("int")).drop("parts")
    # Queries of a cell are cut into blocks, and index rows go only to the blocks that ask for their cell.
    block, every_block = F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int"), F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))
    every_part = F.explode(F.sequence(F.lit(0), F.col("parts") - 1))
    key = ["tree", "cell", "part", "block"]
    blocks_of = lambda asks, label: ws.put(asks.groupBy("tree", "cell").agg(F.ceil(F.count("*") / query_rows).cast("int").alias("blocks")), label)

    # Matches by prefix length: inside the own cell, and above it by whole cells.
    asked_cells = blocks_of(asking, "asked_cells")
    inner = asking.join(cells, ["tree", "cell"]).join(asked_cells, ["tree", "cell"]).withColumn("part", every_part).withColumn("block", block)
    both = index.join(asked_cells, ["tree", "cell"]).withColumn("block", every_block).withColumn("query", F.lit(False)).select(*key, "query", "string", "id", "weight").union(
        inner.withColumn("query", F.lit(True)).select(*key, "query", "string", "id", F.lit(0.0)))
    matches = both.groupBy(*key).applyInArrow(_count(depth), "id long, bits int, n double")
    above = cells.withColumn("bits", F.explode(F.sequence(F.lit(0), F.lit(depth)))).withColumn("prefix", F.expr(f"shiftright(cell, {depth} - bits)"))
    above = ws.put(above.select("tree", "bits", "prefix", "cell", "n", "parts"), "above")
    asking_above = asking.withColumn("bits", F.explode(F.sequence(F.lit(0), F.lit(depth)))).withColumn("prefix", F.expr(f"shiftright(cell, {depth} - bits)"))
    if depth:
        whole = above.where(F.col("bits") < depth).groupBy("tree", "bits", "prefix").agg(F.sum("n").alias("n"))
        matches = matches.union(asking_above.join(whole, ["tree", "bits", "prefix"]).select("id", "bits", "n"))
    enough = max(candidates, share * ids) * (1 - 1e-9)  # sums of weights are rounded
    ascend = matches.groupBy("id", "bits").agg(F.sum("n").alias("n")).where((F.col("n") >= enough) | (F.col("bits") == 0)).groupBy("id").agg(F.max("bits").alias("reach"))
    ascend = ws.put(asked.select("id").join(ascend, "id", "left").na.fill(0, ["reach"]), "ascend")

    # Queries go to every cell under the prefix they ascend to.
    reach = asking_above.join(ascend, "id").where(F.col("bits") == F.least("reach", F.lit(depth))).select("tree", "bits", "prefix", "string", "id", "reach")
    visits = ws.put(reach.join(above, ["tree", "bits", "prefix"]).select("tree", "cell", "parts", "string", "id", "reach"), "visits")
    visited = blocks_of(visits, "visited")
    sent = visits.join(visited, ["tree", "cell"]).withColumn("part", every_part).withColumn("block", block)
    sent = sent.join(asked, "id").withColumn("query", F.lit(True)).select(*key, "query", "string", "id", F.col("reach").alias("bits"), "v")
    held = index.join(visited, ["tree", "cell"]).join(base.select("row", "v"), "row").withColumn("block", every_block).withColumn("query", F.lit(False)).select(*key, "query", "string", "id", F.lit(0).alias("bits"), "v")
    found = held.union(sent).groupBy(*key).applyInArrow(_search(k), "query_id long, vec_id long, score double")
    best = found.groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    result = best.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
    return ws.finish(result)
