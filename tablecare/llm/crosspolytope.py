"""Near-duplicate vectors by cross-polytope hashing with verified pairs.

A hash rotates the vector (padded to a power of two) by three rounds of random signs and the fast Hadamard transform, and takes the place
and sign of the largest component: the nearest corner of the cross-polytope. ``functions`` hashes make one code of a table. A vector is put
into ``probes`` buckets of each of ``tables`` tables: those whose corners cost least against the nearest ones. Two vectors that share a
bucket are compared in double precision. The number of functions follows from the number of vectors (``settings``), so that the unrelated
vectors in a bucket stay few however large the table is; probes and tables follow from it, so that a pair of cosine 0.93 is missed with
probability 1e-7 at most (measured at 64 components, per table: 0.84 found with 3 functions and 8 probes, 0.83 with 4 and 16).

Equal vectors with equal labels collapse to one class first. Buckets with the same members are kept once. Buckets come sorted by key, many
in an Arrow batch, and the pairs of all small ones are compared at once; only those that hold a link are looked at one by one. A bucket of more
than ``block`` classes is dealt into blocks and compared block by block, so no task holds an unbounded bucket. Every pair is counted in one bucket only,
the smallest that both are in; tasks return sums per vector and a spanning forest, never pairs.

Vectors that are null, zero, hold null or non-finite components or have another length than most, and rows without label or id, link
with nothing; they are returned with 0 links, their own id as component, and are kept. Rows that repeat an id and vector count as linked
rows. Other columns are ignored. An empty table gives an empty result.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tablecare.llm.common import Workspace, components, mix64
from tablecare.llm.vectors import lists, matrix, unit, usable

BLOCK = 512
#: Functions: (tables, probes).
SETTINGS = {1: (10, 4), 2: (10, 8), 3: (10, 8), 4: (10, 16), 5: (16, 16), 6: (24, 24)}
SMALL = 64


def settings(rows: int, width: int) -> tuple[int, int, int]:
    """(tables, functions, probes): codes are 512 times as many as rows at least, up to six functions."""
    corners = 2 << max(2, (width - 1).bit_length())
    functions = min(max(SETTINGS), max(min(3, rows), math.ceil(math.log(512 * max(rows, 1)) / math.log(corners))))
    tables, probes = SETTINGS[max(functions, 1)]
    return tables, max(functions, 1), probes


def hadamard(x: np.ndarray) -> np.ndarray:
    """Fast Walsh-Hadamard transform of the rows, scaled to keep lengths."""
    size, width = x.shape[1], 1
    while width < size:
        pair = x.reshape(len(x), -1, 2, width)
        x = np.stack([pair[:, :, 0] + pair[:, :, 1], pair[:, :, 0] - pair[:, :, 1]], axis=2).reshape(len(x), size)
        width *= 2
    return x / np.sqrt(size)


def codes(x: np.ndarray, tables: int, functions: int, probes: int, seed: int = 11) -> np.ndarray:
    """(rows, tables * probes) codes; the number of the table is mixed in."""
    rows, size = len(x), 1 << max(2, (x.shape[1] - 1).bit_length())
    x = np.pad(x, ((0, 0), (0, size - x.shape[1])))
    top = min(4, size)
    out = np.empty((rows, tables * probes), np.uint64)
    rng = np.random.Generator(np.random.PCG64(seed))
    for t in range(tables):
        code, cost = np.full((rows, 1), t + 1, np.uint64), np.zeros((rows, 1))
        for _ in range(functions):
            y = x
            for _ in range(3):
                y = hadamard(y * rng.choice([-1.0, 1.0], size))
            best = np.argsort(-np.abs(y), axis=1, kind="stable")[:, :top]
            value = np.take_along_axis(y, best, axis=1)
            corner = (2 * best + (value < 0)).astype(np.uint64)
            loss = value[:, :1] ** 2 - value**2
            code = mix64(code[:, :, None] * np.uint64(0x9E3779B97F4A7C15) + corner[:, None, :]).reshape(rows, -1)
            cost = (cost[:, :, None] + loss[:, None, :]).reshape(rows, -1)
            order = np.argsort(cost, axis=1, kind="stable")[:, :probes]
            code, cost = np.take_along_axis(code, order, axis=1), np.take_along_axis(cost, order, axis=1)
        out[:, t * probes : (t + 1) * probes] = np.pad(code, ((0, 0), (0, probes - code.shape[1])), "edge")
    return out.view(np.int64)


def _link(least: float):
    """Owned links of a bucket's block pair: with only side 0, between its rows, else between side 0 and side 1."""

    def run(group: pa.Table) -> pa.Table:
        key = group.column("key")[0].as_py()
        side, ids, times = (group.column(c).to_numpy() for c in ("side", "id", "times"))
        x = unit(matrix(group.column("v")))
        a, b = np.flatnonzero(side == 0), np.flatnonzero(side == 1)
        same = group.column("i")[0] == group.column("j")[0]
        b = a if same else b
        near = x[a] @ x[b].T
        close = np.abs(near - least) < 1e-9  # at the border, sums in one fixed order
        for i, j in zip(*np.nonzero(close)):
            near[i, j] = (x[a[i]] * x[b[j]]).sum()
        linked = near >= least
        if same:
            np.fill_diagonal(linked, False)
        keys = group.column("keys").combine_chunks()
        owner = np.repeat(np.arange(len(ids)), np.diff(keys.offsets.to_numpy()))
        kinds, place = np.unique(keys.flatten().to_numpy(), return_inverse=True)
        smaller = np.searchsorted(kinds, key)
        met = (np.bincount(place, minlength=len(kinds)) > 1)[:smaller]
        column = np.where(met, np.cumsum(met) - 1, -1)
        earlier = np.zeros((len(a), len(b)), np.float32)
        low = place < smaller
        owner, place = owner[low], column[place[low]]
        owner, place = owner[place >= 0], place[place >= 0]
        for start in range(0, int(met.sum()), 4096):
            grid = np.zeros((len(ids), 4096), np.float32)
            inside = (place >= start) & (place < start + 4096)
            grid[owner[inside], place[inside] - start] = 1
            earlier += grid[a] @ grid[b].T
        owned = linked & (earlier == 0)
        links = np.zeros(len(ids), np.int64)
        np.add.at(links, a, owned @ times[b])
        if not same:
            np.add.at(links, b, owned.T @ times[a])
        label = np.arange(len(ids))
        i, j = np.nonzero(owned)
        i, j = a[i], b[j]
        while True:
            fresh, low = label.copy(), np.minimum(label[i], label[j])
            np.minimum.at(fresh, i, low)
            np.minimum.at(fresh, j, low)
            fresh = np.minimum(fresh, fresh[fresh])
            if (fresh == label).all():
                break
            label = fresh
        some = np.flatnonzero(links)
        return pa.table({"id": pa.array(ids[some], pa.int64()), "links": pa.array(links[some], pa.int64()), "root": pa.array(ids[label[some]], pa.int64())})

    return run


def _buckets(least: float):
    """``_link`` over rows that come sorted by (key, i, j): the last bucket of a batch waits for the next one. Small buckets without a link go early."""
    link = _link(least)

    def settled(rows: pa.Table):
        marks = np.stack([rows.column(c).to_numpy() for c in ("key", "i", "j")])
        starts = np.flatnonzero(np.append(True, (marks[:, 1:] != marks[:, :-1]).any(axis=0)))
        sizes = np.diff(np.append(starts, rows.num_rows))
        group = np.repeat(np.arange(len(starts)), sizes)
        x = unit(matrix(rows.column("v")))
        small = sizes[group] <= SMALL
        wanted = sizes > SMALL
        for step in range(1, min(SMALL, int(sizes.max()))):
            pairs = np.flatnonzero(small[:-step] & (group[:-step] == group[step:]))
            if not len(pairs):
                break
            for k in range(0, len(pairs), 1 << 16):
                part = pairs[k : k + (1 << 16)]
                near = np.einsum("ij,ij->i", x[part], x[part + step]) >= least - 1e-9
                wanted[group[part[near]]] = True
        for g in np.flatnonzero(wanted).tolist():
            found = link(rows.slice(starts[g], sizes[g]))
            if found.num_rows:
                yield from found.to_batches()

    def run(batches):
        rest = None
        for batch in batches:
            if not batch.num_rows:
                continue
            rows = pa.Table.from_batches([batch])
            rows = pa.concat_tables([rest, rows]).combine_chunks() if rest is not None else rows
            last = [rows.column(c)[-1].as_py() for c in ("key", "i", "j")]
            same = np.all([rows.column(c).to_numpy() == v for c, v in zip(("key", "i", "j"), last)], axis=0)
            whole = int(same.argmax())  # rows of one bucket stand together, so the last bucket's rows are the first of its key and all behind
            rest = rows.slice(whole)
            if whole:
                yield from settled(rows.slice(0, whole))
        if rest is not None:
            yield from settled(rest)

    return run


def near_vectors(rows: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str | None = "label", *, least: float = 0.93,
                 tables: int | None = None, functions: int | None = None, probes: int | None = None, block: int = BLOCK) -> DataFrame:
    """Per row: id_col, n_links (other rows with cosine >= ``least`` and the same label), component_id, kept."""
    ws = Workspace(rows.sparkSession)
    label = F.col(label_col).cast("string") if label_col else F.lit("")
    every = rows.select(F.col(id_col).cast("long").alias("id"), label.alias("label"), F.col(vector_col).cast("array<double>").alias("v"))
    fine = usable(every.where("id IS NOT NULL AND label IS NOT NULL"))
    classes = ws.put(fine.groupBy("label", "v").agg(F.min("id").alias("id"), F.count("*").alias("times")).withColumn(
        "class", F.xxhash64("label", "v", "id")), "classes")
    size = classes.agg(F.count("*").alias("n"), F.max(F.size("v")).alias("d")).first()
    chosen = settings(size["n"], size["d"] or 1)
    tables, functions, probes = tables or chosen[0], functions or chosen[1], probes or chosen[2]

    def run(batches):
        for batch in batches:
            if batch.num_rows:
                yield pa.record_batch([batch.column(0), batch.column(1), lists(codes(unit(matrix(batch.column(2))), tables, functions, probes))], names=["class", "label", "codes"])

    coded = classes.select("class", "label", "v").mapInArrow(run, "class long, label string, codes array<long>")
    places = ws.put(coded.select("class", F.explode(F.array_distinct("codes")).alias("code"), "label").select("class", F.xxhash64("label", "code").alias("key")), "buckets")
    sizes = places.groupBy("key").agg(F.count("*").alias("n"), F.sum(F.xxhash64("class").cast("decimal(38,0)")).alias("members"), F.min("class").alias("low")).where("n > 1")
    buckets = ws.put(sizes.groupBy("n", "members", "low").agg(F.min("key").alias("key")).select("key", "n"), "distinct_buckets")
    member = ws.put(places.join(buckets, "key").select("class", "key", "n"), "members")
    held = member.groupBy("class").agg(F.sort_array(F.collect_list("key")).alias("keys"))  # at most tables * probes keys a class
    data = held.join(classes.select("class", "id", "times", "v"), "class")
    spread = member.withColumn("blocks", F.ceil(F.col("n") / block).cast("int")).withColumn("own", F.pmod(F.xxhash64("class", "key"), F.col("blocks")).cast("int"))
    # Block i meets the blocks j >= i: it is side 0 of the pairs (i, j) and side 1 of the pairs (j, i).
    spread = spread.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    spread = spread.select("class", "key", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), (F.col("own") > F.col("other")).cast("int").alias("side"))
    grouped = spread.join(data, "class").select("key", "i", "j", "side", "id", "times", "keys", "v")
    ordered = grouped.repartition("key", "i", "j").sortWithinPartitions("key", "i", "j")
    found = ws.put(ordered.mapInArrow(_buckets(least), "id long, links long, root long"), "links")
    copies = fine.join(classes.select("label", "v", F.col("id").alias("first"), "times"), ["label", "v"]).select("id", "first", "times")
    copies = ws.put(copies, "copies")
    edges = found.select(F.col("id").alias("a"), F.col("root").alias("b")).union(copies.select(F.col("id").alias("a"), F.col("first").alias("b")))
    part = components(ws, edges).withColumnRenamed("node", "id")
    linked = copies.join(found.groupBy(F.col("id").alias("first")).agg(F.sum("links").alias("links")), "first", "left")
    linked = linked.groupBy("id").agg(F.max(F.col("times") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"))
    result = every.select("id").join(linked, "id", "left").join(part, "id", "left").select(
        F.col("id").alias(id_col), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), F.coalesce("component", "id").alias("component_id"),
        F.coalesce(F.col("component") == F.col("id"), F.lit(True)).alias("kept"))
    return ws.finish(result)
