"""Ordered work that no single task may hold whole: running values, row frames, exact quantiles.

Each function has two ways. Up to ``spark.tablecare.smallRows`` rows (counted, not guessed) a plain
window is used. Beyond that the rows are range-partitioned on (keys, order), so one long key is cut
over many tasks, and the pieces are joined by their small per-piece totals.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tablecare.functions.params import attach
from tablecare.session import block_rows, is_small, settle, small_rows, together

_WITHIN = {
    "sum": lambda c, w: F.sum(c).over(w),
    "min": lambda c, w: F.min(c).over(w),
    "max": lambda c, w: F.max(c).over(w),
    "last": lambda c, w: F.last(c, ignorenulls=True).over(w),
}
_WHOLE = {
    "sum": lambda c: F.sum(c),
    "min": lambda c: F.min(c),
    "max": lambda c: F.max(c),
}


def _join_parts(kind: str, before: Column, here: Column) -> Column:
    if kind == "sum":
        return F.when(before.isNull(), here).when(here.isNull(), before).otherwise(before + here)
    if kind == "min":
        return F.least(before, here)
    if kind == "max":
        return F.greatest(before, here)
    return F.coalesce(here, before)


def _order(order, descending: bool):
    return [F.col(c).desc() if descending else F.col(c).asc() for c in order]


def slice_count(df: DataFrame) -> int:
    """Slices of at most about ``spark.tablecare.blockRows`` rows: a slice is one window task, so their number grows with the rows."""
    spark = df.sparkSession
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), math.ceil(df.count() / block_rows(spark)))


def running(df: DataFrame, keys: list[str], order: list[str], outs: dict[str, tuple[str, Column]],
            descending: bool = False, small: bool | None = None) -> DataFrame:
    """Running sum, min, max or last non-null value up to each row, per key, in a total order."""
    if small is None:
        small = is_small(df)
    by = _order(order, descending)
    if small:
        w = W.partitionBy(*(keys or [F.lit(0)])).orderBy(*by).rowsBetween(W.unboundedPreceding, 0)
        return df.withColumns({n: _WITHIN[k](c, w) for n, (k, c) in outs.items()})
    spark = df.sparkSession
    parts = slice_count(df)
    sources = {f"_in_{n}": c for n, (_, c) in outs.items()}
    cut = df.withColumns(sources).repartitionByRange(parts, *[F.col(k) for k in keys], *by)
    cut = settle(cut.withColumn("_slice", F.spark_partition_id()))
    w = W.partitionBy(*keys, "_slice").orderBy(*by).rowsBetween(W.unboundedPreceding, 0)
    within = cut.withColumns({n: _WITHIN[k](F.col(f"_in_{n}"), w) for n, (k, _) in outs.items()})
    whole = cut.groupBy(*keys, "_slice").agg(*[
        F.max_by(F.col(f"_in_{n}"), F.when(F.col(f"_in_{n}").isNotNull(), F.struct(*[F.col(c) for c in order])))
        .alias(f"_whole_{n}") if k == "last" and not descending else
        F.min_by(F.col(f"_in_{n}"), F.when(F.col(f"_in_{n}").isNotNull(), F.struct(*[F.col(c) for c in order])))
        .alias(f"_whole_{n}") if k == "last" else
        _WHOLE[k](F.col(f"_in_{n}")).alias(f"_whole_{n}")
        for n, (k, _) in outs.items()
    ])
    # A key has at most one row per slice here, so this window is bounded by the slice count.
    prior = W.partitionBy(*(keys or [F.lit(0)])).orderBy("_slice").rowsBetween(W.unboundedPreceding, -1)
    offsets = whole.select(*keys, "_slice", *[
        _WITHIN[k](F.col(f"_whole_{n}"), prior).alias(f"_before_{n}") for n, (k, _) in outs.items()
    ])
    conds = [within[k].eqNullSafe(offsets[k]) for k in keys] + [within["_slice"] == offsets["_slice"]]
    joined = within.join(offsets, conds, "left")
    return joined.select(
        *[within[c] for c in df.columns if c not in outs],
        *[_join_parts(k, offsets[f"_before_{n}"], within[n]).alias(n) for n, (k, _) in outs.items()],
    )


def row_numbers(df: DataFrame, keys: list[str], order: list[str], out: str = "_rn",
                small: bool | None = None) -> DataFrame:
    """Exact position of each row in its key, from 1."""
    return running(df, keys, order, {out: ("sum", F.lit(1).cast("bigint"))}, small=small)


BROADCAST_KEYS = 10_000


def long_keys(df: DataFrame, keys: list[str]) -> DataFrame | None:
    """Keys with more rows than one task may hold, or None.

    The limit is a fixed number of rows at any table size. Up to ``BROADCAST_KEYS`` such keys, counted, are marked for broadcast; more
    are joined by shuffle.
    """
    limit = small_rows(df.sparkSession)
    if is_small(df):
        return None
    counts = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"))
    hot = settle(counts.where(F.col("_n") > limit).select(*keys))
    many = hot.limit(BROADCAST_KEYS + 1).count()
    if not many:
        return None
    return F.broadcast(hot) if many <= BROADCAST_KEYS else hot


def framed(df: DataFrame, keys: list[str], order: list[str], span: int, build) -> DataFrame:
    """Add columns that look back at most ``span`` rows inside a key.

    ``build(window)`` gets an ordered window without a frame and returns named columns. Long keys are cut
    in blocks of exact row numbers, each block led in by the ``span`` rows before it.
    """
    by = _order(order, False)

    def plain(part: DataFrame) -> DataFrame:
        return part.withColumns(build(W.partitionBy(*keys).orderBy(*by)))

    hot = long_keys(df, keys)
    if hot is None:
        return plain(df)
    cold_part = plain(df.join(hot, keys, "left_anti"))
    size = max(block_rows(df.sparkSession), span)
    numbered = row_numbers(df.join(hot, keys, "left_semi"), keys, order, "_frame_rn", small=False)
    at = F.col("_frame_rn") - 1
    block = F.floor(at / size)
    blocks = F.when(at % size >= size - span, F.array(block, block + 1)).otherwise(F.array(block))
    led = numbered.withColumn("_frame_home", block).withColumn("_frame_block", F.explode(blocks))
    hot_part = led.withColumns(build(W.partitionBy(*keys, "_frame_block").orderBy(*by)))
    hot_part = hot_part.where(F.col("_frame_home") == F.col("_frame_block")).drop("_frame_rn", "_frame_home", "_frame_block")
    return cold_part.unionByName(hot_part)


# Up to this many rows the built-in exact percentile, which keeps every distinct value, is the quick way.
PERCENTILE_ROWS = 200_000
# Most (value, count) pairs of one narrowing round that are read as parameters.
BRACKET_VALUES = 100_000


def quantiles(df: DataFrame, cols: list[str], probs: list[float], small: bool | None = None) -> dict[str, list[float]]:
    """Exact interpolated quantiles per column, as parameters on the driver.

    Large tables are never sorted: an approximate pass brackets each wanted rank, the next pass counts the
    rows under each bracket and the few values inside it. A bracket that misses its rank is widened, one with
    too many values is narrowed, so the answer is exact whatever the approximation gave.
    """
    if not cols:
        return {}
    values = df.select(*[F.col(f"`{c}`").cast("double").alias(f"c{i}") for i, c in enumerate(cols)])
    values = values.select(*[F.when(~F.isnan(c), F.col(c)).alias(c) for c in values.columns])
    if small is None:
        small = is_small(df, PERCENTILE_ROWS)
    if small:
        args = F.array(*[F.lit(float(p)) for p in probs])
        row = values.agg(*[F.percentile(c, args).alias(c) for c in values.columns]).first()
        return {c: list(row[i]) if row[i] is not None else [None] * len(probs) for i, c in enumerate(cols)}
    few = _narrow_counts(values)
    wide = [(name, c) for name, c in zip(cols, values.columns) if c not in few]
    found = _bracketed_quantiles(values.select(*[c for _, c in wide]), [name for name, _ in wide], probs) if wide else {}
    return {name: _counted_quantiles(few[c], probs) if c in few else found[name] for name, c in zip(cols, values.columns)}


# Columns with at most this many distinct values are counted whole, all of them in one pass.
NARROW_VALUES = 1000


def _narrow_counts(values: DataFrame) -> dict[str, list[tuple[float, int]]]:
    """Sorted (value, rows) pairs of the columns that have few values; a task stops counting a column that has more."""
    names, most = values.columns, NARROW_VALUES

    def run(batches):
        held = {c: (np.zeros(0), np.zeros(0, np.int64)) for c in names}
        wide = set()
        for batch in batches:
            for c in list(held):
                kinds, times = np.unique(batch.column(c).drop_null().to_numpy(zero_copy_only=False) + 0.0, return_counts=True)
                kinds, at = np.unique(np.concatenate([held[c][0], kinds]), return_inverse=True)
                if len(kinds) > most:
                    wide.add(c)
                    del held[c]
                    continue
                held[c] = kinds, np.bincount(at, np.concatenate([held[c][1], times]), len(kinds)).astype(np.int64)
        # A column counts as wide for all once one task says so, by a row without a value.
        for c in names:
            kinds, times = held.get(c, (np.zeros(0), np.zeros(0, np.int64)))
            yield pa.RecordBatch.from_arrays([pa.array([c] * (len(kinds) + 1)), pa.array([None, *kinds.tolist()], pa.float64()),
                                              pa.array([int(c in wide), *times.tolist()], pa.int64())], names=["c", "v", "n"])

    counts = values.mapInArrow(run, "c string, v double, n bigint").groupBy("c", "v").agg(F.sum("n").alias("n"))
    rows = counts.take(BRACKET_VALUES + 1)
    if len(rows) > BRACKET_VALUES:
        return {}  # tasks that each hold few values hold many together: brackets read less
    out: dict[str, list] = {c: [] for c in names}
    for r in rows:
        if r["v"] is not None:
            out[r["c"]].append((r["v"], r["n"]))
    over = {r["c"] for r in rows if r["v"] is None and r["n"]}
    return {c: sorted(v) for c, v in out.items() if c not in over}


def _counted_quantiles(pairs: list[tuple[float, int]], probs: list[float]) -> list[float]:
    """Interpolated quantiles from all (value, rows) pairs."""
    n = sum(times for _, times in pairs)
    if not n:
        return [None] * len(probs)
    lo, hi = pairs[0][0], pairs[-1][0]
    ends = [(_value_at(math.floor(a), pairs, lo, hi), _value_at(math.ceil(a), pairs, lo, hi), a - math.floor(a)) for a in (p * (n - 1) for p in probs)]
    return [a + (b - a) * part for a, b, part in ends]


ACCURACY = 2000
SLACK = 1e-3
COUNT_BATCH = 18


def _bracketed_quantiles(values: DataFrame, cols: list[str], probs: list[float]) -> dict[str, list[float]]:
    """Four passes for all columns together; a column whose brackets do not close goes on alone."""
    names = values.columns
    marks = sorted({q for p in probs for q in (max(0.0, p - SLACK), min(1.0, p + SLACK))})
    row = values.agg(*[x for c in names for x in (F.count(c).alias(f"n_{c}"), F.percentile_approx(c, marks, ACCURACY).alias(c))]).first()
    counts = {c: row[f"n_{c}"] for c in names}
    brackets: list[tuple[str, float, float, float]] = []
    for c in names:
        if counts[c]:
            at = dict(zip(marks, row[c]))
            brackets += [(c, p, at[max(0.0, p - SLACK)], at[min(1.0, p + SLACK)]) for p in probs]
    sizes, pairs = together(lambda: _bracket_sizes(values, brackets), lambda: _bracket_values(values, brackets))
    out = {}
    for name, c in zip(cols, names):
        if not counts[c]:
            out[name] = [None] * len(probs)
            continue
        ranks = sorted({r for p in probs for r in (math.floor(p * (counts[c] - 1)), math.ceil(p * (counts[c] - 1)))})
        found: dict[int, float] = {}
        if c in pairs:
            for _, p, lo, hi in [b for b in brackets if b[0] == c]:
                below, inside = sizes[(c, p)]
                for r in {math.floor(p * (counts[c] - 1)), math.ceil(p * (counts[c] - 1))}:
                    if below <= r < below + inside:
                        found[r] = _value_at(r - below, pairs[c], lo, hi)
        if any(r not in found for r in ranks):
            found = _ranked_values(values.select(c), c, counts[c], ranks)
        if found is None:
            rows = values.select(F.lit(name).alias("k"), F.col(c).alias("v"))
            out[name] = list(group_quantiles(rows, ["k"], "v", probs, small=False).first()["quantiles"])
            continue
        ends = [(found[math.floor(a)], found[math.ceil(a)], a - math.floor(a)) for a in (p * (counts[c] - 1) for p in probs)]
        out[name] = [lo + (hi - lo) * part for lo, hi, part in ends]
    return out


def _bracket_sizes(values: DataFrame, brackets) -> dict:
    """(rows under, rows inside) per bracket; equal brackets are counted once, a few per pass."""
    sizes = {}
    each = sorted({(c, lo, hi) for c, _, lo, hi in brackets})
    for start in range(0, len(each), COUNT_BATCH):
        part = each[start:start + COUNT_BATCH]
        row = values.agg(*[x for i, (c, lo, hi) in enumerate(part) for x in (
            F.count_if(F.col(c) < lo).alias(f"b{i}"), F.count_if(F.col(c).between(lo, hi)).alias(f"m{i}"))]).first()
        sizes.update({b: (row[f"b{i}"], row[f"m{i}"]) for i, b in enumerate(part)})
    return {(c, p): sizes[(c, lo, hi)] for c, p, lo, hi in brackets}


def _bracket_values(values: DataFrame, brackets) -> dict[str, list[tuple[float, int]]]:
    """Sorted (value, count) pairs inside the brackets of each column; one job whose branches read one column each."""
    branches = None
    names = sorted({c for c, *_ in brackets})
    for c in names:
        cond = F.lit(False)
        for lo, hi in sorted({(lo, hi) for n, _, lo, hi in brackets if n == c}):
            cond = cond | F.col(c).between(lo, hi)
        part = values.where(cond).groupBy(F.col(c).alias("v")).agg(F.count(F.lit(1)).alias("n")).select(F.lit(c).alias("c"), "v", "n")
        branches = part if branches is None else branches.unionByName(part)
    if branches is None:
        return {}
    rows = branches.take(BRACKET_VALUES + 1)
    if len(rows) > BRACKET_VALUES:
        return {}  # too many to read at once: every column goes on alone
    out: dict[str, list] = {c: [] for c in names}
    for r in rows:
        out[r["c"]].append((r["v"], r["n"]))
    return {c: sorted(v) for c, v in out.items()}


def _value_at(position: int, pairs: list[tuple[float, int]], lo: float, hi: float) -> float:
    at = 0
    for value, times in pairs:
        if lo <= value <= hi:
            at += times
            if position < at:
                return value
    raise ValueError("position outside the bracket")


def _around(rank: int, n: int, slack: float = SLACK) -> tuple[float, float]:
    at = rank / max(n - 1, 1)
    return max(0.0, at - slack), min(1.0, at + slack)


def _ranked_values(column: DataFrame, c: str, n: int, ranks: list[int]) -> dict | None:
    """The values at zero-based ranks of one column, from approximate marks around them; None when brackets do not close.

    Each pass reads one column. A bracket with too many values is bracketed again inside itself.
    """
    v = F.col(c)
    shares = sorted({q for r in ranks for q in _around(r, n)})
    marks = dict(zip(shares, column.agg(F.percentile_approx(c, shares, ACCURACY)).first()[0]))
    bounds = {r: tuple(marks[q] for q in _around(r, n)) for r in ranks}
    found: dict[int, float] = {}
    for _ in range(4):
        todo = [r for r in ranks if r not in found]
        if not todo:
            return found
        inside = {r: v.between(*bounds[r]) for r in todo}
        sizes = {}
        for start in range(0, len(todo), 15):
            part = todo[start:start + 15]
            row = column.agg(*[x for i, r in enumerate(part) for x in (
                F.count_if(v < bounds[r][0]).alias(f"b{i}"), F.count_if(inside[r]).alias(f"m{i}"))]).first()
            sizes.update({r: (row[f"b{i}"], row[f"m{i}"]) for i, r in enumerate(part)})
        if any(not below <= r < below + m for r, (below, m) in sizes.items()):
            return None
        cond = inside[todo[0]]
        for r in todo[1:]:
            cond = cond | inside[r]
        rows = column.where(cond).groupBy(c).agg(F.count(F.lit(1)).alias("n")).take(BRACKET_VALUES + 1)
        if len(rows) <= BRACKET_VALUES:
            pairs = sorted((x[0], x["n"]) for x in rows)
            found.update({r: _value_at(r - sizes[r][0], pairs, *bounds[r]) for r in todo})
            continue
        finer = column.agg(*[
            F.percentile_approx(F.when(inside[r], v), list(_around(r - sizes[r][0], sizes[r][1])), ACCURACY).alias(f"q{i}")
            for i, r in enumerate(todo)]).first()
        bounds.update({r: tuple(finer[f"q{i}"]) for i, r in enumerate(todo)})
    return found if all(r in found for r in ranks) else None


# Up to this many groups, counted, are bracketed side by side; Spark sorts the rows for sketches of more.
FEW_GROUPS = 100


def few_group_quantile(df: DataFrame, by: str, values: dict[str, Column], prob: float) -> list[tuple] | None:
    """One exact interpolated quantile of several columns per group, as rows (group, quantile of each column).

    As in ``quantiles``, an approximate pass brackets the rank in each group and the next ones count and read what lies inside, all groups
    and columns together. None when there are more than ``FEW_GROUPS`` groups, a NaN near a rank, or a bracket that does not close.
    """
    spark, n_values = df.sparkSession, len(values)
    rows = df.where(F.col(by).isNotNull()).select(F.col(by).alias("_g"), *[v.cast("double").alias(f"v{i}") for i, v in enumerate(values.values())])
    if len(rows.select("_g").distinct().take(FEW_GROUPS + 1)) > FEW_GROUPS:
        return None
    first = rows.groupBy("_g").agg(*[x for i in range(n_values) for x in (
        F.count(f"v{i}").alias(f"n{i}"), F.percentile_approx(f"v{i}", list(_slack(prob)), ACCURACY).alias(f"q{i}"))]).collect()
    ends = {(at, i): (math.floor(prob * (r[f"n{i}"] - 1)), math.ceil(prob * (r[f"n{i}"] - 1))) for at, r in enumerate(first) for i in range(n_values) if r[f"n{i}"]}
    bounds = {k: tuple(first[k[0]][f"q{k[1]}"]) for k in ends}
    schema = T.StructType([rows.schema["_g"], T.StructField("_at", T.IntegerType()),
                           *[T.StructField(f"{e}{i}", T.DoubleType()) for i in range(n_values) for e in ("lo", "hi")]])
    inside = [F.col(f"v{i}").between(F.col(f"lo{i}"), F.col(f"hi{i}")) for i in range(n_values)]
    # A bracket of one value holds nothing to read.
    wide = [inside[i] & (F.col(f"lo{i}") < F.col(f"hi{i}")) for i in range(n_values)]
    for _ in range(4):
        if any(b != b for pair in bounds.values() for b in pair):
            return None
        table = [(r["_g"], at, *[b for i in range(n_values) for b in bounds.get((at, i), (None, None))]) for at, r in enumerate(first)]
        met = rows.join(F.broadcast(spark.createDataFrame(table, schema)), "_g")
        each = F.array_compact(F.array(*[F.when(wide[i], F.struct(F.lit(i).alias("c"), F.col(f"v{i}").alias("v"))) for i in range(n_values)]))
        sizes, found = together(
            lambda: met.groupBy("_at").agg(*[x for i in range(n_values) for x in (  # noqa: B023
                F.count_if(F.col(f"v{i}") < F.col(f"lo{i}")).alias(f"b{i}"), F.count_if(inside[i]).alias(f"m{i}"))]).collect(),
            lambda: met.select("_at", F.explode(each).alias("r")).groupBy("_at", "r.c", "r.v").agg(F.count(F.lit(1)).alias("n")).take(BRACKET_VALUES + 1))  # noqa: B023
        held = {(r["_at"], i): (r[f"b{i}"], r[f"m{i}"]) for r in sizes for i in range(n_values)}
        if any(not held[k][0] <= low <= high < sum(held[k]) for k, (low, high) in ends.items()):
            return None
        if len(found) <= BRACKET_VALUES:
            pairs: dict[tuple, list] = {k: [] for k in ends}
            for r in found:
                pairs[r["_at"], r["c"]].append((r["v"], r["n"]))
            out = {}
            for k, (low, high) in ends.items():
                inner = sorted(pairs[k]) if bounds[k][0] < bounds[k][1] else [(bounds[k][0], held[k][1])]
                a, b = (_value_at(x - held[k][0], inner, *bounds[k]) for x in (low, high))
                out[k] = a + (b - a) * (prob * (first[k[0]][f"n{k[1]}"] - 1) - low)
            return [(r["_g"], *[out.get((at, i)) for i in range(n_values)]) for at, r in enumerate(first)]
        # Too many values to read: the ranks are bracketed again inside their brackets.
        near = {k: (_around(low - held[k][0], held[k][1])[0], _around(high - held[k][0], held[k][1])[1]) for k, (low, high) in ends.items()}
        shares = [sorted({q for (_, c), pair in near.items() if c == i for q in pair}) or [prob] for i in range(n_values)]
        finer = {r["_at"]: r for r in met.groupBy("_at").agg(*[
            F.percentile_approx(F.when(inside[i], F.col(f"v{i}")), shares[i], ACCURACY).alias(f"q{i}") for i in range(n_values)]).collect()}
        bounds = {(at, i): tuple(finer[at][f"q{i}"][shares[i].index(q)] for q in near[at, i]) for at, i in ends}
    return None


def _slack(prob: float) -> tuple[float, float]:
    return max(0.0, prob - SLACK), min(1.0, prob + SLACK)


def group_quantiles(df: DataFrame, keys: list[str], value: str, probs: list[float],
                    small: bool | None = None) -> DataFrame:
    """Exact interpolated quantiles of one column per group, as an array column ``quantiles``."""
    rows = df.where(F.col(value).isNotNull())
    if small is None:
        small = is_small(rows)
    if small:
        args = F.array(*[F.lit(float(p)) for p in probs])
        return rows.groupBy(*keys).agg(F.percentile(value, args).alias("quantiles"))
    # Numbering them takes several passes, so they are written once.
    counts = settle(rows.groupBy(*keys, value).agg(F.count(F.lit(1)).alias("_c")))
    cum = settle(running(counts, keys, [value], {"_cum": ("sum", F.col("_c"))}, small=False))
    sizes = cum.groupBy(*keys).agg(F.max("_cum").alias("_n"))
    # One row per (group, wanted rank); each keeps the first value whose running count reaches it.
    ranks = sizes.select(*keys, F.posexplode(F.array(*[F.lit(float(p)) for p in probs])).alias("_i", "_p"), "_n")
    ranks = ranks.select(*keys, "_i", (F.col("_p") * (F.col("_n") - 1)).alias("_at"))
    marks = ranks.groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct("_i", "_at"))).alias("_marks"))
    # A value covers the zero-based ranks from cum - count to cum - 1.
    first, last = F.col("_cum") - F.col("_c"), F.col("_cum") - 1
    joined = attach(cum, marks, keys, "inner")
    hits = joined.select(*keys, F.col(value).alias("_v"), first.alias("_f"), last.alias("_l"),
                         F.explode("_marks").alias("_m"))
    hits = hits.select(*keys, "_v", F.col("_m._i").alias("_i"), F.col("_m._at").alias("_at"), "_f", "_l")
    low = F.floor("_at").between(F.col("_f"), F.col("_l"))
    high = F.ceil("_at").between(F.col("_f"), F.col("_l"))
    ends = hits.where(low | high).groupBy(*keys, "_i", "_at").agg(
        F.max(F.when(low, F.col("_v"))).alias("_lo"), F.max(F.when(high, F.col("_v"))).alias("_hi"))
    ends = ends.withColumn("_q", F.col("_lo") + (F.col("_hi") - F.col("_lo")) * (F.col("_at") - F.floor("_at")))
    return ends.groupBy(*keys).agg(
        F.transform(F.sort_array(F.collect_list(F.struct("_i", "_q"))), lambda s: s["_q"]).alias("quantiles"))


def decayed_sums(df: DataFrame, keys: list[str], order: list[str], outs: dict[str, tuple[Column, float]],
                 small: bool | None = None) -> DataFrame:
    """Geometric sums s(t) = x(t) + r * s(t-1) per key, and the row number ``_rn``.

    Rows are numbered and cut in short blocks. Inside a block the sum is a plain running sum of x * r^-i,
    times r^i. The carry into a block is a weighted sum of the ends of the blocks before it; the number of
    blocks taken is the one after which r^rows is under 1e-80, far below the last bit of a double.
    """
    if small is None:
        small = is_small(df)
    numbered = row_numbers(df.withColumns({f"_x_{n}": x for n, (x, _) in outs.items()}), keys, order, small=small)
    lowest = min(r for _, r in outs.values())
    size = max(8, min(400, int(60 / -math.log10(lowest))))
    back = max(1, max(math.ceil(80 / (-math.log10(r) * size)) for _, r in outs.values()))
    numbered = numbered.withColumn("_block", F.floor((F.col("_rn") - 1) / size))
    numbered = numbered.withColumn("_i", ((F.col("_rn") - 1) % size).cast("double"))
    w = W.partitionBy(*keys, "_block").orderBy("_i").rowsBetween(W.unboundedPreceding, 0)
    local = numbered.withColumns({
        f"_s_{n}": F.sum(F.col(f"_x_{n}") * F.pow(F.lit(r), -F.col("_i"))).over(w) * F.pow(F.lit(r), F.col("_i"))
        for n, (_, r) in outs.items()
    })
    ends = local.groupBy(*keys, "_block").agg(*[F.max_by(f"_s_{n}", "_i").alias(f"_e_{n}") for n in outs])

    def carries(window):
        cols = {}
        for n, (_, r) in outs.items():
            terms = [F.coalesce(F.lag(f"_e_{n}", j).over(window), F.lit(0.0)) * F.lit(r ** (size * (j - 1)))
                     for j in range(1, back + 1)]
            carry = terms[0]
            for t in terms[1:]:
                carry = carry + t
            cols[f"_c_{n}"] = carry
        return cols

    if small:
        carried = ends.withColumns(carries(W.partitionBy(*keys).orderBy("_block")))
    else:
        carried = framed(settle(ends), keys, ["_block"], back, carries)
    carried = carried.select(*keys, "_block", *[f"_c_{n}" for n in outs])
    joined = local.join(carried, [*keys, "_block"])
    done = joined.withColumns({
        n: F.col(f"_s_{n}") + F.col(f"_c_{n}") * F.pow(F.lit(r), F.col("_i") + 1) for n, (_, r) in outs.items()
    })
    return done.select(*df.columns, "_rn", *outs)
