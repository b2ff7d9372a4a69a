"""Periodic runs of words: stretches that repeat with a small period, found in tiles per period octave and stitched by document and period.

A run is a stretch of consecutive words whose smallest period is q (words q apart are identical), at least ``least`` words and ``times`` * q
words long, that no neighbouring word extends with that period.

Octave s (a power of two) has the periods s to 2s - 1. Boundaries stand every s words, and the tile of boundary b reaches from b - s to
b + 4s, so tiles overlap. The Z-function of a boundary gives for each period p how far the words from b agree with those from b + p. A run
of period p has at least 3p places that agree with the place p later, so it holds a boundary whose Z-value is s or more. These are
found for all tiles and periods of an octave at once by fingerprints of s words (the next octave's are made of two of these); for them only
the Z-value is then measured on the words themselves, forwards and backwards from the boundary. Tiles of neighbouring boundaries with one
period overlap by more than the period, so their fragments join to the whole stretch. A fragment whose words also repeat with p divided by
a prime has a smaller period and is left out: it belongs to that octave.

A document of at most ``strip`` words has all its tiles solved where it is read. A longer one is exploded into strips, rows of
(document, octaves, first word, word numbers): strips for the low octaves together, then for each higher octave longer ones, each lapping
over the next by 8s words. Strips are dealt to all tasks and solved without each other. Fragments that touch the end of a strip, and whole
runs, are then shuffled by (document, period) and stitched where they overlap by a period or more. The strips of a document of a million
words hold 6 times its words, as 32-bit numbers; shorter ones less, and documents within one strip none.

Words are the runs of other characters than ASCII white space; they are compared whole, as numbers of their own inside a document. Null and
empty texts, and texts of white space alone, have no words and no runs. Rows keep their own results whatever their ids: null and repeated
ids and repeated rows do no harm. Other columns are ignored, so names that clash do none either. A document is held by one task, as Spark
holds it; its strips and fragments are bounded by its length. An empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
from collections import defaultdict
from itertools import count

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tablecare.llm.common import Workspace, mix64, slices, text_buffers

LEAST, TIMES = 6, 4
STRIP = 1 << 14
_ODD = np.uint64(0x9E3779B97F4A7C15)


class _Factors:
    """Smallest prime factor of every number up to a size that grows when needed."""

    def __init__(self):
        self.table = np.arange(2)

    def upto(self, n: int) -> np.ndarray:
        if len(self.table) <= n:
            size = max(1024, 1 << n.bit_length())
            table = np.arange(size)
            for p in range(2, int(size**0.5) + 1):
                if table[p] == p:
                    part = table[p * p :: p]
                    part[part == np.arange(p * p, size, p)] = p
            self.table = table
        return self.table


_factors = _Factors()


def _agreeing(words: np.ndarray, at: int, period: int, limit: int) -> int:
    """Z-value of boundary ``at`` at ``period``, up to ``limit``: places from there on that agree with the place a period later."""
    a, b = words[at : at + limit], words[at + period : at + period + limit]
    differ = a[: len(b)] != b
    first = int(differ.argmax()) if len(b) else 0
    return len(b) if not len(b) or not differ[first] else first


def _agreeing_back(words: np.ndarray, at: int, period: int, limit: int) -> int:
    """The same backwards, from the place before ``at``."""
    low = max(0, at - limit)
    differ = (words[low:at] != words[low + period : at + period])[::-1]
    first = int(differ.argmax()) if len(differ) else 0
    return len(differ) if not len(differ) or not differ[first] else first


def _primitive(marks: np.ndarray, at: np.ndarray, period: np.ndarray, s: int) -> np.ndarray:
    """Which stretches (from ``at``, one period and s words long) have no period that divides ``period``; marks are fingerprints of s words.

    s is more than half a period, so two windows cover the words that decide it.
    """
    alive, rest, factors = np.ones(len(at), bool), period.copy(), _factors.upto(int(period.max(initial=1)))
    while True:
        on = np.flatnonzero(alive & (rest > 1))
        if not len(on):
            return alive
        prime = factors[rest[on]]
        step, begin = period[on] // prime, at[on]
        last = begin + period[on] - s
        alive[on] = (marks[begin] != marks[begin + step]) | (marks[last] != marks[last + step])
        rest[on] //= prime


def tile_fragments(words: np.ndarray, owner: np.ndarray, sizes: np.ndarray, low: int, high: int, shortest=None) -> np.ndarray:
    """(start, end, period) of the stretches that hold a boundary whose Z-value is s or more, joined over neighbouring tiles, for octaves low to high.

    ``words`` holds word numbers (0 or more) of several texts, one after another, with a number of its own (below 0) behind each; ``owner``
    is each place's text, ``sizes`` the words of each text. Octaves are powers of two. ``shortest`` gives a period's shortest stretch asked for.
    """
    found = []
    place = np.arange(len(words))
    marks = mix64(words.astype(np.uint64) * _ODD + np.uint64(1))
    s = 1
    while True:
        if s >= low:
            blocks = np.concatenate([marks, np.zeros(-len(marks) % s, np.uint64)]).reshape(-1, s)
            tile, offset = np.nonzero(blocks[1:] == blocks[:-1, :1])
            at, period = tile * s, s + offset
            fine = at + period + s <= len(words)
            at, period = at[fine], period[fine]
            fine = _primitive(marks, at, period, s)
            at, period = at[fine], period[fine]
            order = np.lexsort((at, period))
            at, period = at[order], period[order]
            fresh = np.ones(len(at) + 1, bool)
            fresh[1:-1] = (period[1:] != period[:-1]) | (at[1:] != at[:-1] + s)
            edges = np.flatnonzero(fresh)
            first, last, period = at[edges[:-1]], at[edges[1:] - 1], period[edges[:-1]]
            if shortest is not None:  # less than s places before the first boundary agree, and less than 2s from the last one on
                fine = last - first + 3 * s - 2 + period >= shortest(period)
                first, last, period = first[fine], last[fine], period[fine]
            for a, z, p in zip(first.tolist(), last.tolist(), period.tolist()):
                begin, end = a - _agreeing_back(words, a, p, s), z + _agreeing(words, z, p, 2 * s) + p
                if shortest is None or end - begin >= shortest(p):
                    found.append((place[begin], place[end - 1] + 1, p))
        # The next octave needs only texts that can hold four of its periods.
        s *= 2
        keep = sizes[owner] >= TIMES * s
        if s > high or not keep.any():
            break
        if not keep.all():
            words, owner, place, marks = words[keep], owner[keep], place[keep], marks[keep]
        half = s // 2
        marks[:-half] = mix64(marks[:-half] * _ODD ^ mix64(marks[half:] + np.uint64(s)))
        marks[marks == 0] = np.uint64(1)
        marks[1 - s :] = mix64(np.arange(2**40 + s, 2**40 + 2 * s - 1, dtype=np.uint64))  # windows over the end agree with none
    return np.array(found, np.int64).reshape(-1, 3)


def _octave(n: int) -> int:
    """The highest octave whose periods fit four times into n words."""
    return 1 << max(n // TIMES, 1).bit_length() - 1


def strips_of(n: int, strip: int) -> list[tuple[int, int, int, int]]:
    """(low octave, high octave, first word, end) of the strips of a text of n words."""
    out, low, size, top = [], 1, strip, _octave(n)
    while low <= top:
        # Strips are 32 times the highest octave long and lap by 8 times; a strip that holds the whole text takes all octaves that are left.
        high = top if size >= n else max(low, 1 << max(size // 32, 1).bit_length() - 1)
        first, lap = 0, 8 * high
        size = max(size, 2 * lap)
        while True:
            out.append((low, high, first, min(n, first + size)))
            if first + size >= n:
                break
            first += size - lap
        low, size = high * 2, max(size, 64 * high)
    return out


def collapse(words: list[bytes], runs: list[tuple[int, int, int]]) -> bytes:
    """The words joined by one space, without those that a run (start, length, period) holds after its first period."""
    if runs:
        change = np.zeros(len(words) + 1, np.int64)
        for start, length, period in runs:
            change[start + period] += 1
            change[start + length] -= 1
        words = [w for w, n in zip(words, np.cumsum(change[:-1]).tolist()) if not n]
    return b" ".join(words)


_RUN = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])
_STRIP = pa.struct([("low", pa.int64()), ("high", pa.int64()), ("first", pa.int64()), ("open_left", pa.bool_()), ("open_right", pa.bool_()), ("words", pa.binary())])
_RUNS = "runs array<struct<start: bigint, length: bigint, period: bigint>>"


def _texts(values: list[bytes], digest: bool) -> pa.Array:
    return pa.array([hashlib.sha256(v).hexdigest() for v in values] if digest else [v.decode() for v in values], pa.string())


def periodic_runs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", *, least: int = LEAST, strip: int = STRIP, digest: bool = False) -> DataFrame:
    """Per row: id_col, n_words, runs (array of start, length, period; by start, then period) and collapsed.

    ``collapsed`` is the text's words joined by one space, without the repeats; with ``digest`` its SHA-256 (hex) stands for it, so that
    texts aren't written again.
    """
    if strip < 64 or strip & (strip - 1):
        raise ValueError("strip is a power of two, 64 at least")
    ws = Workspace(docs.sparkSession)

    def shortest(period):
        return np.maximum(least, TIMES * np.asarray(period))

    def read(batches):
        for batch in batches:
            data, offsets = text_buffers(batch.column(2))
            for a, b in slices(offsets):
                whole, part = data[offsets[a] : offsets[b]].tobytes(), offsets[a : b + 1] - offsets[a]
                texts = [whole[x:y].split() for x, y in zip(part[:-1].tolist(), part[1:].tolist())]
                sizes = np.array([len(t) for t in texts], np.int64)
                numbers: dict[bytes, int] = defaultdict(count().__next__)
                each = [np.fromiter(map(numbers.__getitem__, t), np.int64, len(t)) for t in texts]
                short = np.flatnonzero((sizes <= strip) & (sizes >= least))
                runs: list[list | None] = [[] for _ in texts]
                if len(short):
                    ends = np.cumsum(sizes[short] + 1)
                    joined = np.concatenate([x for i in short for x in (each[i], [-1 - i])])
                    owner = np.repeat(np.arange(len(short)), sizes[short] + 1)
                    for start, end, period in tile_fragments(joined, owner, sizes[short], 1, _octave(int(sizes[short].max())), shortest).tolist():
                        i = owner[start]
                        runs[short[i]].append((start - int(ends[i] - sizes[short[i]] - 1), end - start, period))
                strips: list[list | None] = [None] * len(texts)
                for i in np.flatnonzero(sizes > strip).tolist():
                    runs[i] = None
                    narrow = np.unique(each[i], return_inverse=True)[1].astype(np.int32)
                    strips[i] = [{"low": low, "high": high, "first": x, "open_left": x > 0, "open_right": y < len(narrow), "words": narrow[x:y].tobytes()}
                                 for low, high, x, y in strips_of(len(narrow), strip)]
                runs = [r if r is None else sorted(r, key=lambda x: (x[0], x[2])) for r in runs]
                long = [i for i, r in enumerate(runs) if r is None]
                told = _texts([b"" if r is None else collapse(t, r) for t, r in zip(texts, runs)], digest)
                kept = dict(zip(long, [b" ".join(texts[i]).decode() for i in long]))
                listed = [r if r is None else [dict(zip(("start", "length", "period"), x)) for x in r] for r in runs]
                yield pa.record_batch([batch.column(0).slice(a, b - a), batch.column(1).slice(a, b - a), pa.array(sizes), pa.array(listed, pa.list_(_RUN)), told,
                                       pa.array([kept.get(i) for i in range(len(texts))], pa.string()), pa.array(strips, pa.list_(_STRIP))],
                                      names=["_id", "_row", "_n", "_runs", "_collapsed", "_words", "_strips"])

    def solve(batches):
        for batch in batches:
            out = []
            for row, s in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                words = np.append(np.frombuffer(s["words"], np.int32).astype(np.int64), -1)
                n = len(words) - 1
                # A stretch at an open end may be part of a longer one in the next strip.
                for start, end, period in tile_fragments(words, np.zeros(n + 1, np.int64), np.array([n]), s["low"], s["high"]).tolist():
                    if end - start >= shortest(period) or start == 0 and s["open_left"] or end == n and s["open_right"]:
                        out.append((row, period, s["first"] + start, s["first"] + end))
            columns = list(zip(*out)) or [[]] * 4
            yield pa.record_batch([pa.array(c, pa.int64()) for c in columns], names=["_row", "period", "start", "end"])

    def finish(batches):
        for batch in batches:
            for k in range(batch.num_rows):
                row = batch.slice(k, 1)
                runs = [(r["start"], r["length"], r["period"]) for r in row.column(4)[0].as_py() or []]
                text = collapse(row.column(3)[0].as_py().encode().split(), runs)
                yield pa.record_batch([row.column(0), row.column(1), row.column(2), pa.array([[dict(zip(("start", "length", "period"), r)) for r in runs]], pa.list_(_RUN)),
                                       _texts([text], digest)], names=["_id", "_row", "_n", "_runs", "_collapsed"])

    kind = docs.select(id_col).dtypes[0][1]
    head = f"_id {kind}, _row long, _n long, _{_RUNS}, _collapsed string"
    narrow = docs.select(F.col(id_col).alias("_id"), F.monotonically_increasing_id().alias("_row"), F.col(text_col).alias("_text"))
    strip_type = "struct<low: bigint, high: bigint, first: bigint, open_left: boolean, open_right: boolean, words: binary>"
    rows = ws.put(narrow.mapInArrow(read, f"{head}, _words string, _strips array<{strip_type}>"), "documents")

    strips = rows.where("_strips IS NOT NULL").select("_row", F.explode("_strips").alias("s"))
    fragments = ws.put(strips.repartition("_row", "s.low", "s.first").mapInArrow(solve, "_row long, period long, start long, end long"), "fragments")
    # Two stretches of one period that overlap by it or more are one.
    by = Window.partitionBy("_row", "period").orderBy("start", "end")
    before = F.max("end").over(by.rowsBetween(Window.unboundedPreceding, -1))
    fresh = F.coalesce(F.col("start") > before - F.col("period"), F.lit(True)).cast("int")
    pieces = fragments.withColumn("_fresh", fresh).withColumn("_part", F.sum("_fresh").over(by.rowsBetween(Window.unboundedPreceding, 0)))
    whole = pieces.groupBy("_row", "period", "_part").agg(F.min("start").alias("start"), F.max("end").alias("_end")).select(
        "_row", "start", (F.col("_end") - F.col("start")).alias("length"), "period").where(F.col("length") >= F.greatest(F.lit(least), TIMES * F.col("period")))
    runs = whole.groupBy("_row").agg(F.array_sort(F.collect_list(F.struct("start", "period", "length"))).alias("_found"))
    listed = F.transform("_found", lambda r: F.struct(r["start"].alias("start"), r["length"].alias("length"), r["period"].alias("period")))
    long = rows.where("_strips IS NOT NULL").select("_id", "_row", "_n", "_words").join(runs.select("_row", listed.alias("_found")), "_row", "left")
    long = long.select("_id", "_row", "_n", "_words", "_found").mapInArrow(finish, head)
    short = rows.where("_strips IS NULL").select("_id", "_row", "_n", "_runs", "_collapsed")
    return short.union(long).select(F.col("_id").alias(id_col), F.col("_n").alias("n_words"), F.col("_runs").alias("runs"), F.col("_collapsed").alias("collapsed"))
