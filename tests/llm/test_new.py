"""Exact dedup, fill-in-middle and periodic runs against brute force."""

import hashlib
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from tablecare.llm import exact, fim, periods, queries


def lowered(text):
    return "".join(c.lower() if c.isascii() else c for c in text or "")


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


@pytest.mark.parametrize("bits", [27, 3])
def test_exact_duplicates_equal_brute_force(spark, bits):
    random.seed(2)
    texts = ["Abc", "aBC", "abd", "É", "é", "İ", "i̇", "K", "k", "x" * 100 + "a", "X" * 100 + "b", "x" * 100 + "A", "", "  ", None]
    rows = [(i, random.choice([*texts, f"w{random.randint(0, 300)}"])) for i in range(1500)]
    rows += [(5, "Abc"), (1499, "abc"), (1499, "ABC"), (1499, "ABC"), (1499, "other"), (None, "abc"), (None, "only null"), (None, "ONLY null"), (None, "lonely"), (7, "x" * 500_000), (8, "X" * 500_000)]
    docs = spark.createDataFrame([(*r, "c", 1) for r in rows], "doc_id long, text string, _row string, keep_id int").repartition(5)
    got = exact.exact_duplicates(docs, carry=("text",), prefix=4, most_bits=bits).collect()
    groups = {}
    for i, text in rows:
        groups.setdefault(lowered(text), []).append(i)
    want, have = [], []
    for r in got:
        ids = groups[lowered(r.text)]
        largest = max((i for i in ids if i is not None), default=None)
        assert (r.keep_id, r.group_size) == (largest, len(ids)) and (r.doc_id == r.keep_id or not r.kept)
        have += [lowered(r.text)] * r.kept
    for text in groups:
        want.append(text)
    assert len(got) == len(rows) and sorted(have) == sorted(want)


def test_exact_duplicates_read_whole_texts_of_survivors_only(spark, tiny, none):
    rows = [(1, "ab one"), (2, "ab two"), (3, "xy one"), (4, "alone here")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    heads = docs.select(F.octet_length("text").alias("n"), F.left("text", F.lit(2)).alias("h"))
    kept = exact.flagged(heads, ["n", "h"], exact.occurring_again(heads, ["n", "h"], 15), 15)
    assert sorted((r.n, r.h, r._again) for r in kept.collect()) == [(6, "ab", True), (6, "ab", True), (6, "xy", False), (10, "al", False)]
    got = exact.exact_duplicates(tiny, carry=("id", "component"))
    assert got.columns == ["doc_id", "keep_id", "group_size", "kept", "id", "component"]
    by = {}
    for r in got.collect():
        by.setdefault(r.doc_id, []).append((r.keep_id, r.group_size, r.kept))
    assert by[1] == [(2, 2, False)] and by[2] == [(2, 2, True)] and by[3] == [(4, 2, False)] and by[4] == [(4, 2, True)]
    assert sorted(by[10]) == [(10, 2, False), (10, 2, True)] and by[9] == [(9, 2, True)] and by[None] == [(9, 2, False)]
    assert exact.exact_duplicates(none).count() == 0


def cut(key, text, unit_starts, rate=90, spm=20):
    h = hashlib.sha256(f"1:{'' if key is None else key}".encode()).hexdigest()
    h = [int(h[i : i + 8], 16) for i in (0, 8, 16, 24)]
    n = len(unit_starts)
    x, y = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    form = "plain" if not text or any(s in text for s in ("<P>", "<S>", "<M>")) or h[2] % 100 >= rate else "spm" if h[3] % 100 < spm else "psm"
    a, b = (([*unit_starts, len(text)])[k] for k in (x, y))
    out = text if form == "plain" else f"<P>{text[:a]}<S>{text[b:]}<M>{text[a:b]}" if form == "psm" else f"<S>{text[b:]}<P>{text[:a]}<M>{text[a:b]}"
    return (n, form, None, None, out) if form == "plain" else (n, form, a, b - a, out)


def word_starts(text):
    found = [m.start() for m in re.finditer(r"(?<![^\x20\x09-\x0D])[^\x20\x09-\x0D]", text)]
    if text and re.match(r"[\x20\x09-\x0D]", text):
        found = [0, *found[1:]]
    return found


@pytest.mark.parametrize("units, block", [("code_points", 512), ("code_points", 1), ("words", 512), ("words", 3)])
def test_fill_in_middle_equals_brute_force_and_comes_back(spark, tiny, none, units, block):
    random.seed(3)
    alphabet = ["a", "b", " ", "é", "日", "😀", "\n", "<", "P>", "<P", "\x85", "\xa0"]
    rows = [(i, "".join(random.choices(alphabet, k=random.choice([0, 1, 2, 5, 40, 700])))) for i in range(300)]
    rows += [(i, f"{i} {s} tail" * 30) for i, s in enumerate(("<P>", "<S>", "<M>", "<s>", "< P>"))] + [(None, "no id"), (7, None), (7, "again"), (7, "again"), (9, "long 日" * 200_000)]
    docs = spark.createDataFrame([(*r, "x", 1, 2) for r in rows], "doc_id long, text string, form string, n int, output int")
    got = fim.examples(docs, units=units, block=block).withColumn("back", fim.restored(F.col("output"), F.col("form"))).collect()
    starts = word_starts if units == "words" else lambda t: range(len(t))
    want = [(k, *cut(k, t or "", starts(t or "")), t or "") for k, t in rows]
    key = lambda r: tuple((x is None, x) for x in r)
    assert sorted(((r.doc_id, r.n, r.form, r.prefix_chars, r.middle_chars, r.output, r.back) for r in got), key=key) == sorted(want, key=key)
    assert {r.form for r in got} == {"plain", "psm", "spm"}
    assert fim.examples(tiny, units=units).count() == 13 and fim.examples(none).count() == 0


def test_fill_in_middle_trees_sum_whole_texts_and_refuse_unsafe_sentinels(spark, tiny):
    data = np.frombuffer(("é" * 5000).encode(), np.uint8)
    trees = fim.BlockTrees(np.array([0, 0, 10_000]), [fim.code_points(data)] * 2, 16)
    assert trees.totals(0).tolist() == [0, 5000]
    for k in (0, 1, 7, 8, 4095, 4999, 5000):
        assert [x.tolist() for x in trees.find(np.array([0, k]))] == [[0, 2 * k], [0, k]]
    for bad in (("<P>", "<P>", "<M>"), ("", "<S>", "<M>"), ("ab", "ba", "c"), ("<a", "<a>", "<b")):
        with pytest.raises(ValueError):
            fim.examples(tiny, sentinels=bad)


def all_runs(w, least=6, times=4):
    """Every period of every start, one after another."""
    out = []
    for q in range(1, len(w) // times + 1):
        i = 0
        while i + q < len(w):
            j = i
            while j + q < len(w) and w[j] == w[j + q]:
                j += 1
            if j > i and j + q - i >= max(least, times * q):
                part = w[i : j + q]
                if not any(part[d:] == part[:-d] for d in range(1, q)):
                    out.append((i, j + q - i, q))
            i = max(j, i + 1)
    return sorted(out, key=lambda r: (r[0], r[2]))


def without_repeats(w, runs):
    gone = {k for start, length, period in runs for k in range(start + period, start + length)}
    return " ".join(x for k, x in enumerate(w) if k not in gone)


def periodic_text(rng):
    n = rng.choice([0, 1, 3, 5, 6, 7, 20, 60, 150, 400])
    kind = rng.random()
    if kind < 0.3:
        return [rng.choice("ab") for _ in range(n)]
    if kind < 0.4:
        return ["a"] * n
    out = []
    while len(out) < n:
        unit = [rng.choice("abc") for _ in range(rng.randint(1, 40))]
        out += [rng.choice("abcdefg") for _ in range(rng.randint(1, 12))] if rng.random() < 0.5 else (unit * 8)[: rng.randint(len(unit), 8 * len(unit))]
    return out


@pytest.mark.parametrize("strip", [64, 1 << 14])
def test_periodic_runs_equal_brute_force_whole_and_in_strips(spark, strip):
    rng = random.Random(5)
    texts = [periodic_text(rng) for _ in range(250)]
    texts += [["a", "b", "c"] * 500, ["a"] * 1000 + ["b"] + ["a"] * 1000, [f"w{i % 300}" for i in range(1500)], [f"w{i}" for i in range(500)] + [f"v{i % 130}" for i in range(700)]]
    docs = spark.createDataFrame([(i, rng.choice([" ", "\n", "\t \x0b"]).join(t)) for i, t in enumerate(texts)], "doc_id long, text string")
    got = {r.doc_id: r for r in periods.periodic_runs(docs, strip=strip).collect()}
    digests = {r.doc_id: r.collapsed for r in periods.periodic_runs(docs, strip=strip, digest=True).collect()}
    assert len(got) == len(texts)
    for i, w in enumerate(texts):
        runs = all_runs(w)
        assert [(r.start, r.length, r.period) for r in got[i].runs] == runs and got[i].n_words == len(w)
        assert got[i].collapsed == without_repeats(w, runs) and digests[i] == sha(got[i].collapsed)


def test_strips_lap_and_hold_every_octave():
    for n in (65, 100, 1000, 4096, 100_000):
        by = {}
        for low, high, first, end in periods.strips_of(n, 64):
            assert by.get((low, high), first + 8 * high) >= first + 8 * high and end > first
            by[low, high] = end
        spans = sorted(by)
        assert spans[0][0] == 1 and spans[-1][1] * 4 <= n < spans[-1][1] * 8 and all(a[1] * 2 == b[0] for a, b in zip(spans, spans[1:]))
        assert set(by.values()) == {n}


def test_periodic_runs_of_odd_rows(spark, tiny, none):
    wide = tiny.withColumn("runs", F.lit(1)).withColumn("_row", F.lit("x"))
    got = periods.periodic_runs(wide, strip=64)
    assert got.columns == ["doc_id", "n_words", "runs", "collapsed"] and got.count() == 13
    by = {r.doc_id: r for r in got.collect()}
    assert all(by[k].n_words == 0 and by[k].collapsed == "" and by[k].runs == [] for k in (3, 4, 5))
    assert [(r.start, r.length, r.period) for r in by[7].runs] == [(0, 30_000, 977)] and len(by[7].collapsed.split()) == 977
    same = spark.createDataFrame([(1, "a " * 300), (1, "a " * 300), (1, "b c " * 300), (None, "a " * 300)], "doc_id long, text string")
    assert sorted((r.collapsed, len(r.runs)) for r in periods.periodic_runs(same, strip=64).collect()) == [("a", 1)] * 3 + [("b c", 1)]
    assert periods.periodic_runs(none).count() == 0


def test_query_of_periods_equals_its_contract(spark, tmp_path):
    rng = random.Random(9)
    rows = [(i, " ".join(periodic_text(rng)) if rng.random() < 0.9 else None) for i in range(300)] + [(-5, "  a\tb  "), (10**15, "x y " * 40)]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {r.doc_id: r for r in queries.op13_periods(spark, str(tmp_path)).collect()}
    planted = 0
    for key, text in rows:
        w = [x for x in re.split(r"[\x20\x09-\x0D]+", text or "") if x]
        h = zlib.crc32(str(key).encode())
        if h % 10 == 0 and w:
            g, n = h // 10, len(w)
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            w, planted = [w[i] if i < a else w[a + (i - a) % p] for i in range(n)], planted + 1
        runs = all_runs(w)
        best = min(runs, key=lambda r: (-r[1], r[0], r[2]), default=(None, None, None))
        r = got[key]
        assert (r.n_runs, r.start, r.length, r.period) == (len(runs), *best)
        assert r.exponent_milli == (1000 * best[1] // best[2] if runs else None)
        assert r.runs_sha256 == sha("".join(f"{a},{b},{c}\n" for a, b, c in runs)) and r.collapsed_sha256 == sha(without_repeats(w, runs))
    assert planted > 10 and len(got) == len(rows)
