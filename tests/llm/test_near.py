"""Near-duplicate and neighbour operators against brute force."""

import random

import numpy as np
import pytest

from tablecare.llm import crosspolytope, forest, minhash


def brute(rows, width, share):
    sets = {}
    for key, text in rows:
        words = "".join(c.lower() if c.isascii() else c for c in text or "")
        for c in "\t\n\x0b\x0c\r":
            words = words.replace(c, " ")
        words = [w for w in words.split(" ") if w]
        sets[key] = {tuple(words[i : i + width]) for i in range(len(words) - width + 1)} if len(words) >= width else {tuple(words)} if words else set()
    low = {k: k for k in sets}
    changed = True
    pairs = [(a, b) for a in sets for b in sets if a < b and sets[a] & sets[b] and share[1] * len(sets[a] & sets[b]) >= share[0] * len(sets[a] | sets[b])]
    while changed:
        changed = False
        for a, b in pairs:
            m = min(low[a], low[b])
            changed |= low[a] != m or low[b] != m
            low[a] = low[b] = m
    return {k: (len(sets[k]), low[k], low[k] == k) for k in sets}


@pytest.mark.parametrize("block", [600, 5])
def test_minhash_equals_brute_force_also_in_blocks(spark, block):
    random.seed(4)
    base = [f"w{random.randint(0, 500)}" for _ in range(120)]
    rows = []
    for i in range(120):
        words = list(base) if i % 3 else [f"v{random.randint(0, 400)}" for _ in range(random.randint(0, 60))]
        for _ in range(random.randint(0, 5)):
            if words:
                words[random.randrange(len(words))] = f"x{random.randint(0, 9)}"
        rows.append((i, " ".join(words)))
    got = minhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), share=(85, 100), block=block).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in got} == brute(rows, 5, (85, 100))


def test_minhash_compares_chained_unlike_documents_in_their_buckets_only(spark, monkeypatch):
    """Each document shares 60 percent of its words with the next one: one chain of buckets, no link. The cells that are compared grow with the chain."""
    seen = {}
    for n in (300, 1200):
        words = [f"w{i}" for i in range(40 * n + 200)]
        docs = spark.createDataFrame([(i, " ".join(words[40 * i : 40 * i + 100])) for i in range(n)], "doc_id long, text string")
        cells = spark.sparkContext.accumulator(0)

        def counted(made, cells=cells):
            def make(share):
                run = made(share)

                def count(group):
                    side = group.column("side").to_numpy()
                    cells.add(int((side == 0).sum() * (side == 1).sum()))
                    return run(group)

                return count

            return make

        with monkeypatch.context() as m:
            for name in ("_rest", "_to_hub"):
                m.setattr(minhash, name, counted(getattr(minhash, name)))
            got = minhash.near_duplicates(docs).collect()
        assert all(r.kept and r.component_id == r.doc_id for r in got) and len(got) == n
        seen[n] = cells.value
    assert 0 < seen[1200] < 6 * seen[300]


def test_minhash_joins_copies_of_one_text_by_that_text(spark, monkeypatch):
    """Copies are linked with their original (190/206 shingles), not with each other: comparisons grow with the copies, not with their pairs."""
    seen = {}
    for n in (100, 400):
        rng = random.Random(6)
        base = [f"w{i}" for i in range(204)]
        rows = [(n, " ".join(base))]
        for i in range(n):
            words = list(base)
            for place in (rng.randrange(100), 100 + rng.randrange(100)):
                words[place] = f"x{i}-{place}"
            rows.append((i, " ".join(words)))
        rows = rows[1:] + rows[:1]
        cells = spark.sparkContext.accumulator(0)

        def counted(made, cells=cells):
            def make(share):
                run = made(share)

                def count(group):
                    side = group.column("side").to_numpy()
                    cells.add(int((side == 0).sum() * (side == 1).sum()))
                    return run(group)

                return count

            return make

        with monkeypatch.context() as m:
            for name in ("_rest", "_to_hub"):
                m.setattr(minhash, name, counted(getattr(minhash, name)))
            got = minhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string").coalesce(1), share=(85, 100)).collect()
        assert {r.doc_id: r.component_id for r in got} == dict.fromkeys(range(n + 1), 0)
        seen[n] = cells.value
    assert 0 < seen[400] < 6 * seen[100]


def test_minhash_edges(spark, tiny, none):
    got = minhash.near_duplicates(tiny).collect()
    by = {}
    for r in got:
        by.setdefault(r.doc_id, []).append((r.n_shingles, r.component_id, r.kept))
    assert len(got) == 13
    assert all(by[k] == [(0, k, True)] for k in (3, 4, 5))
    assert by[2] == [(8, 1, False)] and by[8][0][1] == 7 and not by[8][0][2]
    assert by[10] == [(1, 9, False)] * 2 and by[None] == [(1, None, True)]
    assert minhash.near_duplicates(none).count() == 0


def vectors(spark, rows):
    return spark.createDataFrame(rows, "vec_id long, embedding array<double>, label string, v string, id int")


def cases():
    rng = np.random.default_rng(1)
    base = rng.normal(size=(60, 16))
    rows = [(i, x.tolist(), str(i % 2)) for i, x in enumerate(base)]
    rows += [(100 + i, (base[i] + rng.normal(size=16) * 0.08).tolist(), str(i % 2)) for i in range(40)]
    rows += [(200 + i, base[3].tolist(), "1") for i in range(30)] + [(300 + i, (base[4] * 10.0**i + rng.normal(size=16) * 1e-9).tolist(), "0") for i in range(-9, 9)]
    rows += [(400, None, "0"), (401, [0.0] * 16, "0"), (402, [float("nan")] * 16, "0"), (403, [float("inf")] + [1.0] * 15, "1"), (404, [None] + [1.0] * 15, "1"), (405, [1.0], "1"),
             (406, base[3].tolist(), None), (407, (base[3] * 1e-200).tolist(), "1"), (200, base[3].tolist(), "1")]
    return [(*r, "x", 1) for r in rows]


def unit(x):
    x = np.array(x) / np.abs(x).max(axis=-1, keepdims=True)
    return x / np.linalg.norm(x, axis=-1, keepdims=True)


@pytest.fixture(params=["10000", "13"])
def batches(spark, request):
    """Arrow batches of many buckets, and of so few rows that buckets run over their ends."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", request.param)
    yield spark
    spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


@pytest.mark.parametrize("block", [512, 7])
def test_crosspolytope_equals_brute_force(batches, block):
    spark, rows = batches, cases()
    got = crosspolytope.near_vectors(vectors(spark, rows), block=block).collect()
    fine = [(i, r[0], unit(r[1]), r[2]) for i, r in enumerate(rows) if r[1] and len(r[1]) == 16 and None not in r[1] and np.isfinite(r[1]).all() and any(r[1]) and r[2]]
    links = [(a, b) for k, a in enumerate(fine) for b in fine[k + 1 :] if a[3] == b[3] and a[2] @ b[2] >= 0.93]
    n, low = {}, {r[0]: r[0] for r in rows}
    for a, b in links:
        n[a[0]], n[b[0]] = n.get(a[0], 0) + 1, n.get(b[0], 0) + 1
    for _ in range(20):
        for a, b in links:
            low[a[1]] = low[b[1]] = min(low[a[1]], low[b[1]])
    want = sorted((r[0], n.get(i, 0), low[r[0]], low[r[0]] == r[0]) for i, r in enumerate(rows))
    assert sorted((r.vec_id, r.n_links, r.component_id, r.kept) for r in got) == want
    assert crosspolytope.near_vectors(vectors(spark, [])).count() == 0


def test_crosspolytope_finds_the_links_of_the_test_table_at_every_setting(spark):
    table, rng = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet"), np.random.default_rng(8)
    rows = [(r.vec_id, [float(v) for v in r.embedding], str(r.label)) for r in table.collect()]
    # Copies whose cosine to the first lies on both sides of 0.93.
    rows += [(10_000 + k, (unit(np.array(v)[None])[0] + rng.normal(size=len(v)) * 0.05).tolist(), label) for k, (_, v, label) in enumerate(rows[:800])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label string")
    x, label = unit(np.array([r[1] for r in rows])), np.array([r[2] for r in rows])
    links = ((x @ x.T >= 0.93) & (label[:, None] == label)).sum(axis=1) - 1
    want = {r[0]: n for r, n in zip(rows, links.tolist())}
    assert sum(want.values()) > 300
    for functions in (None, 4):
        tables, probes = crosspolytope.SETTINGS[functions or 3]
        got = {r.vec_id: r.n_links for r in crosspolytope.near_vectors(df, functions=functions, tables=tables, probes=probes).collect()}
        assert sum(got.values()) >= 0.99 * sum(want.values()) and all(got[k] <= want[k] for k in want)


def test_crosspolytope_settings_keep_buckets_small():
    for rows in (1, 2, 10, 400, 2000, 10_000, 50_000, 10**6, 10**9):
        tables, functions, probes = crosspolytope.settings(rows, 64)
        assert functions <= 3 or 128 ** (functions - 1) < 512 * rows
        assert 128**functions >= 512 * rows or functions == max(crosspolytope.SETTINGS) or rows < 3
        assert (tables, probes) == crosspolytope.SETTINGS[functions]


@pytest.mark.parametrize("cell_rows", [8192, 16])
def test_forest_finds_neighbours_and_breaks_ties_by_id(spark, cell_rows):
    rows = cases()
    df = vectors(spark, rows)
    got = forest.nearest(df, df.where("vec_id % 50 = 0"), candidates=40, cell_rows=cell_rows, query_rows=4).collect()
    fine = {r[0]: unit(r[1]) for r in rows if r[1] and len(r[1]) == 16 and None not in r[1] and np.isfinite(r[1]).all() and any(r[1])}
    hits = total = 0
    for q in {r.query_id for r in got}:
        mine = sorted((r for r in got if r.query_id == q), key=lambda r: r["rank"])
        assert [r["rank"] for r in mine] == [1, 2, 3, 4, 5] and q not in {r.vec_id for r in mine}
        want = sorted(((-float(fine[q] @ fine[v]), v) for v in fine if v != q))[:5]
        assert all(abs(float(fine[q] @ fine[r.vec_id]) - r.score) < 1e-12 for r in mine)
        assert [(-r.score, r.vec_id) for r in mine] == sorted((-r.score, r.vec_id) for r in mine)
        hits += sum(r.score >= -want[-1][0] - 1e-12 for r in mine)
        total += 5
    assert {r.query_id for r in got} == {0, 50, 100, 200, 300} and hits >= 0.9 * total
    few = df.where("vec_id < 3")
    assert forest.nearest(few, few.where("vec_id = 0")).count() == 2
    assert forest.nearest(df.limit(0), df.limit(0)).count() == 0


@pytest.mark.parametrize("cell_rows", [8192, 16])
def test_forest_reduces_repeated_ids_before_the_nearest(spark, cell_rows):
    rng = np.random.default_rng(6)
    base = rng.normal(size=(40, 16))
    near = [(500, (base[0] + rng.normal(size=16) * 1e-3).tolist()) for _ in range(60)]  # one id, many vectors, nearest to the query
    rows = [(i, x.tolist()) for i, x in enumerate(base)] + near + [(501, base[0].tolist())] * 60
    df = vectors(spark, [(*r, "0", "x", 1) for r in rows])
    got = forest.nearest(df, df.where("vec_id = 0"), candidates=10_000, cell_rows=cell_rows).orderBy("rank").collect()
    best = {}
    for i, x in rows:
        best[i] = max(best.get(i, -2.0), float(unit(x) @ unit(base[0])))
    want = sorted(((-s, i) for i, s in best.items() if i))[:5]
    assert [r.vec_id for r in got] == [i for _, i in want] and all(abs(r.score + s) < 1e-12 for r, (s, _) in zip(got, want))


def test_forest_takes_queries_of_the_tables_length_only(spark):
    rng = np.random.default_rng(3)
    rows = vectors(spark, [(i, rng.normal(size=3).tolist(), "0", "x", 1) for i in range(20)])
    asked = vectors(spark, [(100, [1.0, 2.0], "0", "x", 1), (101, [2.0, 1.0], "0", "x", 1), (102, [1.0, 2.0, 3.0], "0", "x", 1)])
    got = forest.nearest(rows, asked).collect()
    assert len(got) == 5 and {r.query_id for r in got} == {102}


def test_forest_sends_index_rows_only_where_they_are_asked_for(spark, monkeypatch):
    rng = np.random.default_rng(3)
    df = vectors(spark, [(i, rng.normal(size=16).tolist(), "0", "x", 1) for i in range(2000)])
    sent = {}
    for some, block in ((1000, 8192), (1000, 10), (10, 8192)):
        rows = spark.sparkContext.accumulator(0)

        def counted(depth, rows=rows, made=forest._count):
            run = made(depth)

            def count(group):
                rows.add(int((~group.column("query").to_numpy(zero_copy_only=False)).sum()))
                return run(group)

            return count

        with monkeypatch.context() as m:
            m.setattr(forest, "_count", counted)
            found = forest.nearest(df, df.where(f"vec_id < {some}"), candidates=100, share=0.0, cell_rows=32, query_rows=block, trees=4).count()
        assert found == 5 * some
        sent[some, block] = rows.value
    assert sent[1000, 8192] <= 4 * 2000 and sent[10, 8192] < 0.3 * sent[1000, 8192] and sent[1000, 10] < 5 * sent[1000, 8192]


def test_forest_recall_on_the_test_table(spark):
    df = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet")
    got = forest.nearest(df, df.where("vec_id % 50 = 0")).collect()
    rows = df.collect()
    ids, x = np.array([r.vec_id for r in rows]), np.array([unit(np.array(r.embedding, float)) for r in rows])
    hits = total = 0
    for q in np.flatnonzero(ids % 50 == 0):
        score = x @ x[q]
        score[q] = -2
        best = set(ids[np.argsort(-score)[:5]])
        hits += len(best & {r.vec_id for r in got if r.query_id == ids[q]})
        total += 5
    assert hits / total >= 0.9
