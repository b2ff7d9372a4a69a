"""Search with keywords, and neighbours, against plain versions."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tablecare.operators import text as tx
from tablecare.operators.nearest import grow, nearest, routes
from tablecare.queries.catalog import ORACLES, QUERIES

DOCS = "id long, v array<double>, body string, kind string"


def plain_search(docs, queries, k, boost=0.8):
    out = []
    for qid, qv, words in queries:
        scored = []
        for i, v, body, _ in docs:
            if i is None or v is None or qv is None or len(v) != len(qv) or None in v:
                continue
            hits = sum(w is not None and body is not None and w.lower() in body.lower() for w in words or [])
            scored.append((sum((a - b) ** 2 for a, b in zip(v, qv)) * boost**hits, i))
        out += [(qid, i, pytest.approx(s, rel=1e-9, abs=1e-12), r + 1) for r, (s, i) in enumerate(sorted(scored)[:k])]
    return out


@pytest.mark.parametrize("at_once, many", [(1000, False), (7, False), (1000, True)])
def test_search_equals_plain_search(spark, at_once, many):
    rng = np.random.default_rng(3)
    vocabulary = [f"{a}{b}" for a in ("al", "Be", "ga", "DE", "é") for b in ("x", "yy", "z z", "ß", "m")]
    text = lambda: " ".join(rng.choice(vocabulary, rng.integers(0, 6)))
    docs = [(i, rng.integers(0, 3, 4).astype(float).tolist(), text(), "k") for i in range(150)]  # few distinct vectors: many ties
    docs += [(200, None, "alx", "k"), (201, [1.0], "alx", "k"), (202, [0.0, 1.0, 2.0, 0.0], None, "k"), (203, [None, 1.0, 1.0, 1.0], "", "k"), (None, [0.0] * 4, "", "k")]
    words = lambda: rng.choice(vocabulary + ["nowhere", "x", "l"], rng.integers(0, 4)).tolist()
    queries = [(f"q{i}", rng.integers(0, 3, 4).astype(float).tolist(), words()) for i in range(30)]
    queries += [("null words", [0.0] * 4, None), ("null word", [1.0] * 4, [None, "alx", "alx"]), ("no vector", None, ["alx"])]
    if many:  # more words than are looked for one by one
        queries += [(f"m{i}", [1.0, 0.0, 2.0, float(i % 3)], [f"w{i}", vocabulary[i % len(vocabulary)]]) for i in range(100)]
    got = tx.search(spark.createDataFrame(docs, DOCS).repartition(3), spark.createDataFrame(queries, "query_id string, query_vector array<double>, query_words array<string>"),
                    "id", "v", "body", 4, at_once=at_once)
    assert sorted((r.query_id, r.id, r.distance, r["rank"]) for r in got.collect()) == sorted(plain_search(docs, queries, 4), key=lambda r: (r[0], r[1]))


def test_search_takes_thousands_of_queries_and_none(spark):
    docs = spark.createDataFrame([(i, [float(i), 0.0], f"text {i}", "a") for i in range(300)], DOCS)
    queries = spark.range(5000).select(F.col("id").alias("query_id"), F.array((F.col("id") % 300).cast("double"), F.lit(0.0)).alias("query_vector"), F.array(F.concat(F.lit("text "), F.col("id") % 7)).alias("query_words"))
    got = tx.search(docs, queries, "id", "v", "body", 1)
    assert got.count() == 5000 and got.where("query_id % 300 <> id").count() == 0
    assert tx.search(docs, queries.limit(0), "id", "v", "body", 1).count() == 0
    assert tx.search(docs, queries, "id", "v", "body", 1, where=F.col("kind") == "b").count() == 0


def clustered(rng, n, width=6):
    centres = rng.normal(size=(max(n // 25, 1), width)) * 40
    return centres[rng.integers(0, len(centres), n)] + rng.normal(size=(n, width))


@pytest.mark.parametrize("block, leaf_rows", [(4096, 2000), (16, 8), (7, 3)])
def test_nearest_equals_brute_force_at_every_depth_of_the_tree(spark, block, leaf_rows):
    rng = np.random.default_rng(block)
    x = clustered(rng, 500)
    x[100:140] = x[7]  # one crowded point: ties go by id, and its leaf is cut into blocks
    q = np.concatenate([x[::9], rng.normal(size=(15, 6)) * 200])
    corpus = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "id int, v array<double>")
    queries = spark.createDataFrame([(i * 9 if i < 56 else 1000 + i, v.tolist()) for i, v in enumerate(q)], "qid int, v array<double>")
    for skip in (False, True):
        got = {}
        for r in nearest(queries, corpus, "qid", "id", "v", "v", 5, skip_self=skip, block=block, leaf_rows=leaf_rows).collect():
            got.setdefault(r.qid, []).append((r["rank"], r.dist, r.cid))
        for i, v in enumerate(q):
            name = i * 9 if i < 56 else 1000 + i
            d = ((x - v) ** 2).sum(1)
            want = sorted((s, j) for j, s in enumerate(d.tolist()) if not (skip and j == name))[:5]
            mine = sorted(got[name])
            assert [c for _, _, c in mine] == [j for _, j in want] and [s for _, s, _ in mine] == pytest.approx([s for s, _ in want])
    close = nearest(queries, corpus, "qid", "id", "v", "v", 500, within=9.0, block=block, leaf_rows=leaf_rows).groupBy("qid").count().collect()
    assert {r["qid"]: r["count"] for r in close} == {n: c for n, c in ((i * 9 if i < 56 else 1000 + i, int((((x - v) ** 2).sum(1) <= 9.0).sum())) for i, v in enumerate(q)) if c}
    assert nearest(queries, corpus.limit(0), "qid", "id", "v", "v", 5).count() == 0 and nearest(queries.limit(0), corpus, "qid", "id", "v", "v", 5).count() == 0


def test_queries_visit_few_blocks_however_large_the_table(spark):
    rng = np.random.default_rng(1)
    share = {}
    for n in (1000, 4000):
        x = clustered(rng, n)
        df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "id int, v array<double>")
        tree, layout, held = grow(df, "id", "v", block=64, leaf_rows=20)
        assert held.count() == n and held.groupBy("block").count().agg({"count": "max"}).first()[0] <= 2 * 64
        assert len(tree.tops) <= len(tree.pivots) ** 0.5 + 1 and len(tree.pivots) <= max(n // 20, 1)
        reach = df.select(F.col("id").alias("qid"), "v", F.lit(4.0).alias("reach"))
        share[n] = routes(reach, tree, layout, "int").count() / n / held.select("block").distinct().count()
    assert share[4000] < 0.5 * share[1000] < 0.1  # of all blocks, by a query


def test_a_batch_of_many_queries_is_searched_in_little_memory():
    import tracemalloc

    rng = np.random.default_rng(4)
    x, q = rng.normal(size=(1024, 8)), rng.normal(size=(4000, 8))
    asking = [[(i, 1) for i in range(0, 4000, 7)], [], [(5, 2)]]
    tracemalloc.start()
    query, ids, distance = tx._best(np.arange(1024), x, [f"text {i % 3}" for i in range(1024)], q, tx._holds(["1", "nowhere", "2"]), asking, np.zeros(4000), 0.8, 3)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    hits = np.zeros((1024, 4000))
    hits[1::3, ::7] += 1
    hits[2::3, 5] += 2
    want = ((x[:, None] - q[None]) ** 2).sum(2) * 0.8**hits
    order = np.lexsort((ids, distance, query))
    first = order[np.arange(len(order)) - np.searchsorted(query[order], query[order]) < 3]
    assert ids[first].reshape(4000, 3).tolist() == np.argsort(want, axis=0, kind="stable")[:3].T.tolist()
    assert peak < 80e6  # all distances of the batch at once took 200 MB


@pytest.fixture
def passages(spark, tmp_path):
    """Vectors of 320 documents, of which 100 and 57, and 301 and 311, are near each other."""
    rng = np.random.default_rng(2)
    x = rng.normal(size=(320, 8))
    x[[100, 301]] = x[[57, 311]] + 1e-3
    spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<float>").write.parquet(f"{tmp_path}/embeddings.parquet")
    spark.createDataFrame([(i, f"some passage number {i}") for i in range(320)], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    return str(tmp_path)


def test_the_named_search_asks_with_every_id(spark, passages):
    found = QUERIES["txt_search_all"](spark, passages).collect()
    assert {r.query_id for r in found} == set(range(320)) and all(r.vec_id == r.query_id for r in found if r["rank"] == 1) and len(found) == 960
    assert "% 100" not in ORACLES["txt_search_all"]


def test_documents_are_stored_once_when_queries_take_several_passes(spark):
    read = spark.sparkContext.accumulator(0)

    def counted(batches):
        for pdf in batches:
            read.add(len(pdf))
            yield pdf

    docs = spark.createDataFrame([(i, [float(i), 0.0], f"text {i}", "a") for i in range(30)], DOCS).mapInPandas(counted, DOCS)
    queries = spark.range(40).select(F.col("id").alias("query_id"), F.array(F.col("id").cast("double"), F.lit(0.0)).alias("query_vector"), F.array(F.lit("text")).alias("query_words"))
    assert tx.search(docs, queries, "id", "v", "body", 1, at_once=10).count() == 40
    assert read.value == 30  # before, 30 in each of four passes


def test_named_neighbours_are_asked_for_by_every_id(spark, passages):
    near = QUERIES["jon_knn"](spark, passages).collect()
    assert {r.qid for r in near} == set(range(320)) and len(near) == 3200 and {(r.qid, r.cid) for r in near} >= {(100, 57), (57, 100), (301, 311), (311, 301)}
    assert "% 100" not in ORACLES["jon_knn"]


def test_cached_answers_are_sought_for_every_id(spark, passages):
    assert {(r.qid, r.cid) for r in QUERIES["txt_similar_pairs"](spark, passages).collect()} >= {(100, 57), (57, 100), (301, 311), (311, 301)}
    assert "% 100" not in ORACLES["txt_similar_pairs"]


def test_pivots_meet_on_an_executor_and_take_the_driver_little_memory(spark, monkeypatch):
    """Every task sent the driver as many rows as there are pivots."""
    import tracemalloc

    from tablecare.operators import nearest as ne
    from tablecare.session import settle

    sent = []
    monkeypatch.setattr(ne, "settle", lambda df: (sent.append((df.columns, (done := settle(df)).rdd.getNumPartitions())), done)[1])
    rows = spark.range(3000, numPartitions=20).select("id", F.array(F.col("id").cast("double")).alias("v"))
    tree, layout, _ = grow(rows, "id", "v", 64, 32)
    assert (["v"], 1) in sent
    smallest = [r["v"] for r in rows.orderBy(F.xxhash64("id")).limit(93).select("v").collect()]
    assert tree.pivots.tolist() == smallest and layout.count.sum() == 3000
    same = rows.withColumn("id", F.col("id") % 2)  # equal ids have equal hashes, so few or no rows may be under a bound
    tree, layout, _ = grow(same, "id", "v", 64, 32)
    assert len(tree.pivots) == 93 and layout.count.sum() == 3000

    pivots = np.random.default_rng(5).normal(size=(20_000, 2))
    tracemalloc.start()
    tree = ne.Tree(pivots, "chebyshev")
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 40e6  # all distances at once took 68 MB
    assert tree.parent[::500].tolist() == np.abs(pivots[::500, None] - tree.tops).max(2).argmin(1).tolist()
