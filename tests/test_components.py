"""Term weights and their decomposition against dense algebra."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tablecare.operators import components as co
from tablecare.operators import text as tx
from tablecare.plans.preprocess import Preprocess


def sparse(spark, dense, parts=3):
    rows = [(i, np.flatnonzero(r).tolist(), r[r != 0].tolist()) for i, r in enumerate(dense)]
    return spark.createDataFrame(rows, "id int, places array<int>, weights array<double>").repartition(parts)


@pytest.mark.parametrize("shape, rank", [((400, 60), 60), ((400, 60), 4), ((5, 40), 5), ((300, 3), 3)])
def test_decomposition_equals_a_dense_one(spark, shape, rank):
    rng = np.random.default_rng(rank)
    n, m = shape
    dense = (rng.normal(size=(n, rank)) * 0.6 ** np.arange(rank)) @ rng.normal(size=(rank, m))
    dense[rng.random(dense.shape) < 0.3] = 0 if rank == m else dense[rng.random(dense.shape) < 0.3][0]
    dense[min(3, n - 1)] = 0
    values, vectors = co.truncated_svd(sparse(spark, dense), m, 5, rounds=4)
    _, want, right = np.linalg.svd(dense, full_matrices=False)
    k = len(values)
    assert k == min(5, int((want > want[0] * 1e-10).sum())) and np.allclose(values, want[:k], rtol=1e-3)
    assert np.allclose(vectors.T @ vectors, np.eye(k), atol=1e-9)
    error = np.linalg.norm(dense - dense @ vectors @ vectors.T)
    assert error <= np.linalg.norm(dense - dense @ right[:k].T @ right[:k]) * 1.001 + 1e-9
    got = {r.id: r.components for r in co.project(sparse(spark, dense), vectors).collect()}
    assert np.allclose([got[i] for i in range(n)], dense @ vectors)


def test_tall_qr_gives_the_triangular_factor(spark):
    dense = np.random.default_rng(2).normal(size=(200, 30))
    right = np.random.default_rng(3).normal(size=(30, 7))
    r = co.tall_qr(sparse(spark, dense, 9), right)
    assert r.shape == (7, 7) and np.allclose(r.T @ r, right.T @ dense.T @ dense @ right)


def test_decomposition_of_nothing(spark):
    for dense in (np.zeros((0, 4)), np.zeros((3, 4))):
        values, vectors = co.truncated_svd(sparse(spark, dense), 4, 2)
        assert len(values) == 0 and vectors.shape == (4, 0)
    with pytest.raises(ValueError):
        co.truncated_svd(sparse(spark, np.zeros((1, 1))), co.MOST_COLUMNS + 1, 2)


def test_text_components_rebuild_the_weights(spark):
    words = ["tax", "price", "stock", "order", "late", "fee", "rate", "note"]
    rng = np.random.default_rng(4)
    docs = [(i, " ".join(rng.choice(words[: 4 + 4 * (i % 2)], rng.integers(0, 12)))) for i in range(120)] + [(500, None), (501, "")]
    df = spark.createDataFrame(docs, "doc_id int, text string")
    weights = tx.tfidf(df, "doc_id", "text", top=60).collect()
    terms = sorted({r.term for r in weights})
    dense = np.zeros((len(docs), len(terms)))
    place = {i: n for n, (i, _) in enumerate(docs)}
    for r in weights:
        dense[place[r.doc_id], terms.index(r.term)] = r.weight
    filled = dense.any(axis=1)
    assert np.allclose(np.linalg.norm(dense[filled], axis=1), 1) and len(terms) > 30
    got = {r.doc_id: r.components for r in tx.text_components(df, "doc_id", "text", components=6, top=60).collect()}
    mine = np.array([got[i] for i, _ in docs])
    _, s, _ = np.linalg.svd(dense, full_matrices=False)
    assert np.allclose(np.linalg.norm(mine, axis=0), s[:6], rtol=1e-2) and not mine[~filled].any()


def test_preprocessing_projects_texts_like_the_decomposition(spark):
    words = ["tax", "price", "stock", "order", "late", "fee", "rate", "note"]
    rng = np.random.default_rng(4)
    df = spark.createDataFrame([(i, " ".join(rng.choice(words[: 4 + 4 * (i % 2)], rng.integers(0, 12)))) for i in range(120)] + [(500, None), (501, "unseen words")], "doc_id int, body string")
    plan = Preprocess(exclude=("doc_id",), text="svd", text_terms=60, text_components=4, kinds={"body": "text"}).fit(df)
    out = plan.transform(df)
    assert out.columns == ["doc_id", *[f"body_svd_{i}" for i in range(4)]]
    want = {r.doc_id: r.components for r in tx.text_components(df, "doc_id", "body", components=4, top=60).collect()}
    for r in out.collect():
        assert np.allclose(list(r)[1:], want[r.doc_id], atol=1e-6)
    assert not any(list(out.where("doc_id = 501").first())[1:])


ROWS = [(1, "one two one two three"), (2, "two three"), (2, "three four. Two one"), (None, "one two"), (None, "three"), (3, None), (4, ""), (5, "One, two; four four")]


@pytest.mark.parametrize("at_once", [400_000, 3])
def test_terms_of_single_and_repeated_ids_equal_plain_counts(spark, monkeypatch, at_once):
    monkeypatch.setattr(tx, "WORDS_AT_ONCE", at_once)
    seen = {}
    for key, text in ROWS:
        words = "".join(c if c.isalnum() else " " for c in (text or "").lower()).split()
        for term in [*words, *(f"{a} {b}" for a, b in zip(words, words[1:]))]:
            seen.setdefault(term, []).append(key)
    df = spark.createDataFrame(ROWS, "doc_id int, text string")
    for top in (3, 100):
        got = [(r.term, r.docs, r.total) for r in tx.document_frequency(df, "doc_id", "text", max_share=0.7, top=top).collect()]
        want = sorted(((t, len(set(k)), len(k)) for t, k in seen.items() if 2 <= len(set(k)) <= 0.7 * len(ROWS)), key=lambda x: (-x[2], x[0]))
        assert got == want[:top]
    weights = {(r.id, tuple(r.places), tuple(round(w, 9) for w in r.weights)) for r in tx.weight_rows(df, "doc_id", "text", [("two", 1.0), ("one two", 2.0), ("four", 3.0)]).collect()}
    unit = lambda *w: tuple(round(x / sum(y * y for y in w) ** 0.5, 9) for x in w)
    assert weights == {(1, (0, 1), unit(2, 4)), (2, (0, 2), unit(2, 3)), (5, (0, 1, 2), unit(1, 2, 6)), (3, (), ()), (4, (), ()), (None, (0, 1), unit(1, 2)), (None, (), ())}


def test_terms_of_single_rows_are_counted_where_they_are_read(spark):
    """Words and pairs are shuffled as sums of the rows of a task, and pairs only of words as frequent as the top ones."""
    df = spark.createDataFrame([(i, f"often seen {i % 2} words r{i}a r{i}b r{i}c") for i in range(300)], "doc_id int, text string").repartition(2)
    rows = [b for b in df.select(tx.tokens(F.col("text")).alias("_w")).mapInArrow(tx._counted(True, ["often", "seen", "words"]), "term string, docs long, total long").collect()]
    assert {r.term for r in rows} == {"often seen"} and sum(r.total for r in rows) == 300 and len(rows) <= 4
    assert [(r.term, r.docs) for r in tx.document_frequency(df, "doc_id", "text", max_share=1.0, top=4).collect()] == [("often", 300), ("often seen", 300), ("seen", 300), ("words", 300)]
