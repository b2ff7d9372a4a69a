"""Chunks, keywords, vector search and term weights over whole texts."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tablecare.operators.components import MOST_COLUMNS, project, truncated_svd
from tablecare.session import settle


def chunk(df: DataFrame, text: str, size: int = 1000, overlap: int = 200) -> DataFrame:
    """Fixed chunks with overlap; every character of a text is in a chunk. Adds chunk_index, chunk_total, chunk."""
    step = size - overlap
    n = F.length(text)
    total = F.when(n <= size, 1).otherwise(F.ceil((n - size) / step).cast("int") + 1)
    parts = F.transform(F.sequence(F.lit(0), total - 1), lambda i: F.struct(
        i.alias("chunk_index"), F.substring(F.col(text), i * step + 1, F.lit(size)).alias("chunk")))
    return df.where(F.col(text).isNotNull()).select("*", total.alias("chunk_total"), F.explode(parts).alias("_c")).select(
        *df.columns, "chunk_total", "_c.*")


# Fixed list: English words that carry no meaning for a search.
STOP_WORDS = ("i me my myself we our ours ourselves you your yours yourself yourselves he him his himself she her hers herself it its "
              "itself they them their theirs themselves what which who whom this that these those am is are was were be been being "
              "have has had having do does did doing a an the and but if or because as until while of at by for with about against "
              "between into through during before after above below to from up down in out on off over under again further then once "
              "here there when where why how all any both each few more most other some such no nor not only own same so than too "
              "very s t can will just don should now").split()


def tokens(c: Column) -> Column:
    """Lower-case words of letters and digits."""
    return F.array_remove(F.split(F.lower(c), r"[^\p{L}\p{N}]+"), "")


def keywords(c: Column, k: int = 5) -> Column:
    """First k words that are not stop words."""
    stop = F.array(*[F.lit(w) for w in STOP_WORDS])
    return F.slice(F.filter(tokens(c), lambda w: ~F.array_contains(stop, w)), 1, k)


QUERIES_AT_ONCE = 20_000
#: Distances of a batch that are held at a time.
CELLS = 1_000_000
FEW_WORDS = 32


def _holds(words: list[str]):
    """A function from texts to, for each word's number, the places of the texts that contain it."""
    if len(words) > FEW_WORDS:
        import ahocorasick

        machine = ahocorasick.Automaton()
        for i, w in enumerate(words):
            machine.add_word(w, i)
        machine.make_automaton()
        found = lambda text: {i for _, i in machine.iter(text)}
    else:
        found = lambda text: [i for i, w in enumerate(words) if w in text]

    def run(texts) -> dict[int, list[int]]:
        postings: dict[int, list[int]] = {}
        for place, text in enumerate(texts):
            for i in found(text) if text else ():
                postings.setdefault(i, []).append(place)
        return postings

    return run


def _best(ids: np.ndarray, vectors: np.ndarray, texts, q: np.ndarray, holds, asking: list, always: np.ndarray, boost: float, k: int):
    """(query places, ids, distances): at least the k best rows of a batch for each query, ties with the k-th included.

    Only the words' hits are held for all queries; distances are measured for some queries at a time.
    """
    hits = np.tile(always.astype(np.int32)[:, None], (1, len(ids)))
    for word, places in holds(texts).items():
        if asking[word]:
            queries, times = zip(*asking[word])
            hits[np.ix_(queries, places)] += np.array(times, np.int32)[:, None]
    powers = boost ** np.arange(hits.max(initial=0) + 1.0)
    wide, across = (vectors * vectors).sum(1), np.ascontiguousarray(vectors.T)
    step = max(1, CELLS // max(len(ids), 1))
    groups = np.arange(0, len(ids), max(1, len(ids) // (8 * k)))
    parts = [(np.zeros(0, np.int64), ids[:0], np.zeros(0))]
    for a in range(0, len(q), step):
        asked = q[a : a + step]
        factor = powers[hits[a : a + step]]
        norms = (asked * asked).sum(1)
        rough = asked @ across
        rough *= -2
        rough += wide[None, :]
        rough += norms[:, None]
        np.maximum(rough, 0.0, out=rough)
        rough *= factor
        if len(ids) > k:
            # k of the groups' least distances are no less than the k-th distance, and close to it.
            least = np.minimum.reduceat(rough, groups, axis=1) if len(groups) >= k else rough
            edge = np.partition(least, k - 1, axis=1)[:, k - 1]
            # The rough distances are off by a few last digits of the norms.
            slack = 1e-12 * (wide.max(initial=0) + norms) * factor.max(initial=1.0)
            query, row = np.nonzero(rough <= (edge + slack)[:, None])
        else:
            query, row = (x.ravel() for x in np.indices(rough.shape))
        exact = np.concatenate([((vectors[row[b : b + 4096]] - asked[query[b : b + 4096]]) ** 2).sum(1) for b in range(0, len(row), 4096)] or [np.zeros(0)])
        parts.append((query + a, ids[row], exact * factor[query, row]))
    return tuple(np.concatenate(x) for x in zip(*parts))


def search(docs: DataFrame, queries: DataFrame, doc_id: str, vector: str, text: str, k: int, where: Column | None = None,
           boost: float = 0.8, at_once: int = QUERIES_AT_ONCE) -> DataFrame:
    """Nearest documents per query; a keyword inside the text shortens the distance by the boost once per keyword.

    ``queries`` (query_id, query_vector, query_words) may be any number: they travel to the documents ``at_once`` together, each such part in
    one pass. A batch of documents finds the words of all queries in its texts together (posting lists of the batch: word to documents),
    measures all distances as one product of matrices, and each task keeps the k best rows per query. Only these are shuffled, no text and no
    vector. Documents without a vector of the queries' length are left out, as are queries without one; a null text has no words, and null
    words count for nothing. Ties go to the smaller document id.
    """
    spark = docs.sparkSession
    kind, asked_kind = dict(docs.dtypes)[doc_id], dict(queries.dtypes)["query_id"]
    source = docs if where is None else docs.where(where)
    rows = source.select(F.col(doc_id).alias("_id"), F.col(vector).cast("array<double>").alias("_v"), F.lower(text).alias("_low")).where("_id IS NOT NULL AND _v IS NOT NULL AND NOT exists(_v, x -> x IS NULL)")
    asked = settle(queries.select("query_id", F.col("query_vector").cast("array<double>").alias("v"), F.transform(F.coalesce("query_words", F.array().cast("array<string>")), F.lower).alias("words")).where("v IS NOT NULL"))
    if asked.count() > at_once:  # the documents are read once a part, and a join before them must not be done again in each
        rows = settle(rows)
    schema = f"query int, `{doc_id}` {kind}, distance double"
    out = spark.createDataFrame([], f"query_id {asked_kind}, `{doc_id}` {kind}, distance double")

    def part(chunk: list) -> DataFrame:
        width = len(chunk[0]["v"])
        if any(len(r["v"]) != width for r in chunk):
            raise ValueError("queries have vectors of different lengths")
        q = np.array([r["v"] for r in chunk], float)
        words = sorted({w for r in chunk for w in r["words"] if w})
        number, asking = {w: i for i, w in enumerate(words)}, [[] for _ in words]
        always = np.zeros(len(chunk))
        for i, r in enumerate(chunk):
            for w in set(r["words"]) - {None}:
                if w:
                    asking[number[w]].append((i, r["words"].count(w)))
                else:
                    always[i] += r["words"].count(w)  # every text holds the empty word

        def run(batches):
            holds, best = _holds(words), None
            for batch in batches:
                names, vectors, texts = batch.column(0), batch.column(1), batch.column(2).to_pylist()
                fine = np.flatnonzero(np.diff(vectors.offsets.to_numpy()) == width)
                for a in range(0, len(fine), 1024):
                    take = fine[a : a + 1024]
                    x = vectors.take(pa.array(take)).flatten().to_numpy(zero_copy_only=False).reshape(-1, width)
                    query, ids, distance = _best(take, x, [texts[i] for i in take], q, holds, asking, always, boost, k)
                    found = pa.table({"query": pa.array(query, pa.int32()), doc_id: names.take(pa.array(ids)), "distance": pa.array(distance)})
                    merged = found if best is None else pa.concat_tables([best, found])
                    order = pa.compute.sort_indices(merged, [("query", "ascending"), ("distance", "ascending"), (doc_id, "ascending")])
                    merged = merged.take(order)
                    keys = merged.column("query").to_numpy()
                    place = np.arange(len(keys)) - np.searchsorted(keys, keys)
                    best = merged.filter(pa.array(place < k)).combine_chunks()
            if best is not None:
                yield from best.to_batches()

        named = spark.createDataFrame([(i, r["query_id"]) for i, r in enumerate(chunk)], f"query int, query_id {asked_kind}")
        # The rank limit runs in every task before the shuffle.
        w = W.partitionBy("query").orderBy("distance", doc_id)
        top = rows.mapInArrow(run, schema).withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)
        return top.join(F.broadcast(named), "query").select("query_id", doc_id, "distance", "rank")

    done, chunk = None, []
    for r in asked.toLocalIterator():
        chunk.append(r)
        if len(chunk) == at_once:
            done = settle(part(chunk)) if done is None else done.unionByName(settle(part(chunk)))
            chunk = []
    if chunk:
        done = part(chunk) if done is None else done.unionByName(part(chunk))
    return out.withColumn("rank", F.lit(0)) if done is None else done


def pairs(words: Column) -> Column:
    """Pairs of neighbouring words."""
    return F.transform(F.slice(words, 2, F.greatest(F.size(words) - 1, F.lit(0))), lambda x, i: F.concat_ws(" ", F.get(words, i), x))


def grams(words: Column) -> Column:
    """Words, then pairs of neighbouring words."""
    return F.concat(words, pairs(words))


def _terms(df: DataFrame, doc_id: str, text: str, of=grams) -> DataFrame:
    """A row per place of a term of one or two words."""
    return df.select(doc_id, tokens(F.col(text)).alias("_w")).select(doc_id, F.explode(of(F.col("_w"))).alias("term"))


def _alone(df: DataFrame, doc_id: str) -> tuple[DataFrame, DataFrame | None]:
    """Rows whose id no other row has, which are whole documents, and the others (None without any); rows without an id are among these."""
    several = df.groupBy(doc_id).agg(F.count(F.lit(1)).alias("_n")).where((F.col("_n") > 1) | F.col(doc_id).isNull()).select(F.col(doc_id).alias("_several"))
    several = settle(several)
    if not several.limit(1).count():
        return df, None
    same = F.col(doc_id).eqNullSafe(F.col("_several"))
    return df.join(several, same, "left_anti"), df.join(several, same, "left_semi")


WORDS_AT_ONCE = 400_000


def _slices(words: pa.ListArray):
    """Some rows at a time: the first of them, the one after the last, their words and the row of each."""
    ends = words.offsets.to_numpy()
    a = 0
    while a < len(words):
        b = max(a + 1, int(np.searchsorted(ends, ends[a] + WORDS_AT_ONCE, "right")) - 1)
        yield a, b, words.slice(a, b - a).flatten(), np.repeat(np.arange(b - a), np.diff(ends[a : b + 1]))
        a = b


def _pairs(word, row: np.ndarray, fine: np.ndarray | None = None):
    """Pairs of neighbouring words of a row, both of them fine, and the row of each."""
    near = row[1:] == row[:-1]
    at = np.flatnonzero(near if fine is None else near & fine[1:] & fine[:-1])
    return pa.compute.binary_join_element_wise(word.take(pa.array(at)), word.take(pa.array(at + 1)), " "), row[at]


def _counted(two: bool, among: list[str] | None):
    """Words, or pairs of words ``among`` those given, of documents of one row, with the documents and the places that have them."""
    known = None if among is None else pa.array(among, pa.string())

    def run(batches):
        for batch in batches:
            for _, _, term, row in _slices(batch.column(0).fill_null([])):
                if two:
                    term, row = _pairs(term, row, None if known is None else pa.compute.is_in(term, known).to_numpy(zero_copy_only=False))
                coded = term.dictionary_encode()
                code, kinds = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64), len(coded.dictionary)
                if kinds:
                    docs = np.bincount(np.unique(row * kinds + code) % kinds, minlength=kinds)
                    yield pa.record_batch([coded.dictionary, pa.array(docs), pa.array(np.bincount(code, minlength=kinds))], names=["term", "docs", "total"])

    return run


MOST_AMONG = 100_000


def document_frequency(df: DataFrame, doc_id: str, text: str, min_df: int = 2, max_share: float = 0.95, top: int = 100) -> DataFrame:
    """Terms of one and two words with their document and total counts, most frequent first.

    A document of one row is counted where it is read, and only sums are shuffled; one of several rows has its terms gathered by id first.
    Words are counted before pairs: a pair is no more frequent than its words, so one with a word rarer than the ``top`` words within the
    limits can't be among the ``top`` terms and is not counted.
    """
    docs = df.count()
    alone, several = _alone(df, doc_id)
    words = alone.select(tokens(F.col(text)).alias("_w"))
    most = F.desc("total"), F.asc("term")

    def counts(two: bool, among: list[str] | None = None) -> DataFrame:
        freq = words.mapInArrow(_counted(two, among), "term string, docs long, total long")
        if several is not None:
            each = _terms(several, doc_id, text, pairs if two else lambda w: w).groupBy("term", doc_id).agg(F.count(F.lit(1)).alias("n"))
            freq = freq.unionByName(each.select("term", F.lit(1).cast("long").alias("docs"), F.col("n").alias("total")))
        return freq.groupBy("term").agg(F.sum("docs").alias("docs"), F.sum("total").alias("total"))

    within = (F.col("docs") >= min_df) & (F.col("docs") <= max_share * docs)
    single = settle(counts(False))
    edge = single.where(within).orderBy(*most).limit(top).agg(F.count(F.lit(1)).alias("n"), F.min("total").alias("total")).first()
    least = edge["total"] if edge["n"] == top and top else 0
    among = [r["term"] for r in single.where(F.col("total") >= least).select("term").limit(MOST_AMONG + 1).collect()]
    double = counts(True, among if len(among) <= MOST_AMONG else None)
    return single.unionByName(double).where(within).orderBy(*most).limit(top)


def vocabulary(df: DataFrame, doc_id: str, text: str, top: int = 100, **limits) -> list[tuple[str, float]]:
    """(term, smoothed idf) of the ``top`` most frequent terms, at most as many as a decomposition takes."""
    if top > MOST_COLUMNS:
        raise ValueError(f"over {MOST_COLUMNS} terms")
    docs = df.count()
    return [(r["term"], math.log((1 + docs) / (1 + r["docs"])) + 1) for r in document_frequency(df, doc_id, text, top=top, **limits).collect()]


def _weighed(terms: list[tuple[str, float]]):
    """Sparse rows of unit length of documents of one row each."""
    known, idf = pa.array([t for t, _ in terms], pa.string()), np.array([w for _, w in terms], float)
    parts = pa.array(sorted({w for t, _ in terms for w in t.split(" ") if " " in t}), pa.string())

    def run(batches):
        for batch in batches:
            for a, b, word, row in _slices(batch.column(1).fill_null([])):
                fine = pa.compute.is_in(word, parts).to_numpy(zero_copy_only=False)
                double, of = _pairs(word, row, fine)
                term, row = pa.concat_arrays([word, double]), np.concatenate([row, of])
                found = pa.compute.index_in(term, known)
                fine = np.flatnonzero(found.is_valid().to_numpy(zero_copy_only=False))
                place = found.take(pa.array(fine)).to_numpy(zero_copy_only=False).astype(np.int64)
                key, n = np.unique(row[fine] * max(len(known), 1) + place, return_counts=True)
                row, place = key // max(len(known), 1), key % max(len(known), 1)
                w = n * idf[place]
                w = w / np.sqrt(np.bincount(row, w * w, minlength=b - a))[row]
                ends = pa.array(np.concatenate([[0], np.cumsum(np.bincount(row, minlength=b - a))]), pa.int32())
                yield pa.record_batch([batch.column(0).slice(a, b - a), pa.ListArray.from_arrays(ends, pa.array(place, pa.int32())),
                                       pa.ListArray.from_arrays(ends, pa.array(w, pa.float64()))], names=["id", "places", "weights"])

    return run


def weight_rows(df: DataFrame, doc_id: str, text: str, terms: list[tuple[str, float]]) -> DataFrame:
    """id, places, weights: sparse rows of unit length over the terms; a text without any has an empty row.

    A document of one row gets its weights where it is read; the rows of an id with several are gathered.
    """
    kind = df.select(doc_id).schema[0].dataType.simpleString()
    alone, several = _alone(df, doc_id)
    rows = alone.select(F.col(doc_id).alias("id"), tokens(F.col(text)).alias("_w")).mapInArrow(_weighed(terms), f"id {kind}, places array<int>, weights array<double>")
    return rows if several is None else rows.unionByName(_gathered_rows(several, doc_id, text, terms))


def _gathered_rows(df: DataFrame, doc_id: str, text: str, terms: list[tuple[str, float]]) -> DataFrame:
    """The same rows for ids that several rows may have."""
    table = df.sparkSession.createDataFrame([(t, i, w) for i, (t, w) in enumerate(terms)], "term string, place int, idf double")
    found = _terms(df, doc_id, text).join(F.broadcast(table), "term").groupBy(doc_id, "place").agg((F.count(F.lit(1)) * F.first("idf")).alias("w"))
    rows = found.groupBy(F.col(doc_id).alias("id")).agg(F.array_sort(F.collect_list(F.struct("place", "w"))).alias("x"))
    norm = F.sqrt(F.aggregate("x", F.lit(0.0), lambda s, e: s + e["w"] * e["w"]))
    rows = rows.select("id", F.transform("x", lambda e: e["place"]).alias("places"), F.transform("x", lambda e: e["w"] / norm).alias("weights"))
    empty = df.select(F.col(doc_id).alias("id")).distinct().join(rows.select("id"), "id", "left_anti")
    return rows.unionByName(empty.select("id", F.array().cast("array<int>").alias("places"), F.array().cast("array<double>").alias("weights")))


def tfidf(df: DataFrame, doc_id: str, text: str, top: int = 100, **limits) -> DataFrame:
    """Weights per (document, term) with smoothed idf and unit length per document; the term list is at most ``top``."""
    terms = vocabulary(df, doc_id, text, top, **limits)
    named = df.sparkSession.createDataFrame([(i, t) for i, (t, _) in enumerate(terms)], "place int, term string")
    rows = weight_rows(df, doc_id, text, terms).select(F.col("id").alias(doc_id), F.explode(F.arrays_zip("places", "weights")).alias("e"))
    return rows.select(doc_id, F.col("e.places").alias("place"), F.col("e.weights").alias("weight")).join(F.broadcast(named), "place").select(doc_id, "term", "weight")


def text_components(df: DataFrame, doc_id: str, text: str, components: int = 50, top: int = 100, **limits) -> DataFrame:
    """Documents on the leading components of the term weights (latent semantic analysis), for up to 65,536 terms."""
    terms = vocabulary(df, doc_id, text, top, **limits)
    rows = settle(weight_rows(df, doc_id, text, terms))
    _, vectors = truncated_svd(rows, max(len(terms), 1), components)
    return project(rows, vectors).withColumnRenamed("id", doc_id)
