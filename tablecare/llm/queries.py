"""The registered queries of this subpackage: thin digests of the operators, over whole tables."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

import corpus_pipeline
from tablecare.llm import chat, crosspolytope, exact, fim, forest, langid, licenses, minhash, mixing, packing, periods, viterbi, warc
from tablecare.llm.common import table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def keep(fn):
        QUERIES[name] = fn
        if sql:
            ORACLES[name] = sql.strip()
        return fn

    return keep


@query("op1_forest")
def op1_forest(spark, sf_dir):
    """Five nearest vectors of every fiftieth one. Approximate, so tested by recall against brute force."""
    rows = table(spark, sf_dir, "embeddings")
    return forest.nearest(rows, rows.where("vec_id % 50 = 0"), "vec_id", "embedding", k=5)


@query("op2_crosspolytope", """
WITH RECURSIVE v AS (
  SELECT vec_id, label, embedding::DOUBLE[] AS e FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
links AS MATERIALIZED (SELECT a.vec_id AS x, b.vec_id AS y FROM v a JOIN v b ON a.label = b.label AND a.vec_id <> b.vec_id WHERE list_cosine_similarity(a.e, b.e) >= 0.93),
reach(x, y) AS (SELECT x, y FROM links UNION SELECT r.x, l.y FROM reach r JOIN links l ON r.y = l.x),
low AS (SELECT x, min(y) AS y FROM reach GROUP BY x),
degree AS (SELECT x, count(*) AS n FROM links GROUP BY x)
SELECT vec_id, coalesce(n, 0)::BIGINT AS n_links, least(vec_id, coalesce(low.y, vec_id)) AS component_id, vec_id <= coalesce(low.y, vec_id) AS kept
FROM embeddings LEFT JOIN low ON low.x = vec_id LEFT JOIN degree ON degree.x = vec_id
""")
def op2_crosspolytope(spark, sf_dir):
    return crosspolytope.near_vectors(table(spark, sf_dir, "embeddings"), "vec_id", "embedding", "label", least=0.93)


@query("op3_viterbi")
def op3_viterbi(spark, sf_dir):
    """Tokens of every document by the pieces of a public vocabulary; tested against the tokenizer library."""
    return viterbi.token_counts(table(spark, sf_dir, "documents"), "doc_id", "text", model_file=public_tokenizers.path("piece_bpe_32k.model"))


@query("op4_warc", """
WITH p AS (SELECT page_id, coalesce(html, '') AS h, strlen(coalesce(html, '')) AS bytes, sha1(coalesce(html, '')) AS digest FROM pages),
g AS (SELECT digest, max(page_id) AS response FROM p WHERE bytes >= 1000 GROUP BY digest)
SELECT page_id, bytes::BIGINT AS payload_bytes, p.digest AS payload_digest, CASE WHEN page_id < response THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN page_id < response THEN response END AS refers_to
FROM p LEFT JOIN g ON g.digest = p.digest AND bytes >= 1000
""")
def op4_warc(spark, sf_dir):
    return warc.archive_round_trip(table(spark, sf_dir, "pages")).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


#: Target weights of the domains that ``labels`` tells apart.
DOMAIN_WEIGHTS = {"high": 0.9, "low": 0.07, "toxic": 0.03}


def domains(spark, sf_dir) -> DataFrame:
    domain = F.expr("CASE WHEN toxic = 1 THEN 'toxic' WHEN quality = 1 THEN 'high' WHEN quality = 0 THEN 'low' END")
    return table(spark, sf_dir, "labels").select("doc_id", domain.alias("domain")).where("domain IS NOT NULL")


@query("op5_mixing")
def op5_mixing(spark, sf_dir):
    """Rate and copies of every document; tested against a brute-force solution."""
    return mixing.rates(table(spark, sf_dir, "documents"), domains(spark, sf_dir), DOMAIN_WEIGHTS)[0]


@query("op6_langid")
def op6_langid(spark, sf_dir):
    """Language of every document, learned without the fifth that is held out; tested by held-out accuracy."""
    docs = table(spark, sf_dir, "documents")
    held = F.expr("crc32(coalesce(cast(doc_id AS string), '')) % 5 = 0")
    model = langid.fit(docs.where(~held))
    return langid.predict(docs, model).select("doc_id", held.alias("held_out"), "lang_pred", "score", "rejected")


ESCAPED = "replace(replace(replace({0}, '\\', '\\\\'), '#', '\\#'), '</', '<\\/')"


@query("op7_chat", f"""
WITH t AS (SELECT conv_id, turn, role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '\\### Assistant: </turn> ok' UNION ALL SELECT -7, 1, 'assistant', '\\### Assistant: </turn> ok'),
f AS (SELECT *, length('### ' || replace({ESCAPED.format('role')}, ':', '\\:') || ': ' || {ESCAPED.format('text')} || ' </turn>' || chr(10)) AS size,
  row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC, role DESC, text DESC) AS back FROM t),
c AS (SELECT *, sum(size) OVER (PARTITION BY conv_id ORDER BY turn, role, text ROWS UNBOUNDED PRECEDING) AS total FROM f)
SELECT conv_id, count(*)::BIGINT AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
  coalesce(sum(length(text)) FILTER (WHERE role = 'assistant'), 0)::BIGINT AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
  sum(total) FILTER (WHERE role = 'assistant' OR back = 1)::BIGINT AS formatted_chars
FROM c GROUP BY conv_id
""")
def op7_chat(spark, sf_dir):
    turns = table(spark, sf_dir, "conversations")
    own = "\\### Assistant: </turn> ok"
    extra = spark.createDataFrame([(-7, 0, "user", own), (-7, 1, "assistant", own)], turns.select("conv_id", "turn", "role", "text").schema)
    return chat.digests(chat.examples(turns.select(extra.columns).union(extra))).drop("n_examples")


@query("op8_licenses", licenses.sql())
def op8_licenses(spark, sf_dir):
    return licenses.scan(table(spark, sf_dir, "documents"), "doc_id", "text").drop("n_blocks")


UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


@query("op9_minhash", f"""
WITH RECURSIVE w AS (SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), '{UPPER}', '{UPPER.lower()}'), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS w FROM documents),
s AS MATERIALIZED (SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) >= 5 THEN list_transform(range(1, len(w) - 3), lambda i: array_to_string(list_slice(w, i, i + 4), ' '))
  WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END) AS shingle FROM w),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
c AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM s a JOIN s b ON a.shingle = b.shingle AND a.doc_id <> b.doc_id GROUP BY ALL),
links AS MATERIALIZED (SELECT x, y FROM c JOIN n nx ON nx.doc_id = x JOIN n ny ON ny.doc_id = y WHERE 100 * c >= 85 * (nx.n + ny.n - c)),
reach(x, y) AS (SELECT x, y FROM links UNION SELECT r.x, l.y FROM reach r JOIN links l ON r.y = l.x),
low AS (SELECT x, min(y) AS y FROM reach GROUP BY x)
SELECT d.doc_id, coalesce(n, 0)::BIGINT AS n_shingles, least(d.doc_id, coalesce(y, d.doc_id)) AS component_id, d.doc_id <= coalesce(y, d.doc_id) AS kept
FROM documents d LEFT JOIN n ON n.doc_id = d.doc_id LEFT JOIN low ON low.x = d.doc_id
""")
def op9_minhash(spark, sf_dir):
    return minhash.near_duplicates(table(spark, sf_dir, "documents"), "doc_id", "text", width=5, share=(85, 100))


@query("op10_packing")
def op10_packing(spark, sf_dir):
    """Pieces of all documents in windows of 4096 ids; tested by a round trip and against a brute-force optimum."""
    pieces = packing.pack(table(spark, sf_dir, "documents"), "doc_id", "text", tokenizer=public_tokenizers.path("word_bpe_49k.json"))
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


@query("op11_refine", f"""
WITH t AS (SELECT doc_id, translate(coalesce(text, ''), '{UPPER}', '{UPPER.lower()}') AS x FROM documents),
g AS (SELECT x, max(doc_id) AS keep_id, count(*) AS group_size FROM t GROUP BY x)
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, sha256(x) AS text_sha256 FROM t JOIN g USING (x)
""")
def op11_refine(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").withColumn("text_sha256", F.sha2(exact.ascii_lower(F.col("text")), 256))
    return exact.exact_duplicates(docs, "doc_id", "text", carry=("text_sha256",))


@query("op12_fenwick", """
WITH t AS (SELECT doc_id, coalesce(text, '') AS t, length(coalesce(text, '')) AS n, sha256('1:' || doc_id) AS h FROM documents),
u AS (SELECT *, ('0x' || h[1:8])::BIGINT AS h1, ('0x' || h[9:16])::BIGINT AS h2, ('0x' || h[17:24])::BIGINT AS h3, ('0x' || h[25:32])::BIGINT AS h4 FROM t),
c AS (SELECT *, least(h1 % (n + 1), h2 % (n + 1)) AS x, greatest(h1 % (n + 1), h2 % (n + 1)) AS y,
  CASE WHEN n = 0 OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR h3 % 100 >= 90 THEN 'plain' WHEN h4 % 100 < 20 THEN 'spm' ELSE 'psm' END AS form FROM u),
o AS (SELECT *, left(t, x) AS a, substring(t, x + 1, y - x) AS b, substring(t, y + 1) AS c FROM c)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN x END AS prefix_chars, CASE WHEN form <> 'plain' THEN y - x END AS middle_chars,
  sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '<P>' || a || '<S>' || c || '<M>' || b ELSE '<S>' || c || '<P>' || a || '<M>' || b END) AS output_sha256, sha256(t) AS restored_sha256
FROM o
""")
def op12_fenwick(spark, sf_dir):
    made = fim.examples(table(spark, sf_dir, "documents"), "doc_id", "text")
    back = fim.restored(F.col("output"), F.col("form"))
    return made.select("doc_id", "n", "form", "prefix_chars", "middle_chars", F.sha2("output", 256).alias("output_sha256"), F.sha2(back, 256).alias("restored_sha256"))


def with_repeats(docs: DataFrame) -> DataFrame:
    """A tenth of the documents repeat a stretch of their words to the end, as their id says."""
    h = F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")))
    words = F.filter(F.split(F.coalesce("text", F.lit("")), r"[\x20\x09-\x0D]+"), lambda w: w != "")
    rows = docs.select("doc_id", "text", F.floor(h / 10).alias("g"), F.when(h % 10 == 0, words).alias("w")).withColumn("n", F.size("w"))
    rows = rows.withColumn("a", F.expr("CASE WHEN n > 0 THEN g % n END")).withColumn("p", F.expr("1 + (n - a) DIV (3 + g % 8)"))
    again = F.expr("array_join(transform(sequence(0L, n - 1L), i -> w[CAST(IF(i < a, i, a + (i - a) % p) AS INT)]), ' ')")
    return rows.select("doc_id", F.when(F.col("n") > 0, again).otherwise(F.col("text")).alias("text"))


@query("op13_periods")
def op13_periods(spark, sf_dir):
    """Runs of every document; tested against a brute-force version."""
    found = periods.periodic_runs(with_repeats(table(spark, sf_dir, "documents")), "doc_id", "text", digest=True)
    # The greatest length wins, then the smallest start, then the smallest period.
    best = F.array_max(F.transform("runs", lambda r: F.struct(r["length"].alias("length"), (-r["start"]).alias("start"), (-r["period"]).alias("period"))))
    lines = F.concat_ws("", F.transform("runs", lambda r: F.concat(F.concat_ws(",", r["start"].cast("string"), r["length"].cast("string"), r["period"].cast("string")), F.lit("\n"))))
    rows = found.withColumn("best", best)
    start, length, period = -F.col("best.start"), F.col("best.length"), -F.col("best.period")
    return rows.select("doc_id", F.size("runs").cast("long").alias("n_runs"), start.alias("start"), length.alias("length"), period.alias("period"),
                       F.expr("1000 * best.length DIV -best.period").alias("exponent_milli"), F.sha2(lines, 256).alias("runs_sha256"), F.col("collapsed").alias("collapsed_sha256"))


QUERIES["pipeline"] = corpus_pipeline.run
