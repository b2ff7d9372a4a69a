"""Mixing domains to target weights with soft membership, in DataFrame and SQL functions only.

A labelled table (id, domain) trains a naive Bayes classifier on classes of whole-text features: share of symbols, share of capitals,
share of distinct words, mean word length, length, and for each domain the number of its marker words in the text. Counts come from the
``fit_rows`` labelled rows per domain with the smallest hash of their id (a documented bound); priors come from all labelled rows.
Every document gets posteriors p_k, so its tokens count towards every domain in part.

Rates r_d minimise weighted squares of the misses sum_d n_d p_dk r_d - target_k over the box lowest <= r_d <= highest by projected gradient,
r_d <- clip(r_d - sum_k p_dk g_k). Since all r_d start at 1, a rate is a function of the posteriors and of the few numbers g_k
of each round. A round is one aggregate over a narrow table; no rate is stored or shipped, and nothing depends on the number of sources.
A document is then taken floor(rate) times, and once more if a hash of its id falls below the rest.

Null, empty and blank texts have no tokens and the posteriors of their own feature classes. Labels that are null or without a document
are ignored; a document with two labels counts for both. A target without a labelled row can't be met and is ignored. Repeated rows
are rated alike. With no documents or no labels, all rates are 1. Columns of ``docs`` are kept; new ones that clash replace nothing,
because results carry only the id, or (in ``mixed``) only the columns of ``docs``.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tablecare.llm.common import Workspace, smallest_hashes

SHARES = (0.0, 0.005, 0.02, 0.05, 0.1, 0.2, 0.4)
MARKERS, FIT_ROWS = 25, 4000


@dataclass
class Domains:
    names: list[str]
    priors: list[float]
    markers: list[list[str]]
    logs: dict[str, list[list[float]]] = field(default_factory=dict)  # feature -> class -> domain


def _share_class(x: Column) -> Column:
    out = F.lit(len(SHARES))
    for i in range(len(SHARES) - 1, -1, -1):
        out = F.when(x <= SHARES[i], i).otherwise(out)
    return out


def _words(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "[ \\n\\t\\r]+")


def tokens(text: Column) -> Column:
    return F.when(F.coalesce(F.btrim(text, F.lit(" \n\t\r")), F.lit("")) == "", F.lit(0)).otherwise(F.size(_words(text))).cast("long")


def _with_features(rows: DataFrame, text: str, markers: list[list[str]]) -> tuple[DataFrame, dict[str, int]]:
    """Adds the feature classes as columns _f_*, and _tokens; returns how many classes each has."""
    every = sorted({w for m in markers for w in m})
    body = F.coalesce(F.col(text), F.lit(""))
    rows = rows.withColumns({"_words": _words(F.col(text)), "_n": F.length(body), "_tokens": tokens(F.col(text)),
                             "_symbols": F.length(F.regexp_replace(body, "[^!#$%&*|<>{}=+_~^@]+", "")), "_capitals": F.length(F.regexp_replace(body, "[^A-Z]+", ""))})
    rows = rows.withColumns({"_kinds": F.size(F.array_distinct("_words")), "_size": F.size("_words"),
                             "_hits": F.array_intersect("_words", F.array(*[F.lit(w) for w in every])) if every else F.array().cast("array<string>")})
    n = F.greatest(F.col("_n"), F.lit(1))
    made = {"_f_symbols": _share_class(F.col("_symbols") / n), "_f_capitals": _share_class(F.col("_capitals") / n),
            "_f_distinct": F.floor(10 * F.col("_kinds") / F.col("_size")).cast("int"), "_f_word": F.least(F.floor(F.col("_n") / F.col("_size")), F.lit(15)).cast("int"),
            "_f_length": F.least(F.floor(F.log2(F.col("_n") + F.lit(1.0))), F.lit(20)).cast("int")}
    classes = {"_f_symbols": len(SHARES) + 1, "_f_capitals": len(SHARES) + 1, "_f_distinct": 11, "_f_word": 16, "_f_length": 21}
    for k, own in enumerate(markers):
        hits = F.size(F.array_intersect("_hits", F.array(*[F.lit(w) for w in own]))) if own else F.lit(0)
        made[f"_f_marker{k}"], classes[f"_f_marker{k}"] = F.least(hits, F.lit(5)), 6
    return rows.withColumns(made).drop("_words", "_n", "_symbols", "_capitals", "_kinds", "_size", "_hits"), classes


def fit_domains(docs: DataFrame, labelled: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_id: str = "doc_id",
                domain_col: str = "domain", *, fit_rows: int = FIT_ROWS, markers: int = MARKERS) -> Domains:
    """Learn from a table of (label_id, domain_col)."""
    spark = docs.sparkSession
    ws = Workspace(spark)
    labels = labelled.select(F.col(label_id).alias("_id"), F.col(domain_col).cast("string").alias("_domain")).where("_id IS NOT NULL AND _domain IS NOT NULL").distinct()
    counted = {r["_domain"]: r["n"] for r in labels.groupBy("_domain").agg(F.count("*").alias("n")).collect()}
    names = sorted(counted)
    if len(names) > 64:
        raise ValueError(f"{len(names)} domains; at most 64 can be mixed")
    chosen = F.broadcast(smallest_hashes(labels, "_domain", "_id", fit_rows, counted))  # at most 64 * fit_rows ids
    sample = ws.put(docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text")).join(chosen, "_id"), "sample")
    rows = {r["_domain"]: r["n"] for r in sample.groupBy("_domain").agg(F.count("*").alias("n")).collect()}
    names = [d for d in names if rows.get(d)]
    total = sum(counted[d] for d in names)
    model = Domains(names, [float(np.log(counted[d] / total)) for d in names], [[] for _ in names])
    if not names:
        return model
    each = sample.select("_domain", F.explode(F.array_distinct(_words(F.col("_text")))).alias("word")).where("word <> ''")
    per = each.groupBy("word").pivot("_domain", names).agg(F.count(F.lit(1))).na.fill(0)
    every = F.lit(0.0)
    for d in names:
        every = every + F.col(f"`{d}`")
    for k, d in enumerate(names):
        own, size, rest = F.col(f"`{d}`"), rows[d], sum(rows.values()) - rows[d]
        odds = F.log((own + 0.5) / (size + 1.0)) - F.log((every - own + 0.5) / (rest + 1.0))
        top = per.where(own >= max(3, size // 200)).withColumn("_odds", odds).where("_odds >= 1").orderBy((own * F.col("_odds")).desc(), "word").limit(markers)
        model.markers[k] = sorted(r["word"] for r in top.select("word").collect())
    featured, classes = _with_features(sample, "_text", model.markers)
    found = featured.select("_domain", F.explode(F.array(*[F.struct(F.lit(f).alias("f"), F.col(f).cast("int").alias("c")) for f in classes])).alias("x"))
    seen = {(r["_domain"], r["f"], r["c"]): r["n"] for r in found.groupBy("_domain", "x.f", "x.c").agg(F.count("*").alias("n")).collect()}
    for f, size in classes.items():
        model.logs[f] = [[float(np.log((seen.get((d, f, c), 0) + 0.5) / (rows[d] + 0.5 * size))) for d in names] for c in range(size)]
    return model


def posteriors(docs: DataFrame, model: Domains, text_col: str = "text", prefix: str = "_p") -> DataFrame:
    """``docs`` with _tokens and one column ``prefix`` + number per domain; the posteriors of a row add up to 1."""
    rows, _ = _with_features(docs, text_col, model.markers)
    scores = {}
    for k, prior in enumerate(model.priors):
        logs = (f"element_at(array({', '.join(f'{c[k]!r}D' for c in rows_of)}), {f} + 1)" for f, rows_of in model.logs.items())
        scores[f"_s{k}"] = F.expr(" + ".join([f"{prior!r}D", *logs]))
    rows = rows.withColumns(scores).drop(*model.logs)
    most = F.greatest(*[F.col(s) for s in scores]) if len(scores) > 1 else F.col("_s0")
    rows = rows.withColumn("_most", most).withColumns({f"_e{k}": F.exp(F.col(f"_s{k}") - F.col("_most")) for k in range(len(scores))}).drop("_most", *scores)
    total = sum((F.col(f"_e{k}") for k in range(1, len(scores))), F.col("_e0"))
    return rows.withColumn("_total", total).withColumns({f"{prefix}{k}": F.col(f"_e{k}") / F.col("_total") for k in range(len(scores))}).drop(
        "_total", *[f"_e{k}" for k in range(len(scores))])


@dataclass
class Rates:
    """The rounds' numbers g_k (already times the step), the box, and the token sums before and after."""

    rounds: list[list[float]]
    lowest: float
    highest: float
    before: list[float]
    after: list[float]
    targets: list[float]

    def column(self, prefix: str = "_p", start: str = "1D") -> Column:
        """The rate after all rounds. Their numbers are one array that the expression folds over, so neither the plan nor its code grows with the rounds."""
        if not self.rounds:
            return F.expr(start)
        steps = ", ".join(f"array({', '.join(f'{x!r}D' for x in g)})" for g in self.rounds)
        step = " + ".join(f"{prefix}{k} * g[{k}]" for k in range(len(self.rounds[0])))
        return F.expr(f"aggregate(array({steps}), {start}, (r, g) -> greatest({self.lowest!r}D, least({self.highest!r}D, r - ({step}))))")


def fit_rates(rows: DataFrame, weights: list[float], *, budget: float | None = 1.0, lowest: float = 0.0, highest: float = 8.0, rounds: int = 40,
              close: float = 1e-3, prefix: str = "_p") -> Rates:
    """Rates for a table of (_tokens, posteriors); targets are weights times ``budget`` times all tokens.

    Without a budget it is the smallest at which no domain is too large at its lowest rate. Documents that dilute a domain hold a little of it
    themselves, so the budget grows with what the last fit left over, until the targets are met or ``highest`` stands in the way.
    Misses are weighted by the inverse of H = sum of n_d p_d p_d', so step 1 is allowed: without clipping the first round meets the targets.
    Later steps are as long as the last move and the change of its gradient say (spectral steps, 1 to 50); the best round counts. It ends when all targets are met to ``close`` of all tokens, or when a round changes the sums by less than a fiftieth of that.
    """
    size = len(weights)
    p = [F.col(f"{prefix}{k}") for k in range(size)]
    pairs = [(j, k) for j in range(size) for k in range(j, size)]
    first = rows.agg(*[F.sum(F.col("_tokens") * p[j] * p[k]).alias(f"h{j}_{k}") for j, k in pairs], F.sum("_tokens").alias("all")).first()
    none = Rates([], lowest, highest, [0.0] * size, [0.0] * size, [0.0] * size)
    if not size or not first["all"]:
        return none
    h = np.zeros((size, size))
    for j, k in pairs:
        h[j, k] = h[k, j] = first[f"h{j}_{k}"]
    every, share = float(first["all"]), np.array(weights, float) / sum(weights)
    if budget is not None:
        return _descend(rows, h, share * budget * every, lowest, highest, rounds, close, prefix)
    needed = lambda sums: max(1.0, *(x / (w * every) for x, w in zip(sums, share) if w > 0))
    budget = needed(lowest * h.sum(axis=0))
    for _ in range(8):
        out = _descend(rows, h, share * budget * every, lowest, highest, rounds, close, prefix)
        over, budget = budget, needed(out.after)
        if budget <= over * 1.001 or over > highest or np.abs(np.subtract(out.after, out.targets)).max() <= close * sum(out.targets):
            break
        budget *= 1.01
    return out


def _descend(rows: DataFrame, h: np.ndarray, wanted: np.ndarray, lowest: float, highest: float, rounds: int, close: float, prefix: str) -> Rates:
    p = [F.col(f"{prefix}{k}") for k in range(len(wanted))]
    weigh = np.linalg.pinv(h, rcond=1e-6, hermitian=True)
    before, least, best = None, np.inf, 0
    out = Rates([], lowest, highest, [], [], wanted.tolist())
    for k in range(rounds + 1):
        last, step = (Rates(x, lowest, highest, [], [], []) for x in (out.rounds[:-1], out.rounds[-1:]))
        moved = F.sum(F.col("_tokens") * F.pow(F.col("_rate") - F.col("_last"), 2))
        row = rows.withColumn("_last", last.column(prefix)).withColumn("_rate", step.column(prefix, "_last")).agg(*[F.sum(F.col("_tokens") * F.col("_rate") * x) for x in p], moved).first()
        now, moved = np.array([float(x) for x in row[:-1]]), float(row[-1])
        miss = now - wanted
        price = float(miss @ weigh @ miss)
        if price < least:
            least, best, out.after = price, k, now.tolist()
        out.before = out.before or now.tolist()
        length = 1.0
        if before is not None:
            change = now - before
            bend = float(change @ weigh @ change)
            if np.abs(change).max() <= 0.02 * close * wanted.sum():
                break
            length = min(50.0, max(1.0, moved / bend)) if bend > 0 else 1.0
        if k == rounds or np.abs(miss).max() <= close * wanted.sum():
            break
        before = now
        out.rounds.append((length * (weigh @ miss)).tolist())
    out.rounds = out.rounds[:best]
    return out


def copies(rate: Column, *key: Column) -> Column:
    draw = F.pmod(F.xxhash64(*key), F.lit(1_000_003)) / F.lit(1_000_003.0)
    return (F.floor(rate) + F.when(draw < rate - F.floor(rate), 1).otherwise(0)).cast("int")


def _key(id_col: str, text_col: str) -> Column:
    """What a row's draw goes by: its id and text, so that rows without an id, or with one id and several texts, draw for themselves."""
    return F.xxhash64(F.col(id_col), F.col(text_col)).alias("_key")


def rates(docs: DataFrame, labelled: DataFrame, weights: dict[str, float], id_col: str = "doc_id", text_col: str = "text",
          label_id: str = "doc_id", domain_col: str = "domain", **options) -> tuple[DataFrame, Domains, Rates]:
    """id_col, tokens, p_<domain> for each learned domain, rate, copies per document; the classifier; the fitted rates."""
    ws = Workspace(docs.sparkSession)
    model = fit_domains(docs, labelled, id_col, text_col, label_id, domain_col)
    narrow = docs.select(F.col(id_col).alias("_id"), _key(id_col, text_col), F.col(text_col).alias("_text"))
    rows = posteriors(narrow, model, "_text") if model.names else narrow.withColumn("_tokens", tokens(F.col("_text")))
    rows = ws.put(rows.drop("_text"), "posteriors")
    fitted = fit_rates(rows, [weights.get(d, 0.0) for d in model.names], **options) if any(weights.get(d) for d in model.names) else Rates([], 0.0, 1.0, [], [], [])
    rows = rows.withColumn("_rate", fitted.column())
    result = rows.select(F.col("_id").alias(id_col), F.col("_tokens").alias("tokens"), *[F.col(f"_p{k}").alias(f"p_{d}") for k, d in enumerate(model.names)],
                         F.col("_rate").alias("rate"), copies(F.col("_rate"), F.col("_key")).alias("copies"))
    return result, model, fitted


def mixed(docs: DataFrame, model: Domains, fitted: Rates, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs``, each as often as its rate says; the columns stay as they are."""
    if not fitted.rounds:
        return docs
    columns = [F.col(f"`{c}`") for c in docs.columns]
    packed = docs.select(F.struct(*columns).alias("_row"), F.col(text_col).alias("_text"), _key(id_col, text_col))
    rated = posteriors(packed, model, "_text").withColumn("_rate", fitted.column())
    # A filter on the rate would be pushed through all the columns it is made of; one on the exploded rows is not.
    each = rated.select("_row", F.explode_outer(F.array_repeat(F.lit(1), copies(F.col("_rate"), F.col("_key")))).alias("_one"))
    return each.where("_one IS NOT NULL").select("_row.*")
