"""The whole preprocessing plan: types, dates, rare values, fills, clips, scales and codes, fitted once."""

from __future__ import annotations

import math
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tablecare.functions.columns import clip, is_missing
from tablecare.functions.ordered import quantiles
from tablecare.operators.clean import ONE_HOT_LIMIT, TooManyValues
from tablecare.operators.features import datetime_features
from tablecare.operators.profile import Facts, gather
from tablecare.operators.components import truncated_svd
from tablecare.operators.quality import feature_types
from tablecare.operators.text import grams, tokens, vocabulary, weight_rows
from tablecare.session import settle


@dataclass
class Preprocess:
    """``fit`` keeps medians, bounds, moments, category lists and terms; ``transform`` is one projection without a shuffle.

    No column is lost but the excluded ones, which pass as they are, and dates, which become their parts. Numbers are filled, clipped and
    scaled; categories of any type are encoded; texts pass unchanged (``text="pass"``), become the weights of their ``text_terms`` most
    common terms (``text="tfidf"``), or ``text_components`` coordinates of the weights of terms of one and two words (``text="svd"``; terms
    in ``text_min_df`` rows at least and in a share of ``text_max_share`` at most); columns without a value, and others that no rule covers, pass. ``kinds`` sets the type of a column by hand.
    """

    scaling: str = "standard"
    encoding: str = "onehot"
    clip_outliers: bool = True
    rare_share: float = 0.01
    exclude: tuple[str, ...] = ()
    text: str = "pass"
    text_terms: int = 100
    text_components: int = 50
    text_min_df: int = 2
    text_max_share: float = 0.95
    kinds: dict[str, str] = field(default_factory=dict)
    types: dict[str, str] = field(default_factory=dict)
    medians: dict[str, float] = field(default_factory=dict)
    bounds: dict[str, tuple] = field(default_factory=dict)
    centers: dict[str, tuple] = field(default_factory=dict)
    values: dict[str, list] = field(default_factory=dict)
    dates: list[str] = field(default_factory=list)
    terms: dict[str, list[tuple[str, float]]] = field(default_factory=dict)
    spaces: dict[str, tuple[list[tuple[str, float]], np.ndarray]] = field(default_factory=dict)
    passed: list[str] = field(default_factory=list)

    def _dated(self, df: DataFrame) -> DataFrame:
        for c in self.dates:
            df = datetime_features(df, c)
        return df

    def fit(self, df: DataFrame) -> Preprocess:
        facts = Facts(df.drop(*self.exclude), duplicates=False)
        self.types = {**feature_types(facts), **self.kinds}
        self.dates = [c for c, k in self.types.items() if k == "datetime"]
        dated = self._dated(df)
        made = [c for c in dated.columns if c not in df.columns]
        numeric = [c for c, k in self.types.items() if k in ("numeric", "ordinal")] + made
        numeric += [c for c, k in self.types.items() if k == "binary" and c in facts.numeric]
        numeric = [c for c in numeric if c in made or c in facts.numeric]
        probs = [0.01, 0.25, 0.5, 0.75, 0.99]
        found = quantiles(dated, numeric, probs)
        for c in numeric:
            low, q1, mid, q3, high = found[c]
            if mid is None:
                continue
            self.medians[c] = mid
            if self.clip_outliers and self.types.get(c) == "numeric":
                self.bounds[c] = (low, high)
            if self.scaling == "robust":
                self.centers[c] = (mid, (q3 - q1) or 1.0)
        cleaned = self._numbers(dated, scale=False)
        if self.scaling in ("standard", "minmax") and self.medians:
            two = (F.avg, F.stddev_pop) if self.scaling == "standard" else (F.min, F.max)
            row = gather(cleaned, {f"{i}_{c}": f(F.col(c).cast("double")) for c in self.medians for i, f in enumerate(two)})
            for c in self.medians:
                a, b = row[f"0_{c}"], row[f"1_{c}"]
                self.centers[c] = (a, (b if self.scaling == "standard" else b - a) or 1.0)
        # Ordinal columns always go to 0..1.
        ranks = [c for c, k in self.types.items() if k == "ordinal" and c in self.medians]
        if ranks:
            row = gather(cleaned, {f"{i}_{c}": f(F.col(c).cast("double")) for c in ranks for i, f in enumerate((F.min, F.max))})
            self.centers.update({c: (row[f"0_{c}"], (row[f"1_{c}"] - row[f"0_{c}"]) or 1.0) for c in ranks})
        coded = [c for c, k in self.types.items() if k == "categorical" or k == "binary" and c not in facts.numeric]
        for c in coded:
            counts = df.groupBy(F.coalesce(F.col(c).cast("string"), F.lit("missing")).alias("v")).agg(F.count(F.lit(1)).alias("n"))
            # Values over the rare share number at most 1 / share.
            kept = counts.where(F.col("n") >= self.rare_share * facts.rows).orderBy("v").take(ONE_HOT_LIMIT + 1)
            if len(kept) > ONE_HOT_LIMIT:
                raise TooManyValues(f"{c} has over {ONE_HOT_LIMIT} values above the rare share; raise rare_share, or set its kind to text")
            self.values[c] = [r["v"] for r in kept]
        if self.text == "tfidf":
            for c in (c for c, k in self.types.items() if k == "text"):
                found = df.select(F.explode(F.array_distinct(tokens(F.col(c)))).alias("t")).groupBy("t").agg(F.count(F.lit(1)).alias("n"))
                top = found.orderBy(F.desc("n"), "t").limit(self.text_terms).collect()
                self.terms[c] = [(r["t"], math.log((1 + facts.rows) / (1 + r["n"])) + 1) for r in top]
        if self.text == "svd":
            for c in (c for c, k in self.types.items() if k == "text"):
                numbered = settle(df.select(F.monotonically_increasing_id().alias("_row"), c))
                terms = vocabulary(numbered, "_row", c, self.text_terms, min_df=self.text_min_df, max_share=self.text_max_share)
                rows = settle(weight_rows(numbered, "_row", c, terms))
                self.spaces[c] = (terms, truncated_svd(rows, max(len(terms), 1), self.text_components)[1])
        done = {*self.exclude, *self.medians, *self.values, *self.terms, *self.spaces, *self.dates}
        self.passed = [c for c in df.columns if c not in done]
        return self

    def _numbers(self, df: DataFrame, scale: bool = True) -> DataFrame:
        out = {}
        for c, mid in self.medians.items():
            v = F.when(is_missing(df, c), F.lit(mid)).otherwise(F.col(c).cast("double"))
            if c in self.bounds:
                v = clip(v, *self.bounds[c])
            if scale and c in self.centers:
                at, spread = self.centers[c]
                v = (v - F.lit(at)) / F.lit(spread)
            out[c] = v
        return df.withColumns(out)

    def transform(self, df: DataFrame) -> DataFrame:
        """Fitted values only; categories not seen in the fit count as Other."""
        out = self._numbers(self._dated(df))
        cols = [F.col(c) for c in self.exclude if c in out.columns] + [F.col(c) for c in self.medians]
        for c, values in self.values.items():
            v = F.coalesce(F.col(c).cast("string"), F.lit("missing"))
            other = ~v.isin(values)
            if self.encoding == "onehot":
                # A value that is called Other shares its column with the rest, as rare values of that name do elsewhere.
                cols += [F.when(v == x, 1.0).otherwise(0.0).alias(f"{c}_{x}") for x in values if x != "Other"]
                cols.append(F.when(other | (v == "Other"), 1.0).otherwise(0.0).alias(f"{c}_Other"))
            else:
                code = F.lit(-1)
                for i, x in enumerate(values):
                    code = F.when(v == x, i).otherwise(code)
                cols.append(code.alias(c))
        cols += [F.col(c) for c in self.passed if c in out.columns]
        # The words of a text are split once, and each term reads its count from them.
        for i, (c, terms) in enumerate(self.terms.items()):
            out = out.withColumn(f"_words{i}", tokens(F.coalesce(F.col(c), F.lit(""))))
            for term, weight in terms:
                count = F.size(f"_words{i}") - F.size(F.array_remove(f"_words{i}", term))
                cols.append((count * F.lit(weight)).alias(f"{c}_tfidf_{term}"))
        for i, (c, (terms, vectors)) in enumerate(self.spaces.items()):
            out = out.withColumn(f"_space{i}", _projected(terms, vectors)(grams(tokens(F.coalesce(F.col(c), F.lit(""))))))
            cols += [F.get(f"_space{i}", F.lit(j)).alias(f"{c}_svd_{j}") for j in range(vectors.shape[1])]
        return out.select(*cols)


def _projected(terms: list[tuple[str, float]], vectors: np.ndarray):
    """A function from a text's terms to the coordinates of its weights, scaled to unit length."""
    place, idf = {t: i for i, (t, _) in enumerate(terms)}, np.array([w for _, w in terms])

    @F.pandas_udf("array<double>")
    def run(column: pd.Series) -> pd.Series:
        out = []
        for found in column:
            known, counts = np.unique([place[t] for t in found if t in place] or np.zeros(0, int), return_counts=True)
            w = counts * idf[known] if len(known) else np.zeros(0)
            length = np.sqrt((w * w).sum())
            out.append((w / length) @ vectors[known] if length else np.zeros(vectors.shape[1]))
        return pd.Series(out)

    return run
