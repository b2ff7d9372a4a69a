"""Generate feature families, keep the columns with the largest variance, and replay the choice on new rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tablecare.functions.columns import numeric_columns
from tablecare.operators import features as fe


class AutoFeatures:
    """``fit`` returns the chosen columns and the fitted values behind them; ``transform`` is one projection."""

    def __init__(self, max_features: int = 100, threshold: float = 0.01):
        self.max_features, self.threshold = max_features, threshold
        self.numeric: list[str] = []
        self.rows = False
        self.columns: dict[str, Column] = {}
        self.selected: list[str] = []

    def fit(self, df: DataFrame, numeric: list[str] | None = None,
            families=("polynomial", "interaction", "ratio", "log", "row", "bins")) -> AutoFeatures:
        self.numeric = numeric or numeric_columns(df)
        made: dict[str, Column] = {}
        if "polynomial" in families:
            made.update(fe.polynomial_columns(self.numeric))
        if "interaction" in families:
            made.update(fe.interaction_columns(self.numeric))
        if "ratio" in families:
            made.update(fe.ratio_columns(self.numeric))
        if "log" in families:
            made.update(fe.log_columns(df, self.numeric))
        if "row" in families:
            self.rows = True
            made.update({c: F.col(c) for c in fe.ROW_STATISTICS})
        if "bins" in families:
            made.update(fe.bin_columns(fe.bin_edges(df, self.numeric)))
        base = {c: F.col(c) for c in self.numeric}
        self.columns = {**base, **made}
        spread = self._variances(df)
        kept = [c for c in self.columns if spread[c] is not None and spread[c] > self.threshold]
        if len(kept) > self.max_features:
            kept = sorted(kept, key=lambda c: -spread[c])[:self.max_features]
        self.selected = kept
        return self

    def _ready(self, df: DataFrame) -> DataFrame:
        return fe.row_statistics(df, self.numeric) if self.rows else df

    def _variances(self, df: DataFrame, batch: int = 30) -> dict[str, float]:
        names = list(self.columns)
        out: dict[str, float] = {}
        for start in range(0, len(names), batch):
            part = names[start:start + batch]
            row = self._ready(df).agg(*[F.var_pop(F.coalesce(self.columns[c].cast("double"), F.lit(0.0))).alias(f"v{i}") for i, c in enumerate(part)]).first()
            out.update({c: row[i] for i, c in enumerate(part)})
        return out

    def transform(self, df: DataFrame, keep: list[str] | None = None) -> DataFrame:
        return self._ready(df).select(*(keep or []), *[self.columns[c].alias(c) for c in self.selected])
