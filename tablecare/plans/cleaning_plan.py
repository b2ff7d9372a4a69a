"""Ordered cleaning plans: steps of (action, column, params) folded over a DataFrame."""

from __future__ import annotations

from dataclasses import dataclass, field
from itertools import groupby

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tablecare.functions.columns import clip, numeric_columns, text_columns
from tablecare.operators import clean as cl
from tablecare.operators.project import convert, currency, date_text


@dataclass(frozen=True)
class Step:
    action: str
    column: str | None = None
    params: dict = field(default_factory=dict, hash=False)


def from_rows(rows: list[dict]) -> list[Step]:
    """Steps from plain dicts, as a YAML or JSON file holds them."""
    return [Step(r["action"], r.get("column"), dict(r.get("params") or {})) for r in rows]


def to_rows(steps: list[Step]) -> list[dict]:
    return [{"column": s.column, "action": s.action, "params": dict(s.params)} for s in steps]


def _each(fn):
    """Apply a column function to each named column."""
    def run(df, cols, params):
        return df.withColumns({c: fn(df, c, params) for c in cols})
    return run


def _fill(df, cols, p):
    method = p.get("method", "median")
    if method in ("forward_fill", "backward_fill"):
        if not p.get("order"):
            raise ValueError("forward and backward fill need an order")
        fn = cl.forward_fill if method == "forward_fill" else cl.backward_fill
        for c in cols:
            df = fn(df, c, list(p.get("keys", [])), list(p["order"]))
        return df
    if method == "median_by_group":
        return cl.fill_by_group(df, cols, p["by"])
    if method in ("knn", "iterative"):
        # One column has no neighbours but itself, so both come down to the mean.
        method = "mean"
    if method in ("median", "mean"):
        numbers = [c for c in cols if c in numeric_columns(df)]
        words = [c for c in cols if c not in numbers]
        df = cl.fill(df, numbers, method) if numbers else df
        return cl.apply_fill(df, {c: "missing" for c in words if c in text_columns(df)})
    return cl.fill(df, cols, method, p.get("value", "missing"))


def _outliers(df, cols, p):
    method = p.get("method", "clip")
    if method == "winsorize":
        return cl.clip_quantiles(df, cols, 0.05, 0.95)
    if method == "remove":
        return cl.remove_outliers(df, cols)
    if method == "fences":
        return cl.clip_fences(df, cols)
    return cl.clip_quantiles(df, cols)


def _encode(df, cols, p):
    for c in cols:
        df = cl.one_hot(df, c) if p.get("method") == "onehot" else cl.label_encode(df, c)
    return df


def _rename(df, cols, p):
    return df.withColumnRenamed(cols[0], p["new_name"])


ACTIONS = {
    "handle_sentinels": lambda df, cols, p: cl.null_sentinels(df, cols, p.get("sentinels")),
    "fix_negative_prices": lambda df, cols, p: cl.fix_negative_prices(df, cols, p.get("by", "category")),
    "fill_missing": _fill,
    "handle_outliers": _outliers,
    "normalize": lambda df, cols, p: cl.scale(df, cols, p.get("method", "minmax")),
    "encode": _encode,
    "remove_column": lambda df, cols, p: df.drop(*cols),
    "rename_column": _rename,
    "convert_dtype": _each(lambda df, c, p: convert(F.col(c), p.get("dtype", "float"))),
    "normalize_currency": _each(lambda df, c, p: currency(F.col(c), p.get("conversion_rate", 1.0))),
    "standardize_format": _each(lambda df, c, p: date_text(F.col(c), p["format"])),
    "clip_values": _each(lambda df, c, p: clip(F.col(c), p.get("min"), p.get("max"))),
}
# These act on one column at a time.
SINGLE = {"rename_column"}


def replay(df: DataFrame, steps: list[Step]) -> tuple[DataFrame, list[dict]]:
    """Run the steps in order. A step that does not fit the table is skipped, and the log says why.

    Neighbouring steps with the same action and params on different columns are fitted together, so one
    pass gives all their parameters.
    """
    log: list[dict] = []
    for (action, params), group in groupby(steps, key=lambda s: (s.action, repr(sorted(s.params.items())))):
        batch = list(group)
        if action == "remove_duplicates":
            df = cl.drop_duplicates(df)
            log.append({"action": action, "column": None, "state": "done"})
            continue
        parts = [[s] for s in batch] if action in SINGLE else [batch]
        for part in parts:
            known = [s for s in part if s.column in df.columns]
            log += [{"action": action, "column": s.column, "state": "skipped: no such column"} for s in part if s not in known]
            if not known:
                continue
            cols = list(dict.fromkeys(s.column for s in known))
            if action not in ACTIONS:
                log += [{"action": action, "column": c, "state": "skipped: unknown action"} for c in cols]
                continue
            try:
                df = ACTIONS[action](df, cols, known[0].params)
                log += [{"action": action, "column": c, "state": "done"} for c in cols]
            except (ValueError, KeyError, TypeError) as e:
                log += [{"action": action, "column": c, "state": f"skipped: {e}"} for c in cols]
    return df, log
