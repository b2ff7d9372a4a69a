"""Rule-based cleaning from end to end: facts choose the plan, the plan is replayed, a report says what was done."""

from __future__ import annotations

from pyspark.sql import DataFrame

from tablecare.functions.columns import has_word, kind_of, numeric_columns
from tablecare.operators.profile import Facts, missing_counts, outlier_counts
from tablecare.operators.quality import local_stats, recommendations
from tablecare.plans.cleaning_plan import Step, replay
from tablecare.session import settle

# Outlier steps leave these columns alone in retail data.
SKIP_WORDS = ("stock", "qty", "quantity")


def _fill_step(c: str, numeric: bool, by: str | None) -> Step:
    if not numeric:
        return Step("fill_missing", c, {"method": "constant", "value": "missing"})
    if by:
        return Step("fill_missing", c, {"method": "median_by_group", "by": by})
    return Step("fill_missing", c, {"method": "median"})


def auto_clean(df: DataFrame, sector: str = "general", by: str = "category",
               protect: tuple[str, ...] = (), before: Facts | None = None) -> tuple[DataFrame, dict]:
    """Duplicates, sentinels, negative prices, sparse columns, fills and clips, with a step report.

    Statistics are taken over the whole table at each stage, never per part. Columns in ``protect`` (keys)
    keep their values. ``before`` is the facts of ``df``, duplicates included, when they are there already.
    """
    retail = sector == "retail"
    before = before or Facts(df)
    steps: list[Step] = []
    if before.duplicates:
        steps.append(Step("remove_duplicates"))
    if retail:
        steps += [Step("handle_sentinels", c) for c in before.sentinel_columns() if c not in protect]
        steps += [Step("fix_negative_prices", c, {"by": by}) for c in before.negative_prices() if c not in protect]
    cleaned, log = replay(df, steps)
    # Each stage is fitted in several passes: what the stage before it shuffled is written once, not worked out in each of them.
    cleaned = settle(cleaned) if steps else cleaned

    rows, missing = missing_counts(cleaned)
    kinds = {c: kind_of(cleaned, c) for c in cleaned.columns}
    group = by if retail and by in df.columns else None
    open_ = [c for c in cleaned.columns if c not in protect]
    steps = [Step("remove_column", c) for c in open_ if missing[c] > 0.5 * rows]
    steps += [_fill_step(c, kinds[c] == "numeric", group) for c in open_
              if 0 < missing[c] <= 0.5 * rows and kinds[c] in ("numeric", "text")]
    cleaned, more = replay(cleaned, steps)
    cleaned = settle(cleaned) if steps else cleaned
    log += more

    free = [c for c in numeric_columns(cleaned) if c not in protect and not (retail and has_word(c, SKIP_WORDS))]
    shares = {r["column"]: r["share"] for r in outlier_counts(cleaned, free).collect()} if free else {}
    cleaned, more = replay(cleaned, [Step("handle_outliers", c, {"method": "clip"}) for c in free if shares.get(c, 0) > 0.05])
    log += more
    # Fills leave nulls only where a whole group had no value; counted on the result.
    left = sum(missing_counts(cleaned)[1].values())
    report = {
        "quality_before": local_stats(before)["quality_score"],
        "quality_after": 100 - left / max(rows * len(cleaned.columns), 1) * 100,
        "steps": log,
    }
    return cleaned, report


def basic_clean(df: DataFrame) -> tuple[DataFrame, list[dict]]:
    """The fallback: duplicates out, medians and constants in, clip to the fences."""
    facts = Facts(df)
    steps = [Step("remove_duplicates")] if facts.duplicates else []
    steps += [_fill_step(c, c in facts.numeric, None) for c in facts.columns
              if facts.col[c]["missing"] and facts.kinds[c] in ("numeric", "text")]
    steps += [Step("handle_outliers", c, {"method": "fences"}) for c in facts.numeric if facts.col[c]["outliers"]]
    return replay(df, steps)


def clean_from_recommendations(facts: Facts, by: str = "category", protect: tuple[str, ...] = (),
                               general: int | None = None) -> tuple[DataFrame, list[dict]]:
    """Turn the recommendations for a table into plan steps, special ones first, then all general ones, or only the first ``general``."""
    recs = recommendations(facts)
    special = [r for r in recs if r[1] in ("sentinel_handling", "price_correction", "imputation_strategy")]
    rest = [r for r in recs if r not in special][:general]
    group = by if by in facts.columns else None
    gaps = [c for c in facts.columns if facts.col[c]["missing"] and c not in protect]
    steps: list[Step] = []
    for _, category, column, _ in special + rest:
        if column in protect:
            continue
        if category == "sentinel_handling":
            steps += [Step("handle_sentinels", column), _fill_step(column, True, group)]
        elif category == "price_correction":
            steps.append(Step("fix_negative_prices", column, {"by": by}))
        elif category == "imputation_strategy" and group:
            steps += [_fill_step(c, True, group) for c in gaps if c in facts.numeric]
        elif category == "missing_data":
            steps += [_fill_step(c, c in facts.numeric, None) for c in gaps if facts.kinds[c] in ("numeric", "text")]
        elif category == "outliers":
            steps += [Step("handle_outliers", c, {"method": "clip"}) for c in facts.numeric
                      if not has_word(c, SKIP_WORDS) and c not in protect]
    return replay(facts.df, steps)
