"""SQL text for column facts, so the oracle can repeat the rules on the same tables."""

from __future__ import annotations

from tablecare.functions.columns import PRICE_WORDS, has_word, sentinels_for

LINEITEM = {
    "l_orderkey": "numeric", "l_partkey": "numeric", "l_suppkey": "numeric", "l_linenumber": "numeric",
    "l_quantity": "numeric", "l_extendedprice": "numeric", "l_discount": "numeric", "l_tax": "numeric",
    "l_returnflag": "text", "l_linestatus": "text", "l_shipdate": "datetime",
}
DIRTY = {
    "l_orderkey": "numeric", "l_linenumber": "numeric", "l_partkey": "numeric", "category": "text",
    "discount": "numeric", "tax": "numeric", "sparse_tax": "numeric", "stock_qty": "numeric", "price": "numeric",
    "constant_col": "numeric", "empty_col": "numeric", "l_shipdate": "datetime",
}
ORDERS = {
    "o_orderkey": "numeric", "o_custkey": "numeric", "o_orderstatus": "text", "o_totalprice": "numeric",
    "o_orderdate": "datetime", "o_orderpriority": "text",
}
CUSTOMER = {
    "c_custkey": "numeric", "c_name": "text", "c_nationkey": "numeric", "c_acctbal": "numeric", "c_mktsegment": "text",
}


def facts_sql(view: str, cols: dict[str, str]) -> str:
    """One row per column: at, column, kind, rows, missing, distinct, outliers, sentinels, negatives, std, skew."""
    rows = []
    for at, (c, kind) in enumerate(cols.items()):
        if kind == "numeric":
            price = has_word(c, PRICE_WORDS)
            sent = ",".join(str(s) for s in sentinels_for(c))
            more = (f"count_if({c} < q1 - 1.5 * (q3 - q1) OR {c} > q3 + 1.5 * (q3 - q1)) AS outliers, "
                    f"count_if(coalesce({c} IN ({sent}), false)) AS sentinels, "
                    f"{f'count_if({c} < 0)' if price else '0'} AS negatives, "
                    f"stddev_samp({c}) AS std, skewness({c}) AS skew")
            source = (f"{view}, (SELECT quantile_cont({c}::DOUBLE, 0.25) AS q1, quantile_cont({c}::DOUBLE, 0.75) AS q3 "
                      f"FROM {view}) q")
        else:
            more = "0 AS outliers, 0 AS sentinels, 0 AS negatives, NULL AS std, NULL AS skew"
            source = view
        rows.append(f"SELECT {at} AS at, '{c}' AS \"column\", '{kind}' AS kind, count(*) AS n_rows, "
                    f"count(*) - count({c}) AS missing, count(DISTINCT {c}) AS n_distinct, {more} FROM {source}")
    return "\nUNION ALL ".join(rows)


def duplicates_sql(view: str) -> str:
    return f"SELECT (SELECT count(*) FROM {view}) - (SELECT count(*) FROM (SELECT DISTINCT * FROM {view})) AS dups"


def totals_sql() -> str:
    """One row from ``facts`` and ``dup``: shares and counts over the whole table."""
    return """
SELECT max(n_rows) AS n_rows, count(*) AS n_cols, sum(missing) AS missing_cells,
       sum(missing)::DOUBLE / (max(n_rows) * count(*)) AS missing_share,
       (SELECT dups FROM dup)::DOUBLE / max(n_rows) AS duplicate_share, (SELECT dups FROM dup) AS dups,
       coalesce(sum(outliers)::DOUBLE / nullif(max(n_rows) * count_if(kind = 'numeric'), 0), 0) AS outlier_share,
       count_if(sentinels > 0) AS n_sentinel, count_if(negatives > 0) AS n_negative,
       count_if(n_distinct = 1) AS n_constant, count_if(missing = n_rows) AS n_empty,
       count_if(kind = 'numeric') AS n_numeric, count_if(kind = 'text') AS n_text,
       count_if(kind = 'text' AND n_distinct > 20) AS n_wide,
       max(missing::DOUBLE / n_rows) AS worst_missing
FROM facts"""
