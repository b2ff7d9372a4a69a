"""Run queries beside their DuckDB SQL and compare names, row counts and values.

Usage: [COMPARE_CONF=key=value,...] python -m tests.compare [sf dir] [name prefix ...]
"""

from __future__ import annotations

import datetime
import decimal
import math
import os
import sys
import time
import traceback

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages "
          "benchmark labels conversations").split()


def connect(folder: str):
    import duckdb

    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{folder}/{t}.parquet')")
    return con


def norm(v):
    if v is None:
        return "null"
    if isinstance(v, bool):
        return f"bool:{v}"
    if isinstance(v, float):
        return "null" if math.isnan(v) else f"float:{v!r}"
    if isinstance(v, int):
        return f"int:{v}"
    if isinstance(v, decimal.Decimal):
        return f"decimal:{v}"
    if isinstance(v, datetime.datetime):
        return f"time:{v.replace(tzinfo=None).isoformat()}"
    if isinstance(v, (list, tuple)):
        return "[" + ",".join(norm(x) for x in v) + "]"
    return f"{type(v).__name__}:{v}"


def rows_of(names, rows):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted("|".join(norm(r[i]) for i in order) for r in rows)


def compare(spark, con, folder, fn, sql):
    df = fn(spark, folder)
    names = list(df.columns)
    got = rows_of(names, [tuple(r) for r in df.collect()])
    if sql is None:
        return ("rows", len(got), "") if got else ("EMPTY", 0, "")
    cur = con.execute(sql)
    want_names = [d[0] for d in cur.description]
    want = rows_of(want_names, cur.fetchall())
    if sorted(names) != sorted(want_names):
        return "NAMES", len(got), f"{sorted(names)} / {sorted(want_names)}"
    if len(got) != len(want):
        return "COUNT", len(got), f"{len(got)} / {len(want)}"
    bad = [(a, b) for a, b in zip(got, want) if a != b]
    if bad:
        only_got = sorted(set(got) - set(want))[:3]
        only_want = sorted(set(want) - set(got))[:3]
        return "VALUES", len(got), f"{len(bad)} differ\n   {sorted(names)}\n   got  {only_got}\n   want {only_want}"
    return "ok", len(got), ""


def main(argv):
    import __spark_entry__ as entry
    from tablecare.session import get_spark

    folder = argv[0] if argv else "/root/testdata/sf0.01"
    prefixes = argv[1:]
    spark = get_spark("compare", "local[8]", **{
        "spark.sql.shuffle.partitions": "8", "spark.driver.memory": "12g",
        "spark.ui.showConsoleProgress": "false",
        **dict(kv.split("=", 1) for kv in os.environ.get("COMPARE_CONF", "").split(",") if kv)})
    spark.sparkContext.setLogLevel("ERROR")
    con = connect(folder)
    queries, oracles = entry.queries(), entry.oracle_sql()
    failed = []
    for name, fn in queries.items():
        if prefixes and not any(name.startswith(p) for p in prefixes):
            continue
        began = time.time()
        try:
            state, n, note = compare(spark, con, folder, fn, oracles.get(name))
        except Exception as e:  # noqa: BLE001 - report and go on to the next query
            state, n, note = "ERROR", 0, "".join(traceback.format_exception_only(e))[:1500]
        if state not in ("ok", "rows"):
            failed.append(name)
        print(f"{state:7} {name:28} {n:7} rows {time.time() - began:6.2f}s {note}", flush=True)
    print(f"failed: {failed}")
    spark.stop()
    return 1 if failed else 0


if __name__ == "__main__":
    sys.exit(main(sys.argv[1:]))
