"""Named queries, each with the SQL that must give the same rows."""

from __future__ import annotations

from collections.abc import Callable

QUERIES: dict[str, Callable] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Register a query; leave ``sql`` out where no SQL can state the operator."""

    def keep(fn):
        if name in QUERIES:
            raise ValueError(f"query {name} is registered twice")
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql.strip()
        return fn

    return keep


def with_views(sql: str, **views: str) -> str:
    """Prefix SQL with common table expressions."""
    heads = ",\n".join(f"{name} AS ({text.strip()})" for name, text in views.items())
    return f"WITH {heads}\n{sql.strip()}"
