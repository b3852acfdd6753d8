"""Where the modules of queries put them."""

from __future__ import annotations

import re
from collections.abc import Callable

QUERIES: dict[str, Callable] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None, name: str | None = None):
    """Register a function of (spark, sf_dir), with DuckDB SQL for its rows where that can be written."""

    def put(f: Callable) -> Callable:
        QUERIES[name or f.__name__] = f
        if sql:
            # Each step is made once, however many read it.
            ORACLE_SQL[name or f.__name__] = re.sub(r"\b(\w+) AS \((?=SELECT\b)", r"\1 AS MATERIALIZED (", sql)
        return f

    return put
