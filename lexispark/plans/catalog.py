"""Every query of the library, by name, with its SQL for DuckDB where SQL can express it."""

from __future__ import annotations

from collections.abc import Callable

QUERIES: dict[str, Callable] = {}
ORACLES: dict[str, str] = {}


def register(name: str, sql: str | None = None):
    """Decorator for query(spark, sf_dir)."""

    def put(f: Callable) -> Callable:
        QUERIES[name] = f
        if sql:
            ORACLES[name] = sql
        return f

    return put


from . import maintenance_queries, search_queries, text_queries, vector_queries  # noqa: E402, F401  registers all
