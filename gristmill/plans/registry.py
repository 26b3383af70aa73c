"""All registered queries and their SQL twins."""

from __future__ import annotations

from collections.abc import Callable

_QUERIES: dict[str, Callable] = {}
_SQL: dict[str, str] = {}


def query(sql: str | None = None, name: str | None = None):
    """Register a query (spark, sf_dir) under its function's name, with DuckDB's form of it."""

    def keep(f: Callable) -> Callable:
        _QUERIES[name or f.__name__] = f
        if sql:
            _SQL[name or f.__name__] = sql
        return f

    return keep


def _load() -> None:
    from . import label_queries, metric_queries, sampling_queries, source_queries, text_queries, vector_queries  # noqa: F401


def queries() -> dict[str, Callable]:
    _load()
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    _load()
    return dict(_SQL)
