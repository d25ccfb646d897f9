"""All queries by name, with their SQL where SQL can express them."""

from __future__ import annotations

import importlib
import textwrap
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]

MODULES = ("transcripts", "search", "captions", "beats", "timeline", "media", "music", "audio", "colour", "tools", "relations")

_QUERIES: dict[str, Query] = {}
_SQL: dict[str, str] = {}


def query(sql: str | None = None, name: str | None = None) -> Callable[[Query], Query]:
    """Register a query under its function's name; sql is what DuckDB runs on the same tables."""

    def register(fn: Query) -> Query:
        key = name or fn.__name__
        _QUERIES[key] = fn
        if sql:
            _SQL[key] = textwrap.dedent(sql).strip()
        return fn

    return register


def _load() -> None:
    for m in MODULES:
        importlib.import_module(f"{__package__}.{m}")


def queries() -> dict[str, Query]:
    _load()
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    _load()
    return dict(_SQL)
