"""The registered queries and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

_queries: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
_oracles: dict[str, str] = {}


def query(sql: str | None = None, name: str | None = None) -> Callable:
    """Register a (spark, sf_dir) function under its own name, with the SQL that gives the same rows."""

    def add(f: Callable[[SparkSession, str], DataFrame]) -> Callable:
        _queries[name or f.__name__] = f
        if sql:
            _oracles[name or f.__name__] = sql
        return f

    return add


def _load() -> None:
    from behaviorframe.plans import corpus_queries, evaluation_queries, generator_queries, probe_queries, split_queries, text_queries, vision_queries  # noqa: F401


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    _load()
    return dict(_queries)


def oracle_sql() -> dict[str, str]:
    _load()
    return dict(_oracles)
