"""Query registry: name -> (Spark builder, DuckDB oracle SQL or None).

Plan modules register queries with `@query(name, sql)`; `__spark_entry__` exposes them.
Every registered query reads the given tables (or data Spark derives from them) in full.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Builder = Callable[[SparkSession, str], DataFrame]
_QUERIES: dict[str, Builder] = {}
_SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def deco(fn: Builder) -> Builder:
        if name in _QUERIES:
            raise ValueError(f"duplicate query {name}")
        _QUERIES[name] = fn
        if sql is not None:
            _SQL[name] = sql
        return fn
    return deco


def _load_all() -> None:
    from tabvet.plans import (  # noqa: F401
        q_infer, q_profile, q_validate, q_drift, q_evaluate, q_monitor, q_text, q_clean, q_features, q_train,
        q_sources, q_streaming, q_dataset, q_scores, q_explain, q_ranges,
    )


def queries() -> dict[str, Builder]:
    _load_all()
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    _load_all()
    return dict(_SQL)
