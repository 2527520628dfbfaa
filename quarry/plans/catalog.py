"""Registry of runnable jobs: name -> (Spark builder, DuckDB oracle SQL or None).

Each builder takes ``(spark, sf_dir)`` and returns a lazy DataFrame that reads whole
driver tables. Column names are aliased identically in the Spark job and the SQL.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from ..sources.fixtures import duckdb_with

Builder = Callable[[SparkSession, str], DataFrame]

_QUERIES: dict[str, Builder] = {}
_ORACLES: dict[str, str] = {}


def register(name: str, oracle: str | None = None, views: list[str] | None = None):
    """Decorator: register ``fn(spark, sf_dir) -> DataFrame`` under ``name``.

    ``oracle`` is the DuckDB SQL body; ``views`` lists fixture views it needs, inlined as CTEs.
    """
    def deco(fn: Builder) -> Builder:
        if name in _QUERIES:
            raise ValueError(f"duplicate query {name}")
        _QUERIES[name] = fn
        if oracle is not None:
            _ORACLES[name] = duckdb_with(views or [], oracle.strip())
        return fn
    return deco


def _load_all() -> None:
    # Import for side effects: each module registers its jobs.
    from . import files, links, changes, events, webhooks, registry, audit, privacy, streams  # noqa: F401


def queries() -> dict[str, Builder]:
    _load_all()
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    _load_all()
    return dict(_ORACLES)
