"""Every query of the library over the driver's tables, with the SQL it must agree with."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

_QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
_SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Register a query under ``name``; ``sql`` is the DuckDB text for the same rows."""

    def wrap(fn):
        _QUERIES[name] = fn
        if sql:
            _SQL[name] = sql
        return fn

    return wrap


def _load() -> None:
    from seriesmith.queries import chain_sql, files, more, pictures, relations, scoring, text, variants  # noqa: F401

    _SQL.update(chain_sql.ORACLES)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    _load()
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    _load()
    return dict(_SQL)


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    return queries()["funnel_of_repairs"](spark, sf_dir)
