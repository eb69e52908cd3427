"""Where the query modules register."""

from __future__ import annotations

from collections.abc import Callable
from importlib import import_module

from pyspark.sql import DataFrame, SparkSession

from .views import Views

_QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
_SQL: dict[str, str] = {}
_MODULES = ("report_queries", "station_queries", "series_queries", "fill_queries", "score_queries")


def query(name: str, sql: str | None = None):
    """Register ``build(views)`` under ``name``, with its SQL equivalent where there is one."""

    def register(build: Callable[[Views], DataFrame]):
        if name in _QUERIES:
            raise ValueError(f"query {name} registered twice")
        _QUERIES[name] = lambda spark, sf_dir: build(Views(spark, sf_dir))
        if sql is not None:
            _SQL[name] = sql
        return build

    return register


def _load() -> None:
    for module in _MODULES:
        import_module(f"{__package__}.{module}")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    _load()
    return dict(_QUERIES)


def sql_texts() -> dict[str, str]:
    _load()
    return dict(_SQL)
