"""Registration of queries: a Spark callable and, where SQL can express it, the same result in SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from auditkit.plans.sqlviews import with_ctes
from auditkit.plans.views import Views

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
_SQL: dict[str, tuple[tuple[str, ...], str]] = {}


def query(name: str, sql: str | None = None, ctes: tuple[str, ...] = ()):
    """Register ``fn(views) -> DataFrame`` under ``name``."""

    def wrap(fn: Callable[[Views], DataFrame]):
        QUERIES[name] = lambda spark, sf_dir: fn(Views(spark, sf_dir))
        if sql is not None:
            _SQL[name] = (ctes, sql)
        return fn

    return wrap


def oracles() -> dict[str, str]:
    """The statements, composed once every view is known."""
    return {name: with_ctes(ctes, sql) for name, (ctes, sql) in _SQL.items()}
