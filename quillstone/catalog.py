"""The query catalogue: one entry for each operator, with its SQL oracle where SQL can express it."""

from __future__ import annotations

import importlib
import pkgutil
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]

_QUERIES: dict[str, Query] = {}
_SQL: dict[str, str] = {}


class Tables:
    """The tables of a folder; a table is read when it is asked for."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder

    def __getattr__(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/{name}.parquet")


def query(sql: str | None = None) -> Callable[[Callable[[Tables], DataFrame]], Callable[[Tables], DataFrame]]:
    """Register a function of the tables under its name, with the SQL that gives the same rows."""

    def register(f: Callable[[Tables], DataFrame]) -> Callable[[Tables], DataFrame]:
        if f.__name__ in _QUERIES:
            raise ValueError(f"two queries are named {f.__name__}")
        _QUERIES[f.__name__] = lambda spark, folder: f(Tables(spark, folder))
        if sql:
            _SQL[f.__name__] = sql
        return f

    return register


def sql_of(f: Callable[[Tables], DataFrame]) -> str:
    """The SQL of a query that is registered already, for another that has to give the same rows."""
    return _SQL[f.__name__]


def _load() -> None:
    from . import plans

    for module in pkgutil.iter_modules(plans.__path__):
        importlib.import_module(f"{plans.__name__}.{module.name}")


def queries() -> dict[str, Query]:
    _load()
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    _load()
    return dict(_SQL)
