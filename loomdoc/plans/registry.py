"""Named queries and the SQL that defines their results.

Operator modules call :func:`query`; ``loomdoc.plans`` imports them all.
"""

from __future__ import annotations

import importlib
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]

#: Modules that register queries on import.
MODULES = ["contributors", "versions", "lines", "html", "index", "misc", "grammar", "manuals", "corpus", "page_passes", "menus", "heads", "files"]

_QUERIES: dict[str, Query] = {}
_SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    """Register a function (spark, sf_dir) -> DataFrame, with its oracle where SQL has one."""

    def add(f: Query) -> Query:
        if name in _QUERIES:
            raise ValueError(f"query {name} is registered twice")
        _QUERIES[name] = f
        if sql is not None:
            _SQL[name] = sql
        return f

    return add


def _import_all() -> None:
    for module in MODULES:
        importlib.import_module(f"loomdoc.plans.{module}")


def queries() -> dict[str, Query]:
    _import_all()
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    _import_all()
    return dict(_SQL)
