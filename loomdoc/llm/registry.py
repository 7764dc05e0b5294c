"""Queries of the training-data operators, one module each."""

from __future__ import annotations

import importlib
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

#: Modules with QUERY (a name), run(spark, sf_dir) and SQL (a string or None).
MODULES = [
    "url_filter",
    "licenses",
    "pii",
    "simhash",
    "decontaminate",
    "quality",
    "toxicity",
    "chat",
    "packing",
    "token_files",
    "prefix_trie",
    "token_counts",
    "filter_audit",
]


def _modules():
    return [importlib.import_module(f"loomdoc.llm.{m}") for m in MODULES]


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {m.QUERY: m.run for m in _modules()}


def oracle_sql() -> dict[str, str]:
    return {m.QUERY: m.SQL for m in _modules() if m.SQL}
