"""Queries over the test tables, each with the SQL that must give the same rows."""

from __future__ import annotations

import importlib
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

_MODULES = ["dates", "people", "works", "pages", "harvest", "files"]

Query = Callable[[SparkSession, str], DataFrame]


def all_queries() -> dict[str, Query]:
    return {k: v for m in _MODULES for k, v in importlib.import_module(f"checks.{m}").QUERIES.items()}


def all_oracles() -> dict[str, str]:
    return {k: v for m in _MODULES for k, v in importlib.import_module(f"checks.{m}").ORACLE.items()}
