"""Every operator as a named query over the given tables.

A query is a function (spark, sf_dir) -> DataFrame. Its docstring says what it
shows; the SQL given with it computes the same rows elsewhere.
"""

from __future__ import annotations

import importlib
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    """Register a function under its name, with its SQL where there is one."""

    def register(function: Query) -> Query:
        QUERIES[function.__name__] = function
        if sql is not None:
            ORACLES[function.__name__] = sql
        return function

    return register


for _theme in ("indicators", "features", "tables", "quality", "texts"):
    importlib.import_module(f"{__name__}.{_theme}")
