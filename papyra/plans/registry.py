"""All queries by name, and the SQL that states the same."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import data_queries, model_queries, text_queries, tree_queries, value_queries

_FAMILIES = (data_queries, text_queries, tree_queries, value_queries, model_queries)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for family in _FAMILIES for f in family.QUERIES}


def oracle_sql() -> dict[str, str]:
    return {name: sql for family in _FAMILIES for name, sql in family.SQL.items()}
