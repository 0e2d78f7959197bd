"""The registered queries of this package and the SQL of those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from cliploom.llm import queries_lexical, queries_tables, queries_text, sql


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return queries_text.QUERIES | queries_tables.QUERIES | queries_lexical.QUERIES


def oracle_sql() -> dict[str, str]:
    return dict(sql.CHECKS)
