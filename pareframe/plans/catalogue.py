"""All queries of the engine by name, with their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from pareframe.plans import graphs, relations, reports, searches, texts, trees

ALL = searches.QUERIES | graphs.QUERIES | trees.QUERIES | relations.QUERIES | reports.QUERIES | texts.QUERIES


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: query for name, (query, _) in ALL.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for name, (_, sql) in ALL.items() if sql}
