"""All queries of the engine's own operators, and the SQL that each is held against."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from theoremill.plans import queries_graph, queries_learning, queries_sources, queries_trees

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}
for module in (queries_graph, queries_trees, queries_learning, queries_sources):
    QUERIES.update(module.Q)
    SQL.update(module.SQL)
