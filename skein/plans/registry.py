"""All queries of the engine by name, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from skein.plans import q_graph, q_items, q_text

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = q_text.QUERIES | q_items.QUERIES | q_graph.QUERIES
SQL: dict[str, str] = q_text.SQL | q_items.SQL | q_graph.SQL
