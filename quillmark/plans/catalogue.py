"""All queries of the retrieval operators on the driver's tables, with their SQL twins."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import entity_queries, eval_queries, graph_queries, report_queries, search_queries, stage_queries

MODULES = (search_queries, graph_queries, eval_queries, report_queries, stage_queries, entity_queries)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: f for m in MODULES for name, f in m.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for m in MODULES for name, sql in m.SQL.items()}
