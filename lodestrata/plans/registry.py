"""All core queries and their SQL twins."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from lodestrata.plans import catalog_queries, graph_queries, source_queries, text_queries, training

MODULES = [training, graph_queries, text_queries, catalog_queries, source_queries]


def queries() -> dict:
    return {k: v for m in MODULES for k, v in m.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {k: v for m in MODULES for k, v in m.SQL.items()}


def flagship(spark: SparkSession, d: str) -> DataFrame:
    return queries()["hybrid_search"](spark, d)
