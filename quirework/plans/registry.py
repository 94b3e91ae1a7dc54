"""All queries outside the optional subpackage, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from quirework.plans import corpus_queries, entity_queries, evaluation_queries, layout_queries, nested_queries, synthesis_queries, text_queries

MODULES = [nested_queries, text_queries, layout_queries, corpus_queries, entity_queries, synthesis_queries, evaluation_queries]


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {k: v for m in MODULES for k, v in m.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {k: v for m in MODULES for k, v in getattr(m, "SQL", {}).items()}


def flagship(spark: SparkSession, folder: str) -> DataFrame:
    return layout_queries.flagship(spark, folder)
