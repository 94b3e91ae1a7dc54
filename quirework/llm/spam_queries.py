"""Queries of problem 9."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from quirework.llm.spam import scored, stuffed_pages
from quirework.sources.tables import table


def p9_found(spark: SparkSession, d: str) -> DataFrame:
    return stuffed_pages(table(spark, d, "documents"))


def p9_scores(spark: SparkSession, d: str) -> DataFrame:
    return scored(table(spark, d, "documents"))


QUERIES = {f.__name__: f for f in (p9_found, p9_scores)}
