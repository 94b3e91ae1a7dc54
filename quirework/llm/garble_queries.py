"""Queries of problem 5."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quirework.llm.garble import garbled, restored
from quirework.sources.tables import table


def _texts(spark: SparkSession, d: str) -> DataFrame:
    records = table(spark, d, "label_records").select(F.lit("label_records").alias("place"), F.col("record_id").alias("item_id"), F.col("label.text").alias("text"))
    regions = table(spark, d, "text_regions").select(F.lit("text_regions").alias("place"), F.col("region_id").alias("item_id"), F.col("label").alias("text"))
    return records.unionByName(regions)


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    return garbled(_texts(spark, d)).select("place", "item_id").dropDuplicates()


def p5_restored(spark: SparkSession, d: str) -> DataFrame:
    return restored(_texts(spark, d))


def p5_words(spark: SparkSession, d: str) -> DataFrame:
    """Garbled words with their originals, how they were found, and how many items hold them."""
    x = garbled(_texts(spark, d)).groupBy("word").agg(F.first("original").alias("original"), F.first("way").alias("way"), F.count("*").alias("items"))
    return x.select("word", "original", "way", "items")


QUERIES = {f.__name__: f for f in (p5_found, p5_restored, p5_words)}
