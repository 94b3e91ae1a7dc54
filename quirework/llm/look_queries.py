"""Queries of problem 2."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quirework.llm.looks import normalized, print_classes, same_print
from quirework.sources.tables import table


def _entries(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "label_charsets").select("charset_id", F.posexplode("charset").alias("pos", "entry"))


def _both(spark: SparkSession, d: str, found: Callable[[DataFrame, bool], DataFrame]) -> DataFrame:
    texts = table(spark, d, "label_records").select(F.lit(0).alias("owner"), F.col("record_id").alias("item"), F.col("label.text").alias("text"))
    entries = _entries(spark, d).select(F.col("charset_id").alias("owner"), F.col("pos").alias("item"), F.col("entry").alias("text"))
    return found(texts, False).withColumn("place", F.lit("text")).unionByName(found(entries, True).withColumn("place", F.lit("charset")))


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    return _both(spark, d, same_print).select("place", "owner", "item_a", "item_b")


def p2_classes(spark: SparkSession, d: str) -> DataFrame:
    """One row an item, with its class of equal print and how many items of it are spelled differently."""
    return _both(spark, d, print_classes).select("place", "owner", "item", "class", "spellings", "links")


def p2_texts(spark: SparkSession, d: str) -> DataFrame:
    texts = table(spark, d, "label_records").select("record_id", F.col("label.text").alias("text"))
    return normalized(texts, "record_id", "text").dropDuplicates(["record_id"])


def p2_charsets(spark: SparkSession, d: str) -> DataFrame:
    """The consistent entries of each charset, each once, in the order of their first places."""
    forms = normalized(_entries(spark, d).select(F.struct("charset_id", "pos").alias("at"), "entry"), "at", "entry")
    kept = forms.where("form <> ''").groupBy("at.charset_id", "form").agg(F.min("at.pos").alias("pos"))
    return kept.groupBy("charset_id").agg(F.array_sort(F.collect_list(F.struct("pos", "form"))).alias("x")).select("charset_id", F.expr("transform(x, e -> e.form)").alias("charset"))


QUERIES = {f.__name__: f for f in (p2_found, p2_classes, p2_texts, p2_charsets)}
