"""Queries of problem 4."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quirework.llm.budget import first_delivered
from quirework.llm.overlap import coverage, cross_split_classes, cross_split_pairs, spans
from quirework.sources.tables import table


def _pairs(spark: SparkSession, d: str) -> DataFrame:
    return cross_split_pairs(_records(spark, d))


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    p = _pairs(spark, d)
    return p.select(F.least("train_id", "eval_id").alias("record_a"), F.greatest("train_id", "eval_id").alias("record_b")).dropDuplicates()


def _records(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "label_records").select("record_id", "split", F.col("label.text").alias("text"))


def p4_classes(spark: SparkSession, d: str) -> DataFrame:
    """One row for each record, with its class of equal texts and how many classes of the other side are the same or nearly so."""
    return cross_split_classes(_records(spark, d))


def p4_spans(spark: SparkSession, d: str) -> DataFrame:
    """What the texts of each pair of classes have in common: chained seeds, gaps aligned."""
    return spans(_records(spark, d))


def p4_coverage(spark: SparkSession, d: str) -> DataFrame:
    """Per evaluation split and source: records, their characters, and how many of these stand in stretches that train has anywhere."""
    x = coverage(_records(spark, d)).join(_sources(spark, d), "record_id", "left")
    per = x.groupBy("split", "source").agg(F.count("*").alias("n_records"), F.sum("length").alias("n_chars"), F.sum("covered").alias("covered"))
    return per.withColumn("share", F.round(F.col("covered") / F.nullif(F.col("n_chars"), F.lit(0)), 6))


def _sources(spark: SparkSession, d: str) -> DataFrame:
    """record_id, source, each once."""
    kept = first_delivered(table(spark, d, "samples").select("sample_id", "loaded_at", "record_id", "source"), ["record_id", "source"])
    return kept.where("record_id is not null").distinct()


def p4_report(spark: SparkSession, d: str) -> DataFrame:
    """Per evaluation split and source of its samples: records altogether and those that train has (nearly), their pairs, and the share of their characters that train keeps at best."""
    records = _records(spark, d)
    sources = _sources(spark, d)
    pairs = cross_split_pairs(records).groupBy("eval_id").agg(F.count("*").alias("pairs"), F.max(1 - F.col("edits") / F.col("length")).alias("kept"))
    every = records.where("split in ('valid', 'test')").select("record_id", F.col("split").alias("eval_split")).distinct().join(sources, "record_id", "left")
    x = every.join(pairs.withColumnRenamed("eval_id", "record_id"), "record_id", "left")
    return x.groupBy("eval_split", "source").agg(
        F.count("*").alias("n_records"), F.count("pairs").alias("n_overlapping"), F.coalesce(F.sum("pairs"), F.lit(0)).alias("n_pairs"), F.round(F.avg("kept"), 6).alias("mean_kept")
    )


QUERIES = {f.__name__: f for f in (p4_found, p4_report, p4_classes, p4_coverage, p4_spans)}
