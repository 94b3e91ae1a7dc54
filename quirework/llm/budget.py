"""Exact token totals per slice without encoding any text twice (problem 3).

The tokenizer's file is read for what it does to texts: byte-level files have no normalization, and one that has is refused (bpe.py). Texts are pre-split into units whose tokens do not depend on what surrounds them. Each distinct unit of the collection is
encoded once; its length is joined with how often the units occur in each slice, which is aggregated before any shuffle.

Defined results: a record counts once in a slice, also if it is delivered or sampled several times there; of a repeated
sample_id the first delivered row counts (ties: the smallest values); samples of records that were not delivered are left out; null slices are
slices of their own; records with null or empty text count as records with 0 tokens. Languages are compared in lower case
by their first subtag ('FR', 'fr-CH' and ' fr' are 'fr').
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quirework.llm.bpe import tokenizer
from quirework.session import staged


def language(c: Column) -> Column:
    x = F.lower(F.trim(F.regexp_replace(c, "[-_].*$", "")))
    return F.when(x != "", x)


def first_delivered(samples: DataFrame, keys: list[str]) -> DataFrame:
    """One row for each sample_id, the one that came first."""
    first = F.min_by(F.struct(*keys), F.struct("loaded_at", *keys))
    return samples.groupBy("sample_id").agg(first.alias("s")).select("s.*")


def unit_counts(texts: DataFrame, path: str = "") -> DataFrame:
    """(slices, text) to (slices, unit, n): how often each unit occurs in the texts of equal slices; summed per Arrow batch before anything is sent."""
    kind = texts.schema["slices"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        units = tokenizer(path).units
        for batch in batches:
            counts: dict[tuple, Counter] = {}
            for s, t in zip(batch.column(0).to_pylist(), batch.column(1)):
                text = t.as_py()
                if text:
                    counts.setdefault(tuple(s), Counter()).update(units(text))
            for s, c in counts.items():
                slices = pa.array([list(s)] * len(c), batch.schema.field(0).type)
                yield pa.RecordBatch.from_arrays([slices, pa.array(list(c), pa.string()), pa.array(list(c.values()), pa.int64())], ["slices", "unit", "n"])

    return texts.select("slices", "text").mapInArrow(run, f"slices {kind}, unit string, n bigint")


def unit_lengths(units: DataFrame, path: str = "") -> DataFrame:
    """unit and its number of tokens."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = tokenizer(path).count
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([count(u.as_py()) for u in batch.column(0)], pa.int64())], ["unit", "length"])

    return units.select("unit").mapInArrow(run, "unit string, length bigint")


def token_budget(records: DataFrame, samples: DataFrame, by: list[str], path: str = "") -> DataFrame:
    """Columns of `by` (of samples), n_records, n_tokens. records: record_id, text; samples: sample_id, record_id, loaded_at and `by`."""
    kept = first_delivered(samples.select("sample_id", "loaded_at", "record_id", *by), ["record_id", *by])
    if "lang" in by:
        kept = kept.withColumn("lang", language(F.col("lang")))
    slice_id = F.xxhash64(F.to_json(F.struct(*by), {"ignoreNullFields": "false"}))
    kept = kept.where("record_id is not null").withColumn("slice", slice_id)
    named = kept.groupBy("record_id").agg(F.collect_set(F.struct("slice", *by)).alias("of"))
    texts = records.groupBy("record_id").agg(F.first("text").alias("text")).join(named, "record_id")
    slices = texts.select(F.explode("of").alias("s")).groupBy("s.slice", *(f"s.{c}" for c in by)).agg(F.count("*").alias("n_records"))
    counts = unit_counts(texts.select(F.transform("of", lambda s: s["slice"]).alias("slices"), "text"), path)
    freq = staged(counts.select(F.explode("slices").alias("slice"), "unit", "n").groupBy("unit", "slice").agg(F.sum("n").alias("n")), "units")
    lengths = unit_lengths(freq.select("unit").distinct(), path)
    tokens = freq.join(staged(lengths, "lengths"), "unit").groupBy("slice").agg(F.sum(F.col("n") * F.col("length")).alias("n_tokens"))
    return slices.join(tokens, "slice", "left").select(*by, "n_records", F.coalesce("n_tokens", F.lit(0)).alias("n_tokens"))
