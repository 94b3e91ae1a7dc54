"""Readers of corpora: line files, entity files, XML letters, text collections; and a sink of labels."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quirework.functions.text import corpus_clean, tighten

#: A letter's XML page: a source and boxes with corners, type and text.
LETTER_XML = "source string, box array<struct<_top_left_x:int,_top_left_y:int,_bottom_right_x:int,_bottom_right_y:int,type:string,text:string>>"


def parse_lines(lines: DataFrame) -> DataFrame:
    """line_id, page_id, box, text of a list of lines (value): comments and blanks aside, fields by spaces, words from the ninth field on joined by pipes."""
    x = lines.where(~F.col("value").startswith("#") & (F.trim("value") != "")).select(F.split("value", " ").alias("f"))
    at = lambda i: F.try_element_at("f", F.lit(i)).try_cast("int")
    box = F.struct(at(5).alias("l"), at(6).alias("t"), (at(5) + at(7)).alias("r"), (at(6) + at(8)).alias("b"))
    name = F.col("f")[0]
    return x.select(name.alias("line_id"), F.substring_index(name, "-", 2).alias("page_id"), box.alias("box"), tighten(F.array_join(F.slice("f", 9, F.greatest(F.size("f"), F.lit(1))), " ")).alias("text"))


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    return parse_lines(spark.read.text(path))


def parse_entities(lines: DataFrame) -> DataFrame:
    """word_id, tag of lines 'word_id tag' (value)."""
    x = lines.where(F.trim("value") != "").select(F.split(F.trim("value"), " +").alias("f"))
    return x.select(F.col("f")[0].alias("word_id"), F.try_element_at("f", F.lit(2)).alias("tag"))


def parse_letters(pages: DataFrame) -> DataFrame:
    """source, pos, type, text and box of each box of the XML letters (value), one a row."""
    y = pages.select(F.from_xml("value", LETTER_XML, {"ignoreSurroundingSpaces": "false"}).alias("x")).select("x.source", F.posexplode("x.box").alias("pos", "b"))
    return y.select("source", "pos", "b.type", "b.text", F.col("b._top_left_x").alias("l"), F.col("b._top_left_y").alias("t"), F.col("b._bottom_right_x").alias("r"), F.col("b._bottom_right_y").alias("b"))


def read_letters(spark: SparkSession, path: str) -> DataFrame:
    """The same of a folder of XML files, one letter each."""
    return parse_letters(spark.read.text(path, wholetext=True))


def corpus(docs: DataFrame, sources: list[str] | None = None) -> DataFrame:
    """doc_id, source, text: cleaned texts, of some sources only."""
    x = docs.where("text is not null").select("doc_id", F.coalesce("source", F.lit("none")).alias("source"), corpus_clean(F.col("text")).alias("text"))
    return x if sources is None else x.where(F.col("source").isin(sources))


def samples_of(records: DataFrame, existing: DataFrame, ner: str = "IAM_NER") -> DataFrame:
    """Runtime samples of records whose file exists (left-semi on record_id): name, label, data set, split; training rows of the given data set once more as entity copies."""
    x = records.join(existing.select("record_id").distinct(), "record_id", "left_semi")
    x = x.select("record_id", F.concat_ws("/", "dataset", "split", "filename").alias("name"), "split", "dataset", F.col("text").alias("label"), F.lit(False).alias("added"))
    return x.unionByName(x.where((F.col("split") == "train") & (F.col("dataset") == ner)).withColumn("dataset", F.concat("dataset", F.lit("-ner"))).withColumn("added", F.lit(True)))


def write_labels(df: DataFrame, path: str) -> None:
    """Labels as JSON, a folder for each split."""
    df.write.partitionBy("split").json(path)
