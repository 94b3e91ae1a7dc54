"""Page descriptions: PAGE-XML of registers, XML letters with their repairs and splits."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quirework.functions.arrays import box_of
from quirework.functions.text import annotation_repair, first_alternative, text_label_clean
from quirework.sources.corpora import parse_letters

_LINE = "struct<_id:string,Coords:struct<_points:string>,Baseline:struct<_points:string>,TextEquiv:struct<Unicode:string>>"
_REGION = f"struct<_id:string,Coords:struct<_points:string>,TextLine:array<{_LINE}>>"
PAGE_XML = f"Page array<struct<_imageFilename:string,_imageWidth:int,_imageHeight:int,TextRegion:array<{_REGION}>>>"


def parse_page_xml(pages: DataFrame, fixes: dict[str, str] | None = None) -> DataFrame:
    """file, page_no, image, page_width, page_height, pos, region_id, label, coords, base (box of the lines' base lines) and lines of every region of PAGE-XML documents (file, value).

    Lines without text are left out, but for those that `fixes` (line id to text) gives one; regions without lines are left out. Lines keep their order; a line without
    base line has its outline for one. Name spaces are ignored. A document that cannot be parsed has no rows."""
    plain = F.regexp_replace("value", r"<(/?)[A-Za-z0-9]+:", "<$1")
    x = pages.select("file", F.from_xml(plain, PAGE_XML, {"ignoreSurroundingSpaces": "false"}).alias("x")).select("file", F.posexplode("x.Page").alias("page_no", "p"))
    x = x.select("file", "page_no", F.col("p._imageFilename").alias("image"), F.col("p._imageWidth").alias("page_width"), F.col("p._imageHeight").alias("page_height"), F.posexplode("p.TextRegion").alias("pos", "r"))
    fixed = F.create_map(*(F.lit(v) for kv in (fixes or {"": ""}).items() for v in kv))

    def line(t: Column) -> Column:
        text = F.coalesce(F.try_element_at(fixed, F.coalesce(t["_id"], F.lit("-"))), F.nullif(t["TextEquiv"]["Unicode"], F.lit("")))
        outline = t["Coords"]["_points"]
        return F.struct(t["_id"].alias("id"), text_label_clean(text).alias("text"), box_of(outline).alias("coords"), box_of(F.coalesce(t["Baseline"]["_points"], outline)).alias("base"))

    lines = F.filter(F.transform("r.TextLine", line), lambda t: t["text"].isNotNull())
    x = x.select("file", "page_no", "image", "page_width", "page_height", "pos", F.col("r._id").alias("region_id"), box_of(F.col("r.Coords._points")).alias("coords"), lines.alias("lines")).where("size(lines) > 0")
    over = lambda f, k: f(F.transform("lines", lambda t: t["base"][k])).alias(k)
    base = F.struct(over(F.array_min, "l"), over(F.array_min, "t"), over(F.array_max, "r"), over(F.array_max, "b"))
    label = text_label_clean(F.array_join(F.transform("lines", lambda t: t["text"]), "\n"))
    return x.select("file", "page_no", "image", "page_width", "page_height", "pos", "region_id", label.alias("label"), "coords", base.alias("base"), "lines")


def read_page_xml(spark: SparkSession, path: str, fixes: dict[str, str] | None = None) -> DataFrame:
    files = spark.read.text(path, wholetext=True).select(F.element_at(F.split(F.input_file_name(), "/"), -1).alias("file"), "value")
    return parse_page_xml(files, fixes)


def clean_letters(boxes: DataFrame, replaced: dict[str, str] | None = None) -> DataFrame:
    """Boxes of parse_letters with their text repaired, their alternatives resolved and their spaces cleaned; boxes without text are left out.

    replaced: texts of boxes to be taken for others, as a whole, before anything else."""
    text = F.col("text")
    if replaced:
        text = F.coalesce(F.try_element_at(F.create_map(*(F.lit(v) for kv in replaced.items() for v in kv)), text), text)
    return boxes.where(F.trim("text") != "").withColumn("text", text_label_clean(first_alternative(annotation_repair(text))))


def letters(pages: DataFrame, replaced: dict[str, str] | None = None) -> DataFrame:
    """The cleaned boxes of XML letters (value)."""
    return clean_letters(parse_letters(pages), replaced)
