"""Inputs that the queries share, derived from the driver's tables, and the same as SQL.

regions: each region once. pairs: a region's label as truth, and as prediction the label with every character replaced by
'#' where (31 * region_id + 17 * position) mod 19 is 0. tagged: each record with text once, its text with layout markers as truth, and as
prediction the same without the characters at which (13 * record_id + 7 * position) mod 23 is 0 (markers fall away as well as letters).
words: the words of the tagged texts, without markers, in order; tag by their length.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quirework.functions.text import chars
from quirework.sources.tables import table

MARKS = "".join(chr(c) for c in range(0x24B6, 0x24EA))


def regions(spark: SparkSession, d: str) -> DataFrame:
    cols = ["region_id", "scan_id", "archive", "pos", "region_type", "label", "coords", "page_width", "lang"]
    return table(spark, d, "text_regions").select(*cols).dropDuplicates(["region_id"])


def _changed(s: Column, key: str, a: int, b: int, n: int, to: str) -> Column:
    return F.array_join(F.transform(chars(s), lambda c, i: F.when((F.col(key) * a + i * b) % n == 0, F.lit(to)).otherwise(c)), "")


def pairs(spark: SparkSession, d: str) -> DataFrame:
    r = regions(spark, d).where("label is not null")
    return r.select("region_id", "archive", F.coalesce("lang", F.lit("und")).alias("lang"), F.coalesce("region_type", F.lit("none")).alias("class"), F.col("label").alias("gt"), _changed(F.col("label"), "region_id", 31, 17, 19, "#").alias("pred"))


def records(spark: SparkSession, d: str) -> DataFrame:
    x = F.col("label")
    cols = ["record_id", "split", "filename", x["text"].alias("text"), x["nb_cols"].alias("nb_cols"), x["dataset"].alias("dataset"), x["paragraphs"].alias("paragraphs"), x["pages"].alias("pages")]
    return table(spark, d, "label_records").select(*cols).dropDuplicates(["record_id"])


def tagged(spark: SparkSession, d: str) -> DataFrame:
    r = records(spark, d).where("text is not null")
    return r.select("record_id", "split", F.coalesce("dataset", F.lit("none")).alias("dataset"), F.col("text").alias("gt"), _changed(F.col("text"), "record_id", 13, 7, 23, "").alias("pred"))


def words(spark: SparkSession, d: str) -> DataFrame:
    x = F.split(F.trim(F.regexp_replace(F.translate("gt", MARKS, ""), "[ \n]+", " ")), " ")
    w = tagged(spark, d).select("record_id", "dataset", F.posexplode(x).alias("pos", "word")).where("word <> ''")
    return w.withColumn("tag", F.when(F.char_length("word") % 4 == 0, F.lit("PER")).when(F.char_length("word") % 7 == 0, F.lit("LOC")).otherwise(F.lit("O")))


def sentences(spark: SparkSession, d: str) -> DataFrame:
    """Documents with one blank between words, and how many sentences they have."""
    s = F.trim(F.regexp_replace(F.regexp_replace("text", "\n", " "), " +", " "))
    return table(spark, d, "documents").where("text is not null").select("doc_id", F.coalesce("source", F.lit("none")).alias("source"), s.alias("text")).where("text <> ''").withColumn("n_sentences", F.size(F.split("text", r"\. ")))


def with_sql(body: str) -> str:
    """The SQL with the inputs that it names in front."""
    used = [k for k in _SQL if k in body]
    more = True
    while more:
        more = False
        for k in list(used):
            for other in _SQL:
                if other in _SQL[k] and other not in used:
                    used.append(other)
                    more = True
    ordered = [k for k in _SQL if k in used]
    return "WITH " + ", ".join(f"{k} AS ({_SQL[k]})" for k in ordered) + " " + body


def _sql_changed(s: str, key: str, a: int, b: int, n: int, to: str) -> str:
    return f"array_to_string(list_transform(CASE WHEN {s} = '' THEN [] ELSE string_split({s}, '') END, lambda c, i: CASE WHEN ({key} * {a} + (i - 1) * {b}) % {n} = 0 THEN '{to}' ELSE c END), '')"


_SQL = {
    "q_regions": "SELECT region_id, any_value(scan_id) AS scan_id, any_value(archive) AS archive, any_value(pos) AS pos, any_value(region_type) AS region_type, any_value(label) AS label, any_value(coords) AS coords, any_value(page_width) AS page_width, any_value(lang) AS lang FROM text_regions GROUP BY region_id",
    "q_pairs": f"SELECT region_id, archive, coalesce(lang, 'und') AS lang, coalesce(region_type, 'none') AS class, label AS gt, {_sql_changed('label', 'region_id', 31, 17, 19, '#')} AS pred FROM q_regions WHERE label IS NOT NULL",
    "q_records": "SELECT record_id, any_value(split) AS split, any_value(filename) AS filename, any_value(label.text) AS text, any_value(label.nb_cols) AS nb_cols, any_value(label.dataset) AS dataset, any_value(label.paragraphs) AS paragraphs, any_value(label.pages) AS pages FROM label_records GROUP BY record_id",
    "q_tagged": f"SELECT record_id, split, coalesce(dataset, 'none') AS dataset, text AS gt, {_sql_changed('text', 'record_id', 13, 7, 23, '')} AS pred FROM q_records WHERE text IS NOT NULL",
    "q_word_lists": f"SELECT record_id, dataset, string_split(trim(regexp_replace(translate(gt, '{MARKS}', ''), '[ \\n]+', ' ', 'g'), ' '), ' ') AS ws FROM q_tagged",
    "q_words": "SELECT record_id, dataset, CAST(pos AS INTEGER) AS pos, word, CASE WHEN length(word) % 4 = 0 THEN 'PER' WHEN length(word) % 7 = 0 THEN 'LOC' ELSE 'O' END AS tag FROM (SELECT record_id, dataset, unnest(ws) AS word, generate_subscripts(ws, 1) - 1 AS pos FROM q_word_lists) WHERE word <> ''",
    "q_sentences": "SELECT doc_id, source, text, CAST(len(string_split(text, '. ')) AS INTEGER) AS n_sentences FROM (SELECT doc_id, coalesce(source, 'none') AS source, trim(regexp_replace(replace(text, chr(10), ' '), ' +', ' ', 'g'), ' ') AS text FROM documents WHERE text IS NOT NULL) WHERE text <> ''",
}


def sql_class(characters: str, negated: bool = False) -> str:
    """The class of characters for DuckDB's regular expressions, inside an SQL string."""
    return "[" + "^" * negated + "".join("\\" + c if c in "[]\\^-&" else c for c in characters).replace("'", "''") + "]"


def sql_edits(a: str, b: str) -> str:
    """Edit distance of two lists of symbols, each symbol that both have coded as one byte (up to 125), any other of a side as one that the other side lacks."""
    coded = lambda x, own: f"array_to_string(list_transform({x}, lambda c: CASE WHEN list_contains(p.s, c) THEN chr(CAST(list_position(p.s, c) AS INTEGER) + 2) ELSE chr({own}) END), '')"
    return f"list_transform([{{'a': {a}, 'b': {b}, 's': list_distinct(list_intersect({a}, {b}))}}], lambda p: levenshtein({coded('p.a', 1)}, {coded('p.b', 2)}))[1]"
