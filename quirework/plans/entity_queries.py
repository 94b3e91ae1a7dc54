"""Queries over reading order and named entities."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quirework.operators import entities as N
from quirework.operators import reading as R
from quirework.plans import fixtures as X
from quirework.plans.base import Book

_book = Book()
QUERIES, SQL = _book.QUERIES, _book.SQL
_q = _book.add
#: Entity characters by tag.
_SIGN = {"PER": "✻", "LOC": "✼"}
_SIGNS = "".join(_SIGN.values())
_SIGN_SQL = "CASE tag WHEN 'PER' THEN '✻' WHEN 'LOC' THEN '✼' ELSE '' END"


@_q()
def reading_order_letters(spark: SparkSession, d: str) -> DataFrame:
    return R.order_letters(X.regions(spark, d))


@_q()
def reading_order_read(spark: SparkSession, d: str) -> DataFrame:
    return R.order_registers(X.regions(spark, d)).select("scan_id", "region_id", "place", "mode")


@_q()
def region_grouping(spark: SparkSession, d: str) -> DataFrame:
    return R.order_registers(X.regions(spark, d)).groupBy("scan_id", "grp").agg(F.count("*").alias("n"))


@_q(X.with_sql("SELECT record_id, pos, word, CASE WHEN tag = 'O' THEN 'O' WHEN tag = lag(tag) OVER (PARTITION BY record_id ORDER BY pos) THEN 'I-' || tag ELSE 'B-' || tag END AS bio FROM q_words"))
def bio_prefix(spark: SparkSession, d: str) -> DataFrame:
    before = F.lag("tag").over(W.partitionBy("record_id").orderBy("pos"))
    bio = F.when(F.col("tag") == "O", "O").when(F.col("tag") == before, F.concat(F.lit("I-"), "tag")).otherwise(F.concat(F.lit("B-"), "tag"))
    return X.words(spark, d).select("record_id", "pos", "word", bio.alias("bio"))


def _line(df: DataFrame, word: str) -> DataFrame:
    rows = F.array_sort(F.collect_list(F.struct("pos", F.col(word).alias("w"))))
    return df.groupBy("record_id").agg(F.array_join(F.transform(rows, lambda r: r["w"]), " ").alias("text"))


@_q(X.with_sql(f"SELECT record_id, string_agg(word || {_SIGN_SQL}, ' ' ORDER BY pos) AS text FROM q_words GROUP BY record_id"))
def ner_tagging(spark: SparkSession, d: str) -> DataFrame:
    """Texts whose words carry their entity's sign after them."""
    return _line(_signed(spark, d), "after")


def _signed(spark: SparkSession, d: str) -> DataFrame:
    sign = F.expr(_SIGN_SQL)
    return X.words(spark, d).withColumn("after", F.concat("word", sign))


_BOTH = f"CASE WHEN tag <> 'O' AND coalesce(lag(tag) OVER w, 'O') <> tag THEN {_SIGN_SQL} ELSE '' END || word || CASE WHEN tag <> 'O' AND coalesce(lead(tag) OVER w, 'O') <> tag THEN {_SIGN_SQL} ELSE '' END"


@_q(X.with_sql(f"SELECT record_id, string_agg(x, ' ' ORDER BY pos) AS text FROM (SELECT record_id, pos, {_BOTH} AS x FROM q_words WINDOW w AS (PARTITION BY record_id ORDER BY pos)) GROUP BY record_id"))
def ner_both_tagging(spark: SparkSession, d: str) -> DataFrame:
    """Signs where an entity begins and where it ends, also across lines."""
    w = W.partitionBy("record_id").orderBy("pos")
    sign, none = F.expr(_SIGN_SQL), F.lit("")
    own = F.col("tag") != "O"
    opens, closes = own & (F.coalesce(F.lag("tag").over(w), F.lit("O")) != F.col("tag")), own & (F.coalesce(F.lead("tag").over(w), F.lit("O")) != F.col("tag"))
    return _line(X.words(spark, d).withColumn("x", F.concat(F.when(opens, sign).otherwise(none), "word", F.when(closes, sign).otherwise(none))), "x")


@_q(X.with_sql("SELECT scan_id, 'ⓟ' || string_agg(label, chr(10) ORDER BY pos, region_id) || 'Ⓟ' AS text FROM q_regions WHERE label IS NOT NULL GROUP BY scan_id"))
def page_assembly(spark: SparkSession, d: str) -> DataFrame:
    rows = F.array_sort(F.collect_list(F.struct("pos", "region_id", "label")))
    x = X.regions(spark, d).where("label is not null").groupBy("scan_id").agg(rows.alias("r"))
    return x.select("scan_id", F.concat(F.lit("ⓟ"), F.array_join(F.transform("r", lambda r: r["label"]), "\n"), F.lit("Ⓟ")).alias("text"))


def _tagged_pairs(spark: SparkSession, d: str) -> DataFrame:
    """record_id, gt and pred with signs after the words; the prediction loses every sign of a word at a place that 5 divides, and the first letter of those that 11 divides."""
    lossy = F.when(F.col("pos") % 5 == 0, F.col("word")).when(F.col("pos") % 11 == 0, F.expr("substring(after, 2)")).otherwise(F.col("after"))
    rows = F.array_sort(F.collect_list(F.struct("pos", "after", lossy.alias("lossy"))))
    x = _signed(spark, d).groupBy("record_id").agg(rows.alias("r"))
    joined = lambda k: F.array_join(F.transform("r", lambda r: r[k]), " ")
    return x.select("record_id", joined("after").alias("gt"), joined("lossy").alias("pred"))


_PARTS = "regexp_split_to_array(replace(gt, chr(10), ' '), '[ &(),./:;=?]')"


@_q(X.with_sql(f"""SELECT record_id, CAST(row_number() OVER w - 1 AS INTEGER) AS pos, plain AS word, CASE WHEN name = '' THEN 'O' WHEN name = lag(name) OVER w THEN 'I-' || name ELSE 'B-' || name END AS tag FROM (
SELECT record_id, i, regexp_extract(part, '^(.+?)([{_SIGNS}]{{1,2}})$', 2) AS name, CASE WHEN regexp_matches(part, '^(.+?)([{_SIGNS}]{{1,2}})$') THEN regexp_extract(part, '^(.+?)([{_SIGNS}]{{1,2}})$', 1) ELSE part END AS plain FROM (
SELECT record_id, unnest({_PARTS}) AS part, generate_subscripts({_PARTS}, 1) AS i FROM (SELECT record_id, string_agg(word || {_SIGN_SQL}, ' ' ORDER BY pos) AS gt FROM q_words GROUP BY record_id)) WHERE part <> '') WINDOW w AS (PARTITION BY record_id ORDER BY i)"""))
def bio_lines(spark: SparkSession, d: str) -> DataFrame:
    import pyarrow as pa

    def run(batches):
        for batch in batches:
            rows = [(k, i, w, t) for k, text in zip(*(c.to_pylist() for c in batch.columns)) for i, (w, t) in enumerate(N.bio_of(text, _SIGNS))]
            cols = list(zip(*rows)) or [()] * 4
            yield pa.RecordBatch.from_arrays([pa.array(cols[0], pa.int64()), pa.array(cols[1], pa.int32()), pa.array(cols[2], pa.string()), pa.array(cols[3], pa.string())], ["record_id", "pos", "word", "tag"])

    return _tagged_pairs(spark, d).select("record_id", "gt").mapInArrow(run, "record_id bigint, pos int, word string, tag string")


@_q()
def bio_char_labels(spark: SparkSession, d: str) -> DataFrame:
    """Characters of each record inside entities, and its entities."""
    import pyarrow as pa

    def run(batches):
        for batch in batches:
            made = [N.char_labels(N.bio_of(text, _SIGNS)) for text in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([len(m[0]) for m in made], pa.int64()), pa.array([sum(x != "O" for x in m[1]) for m in made], pa.int64()), pa.array([m[2]["All"] for m in made], pa.int64())], ["record_id", "n_chars", "n_inside", "n_entities"])

    return _tagged_pairs(spark, d).select("record_id", "gt").mapInArrow(run, "record_id bigint, n_chars bigint, n_inside bigint, n_entities bigint")


def _runs(text: str, sign: str) -> str:
    """SQL of the runs of words that all carry the sign at their end, up to a space, a line's end or a mark."""
    return f"regexp_extract_all({text}, '((?:(?:^|[ \\n(])[^ \\n&(),/:;=?]*{sign})+)', 1)"


_TAGS_SQL = " UNION ALL ".join(f"SELECT record_id, '{k}' AS tag, {_runs('gt', s)} AS runs FROM gts" for k, s in _SIGN.items())


@_q(X.with_sql(f"""SELECT record_id, tag, CAST(pos AS INTEGER) AS pos, trim(translate(run, '{_SIGNS}', ''), ' (' || chr(10)) AS entity FROM (
SELECT record_id, tag, unnest(runs) AS run, generate_subscripts(runs, 1) - 1 AS pos FROM (WITH gts AS (SELECT record_id, string_agg(word || {_SIGN_SQL}, ' ' ORDER BY pos) AS gt FROM q_words GROUP BY record_id) {_TAGS_SQL}))"""))
def extract_entities(spark: SparkSession, d: str) -> DataFrame:
    """By tag, the runs of words that all carry its sign, without any sign."""
    found = F.expr("array(" + ", ".join(f"struct('{k}' AS tag, {_runs('gt', s)} AS runs)" for k, s in _SIGN.items()) + ")")
    x = _line(_signed(spark, d), "after").withColumnRenamed("text", "gt").select("record_id", F.explode(found).alias("f"))
    x = x.select("record_id", "f.tag", F.posexplode("f.runs").alias("pos", "run"))
    return x.select("record_id", "tag", "pos", F.btrim(F.translate("run", _SIGNS, ""), F.lit(" \n(")).alias("entity"))


def _scores(spark: SparkSession, d: str, threshold: float) -> DataFrame:
    x = _tagged_pairs(spark, d).join(X.records(spark, d).select("record_id", F.coalesce("dataset", F.lit("none")).alias("dataset")), "record_id")
    rows = N.scored(x.select(F.struct("record_id", "dataset").alias("key"), "gt", "pred"), "key", _SIGNS, X.MARKS, threshold)
    return N.corpus_scores(rows.withColumn("dataset", F.col("key.dataset")), ["dataset"])


@_q()
def ner_f1(spark: SparkSession, d: str) -> DataFrame:
    return _scores(spark, d, 0.30)


@_q()
def ner_f1_strict(spark: SparkSession, d: str) -> DataFrame:
    return _scores(spark, d, 0.15)
