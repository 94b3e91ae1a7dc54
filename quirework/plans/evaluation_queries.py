"""Queries over predictions that are tables of their own, layout repair with confidences, page descriptions, sinks, and further sampling."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quirework.functions import text as T
from quirework.functions.distance import ratio
from quirework.functions.maps import merge_maps
from quirework.functions.rng import UNIFORM_SQL, uniform, uniform_int
from quirework.operators import entities as N
from quirework.operators import evaluation as V
from quirework.operators.ordering import group_rank
from quirework.plans import fixtures as X
from quirework.plans.base import Book
from quirework.plans.text_queries import _CHARS, _sql_alternatives, _sql_cer, _sql_repair
from quirework.session import staging_dir
from quirework.sources import files, pages, sinks
from quirework.sources.tables import table
from quirework.streaming import metrics as M

_book = Book()
QUERIES, SQL = _book.QUERIES, _book.SQL
_q = _book.add
_u = UNIFORM_SQL.format
_NAME = "dataset || '/' || record_id"


def _truths(spark: SparkSession, d: str) -> DataFrame:
    return X.tagged(spark, d).select("dataset", F.concat_ws("/", "dataset", "record_id").alias("name"), "record_id", "gt")


def _predictions(spark: SparkSession, d: str) -> DataFrame:
    """name, pred, conf: one record in 17 has no prediction; a character's confidence depends on its place."""
    x = X.tagged(spark, d).where("record_id % 17 <> 0")
    conf = F.transform(T.chars(F.col("pred")), lambda c, i: ((F.col("record_id") * 7 + i * 13) % 100) / 100.0)
    return x.select(F.concat_ws("/", "dataset", "record_id").alias("name"), "pred", conf.alias("conf"))


def _pairs(spark: SparkSession, d: str) -> DataFrame:
    return V.matched(_truths(spark, d), _predictions(spark, d))


_TEXT = f"""SELECT dataset, count(*) AS nb_docs, CAST(count_if(missing) AS BIGINT) AS missing, sum({X.sql_edits(_CHARS.format('a'), _CHARS.format('b'))}) / nullif(sum(length(a)), 0) AS cer FROM (
SELECT dataset, missing, {_sql_cer('gt', X.MARKS)} AS a, {_sql_cer('pred', X.MARKS)} AS b FROM (
SELECT dataset, gt, record_id % 17 = 0 AS missing, CASE WHEN record_id % 17 = 0 THEN '' ELSE pred END AS pred FROM q_tagged)) GROUP BY dataset"""


@_q(X.with_sql(_TEXT))
def evaluation_text(spark: SparkSession, d: str) -> DataFrame:
    """Error rates of predictions that meet their truths by name."""
    x = V.text_rows(_pairs(spark, d), X.MARKS)
    return x.groupBy("dataset").agg(F.count("*").alias("nb_docs"), F.count_if("missing").alias("missing"), ratio(F.col("e"), F.col("n")).alias("cer"))


@_q()
def evaluation(spark: SparkSession, d: str) -> DataFrame:
    """Every metric that the registry gives a data set, layouts repaired and regions ranked by confidence first."""
    return V.evaluated(_pairs(spark, d), X.MARKS)


@_q()
def class_precision(spark: SparkSession, d: str) -> DataFrame:
    """Average precision by data set, class and threshold, of repaired regions ranked by the confidences of their markers."""
    x = V.layout_rows(_pairs(spark, d)).where("metric like 'map_cer%'")
    return x.groupBy("dataset", "class", F.substring("metric", 9, 2).cast("int").alias("threshold")).agg(F.round(F.sum("part") / F.sum("whole"), 6).alias("precision"), F.sum("whole").cast("bigint").alias("regions"))


@_q()
def entity_precision(spark: SparkSession, d: str) -> DataFrame:
    """Average precision of entities by tag and threshold: runs of words with a tag's sign, ranked by the mean confidence of their signs."""
    from quirework.plans.entity_queries import _SIGN, _tagged_pairs

    x = _tagged_pairs(spark, d).select("record_id", "gt", "pred", F.transform(T.chars(F.col("pred")), lambda c, i: ((F.col("record_id") * 7 + i * 13) % 100) / 100.0).alias("conf"))
    return N.entity_ap(x, "record_id", _SIGN).groupBy("tag", "threshold").agg(F.round(F.sum(F.col("ap") * F.col("weight")) / F.sum("weight"), 6).alias("precision"), F.sum("weight").alias("entities"))


@_q()
def repair_confidences(spark: SparkSession, d: str) -> DataFrame:
    """Repaired predictions with the confidence of every character; inserted markers have 0."""
    return V.repaired_rows(_pairs(spark, d))


_PRED = X.with_sql(f"SELECT {_NAME} AS name, pred FROM q_tagged WHERE record_id % 17 <> 0")


@_q(_PRED)
def predictions_roundtrip(spark: SparkSession, d: str) -> DataFrame:
    """Predictions written as JSON and read back."""
    path = f"{staging_dir(spark)}/predictions-{uuid.uuid4().hex}"
    sinks.write_predictions(_predictions(spark, d), path)
    return sinks.read_predictions(spark.read.text(path))


@_q(X.with_sql(f"SELECT dataset, round(cer, 6) AS cer, CAST(missing AS DOUBLE) AS missing FROM ({_TEXT})"))
def metrics_roundtrip(spark: SparkSession, d: str) -> DataFrame:
    """Metrics written as JSON and read back."""
    path = f"{staging_dir(spark)}/metrics-{uuid.uuid4().hex}"
    values = evaluation_text(spark, d).withColumn("missing", F.col("missing").cast("double")).unpivot(["dataset"], ["cer", "missing"], "metric", "value")
    sinks.write_metrics(values, path)
    x = spark.read.schema("dataset string, metrics struct<cer:double,missing:double>").json(f"{path}/summary")
    return x.select("dataset", F.round("metrics.cer", 6).alias("cer"), "metrics.missing")


# ---- page descriptions

_WHOLE = "coords.l IS NOT NULL AND coords.t IS NOT NULL AND coords.r IS NOT NULL AND coords.b IS NOT NULL AND scan_id IS NOT NULL"
_PLAIN = "replace(replace(regexp_replace(label, '[\\x00-\\x08\\x0b\\x0c\\x0e-\\x1f]', '', 'g'), chr(13) || chr(10), chr(10)), chr(13), chr(10))"
_SQL_CLEAN = "trim(regexp_replace(regexp_replace({}, '\\n+', chr(10), 'g'), ' +', ' ', 'g'), ' ' || chr(10))"


def _escaped(c: str) -> Column:
    x = F.regexp_replace(c, r"[\x00-\x08\x0b\x0c\x0e-\x1f]", "")
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;")):
        x = F.replace(x, F.lit(a), F.lit(b))
    return x


@_q(X.with_sql(f"""SELECT CAST(scan_id AS VARCHAR) AS file, region_id, {_SQL_CLEAN.format("array_to_string(list_transform(lines, lambda x: " + _SQL_CLEAN.format("x") + "), chr(10))")} AS label, l, t, r, b FROM (
SELECT scan_id, region_id, list_filter(string_split({_PLAIN}, chr(10)), lambda x: x <> '') AS lines, coords.l AS l, coords.t AS t, coords.r AS r, coords.b AS b FROM q_regions WHERE label IS NOT NULL AND {_WHOLE}) WHERE len(lines) > 0"""))
def page_xml_scan(spark: SparkSession, d: str) -> DataFrame:
    """Regions of each scan as PAGE-XML with outlines of many points, read again: boxes from outlines, labels from lines; empty lines and regions without lines are left out."""
    c = lambda k: F.col(f"coords.{k}")
    mid = F.floor((c("l") + c("r")) / 2).cast("int")
    outline = F.concat_ws(" ", *(F.concat_ws(",", x, y) for x, y in ((mid, c("t")), (c("r"), F.floor((c("t") + c("b")) / 2).cast("int")), (c("l"), c("b")), (mid, c("b")), (c("l"), c("t")))))
    points = F.concat(F.lit('<Coords points="'), outline, F.lit('"/>'))
    line = F.transform(F.split(_escaped("label"), "\r\n|\r|\n"), lambda x, i: F.concat(F.lit('<TextLine id="l'), i.cast("string"), F.lit('">'), F.col("points"), F.lit("<TextEquiv><Unicode>"), x, F.lit("</Unicode></TextEquiv></TextLine>")))
    x = X.regions(spark, d).where(f"label is not null and {_WHOLE}").withColumn("points", points)
    x = x.select("scan_id", "pos", "region_id", F.concat(F.lit('<TextRegion id="'), F.col("region_id").cast("string"), F.lit('">'), F.col("points"), F.array_join(line, ""), F.lit("</TextRegion>")).alias("xml"))
    body = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "region_id", "xml"))), lambda r: r["xml"]), "")
    docs = x.groupBy("scan_id").agg(F.concat(F.lit('<PcGts><Page imageFilename="x.jpg" imageWidth="100" imageHeight="100">'), body, F.lit("</Page></PcGts>")).alias("value"))
    y = pages.parse_page_xml(docs.select(F.col("scan_id").cast("string").alias("file"), "value"))
    return y.select("file", F.col("region_id").cast("bigint").alias("region_id"), "label", "coords.*")


_CLEAN_LETTER = _SQL_CLEAN.format(_sql_alternatives(_sql_repair("label")))


@_q(X.with_sql(f"SELECT region_id, {_CLEAN_LETTER} AS text FROM q_regions WHERE trim(label, ' ') <> ''"))
def letters_clean(spark: SparkSession, d: str) -> DataFrame:
    """The whole cleaning of a letter's boxes: repairs, alternatives, spaces."""
    return pages.clean_letters(X.regions(spark, d).select("region_id", F.col("label").alias("text"))).select("region_id", "text")


_NUMBER = "translate(regexp_extract(gt, 'ⓝ([^Ⓝ]*)Ⓝ', 1), '. ⓝⓃ', '')"


@_q(X.with_sql(f"SELECT dataset, CAST({_NUMBER} AS INTEGER) AS number, list(record_id ORDER BY record_id) AS pages FROM q_tagged WHERE regexp_matches({_NUMBER}, '^[0-9]{{1,9}}$') GROUP BY ALL"))
def page_groups(spark: SparkSession, d: str) -> DataFrame:
    """Pages of a data set by the number that their first number region states, cleaned."""
    number = T.page_number(F.regexp_extract("gt", "ⓝ([^Ⓝ]*)Ⓝ", 1))
    x = X.tagged(spark, d).select("dataset", "record_id", number.alias("number")).where("number is not null")
    return x.groupBy("dataset", "number").agg(F.array_sort(F.collect_list("record_id")).alias("pages"))


# ---- corpora, splits, sampling


@_q(X.with_sql("SELECT 'labels' AS source, record_id, text FROM q_records WHERE text IS NOT NULL AND text <> '' AND NOT regexp_matches(text, '[^A-Za-zÀ-ÿ0-9.,;:''Ⓐ-ⓩ \\n-]')"))
def corpus_labels(spark: SparkSession, d: str) -> DataFrame:
    """Label records as a corpus: those written in a charset only."""
    charset = "".join(chr(c) for c in (*range(0x41, 0x5B), *range(0x61, 0x7B), *range(0xC0, 0x100), *range(0x30, 0x3A), *range(0x24B6, 0x24EA))) + ".,;:'-"
    return files.label_corpus(X.records(spark, d).select("record_id", "text"), charset)


@_q(X.with_sql("SELECT source, CAST(weight AS DOUBLE) AS weight, count(*) AS lines FROM (SELECT CASE WHEN record_id % 3 = 0 THEN 'a' ELSE 'b' END AS source, CASE WHEN record_id % 3 = 0 THEN 0.75 ELSE 0.25 END AS weight, unnest(string_split(regexp_replace(gt, '\\r\\n?', chr(10), 'g'), chr(10))) AS line FROM q_tagged) WHERE trim(line, ' ') <> '' GROUP BY source, weight"))
def corpus_weighted(spark: SparkSession, d: str) -> DataFrame:
    """Two text files of weights 3 and 1, written and read as one weighted corpus."""
    folder = f"{staging_dir(spark)}/corpus-{uuid.uuid4().hex}"
    x = X.tagged(spark, d)
    for name, rule in (("a", "record_id % 3 = 0"), ("b", "record_id % 3 <> 0")):
        x.where(rule).select(F.col("gt").alias("value")).write.text(f"{folder}/{name}")
    return files.text_corpus(spark, {f"{folder}/a": 3.0, f"{folder}/b": 1.0}).groupBy("source", "weight").agg(F.count("*").alias("lines"))


@_q(X.with_sql("SELECT record_id, dataset || '-' || split AS name, CASE split WHEN 'train' THEN 'train' WHEN 'valid' THEN 'eval' WHEN 'test' THEN 'eval' END AS role FROM q_tagged WHERE split IS NOT NULL AND dataset <> 'none' AND NOT (dataset = 'RIMES' AND split = 'test') AND NOT (dataset = 'IAM_NER' AND record_id % 10 = 0)"))
def split_resolution(spark: SparkSession, d: str) -> DataFrame:
    """Named splits of data sets to roles, without a split that is taken out and without listed records."""
    roles = F.create_map(*(F.lit(x) for kv in {"train": "train", "valid": "eval", "test": "eval"}.items() for x in kv))
    x = X.tagged(spark, d).where("split is not null and dataset <> 'none'")
    removed = (F.col("dataset") == "RIMES") & (F.col("split") == "test")
    listed = x.where("dataset = 'IAM_NER' and record_id % 10 = 0").select("record_id")
    return x.where(~removed).join(listed, "record_id", "left_anti").select("record_id", F.concat_ws("-", "dataset", "split").alias("name"), F.try_element_at(roles, F.col("split")).alias("role"))


_SUBST = {"e": "é", "é": "e", "i": "l", "l": "i", "o": "0", "u": "n", "n": "u", "a": "o", "Ⓑ": "Ⓟ", "ⓑ": "ⓟ"}
_SPECIAL = "ⒷⓑⓅⓟ"
_RATE = "CASE WHEN c IN ('Ⓑ', 'ⓑ', 'Ⓟ', 'ⓟ') OR s IS NULL THEN 0.1 / 3 ELSE 0.1 END"
_SUBST_SQL = "CASE c " + " ".join(f"WHEN '{a}' THEN '{b}'" for a, b in _SUBST.items()) + " END"


@_q(X.with_sql(f"""SELECT record_id, string_agg(CASE WHEN i > 1 AND c <> chr(10) AND u < {_RATE} THEN coalesce(s, '¤') ELSE c END, '' ORDER BY i) AS text FROM (
SELECT record_id, i, c, {_SUBST_SQL} AS s, {_u("'6:' || record_id || ':' || (i - 1)")} AS u FROM (SELECT record_id, unnest(string_split(gt, '')) AS c, generate_subscripts(string_split(gt, ''), 1) AS i FROM q_tagged WHERE gt <> '')) GROUP BY record_id"""))
def token_noise_table(spark: SparkSession, d: str) -> DataFrame:
    """Characters replaced by those they are mistaken for, never the first nor line ends; layout markers and characters without such a one at a third of the rate."""
    table_ = F.create_map(*(F.lit(x) for kv in _SUBST.items() for x in kv))

    def noisy(c: Column, i: Column) -> Column:
        to = F.try_element_at(table_, c)
        rate = F.when(F.lit(_SPECIAL).contains(c) | to.isNull(), F.lit(0.1) / 3).otherwise(F.lit(0.1))
        return F.when((i > 0) & (c != "\n") & (uniform(F.col("record_id"), i, seed=6) < rate), F.coalesce(to, F.lit("¤"))).otherwise(c)

    return X.tagged(spark, d).where("gt <> ''").select("record_id", F.array_join(F.transform(T.chars(F.col("gt")), noisy), "").alias("text"))


@_q(f"SELECT event_id, CAST(3 + floor({_u(chr(39) + '17:' + chr(39) + ' || event_id')} * 9) AS INTEGER) AS draw FROM events")
def uniform_draws(spark: SparkSession, d: str) -> DataFrame:
    """Whole numbers from 3 up to, not including, 12, by key."""
    return table(spark, d, "events").select("event_id", uniform_int(3, 12, "event_id", seed=17).alias("draw"))


_CARRY = 7


@_q(X.with_sql(f"""SELECT source, CAST((k - 1) // {_CARRY} AS BIGINT) AS page, string_agg(s, '. ' ORDER BY k) AS text FROM (
SELECT source, s, row_number() OVER (PARTITION BY source ORDER BY h, doc_id, i) AS k FROM (SELECT source, md5('13:' || doc_id) AS h, doc_id, unnest(string_split(text, '. ')) AS s, generate_subscripts(string_split(text, '. '), 1) AS i FROM q_sentences)) GROUP BY source, (k - 1) // {_CARRY}"""))
def text_carry_over(spark: SparkSession, d: str) -> DataFrame:
    """A corpus in shuffled order cut into pages of so many sentences; what a document leaves over opens the next page, and nothing is lost.

    Places in a source come from a sort by range and offsets: no source is one window."""
    x = X.sentences(spark, d).select("source", F.md5(F.concat(F.lit("13:"), F.col("doc_id").cast("string"))).alias("h"), "doc_id", F.posexplode(F.split("text", r"\. ")).alias("i", "s"))
    placed = group_rank(x, ["source"], ["h", "doc_id", "i"]).withColumn("page", F.floor((F.col("k") - 1) / _CARRY))
    rows = F.array_sort(F.collect_list(F.struct("k", "s")))
    return placed.groupBy("source", "page").agg(F.array_join(F.transform(rows, lambda r: r["s"]), ". ").alias("text"))


# ---- tables and texts


@_q("SELECT y, x, i AS dim, round(CASE WHEN i < 32 THEN (CASE WHEN i % 2 = 0 THEN sin(y / pow(10000.0, i / 32.0)) ELSE cos(y / pow(10000.0, (i - 1) / 32.0)) END) ELSE (CASE WHEN i % 2 = 0 THEN sin(x / pow(10000.0, (i - 32) / 32.0)) ELSE cos(x / pow(10000.0, (i - 33) / 32.0)) END) END, 6) AS v FROM range(0, 20) a(y), range(0, 30) c(x), range(0, 64) b(i)")
def position_table_2d(spark: SparkSession, d: str) -> DataFrame:
    """Sinusoidal positions of a plane of 20 by 30: the first half of the 64 dimensions for the row, the second for the column."""
    number = lambda n: F.sequence(F.lit(0).cast("bigint"), F.lit(n - 1).cast("bigint"))
    x = spark.range(20).select(F.col("id").alias("y"), F.explode(number(30)).alias("x")).select("y", "x", F.explode(number(64)).alias("dim"))
    own = F.col("dim") % 32
    angle = F.when(F.col("dim") < 32, F.col("y")).otherwise(F.col("x")) / F.pow(F.lit(10000.0), (own - own % 2) / 32.0)
    return x.select("y", "x", "dim", F.round(F.when(F.col("dim") % 2 == 0, F.sin(angle)).otherwise(F.cos(angle)), 6).alias("v"))


_WITH = "CASE WHEN tag = 'PER' THEN '✻' WHEN tag = 'LOC' THEN '✼' ELSE '' END"


@_q(X.with_sql(f"SELECT record_id, string_agg({_WITH} || word, ' ' ORDER BY pos) AS text FROM q_words GROUP BY record_id"))
def ner_before_tagging(spark: SparkSession, d: str) -> DataFrame:
    """Texts whose words carry their entity's sign before them."""
    rows = F.array_sort(F.collect_list(F.struct("pos", F.concat(F.expr(_WITH), "word").alias("w"))))
    return X.words(spark, d).groupBy("record_id").agg(F.array_join(F.transform(rows, lambda r: r["w"]), " ").alias("text"))


@_q("SELECT charset_id, section, key, value FROM (SELECT charset_id, 'page' AS section, 'mode' AS key, 'plain' AS value FROM label_charsets UNION ALL SELECT charset_id, 'page', 'version', CAST(version AS VARCHAR) FROM label_charsets UNION ALL SELECT charset_id, 'text', 'sorted', 'yes' FROM label_charsets UNION ALL SELECT charset_id, 'own', 'dataset', dataset FROM label_charsets)")
def settings_merge(spark: SparkSession, d: str) -> DataFrame:
    """Settings of two levels: each charset's over general ones; sections are merged key by key, the right side wins."""
    lit = lambda m: F.create_map(*(F.lit(x) for kv in m.items() for x in kv))
    base = F.create_map(F.lit("page"), lit({"mode": "plain", "version": "0"}), F.lit("text"), lit({"sorted": "yes"}))
    own = F.create_map(F.lit("page"), F.create_map(F.lit("version"), F.col("version").cast("string")), F.lit("own"), F.create_map(F.lit("dataset"), F.col("dataset")))
    x = table(spark, d, "label_charsets").select("charset_id", F.explode(merge_maps(base, own)).alias("section", "values"))
    return x.select("charset_id", "section", F.explode("values").alias("key", "value"))


@_q()
def bio_udtf(spark: SparkSession, d: str) -> DataFrame:
    """The tagged words of each text by a table function that SQL can call."""
    from quirework.plans.entity_queries import _SIGNS, _line, _signed

    N.register_bio(spark, _SIGNS)
    _line(_signed(spark, d), "after").createOrReplaceTempView("quirework_tagged")
    return spark.sql("SELECT record_id, b.* FROM quirework_tagged, LATERAL bio_words(text) b")


# ---- streams


@_q("SELECT slot + INTERVAL (k * 15) MINUTE AS start, event_type, count(*) AS n FROM (SELECT event_type, time_bucket(INTERVAL 15 MINUTES, ts) - INTERVAL 45 MINUTES AS slot FROM events), range(0, 4) t(k) GROUP BY 1, 2")
def ext_sliding(spark: SparkSession, d: str) -> DataFrame:
    """Counts in windows of an hour that begin every quarter of an hour, by the stream in complete mode."""
    out = M.drained(M.sliding(M.event_stream(spark, f"{d}/events.parquet")), "complete")
    return out.select(F.col("start").cast("timestamp_ntz").alias("start"), "event_type", "n")


@_q("SELECT DISTINCT user_id, event_type, date_trunc('hour', ts) AS hour FROM events")
def ext_dedup(spark: SparkSession, d: str) -> DataFrame:
    """The first event of each user, type and hour: repeated ones are dropped as long as the watermark keeps their keys."""
    out = M.drained(M.first_of_hour(M.event_stream(spark, f"{d}/events.parquet")), "append")
    return out.select("user_id", "event_type", F.col("hour").cast("timestamp_ntz").alias("hour"))


@_q("SELECT a.event_id AS a, b.event_id AS b FROM events a JOIN events b ON a.user_id = b.user_id AND b.event_id > a.event_id AND b.ts >= a.ts AND b.ts <= a.ts + INTERVAL 6 HOURS WHERE a.event_type = (SELECT min(event_type) FROM events) AND b.event_type = (SELECT max(event_type) FROM events)")
def ext_stream_join(spark: SparkSession, d: str) -> DataFrame:
    """Events of one type with those of another by the same user within six hours after: two streams joined by key and time."""
    kinds = table(spark, d, "events").agg(F.min("event_type").alias("a"), F.max("event_type").alias("b")).first()  # one row
    stream = lambda kind: M.event_stream(spark, f"{d}/events.parquet").where(F.col("event_type") == kind)
    return M.drained(M.followed(stream(kinds.a), stream(kinds.b), "6 hours"), "append")
