"""Queries over layout markers: repair, extraction, graphs, average precision, and the suite of corpus metrics."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quirework.functions import text as T
from quirework.functions.distance import char_edits, ratio
from quirework.operators import evaluation as V
from quirework.operators import layout as L
from quirework.operators.ordering import group_rank, running
from quirework.plans import fixtures as X
from quirework.plans.base import Book
from quirework.plans.text_queries import _CHARS, _sql_cer, row_rates

_book = Book()
QUERIES, SQL = _book.QUERIES, _book.SQL
_q = _book.add
_P = T.LETTER_PAIRS
_END_OF = "CASE {} " + " ".join(f"WHEN '{a}' THEN '{b}'" for a, b in _P.items()) + " ELSE '' END"
_BEGINS, _ENDS = "('" + "','".join(_P) + "')", "('" + "','".join(_P.values()) + "')"

#: Flat repair as a fold; a is the state, b.text the next character.
_FLAT = f"""SELECT record_id, dataset, pred, s.text || {_END_OF.format("s.opened")} AS text, CAST(s.ops + CASE WHEN s.opened = '' THEN 0 ELSE 1 END AS INTEGER) AS ops FROM (
SELECT record_id, dataset, pred, list_reduce(list_prepend({{'opened': '', 'text': '', 'ops': 0}}, list_transform({_CHARS.format("pred")}, lambda c: {{'opened': '', 'text': c, 'ops': 0}})), lambda a, b: {{
 'opened': CASE WHEN b.text IN {_BEGINS} THEN b.text WHEN b.text IN {_ENDS} AND {_END_OF.format("a.opened")} = b.text THEN '' ELSE a.opened END,
 'text': a.text || CASE WHEN b.text IN {_BEGINS} AND a.opened <> '' THEN {_END_OF.format("a.opened")} || b.text WHEN b.text IN {_ENDS} AND {_END_OF.format("a.opened")} <> b.text THEN '' ELSE b.text END,
 'ops': a.ops + CASE WHEN (b.text IN {_BEGINS} AND a.opened <> '') OR (b.text IN {_ENDS} AND {_END_OF.format("a.opened")} <> b.text) THEN 1 ELSE 0 END}}) AS s FROM q_tagged)"""


@_q(X.with_sql(f"SELECT record_id, text, ops FROM ({_FLAT})"))
def repair_flat(spark: SparkSession, d: str) -> DataFrame:
    return X.tagged(spark, d).select("record_id", L.flat_repair(F.col("pred")).alias("r")).select("record_id", "r.text", "r.ops")


_COUNT = f"length(regexp_replace({{}}, '{X.sql_class(''.join(_P) + ''.join(_P.values()), True)}', '', 'g'))"


@_q(X.with_sql(f"SELECT dataset, sum(ops) / nullif(sum({_COUNT.format('pred')}), 0) AS pper, CAST(sum(ops) AS BIGINT) AS ops FROM ({_FLAT}) GROUP BY dataset"))
def pper(spark: SparkSession, d: str) -> DataFrame:
    """Repair operations over layout markers of the predictions."""
    marks = F.char_length(T.keep_tokens(F.col("pred"), "".join(_P) + "".join(_P.values())))
    x = X.tagged(spark, d).select("dataset", L.flat_repair(F.col("pred"))["ops"].cast("bigint").alias("ops"), marks.cast("bigint").alias("n"))
    return x.groupBy("dataset").agg(ratio(F.col("ops"), F.col("n")).alias("pper"), F.sum("ops").alias("ops"))


@_q()
def repair_tree(spark: SparkSession, d: str) -> DataFrame:
    return L.repaired(X.tagged(spark, d).select("record_id", "pred"), "record_id", "pred", L.READ)


@_q()
def repair_acts(spark: SparkSession, d: str) -> DataFrame:
    return L.repaired(X.tagged(spark, d).select("record_id", T.to_single(F.col("pred")).alias("pred")), "record_id", "pred", L.ACTS)


def _each(spark: SparkSession, d: str, col: str) -> DataFrame:
    """record_id, class, pos, content, conf: the regions of a text by class, with a confidence that depends on record and place."""
    of = lambda b: lambda x, i: F.struct(F.lit(b).alias("class"), i.cast("int").alias("pos"), x.alias("content"))
    found = F.flatten(F.array(*(F.transform(T.regions(F.col(col), b, e), of(b)) for b, e in _P.items())))
    x = X.tagged(spark, d).select("record_id", F.explode(found).alias("r")).select("record_id", "r.*")
    return x.withColumn("conf", ((F.col("record_id") * 7 + F.col("pos") * 13) % 100) / 100.0)


def _sql_each(col: str) -> str:
    parts = [f"SELECT record_id, '{b}' AS class, unnest(rs) AS content, CAST(generate_subscripts(rs, 1) - 1 AS INTEGER) AS pos FROM (SELECT record_id, regexp_extract_all({col}, '{b}([^{e}]*){e}', 1) AS rs FROM q_tagged)" for b, e in _P.items()]
    return f"SELECT record_id, class, pos, content, ((record_id * 7 + pos * 13) % 100) / 100.0 AS conf FROM ({' UNION ALL '.join(parts)})"


@_q(X.with_sql(_sql_each("gt")))
def extract_regions(spark: SparkSession, d: str) -> DataFrame:
    return _each(spark, d, "gt")


@_q(X.with_sql(f"SELECT record_id, class, list(content ORDER BY conf DESC, pos) AS contents FROM ({_sql_each('pred')}) GROUP BY record_id, class"))
def regions_by_confidence(spark: SparkSession, d: str) -> DataFrame:
    """Regions of a text by falling confidence; equal ones stay in their order."""
    rows = F.array_sort(F.collect_list(F.struct((-F.col("conf")).alias("k"), "pos", "content")))
    return _each(spark, d, "pred").groupBy("record_id", "class").agg(rows.alias("r")).select("record_id", "class", F.transform("r", lambda r: r["content"]).alias("contents"))


@_q(X.with_sql(f"SELECT record_id, CAST(n + 1 AS INTEGER) AS nodes, CAST(greatest(2 * n - 1, 0) AS INTEGER) AS edges FROM (SELECT record_id, length(gt) - length(translate(gt, '{''.join(_P)}', '')) AS n FROM q_tagged)"))
def layout_graph_flat(spark: SparkSession, d: str) -> DataFrame:
    nodes, edges = L.flat_graph_size(F.col("gt"))
    return X.tagged(spark, d).select("record_id", nodes.cast("int").alias("nodes"), edges.cast("int").alias("edges"))


# nodes: the document and every marker; edges: one to the parent, and one to each elder sibling: of the same kind of level since the last marker of a higher one
_LEVEL = "CASE c WHEN 'ⓟ' THEN 1 WHEN 'ⓢ' THEN 2 WHEN 'ⓝ' THEN 2 WHEN 'ⓐ' THEN 3 WHEN 'ⓑ' THEN 3 END"
_GRAPH_SQL = f"""WITH m AS (SELECT record_id, i, lv FROM (SELECT record_id, i, {_LEVEL} AS lv FROM (SELECT record_id, unnest(string_split(gt, '')) AS c, generate_subscripts(string_split(gt, ''), 1) AS i FROM q_tagged WHERE gt <> '')) WHERE lv IS NOT NULL),
s AS (SELECT record_id, i, lv, sum(CASE WHEN lv = 1 THEN 1 ELSE 0 END) OVER w AS p, sum(CASE WHEN lv <= 2 THEN 1 ELSE 0 END) OVER w AS q FROM m WINDOW w AS (PARTITION BY record_id ORDER BY i)),
e AS (SELECT record_id, lv, count(*) OVER (PARTITION BY record_id, lv, CASE WHEN lv = 1 THEN 0 WHEN lv = 2 THEN p ELSE q END ORDER BY i) > 1 AS elder FROM s)
SELECT t.record_id, CAST(1 + coalesce(k.size, 0) AS BIGINT) AS size FROM q_tagged t LEFT JOIN (SELECT record_id, 2 * count(*) + count_if(elder) AS size FROM e GROUP BY record_id) k USING (record_id)"""


@_q(X.with_sql("SELECT * FROM (" + _GRAPH_SQL + ")"))
def layout_graph(spark: SparkSession, d: str) -> DataFrame:
    """Size of each record's graph under the tree grammar."""
    x = X.tagged(spark, d).select("record_id", "gt", F.lit("").alias("pred"))
    return L.loer_rows(x, "record_id", L.READ).select("record_id", "size")


def _loer_rows(spark: SparkSession, d: str) -> DataFrame:
    """dataset, name, edits, size, exact of the records of all data sets that have a layout, predictions repaired first."""
    x = X.tagged(spark, d).select("dataset", F.col("record_id").cast("string").alias("name"), "gt", "pred", F.array().cast("array<double>").alias("conf"))
    rows = V.layout_rows(x).where("metric in ('loer', 'bounded')").groupBy("dataset", "name")
    return rows.agg(F.sum(F.when(F.col("metric") == "loer", F.col("part"))).alias("edits"), F.sum(F.when(F.col("metric") == "loer", F.col("whole"))).alias("size"), (F.sum(F.when(F.col("metric") == "bounded", F.col("part"))) == 0).alias("exact"))


@_q()
def loer(spark: SparkSession, d: str) -> DataFrame:
    """Layout error: graph edits over nodes and edges of the truth, by data set; how many rows have only an upper bound is told."""
    return _loer_rows(spark, d).groupBy("dataset").agg(ratio(F.col("edits"), F.col("size")).alias("loer"), F.sum((~F.col("exact")).cast("bigint")).alias("bounded"))


@_q()
def loers(spark: SparkSession, d: str) -> DataFrame:
    """Layout error of each record."""
    return _loer_rows(spark, d).select("dataset", F.col("name").cast("bigint").alias("record_id"), F.round(F.col("edits") / F.greatest(F.col("size"), F.lit(1.0)), 3).alias("loer"))


def ap_rows(spark: SparkSession, d: str) -> DataFrame:
    """record_id, class, threshold (per cent), ap, weight: of the classes that the truth has."""
    of = lambda col: _each(spark, d, col).groupBy("record_id", "class").agg(F.array_sort(F.collect_list(F.struct((-F.col("conf")).alias("k"), "pos", "content"))).alias("r"))
    t = _each(spark, d, "gt").groupBy("record_id", "class").agg(F.array_sort(F.collect_list(F.struct("pos", "content"))).alias("t"))
    x = t.join(of("pred"), ["record_id", "class"], "left")
    plain = lambda c: F.translate(c, X.MARKS, "")
    x = x.select("record_id", "class", F.transform("t", lambda r: plain(r["content"])).alias("t"), F.coalesce(F.transform("r", lambda r: plain(r["content"])), F.array().cast("array<string>")).alias("p"))
    return L.ap_table(x)


@_q()
def map_cer(spark: SparkSession, d: str) -> DataFrame:
    """Mean over thresholds, weighted by regions within and over records: all in all the sum of AP times weight over the weights."""
    return ap_rows(spark, d).agg(F.round(F.coalesce(F.sum(F.col("ap") * F.col("weight")) / F.sum("weight"), F.lit(0.0)), 6).alias("map_cer"))


@_q()
def map_cer_per_class(spark: SparkSession, d: str) -> DataFrame:
    w = F.greatest(F.col("weight").cast("double"), F.lit(0.1))
    return ap_rows(spark, d).groupBy("class").agg(F.round(F.sum(F.col("ap") * w) / F.sum(w), 6).alias("map_cer"))


@_q()
def precision_per_class_threshold(spark: SparkSession, d: str) -> DataFrame:
    return ap_rows(spark, d).groupBy("class", "threshold").agg(F.round(F.sum(F.col("ap") * F.col("weight")) / F.sum("weight"), 6).alias("precision"))


_PR = f"""SELECT class, region_id, p, r, max(p) OVER (PARTITION BY class, lang ORDER BY k ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS best, r - coalesce(lag(r) OVER (PARTITION BY class, lang ORDER BY k), 0) AS gain FROM (
SELECT class, lang, region_id, k, sum(c) OVER w / k AS p, sum(c) OVER w / count(*) OVER (PARTITION BY class, lang) AS r FROM (
SELECT class, lang, region_id, CASE WHEN region_id % 3 = 0 THEN 1 ELSE 0 END AS c, row_number() OVER (PARTITION BY class, lang ORDER BY (region_id * 7) % 101, region_id) AS k FROM q_pairs) WINDOW w AS (PARTITION BY class, lang ORDER BY k ROWS UNBOUNDED PRECEDING))"""


@_q(X.with_sql(_PR))
def precision_recall_curve(spark: SparkSession, d: str) -> DataFrame:
    """Running precision and recall of ranked regions, the best precision from there on, and the gain in recall.

    A class may be a third of all rows: ranks and running values, forth and back, are worked out in blocks."""
    by = ["class", "lang"]
    x = X.pairs(spark, d).select(*by, "region_id", F.when(F.col("region_id") % 3 == 0, 1).otherwise(0).alias("c"), ((F.col("region_id") * 7) % 101).alias("o"))
    x = group_rank(x, by, ["o", "region_id"])
    n = x.groupBy(*by).agg(F.count("*").alias("n"))  # a row for each class and language
    x = running(x, by, {"s": ("sum", F.col("c"))}).join(n, by)
    x = x.withColumns({"p": F.col("s") / F.col("k"), "r": F.col("s") / F.col("n"), "back": F.col("n") - F.col("k") + 1})
    x = running(x, by, {"best": ("max", F.col("p"))}, k="back")
    return x.select("class", "region_id", "p", "r", "best", (F.col("r") - (F.col("s") - F.col("c")) / F.col("n")).alias("gain"))


@_q(X.with_sql(f"SELECT record_id, class, {X.sql_edits(_CHARS.format('a'), _CHARS.format('b'))} AS edits, CAST(length(a) AS BIGINT) AS n FROM (SELECT record_id, class, string_agg(content, '' ORDER BY pos) AS a, coalesce(any_value(b), '') AS b FROM ({_sql_each('gt')}) g LEFT JOIN (SELECT record_id, class, string_agg(content, '' ORDER BY pos) AS b FROM ({_sql_each('pred')}) GROUP BY record_id, class) p USING (record_id, class) GROUP BY record_id, class)"))
def class_concat_edit(spark: SparkSession, d: str) -> DataFrame:
    """Edits between all strings of a class put together, by record."""
    joined = lambda col, name: _each(spark, d, col).groupBy("record_id", "class").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "content"))), lambda r: r["content"]), "").alias(name))
    x = joined("gt", "a").join(joined("pred", "b"), ["record_id", "class"], "left").withColumn("b", F.coalesce("b", F.lit("")))
    return x.select("record_id", "class", char_edits(F.col("a"), F.col("b")).alias("edits"), F.char_length("a").cast("bigint").alias("n"))


_SUITE = f"""SELECT dataset, count(*) AS nb_docs, sum(e) / nullif(sum(n), 0) AS cer, sum(ops) / nullif(sum(marks), 0) AS pper FROM (
SELECT dataset, {X.sql_edits(_CHARS.format('a'), _CHARS.format('b'))} AS e, length(a) AS n, ops, marks FROM (
SELECT t.dataset, {_sql_cer('t.gt', X.MARKS)} AS a, {_sql_cer('t.pred', X.MARKS)} AS b, f.ops, {_COUNT.format('t.pred')} AS marks FROM q_tagged t JOIN ({_FLAT}) f USING (record_id))) GROUP BY dataset"""


@_q(X.with_sql(_SUITE))
def metric_suite(spark: SparkSession, d: str) -> DataFrame:
    """Several metrics by corpus from one pass over the pairs: row expressions first, then one aggregate."""
    a, b = T.cer_normalise(F.col("gt"), X.MARKS), T.cer_normalise(F.col("pred"), X.MARKS)
    marks = F.char_length(T.keep_tokens(F.col("pred"), "".join(_P) + "".join(_P.values())))
    x = X.tagged(spark, d).select("dataset", a.alias("a"), b.alias("b"), L.flat_repair(F.col("pred"))["ops"].cast("bigint").alias("ops"), marks.cast("bigint").alias("marks"))
    x = x.withColumn("e", char_edits(F.col("a"), F.col("b"))).withColumn("n", F.char_length("a").cast("bigint"))
    return x.groupBy("dataset").agg(F.count("*").alias("nb_docs"), ratio(F.col("e"), F.col("n")).alias("cer"), ratio(F.col("ops"), F.col("marks")).alias("pper"))


def flagship(spark: SparkSession, d: str) -> DataFrame:
    """CER and WER by language."""
    return row_rates(spark, d).groupBy("lang").agg(F.count("*").alias("nb_docs"), ratio(F.col("edits"), F.col("n")).alias("cer"), ratio(F.col("word_edits"), F.col("n_words")).alias("wer"))
