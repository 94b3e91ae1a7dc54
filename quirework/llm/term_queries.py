"""Queries of problem 6 and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quirework.llm.terms import TermCounts, changes, marked
from quirework.session import staged
from quirework.sources.tables import table


def _entries(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "label_charsets").select(F.explode("charset").alias("term")).where("term <> ''").distinct()


def _known(entries: DataFrame) -> tuple[str, ...]:
    return tuple(sorted(r.term for r in entries.collect()))  # label_charsets is a table of fixed size


def _counted(spark: SparkSession, d: str) -> DataFrame:
    """All terms with their counts, as the store has them after two steps: the records of the train split first, then what changed to the whole table."""
    rows = table(spark, d, "label_records").select("record_id", "split", F.col("label.text").alias("text"))
    entries = _entries(spark, d)
    whole = rows.groupBy("record_id").agg(F.first("text").alias("text"), F.max(F.coalesce(F.col("split") == "train", F.lit(False))).alias("first"))
    whole = staged(whole, "records")
    first = whole.where("first").select("record_id", "text")
    counts = TermCounts(spark, entries=_known(entries)).apply(new=first)
    gone, new = changes(first, whole.select("record_id", "text"))
    return marked(TermCounts(spark, counts.folder).apply(new=new, gone=gone).counts(), entries)


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    return _counted(spark, d).where("mark is not null").select("kind", "term", "mark")


def p6_counts(spark: SparkSession, d: str) -> DataFrame:
    return _counted(spark, d)


_COUNTS = r"""
WITH r AS (SELECT record_id, any_value(label.text) AS text FROM label_records GROUP BY record_id),
n AS (SELECT count(*) AS n FROM r),
w AS (SELECT record_id, unnest(regexp_extract_all(text, '[^ \t\n\rⒶ-ⓩ]+')) AS term FROM r),
e AS (SELECT DISTINCT term FROM (SELECT unnest(charset) AS term FROM label_charsets) WHERE term <> ''),
counts AS (
  SELECT 'word' AS kind, term, count(*) AS occurrences, count(DISTINCT record_id) AS records FROM w GROUP BY term
  UNION ALL
  SELECT 'entry', e.term, coalesce(sum(CAST((strlen(text) - strlen(replace(text, e.term, ''))) / strlen(e.term) AS BIGINT)), 0), count(r.record_id) FROM e LEFT JOIN r ON contains(r.text, e.term) GROUP BY e.term
), marks AS (
  SELECT kind, term, CAST(occurrences AS BIGINT) AS occurrences, records,
    CASE WHEN records <= 1 THEN 'rare' WHEN records > (CASE kind WHEN 'entry' THEN 0.8 ELSE 0.2 END) * n THEN 'common' END AS mark FROM counts, n
)"""

QUERIES = {f.__name__: f for f in (p6_found, p6_counts)}
SQL = {
    "p6_found": _COUNTS + " SELECT kind, term, mark FROM marks WHERE mark IS NOT NULL",
    "p6_counts": _COUNTS + " SELECT kind, term, occurrences, records, mark FROM marks",
}
