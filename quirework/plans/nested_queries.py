"""Queries of problem 1."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quirework.operators.nested import all_labels, distinct_nodes, nodes
from quirework.sources.tables import table


def _all(spark: SparkSession, d: str) -> DataFrame:
    return all_labels(table(spark, d, "label_records"), table(spark, d, "label_dumps"))


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    return distinct_nodes(_all(spark, d), ()).where("level <> 'record'").select("record_id", "level", "page_pos", "par_pos", "line_pos")


def p1_records(spark: SparkSession, d: str) -> DataFrame:
    """The records, with the post-order number that all their nodes lie below."""
    n = nodes(_all(spark, d)).where("level = 'record'").dropDuplicates(["record_id"])
    return n.select("record_id", "pre", "post", "text", F.col("kind").alias("dataset"), "nb_cols")


def p1_pages(spark: SparkSession, d: str) -> DataFrame:
    n = distinct_nodes(_all(spark, d)).where("level = 'page'")
    return n.select("record_id", "pre", "post", "page_pos", "text", "side", "nb_cols", "page_width", "l", "t", "r", "b")


def p1_paragraphs(spark: SparkSession, d: str) -> DataFrame:
    n = distinct_nodes(_all(spark, d)).where("level = 'paragraph'")
    return n.select("record_id", "pre", "post", "page_pre", "page_pos", "par_pos", "text", "kind", "l", "t", "r", "b")


def p1_lines(spark: SparkSession, d: str) -> DataFrame:
    n = distinct_nodes(_all(spark, d)).where("level = 'line'")
    return n.select("record_id", "pre", "post", F.col("par_pre").alias("paragraph_pre"), "page_pos", "par_pos", "line_pos", "text", "l", "t", "r", "b")


QUERIES = {f.__name__: f for f in (p1_found, p1_records, p1_pages, p1_paragraphs, p1_lines)}


def _many(x: str, key: str) -> str:
    """Elements under a key: of an array, or the lone one."""
    v = f"json_extract({x}, '$.{key}')"
    return f"CASE WHEN {v} IS NULL OR json_type({v}) = 'NULL' THEN [] WHEN json_type({v}) = 'ARRAY' THEN json_extract({v}, '$[*]') ELSE [{v}] END"


def _each(source: str, key: str, keep: str, pos: str) -> str:
    rest = "* EXCLUDE (x, xs)"
    return f"SELECT * FROM (SELECT {rest}, unnest(xs) AS x, CAST(generate_subscripts(xs, 1) - 1 AS INTEGER) AS {pos} FROM (SELECT *, {_many('x', key)} AS xs FROM {source})) WHERE json_type(x) IN ({keep})"


_OBJECT, _LINE = "'OBJECT'", "'OBJECT', 'VARCHAR'"
_ONCE = f"""WITH j AS (
SELECT record_id, to_json(label) AS x FROM label_records
UNION ALL SELECT record_id, x FROM (SELECT record_id, CASE WHEN json_valid(payload) THEN CAST(payload AS JSON) END AS x FROM label_dumps) WHERE json_type(x) IN ('OBJECT', 'VARCHAR')),
o AS (SELECT * FROM j WHERE json_type(x) = 'OBJECT'),
pages AS ({_each("o", "pages", _OBJECT, "page_pos")}),
pars AS (SELECT record_id, x, page_pos, par_pos FROM ({_each("pages", "paragraphs", _OBJECT, "par_pos")}) UNION ALL SELECT record_id, x, -1, par_pos FROM ({_each("o", "paragraphs", _OBJECT, "par_pos")})),
rows AS (SELECT record_id, x, page_pos, par_pos, line_pos FROM ({_each("pars", "lines", _LINE, "line_pos")}) UNION ALL SELECT record_id, x, -1, -1, line_pos FROM ({_each("o", "lines", _LINE, "line_pos")})),
every AS (SELECT record_id, 'page' AS level, page_pos, -1 AS par_pos, -1 AS line_pos, 1 AS depth, x FROM pages
UNION ALL SELECT record_id, 'paragraph', page_pos, par_pos, -1, CASE WHEN page_pos >= 0 THEN 2 ELSE 1 END, x FROM pars
UNION ALL SELECT record_id, 'line', page_pos, par_pos, line_pos, CASE WHEN page_pos >= 0 THEN 3 WHEN par_pos >= 0 THEN 2 ELSE 1 END, x FROM rows),
once AS (SELECT record_id, level, page_pos, par_pos, line_pos, any_value(depth) AS depth, any_value(x) AS x FROM every GROUP BY record_id, level, page_pos, par_pos, line_pos),
sized AS (SELECT *, CAST(row_number() OVER (PARTITION BY record_id ORDER BY CASE WHEN page_pos >= 0 THEN 0 WHEN par_pos >= 0 THEN 1 ELSE 2 END, page_pos, par_pos, line_pos) AS INTEGER) AS pre,
CASE level WHEN 'page' THEN count(*) OVER (PARTITION BY record_id, page_pos) WHEN 'paragraph' THEN count(*) OVER (PARTITION BY record_id, page_pos, par_pos) ELSE 1 END AS size FROM once),
n AS (SELECT *, CAST(pre + size - 1 - depth AS INTEGER) AS post FROM sized)"""
def _int(*of: str) -> str:
    """The first of these keys that is there, cut to a whole number."""
    return f"CAST(trunc(TRY_CAST(trim(coalesce({', '.join(of)})) AS DOUBLE)) AS INTEGER)"


_SIDES = (("l", "left"), ("t", "top"), ("r", "right"), ("b", "bottom"))


def _key(name: str, under: str = "") -> str:
    return f"x->>'$.{under}{name}'"


def _sides() -> str:
    return ", ".join(f"{_int(_key(name), _key(k))} AS {k}" for k, name in _SIDES)


def _par_sides() -> str:
    return ", ".join(f"coalesce({_int(_key(name, 'coords.'), _key(k, 'coords.'))}, {_int(_key(name), _key(k))}) AS {k}" for k, name in _SIDES)


SQL = {
    "p1_found": _ONCE + " SELECT record_id, level, page_pos, par_pos, line_pos FROM n",
    "p1_records": _ONCE + f""" SELECT record_id, 0 AS pre, CAST(count(pre) AS INTEGER) AS post, any_value(text) AS text, any_value(dataset) AS dataset, any_value(nb_cols) AS nb_cols FROM (
SELECT record_id, any_value(CASE WHEN json_type(x) = 'VARCHAR' THEN x->>'$' ELSE x->>'$.text' END) AS text, any_value(x->>'$.dataset') AS dataset, any_value({_int(_key('nb_cols'))}) AS nb_cols FROM j GROUP BY record_id) LEFT JOIN (SELECT record_id, pre FROM n) USING (record_id) GROUP BY record_id""",
    "p1_pages": _ONCE + f" SELECT record_id, pre, post, page_pos, x->>'$.text' AS text, x->>'$.side' AS side, {_int(_key('nb_cols'))} AS nb_cols, {_int(_key('page_width'))} AS page_width, {_sides()} FROM n WHERE level = 'page'",
    "p1_paragraphs": _ONCE + f" SELECT p.record_id, p.pre, p.post, g.pre AS page_pre, p.page_pos, p.par_pos, p.text, p.kind, p.l, p.t, p.r, p.b FROM (SELECT *, x->>'$.label' AS text, coalesce(x->>'$.type', x->>'$.region_type', x->>'$.mode') AS kind, {_par_sides()} FROM n WHERE level = 'paragraph') p LEFT JOIN (SELECT record_id, page_pos, pre FROM n WHERE level = 'page') g ON p.record_id = g.record_id AND p.page_pos = g.page_pos",
    "p1_lines": _ONCE + f" SELECT p.record_id, p.pre, p.post, g.pre AS paragraph_pre, p.page_pos, p.par_pos, p.line_pos, p.text, p.l, p.t, p.r, p.b FROM (SELECT *, CASE WHEN json_type(x) = 'VARCHAR' THEN x->>'$' ELSE x->>'$.text' END AS text, {_sides()} FROM n WHERE level = 'line') p LEFT JOIN (SELECT record_id, page_pos, par_pos, pre FROM n WHERE level = 'paragraph') g ON p.record_id = g.record_id AND p.page_pos = g.page_pos AND p.par_pos = g.par_pos",
}
