"""Label records to flat tables, against a plain walk."""

import json
import os

import pytest
from pyspark.sql import functions as F

from quirework.operators import nested as N

FOLDER = os.environ.get("QUIREWORK_TESTDATA", "/root/testdata/sf0.001")


def walk(label, of_dump):
    """(level, page_pos, par_pos, line_pos) of a label, read straight from the JSON or the row."""
    many = lambda x: x if isinstance(x, list) else [] if x is None else [x]
    found = []

    def lines(xs, page, par):
        found.extend(("line", page, par, i) for i, x in enumerate(many(xs)) if isinstance(x, dict) or of_dump and isinstance(x, str))

    def pars(xs, page):
        for i, x in enumerate(many(xs)):
            if isinstance(x, dict):
                found.append(("paragraph", page, i, -1))
                lines(x.get("lines"), page, i)

    for i, x in enumerate(many(label.get("pages"))):
        if isinstance(x, dict):
            found.append(("page", i, -1, -1))
            pars(x.get("paragraphs"), i)
    pars(label.get("paragraphs"), -1)
    lines(label.get("lines"), -1, -1)
    return found


def parsed(payload):
    try:
        return json.loads(payload)
    except (TypeError, ValueError):
        return None


@pytest.mark.skipif(not os.path.exists(FOLDER), reason="no test tables")
def test_against_a_walk(spark):
    from quirework.plans.nested_queries import p1_found, p1_lines

    want = set()
    for r in spark.read.parquet(f"{FOLDER}/label_dumps.parquet").collect():
        x = parsed(r.payload)
        if isinstance(x, dict):
            want |= {(r.record_id, *k) for k in walk(x, True)}
    for r in spark.read.parquet(f"{FOLDER}/label_records.parquet").collect():
        if r.label:
            want |= {(r.record_id, *k) for k in walk(r.label.asDict(True), False)}
    got = [tuple(r) for r in p1_found(spark, FOLDER).collect()]
    assert len(got) == len(set(got)) and set(got) == want
    rows = p1_lines(spark, FOLDER).collect()
    assert len(rows) == len({k for k in want if k[1] == "line"})
    assert all((r.paragraph_pre is None) == (r.par_pos < 0) for r in rows)


def test_shapes(spark):
    payloads = [
        (1, json.dumps({"pages": {"paragraphs": {"lines": ["a", None, {"text": "b", "top": "7", "left": 1.0}]}}, "meta": {"lines": ["no"]}})),
        (2, '{"lines": ["cut'),
        (3, '"just text"'),
        (4, json.dumps([{"lines": ["x"]}])),
        (5, None),
        (6, json.dumps({"paragraphs": [None, {"label": "p", "coords": {"left": "3", "right": 9, "top": 1, "bottom": 2}}], "lines": "lone"})),
        (7, "{}"),
        (8, "7"),
    ]
    dumps = spark.createDataFrame(payloads, "record_id bigint, payload string").withColumn("label", F.lit("clash"))
    rows = N.distinct_nodes(N.parse_dumps(dumps)).collect()
    of = lambda k: sorted((r.level, r.page_pos, r.par_pos, r.line_pos) for r in rows if r.record_id == k)
    assert of(1) == sorted([("record", -1, -1, -1), ("page", 0, -1, -1), ("paragraph", 0, 0, -1), ("line", 0, 0, 0), ("line", 0, 0, 2)])
    assert of(2) == of(4) == of(5) == of(8) == []
    assert of(3) == of(7) == [("record", -1, -1, -1)]
    assert of(6) == sorted([("record", -1, -1, -1), ("paragraph", -1, 1, -1), ("line", -1, -1, 0)])
    line = next(r for r in rows if r.record_id == 1 and r.line_pos == 2)
    assert (line.text, line.t, line.l, line.b) == ("b", 7, 1, None)
    par = next(r for r in rows if r.record_id == 6 and r.level == "paragraph")
    assert (par.l, par.r, par.t, par.b) == (3, 9, 1, 2)
    # intervals: post = pre + size of the subtree - 1 - depth, descendants are contained
    page = next(r for r in rows if r.record_id == 1 and r.level == "page")
    assert all(page.pre < r.pre and r.post < page.post for r in rows if r.record_id == 1 and r.level in ("paragraph", "line"))


def test_empty(spark):
    dumps = spark.createDataFrame([], "record_id bigint, payload string")
    assert N.distinct_nodes(N.parse_dumps(dumps)).count() == 0
    n = N.distinct_nodes(N.parse_dumps(dumps))
    assert N.linked(n, n).count() == 0
