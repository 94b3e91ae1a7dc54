"""The driver's contract, sources, streams, and ranks over partitions."""

import os

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from quirework.functions.rng import uniform
from quirework.operators.ordering import global_rank, group_rank, running, trailing
from quirework.sources import corpora as C
from quirework.streaming import metrics as M

FOLDER = os.environ.get("QUIREWORK_TESTDATA", "/root/testdata/sf0.001")


def test_contract():
    queries, sql = entry.queries(), entry.oracle_sql()
    assert len(queries) > 100 and set(sql) <= set(queries) and "p1_found" in queries


@pytest.mark.skipif(not os.path.exists(FOLDER), reason="no test tables")
@pytest.mark.parametrize("name", ["map_cer", "loer", "repair_tree", "reading_order_read", "ner_f1", "synth_pages", "xml_like_scan", "ext_sessions", "stream_metrics"])
def test_runs(spark, name):
    assert entry.queries()[name](spark, FOLDER).count() > 0


def test_rank(spark):
    x = spark.range(1000).select((F.col("id") * 7919 % 1000).alias("k")).repartition(7)
    rows = global_rank(x, ["k"]).collect()
    assert sorted((r.k, r["rank"]) for r in rows) == [(i, i + 1) for i in range(1000)]
    assert global_rank(x.limit(0), ["k"]).count() == 0


def test_windows_in_blocks(spark):
    """Ranks, trailing and running windows are the same however small the blocks are; groups of unequal size, a null group among them."""
    rows = [(None if k % 5 == 0 else "a" if k % 3 else "b", k, (k * 37) % 23) for k in range(200)]
    x = spark.createDataFrame(rows, "g string, id long, v long").repartition(5)
    ranked = group_rank(x, ["g"], ["id"])
    want = {}
    for g in (None, "a", "b"):
        own = sorted((k, v) for h, k, v in rows if h == g)
        for n, (k, v) in enumerate(own):
            want[k] = (n + 1, sum(y for _, y in own[max(0, n - 6) : n + 1]), min((y for _, y in own[:n]), default=None), sum(y for _, y in own[: n + 1]))
    laid, w = trailing(ranked, ["g"], 7, block=9)
    got = {r.id: (r.k, r.s) for r in laid.withColumn("s", F.sum("v").over(w)).where("_own").collect()}
    assert got == {k: v[:2] for k, v in want.items()}
    one = running(ranked, ["g"], {"least": ("min", F.col("v"))}, upto=-1, block=9)
    two = running(one, ["g"], {"sum": ("sum", F.col("v"))}, block=11)
    assert {r.id: (r.least, r["sum"]) for r in two.collect()} == {k: v[2:] for k, v in want.items()}
    assert running(group_rank(x.limit(0), ["g"], ["id"]), ["g"], {"m": ("max", F.col("v"))}).count() == 0


def test_uniform(spark):
    u = [r.u for r in spark.range(2000).select(uniform("id", seed=1).alias("u")).collect()]
    assert 0 <= min(u) and max(u) < 1 and abs(sum(u) / len(u) - 0.5) < 0.03


def test_sources(spark, tmp_path):
    lines = spark.createDataFrame([("# note",), ("",), ("a01-000-00 ok 154 1 408 768 27 51 A|MOVE|to|stop|.",), ("a01-000-01 ok",)], ["value"])
    got = {r.line_id: r for r in C.parse_lines(lines).collect()}
    assert got["a01-000-00"].text == "A MOVE to stop." and got["a01-000-00"].page_id == "a01-000" and got["a01-000-00"].box.r == 408 + 27
    assert got["a01-000-01"].box.l is None and got["a01-000-01"].text == ""
    tags = C.parse_entities(spark.createDataFrame([("w1 PER",), ("",), ("w2",)], ["value"])).collect()
    assert [(r.word_id, r.tag) for r in tags] == [("w1", "PER"), ("w2", None)]
    (tmp_path / "a.xml").write_text('<letter>\n<source>s</source><box top_left_x="1" top_left_y="2" bottom_right_x="3" bottom_right_y="4"><type>Objet</type><text>a &amp; b</text></box></letter>')
    row = C.read_letters(spark, str(tmp_path)).collect()
    assert [(r.source, r.text, r.l, r.b) for r in row] == [("s", "a & b", 1, 4)]


def test_stream_state(spark, tmp_path):
    for k in range(3):
        spark.createDataFrame([(i, ["x", "y"][i % 2], float(i + k)) for i in range(10)], "event_id long, event_type string, value double").coalesce(1).write.mode("append").parquet(str(tmp_path / "events.parquet"))
    out = {r.event_type: (r.n, r.total) for r in M.drained(M.rates(M.event_stream(spark, str(tmp_path / "events.parquet" / "*.parquet"))), "complete").collect()}
    assert out == {"x": (15, 75.0), "y": (15, 90.0)}
