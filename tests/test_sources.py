"""Sources and sinks on small files, evaluation by name, settings."""

import io
import struct
import tarfile
import zipfile
import zlib
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from quirework.functions.maps import deep_merge, merge_maps
from quirework.operators import entities as N
from quirework.operators import evaluation as V
from quirework.operators import layout as L
from quirework.sources import files, pages, sinks
from quirework.streaming import metrics as M

PAGE = """<?xml version="1.0"?>
<pc:PcGts xmlns:pc="urn:x"><pc:Page imageFilename="a.jpg" imageWidth="100" imageHeight="50">
<pc:TextRegion id="r1"><pc:Coords points="9,8 1,2 5,20"/>
<pc:TextLine id="l1"><pc:Coords points="1,2 9,8"/><pc:Baseline points="2,7 8,7"/><pc:TextEquiv><pc:Unicode>Anna  &amp; Co</pc:Unicode></pc:TextEquiv></pc:TextLine>
<pc:TextLine id="l2"><pc:Coords points="1,9 9,20"/><pc:TextEquiv><pc:Unicode></pc:Unicode></pc:TextEquiv></pc:TextLine>
<pc:TextLine id="l3"><pc:Coords points="1,9 9,20"/><pc:TextEquiv><pc:Unicode></pc:Unicode></pc:TextEquiv></pc:TextLine></pc:TextRegion>
<pc:TextRegion id="r2"><pc:Coords points="0,0 1,1"/></pc:TextRegion></pc:Page></pc:PcGts>"""


def test_page_xml(spark, tmp_path):
    (tmp_path / "a.xml").write_text(PAGE)
    (tmp_path / "b.xml").write_text("<broken")
    (row,) = pages.read_page_xml(spark, str(tmp_path), {"l3": "16"}).collect()
    assert (row.file, row.region_id, row.label, row.page_width) == ("a.xml", "r1", "Anna & Co\n16", 100)
    assert tuple(row.coords) == (1, 2, 9, 20) and [x.id for x in row.lines] == ["l1", "l3"]
    assert tuple(row.base) == (1, 7, 9, 20)


def test_letters(spark):
    xml = '<letter><source>s</source><box top_left_x="1" top_left_y="2" bottom_right_x="3" bottom_right_y="4"><type>Objet</type><text>¤{un/deux}¤  Ã©tÃ©</text></box><box top_left_x="1" top_left_y="2" bottom_right_x="3" bottom_right_y="4"><type>x</type><text> </text></box></letter>'
    out = pages.letters(spark.createDataFrame([(xml,)], "value string"), {"other": "x"}).collect()
    assert [(r.pos, r.text) for r in out] == [(0, "un été")]


def _png(height, width, rows):
    raw = b"".join(b"\x00" + bytes(r) for r in rows)
    part = lambda kind, data: struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))
    return b"\x89PNG\r\n\x1a\n" + part(b"IHDR", struct.pack(">IIBBBBB", width, height, 8, 0, 0, 0, 0)) + part(b"IDAT", zlib.compress(raw)) + part(b"IEND", b"")


def test_images_and_archives(spark, tmp_path):
    folder = tmp_path / "images"
    folder.mkdir()
    (folder / "a.png").write_bytes(_png(2, 3, [[0, 51, 102], [153, 204, 255]]))
    (folder / "b.png").write_bytes(b"no image")
    images = files.read_images(spark, str(folder))
    (row,) = files.prepared_images(images, [51.0], [51.0], 3, 4, -9.0).collect()
    assert (row.height, row.width) == (3, 4) and row["values"] == [-1, 0, 1, -9, 2, 3, 4, -9, -9, -9, -9, -9]
    with zipfile.ZipFile(tmp_path / "x.zip", "w") as z:
        z.writestr("d/one.txt", "1")
        z.writestr("two.txt", "2")
    with tarfile.open(tmp_path / "y.tar.gz", "w:gz") as t:
        info = tarfile.TarInfo("three.txt")
        info.size = 1
        t.addfile(info, io.BytesIO(b"3"))
    (tmp_path / "z.zip").write_bytes(b"broken")
    got = files.archive_members(spark, str(tmp_path / "*.*")).collect()
    assert sorted((r.member, bytes(r.content)) for r in got) == [("d/one.txt", b"1"), ("three.txt", b"3"), ("two.txt", b"2")]


def test_stored_things(spark, tmp_path):
    folder = str(tmp_path / "runs")
    assert files.latest(spark, folder, "best_") is None and files.keep_latest(spark, folder, "best_") is None
    assert files.save_params(spark, folder, {"a": 1}).endswith("params.json") and files.save_params(spark, folder, {"a": 2}).endswith("params_1.json")
    for n in ("best_2.pt", "best_10.pt", "last_99.pt"):
        (tmp_path / "runs" / n).write_text("")
    assert files.keep_latest(spark, folder, "best_").endswith("best_10.pt")
    assert sorted(p.name for p in (tmp_path / "runs").iterdir() if not p.name.startswith(".")) == ["best_10.pt", "last_99.pt", "params.json", "params_1.json"]


def test_sinks_and_corpora(spark, tmp_path):
    df = spark.createDataFrame([("a/1", 'x "y"\n'), ("b", None)], "name string, pred string")
    sinks.write_predictions(df, str(tmp_path / "p"))
    assert sorted(map(tuple, sinks.read_predictions(spark.read.text(str(tmp_path / "p"))).collect()), key=str) == [("a/1", 'x "y"\n'), ("b", None)]
    sinks.write_metrics(spark.createDataFrame([("d", "cer", 0.5), (None, "cer", 0.1)], "dataset string, metric string, value double"), str(tmp_path / "m"))
    assert sorted(r.value for r in spark.read.text(str(tmp_path / "m" / "text")).collect()) == ["d: cer=0.5", "none: cer=0.1"]
    sinks.write_pages(df, str(tmp_path / "s"))
    assert spark.read.json(str(tmp_path / "s")).where("split = 'train'").count() == 2
    (tmp_path / "one.txt").write_text("a*b\n\nc\n")
    (tmp_path / "two.txt").write_text("d\n")
    rows = files.text_corpus(spark, {str(tmp_path / "one.txt"): 1, str(tmp_path / "two.txt"): 3}).collect()
    assert sorted((r.source, r.weight, r.text) for r in rows) == [("one", 0.25, "ab"), ("one", 0.25, "c"), ("two", 0.75, "d")]
    with pytest.raises(ValueError):
        files.text_corpus(spark, {})


def test_settings(spark):
    base, over = {"a": {"x": 1, "y": {"z": 1}}, "b": 1}, {"a": {"y": {"w": 2}, "x": None}, "c": {"d": 1}}
    assert deep_merge(base, over) == {"a": {"x": None, "y": {"z": 1, "w": 2}}, "b": 1, "c": {"d": 1}} and base["a"]["y"] == {"z": 1}
    made = deep_merge({}, over)
    made["c"]["d"] = 2
    assert over["c"]["d"] == 1
    x = spark.range(1).select(F.expr("map('s', map('a', 1, 'b', 1), 't', map('c', 1))").alias("l"), F.expr("map('s', map('b', 2), 'u', map('d', 2))").alias("r"))
    assert x.select(merge_maps(F.col("l"), F.col("r")).alias("m")).first().m == {"s": {"a": 1, "b": 2}, "t": {"c": 1}, "u": {"d": 2}}


def test_evaluation(spark):
    assert V.layout_of("READ_2016").grammar is L.READ and V.layout_of(None) is None and V.metrics_of(None) == ("cer", "wer") and "cer-ner" in V.metrics_of("IAM_NER")
    assert V.flat_repair_at("ⓑaⓞbⒷ") == ("ⓑaⒷⓞbⓄ", 3, [0, 1, -1, 2, 3, -1])
    text, ops, conf = V.repaired_with("ⓑaⓞbⒷ", [0.1, 0.2, 0.3, 0.4, 0.5], V.LAYOUTS["rimes"])
    assert (text, ops, conf) == ("ⓑaⒷⓞbⓄ", 3, [0.1, 0.2, 0.0, 0.3, 0.4, 0.0])
    assert V.regions_of("ⓑaⒷⓑbⒷⓑc", "ⓑ", "Ⓑ", [0.1, 0, 0.1, 0.9, 0, 0.1, 0, 0]) == ["b", "a"]
    truths = spark.createDataFrame([("RIMES", "r1", "ⓑabcdⒷ"), ("RIMES", "r2", "ⓞxⓄ"), (None, "n", "ab")], "dataset string, name string, gt string")
    preds = spark.createDataFrame([("r1", "ⓑabcd", [1.0] * 5), ("n", "a", None), ("other", "q", None)], "name string, pred string, conf array<double>")
    both = V.matched(truths, preds)
    assert sorted((r.name, r.missing) for r in both.collect()) == [("n", False), ("r1", False), ("r2", True)]
    got = {(r.dataset, r.metric): r.value for r in V.evaluated(both, "ⓑⒷⓞⓄ").collect()}
    assert got[None, "cer"] == 0.5 and got["RIMES", "cer"] == 0.2 and got["RIMES", "pper"] == 1.0 and got["RIMES", "map_cer"] == 0.5
    assert (None, "loer") not in got and ("RIMES", "cer-ner") not in got
    assert V.evaluated(both.limit(0), "ⓑ").count() == 0
    V.register_layout("mine", V.Layout(L.ACTS, False), ("cer",))
    try:
        assert V.layout_of("My_Mine").grammar is L.ACTS and V.metrics_of("mine") == ("cer",)
    finally:
        del V.LAYOUTS["mine"], V.METRICS["mine"]


def test_entities_by_confidence(spark):
    assert N.tagged_runs("Anna✻ Lee✻, Rom✼ Tom✻", "✻", "✻✼", None) == ["Anna Lee", "Tom"]
    assert N.tagged_runs("Tom✻, Anna✻", "✻", "✻✼", [0.1] * 6 + [0.9] * 6) == ["Anna", "Tom"]
    df = spark.createDataFrame([(1, "Tom✻ x", "Tom✻ x", None), (2, None, None, None)], "id bigint, gt string, pred string, conf array<double>")
    rows = N.entity_ap(df.withColumn("conf", F.array_repeat(F.lit(0.5), 6)), "id", {"PER": "✻", "LOC": "✼"}).collect()
    assert {(r.id, r.tag, r.ap, r.weight) for r in rows} == {(1, "PER", 1.0, 1)} and len(rows) == 10
    N.register_bio(spark, "✻")
    assert [tuple(r) for r in spark.sql("SELECT * FROM bio_words('Anna✻ Lee✻ x')").collect()] == [(0, "Anna", "B-✻"), (1, "Lee", "I-✻"), (2, "x", "O")]


def test_late_and_joined_streams(spark, tmp_path):
    kind = "event_id long, user_id long, event_type string, ts timestamp"
    rows = lambda *x: spark.createDataFrame([(i, u, t, datetime(2024, 1, 1, h, m)) for i, u, t, h, m in x], kind)
    path = str(tmp_path / "events.parquet")
    rows((1, 1, "a", 10, 0), (2, 1, "b", 10, 5), (3, 1, "b", 12, 0)).coalesce(1).write.parquet(path)
    rows((4, 1, "a", 10, 30), (5, 1, "b", 6, 0), (6, 1, "b", 12, 30)).coalesce(1).write.mode("append").parquet(path)
    stream = lambda: M.event_stream(spark, path + "/*.parquet")
    assert M.drained(M.first_of_hour(stream()), "append").count() >= 4
    got = {tuple(r) for r in M.drained(M.followed(stream().where("event_type = 'a'"), stream().where("event_type = 'b'"), "10 minutes"), "append").collect()}
    assert got == {(1, 2)}
