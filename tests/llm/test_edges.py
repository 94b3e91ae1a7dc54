"""Every query of the problems over tables of odd rows, and over empty ones."""

import os
from datetime import datetime

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quirework.llm import registry

FOLDER = os.environ.get("QUIREWORK_TESTDATA", "/root/testdata/sf0.001")
TABLES = ("label_records", "label_charsets", "samples", "text_regions", "documents")
#: Names that the operators use themselves; the tables get them as further columns.
CLASHES = ("salt", "look", "own", "phrase", "host", "window", "shard", "norm", "cls", "unit", "slice", "word", "bucket", "items", "text_")
LONG = "Ein langer Satz über nichts. " * 20_000
NOW = datetime(2024, 1, 1)


def _write(spark, folder, name, rows):
    schema = spark.read.parquet(f"{FOLDER}/{name}.parquet").schema
    given = [[r.get(f.name) for f in schema.fields] for r in rows]
    df = spark.createDataFrame(given, T.StructType([T.StructField(f.name, f.dataType) for f in schema.fields]))
    for c in CLASHES:
        if c not in df.columns:
            df = df.withColumn(c, F.lit("clash"))
    df.coalesce(1).write.mode("overwrite").parquet(f"{folder}/{name}.parquet")


def _label(spark, text, **more):
    kind = spark.read.parquet(f"{FOLDER}/label_records.parquet").schema["label"].dataType
    return tuple({"text": text, **more}.get(f.name) for f in kind.fields)


@pytest.fixture(scope="module")
def odd(spark, tmp_path_factory):
    if not os.path.exists(FOLDER):
        pytest.skip("no test tables")
    folder = str(tmp_path_factory.mktemp("odd"))
    label = lambda t: _label(spark, t)
    texts = [None, "", " ", "ⓟⓑⒷⓅ", "abc", "abc", "Über Zürich", "Ãœber ZÃ¼rich", "Über Zürich, Über Zürich", LONG, "а́ Ꭺ", "​", LONG + "x", "x" * 5000]
    records = [{"record_id": k, "split": ["train", "valid", "test", None][k % 4], "label": label(t), "loaded_at": NOW} for k, t in enumerate(texts)]
    records += [records[4], records[9], {"record_id": 90, "split": "train", "label": None}, {"record_id": None, "split": "test", "label": label("abc")}, {"record_id": 91, "split": "other", "label": label("abc")}]
    _write(spark, folder, "label_records", records)
    _write(spark, folder, "label_charsets", [{"charset_id": 1, "dataset": "d", "version": 1, "charset": ["a", "а", None, "", "é", "é", "ab"]}, {"charset_id": 2, "charset": None}, {"charset_id": None, "charset": ["z"]}])
    samples = [{"sample_id": k, "record_id": k % 17, "source": ["s", None][k % 2], "lang": ["FR", "fr-CH", None, ""][k % 4], "domain": "d", "dataset": None, "loaded_at": NOW} for k in range(40)]
    _write(spark, folder, "samples", [*samples, samples[3], {"sample_id": None, "record_id": 4}, {"sample_id": 99, "record_id": None}, {"sample_id": 98, "record_id": 7777}])
    regions = [{"region_id": k, "label": t} for k, t in enumerate(texts)]
    _write(spark, folder, "text_regions", [*regions, regions[7], {"region_id": None, "label": "ZÃ¼rich"}])
    docs = [{"doc_id": k, "text": t, "source": ["a", None, "b"][k % 3], "url": [None, "http://h.example/x", "no url", ""][k % 4]} for k, t in enumerate([*texts, *["wax seals, ink"] * 30])]
    _write(spark, folder, "documents", [*docs, docs[9], {"doc_id": 500, "text": "#tag " * 100_000}])
    return folder


@pytest.fixture(scope="module")
def empty(spark, tmp_path_factory):
    if not os.path.exists(FOLDER):
        pytest.skip("no test tables")
    folder = str(tmp_path_factory.mktemp("empty"))
    for name in TABLES:
        _write(spark, folder, name, [])
    return folder


@pytest.mark.parametrize("name", sorted(registry.queries()))
def test_odd_rows(spark, odd, name):
    rows = registry.queries()[name](spark, odd).collect()
    keys = {
        "p7_ids": lambda: sorted(r.doc_id for r in rows)[-1] == 500 and all(r.ids == [] for r in rows if r.doc_id in (0, 1)),
        "p7_round_trip": lambda: all(r.same for r in rows),
        "p8_faults": lambda: True,
        "p8_containers": lambda: max(r.n_tokens for r in rows) == 2048 and {r.doc_id for r in rows} >= {0, 1, 500},
        "p9_found": lambda: 500 in {r.doc_id for r in rows} and len(rows) == len({r.doc_id for r in rows}),
        "p5_found": lambda: {("label_records", 7), ("text_regions", 7)} <= {(r.place, r.item_id) for r in rows},
        "p2_found": lambda: ("charset", 1, 0, 1) in {tuple(r) for r in rows} and ("charset", 1, 4, 5) in {tuple(r) for r in rows},
        "p4_found": lambda: {(4, 5), (9, 12)} <= {(r.record_a, r.record_b) for r in rows},
        "p6_found": lambda: ("word", "abc") not in {(r.kind, r.term) for r in rows if r.mark == "rare"},
    }
    assert keys.get(name, lambda: True)(), rows[:5]


@pytest.mark.parametrize("name", sorted(registry.queries()))
def test_empty_tables(spark, empty, name):
    rows = registry.queries()[name](spark, empty).collect()
    assert len(rows) == (1 if name == "p8_faults" else 0)
