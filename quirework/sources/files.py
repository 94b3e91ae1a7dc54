"""Files as they lie: images, members of archives, lists of weighted corpus files; versions of stored things."""

from __future__ import annotations

import io
import json
import tarfile
import zipfile
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quirework.functions.text import corpus_clean


def read_images(spark: SparkSession, path: str) -> DataFrame:
    """path, height, width, channels and pixels (rows of blue, green, red or grey) of a folder's images; files that are none are left out."""
    x = spark.read.format("image").option("dropInvalid", True).load(path)
    return x.select(F.col("image.origin").alias("path"), F.col("image.height").alias("height"), F.col("image.width").alias("width"), F.col("image.nChannels").alias("channels"), F.col("image.data").alias("pixels"))


def prepared_images(images: DataFrame, mean: list[float], std: list[float], height: int | None = None, width: int | None = None, empty: float = 0.0) -> DataFrame:
    """path, height, width, values (float32, rows of channels) of images normalised by channel and filled up to a size at the right and below; larger ones keep their size."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[tuple] = []
            for path, h, w, c, data in zip(*(x.to_pylist() for x in batch.columns)):
                x = np.frombuffer(data, np.uint8).reshape(h, w, c).astype(np.float32)
                x = (x - np.asarray(mean[:c], np.float32)) / np.asarray(std[:c], np.float32)
                to = max(h, height or h), max(w, width or w)
                full = np.full((*to, c), empty, np.float32)
                full[:h, :w] = x
                out.append((path, *to, full.ravel().tolist()))
            cols = list(zip(*out)) or [()] * 4
            yield pa.RecordBatch.from_arrays([pa.array(a, k) for a, k in zip(cols, (pa.string(), pa.int32(), pa.int32(), pa.list_(pa.float32())))], ["path", "height", "width", "values"])

    return images.select("path", "height", "width", "channels", "pixels").mapInArrow(run, "path string, height int, width int, values array<float>")


def archive_members(spark: SparkSession, path: str) -> DataFrame:
    """archive, member, content of the files in zip and tar archives (also compressed), each archive read by one task; other files have no rows."""

    def members(data: bytes) -> Iterator[tuple[str, bytes]]:
        if zipfile.is_zipfile(io.BytesIO(data)):
            with zipfile.ZipFile(io.BytesIO(data)) as z:
                for info in z.infolist():
                    if not info.is_dir():
                        yield info.filename, z.read(info)
            return
        try:
            with tarfile.open(fileobj=io.BytesIO(data)) as t:
                for info in t:
                    if info.isfile():
                        yield info.name, t.extractfile(info).read()
        except tarfile.ReadError:
            return

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for place, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                for name, content in members(data):
                    yield pa.RecordBatch.from_arrays([pa.array([place]), pa.array([name]), pa.array([content], pa.binary())], ["archive", "member", "content"])

    files = spark.read.format("binaryFile").load(path)
    return files.select("path", "content").mapInArrow(run, "archive string, member string, content binary")


def text_corpus(spark: SparkSession, files: dict[str, float]) -> DataFrame:
    """source (file or folder name), weight (shares that sum to 1), line_no, text of text files, a line a row, cleaned; blank lines are left out."""
    total = sum(files.values())
    out = None
    for path, weight in files.items():
        name = path.rstrip("/").rsplit("/", 1)[-1].split(".")[0]
        x = spark.read.text(path).where(F.trim("value") != "").select(F.lit(name).alias("source"), F.lit(weight / total).alias("weight"), corpus_clean(F.col("value")).alias("text"))
        out = x if out is None else out.unionByName(x)
    if out is None:
        raise ValueError("no files are given")
    return out


def label_corpus(records: DataFrame, charset: str, source: str = "labels") -> DataFrame:
    """source, record_id, text of label records whose text has only characters of the charset (spaces and line feeds aside)."""
    allowed = F.translate("text", charset + " \n", "") == ""
    return records.where("text is not null and text <> ''").where(allowed).select(F.lit(source).alias("source"), "record_id", "text")


# ---- stored things


def _files(spark: SparkSession, folder: str) -> tuple[object, object]:
    place = spark._jvm.org.apache.hadoop.fs.Path(folder)
    return place, place.getFileSystem(spark._jsc.hadoopConfiguration())


def latest(spark: SparkSession, folder: str, prefix: str) -> str | None:
    """The newest file or folder whose name begins so, by the number at its end, then by time; None if there is none."""
    place, fs = _files(spark, folder)
    found = [(f.getPath().getName(), f.getModificationTime()) for f in fs.listStatus(place)] if fs.exists(place) else []
    found = [x for x in found if x[0].startswith(prefix)]
    number = lambda name: int("".join(c for c in name.rsplit(".", 1)[0][len(prefix) :] if c.isdigit()) or -1)
    best = max(found, key=lambda x: (number(x[0]), x[1], x[0]), default=None)
    return best and f"{folder.rstrip('/')}/{best[0]}"


def keep_latest(spark: SparkSession, folder: str, prefix: str) -> str | None:
    """Removes all but the newest of these; the newest."""
    best = latest(spark, folder, prefix)
    place, fs = _files(spark, folder)
    for f in fs.listStatus(place) if best else ():
        name = f.getPath().getName()
        if name.startswith(prefix) and name != best.rsplit("/", 1)[-1]:
            fs.delete(f.getPath(), True)
    return best


def save_params(spark: SparkSession, folder: str, params: dict, name: str = "params") -> str:
    """Settings of a run as JSON; a number is added to the name if it is taken."""
    place, fs = _files(spark, folder)
    fs.mkdirs(place)
    k, path = 0, f"{folder}/{name}.json"
    while fs.exists(_files(spark, path)[0]):
        k, path = k + 1, f"{folder}/{name}_{k + 1}.json"
    out = fs.create(_files(spark, path)[0])
    out.write(bytearray(json.dumps(params, ensure_ascii=False, sort_keys=True, default=str).encode()))
    out.close()
    return path
