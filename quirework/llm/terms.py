"""How often every term occurs and in how many records, kept up to date by signed deltas (problem 6).

A TermCounts is a folder of counts, in buckets by a hash of the term. A change of the collection is two sets of
records, those that are gone (or were different before) and those that are new (or are different now); their terms are
counted with the signs -1 and +1, summed per batch and then per term, and merged into the buckets that have any of these terms. Records that
did not change are never read, buckets without a changed term are neither read nor written. Every version has a small manifest: the folder of
each bucket, the charset entries that are counted, the number of rows. A manifest comes into being by renaming, after its data are written; the one of the
highest number is current, so that a folder is opened again by its name, by any process, and a writer that died leaves the counts as they were.
Buckets are doubled when they have grown too large. `changes` finds the two sets from two states of a collection.

Defined results: a term is a longest stretch without space, tab, line feed, carriage return or layout marker, as stored; null and
empty texts have no terms but count as records; repeated rows of a record count once (its first row by order of delivery is not told apart: they are equal).
"""

from __future__ import annotations

import functools
import json
import re
import uuid
from collections import Counter
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quirework.llm.looks import MARKERS
from quirework.session import staged, staging_dir

_TERM = re.compile(rf"[^ \t\n\r{MARKERS}]+")
#: Terms of a bucket on average, up to twice as many before buckets are split.
BUCKET_ROWS = 100_000
COUNTS = "kind string, term string, occurrences bigint, records bigint"


def distinct_records(records: DataFrame, key: str = "record_id", text: str = "text") -> DataFrame:
    return records.groupBy(key).agg(F.first(text).alias(text))


def term_deltas(records: DataFrame, sign: int, entries: tuple[str, ...] = (), text: str = "text") -> DataFrame:
    """COUNTS of the records' words (kind 'word'), of the given entries as parts of their texts ('entry'), and of the records themselves ('all'), all times sign.

    entries: characters or short strings of a charset, a list of fixed size. Counts are summed over each Arrow batch before they are sent."""
    single = frozenset(e for e in entries if len(e) == 1)
    longer = tuple(e for e in entries if len(e) > 1)
    firsts = frozenset(e[-1] for e in longer)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            occurrences: Counter = Counter()
            held: Counter = Counter()
            part: Counter = Counter()
            part_held: Counter = Counter()
            for value in batch.column(0):
                t = value.as_py()
                if not t:
                    continue
                words = Counter(_TERM.findall(t))
                occurrences.update(words)
                held.update(words.keys())
                if entries:
                    chars = Counter(t)
                    some = single & chars.keys()
                    part_held.update(some)
                    part.update({c: chars[c] for c in some})
                    if firsts & chars.keys():
                        for e in longer:
                            if e in t:
                                part_held[e] += 1
                                part[e] += t.count(e)
            rows = [("word", k, sign * n, sign * held[k]) for k, n in occurrences.items()] + [("entry", k, sign * n, sign * part_held[k]) for k, n in part.items()]
            rows.append(("all", "", 0, sign * batch.num_rows))
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), (pa.string(), pa.string(), pa.int64(), pa.int64()))], ["kind", "term", "occurrences", "records"])

    return records.select(text).mapInArrow(run, COUNTS)


def _summed(rows: DataFrame) -> DataFrame:
    out = rows.groupBy("kind", "term").agg(F.sum("occurrences").alias("occurrences"), F.sum("records").alias("records"))
    return out.where("occurrences <> 0 or records <> 0")


def changes(before: DataFrame, after: DataFrame, key: str = "record_id", text: str = "text") -> tuple[DataFrame, DataFrame]:
    """The records that are gone and those that are new between two states (one row a record); a changed one is in both, with its old and its new text."""
    print_of = F.xxhash64(F.coalesce(text, F.lit("")), F.col(text).isNull())
    a, b = (x.select(key, text).withColumn("_print", print_of) for x in (before, after))
    gone = a.join(b.select(key, "_print"), [key, "_print"], "left_anti").drop("_print")
    new = b.join(a.select(key, "_print"), [key, "_print"], "left_anti").drop("_print")
    return gone, new


class TermCounts:
    """Persistent counts in a folder; every apply adds a version."""

    def __init__(self, spark: SparkSession, folder: str | None = None, entries: tuple[str, ...] | None = None, bucket_rows: int = BUCKET_ROWS) -> None:
        """Opens the counts of a folder, or begins new ones. entries: of the charsets; those of an open folder are its own, see add_entries."""
        self.spark, self.bucket_rows = spark, bucket_rows
        self.folder = folder or f"{staging_dir(spark)}/terms-{uuid.uuid4().hex}"
        self.version, self.manifest = self._current()
        if self.version == 0:
            self.manifest = {"entries": sorted(entries or ()), "buckets": {}, "of": 0, "rows": 0}
        elif entries is not None and not {*entries} <= {*self.manifest["entries"]}:
            raise ValueError("the counts lack some of these entries; add_entries counts them in all records")

    # -- files

    def _path(self, *parts: str) -> tuple[object, object]:
        place = self.spark._jvm.org.apache.hadoop.fs.Path("/".join((self.folder, *parts)))
        return place, place.getFileSystem(self.spark._jsc.hadoopConfiguration())

    def _current(self) -> tuple[int, dict]:
        at, fs = self._path("manifests")
        names = [f.getPath().getName() for f in fs.listStatus(at)] if fs.exists(at) else []
        numbers = [int(n[:-5]) for n in names if n.endswith(".json") and n[:-5].isdigit()]
        if not numbers:
            return 0, {}
        place, fs = self._path("manifests", f"{max(numbers):010d}.json")
        stream = fs.open(place)
        try:
            return max(numbers), json.loads(self.spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
        finally:
            stream.close()

    def _publish(self, manifest: dict) -> None:
        draft, fs = self._path("manifests", f".{uuid.uuid4().hex}")
        stream = fs.create(draft)
        stream.write(bytearray(json.dumps(manifest).encode()))
        stream.close()
        final, _ = self._path("manifests", f"{self.version + 1:010d}.json")
        if fs.exists(final) or not fs.rename(draft, final):
            fs.delete(draft, False)
            raise RuntimeError("another writer has published a version of these counts")
        self.version, self.manifest = self.version + 1, manifest

    def vacuum(self) -> None:
        """Removes what the current version no longer uses."""
        used = {*self.manifest["buckets"].values()}
        at, fs = self._path("data")
        for run in fs.listStatus(at) if fs.exists(at) else ():
            for bucket in fs.listStatus(run.getPath()):
                if bucket.isDirectory() and f"data/{run.getPath().getName()}/{bucket.getPath().getName()}" not in used:
                    fs.delete(bucket.getPath(), True)

    # -- counts

    def _read(self, buckets: Iterable[int] | None = None) -> DataFrame:
        known = self.manifest["buckets"]
        paths = [f"{self.folder}/{at}" for k, at in known.items() if buckets is None or int(k) in buckets]
        return self.spark.read.schema(COUNTS).parquet(*paths) if paths else self.spark.createDataFrame([], COUNTS)

    def counts(self) -> DataFrame:
        """COUNTS of the current version."""
        return self._read()

    def _merge(self, deltas: DataFrame, entries: list[str]) -> TermCounts:
        deltas = staged(_summed(deltas), "deltas")
        of, n = self.manifest["of"], deltas.count()
        total = self.manifest["rows"] + n  # at most
        whole = total > 2 * self.bucket_rows * of
        if whole:
            of = max(of, 1)
            while of * self.bucket_rows < total:
                of *= 2
        bucket = F.pmod(F.hash("kind", "term"), F.lit(of)).cast("int")
        touched = None if whole else {r.b for r in deltas.select(bucket.alias("b")).distinct().collect()}  # a number for each bucket at most
        run = f"data/{uuid.uuid4().hex}"
        before = 0 if whole or not touched else self._read(touched).count()
        merged = _summed(self._read(touched).unionByName(deltas)).withColumn("bucket", bucket)
        parts = of if touched is None else max(1, len(touched))
        merged.repartition(parts, "bucket").write.partitionBy("bucket").parquet(f"{self.folder}/{run}")
        at, fs = self._path(run)
        made = {f.getPath().getName().split("=")[1]: f"{run}/{f.getPath().getName()}" for f in fs.listStatus(at) if f.isDirectory()}
        kept = {} if whole else {k: v for k, v in self.manifest["buckets"].items() if int(k) not in touched}
        after = self.spark.read.schema(COUNTS).parquet(*(f"{self.folder}/{x}" for x in made.values())).count() if made else 0
        rows = after if whole else self.manifest["rows"] - before + after
        self._publish({"entries": entries, "buckets": kept | made, "of": of, "rows": rows})
        return self

    def apply(self, new: DataFrame | None = None, gone: DataFrame | None = None) -> TermCounts:
        """Counts with the terms of the new records added and those of the gone records taken away."""
        entries = self.manifest["entries"]
        rows = [term_deltas(df, sign, tuple(entries)) for df, sign in ((new, 1), (gone, -1)) if df is not None]
        return self._merge(functools.reduce(DataFrame.unionByName, rows), entries) if rows else self

    def add_entries(self, entries: Iterable[str], records: DataFrame) -> TermCounts:
        """Entries that were not counted so far are counted in all records of the collection as it is now."""
        more = sorted({*entries} - {*self.manifest["entries"]})
        if not more:
            return self
        return self._merge(term_deltas(records, 1, tuple(more)).where("kind = 'entry'"), sorted({*self.manifest["entries"], *more}))


def marked(counts: DataFrame, entries: DataFrame | None = None, rare: int = 1, common: float = 0.2, common_entry: float = 0.8) -> DataFrame:
    """kind, term, occurrences, records, mark ('rare', 'common' or null). entries: (term) of those that get a row even if no record holds them."""
    total = counts.where("kind = 'all'").agg(F.coalesce(F.sum("records"), F.lit(0)).alias("total"))
    rows = counts.where("kind <> 'all'")
    if entries is not None:
        none = entries.select(F.lit("entry").alias("kind"), "term", F.lit(0).cast("bigint").alias("occurrences"), F.lit(0).cast("bigint").alias("records"))
        rows = rows.unionByName(none).groupBy("kind", "term").agg(F.sum("occurrences").alias("occurrences"), F.sum("records").alias("records"))
    n = total.first().total  # one number
    share = F.when(F.col("kind") == "entry", F.lit(common_entry)).otherwise(F.lit(common))
    mark = F.when(F.col("records") <= rare, "rare").when(F.col("records") > share * F.lit(n), "common")
    return rows.withColumn("mark", mark)
