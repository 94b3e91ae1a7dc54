"""Metrics over streams: the same aggregates as in batch, kept up to date, and windows over event time."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quirework.session import staging_dir


def event_stream(spark: SparkSession, path: str) -> DataFrame:
    """The files of a folder or pattern as a stream, with the schema of the first."""
    schema = spark.read.parquet(path).schema
    folder, name = path.rstrip("/").rsplit("/", 1)
    return spark.readStream.schema(schema).option("pathGlobFilter", name).option("maxFilesPerTrigger", 1).parquet(folder)


def rates(events: DataFrame) -> DataFrame:
    """Micro-averaged value by type: sums of values and weights."""
    return events.groupBy("event_type").agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("total"))


def hourly(events: DataFrame, late: str = "1 hour") -> DataFrame:
    """Counts by hour of event time and type; events later than the watermark are dropped."""
    ts = events.withColumn("ts", F.col("ts").cast("timestamp"))
    return ts.withWatermark("ts", late).groupBy(F.window("ts", "1 hour").alias("w"), "event_type").agg(F.count("*").alias("n")).select(F.col("w.start").alias("hour"), "event_type", "n")


def sessions(events: DataFrame, gap: str = "30 minutes", late: str = "1 hour") -> DataFrame:
    ts = events.withColumn("ts", F.col("ts").cast("timestamp"))
    return ts.withWatermark("ts", late).groupBy(F.session_window("ts", gap).alias("w"), "user_id").agg(F.count("*").alias("n")).select("user_id", F.col("w.start").alias("begin"), F.col("w.end").alias("end"), "n")


def sliding(events: DataFrame, width: str = "1 hour", every: str = "15 minutes", late: str = "1 hour") -> DataFrame:
    """Counts by type in overlapping windows of event time."""
    ts = events.withColumn("ts", F.col("ts").cast("timestamp"))
    return ts.withWatermark("ts", late).groupBy(F.window("ts", width, every).alias("w"), "event_type").agg(F.count("*").alias("n")).select(F.col("w.start").alias("start"), "event_type", "n")


def first_of_hour(events: DataFrame, late: str = "1 hour") -> DataFrame:
    """user_id, event_type, hour: each once; keys are forgotten when the watermark has passed them."""
    x = events.select("user_id", "event_type", F.date_trunc("hour", F.col("ts").cast("timestamp")).alias("hour"))
    return x.withWatermark("hour", late).dropDuplicates(["user_id", "event_type", "hour"])


def followed(first: DataFrame, then: DataFrame, within: str, late: str = "1 hour") -> DataFrame:
    """a, b: events of one stream and later ones (also by number) of the same user in another within so long; state is kept as long as the watermarks allow a match."""
    a = first.select("user_id", F.col("event_id").alias("a"), F.col("ts").cast("timestamp").alias("at")).withWatermark("at", late)
    b = then.select(F.col("user_id").alias("user"), F.col("event_id").alias("b"), F.col("ts").cast("timestamp").alias("bt")).withWatermark("bt", late)
    return a.join(b, F.expr(f"user_id = user and b > a and bt >= at and bt <= at + interval {within}")).select("a", "b")


def drained(stream: DataFrame, mode: str) -> DataFrame:
    """Everything that is there now run through the stream; the last state of its result.

    Each batch is written whole to the shared folder (complete mode) or added there (append mode), so that a restarted run gives the same."""
    spark = stream.sparkSession
    folder = f"{staging_dir(spark)}/stream-{uuid.uuid4().hex}"
    last: list[str] = []

    def keep(batch: DataFrame, k: int) -> None:
        to = f"{folder}/out/batch={k}"
        batch.write.mode("overwrite").parquet(to)
        if mode == "complete":
            last[:] = [to]
        else:
            last.append(to)

    q = stream.writeStream.outputMode(mode).option("checkpointLocation", f"{folder}/state").trigger(availableNow=True).foreachBatch(keep).start()
    q.awaitTermination()
    return spark.read.schema(stream.schema).parquet(*last) if last else spark.createDataFrame([], stream.schema)
