"""Where results go: metrics, predictions, generated pages."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def write_metrics(metrics: DataFrame, path: str) -> None:
    """(dataset, metric, value) as JSON, one row a data set, and as lines of text beside it."""
    rows = metrics.groupBy("dataset").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("metric", "value")))).alias("metrics"))
    rows.write.mode("overwrite").json(f"{path}/summary")
    line = F.concat_ws(" ", F.concat(F.coalesce("dataset", F.lit("none")), F.lit(":")), F.concat_ws("=", "metric", F.col("value").cast("string")))
    metrics.select(line.alias("value")).write.mode("overwrite").text(f"{path}/text")


def write_predictions(predictions: DataFrame, path: str) -> None:
    """(name, pred) as JSON rows {"name": {"pred": ...}}."""
    rows = predictions.select(F.to_json(F.create_map("name", F.struct("pred"))).alias("value"))
    rows.write.mode("overwrite").text(path)


def read_predictions(predictions: DataFrame) -> DataFrame:
    """name, pred of such rows (value)."""
    x = predictions.select(F.from_json("value", "map<string, struct<pred:string>>").alias("m"))
    return x.select(F.explode("m").alias("name", "p")).select("name", "p.pred")


def write_pages(pages: DataFrame, path: str, split: str = "train") -> None:
    """Generated pages as JSON with their labels and boxes, a folder for each split."""
    pages.withColumn("split", F.lit(split)).write.mode("overwrite").partitionBy("split").json(path)
