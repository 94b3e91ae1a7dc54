"""Metrics of predictions against truths: layouts and metrics by data set, confidences through layout repair, one result for all metrics.

Truths and predictions are tables of their own that meet on a sample's name; a truth without a prediction counts with an empty one. Which metrics a
data set has, and by which grammar its layout is read, is looked up by what its name contains, in two registries that can be added to.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quirework.functions.distance import char_edits, ratio, word_edits
from quirework.functions.text import JOINT_TO_SINGLE, LETTER_PAIRS, cer_normalise, keep_tokens, wer_normalise
from quirework.operators import layout as L
from quirework.session import spread


@dataclass(frozen=True)
class Layout:
    """How the layout of a data set is read: its grammar, whether pages are compared one by one, and whether its regions are nested."""

    grammar: L.Grammar
    by_page: bool
    nested: bool = True


#: Layouts and metrics by a part of the data set's name, in any case; the first that fits is taken.
LAYOUTS: dict[str, Layout] = {"read": Layout(L.READ, True), "popp": Layout(L.ACTS, True), "rimes": Layout(L.LETTERS, False, nested=False)}
METRICS: dict[str, tuple[str, ...]] = {"ner": ("cer", "wer", "cer-ner"), "read": ("cer", "wer", "pper", "loer", "map_cer"), "popp": ("cer", "wer", "pper", "loer", "map_cer"), "rimes": ("cer", "wer", "pper", "loer", "map_cer"), "": ("cer", "wer")}


def register_layout(part: str, layout: Layout, metrics: tuple[str, ...] = ("cer", "wer", "pper", "loer", "map_cer")) -> None:
    """Adds a grammar for data sets whose name contains the part; it goes before those that are there."""
    for registry, value in ((LAYOUTS, layout), (METRICS, metrics)):
        rest = {k: v for k, v in registry.items() if k != part.lower()}
        registry.clear()
        registry.update({part.lower(): value} | rest)


def layout_of(dataset: str | None) -> Layout | None:
    return next((v for k, v in LAYOUTS.items() if k in (dataset or "").lower()), None)


def metrics_of(dataset: str | None) -> tuple[str, ...]:
    return next(v for k, v in METRICS.items() if k in (dataset or "").lower())


def flat_repair_at(text: str, pairs: dict[str, str] = LETTER_PAIRS) -> tuple[str, int, list[int]]:
    """flat_repair of layout.py for Arrow functions, with the place in the given text of each character (-1: inserted)."""
    begin_of = {b: a for a, b in pairs.items()}
    out: list[str] = []
    at: list[int] = []
    ops, opened = 0, ""
    for i, c in enumerate(text):
        if c in pairs:
            if opened:
                out.append(pairs[opened])
                at.append(-1)
                ops += 1
            opened = c
        elif c in begin_of:
            if begin_of[c] != opened:
                ops += 1
                continue
            opened = ""
        out.append(c)
        at.append(i)
    if opened:
        out.append(pairs[opened])
        at.append(-1)
        ops += 1
    return "".join(out), ops, at


def repaired_with(text: str, confidences: list[float], layout: Layout) -> tuple[str, int, list[float]]:
    """The repaired text, its operations and its characters' confidences: inserted markers have 0, those of deleted ones fall away; characters without one have 0, too."""
    made, ops, at = L.tree_repair(text, layout.grammar) if layout.nested else flat_repair_at(text, layout.grammar.ends)
    return made, ops, [confidences[i] if 0 <= i < len(confidences) else 0.0 for i in at]


def regions_of(text: str, begin: str, end: str, confidences: list[float] | None = None) -> list[str]:
    """Contents of the regions of a kind, without overlap; with confidences by their falling mean over begin and end marker, equal ones in their order."""
    found: list[tuple[float, str]] = []
    at = 0
    while (i := text.find(begin, at)) >= 0:
        j = text.find(end, i)
        if j < 0:
            break
        found.append((0.0 if confidences is None else -(confidences[i] + confidences[j]) / 2, text[i + 1 : j]))
        at = j + 1
    return [content for _, content in sorted(found, key=lambda x: x[0])]


def layout_rows(pairs: DataFrame, thresholds: range = range(5, 51, 5)) -> DataFrame:
    """dataset, name, class (null for the whole sample), metric, part and whole (metric value = sum of parts over sum of wholes) of (dataset, name, gt, pred, conf).

    pper: repairs over markers; loer: graph edits over nodes and edges, after repair (exact: 1 if proven); map_cer: average precision by class, weighted by regions."""
    marks = str.maketrans("", "", "".join(chr(c) for c in range(0x24B6, 0x24EA)))
    single = str.maketrans(JOINT_TO_SINGLE)
    schema = pa.schema([("dataset", pa.string()), ("name", pa.string()), ("class", pa.string()), ("metric", pa.string()), ("part", pa.float64()), ("whole", pa.float64())])

    def rows(dataset: str, name: str, gt: str, pred: str, conf: list[float]) -> Iterator[tuple]:
        layout = layout_of(dataset)
        if layout is None:
            return
        gt, pred = gt.translate(single), pred.translate(single)
        made, ops, confidences = repaired_with(pred, conf, layout)
        pairs = layout.grammar.ends
        signs = {*pairs, *pairs.values()}
        yield dataset, name, None, "pper", float(ops), float(sum(c in signs for c in pred))
        edits, size, exact = L.graph_edits(gt, made, layout.grammar, layout.by_page)
        yield dataset, name, None, "loer", float(edits), float(size)
        yield dataset, name, None, "bounded", float(not exact), 1.0
        for begin, end in pairs.items():
            truths = [t.translate(marks) for t in regions_of(gt, begin, end)]
            if truths:
                found = [t.translate(marks) for t in regions_of(made, begin, end, confidences)]
                for n, ap in zip(thresholds, L.average_precisions(truths, found, [k / 100 for k in thresholds])):
                    yield dataset, name, begin, f"map_cer_{n:02d}", ap * len(truths), float(len(truths))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = [r for d, k, g, p, c in zip(*(x.to_pylist() for x in batch.columns)) for r in rows(d, k, g or "", p or "", c or [])]
            cols = list(zip(*out)) or [()] * 6
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(cols, schema)], schema=schema)

    return spread(pairs.select("dataset", "name", "gt", "pred", "conf")).mapInArrow(run, "dataset string, name string, class string, metric string, part double, whole double")


def repaired_rows(pairs: DataFrame) -> DataFrame:
    """dataset, name, text, ops, conf of the repaired predictions of data sets that have a layout."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        single = str.maketrans(JOINT_TO_SINGLE)
        for batch in batches:
            out = []
            for dataset, name, pred, conf in zip(*(x.to_pylist() for x in batch.columns)):
                if (layout := layout_of(dataset)) is not None:
                    out.append((dataset, name, *repaired_with((pred or "").translate(single), conf or [], layout)))
            cols = list(zip(*out)) or [()] * 5
            kinds = (pa.string(), pa.string(), pa.string(), pa.int32(), pa.list_(pa.float64()))
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds)], ["dataset", "name", "text", "ops", "conf"])

    return spread(pairs.select("dataset", "name", "pred", "conf")).mapInArrow(run, "dataset string, name string, text string, ops int, conf array<double>")


def matched(truths: DataFrame, predictions: DataFrame) -> DataFrame:
    """dataset, name, gt, pred, conf, missing of truths (dataset, name, gt) and predictions (name, pred, conf); of repeated names of predictions the first by text counts."""
    one = predictions.groupBy("name").agg(F.min_by(F.struct("pred", "conf"), "pred").alias("p")).select("name", "p.pred", "p.conf")
    x = truths.join(one, "name", "left")
    return x.select("dataset", "name", "gt", F.coalesce("pred", F.lit("")).alias("pred"), F.coalesce("conf", F.array().cast("array<double>")).alias("conf"), F.col("pred").isNull().alias("missing"))


def text_rows(pairs: DataFrame, marks: str) -> DataFrame:
    """pairs with the edits and lengths of characters, words and markers."""
    a, b = cer_normalise(F.col("gt"), marks), cer_normalise(F.col("pred"), marks)
    x = pairs.select("*", a.alias("a"), b.alias("b"), wer_normalise(F.col("gt"), marks).alias("v"), wer_normalise(F.col("pred"), marks).alias("w"), keep_tokens(F.col("gt"), marks).alias("s"), keep_tokens(F.col("pred"), marks).alias("t"))
    size = lambda c: c.cast("bigint")
    return x.select(*pairs.columns, char_edits(F.col("a"), F.col("b")).alias("e"), size(F.char_length("a")).alias("n"), word_edits(F.col("v"), F.col("w")).alias("we"), size(F.size("v")).alias("wn"), char_edits(F.col("s"), F.col("t")).alias("te"), size(F.char_length("s")).alias("tn"))


def _wanted(metric: Column) -> Column:
    """Whether a data set (column dataset) has a metric, by the registry; its rules become one expression."""
    found = F.lit(False)
    for part, metrics in reversed(METRICS.items()):
        found = F.when(F.lower("dataset").contains(part) if part else F.lit(True), metric.isin(*metrics)).otherwise(found)
    return found


def evaluated(pairs: DataFrame, marks: str) -> DataFrame:
    """dataset, metric, value, of which each data set has those that the registry gives it. pairs: of matched."""
    text = text_rows(pairs, marks).groupBy("dataset").agg(ratio(F.col("e"), F.col("n")).alias("cer"), ratio(F.col("we"), F.col("wn")).alias("wer"), ratio(F.col("te"), F.col("tn")).alias("cer-ner"))
    text = text.unpivot(["dataset"], ["cer", "wer", "cer-ner"], "metric", "value")
    rows = layout_rows(pairs).withColumn("metric", F.when(F.col("metric").startswith("map_cer"), "map_cer").otherwise(F.col("metric")))
    laid = rows.groupBy("dataset", "metric").agg((F.sum("part") / F.nullif(F.sum("whole"), F.lit(0.0))).alias("value"))
    both = text.unionByName(laid)
    return both.where(_wanted(F.col("metric")) | (F.col("metric") == "bounded")).select("dataset", "metric", F.round("value", 6).alias("value"))


__all__ = ["LAYOUTS", "METRICS", "Layout", "evaluated", "layout_of", "layout_rows", "matched", "metrics_of", "register_layout", "repaired_with", "text_rows"]
