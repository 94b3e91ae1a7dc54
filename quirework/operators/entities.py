"""Named entities: tagged text to BIO rows, labels of characters, alignment and thresholded scores.

The scorer that the reference calls is not part of it; the rule here is our own: an entity of the truth is found if the
prediction has an entity of the same type that overlaps it in the alignment and whose characters differ from its own by no more than the threshold times its length.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quirework.functions.edit import alignment, edits
from quirework.session import spread

Bio = tuple[str, str]

#: Signs at which words are parted and which vanish.
_PART = re.compile(r"[ &(),./:;=?]")


def bio_of(text: str, entities: str, layout: str = "", where: str = "after", most: int = 2) -> list[Bio]:
    """(word, tag) rows of a text whose words carry up to `most` entity characters before or after them. A word's tag continues the one before ('I-') if the words' characters are the same; a tag without word is a word of its own."""
    for c in set(layout) - set(entities):
        text = text.replace(c, " ")
    signs = re.escape(entities)
    rule = re.compile(f"(.+?)([{signs}]{{1,{most}}})$" if where == "after" else f"([{signs}]{{1,{most}}})(.+)$", re.S)
    out: list[Bio] = []
    before = ""
    for word in _PART.split(text.replace("\n", " ")):
        if not word:
            continue
        m = rule.match(word) if entities else None
        if not m:
            out.append((word, "O"))
            before = ""
            continue
        plain, name = m.groups() if where == "after" else m.groups()[::-1]
        out.append((plain, ("I-" if name == before else "B-") + name))
        before = name
    return out


def char_labels(rows: list[Bio]) -> tuple[str, list[str], Counter]:
    """The words with single spaces between them, a label for every character and space, and the number of entities by type and altogether.

    A space belongs to an entity if the word after it continues the one before; hyphens are written '§', as '-' stands for gaps in alignments. Where an entity of another type begins
    inside one that goes on after it, the space is the outer one's."""
    text: list[str] = []
    labels: list[str] = []
    counts: Counter = Counter()
    last = "O"
    for k, (word, tag) in enumerate(rows):
        kind, start = (tag[2:], tag[0] == "B") if tag != "O" else ("O", False)
        if k:
            inside = kind != "O" and kind == last and not start
            if not inside and start and last not in ("O", kind):
                later = next((t for _, t in rows[k + 1 :] if t == "O" or t[2:] != kind), "O")
                inside = later == "I-" + last
                text.append(" ")
                labels.append(f"I-{last}" if inside else "O")
            else:
                text.append(" ")
                labels.append(f"I-{last}" if inside else "O")
        if kind != "O" and (start or kind != last):
            counts[kind] += 1
            counts["All"] += 1
        text.append(word.replace("-", "§"))
        labels += [f"{'B' if start and i == 0 else 'I'}-{kind}" if kind != "O" else "O" for i in range(len(word))]
        last = kind
    return "".join(text), labels, counts


def _spans(labels: list[str]) -> list[tuple[str, int, int]]:
    out: list[tuple[str, int, int]] = []
    for i, x in enumerate(labels):
        if x == "O":
            continue
        if x[0] == "I" and out and out[-1][0] == x[2:] and out[-1][2] == i:
            out[-1] = (x[2:], out[-1][1], i + 1)
        else:
            out.append((x[2:], i, i + 1))
    return out


def entity_scores(truth: list[Bio], pred: list[Bio], threshold: float = 0.3) -> tuple[int, int, int]:
    """Entities of the truth, of the prediction, and matched ones. An empty prediction is one word 'A' outside of entities."""
    (a, la, ca), (b, lb, cb) = char_labels(truth), char_labels(pred or [("A", "O")])
    to = {i: j for i, j in alignment(a, b) if i >= 0 and j >= 0}
    used: set[int] = set()
    spans = _spans(lb)
    hits = 0
    for kind, i, j in _spans(la):
        reach = {to[k] for k in range(i, j) if k in to}
        for n, (other, p, q) in enumerate(spans):
            if n not in used and other == kind and any(p <= x < q for x in reach) and edits(a[i:j], b[p:q]) <= threshold * (j - i):
                used.add(n)
                hits += 1
                break
    return ca["All"], cb["All"], hits


def scored(df: DataFrame, key: str, entities: str, layout: str, threshold: float) -> DataFrame:
    """key, support, predicted, matched of (key, gt, pred)."""
    kind = df.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [entity_scores(bio_of(g or "", entities, layout), bio_of(p or "", entities, layout), threshold) for g, p in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist())]
            cols = list(zip(*rows)) or [(), (), ()]
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, pa.int64()) for c in cols)], [key, "support", "predicted", "matched"])

    return spread(df.select(key, "gt", "pred")).mapInArrow(run, f"`{key}` {kind}, support bigint, predicted bigint, matched bigint")


def corpus_scores(rows: DataFrame, by: list[str]) -> DataFrame:
    """Mean precision, recall and F1 of the documents that have entities on either side, pooled F1, and the sums."""
    none = F.lit(0.0)
    p = F.when(F.col("predicted") > 0, F.col("matched") / F.col("predicted")).otherwise(none)
    r = F.when(F.col("support") > 0, F.col("matched") / F.col("support")).otherwise(none)
    f = F.when(F.col("matched") > 0, 2 * F.col("matched") / (F.col("support") + F.col("predicted"))).otherwise(none)
    x = rows.where("support > 0 or predicted > 0").withColumns({"p": p, "r": r, "f": f})
    pooled: Column = 2 * F.sum("matched") / F.nullif(F.sum("support") + F.sum("predicted"), F.lit(0))
    mean = lambda c, n: F.round(F.avg(c), 6).alias(n)
    return x.groupBy(*by).agg(mean("p", "precision"), mean("r", "recall"), mean("f", "f1"), F.round(pooled, 6).alias("pooled_f1"), F.sum("support").alias("support"), F.sum("predicted").alias("predicted"), F.sum("matched").alias("matched"))


#: What parts runs of tagged words (fixed values: the signs that a word of a run cannot hold).
_BOUND = " \n&(),/:;=?"


def tagged_runs(text: str, sign: str, signs: str, confidences: list[float] | None = None) -> list[str]:
    """Runs of words that all end in the sign, without any sign; with confidences by their falling mean over the run's signs, equal ones in their order."""
    found: list[tuple[float, str]] = []
    for m in re.finditer(f"(?:(?:^|[ \n(])[^{re.escape(_BOUND)}]*{re.escape(sign)})+", text):
        run = m.group()
        own = [confidences[m.start() + k] for k, c in enumerate(run) if c == sign] if confidences is not None else [0.0]
        found.append((-sum(own) / len(own), "".join(c for c in run if c not in signs).strip(" \n(")))
    return [content for _, content in sorted(found, key=lambda x: x[0])]


def entity_ap(df: DataFrame, key: str, signs: dict[str, str], thresholds: range = range(5, 51, 5)) -> DataFrame:
    """key, tag, threshold (per cent), ap, weight (entities of the truth) of (key, gt, pred, conf), of the tags that the truth has."""
    from quirework.operators.layout import average_precisions

    kind, every = df.schema[key].dataType.simpleString(), "".join(signs.values())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, out = [], []
            for row, (gt, pred, conf) in enumerate(zip(*(c.to_pylist() for c in batch.columns[1:]))):
                for tag, sign in signs.items():
                    truths = tagged_runs(gt or "", sign, every)
                    if truths:
                        found = tagged_runs(pred or "", sign, every, conf or [])
                        for n, ap in zip(thresholds, average_precisions(truths, found, [k / 100 for k in thresholds])):
                            rows.append(row)
                            out.append((tag, n, ap, len(truths)))
            cols = list(zip(*out)) or [()] * 4
            kinds = (pa.string(), pa.int32(), pa.float64(), pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(rows, pa.int64())), *(pa.array(c, k) for c, k in zip(cols, kinds))], [key, "tag", "threshold", "ap", "weight"])

    return spread(df.select(key, "gt", "pred", "conf")).mapInArrow(run, f"`{key}` {kind}, tag string, threshold int, ap double, weight bigint")


def register_bio(spark: SparkSession, signs: str, name: str = "bio_words") -> None:
    """A table function for SQL: pos, word and tag of the words of a text that carry entity signs after them."""

    @F.udtf(returnType="pos int, word string, tag string")
    class BioWords:
        def eval(self, text: str) -> Iterator[tuple[int, str, str]]:
            for i, (word, tag) in enumerate(bio_of(text or "", signs)):
                yield i, word, tag

    spark.udtf.register(name, BioWords)
