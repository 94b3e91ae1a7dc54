"""Deeply nested label records to flat, linked tables.

Every node of a record (the record itself, pages, paragraphs, lines) gets its pre-order and post-order number by
depth-first traversal, and its place in the array it stands in. A node lies below another one if its pre-order number is larger and its post-order number
smaller. The traversal is one array expression: children follow their parent in the array of nodes, the place in it is the
pre-order number, and post = pre + size of the subtree - 1 - depth. Tables of one level each are linked by interval containment on record_id and these two
numbers: pages never hold pages nor paragraphs paragraphs, so the one container that a node can have on a level is the last node of that level before it, if
its interval holds the node's. That is one window over a record's nodes, no join (distinct_nodes); linked joins any two node tables.

Defined results: null arrays and null elements give no nodes, but null elements count for positions; a lone element in
place of an array has position 0; a bare string as label is its text, as line a line's text; a payload that is cut off
gives no record at all, one that is a bare string gives a record without other nodes, any other non-object none. Repeated rows
count once.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from quirework.functions.distance import bound

BOX = "struct<l:int,r:int,t:int,b:int>"
LINE = "struct<text:string,l:int,t:int,r:int,b:int>"
PARAGRAPH = f"struct<label:string,region_type:string,mode:string,coords:{BOX},lines:array<{LINE}>,t:int,b:int,l:int,r:int>"
PAGE = f"struct<text:string,paragraphs:array<{PARAGRAPH}>,nb_cols:int,side:string,t:int,b:int,l:int,r:int,page_width:int>"
LABEL = f"struct<text:string,text_ner:string,nb_cols:int,dataset:string,lines:array<{LINE}>,paragraphs:array<{PARAGRAPH}>,pages:array<{PAGE}>>"

#: Columns of the node table besides record_id.
NODE = "struct<level:string,depth:int,pos:int,size:int,text:string,kind:string,side:string,nb_cols:int,page_width:int,l:int,t:int,r:int,b:int>"


# ---- raw JSON to the label struct -------------------------------------------------------------------------------


def _int(x: object) -> int | None:
    if isinstance(x, bool) or x is None:
        return None
    if isinstance(x, str):
        try:
            x = float(x.strip())
        except ValueError:
            return None
    if isinstance(x, (int, float)) and x == x and abs(x) < 2**31:
        return int(x)
    return None


def _str(x: object) -> str | None:
    if x is None or isinstance(x, str):
        return x
    return json.dumps(x, ensure_ascii=False)


def _many(x: object) -> list | None:
    """An array as it is; a lone element as an array of one; null stays absent."""
    return x if isinstance(x, list) or x is None else [x]


def _box(x: dict) -> dict:
    return {to: _int(x.get(name, x.get(to))) for to, name in (("l", "left"), ("r", "right"), ("t", "top"), ("b", "bottom"))}


def _line(x: object) -> dict | None:
    if isinstance(x, dict):
        return {"text": _str(x.get("text")), **_box(x)}
    return {"text": x} if isinstance(x, str) else None


def _paragraph(x: object) -> dict | None:
    if not isinstance(x, dict):
        return None
    coords = x.get("coords")
    return {
        "label": _str(x.get("label")),
        "region_type": _str(x.get("type", x.get("region_type"))),
        "mode": _str(x.get("mode")),
        "coords": _box(coords) if isinstance(coords, dict) else None,
        "lines": None if x.get("lines") is None else [_line(y) for y in _many(x["lines"])],
        **_box(x),
    }


def _page(x: object) -> dict | None:
    if not isinstance(x, dict):
        return None
    return {
        "text": _str(x.get("text")),
        "paragraphs": None if x.get("paragraphs") is None else [_paragraph(y) for y in _many(x["paragraphs"])],
        "nb_cols": _int(x.get("nb_cols")),
        "side": _str(x.get("side")),
        "page_width": _int(x.get("page_width")),
        **_box(x),
    }


def label_of(payload: str | None) -> dict | None:
    """The label struct of a raw payload; None if it is cut off or neither an object nor a string."""
    try:
        x = json.loads(payload) if payload is not None else None
    except (ValueError, RecursionError):
        return None
    if isinstance(x, str):
        return {"text": x}
    if not isinstance(x, dict):
        return None
    return {
        "text": _str(x.get("text")),
        "text_ner": _str(x.get("text-ner", x.get("text_ner"))),
        "nb_cols": _int(x.get("nb_cols")),
        "dataset": _str(x.get("dataset")),
        "lines": None if x.get("lines") is None else [_line(y) for y in _many(x["lines"])],
        "paragraphs": None if x.get("paragraphs") is None else [_paragraph(y) for y in _many(x["paragraphs"])],
        "pages": None if x.get("pages") is None else [_page(y) for y in _many(x["pages"])],
    }


def parse_dumps(dumps: DataFrame) -> DataFrame:
    """record_id, label of the readable payloads, in the struct of the delivered labels, brought to it from their many spellings in Arrow batches."""
    kind = to_arrow_type(T._parse_datatype_string(LABEL))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = [(k, label) for k, p in zip(batch.column(0), batch.column(1).to_pylist()) if (label := label_of(p)) is not None]
            yield pa.RecordBatch.from_arrays([pa.array([k.as_py() for k, _ in made], pa.int64()), pa.array([x for _, x in made], kind)], ["record_id", "label"])

    return dumps.select(F.col("record_id").cast("bigint"), "payload").mapInArrow(run, f"record_id bigint, label {LABEL}")


# ---- traversal ---------------------------------------------------------------------------------------------------


def _node(level: str, depth: int, pos: Column, size: Column, **fields: Column) -> Column:
    null = lambda kind: F.lit(None).cast(kind)
    return F.struct(
        F.lit(level).alias("level"), F.lit(depth).alias("depth"), pos.cast("int").alias("pos"), size.cast("int").alias("size"),
        *(fields.get(k, null("string")).alias(k) for k in ("text", "kind", "side")),
        *(fields.get(k, null("int")).alias(k) for k in ("nb_cols", "page_width", "l", "t", "r", "b")),
    )


def _some(xs: Column, kind: str) -> Column:
    return F.coalesce(xs, F.array().cast(f"array<{kind}>"))


def _held(xs: Column) -> Column:
    """Number of elements that are not null."""
    return F.coalesce(F.size(F.filter(xs, lambda x: x.isNotNull())), F.lit(0))


def _lines(xs: Column, depth: int) -> Column:
    made = F.transform(_some(xs, LINE), lambda x, i: F.when(x.isNotNull(), _node("line", depth, i, F.lit(1), text=x["text"], l=x["l"], t=x["t"], r=x["r"], b=x["b"])))
    return F.filter(made, lambda x: x.isNotNull())


def _paragraphs(xs: Column, depth: int) -> Column:
    def one(x: Column, i: Column) -> Column:
        side = {k: F.coalesce(x["coords"][k], x[k]) for k in "ltrb"}
        own = _node("paragraph", depth, i, 1 + F.greatest(_held(x["lines"]), F.lit(0)), text=x["label"], kind=F.coalesce(x["region_type"], x["mode"]), **side)
        return F.when(x.isNotNull(), F.concat(F.array(own), _lines(x["lines"], depth + 1)))

    return F.flatten(F.filter(F.transform(_some(xs, PARAGRAPH), one), lambda x: x.isNotNull()))


def _pages(xs: Column) -> Column:
    def one(x: Column, i: Column) -> Column:
        below = _paragraphs(x["paragraphs"], 2)
        size = 1 + F.aggregate(_some(x["paragraphs"], PARAGRAPH), F.lit(0), lambda n, p: n + F.when(p.isNotNull(), 1 + F.greatest(_held(p["lines"]), F.lit(0))).otherwise(0))
        own = _node("page", 1, i, size, text=x["text"], side=x["side"], nb_cols=x["nb_cols"], page_width=x["page_width"], l=x["l"], t=x["t"], r=x["r"], b=x["b"])
        return F.when(x.isNotNull(), F.concat(F.array(own), below))

    return F.flatten(F.filter(F.transform(_some(xs, PAGE), one), lambda x: x.isNotNull()))


_FIELDS = ("text", "kind", "side", "nb_cols", "page_width", "l", "t", "r", "b")


def nodes(labels: DataFrame) -> DataFrame:
    """One row for each node of each row of (record_id, label): level, pos (in its array; -1: the record), pre, post and the node's own fields.

    The record is the node of level 'record' with pre 0 and the largest post. Repeated rows of a record stay; see distinct_nodes."""
    x = F.col("label")
    body = F.concat(_pages(x["pages"]), _paragraphs(x["paragraphs"], 1), _lines(x["lines"], 1))
    root = lambda size: _node("record", 0, F.lit(-1), size, text=x["text"], kind=x["dataset"], nb_cols=x["nb_cols"])
    whole = bound(body, lambda b: F.concat(F.array(root(1 + F.size(b))), b))
    out = labels.select("record_id", F.posexplode(whole).alias("pre", "n"))
    return out.select("record_id", "pre", (F.col("pre") + F.col("n.size") - 1 - F.col("n.depth")).alias("post"), "n.level", "n.pos", *(F.col(f"n.{c}").alias(c) for c in _FIELDS))


def distinct_nodes(labels: DataFrame, fields: tuple[str, ...] = _FIELDS) -> DataFrame:
    """The nodes with page_pre and par_pre, the numbers of the page and the paragraph whose intervals hold theirs (null: none), and page_pos, par_pos, line_pos,
    their places (-1 for an absent level). Each record counts once although it may be delivered twice (with equal labels): equal nodes are merged by their number.

    One shuffle by record, which serves the merging and the window alike."""
    x = nodes(labels).select("record_id", "pre", "post", "level", "pos", *fields).repartition("record_id").dropDuplicates(["record_id", "pre"])
    before = W.partitionBy("record_id").orderBy("pre").rowsBetween(W.unboundedPreceding, -1)
    last = lambda level: F.last(F.when(F.col("level") == level, F.struct("pre", "post", "pos")), ignorenulls=True).over(before)
    x = x.withColumns({"_page": last("page"), "_par": last("paragraph")})
    held = lambda c: F.when(F.col(f"{c}.post") > F.col("post"), F.col(c))
    x = x.withColumns({"_page": held("_page"), "_par": held("_par")})
    place = lambda level, c: F.when(F.col("level") == level, F.col("pos")).otherwise(F.coalesce(F.col(c)["pos"], F.lit(-1)) if c else F.lit(-1))
    return x.select(
        "record_id", "pre", "post", "level", F.col("_page.pre").alias("page_pre"), F.col("_par.pre").alias("par_pre"),
        place("page", "_page").alias("page_pos"), place("paragraph", "_par").alias("par_pos"), place("line", "").alias("line_pos"), *fields,
    )


def all_labels(records: DataFrame, dumps: DataFrame) -> DataFrame:
    """record_id, label of delivered and dumped records together."""
    return records.select("record_id", F.col("label").cast(LABEL).alias("label")).unionByName(parse_dumps(dumps))


def linked(children: DataFrame, parents: DataFrame) -> DataFrame:
    """Children with parent_pre, the pre-order number of the parent among the given nodes: the innermost interval that contains theirs.

    Containment on equal record_id: parent.pre < child.pre and child.post < parent.post. A child without parent there keeps a null.
    """
    p = parents.select("record_id", F.col("pre").alias("_pre"), F.col("post").alias("_post"))
    met = children.join(p, (children.record_id == p.record_id) & (p._pre < children.pre) & (children.post < p._post), "left").select(children["*"], p._pre)
    key = [c for c in children.columns if c not in ("record_id", "pre")]
    return met.groupBy("record_id", "pre").agg(*(F.first(c).alias(c) for c in key), F.max("_pre").alias("parent_pre"))
