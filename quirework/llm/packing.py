"""Items of varying length into containers of fixed capacity, with a controlled mixture of sources (problem 8).

Every source is a queue, in an order given by hashes. Deficit round-robin fills window after window: each window grants every source its share of
the window's tokens, plus what it is still owed or minus what it took too much. Over the whole collection this has a closed form: the tokens before an
item in its queue are what its source has been given when its turn comes, so the item belongs to the window in which the source's grants reach
that point. Deficits are carried by these running sums, across windows and across partitions, and no window waits for the one before. A source that
has run dry leaves its share to the others. The running sums come from one sort by range: sums within partitions, and offsets
from one row for each partition and source.

Consecutive windows are a shard, packed by one task: the items of a window go best-fit, longest first, into the open containers;
containers stay open over the windows of a shard until their room is too small for the shortest item, so that little more than each shard's last containers stays unfilled.

Defined results: an item longer than the capacity is cut into full containers and a rest, any other is whole; items
without tokens get a place in an open container (or a new one); null sources are a source of their own; every row of a repeated key
is an item of its own; sources without a wanted proportion follow after the others, in their own proportions.
"""

from __future__ import annotations

from bisect import bisect_left, insort
from collections.abc import Iterator
from itertools import groupby

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quirework.llm.encode import count_tokens
from quirework.session import staged

CAPACITY = 2048
#: Containers that a window fills, and tokens that a shard holds on average.
WINDOW, SHARD_TOKENS = 64, 4_000_000


def pack_windows(items: list[tuple[int, int, int]], capacity: int, most_open: int = 4 * WINDOW) -> list[tuple[int, int, int, int, int, int]]:
    """items: (window, key, length); the result: (key, part, container, window, first token, length), containers from 0."""
    out: list[tuple[int, int, int, int, int, int]] = []
    rooms: list[tuple[int, int]] = []  # (room, container) of the open ones, in order
    made = 0
    least = min((n % capacity or min(n, capacity) for _, _, n in items), default=0)
    for window, taken in groupby(sorted(items), key=lambda x: x[0]):
        rest: list[tuple[int, int, int, int]] = []  # length, key, part, first token
        for _, key, n in taken:
            full = n // capacity if n > capacity else 0
            for part in range(full):
                out.append((key, part, made, window, part * capacity, capacity))
                made += 1
            if n > full * capacity or not n:
                rest.append((n - full * capacity, key, full, full * capacity))
        for n, key, part, first in sorted(rest, key=lambda x: (-x[0], x[1], x[2])):
            at = bisect_left(rooms, (n, -1))
            if at < len(rooms):
                room, container = rooms.pop(at)
            else:
                room, container, made = capacity, made, made + 1
            out.append((key, part, container, window, first, n))
            if room - n > 0:
                insort(rooms, (room - n, container))
        if len(rooms) > most_open:
            del rooms[: bisect_left(rooms, (least, -1))]
    return out


def lined_up(items: DataFrame) -> DataFrame:
    """doc_id, no (source is null), name, n_tokens, start (tokens before it in its source's queue) and of (the source's tokens) of every row of (doc_id, source, n_tokens)."""
    named = items.select("doc_id", F.col("source").isNull().alias("no"), F.coalesce("source", F.lit("")).alias("name"), F.coalesce("n_tokens", F.lit(0)).cast("bigint").alias("n_tokens"))
    keys = ["no", "name", "turn", "doc_id", "n_tokens"]
    parts = int(items.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    placed = named.withColumn("turn", F.xxhash64("doc_id", "n_tokens")).repartitionByRange(parts, *keys).sortWithinPartitions(*keys).withColumn("at", F.spark_partition_id())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last: tuple | None = None
        given = 0
        for batch in batches:
            if not batch.num_rows:
                continue
            no, name, n = (batch.column(k) for k in (1, 2, 3))
            tokens = n.to_numpy()
            upto = np.cumsum(tokens)
            sources = list(zip(no.to_pylist(), name.to_pylist()))
            base = np.zeros(len(tokens), np.int64)
            for k in [0, *(i for i in range(1, len(sources)) if sources[i] != sources[i - 1])]:
                base[k:] = upto[k] - tokens[k] - (given if k == 0 and sources[0] == last else 0)
            start = upto - tokens - base
            last, given = sources[-1], int(start[-1] + tokens[-1])
            yield pa.RecordBatch.from_arrays([batch.column(0), no, name, n, batch.column(4), pa.array(start, pa.int64())], ["doc_id", "no", "name", "n_tokens", "at", "start"])

    kind = items.schema["doc_id"].dataType.simpleString()
    lined = staged(placed.select("doc_id", "no", "name", "n_tokens", "at").mapInArrow(run, f"doc_id {kind}, no boolean, name string, n_tokens bigint, at int, start bigint"), "lined")
    sums = lined.groupBy("no", "name", "at").agg(F.sum("n_tokens").alias("n"))  # a row for each partition and one for each source, at most
    queue = W.partitionBy("no", "name")
    before = F.coalesce(F.sum("n").over(queue.orderBy("at").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    offsets = sums.select("no", "name", "at", before.alias("before"), F.sum("n").over(queue).alias("of"))
    return lined.join(offsets, ["no", "name", "at"]).select("doc_id", "no", "name", "n_tokens", (F.col("start") + F.col("before")).alias("start"), "of")


def _reached(lined: DataFrame, total: int, proportions: dict[str | None, float] | None) -> Column:
    """Tokens of all sources that are given out before an item, if every source advances at its pace. total: of all sources.

    With shares s and totals t, when each source has advanced to the time v, all have been given the sum of min(t, s v); an item's time is its start over its source's share."""
    start, of = F.col("start").cast("double"), F.col("of")
    wanted = {k: float(v) for k, v in (proportions or {}).items() if v > 0}
    if not wanted:
        return start * total / of
    own = lambda k: (F.col("no") == F.lit(k is None)) & (F.col("name") == F.lit(k or ""))
    pace = F.coalesce(*(F.when(own(k), F.lit(v / sum(wanted.values()))) for k, v in wanted.items()))
    sources = lined.where(pace.isNotNull()).select(pace.alias("pace"), "of", "no", "name").distinct().collect()  # one row for each wanted proportion at most
    if not sources:
        return start * total / of
    first = sum(r.of for r in sources)
    terms = F.array(*(F.struct(F.lit(float(r.of)).alias("of"), F.lit(r.pace).alias("pace")) for r in sources))
    given = F.aggregate(terms, F.lit(0.0), lambda a, k: a + F.least(k["of"], k["pace"] * start / pace))
    return F.when(pace.isNull(), first + start * (total - first) / of).otherwise(given)


_OUT = pa.schema([("doc_id", pa.int64()), ("source", pa.string()), ("part", pa.int32()), ("container", pa.string()), ("window", pa.int64()), ("token_from", pa.int64()), ("n_tokens", pa.int64())])


def pack(items: DataFrame, capacity: int = CAPACITY, shard_tokens: int = SHARD_TOKENS, proportions: dict[str | None, float] | None = None, window: int = WINDOW) -> DataFrame:
    """doc_id, source, part, container, window, token_from, n_tokens of each part of each row of (doc_id, source, n_tokens).

    proportions: wanted shares of the tokens by source; without it those of the whole collection, so that every window mirrors it.
    A container's name is its shard and its number there; a shard is a run of windows of about shard_tokens tokens."""
    lined = lined_up(items)
    total = lined.agg(F.coalesce(F.sum("n_tokens"), F.lit(0))).first()[0]  # one number
    budget = window * capacity
    windows, per_shard = max(1, -(-total // budget)), max(1, shard_tokens // budget)
    number = F.least(F.floor(_reached(lined, total, proportions) / budget), F.lit(windows - 1))
    number = F.when(F.col("of") > 0, number).otherwise(F.pmod(F.xxhash64("doc_id"), F.lit(windows)))  # sources without any token
    placed = lined.withColumn("window", number.cast("bigint")).withColumn("shard", F.floor(F.col("window") / per_shard))
    placed = placed.select("shard", "window", F.col("doc_id").cast("bigint"), F.when(~F.col("no"), F.col("name")).alias("source"), "n_tokens")

    def run(group: pa.Table) -> pa.Table:
        shard = group["shard"][0].as_py()
        sources = group["source"].to_pylist()
        ids = group["doc_id"].to_pylist()
        made = pack_windows(list(zip(group["window"].to_pylist(), range(len(ids)), group["n_tokens"].to_pylist())), capacity, 4 * window)
        cols = list(zip(*made))
        return pa.table([[ids[k] for k in cols[0]], [sources[k] for k in cols[0]], cols[1], [f"{shard}-{c}" for c in cols[2]], *cols[3:]], schema=_OUT)

    return placed.groupBy("shard").applyInArrow(run, "doc_id bigint, source string, part int, container string, window bigint, token_from bigint, n_tokens bigint")


def mixture(packed: DataFrame) -> DataFrame:
    """window, source, n_tokens, share of each window's tokens."""
    x = packed.groupBy("window", "source").agg(F.sum("n_tokens").alias("n_tokens"))
    return x.withColumn("share", F.round(F.col("n_tokens") / F.nullif(F.sum("n_tokens").over(W.partitionBy("window")), F.lit(0)), 6))


def pack_documents(docs: DataFrame, capacity: int = CAPACITY, proportions: dict[str | None, float] | None = None) -> DataFrame:
    """Packs (doc_id, source, text) by token counts; the counts are written to the shared folder, as they are read twice."""
    return pack(staged(count_tokens(docs.select("doc_id", "source", "text")), "sizes"), capacity, proportions=proportions)
