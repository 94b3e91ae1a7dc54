"""The same or nearly the same records across splits (problem 4).

Texts are compared as they print, without layout markers, case and white space. Equal texts are one class; classes of
different sides are paired by counting pieces: of the longer text of a pair that may have k edits k + 1 + k / SPARE separate pieces are
taken, the rarest, and k edits leave 1 + k / SPARE of these pieces unharmed and move none by more than k places. Texts are laid out in cells by bands of length; within a cell
the pieces of one side are looked up among all places of the other, and pairs that meet in too few pieces are ruled out. What is left is told apart by
grams with places: k edits destroy at most GRAM * k of a text's grams. Which pieces are taken matters for speed only, and hashing can only add a match; so no pair
within the tolerance is lost, however short, common or evenly edited its texts are. The edit distance of the whole texts, a banded alignment, decides on the rest.
One shared piece would not do for that: at one edit in ten characters a pair may share no stretch of more than nine characters, which set phrases share as well.

What the two splits have in common beyond near-copies is told by winnowing fingerprints: of every WINNOW successive hashes of SEED characters the least is
selected, so that any common stretch of SEED + WINNOW - 1 characters has a common seed. Selected seeds are joined across the splits (coverage); in a pair they are chained
in order, and the gaps of the chain are aligned (spans).

Defined results: a record counts once; null splits and texts without letter or digit take no part; records of
other splits than train, valid and test neither. A pair of equal texts is found whatever its length.
"""

from __future__ import annotations

import hashlib
import math
import re
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator
from itertools import chain as chained

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quirework.functions.edit import alignment
from quirework.functions.edit import edits as char_edits
from quirework.llm.looks import MARKERS, _repeated, _salted, consistent, has_print, look_table, skeleton, use
from quirework.session import spread, staged

#: Characters of a gram; ratio of the lengths in a band; texts of a side in a cell at least and at most; texts whose pieces are chosen together.
GRAM, BAND, CELL, ROWS = 3, 1.25, (4096, 65536), 2048
#: Characters of a piece at most; one segment more for so many edits; numbers that are held and pairs that are counted at once.
PIECE, SPARE, HELD, BLOCK = 6, 4, 1 << 22, 1 << 18
#: Buckets of places that the most edits of a pair can move a gram by.
REACH = 4

#: Characters of a seed, and successive seeds of which one is selected: a common stretch of 24 characters is always found.
SEED, WINNOW = 12, 13

_DROPPED = re.compile(rf"[\s{MARKERS}]+")


def compared(text: str) -> str:
    """What is compared of a text."""
    return _DROPPED.sub("", skeleton(consistent(text).lower()))


def classes_of(records: DataFrame) -> DataFrame:
    """record_id, side ('train' or 'eval'), split, cls (of equal compared texts) and norm, for (record_id, split, text)."""
    table = look_table(records.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        use(table)
        for batch in batches:
            ids, sides, splits, keys, norms = [], [], [], [], []
            for i, s, t in zip(*(c.to_pylist() for c in batch.columns)):
                if s in ("train", "valid", "test") and has_print(t):
                    norm = compared(t)
                    ids.append(i)
                    sides.append("train" if s == "train" else "eval")
                    splits.append(s)
                    keys.append(int.from_bytes(hashlib.blake2b(norm.encode("utf-8", "replace"), digest_size=8).digest(), "little", signed=True))
                    norms.append(norm)
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(sides, pa.string()), pa.array(splits, pa.string()), pa.array(keys, pa.int64()), pa.array(norms, pa.string())], ["record_id", "side", "split", "cls", "norm"])

    return records.select("record_id", "split", "text").mapInArrow(run, "record_id bigint, side string, split string, cls bigint, norm string")


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15)
    return h ^ (h >> np.uint64(29))


def _codes(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "replace"), np.uint32).astype(np.uint64)


def _grams(codes: np.ndarray, k: int) -> np.ndarray:
    n = len(codes) - k + 1
    h = np.zeros(max(n, 0), np.uint64)
    for j in range(k if n > 0 else 0):
        h = h * np.uint64(0x100000001B3) + codes[j : j + n]
    return _mixed(h)


def _most(length: np.ndarray | int) -> np.ndarray | int:
    """Edits within the tolerance, by the length of the longer text."""
    return length // 10


def _band(length: int) -> int:
    return int(math.log(length) / math.log(BAND))


def _shorter(length: int) -> int:
    """No partner of a text is shorter."""
    return length - _most(length)


def _longer(length: int) -> int:
    """No partner of a text is longer."""
    return length + length // 9 + 1


def _slots(values: np.ndarray, size: int) -> np.ndarray:
    return (values >> np.uint64(40)) & np.uint64(size - 1)


def _size(least: int) -> int:
    return 1 << max(6, (least - 1).bit_length())


def _every(norms: list[str], gram: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The grams of all texts, their texts and their places."""
    sizes = np.array([len(t) for t in norms])
    row = np.repeat(np.arange(len(norms)), sizes)
    g = _grams(_codes("".join(norms)), gram)
    whole = np.flatnonzero(row[: len(g)] == row[gram - 1 :][: len(g)])  # not across two texts
    row = row[whole]
    return g[whole], row, whole - (np.cumsum(sizes) - sizes)[row]


def _taken(length: np.ndarray | int) -> np.ndarray | int:
    """Pieces that are taken of a text: so many more than it may have edits that some of them are left unharmed."""
    return _most(length) + 1 + _most(length) // SPARE


def _piece(length: np.ndarray | int) -> np.ndarray | int:
    """Characters of a piece at most, by the length of its text."""
    return np.minimum(PIECE, length // _taken(length))


def _pieces(norms: list[str], piece: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Each text is cut in segments of the length of a piece at least; of each the rarest piece is looked at, and the rarest of these are taken: the pieces, their texts and places."""
    g, row, place = _every(norms, piece)
    lengths = np.array([len(t) for t in norms])
    length = lengths[row]
    n = length // piece
    segment = ((place + 1) * n - 1) // length
    inside = np.flatnonzero(place + piece <= (segment + 1) * length // n)
    g, row, place, segment = g[inside], row[inside], place[inside], segment[inside]
    slot = _slots(g, 1 << 20).astype(np.int64)
    often = np.bincount(slot)[slot]
    first = np.flatnonzero((np.diff(row, prepend=-1) != 0) | (np.diff(segment, prepend=-1) != 0))
    at = np.minimum.reduceat(often << 32 | np.arange(len(g)), first) & 0xFFFFFFFF
    at = at[np.argsort(row[at] << 32 | np.minimum(often[at], 0xFFFFFFFF), kind="stable")]  # by text, the rarest first
    sizes = np.bincount(row[at], minlength=len(norms))
    at = at[np.arange(len(at)) - np.repeat(np.cumsum(sizes) - sizes, sizes) < _taken(lengths)[row[at]]]
    return g[at], row[at], place[at]


def _keys(g: np.ndarray, place: np.ndarray) -> np.ndarray:
    return g >> np.uint64(24) << np.uint64(24) | np.clip(place, 0, (1 << 24) - 1).astype(np.uint64)


def _met(norms: list[str], lengths: np.ndarray, longer: np.ndarray, shorter: np.ndarray, equal: bool) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Rows of the pairs of a text and one that is shorter (or as long, if equal) by its most edits at most and has enough of its pieces, each moved by no more places than these.
    Both are in order of length."""
    longer = longer[lengths[longer] >= lengths[shorter].min()]
    if not len(longer):
        return
    piece = int(_piece(lengths[longer]).min())
    made = []
    for x in range(0, len(longer), ROWS):
        g, row, place = _pieces([norms[k] for k in longer[x : x + ROWS]], piece)
        most = _most(lengths[longer[x + row]])
        made.append((x + row, _keys(g, place - most), _keys(g, place + most)))
    row, low, high = (np.concatenate(x) for x in zip(*made))
    need = _taken(lengths[longer]) - _most(lengths[longer])
    known = np.zeros(HELD, bool)
    known[_slots(low, HELD)] = True
    upto = np.cumsum(lengths[shorter])
    for b in np.split(shorter, np.searchsorted(upto, np.arange(HELD, upto[-1], HELD))):
        if not len(b):
            continue
        g, of, place = _every([norms[k] for k in b], piece)
        some = np.flatnonzero(known[_slots(g, HELD)])
        keys, of = _keys(g[some], place[some]), of[some]
        order = np.argsort(keys)
        there = np.zeros(HELD, bool)
        there[_slots(keys, HELD)] = True
        there = there[_slots(low, HELD)]
        keys, of = keys[order], of[order]
        begin, end = np.searchsorted(lengths[longer], [lengths[b[0]], _longer(int(lengths[b[-1]])) + 1])
        sought = np.arange(*np.searchsorted(row, [begin, end]))
        sought = sought[there[sought]]
        start = np.searchsorted(keys, low[sought])
        hit = np.flatnonzero(np.append(keys, ~np.uint64(0))[start] <= high[sought])
        sought, start = sought[hit], start[hit]
        n = np.searchsorted(keys, high[sought], "right") - start
        step = max(1, BLOCK // len(b))
        for x in range(begin, end, step):
            a = longer[x : min(x + step, end)]
            first, last = np.searchsorted(row[sought], [x, x + len(a)])
            sums = np.cumsum(n[first:last])
            cuts = [first, *(first + np.searchsorted(sums, np.arange(HELD, sums[-1], HELD))), last] if len(sums) else []
            counts = None
            for y, z in zip(cuts, cuts[1:]):
                at = np.arange(n[y:z].sum()) + np.repeat(start[y:z] - np.cumsum(n[y:z]) + n[y:z], n[y:z])
                more = np.bincount(np.repeat((row[sought[y:z]] - x) * len(b), n[y:z]) + of[at], minlength=len(a) * len(b))
                counts = more if counts is None else counts + more
            if counts is None:
                continue
            i, j = np.divmod(np.flatnonzero(counts.reshape(len(a), -1) >= need[x : x + len(a), None]), len(b))
            i, j = a[i], b[j]
            apart = lengths[i] - lengths[j]
            kept = (apart >= 1 - equal) & (apart <= _most(lengths[i]))
            yield i[kept], j[kept]


def _placed(norms: list[str], size: int, width: int, reach: int) -> np.ndarray:
    """Packed bits of the hashed grams of each text with their buckets of places; with reach 0 the bucket itself, else all up to reach away."""
    out = np.zeros((len(norms), size // 64), np.uint64)
    step = max(1, HELD // size)
    for x in range(0, len(norms), step):
        part = norms[x : x + step]
        g, row, place = _every(part, GRAM)
        bits = np.zeros(len(part) * size, bool)
        for k in range(-reach, reach + 1):
            bits[row * size + _slots(_mixed(g * np.uint64(0x9E3779B97F4A7C15) + (place // width + REACH + k).astype(np.uint64)), size).astype(np.int64)] = True
        out[x : x + step] = np.packbits(bits).view(np.uint64).reshape(len(part), -1)
    return out


def _possible(norms: list[str], i: np.ndarray, j: np.ndarray, most: np.ndarray) -> np.ndarray:
    """Which of the pairs of rows i and j don't miss too many grams with places."""
    width, size = -(-int(most.max()) // REACH) or 1, _size_for(int(most.max()))
    ui, ri = np.unique(i, return_inverse=True)
    uj, rj = np.unique(j, return_inverse=True)
    a, b = _placed([norms[x] for x in ui], size, width, 0), ~_placed([norms[x] for x in uj], size, width, REACH)
    step = max(1, (1 << 20) // (size // 64))
    missing = np.concatenate([np.bitwise_count(a[ri[x : x + step]] & b[rj[x : x + step]]).sum(1, dtype=np.int64) for x in range(0, len(i), step)])
    return missing <= GRAM * most


def _size_for(most: int) -> int:
    return min(1 << 17, _size(32 * (10 * most + 9)))


def _cell_pairs(cell: pa.Table) -> pa.Table:
    """e, t of the pairs of a cell (cls, norm, train) that may be within the tolerance."""
    norms, train, cls = cell["norm"].to_pylist(), cell["train"].to_numpy(), cell["cls"].to_numpy()
    lengths = np.array([len(x) for x in norms])
    order = np.argsort(lengths, kind="stable")
    ts, es = order[train[order]], order[~train[order]]
    found: list[tuple[np.ndarray, np.ndarray]] = [(np.zeros(0, np.int64), np.zeros(0, np.int64))]
    if len(ts) and len(es):
        held: list[tuple[np.ndarray, np.ndarray]] = []
        at_once = (HELD << 7) // _size_for(_most(int(lengths.max())))  # by the room that their bits take
        pairs = chained(_met(norms, lengths, ts, es, True), ((t, e) for e, t in _met(norms, lengths, es, ts, False)), [None])
        for pair in pairs:
            held += [pair] if pair else []
            if held and (pair is None or sum(len(x[0]) for x in held) >= at_once):
                t, e = (np.concatenate(x) for x in zip(*held))
                held.clear()
                for k in range(0, len(t), at_once):
                    i, j = t[k : k + at_once], e[k : k + at_once]
                    kept = _possible(norms, i, j, _most(np.maximum(lengths[i], lengths[j])))
                    found.append((cls[j[kept]], cls[i[kept]]))
    e, t = (np.concatenate(x) for x in zip(*found))
    return pa.table({"e": pa.array(e[e != t], pa.int64()), "t": pa.array(t[e != t], pa.int64())})


def candidates(texts: DataFrame) -> DataFrame:
    """e, t: pairs of classes (of eval and train) that gram counts don't rule out, among them all within the tolerance; each once."""
    length = F.char_length("norm")
    texts = texts.where(length >= 9)  # shorter ones have no edit to spare
    band = F.floor(F.log(length.cast("double")) / math.log(BAND)).cast("int")
    sizes = texts.groupBy(band.alias("band")).agg(F.sum(F.col("train").cast("long")).alias("train"), F.sum(F.col("eval").cast("long")).alias("eval")).collect()  # a row for each band of lengths
    block = min(CELL[1], max(CELL[0], sum(r.train + r.eval for r in sizes) // 16))
    n_train = {r.band: -(-r.train // block) or 1 for r in sizes}
    n_eval = {r.band: -(-r.eval // block) or 1 for r in sizes}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, cells, sides = [], [], []
            for row, (cls, norm, train, eval_) in enumerate(zip(*(c.to_pylist() for c in batch.columns))):
                own, others = _band(len(norm)), range(_band(_shorter(len(norm))), _band(_longer(len(norm))) + 1)
                for side, takes, mine, theirs in ((True, train, n_train, n_eval), (False, eval_, n_eval, n_train)):
                    salt = cls % mine.get(own, 1)
                    for other in others if takes else ():
                        for x in range(theirs.get(other, 1)):
                            tb, ts, eb, es = (own, salt, other, x) if side else (other, x, own, salt)
                            cells.append(((tb << 7 | eb) << 24 | ts) << 24 | es)
                            rows.append(row)
                            sides.append(side)
            at = pa.array(rows, pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(cells, pa.int64()), batch.column(0).take(at), batch.column(1).take(at), pa.array(sides, pa.bool_())], ["cell", "cls", "norm", "train"])

    laid = texts.select("cls", "norm", "train", "eval").mapInArrow(run, "cell bigint, cls bigint, norm string, train boolean")
    laid = laid.repartition(int(laid.sparkSession.conf.get("spark.sql.shuffle.partitions")), "cell")
    return laid.groupBy("cell").applyInArrow(_cell_pairs, "e bigint, t bigint")


def near_classes(kept: DataFrame) -> DataFrame:
    """e, t, edits, length (of the longer) of the pairs of different classes within the tolerance; kept: classes_of."""
    texts = kept.groupBy("cls").agg(F.first("norm").alias("norm"), F.max(F.col("side") == "train").alias("train"), F.max(F.col("side") == "eval").alias("eval"))
    texts = staged(texts, "classes")
    pairs = candidates(texts)
    x = pairs.join(texts.select(F.col("cls").alias("e"), F.col("norm").alias("a")), "e").join(texts.select(F.col("cls").alias("t"), F.col("norm").alias("b")), "t")
    longer = F.greatest(F.char_length("a"), F.char_length("b"))
    x = x.select("e", "t", "a", "b", longer.alias("length"), F.floor(longer / 10).cast("int").alias("most"))
    # a banded alignment, -1 beyond the tolerance; very long texts are compared in Python, without what they have in common at both ends
    edits = F.expr(f"CASE WHEN length <= {VERY_LONG} THEN levenshtein(a, b, most) END")
    x = x.withColumn("edits", edits).where("edits is null or edits >= 0")
    x = x.select("e", "t", "length", "edits", "most", F.expr("CASE WHEN edits IS NULL THEN a END").alias("a"), F.expr("CASE WHEN edits IS NULL THEN b END").alias("b"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = zip(*(batch.column(k).to_pylist() for k in (3, 4, 5, 6)))
            made = [d if d is not None else _core_edits(a, b) for d, _, a, b in rows]
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(made, pa.int32()), batch.column(4)], ["e", "t", "length", "edits", "most"])

    x = x.mapInArrow(run, "e bigint, t bigint, length int, edits int, most int")
    return x.where("edits <= most").select("e", "t", "length", "edits")


#: Characters from which a pair's edit distance is worked out in Python.
VERY_LONG = 20_000


def _common(a: str, b: str) -> int:
    """Characters that two texts begin with alike, by halving."""
    low, high = 0, min(len(a), len(b))
    while low < high:
        mid = (low + high + 1) // 2
        low, high = (mid, high) if a[low:mid] == b[low:mid] else (low, mid - 1)
    return low


def _core_edits(a: str, b: str) -> int:
    n = _common(a, b)
    a, b = a[n:], b[n:]
    n = _common(a[::-1], b[::-1])
    return char_edits(a[: len(a) - n], b[: len(b) - n])


def cross_split_pairs(records: DataFrame) -> DataFrame:
    """train_id, eval_id, eval_split, edits, length of all pairs of records that are the same or nearly so. records: record_id, split, text."""
    kept = staged(classes_of(records), "compared")
    links = _links(kept)
    members = kept.select("record_id", "side", "split", "cls").dropDuplicates(["record_id", "side"])
    e = _salted(members.where("side = 'eval'").select(F.col("cls").alias("e"), F.col("record_id").alias("eval_id"), F.col("split").alias("eval_split")), "eval_id")
    t = _salted(members.where("side = 'train'").select(F.col("cls").alias("t"), F.col("record_id").alias("train_id")), "train_id")
    out = _repeated(links).join(e, ["e", "salt"]).drop("salt")  # a third of all records may be of one class
    out = _repeated(out).join(t, ["t", "salt"]).where("eval_id <> train_id")
    return out.select("train_id", "eval_id", "eval_split", "edits", "length").dropDuplicates(["train_id", "eval_id"])


def _links(kept: DataFrame) -> DataFrame:
    """e, t, length, edits of all pairs of classes that are the same (of both sides) or nearly so."""
    same = kept.groupBy("cls").agg(F.max(F.col("side") == "train").alias("x"), F.max(F.col("side") == "eval").alias("y"), F.max(F.char_length("norm")).alias("length")).where("x and y")
    return near_classes(kept).unionByName(same.select(F.col("cls").alias("e"), F.col("cls").alias("t"), "length", F.lit(0).alias("edits")))


def cross_split_classes(records: DataFrame) -> DataFrame:
    """record_id, split, class and links, the number of classes of the other side (its own, too, if that side has it) that are the same or nearly so: one row for each record that takes part."""
    kept = staged(classes_of(records), "compared")
    links = _links(kept)
    per = links.select(F.col("e").alias("cls"), F.lit("eval").alias("side"), F.col("t").alias("other")).unionByName(links.select(F.col("t").alias("cls"), F.lit("train").alias("side"), F.col("e").alias("other")))
    counts = per.groupBy("cls", "side").agg(F.count("*").alias("links"))
    members = _salted(kept.select("record_id", "side", "split", "cls").dropDuplicates(["record_id", "side"]), "record_id")
    out = members.join(_repeated(counts), ["cls", "side", "salt"], "left")
    return out.select("record_id", "split", F.hex("cls").alias("class"), F.coalesce("links", F.lit(0)).alias("links"))


# ---- fingerprints


def seeds_of(norm: str) -> list[tuple[int, int]]:
    """(hash, place) of the selected seeds of a text: of equal hashes in a window the last one; a text shorter than a window has one seed, if it is as long as that."""
    g = _grams(_codes(norm), SEED)
    if not len(g):
        return []
    w = min(WINNOW, len(g))
    windows = np.lib.stride_tricks.sliding_window_view(g[::-1], w)[::-1]
    at = np.unique(np.arange(len(windows)) + w - 1 - windows.argmin(1))
    return [(int(h), int(k)) for h, k in zip(g[at].view(np.int64), at)]


def fingerprints(classes: DataFrame) -> DataFrame:
    """cls, seed, at of each of (cls, norm)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, seeds, places = [], [], []
            for row, norm in enumerate(batch.column(1).to_pylist()):
                for h, k in seeds_of(norm):
                    rows.append(row)
                    seeds.append(h)
                    places.append(k)
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(rows, pa.int64())), pa.array(seeds, pa.int64()), pa.array(places, pa.int32())], ["cls", "seed", "at"])

    return classes.select("cls", "norm").mapInArrow(run, "cls bigint, seed bigint, at int")


def coverage(records: DataFrame) -> DataFrame:
    """record_id, split, length, covered (characters in stretches that train has anywhere) of every record of valid and test: a semi-join with the distinct seeds of train.

    No pair is formed, so that a set phrase of a third of all records costs no more than another. A text of less than SEED characters is covered if train has it as a whole."""
    kept = staged(classes_of(records), "compared")
    of = lambda side: kept.where(F.col("side") == side).groupBy("cls").agg(F.first("norm").alias("norm"))
    train = fingerprints(of("train")).select("seed").distinct()
    met = fingerprints(of("eval")).join(train, "seed", "left_semi")
    ends = F.array_sort(F.collect_list("at"))  # of one text
    grown = F.aggregate(F.col("ats"), F.struct(F.lit(0).alias("upto"), F.lit(0).alias("sum")), lambda a, k: F.struct(F.greatest(a["upto"], k + SEED).alias("upto"), (a["sum"] + k + SEED - F.greatest(a["upto"], k)).alias("sum")), lambda a: a["sum"])
    covered = met.groupBy("cls").agg(ends.alias("ats")).select("cls", grown.alias("covered"))
    whole = kept.where("side = 'train'").select("cls", F.lit(True).alias("in_train")).distinct()
    x = of("eval").select("cls", F.char_length("norm").alias("length")).join(covered, "cls", "left").join(whole, "cls", "left")
    per = x.select("cls", "length", F.when(F.col("in_train"), F.col("length")).otherwise(F.coalesce("covered", F.lit(0))).alias("covered"))
    members = _salted(kept.where("side = 'eval'").select("record_id", "split", "cls").dropDuplicates(["record_id"]), "record_id")
    return members.join(_repeated(per), ["cls", "salt"]).select("record_id", "split", "length", "covered")


def chain(a: str, b: str) -> list[tuple[int, int]]:
    """Places of common seeds in a and b, in order in both: the longest such run, where the n-th of equal seeds of one text stands for the n-th of the other."""
    x, y = ({}, {})
    for seeds, of in ((seeds_of(a), x), (seeds_of(b), y)):
        n: Counter = Counter()
        for h, k in seeds:
            of[h, n[h]] = k
            n[h] += 1
    hits = sorted((x[h], y[h]) for h in x.keys() & y.keys())
    tails: list[int] = []
    ends: list[int] = []
    before = [-1] * len(hits)
    for k, (_, q) in enumerate(hits):
        at = bisect_left(tails, q)
        before[k] = ends[at - 1] if at else -1
        tails[at : at + 1], ends[at : at + 1] = [q], [k]
    out = []
    k = ends[-1] if ends else -1
    while k >= 0:
        out.append(hits[k])
        k = before[k]
    return out[::-1]


MOST_GAP = 100_000_000


def _gap(a: str, b: str) -> list[tuple[int, int]]:
    """Places of the characters that an alignment of two gaps keeps."""
    if len(a) * len(b) <= MOST_GAP:
        return [(x, y) for x, y in alignment(a, b) if x >= 0 and y >= 0 and a[x] == b[y]]
    n = min(len(a), len(b))
    head = next((k for k in range(n) if a[k] != b[k]), n)
    tail = next((k for k in range(n - head) if a[-1 - k] != b[-1 - k]), n - head)
    return [(k, k) for k in range(head)] + [(len(a) - k, len(b) - k) for k in range(tail, 0, -1)]


def aligned(a: str, b: str) -> tuple[int, int, int]:
    """Characters that an alignment of a and b keeps, in how many stretches, and the longest one: the seeds of the chain are kept, the gaps between them are aligned.

    A gap of more than MOST_GAP places times places, which only texts without common seeds over thousands of characters have, keeps what its two ends have in common."""
    pairs: list[tuple[int, int]] = []
    i = j = 0
    for p, q in [*chain(a, b), (len(a), len(b))]:
        p, q = (p, q) if p >= i and q >= j else (max(p, i), q + max(p, i) - p)  # seeds that overlap the one before, on its diagonal
        if p < i or q < j:
            continue
        pairs += [(i + x, j + y) for x, y in _gap(a[i:p], b[j:q])]
        n = min(SEED, len(a) - p, len(b) - q)
        while n and a[p : p + n] != b[q : q + n]:
            n -= 1
        pairs += [(p + k, q + k) for k in range(n)]
        i, j = p + n, q + n
    stretches = longest = run = 0
    last = (-2, -2)
    for pair in pairs:
        run = run + 1 if pair == (last[0] + 1, last[1] + 1) else 1
        stretches += run == 1
        longest, last = max(longest, run), pair
    return len(pairs), stretches, longest


def spans(records: DataFrame) -> DataFrame:
    """e_class, t_class, edits, kept (characters that the alignment keeps), stretches, longest, e_share and t_share (of each text's characters) of every pair of classes of p4."""
    kept = staged(classes_of(records), "compared")
    texts = staged(kept.groupBy("cls").agg(F.first("norm").alias("norm")), "texts")
    x = _links(kept).join(texts.select(F.col("cls").alias("e"), F.col("norm").alias("a")), "e").join(texts.select(F.col("cls").alias("t"), F.col("norm").alias("b")), "t")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = [(*aligned(a, b), len(a), len(b)) for a, b in zip(batch.column(3).to_pylist(), batch.column(4).to_pylist())]
            cols = [pa.array(c, pa.int32()) for c in zip(*made)] or [pa.array([], pa.int32())] * 5
            share = [pa.array([m[0] / m[k] if m[k] else 1.0 for m in made], pa.float64()) for k in (3, 4)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], *cols[:3], *share], ["e", "t", "edits", "kept", "stretches", "longest", "e_share", "t_share"])

    x = spread(x.select("e", "t", "edits", "a", "b"))
    out = x.mapInArrow(run, "e bigint, t bigint, edits int, kept int, stretches int, longest int, e_share double, t_share double")
    return out.select(F.hex("e").alias("e_class"), F.hex("t").alias("t_class"), "edits", "kept", "stretches", "longest", F.round("e_share", 6).alias("e_share"), F.round("t_share", 6).alias("t_share"))
