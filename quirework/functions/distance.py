"""Edit distances as column expressions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def char_edits(a: Column, b: Column, most: int | None = None) -> Column:
    """Insertions, deletions and replacements of code points between two strings; -1 beyond `most`."""
    if most is not None:
        return F.levenshtein(a, b, most).cast("bigint")
    return bound(F.struct(a.alias("a"), b.alias("b")), lambda x: _edits(x["a"], x["b"]))


def _edits(a: Column, b: Column) -> Column:
    """Near strings are told by the band of the table that a few edits leave; only where that is not enough is the whole table worked out."""
    band = F.greatest(F.lit(8), F.floor(F.char_length(a) / 10).cast("int"))
    return bound(F.call_function("levenshtein", a, b, band), lambda d: F.when(d >= 0, d).otherwise(F.levenshtein(a, b))).cast("bigint")


def word_edits(a: Column, b: Column) -> Column:
    """The same between two arrays of words: every distinct word of the two becomes one character.

    Characters are taken from U+4E00 on, past the surrogates from U+10000 on, so that 40,000 distinct words of a pair fit."""

    def char(k: Column) -> Column:
        bmp = F.decode(F.unhex(F.hex(k + 0x4E00 - 1)), "UTF-16BE")
        high = F.decode(F.unhex(F.lpad(F.hex(k + 0x10000), 8, "0")), "UTF-32")
        return F.when(k < 20000, bmp).otherwise(high)

    def distance(x: Column) -> Column:
        coded = lambda words: F.array_join(F.transform(F.transform(words, lambda w: F.array_position(x["both"], w)), char), "")
        return F.levenshtein(coded(x["a"]), coded(x["b"])).cast("bigint")

    return bound(F.struct(a.alias("a"), b.alias("b"), F.array_distinct(F.concat(a, b)).alias("both")), distance)


def bound(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value) with value worked out once, however often it stands in the result."""
    return F.get(F.transform(F.array(value), use), 0)


def ratio(edits: Column, length: Column) -> Column:
    """Micro-averaged error rate: sums over sums; null where there is nothing to compare with."""
    return F.sum(edits) / F.nullif(F.sum(length), F.lit(0))
