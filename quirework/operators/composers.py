"""Texts of generated pages in their plain and tagged renderings, and the boxes that go with them: letters, registers, acts, tagged lines.

Each composer is an expression over the lines of a page and uniform numbers of its key, so that pages are the same in every run; pixels are not made.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from quirework.functions.text import LETTER_PAIRS


def words_of(line: Column, first: int, n: int) -> Column:
    """n words of a line from the given one on (1 the first)."""
    return F.array_join(F.slice(F.split(line, " "), first, n), " ")


def letter_parts(lines: Column, u: dict[str, Column]) -> Column:
    """array<struct<kind, text, l, t, r, b>> of a letter's regions in reading order. u: uniform numbers for 'ⓢ', 'ⓦ', 'ⓞ' and 'ⓟ', regions that a letter may lack."""
    head, last = F.get(lines, F.lit(0)), F.element_at(lines, -1)
    height = 48 * F.size(lines)
    width = F.array_max(F.transform(lines, lambda s: F.char_length(s))) * 12
    part = lambda kind, text, l, t, r, b: F.struct(F.lit(kind).alias("kind"), text.alias("text"), *(x.cast("int").alias(k) for k, x in zip("ltrb", (l, t, r, b))))
    sender, place, opening, after = words_of(head, 1, 3), words_of(head, 4, 3), words_of(last, 1, 2), words_of(last, 3, 4)
    every = F.array(
        F.when(u["ⓢ"] < 0.8, part("ⓢ", sender, F.lit(60), F.lit(40), 60 + 12 * F.char_length(sender), F.lit(80))),
        F.when(u["ⓦ"] < 0.7, part("ⓦ", place, F.lit(700), F.lit(100), 700 + 12 * F.char_length(place), F.lit(140))),
        F.when(u["ⓞ"] < 0.6, part("ⓞ", opening, F.lit(120), F.lit(180), 120 + 12 * F.char_length(opening), F.lit(220))),
        part("ⓑ", F.array_join(lines, "\n"), F.lit(60), F.lit(260), 60 + width, 260 + height),
        F.when(u["ⓟ"] < 0.2, part("ⓟ", after, F.lit(60), 300 + height, 60 + 12 * F.char_length(after), 340 + height)),
    )
    return F.filter(every, lambda p: p.isNotNull() & (p["text"] != ""))


def plain(parts: Column) -> Column:
    return F.array_join(F.transform(parts, lambda p: p["text"]), "\n")


def tagged(parts: Column, pairs: dict[str, str] = LETTER_PAIRS) -> Column:
    ends = F.create_map(*(F.lit(x) for kv in pairs.items() for x in kv))
    return F.array_join(F.transform(parts, lambda p: F.concat(p["kind"], p["text"], F.element_at(ends, p["kind"]))), "")


def sections(lines: Column, n: int) -> Column:
    """The lines in groups of n, the last one shorter."""
    return F.transform(F.sequence(F.lit(0), F.greatest(F.floor((F.size(lines) - 1) / n), F.lit(0)).cast("int")), lambda i: F.slice(lines, i * n + 1, n))


def register_page(lines: Column, number: Column) -> Column:
    """A page of a register: its number, and sections of an annotation (the first two words) and a body of three lines."""
    one = lambda s: F.concat(F.lit("ⓢⓐ"), words_of(F.get(s, F.lit(0)), 1, 2), F.lit("Ⓐⓑ"), F.array_join(s, "\n"), F.lit("ⒷⓈ"))
    return F.concat(F.lit("ⓟⓝ"), number.cast("string"), F.lit("Ⓝ"), F.array_join(F.transform(sections(lines, 3), one), ""), F.lit("Ⓟ"))


def act_page(lines: Column, u: Column) -> Column:
    """A page of acts of four lines: names and particulars in the margin, the paragraph, and a signature on part of the pages."""
    signed = F.when(u < 0.5, F.lit("ⓢ+Ⓢ")).otherwise(F.lit(""))
    one = lambda s: F.concat(F.lit("ⓜⓝ"), words_of(F.get(s, F.lit(0)), 1, 2), F.lit("Ⓝⓘ"), words_of(F.get(s, F.lit(0)), 3, 1), F.lit("Ⓘⓑ"), F.array_join(s, "\n"), F.lit("Ⓑ"), signed, F.lit("Ⓜ"))
    return F.concat(F.lit("ⓟ"), F.array_join(F.transform(sections(lines, 4), one), ""), F.lit("Ⓟ"))


def section_lines(lines: Column, u: Column, width: int) -> Column:
    """Lines of a section: the first one indented by four spaces, the last one cut to half its words, and in one of fifteen sections the line before it said twice."""
    n = F.size(lines)
    half = lambda s: words_of(s, 1, F.greatest(F.floor(F.size(F.split(s, " ")) / 2), F.lit(1)).cast("int"))
    last = F.element_at(lines, -1)
    first = F.concat(F.lit("    "), F.get(lines, F.lit(0)))
    inner = F.slice(lines, 2, F.greatest(n - 2, F.lit(0)))
    again = F.when((u < 1 / 15) & (n > 2), F.slice(lines, F.greatest(n - 1, F.lit(1)), F.lit(1))).otherwise(F.array().cast("array<string>"))
    made = F.when(n > 1, F.concat(F.array(first), inner, again, F.array(half(last)))).otherwise(F.array(first))
    return F.transform(made, lambda s: F.substring(s, 1, width))
