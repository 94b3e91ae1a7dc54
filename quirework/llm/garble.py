"""Text decoded in a wrong encoding, found and restored (problem 5).

A text's words are its stretches between white space and layout markers, without ASCII punctuation around them. Words that hold
characters beyond ASCII and that no chain of wrong decodings could have made are clean. Of every distinct clean word the
forms that the chains turn it into are generated, with what gets lost on the way (bytes without a character left out or
shown as '?', non-breaking spaces cut off), and those of one-byte text read in another one-byte encoding, which count if
they are rarer than their original. The words of the collection are hash-joined with these forms; a hit is a garbled word and names its original. Words that were
not hit, as their original is nowhere clean in the collection, are taken apart: a stretch beyond ASCII is garbled if one
chain's forms of clean characters make it up altogether. A replacement character always is a garbled stretch.

Defined results: null and empty texts are never garbled; an item delivered several times counts once; a form that several
originals share is restored to the one that more texts hold (ties: the smaller string); rare but right characters stay, as no
chain leads to them.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quirework.llm.looks import MARKERS, consistent, use
from quirework.session import spread, staged

#: Encodings in which UTF-8 is read by mistake, and those in which the result may be read wrong again.
WRONG = ("cp1252", "latin-1", "cp437", "cp850", "mac_roman", "cp1251", "cp1250", "gbk", "big5", "koi8-r", "cp866", "shift_jis")
AGAIN = ("cp1252", "latin-1", "mac_roman", "cp437", "cp1251")
CHAINS: tuple[tuple[str, ...], ...] = (*((e,) for e in WRONG), *((a, b) for a in ("cp1252", "latin-1") for b in AGAIN), ("cp437", "cp437"), ("mac_roman", "mac_roman"), ("cp1252", "cp1252", "cp1252"), ("latin-1", "latin-1", "latin-1"))

_SPLIT = re.compile(rf"[ \t\r\n]+|([{MARKERS}]+)")
_RUN = re.compile(r"[^\x00-\x7f]+")
_AROUND = "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"
LOST = "�"


@lru_cache(maxsize=None)
def _single(encoding: str) -> tuple[list[str], dict[str, int]] | None:
    """Characters by byte and bytes by character of a one-byte encoding; bytes without a character stay as control characters. None for the others."""
    if encoding in ("gbk", "big5", "shift_jis"):
        return None
    chars = [bytes([b]).decode(encoding, "replace") for b in range(256)]
    chars = [chr(b) if c == LOST else c for b, c in enumerate(chars)]
    return chars, {c: b for b, c in enumerate(chars)}


def _misread(text: str, encoding: str) -> str | None:
    data = text.encode("utf-8", "replace")
    if table := _single(encoding):
        return "".join([table[0][b] for b in data])
    try:
        return data.decode(encoding)
    except UnicodeDecodeError:
        return None


def _reread(text: str, encoding: str) -> str | None:
    """The inverse of _misread; None where there is none."""
    try:
        if table := _single(encoding):
            return bytes([table[1][c] for c in text]).decode("utf-8")
        return text.encode(encoding).decode("utf-8")
    except (KeyError, UnicodeError):
        return None


def misread(text: str, chain: tuple[str, ...]) -> str | None:
    for encoding in chain:
        if text is None:
            return None
        text = _misread(text, encoding)
    return text


def reread(text: str, chain: tuple[str, ...]) -> str | None:
    for encoding in reversed(chain):
        if text is None:
            return None
        text = _reread(text, encoding)
    return text


@lru_cache(maxsize=1 << 16)
def inversions(run: str) -> tuple[str, ...]:
    """What a stretch beyond ASCII could have been before each chain, longest chains last."""
    found = []
    for chain in CHAINS:
        back = reread(run, chain)
        if back is not None and back != run and len(back) < len(run) + 1 and back not in found:
            found.append(back)
    return tuple(found)


def is_clean(word: str) -> bool:
    """Whether no chain could have made any stretch of it and nothing is lost."""
    return LOST not in word and not any("\x80" <= c <= "\x9f" for c in word) and not any(inversions(r) for r in _RUN.findall(word))


#: Encodings of which one is read as another, and letters that a word needs for that to be told from a rare character.
ONE_BYTE, LETTERS = ("cp1252", "latin-1", "cp437", "cp850", "mac_roman", "cp1251", "cp1250", "koi8-r", "cp866"), 3

_SHAKY = re.compile("[\x80-\x9f\xa0\xad]")


def forms(word: str) -> Iterator[tuple[str, bool, bool]]:
    """Garbled forms of a clean word, whether they may be words of their own (something was lost, or one-byte text read in another one-byte encoding), and whether they are the latter."""
    seen = {word}
    for chain in CHAINS:
        made = misread(word, chain)
        if made is None or made in seen:
            continue
        seen.add(made)
        yield made, False, False
        if len(chain) == 1 and _SHAKY.search(made):
            for to in ("", "?"):
                less = _SHAKY.sub(to, made).strip(_AROUND)
                if less not in seen and not less.isascii():
                    seen.add(less)
                    yield less, True, False
    if sum(map(str.isalpha, word)) >= LETTERS:
        for source in ONE_BYTE:
            try:
                data = bytes([_single(source)[1][c] for c in word])
            except KeyError:
                continue
            for encoding in ONE_BYTE:
                made = "".join([_single(encoding)[0][b] for b in data])
                if made not in seen and not made.isascii():
                    seen.add(made)
                    if consistent(made) == made:  # else look-alike letters of another script, as in problem 2
                        yield made, True, True
    for encoding in ("latin-1",):  # the other way round: one-byte text read as UTF-8
        try:
            made = word.encode(encoding).decode("utf-8", "replace")
        except UnicodeEncodeError:
            continue
        if made not in seen:
            seen.add(made)
            yield made, True, False


def words_of(text: str) -> list[str]:
    """Distinct words beyond ASCII of a text, and its groups of layout markers."""
    out = []
    for part in _SPLIT.split(text):
        if part and not part.isascii():
            word = part.strip(_AROUND)
            if word:
                out.append(word)
    return list(dict.fromkeys(out))


def text_words(texts: DataFrame) -> DataFrame:
    """place, item_id, word, clean: the distinct words beyond ASCII of each of (place, item_id, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[str, bool] = {}
        for batch in batches:
            rows, words, clean = [], [], []
            for row, value in enumerate(batch.column(2)):
                for word in words_of(value.as_py() or ""):
                    if word not in known:
                        if len(known) > 1 << 18:
                            known.clear()
                        known[word] = is_clean(word)
                    rows.append(row)
                    words.append(word)
                    clean.append(known[word])
            at = pa.array(rows, pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0).take(at), batch.column(1).take(at), pa.array(words, pa.string()), pa.array(clean, pa.bool_())], ["place", "item_id", "word", "clean"])

    some = texts.where("text is not null").where(F.col("text").rlike("[^\\x00-\\x7F]"))
    return some.select("place", F.col("item_id").cast("bigint"), "text").mapInArrow(run, "place string, item_id bigint, word string, clean boolean")


def form_table(clean: DataFrame) -> DataFrame:
    """form, original, lost, swapped, n: one row for each garbled form of the words of (word, n), where n tells how many texts hold it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        use(((), ()))  # the fixed looks alone, whatever this process did before
        for batch in batches:
            out: list[tuple[str, str, bool, bool, int]] = []
            for word, n in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                out += [(form, word, lost, swapped, n) for form, lost, swapped in forms(word)]
                if len(out) > 50_000:
                    yield _rows(out)
                    out = []
            yield _rows(out)

    def _rows(out: list[tuple]) -> pa.RecordBatch:
        cols = list(zip(*out)) or [()] * 5
        kinds = (pa.string(), pa.string(), pa.bool_(), pa.bool_(), pa.int64())
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds)], ["form", "original", "lost", "swapped", "n"])

    return clean.select("word", "n").mapInArrow(run, "form string, original string, lost boolean, swapped boolean, n bigint")


def taken_apart(word: str, known: frozenset[str]) -> str | None:
    """The word with every stretch restored that forms of known characters make up; None if there is none."""

    def back(m: re.Match) -> str:
        for option in inversions(m.group()):
            if all(c.isascii() or c in known for c in option):
                return option
        return m.group()

    made = _RUN.sub(back, word)
    return made if made != word else None


def garbled_words(words: DataFrame) -> DataFrame:
    """word, original (null if it can't be restored), way ('table': a form of a clean word; 'apart': taken apart) of the garbled words among (place, item_id, word, clean)."""
    counts = words.groupBy("word", "clean").agg(F.count("*").alias("n"))
    counts = staged(counts, "words")
    clean, other = counts.where("clean"), counts.where("not clean")
    table = form_table(spread(clean))
    # a form that is a clean-looking word itself counts only if it has lost something, is rarer than its original, and short of letters
    suspects = counts.select("word", F.col("n").alias("own"), "clean")
    met = table.join(suspects, F.col("form") == F.col("word")).where("(not clean and not swapped) or (lost and own < n)")
    hits = met.groupBy("word").agg(F.max_by("original", F.struct(~F.col("swapped"), "n", F.col("original"))).alias("original"))
    missed = other.join(hits.select("word"), "word", "left_anti")
    # distinct characters of clean words: no more than Unicode has
    chars = clean.select(F.explode(F.array_distinct(F.split("word", ""))).alias("c")).where("c > '\\u007f'").distinct()
    known = frozenset(r.c for r in chars.collect()) | frozenset(chr(c) for c in range(0x24B6, 0x24EA))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = [(w, made, made is not None or LOST in w) for w in batch.column(0).to_pylist() for made in [taken_apart(w, known)]]
            out = [x for x in out if x[2]]
            yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in out], pa.string()), pa.array([None if x[1] is None or LOST in x[1] else x[1] for x in out], pa.string())], ["word", "original"])

    apart = missed.select("word").mapInArrow(run, "word string, original string")
    return hits.withColumn("way", F.lit("table")).unionByName(apart.withColumn("way", F.lit("apart")))


#: Salts of a garbled word, as a third of all items may hold the same one.
SALTS = 8


def garbled(texts: DataFrame) -> DataFrame:
    """place, item_id, word, original, way: the garbled words of each item of (place, item_id, text)."""
    words = staged(text_words(texts), "text-words")
    bad = garbled_words(words).withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    rows = words.select("place", "item_id", "word", F.pmod(F.xxhash64("item_id"), F.lit(SALTS)).cast("int").alias("salt"))
    return rows.join(bad, ["word", "salt"]).select("place", "item_id", "word", "original", "way").dropDuplicates(["place", "item_id", "word"])


def replaced(text: str, to: dict[str, str]) -> str:
    """The text with whole words replaced, as words_of parts them; what stands around a word stays, and so does the same string inside another word."""
    if not to:
        return text
    out = []
    at = 0
    for gap in _SPLIT.finditer(text + "\n"):  # the last word, too, has a gap after it
        part, word = text[at : gap.start()], ""
        if part and not part.isascii():
            word = part.strip(_AROUND)
        out.append(part.replace(word, to[word], 1) if word in to else part)
        out.append(text[gap.start() : gap.end()])
        at = gap.end()
    return "".join(out)


def restored(texts: DataFrame) -> DataFrame:
    """place, item_id, text with the garbled words replaced, n_garbled, complete (all of them could be) of the items concerned."""
    bad = garbled(texts).groupBy("place", "item_id").agg(F.collect_list(F.struct("word", "original")).alias("swaps"))
    rows = texts.groupBy("place", "item_id").agg(F.first("text").alias("text")).join(bad, ["place", "item_id"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for text, swaps in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist()):
                to = {s["word"]: s["original"] for s in swaps if s["original"] is not None}
                out.append((replaced(text, to), len(swaps), len(to) == len(swaps)))
            cols = list(zip(*out)) or [(), (), ()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(cols[0], pa.string()), pa.array(cols[1], pa.int32()), pa.array(cols[2], pa.bool_())], ["place", "item_id", "text", "n_garbled", "complete"])

    return rows.select("place", "item_id", "text", "swaps").mapInArrow(run, "place string, item_id bigint, text string, n_garbled int, complete boolean")
