"""One consistent form for texts that print the same (problem 2).

Every character has a look: width of letters, composed or separate accents, kinds of space and characters without any
print make no difference, and letters of other scripts that are drawn alike share one. The form is spelled from looks
only, so that equal looks are equal strings: for every token (run of letters and marks) the sets of scripts in which each
of its looks can be written are intersected. One script left: the token is spelled in it. Several left (the whole
token is confusable): the script that most unmistakable tokens of the text have, if it is among them, else the first of
Latin, Cyrillic, Greek. None left: if the looser looks of its letters (those that resemble a Latin letter for which their script has a closer one)
leave a script, they are taken; otherwise the token is mixed for good, its looks stay as they are.

Scripts are those of Unicode's Script_Extensions, with Han, kana, Hangul and bopomofo taken together as their writing systems do. Letters drawn alike are a short fixed
list and, on a session, all that the Unicode confusables data of the ICU library, which Spark ships, hold of cased letters (look_table).

Kept apart as visible: case, true accents, superscripts, layout markers against letters, line breaks, number of spaces.
Defined results: null stays null, an empty text is empty, a text of characters without print becomes empty.
"""

from __future__ import annotations

import hashlib
import re
import sys
import unicodedata
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quirework.session import staged

#: Letters drawn alike, in the order of the Latin ones (upper case, then lower).
LATIN_CYRILLIC = (
    "ABCEHIJKMOPQSTWXY" "acdehijlopqswxy",
    "АВСЕНІЈКМОРԚЅТԜХУ" "асԁеһіјӏорԛѕԝху",
)
LATIN_GREEK = ("ABEHIKMNOPTXYZ" "aijopuvc", "ΑΒΕΗΙΚΜΝΟΡΤΧΥΖ" "αιϳορυνϲ")
LATIN_ARMENIAN = ("ounhq", "օսոհզ")
#: Cyrillic and Greek letters alike that no Latin letter resembles.
CYRILLIC_GREEK = ("ГПФк", "ΓΠΦκ")

MARKERS = "Ⓐ-ⓩ"
_CYRILLIC, _GREEK, _ARMENIAN = "Cyrillic", "Greek", "Armenian"
_ORDER = ("Latin", _CYRILLIC, _GREEK, _ARMENIAN)
#: Characters of category Cf that do print (signs that enclose or precede numbers).
PRINTED = frozenset({*range(0x0600, 0x0606), 0x06DD, 0x070F, 0x0890, 0x0891, 0x08E2, 0x110BD, 0x110CD})
#: Names of scripts in Unicode.
SCRIPTS = (
    "Latin Cyrillic Greek Armenian Coptic Cherokee Georgian Hebrew Arabic Syriac Thaana Devanagari Bengali Gurmukhi Gujarati Oriya Tamil Telugu Kannada Malayalam Sinhala Thai Lao Tibetan "
    "Myanmar Ethiopic Khmer Mongolian Han Hiragana Katakana Hangul Bopomofo Yi Lisu Vai Nko Tifinagh Gothic Deseret Osage Glagolitic Runic Ogham Canadian_Aboriginal Adlam Warang_Citi Medefaidrin Old_Hungarian Vithkuqi"
).split()
#: Writing systems of several scripts.
SYSTEMS = {"Han": ("Chinese_Bopomofo", "Japanese", "Korean"), "Hiragana": ("Japanese",), "Katakana": ("Japanese",), "Hangul": ("Korean",), "Bopomofo": ("Chinese_Bopomofo",)}

#: Looks of a session beyond the fixed ones: (character, look, script) that hold always, and (character, look) that only mend mixed tokens.
Table = tuple[tuple[tuple[str, str, str], ...], tuple[tuple[str, str], ...]]
_used: Table = ((), ())
#: Everyday letters of Greek, Cyrillic and Armenian, of which the fixed list has those drawn alike.
ALPHABETS = (("Α", "ω"), ("А", "я"), ("Ա", "և"))


def use(table: Table) -> None:
    """Makes a session's table that of this process."""
    global _used
    if table != _used:
        _used = table
        for cached in (_looks, _scripts, token_scripts):
            cached.cache_clear()


def look_table(spark: SparkSession) -> Table:
    """Cased letters of other scripts (and those of Lisu, drawn as capitals) that ICU's confusables data give the skeleton of an ASCII letter of the same case.

    A script's letter has the look if no other letter of that script has it already: two letters that one script keeps apart stay apart in its words. The letters of the
    everyday alphabets that the fixed list leaves out (г, γ) only mend mixed tokens, too."""
    known = _TABLES.get(spark.sparkContext.applicationId)
    if known is None:
        letters = [chr(cp) for cp in range(0x250, sys.maxunicode + 1) if unicodedata.category(chr(cp)) in ("Lu", "Ll") or 0xA4D0 <= cp <= 0xA4F7]
        letters = [c for c in letters if "Latin" not in script_set(c) and script_set(c) & {*SCRIPTS} and unicodedata.normalize("NFD", c) == c]
        ascii_ = [*"ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz"]
        icu = spark._jvm.com.ibm.icu.text.SpoofChecker.Builder().build()
        made = icu.getSkeleton("\n".join([*ascii_, *letters])).split("\n")
        skeletons = dict(zip([*ascii_, *letters], made, strict=True))
        of: dict[tuple[str, bool], str] = {}
        for c in ascii_:
            of.setdefault((skeletons[c], c.isupper()), c)
        fixed, spell = _looks()
        taken = {(s, look) for s, each in spell.items() for look in each}
        close, loose = [], []
        for c in letters:
            look = of.get((skeletons[c], not c.islower()))
            if look is None or ord(c) in fixed:
                continue
            script = min(script_set(c) & {*SCRIPTS})
            if (script, look) not in taken and not any(low <= c <= high for low, high in ALPHABETS):
                taken.add((script, look))
                close.append((c, look, script))
            else:
                loose.append((c, look))
        known = _TABLES[spark.sparkContext.applicationId] = (tuple(close), tuple(loose))
    return known


_TABLES: dict[str, Table] = {}
_SCRIPT = {name: regex.compile(rf"\p{{scx={name}}}") for name in SCRIPTS}


@lru_cache(maxsize=1 << 14)
def script_set(c: str) -> frozenset[str]:
    """Scripts and writing systems of a letter."""
    found = {name for name, of in _SCRIPT.items() if of.match(c)}
    return frozenset({*found, *(s for f in found for s in SYSTEMS.get(f, ()))} or {unicodedata.name(c, "").split(" ", 1)[0].capitalize()})


@lru_cache(maxsize=1)
def _looks() -> tuple[dict[int, str | None], dict[str, dict[str, str]]]:
    """The look of every character that isn't its own (after canonical decomposition), and by script how to spell a look in it."""
    table: dict[int, str | None] = {}
    for cp in range(sys.maxunicode + 1):
        c = chr(cp)
        kind = unicodedata.category(c)
        if kind == "Zs" or c == "\t":
            table[cp] = " "
        elif kind == "Cf" and cp not in PRINTED or kind == "Cc" and c not in "\n\r\x0b\x0c\x85":
            table[cp] = None
        elif (d := unicodedata.decomposition(c)).startswith(("<wide>", "<narrow>")):
            table[cp] = "".join(chr(int(x, 16)) for x in d.split()[1:])
    for cp in (0x034F, 0x115F, 0x1160, 0x17B4, 0x17B5, 0x3164, 0xFFA0, *range(0x180B, 0x1810), *range(0xFE00, 0xFE10), *range(0xE0100, 0xE01F0)):
        table[cp] = None  # default ignorable without being of category Cf
    table.pop(0x20, None)
    table[0xB5] = "μ"
    spell: dict[str, dict[str, str]] = {s: {} for s in _ORDER}
    for (look, drawn), script in ((LATIN_CYRILLIC, _CYRILLIC), (LATIN_GREEK, _GREEK), (LATIN_ARMENIAN, _ARMENIAN)):
        for a, b in zip(look, drawn):
            table[ord(b)] = a
            spell[script].setdefault(a, b)
    for a, b in zip(*CYRILLIC_GREEK):
        table[ord(b)] = a
        spell[_GREEK][a] = b
    for b, a, script in _used[0]:
        table[ord(b)] = a
        spell.setdefault(script, {}).setdefault(a, b)
    for cp, to in list(table.items()):  # wide or narrow forms of letters that have a look themselves
        if to and len(to) == 1 and (further := table.get(ord(to), to)) != to:
            table[cp] = further
    return table, spell


def skeleton(text: str) -> str:
    """The looks of a text: equal for texts that print the same."""
    if text.isascii() and not _CONTROL.search(text):
        return text
    table, _ = _looks()
    return unicodedata.normalize("NFC", unicodedata.normalize("NFD", text).translate(table))


_CONTROL = re.compile(r"[\x00-\x09\x0e-\x1f\x7f]")
_TOKEN = re.compile(r"[^\W\d_]+(?:[̀-ͯ]+[^\W\d_]*)*")


@lru_cache(maxsize=1 << 14)
def _scripts(c: str) -> frozenset[str] | None:
    """Scripts in which the look c can be written; None if it belongs to any."""
    base, marks = (x := unicodedata.normalize("NFD", c))[0], x[1:]
    if not base.isalpha():
        return None
    _, spell = _looks()
    written = {s for s, each in spell.items() if base in each and len(unicodedata.normalize("NFC", each[base] + marks)) == 1}
    return script_set(base) | written


@lru_cache(maxsize=1 << 16)
def token_scripts(token: str) -> frozenset[str]:
    """Intersection of the script sets of a token's looks (empty: mixed for good)."""
    sets = [s for s in map(_scripts, token) if s is not None]
    return frozenset.intersection(*sets) if sets else frozenset({"Latin"})


def _spelled(token: str, script: str) -> str:
    table = _looks()[1].get(script, {})
    return unicodedata.normalize("NFC", "".join(table.get(c, c) for c in unicodedata.normalize("NFD", token)))


def consistent(text: str | None) -> str | None:
    """The consistent form of a text."""
    if text is None or text.isascii() and not _CONTROL.search(text):
        return text
    looks = skeleton(text)
    if looks.isascii():
        return looks
    if _used[1]:
        looks = _TOKEN.sub(_mended, looks)
    sure = Counter(next(iter(s)) for t in _TOKEN.findall(looks) if len(s := token_scripts(t)) == 1)
    if not sure or {*sure} <= {"Latin"}:
        return looks
    main = min(sure, key=lambda s: (-sure[s], s))

    def spell(m: re.Match) -> str:
        token = m.group()
        scripts = token_scripts(token)
        if not scripts:
            return token
        script = main if main in scripts else next((s for s in _ORDER if s in scripts), min(scripts))
        return _spelled(token, script) if script != "Latin" else token

    return _TOKEN.sub(spell, looks)


def _mended(m: re.Match) -> str:
    """A mixed token by the looser looks of its letters, if these leave it a script."""
    token = m.group()
    if token_scripts(token):
        return token
    loose = unicodedata.normalize("NFC", unicodedata.normalize("NFD", token).translate({ord(c): look for c, look in _used[1]}))
    return loose if loose != token and token_scripts(loose) else token


def confusables(text: str | None) -> tuple[int, int]:
    """Tokens of a text that mix scripts as written, and tokens that a single other script could have written whole."""
    mixed = whole = 0
    for token in _TOKEN.findall(unicodedata.normalize("NFKC", text or "")):
        sets = [script_set(c) for c in unicodedata.normalize("NFD", token) if c.isalpha()]
        common = frozenset.intersection(*sets) if sets else frozenset()
        mixed += bool(sets) and not common
        whole += bool(common) and "Latin" not in common and "Latin" in token_scripts(skeleton(token))
    return mixed, whole


_SHOWN = re.compile(r"[^\W_]")


def has_print(text: str | None) -> bool:
    """Whether a letter or digit stands in it, layout markers aside."""
    return bool(text) and bool(_SHOWN.search(text))


def normalized(df: DataFrame, key: str, text: str) -> DataFrame:
    """key, form, n_mixed, n_whole, changed of each row."""
    kind, table = df.schema[key].dataType.simpleString(), look_table(df.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        use(table)
        for batch in batches:
            texts = batch.column(1).to_pylist()
            forms = [consistent(t) for t in texts]
            counts = [confusables(t) if t is not None and not t.isascii() else (0, 0) for t in texts]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(forms, pa.string()), pa.array([c[0] for c in counts], pa.int32()), pa.array([c[1] for c in counts], pa.int32()), pa.array([a != b for a, b in zip(texts, forms)], pa.bool_())],
                [key, "form", "n_mixed", "n_whole", "changed"],
            )

    return df.select(key, text).mapInArrow(run, f"`{key}` {kind}, form string, n_mixed int, n_whole int, changed boolean")


def _look_keys(df: DataFrame, every: bool) -> DataFrame:
    """owner, item, look, own: 16-byte digests of the form and of the string as it is. every: also strings without letter or digit."""
    table = look_table(df.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        use(table)
        digest = lambda s: hashlib.blake2b(s.encode("utf-8", "replace"), digest_size=16).digest()
        for batch in batches:
            owners, items, look, own = [], [], [], []
            for o, i, t in zip(*(c.to_pylist() for c in batch.columns)):
                if t and (every or has_print(t)):
                    owners.append(o)
                    items.append(i)
                    look.append(digest(consistent(t)))
                    own.append(digest(t))
            yield pa.RecordBatch.from_arrays([pa.array(owners, pa.int64()), pa.array(items, pa.int64()), pa.array(look, pa.binary()), pa.array(own, pa.binary())], ["owner", "item", "look", "own"])

    return df.select(F.col("owner").cast("bigint"), F.col("item").cast("bigint"), "text").mapInArrow(run, "owner bigint, item bigint, look binary, own binary")


#: Salts of a look or a spelling, as a third of all rows may share one.
SALTS = 8


def _salted(df: DataFrame, by: str) -> DataFrame:
    return df.withColumn("salt", F.pmod(F.xxhash64(by), F.lit(SALTS)).cast("int"))


def _repeated(df: DataFrame) -> DataFrame:
    return df.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))


def same_print(df: DataFrame, every: bool = False) -> DataFrame:
    """owner, item_a, item_b: pairs of items of one owner whose strings differ but print the same. df: owner, item, text.

    Distinct spellings of a look are paired first (few), then joined with the items that have them, so that a group of
    equal copies, however large, is never paired with itself. Looks and spellings are salted, none is gathered in one row. An item delivered several times counts once.
    """
    keys = staged(_look_keys(df, every).dropDuplicates(["owner", "item", "own"]), "looks")
    spellings = keys.select("owner", "look", "own").distinct()
    several = spellings.groupBy("owner", "look").agg(F.count("*").alias("n")).where("n > 1").select("owner", "look")
    spellings = spellings.join(several, ["owner", "look"], "left_semi")
    a, b = _salted(spellings.withColumnRenamed("own", "a"), "a"), _repeated(spellings.withColumnRenamed("own", "b"))
    pairs = a.join(b, ["owner", "look", "salt"]).where("a <> b").select("owner", "a", "b")
    left = _salted(keys.select("owner", F.col("own").alias("a"), F.col("item").alias("item_a")), "item_a")
    right = _salted(keys.select("owner", F.col("own").alias("b"), F.col("item").alias("item_b")), "item_b")
    met = _repeated(pairs).join(left, ["owner", "a", "salt"]).drop("salt")
    met = _repeated(met).join(right, ["owner", "b", "salt"]).where("item_a < item_b")
    return met.select("owner", "item_a", "item_b").dropDuplicates()


def print_classes(df: DataFrame, every: bool = False) -> DataFrame:
    """owner, item, class (hash of its look), spellings (different strings of the class) and links (items of the class that are spelled differently): one row an item."""
    keys = _look_keys(df, every).dropDuplicates(["owner", "item", "own"]).select("owner", "item", F.hex("look").alias("class"), "own")
    own = keys.groupBy("owner", "class", "own").agg(F.count("*").alias("same"))
    of = own.groupBy("owner", "class").agg(F.count("*").alias("spellings"), F.sum("same").alias("items"))
    sizes = own.join(of, ["owner", "class"]).select("owner", "class", "own", "spellings", (F.col("items") - F.col("same")).alias("links"))
    return _salted(keys, "item").join(_repeated(sizes), ["owner", "class", "own", "salt"]).select("owner", "item", "class", "spellings", "links")
