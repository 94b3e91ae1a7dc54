"""Column expressions over strings: normalisation for metrics, layout markers, line wrapping, label features.

All work on code points and stay in the JVM. Null strings give null results unless a function says otherwise.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Layout markers by corpus family, begin to end.
READ_PAIRS = {"ⓟ": "Ⓟ", "ⓝ": "Ⓝ", "ⓢ": "Ⓢ", "ⓐ": "Ⓐ", "ⓑ": "Ⓑ"}
LETTER_PAIRS = {"ⓑ": "Ⓑ", "ⓞ": "Ⓞ", "ⓡ": "Ⓡ", "ⓢ": "Ⓢ", "ⓦ": "Ⓦ", "ⓨ": "Ⓨ", "ⓟ": "Ⓟ"}
ACT_PAIRS = {"ⓟ": "Ⓟ", "ⓜ": "Ⓜ", "ⓝ": "Ⓝ", "ⓑ": "Ⓑ", "ⓘ": "Ⓘ", "ⓢ": "Ⓢ"}
#: Region types of letters and their begin markers.
LETTER_TYPES = {"opening": "ⓞ", "body": "ⓑ", "postscript": "ⓟ", "sender": "ⓢ", "reference": "ⓢ", "subject": "ⓨ", "date_place": "ⓦ", "recipient": "ⓡ"}
#: Markers of the joint corpus and those of the single corpora they stand for.
JOINT_TO_SINGLE = {"ⓒ": "ⓑ", "ⓕ": "ⓢ", "ⓔ": "ⓟ", "Ⓒ": "Ⓑ", "Ⓕ": "Ⓢ", "Ⓔ": "Ⓟ", "ⓚ": "ⓟ", "ⓗ": "ⓑ", "ⓙ": "ⓝ", "Ⓚ": "Ⓟ", "Ⓗ": "Ⓑ", "Ⓙ": "Ⓝ"}
#: Punctuation that counts as a word of its own (the backslash does not).
WORD_PUNCTUATION = "[]{}/()\"'&+*=<>?.;:,!-—_€#%°"
#: Accents that are folded away where a charset lacks the letter.
FOLDED = {"Â": "A", "È": "E", "É": "E", "Û": "U", "à": "a", "â": "a", "ä": "a", "ç": "c", "è": "e", "é": "e", "ê": "e", "ë": "e", "î": "i", "ï": "i", "ô": "o", "ö": "o", "ù": "u", "û": "u", "ü": "u", "ÿ": "y"}
#: What a text corpus is rid of when it is read in.
CORPUS_DROPPED, CORPUS_CHANGED = "!%*+=>@\\{}²€", {"À": "A", "Ç": "C", "É": "E", "Ê": "E", "Ô": "O", "œ": "oe"}
#: Repairs of wrongly decoded annotations, in the order in which they are made; characters without print are written as escapes.
ANNOTATION_REPAIRS = (
    ("\\n", "\n"), ("<euro>", "€"), (">euro>", "€"), (">fligne>", " "), ("Â¤", "¤"), ("Ã»", "û"), ("\ufffd", ""), ("ï¿©", "é"), ("Ã§", "ç"),
    ("Ã©", "é"), ("Ã´", "ô"), ("\xa0", " "), ("Ã¨", "è"), ("Â°", "°"), ("Ã\x80", "À"), ("Ã¬", "À"), ("Ãª", "ê"), ("Ã®", "î"), ("Ã¢", "â"),
    ("Â²", "²"), ("Ã¹", "ù"), ("Ã", "à"), ("¬", "€"),
)
#: Spellings of annotators' alternatives, in the order in which the first group takes their place (a dot is any character).
ALTERNATIVES = (
    r"¤\{([^¤]*)[/|]([^¤]*)\}¤",
    r"¤\{([^¤]*)[/|]([^¤]*)[/|]([^¤]*)>",
    r"¤([^¤]*)[/|]([^¤]*)¤",
    r"¤\{\}¤([^¤]*)[/|]([^ ]*)",
    r"¤\{/([^¤]*)/([^ ]*)",
    r"¤\{([^¤]*)[/|]([^ ]*)",
    r"([^¤]*)/(.*)[¤}{]+",
    r"[¤}{]+([^¤}{]*)[¤}{]+",
    r"¤([^¤]*)¤",
)
#: Most occurrences of a character in a valid line and in a valid page.
LINE_LIMITS = {"|": 2, "(": 10, ".": 20, "-": 20, ":": 20, ",": 20, "/": 15, '"': 10, "'": 10}
PAGE_LIMITS = {"|": 2, "(": 10, ".": 40, "-": 50, ":": 40, ",": 30, "/": 15, '"': 50, "'": 30}


def chars(s: Column) -> Column:
    """Code points of a string; an empty string has none."""
    return F.when(s == "", F.array().cast("array<string>")).otherwise(F.split(s, ""))


def class_of(characters: str, negated: bool = False) -> str:
    """A regular expression for one of the characters."""
    return "[" + "^" * negated + "".join("\\" + c if c in "[]\\^-&" else c for c in characters) + "]"


def keep_tokens(s: Column, tokens: str) -> Column:
    if not tokens:
        raise ValueError("no tokens are given")
    return F.regexp_replace(s, class_of(tokens, negated=True), "")


def strip_tokens(s: Column, tokens: str) -> Column:
    return F.translate(s, tokens, "")


def to_single(s: Column) -> Column:
    """Joint markers renamed; no target is a source, so one pass is the whole chain."""
    return F.translate(s, "".join(JOINT_TO_SINGLE), "".join(JOINT_TO_SINGLE.values()))


def stripped(s: Column) -> Column:
    """Without white space at both ends."""
    return F.regexp_replace(F.regexp_replace(s, r"(?U)^\s+", ""), r"(?U)\s+\z", "")


def cer_normalise(s: Column, tokens: str | None = None) -> Column:
    """For character error rates: no tokens nor unknowns, single line feeds and spaces, nothing blank at the ends."""
    if tokens is not None:
        s = F.replace(strip_tokens(s, tokens), F.lit("<unk>"), F.lit(""))
    return stripped(F.regexp_replace(F.regexp_replace(s, "\n+", "\n"), " +", " "))


def wer_normalise(s: Column, tokens: str | None = None) -> Column:
    """Words for word error rates: punctuation marks are words; tokens vanish afterwards, so that words across them fuse; an empty text is one empty word."""
    s = F.regexp_replace(s, f"({class_of(WORD_PUNCTUATION)})", " $1 ")
    if tokens is not None:
        s = strip_tokens(s, tokens)
    return F.split(stripped(F.regexp_replace(s, "[ \n]+", " ")), " ")


def text_label_clean(s: Column) -> Column:
    """Single line feeds and spaces, none at the ends."""
    return F.btrim(F.regexp_replace(F.regexp_replace(s, "\n+", "\n"), " +", " "), F.lit(" \n"))


def annotation_repair(s: Column) -> Column:
    for a, b in ANNOTATION_REPAIRS:
        s = F.replace(s, F.lit(a), F.lit(b))
    return s


def first_alternative(s: Column) -> Column:
    """Annotators' alternatives ¤{a/b}¤ in their many spellings: the first one stays; spaces are single, none at the ends."""
    made = s
    for spelling in ALTERNATIVES:
        made = F.regexp_replace(made, "(?s)" + spelling, "$1")
    return stripped(F.regexp_replace(F.when(s.contains("¤"), made).otherwise(s), " +", " "))


def wrapped(s: Column, begin: Column, end: Column) -> Column:
    """Between its markers; without a begin marker as it is."""
    return F.when(begin.isNull() | (begin == ""), s).otherwise(F.concat(begin, s, F.coalesce(end, F.lit(""))))


def fold_missing(s: Column, charset: str) -> Column:
    """Accents folded away of letters that the charset lacks."""
    missing = {a: b for a, b in FOLDED.items() if a not in charset}
    return F.translate(s, "".join(missing), "".join(missing.values())) if missing else s


def only_charset(s: Column, charset: str) -> Column:
    """Folded, then rid of everything that is neither in the charset nor a space."""
    return F.regexp_replace(fold_missing(s, charset), class_of(charset + " ", negated=True), "")


def corpus_clean(s: Column) -> Column:
    s = F.translate(s, CORPUS_DROPPED, "")
    for a, b in CORPUS_CHANGED.items():
        s = F.replace(s, F.lit(a), F.lit(b))
    return s


def upper_folded(s: Column) -> Column:
    """Upper case without accents."""
    s = F.replace(F.replace(F.upper(s), F.lit("Œ"), F.lit("OE")), F.lit("Æ"), F.lit("AE"))
    return F.translate(s, "ÀÂÄÇÈÉÊËÎÏÔÖÙÛÜŸ", "AAACEEEEIIOOUUUY")


def is_invalid(s: Column, limits: dict[str, int] = PAGE_LIMITS) -> Column:
    """Whether any limited character occurs too often."""
    found = None
    for c, most in limits.items():
        one = F.char_length(s) - F.char_length(F.replace(s, F.lit(c), F.lit(""))) > most
        found = one if found is None else found | one
    return found


def _greedy(s: Column, width: int) -> Column:
    """Lines of a string that ends in a space: as many words as fit in width characters, else a single longer one. One pass of an expression, nothing grows."""
    return F.transform(F.regexp_extract_all(s, F.lit(f"(?s)(.{{0,{width}}} |[^ ]* )"), F.lit(1)), lambda x: F.trim(x))


def wrap_lines(s: Column, width: int) -> Column:
    """Greedy lines of at most width characters; a first word that is too long leaves an empty line before it."""
    long = F.char_length(F.substring_index(s, " ", 1)) > width
    return F.concat(F.when(long, F.array(F.lit(""))).otherwise(F.array().cast("array<string>")), _greedy(F.concat(s, F.lit(" ")), width))


def wrap_lines_b(s: Column, width: int) -> Column:
    """Greedy lines over words between any white space; the first line counts a space before its first word, too; a text without words has no line."""
    words = F.filter(F.split(s, r"\s+"), lambda w: w != "")
    return F.when(F.size(words) == 0, F.array().cast("array<string>")).otherwise(_greedy(F.concat(F.lit(" "), F.array_join(words, " "), F.lit(" ")), width))


def sentence_window(s: Column, start: Column, n: int) -> Column:
    """n sentences from the given one on (0 the first)."""
    return F.array_join(F.slice(F.split(s, r"\. "), start + 1, n), ". ")


def end_at_dot(s: Column) -> Column:
    """Up to the last dot before a space, if there is one."""
    cut = F.regexp_extract(s, r"(?s)^(.*\.) ", 1)
    return F.when(cut != "", cut).otherwise(s)


def truncate_words(s: Column, width: int) -> Column:
    """At most width characters, cut back to the last space."""
    return F.when(F.char_length(s) <= width, s).otherwise(F.regexp_replace(F.substring(s, 1, width), " [^ ]*$", ""))


def splice(a: Column, b: Column) -> Column:
    """The first half of one line's words and the second half of another's."""
    x, y = F.split(a, " "), F.split(b, " ")
    return F.array_join(F.concat(F.slice(x, 1, F.floor(F.size(x) / 2).cast("int")), F.slice(y, F.floor(F.size(y) / 2).cast("int") + 1, F.size(y))), " ")


def natural_key(s: Column) -> Column:
    """Sorts digit runs by value, of any length, and the rest in lower case."""
    runs = F.regexp_extract_all(s, F.lit("([0-9]+|[^0-9]+)"), F.lit(1))

    def number(r: Column) -> Column:
        digits = F.regexp_replace(r, "^0+(?=[0-9])", "")  # as many digits first, then the digits
        return F.concat(F.lpad(F.char_length(digits).cast("string"), 10, "0"), digits)

    return F.transform(runs, lambda r: F.when(r.rlike("^[0-9]"), number(r)).otherwise(F.lower(r)))


def page_number(s: Column) -> Column:
    """Digits left when dots, spaces and number markers are gone, as a number; null if there is anything else."""
    left = F.translate(s, ". ⓝⓃ", "")
    return F.when(left.rlike("^[0-9]{1,9}$"), left.cast("int"))


def tighten(s: Column) -> Column:
    """Pipes to spaces, no space before , . ; :"""
    s = F.replace(s, F.lit("|"), F.lit(" "))
    for c in ",.;:":
        s = F.replace(s, F.lit(" " + c), F.lit(c))
    return s


def encode(s: Column, charset: Column) -> Column:
    """Index in the charset of each character; -1 for one that is not there."""
    return F.transform(chars(s), lambda c: (F.array_position(charset, c) - 1).cast("int"))


def decode(ids: Column, charset: Column, unknown: str = "¤") -> Column:
    return F.array_join(F.transform(ids, lambda i: F.coalesce(F.get(charset, i), F.lit(unknown))), "")


def regions(s: Column, begin: str, end: str) -> Column:
    """Contents between a begin marker and the next end marker, from the left, without overlap."""
    return F.regexp_extract_all(s, F.lit(f"{begin}([^{end}]*){end}"), F.lit(1))


def canonical(s: Column) -> Column:
    """A set of characters as one key: in the order of code points."""
    return F.array_join(F.array_sort(chars(s)), "")


def label_features(s: Column) -> Column:
    """Lines, words (line feeds are spaces, double spaces made single once) and counts."""
    words = F.split(F.replace(F.replace(s, F.lit("\n"), F.lit(" ")), F.lit("  "), F.lit(" ")), " ")
    lines = F.split(s, "\n")
    return F.struct(F.size(lines).alias("n_lines"), F.size(words).alias("n_words"), F.char_length(s).alias("n_chars"))
