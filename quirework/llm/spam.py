"""Pages of repeated keywords, links or product tags instead of sentences (problem 9).

Two kinds of evidence are joined. Replication: the texts of all pages are exploded into phrases (every two successive words of
a list item), and of each phrase the distinct hosts that use it are counted; a phrase is stitched in if it stands on several hosts or again and again in
the page. List density: what share of a page is links, tagged, counted or priced lists and fragments rather than sentences. A page is spam if more than
half of it is such lists and at least half of its items (a quarter where links, tags and prices alone make up more than half) are stitched in, or their words repeat themselves.

Only phrases of dense pages need host counts, and of these only the ones that the dense pages alone do not show on enough hosts; the phrases of all pages are first reduced
to those, by a filter of bits and then exactly. Their counts come from every page.
Not stuffing: lines of an index (entries that end in page numbers), dated or headed sentences (calendars, glossaries), repeated whole
sentences (refrains), quantities of different things (inventories). Defined results: null, empty and blank texts are never flagged; a page without
URL has its source as host; repeated rows of a doc_id are pages of their own and give one row.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quirework.session import staged

#: Distinct hosts that make a phrase a replicated one, share of a page that makes it spam.
HOSTS, SHARE = 3, 0.5
#: Words that a page at most turns over and over if its sentences are to count as a list.
FEW = 40
#: Times that a phrase in a page counts as repeated, and list items that make a list.
OWN, ITEMS = 3, 6

_SPACES = re.compile(r"[^\S\n\t ]")
#: What every link has; pages without it are not searched for the forms of links. Both begin with the rarest sign and look back from there.
_ANCHOR = re.compile(r"[.:\]\[<](?:(?<=http:)|(?<=https:)|(?<=www\.)|(?<=\.)(?:(?:example|test|invalid|localhost|com|org|net|info|biz|eu|de|fr|uk)\b|[a-z]{2,24}(?:/|\s*$))|(?<=\])\(|(?<=\[)url|(?<=<)a )", re.I | re.M)
_CURRENCY = re.compile(r"[.,](?<=\d.)\d\d ?[€$£EUf]")
_LINK = re.compile(
    r"<a\s[^>]*>.*?</a>|\[url=[^\]]*\].*?\[/url\]|\*?\s*\[[^\]\n]*\]\([^)\s]*\)|(?:[^\W\d_][\w' ]{0,40} - )?(?:https?://|www\.)[^\s<>\"]+"
    r"|(?:[^\W\d_][\w']*(?: [\w']+){0,3} - )?\b[a-z0-9][a-z0-9.-]*\.(?:example|test|invalid|localhost|com|org|net|info|biz|eu|de|fr|uk)\b(?:/\S*)?"
    r"|\b[a-z0-9-]+(?:\.[a-z0-9-]+)*\.[a-z]{2,24}/\S+|^[ \t]*[a-z0-9-]+(?:\.[a-z0-9-]+)*\.[a-z]{2,24}[ \t]*$",
    re.I | re.S | re.M,
)
_TRAIL = re.compile(r"^[^\n]*\S (?:>|›|»|::) \S[^\n]* (?:>|›|»|::) [^\n]*$", re.M)
_TAG = re.compile(r"#[^\W\d_][\w’']*")
_PRICE = re.compile(r"\b(?:No\.\s?\d+|Pro|Set|XL|XXL|\d+er)?\s?\d+[.,]\d\d ?(?:€|\$|£|EUR|USD|frs|fr)(?!\w)")
_COUNT = re.compile(r"\(\d+\)")
_INDEX = re.compile(r"^[^\n:]{2,80}: \d+(?:, ?\d+)*\s*$")
_HEADED = re.compile(r"^(?:\d{1,2}\.\d{1,2}\.\t|[^\W\d_][\w' -]{0,30}: )(.*?[.!?。])(?:\t\d+)?\s*$")
_STOP = re.compile(r"(?<=[.!?;])\s+|(?<=[。！？；])")
_NARROW_STOP = re.compile(r"\s(?<=[.!?;].)\s*", re.S)  # the same for texts without wide stops
_MARKER = re.compile(r"[Ⓐ-ⓩ]+")
_WORD = re.compile(r"[^\W_]+")
_PLAIN_WORD = re.compile(r"\w+")  # the same for texts without underscores
_WIDE = re.compile(r"[぀-ヿ㐀-鿿豈-﫿]")


def _repeated(words: list[str]) -> float:
    """Share of the words that stood there before, short ones aside."""
    if len({*words}) == len(words):
        return 0.0
    long = [w for w in words if len(w) > 3 or not w.isascii() and _WIDE.search(w)]
    return 1 - len({*long}) / len(long) if len(long) > 3 else 0.0


def _key(phrase: str) -> str:
    return " ".join(_WORD.findall(phrase.lower().replace("-", " ")))


def _enumerates(sentence: str) -> bool:
    """Many short items between commas or the like, some of them again and again."""
    if sum(map(sentence.count, (",", ";", "|", "/", "·", "~", "\n", "  "))) < 5:
        return False
    found = [_key(x) for x in re.split(r"[,;|/·~\n]| {2,}", sentence) if x.strip()]
    short = [x for x in found if 0 < len(x.split()) <= 5]
    return len(short) >= 6 and len(short) >= 0.8 * len(found) and len({*short}) <= 0.8 * len(short)


def _marks(text: str, priced: bool) -> tuple[int, int, int]:
    """Tags, prices (looked for if the page has anything like one) and bracketed counts."""
    return (
        len(_TAG.findall(text)) if "#" in text else 0,
        len(_PRICE.findall(text)) if priced and _CURRENCY.search(text) else 0,
        len(_COUNT.findall(text)) if "(" in text else 0,
    )


def _sentence(text: str, priced: bool, wide_page: bool) -> list[str] | None:
    """The words of a stretch up to a stop if it reads as a sentence rather than a list."""
    if text.rstrip()[-1:] not in ".!?;。！？；":
        return None
    words = (_WORD if "_" in text else _PLAIN_WORD).findall(text.lower())
    wide = len(_WIDE.findall(text)) if wide_page else 0
    if max(len(words), wide // 2) < 4 or len(words) > 150:
        return None
    if wide and wide < 0.5 * len(text.replace(" ", "")) and len(words) < 4 or wide and _REPEATED_WIDE.search(text):
        return None
    tags, prices, counts = _marks(text, priced)
    if tags > 2 or prices > 1 or counts > 2:
        return None
    # one word that stood there before is a quarter at most
    return words if (len({*words}) >= len(words) - 1 or _repeated(words) < 0.4) and not _enumerates(text) else None


_REPEATED_WIDE = re.compile(r"(.{4,})[\s+=?!]+\1")


def _signs(text: str) -> str:
    """The different characters of a text that is not all ASCII."""
    return "".join({*text})


def parts(text: str) -> dict:
    """Characters of a page altogether, in links, in sentences and in tagged, counted or priced lists; number of links; its other fragments. Of a page that is certain to be
    mostly sentences the rest is not looked at."""
    signs = "" if text.isascii() else _signs(text)
    if _SPACES.search(signs) or "\r" in text or "\f" in text or "\v" in text:
        text = _SPACES.sub(" ", text)
    text = text.strip()
    wide_page = _WIDE.search(signs) is not None
    total = len(" ".join(text.split()))
    priced = _CURRENCY.search(text) is not None
    out = {"total": total, "link": 0, "links": 0, "prose": 0, "listed": 0, "loose": []}

    def cut(m: re.Match) -> str:
        out["link"] += len(m.group()) + 1
        out["links"] += 1
        return "\n\n"

    if any(sign in text for sign in (" > ", " › ", " » ", " :: ")):
        text = _TRAIL.sub(cut, text)
    if _ANCHOR.search(text):
        text = _LINK.sub(cut, text)
    if _MARKER.search(signs):
        text = _MARKER.sub("\n\n", text)
    stop = _STOP if any(sign in signs for sign in "。！？；") else _NARROW_STOP
    sentences: dict[str, list[str]] = {}
    varied: set[str] = set()
    heard: list[list[str]] = []  # sentences whose words are not yet in varied
    left, held = len(text), 0  # characters that are not yet known to be in sentences; characters in fragments
    for block in re.split(r"\n\s*\n", text):
        flow: list[str] = []
        for line in block.split("\n"):
            line = line.strip()
            if line[-1:].isdigit() and _INDEX.match(line):
                continue
            if (line[:1].isdigit() or ": " in line) and (m := _HEADED.match(line)) and _sentence(m.group(1), priced, wide_page):
                out["prose"] += len(line) + 1
            elif line:
                flow.append(line)
        loose: list[str] = []
        for stretch in [*stop.split("\n".join(flow)), None]:
            words = _sentence(stretch, priced, wide_page) if stretch else None
            if (words or stretch is None) and loose:
                fragment = "\n".join(loose)
                if sum(_marks(fragment, priced)) > 2:
                    out["listed"] += len(fragment) + 1
                else:
                    out["loose"].append(fragment)
                    held += len(fragment) + 1
                loose = []
            if words:
                out["prose"] += len(stretch) + 1
                sentences[stretch] = words
                heard.append(words)
                left -= len(stretch) + 1
                # a fragment counts one character more than it has; between two there is a sentence or a blank line
                if out["link"] + out["listed"] + held + 1.2 * left + 10 <= SHARE * total:
                    varied.update([w for each in heard for w in each if len(w) > 3])
                    heard.clear()
                    if len(varied) > FEW:
                        return out  # whatever is left, the page is mostly sentences
            elif stretch and stretch.strip():
                loose.append(stretch)
    each = list(sentences.values())
    used = {w for x in each for w in x if len(w) > 3}
    again = sum(len({*x}) for x in each) <= 0.85 * sum(map(len, each))
    if again and len(each) >= 2 and len(used) <= min(FEW, max(5, 1.3 * len(each))) and not (wide_page and _WIDE.search(text)):  # the same few words turned over and over
        out["loose"] += sentences
        out["prose"] = 0
    return out


#: Words that single characters part (spaces, hyphens, quotes, not the marks of lists): a list item. Addresses and tags of links part items, too. Of a longer one so many words count as one.
ITEM, WORDS = r"[\p{L}\p{N}]+(?:[^\p{L}\p{N}\n\r,;|/·•~#+=>›.!?()][\p{L}\p{N}]+)*+", 5
ADDRESSES = r"(?i)https?://[^\s/<>\"\])]+|\b[\w-]+(?:\.[\w-]+)*\.[a-z]{2,24}\b(?=[/\s<\])\"]|$)|<a\s[^>]*>|</a>|\[/?url[^\]]*\]"
#: Prices are one phrase, whatever they come to: the slot that a product list fills again and again.
PRICES = r"(?U)\b\d+[.,]\d\d ?(?:€|\$|£|EUR|USD|frs|fr)(?!\w)"
#: Bits of the filter for each phrase that is looked for, words of 64 bits in a chunk of it and at most (32 MB; with more phrases than it is made for it only lets more through).
BITS, CHUNK, MOST = 16, 512, 1 << 22
#: Salts of a phrase's host count, so that the rows of a phrase that a third of the pages have are met in several tasks.
SALTS = 8

_EVIDENCE = "doc_id bigint, host string, text string, total bigint, link bigint, links bigint, listed bigint, loose bigint, repeated double"


def dense_pages(docs: DataFrame) -> DataFrame:
    """The columns of _EVIDENCE for every page that is more than SHARE anything but sentences. docs: doc_id, host, text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[tuple] = []
            for doc, host, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2).to_pylist()):
                if not text or not text.strip():
                    continue
                p = parts(text)
                loose = sum(len(f) + 1 for f in p["loose"])
                if p["link"] + p["listed"] + loose > SHARE * p["total"]:
                    words = _WORD.findall(_CAMEL.sub(" ", _ADDRESS.sub(" ", text)).lower())
                    out.append((doc, host, text, p["total"], p["link"], p["links"], p["listed"], loose, _repeated(words)))
            cols = list(zip(*out)) or [()] * 9
            kinds = (pa.int64(), pa.string(), pa.string(), *[pa.int64()] * 5, pa.float64())
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds)], [c.split()[0] for c in _EVIDENCE.split(", ")])

    return docs.select("doc_id", "host", "text").mapInArrow(run, _EVIDENCE)


_CAMEL = re.compile(r"(?<=[a-zß-öø-ÿа-я])(?=[A-ZÀ-ÖØ-ÞА-Я])")
_ADDRESS = re.compile(ADDRESSES.replace("(?i)", ""), re.I)


def phrases(pages: DataFrame) -> DataFrame:
    """The rows of pages, without text, once for every two successive words of an item, at whatever place they stand, and for every item of one word: item, its number, at, the place of the
    first word in it, phrase, a hash of the words, size and next, the characters of each. All in the JVM; the costly expressions are kept from texts that cannot have what they look for."""
    text = F.col("text")
    links = F.contains(text, F.lit("://")) | F.contains(text, F.lit("[")) | F.contains(text, F.lit("<")) | text.rlike(r"\.[A-Za-z]")
    plain = F.when(links, F.regexp_replace(text, ADDRESSES, "\n")).otherwise(text)
    plain = F.when(text.rlike(r"\d[.,]\d\d"), F.regexp_replace(plain, PRICES, "\npricestated\n")).otherwise(plain)
    apart = F.when(F.contains(text, F.lit("#")), F.regexp_replace(plain, r"(?<=\p{Ll})(?=\p{Lu})", "\n")).otherwise(plain)  # glued tags
    rest = [c for c in pages.columns if c != "text"]
    item = F.posexplode(F.regexp_extract_all(F.lower(apart), F.lit(ITEM), F.lit(0))).alias("item", "words")
    x = pages.select(*rest, item).withColumn("words", F.split("words", " "))  # hyphens are spaces, but their words are not told apart
    x = x.select(*rest, "item", "words", F.explode(F.sequence(F.lit(1), F.greatest(F.size("words") - 1, F.lit(1)))).alias("at"))
    pair = F.replace(F.concat_ws(" ", F.get("words", F.col("at") - 1), F.get("words", "at")), F.lit("-"), F.lit(" "))
    size, after = (F.char_length(F.get("words", F.col("at") - k)) + 1 for k in (1, 0))
    x = x.select(*rest, "item", "at", size.alias("size"), after.alias("next"), F.explode(F.array(F.xxhash64(pair))).alias("phrase"))  # exploded, so that no filter computes it again
    return x.select(*rest, "item", "at", "phrase", "size", "next")


def _hosted(docs: DataFrame) -> DataFrame:
    host = F.coalesce(F.when(F.col("url").rlike("^[a-z]+://"), F.regexp_extract("url", r"^[a-z]+://([^/:?#]+)", 1)), F.col("source"), F.lit(""))
    return docs.where("text is not null").select(F.col("doc_id").cast("bigint"), host.alias("host"), "text")


def _place(words: int) -> tuple[str, str]:
    """SQL of the word and of the bit in it that a phrase has in a filter of so many words."""
    return f"cast(shiftright(phrase, 6) & {words - 1}L as int)", "cast(phrase & 63L as int)"


def passed(used: DataFrame, wanted: DataFrame) -> DataFrame:
    """The rows of used whose phrase may be in wanted (phrase): all that are, and a few that are not. Keeps rows that nobody asked for out of the shuffle."""
    words, needed = CHUNK, wanted.count() * BITS
    while words < MOST and words * 64 < needed:
        words *= 2
    word, bit = _place(words)
    empty = used.sparkSession.range(words).select(F.col("id").cast("int").alias("word"), F.lit(0).cast("bigint").alias("bits"))
    row = wanted.select(F.expr(word).alias("word"), F.expr(f"shiftleft(1L, {bit})").alias("bits")).union(empty).groupBy("word").agg(F.bit_or("bits").alias("bits"))
    for key, size in (("word", CHUNK), ("chunk", words)):  # chunks of words, then one row of chunks
        ordered = F.sort_array(F.collect_list(F.struct(key, "bits"))).getField("bits").alias("bits")
        row = row.groupBy(F.expr(f"cast({key} div {size} as int)").alias("chunk")).agg(ordered)
    word = F.expr(word)
    found = F.get(F.get(row.select("bits").scalar(), F.shiftright(word, CHUNK.bit_length() - 1)), word.bitwiseAND(CHUNK - 1))
    return used.where(F.getbit(found, F.expr(bit)) == 1)


def scored(docs: DataFrame, hosts_needed: int = HOSTS) -> DataFrame:
    """Of each dense page: doc_id, density (share of links, lists and fragments), replicated (share of the items' characters in words of phrases that other hosts have
    or the page repeats), repeated (share of its words that stood there before), items, links, and whether it is spam."""
    pages = _hosted(docs)
    dense = staged(dense_pages(pages), "dense").dropDuplicates(["doc_id"])
    hashed = F.xxhash64("host").alias("host")
    found = staged(phrases(dense.select("doc_id", hashed, "text")), "phrases")
    each = found.groupBy("doc_id", "phrase").agg(F.count("*").alias("own"))
    # Of a phrase that dense pages have on enough hosts no other page can change that: only the rest is counted over all pages.
    wanted = staged(found.select("phrase", "host").distinct().groupBy("phrase").agg((F.count("*") >= hosts_needed).alias("known")), "wanted")
    rest = wanted.where(~F.col("known")).select("phrase")  # Spark broadcasts it only if its files are below the session's threshold
    used = passed(phrases(pages.select(hashed, "text")).select("host", "phrase"), rest)
    counts = used.join(rest, "phrase", "left_semi").distinct().groupBy("phrase").agg(F.count("*").alias("hosts")).where(F.col("hosts") >= hosts_needed)
    salted = counts.select("phrase").union(wanted.where("known").select("phrase")).select("phrase", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt"))
    met = each.withColumn("salt", F.pmod(F.xxhash64("doc_id"), F.lit(SALTS)).cast("int")).join(salted.withColumn("found", F.lit(True)), ["phrase", "salt"], "left")
    stitched = met.where(F.col("found") | (F.col("own") >= OWN)).select("doc_id", "phrase", F.lit(True).alias("in"))
    both = F.array(*(F.struct((F.col("at") + k).alias("at"), F.col(size).alias("size")) for k, size in enumerate(("size", "next"))))
    words = found.join(stitched, ["doc_id", "phrase"], "left").select("doc_id", "item", "in", F.inline(both)).where("size is not null")
    words = words.groupBy("doc_id", "item", "at").agg(F.max("size").alias("size"), F.max("in").alias("in"))  # a word is stitched in if a phrase is that it stands in
    share = words.groupBy("doc_id").agg((F.sum(F.when(F.col("in"), F.col("size")).otherwise(0)) / F.sum("size")).alias("replicated"), F.count_if(F.col("at") % WORDS == 1).alias("items"))
    x = dense.drop("text").join(share, "doc_id", "left").na.fill({"replicated": 0.0, "items": 0})
    density = (F.col("link") + F.col("listed") + F.col("loose")) / F.col("total")
    sure = (F.col("link") + F.col("listed")) / F.col("total") > SHARE  # links, tags and prices tell a list more surely than fragments do
    enough = F.when(sure, SHARE / 2).otherwise(SHARE)
    stuffed = (F.col("items") >= ITEMS) & ((F.col("replicated") >= enough) | (F.col("repeated") >= SHARE))
    spam = (density > SHARE) & (stuffed | ((F.col("items") >= 2) & (F.col("repeated") >= 2 * SHARE / 1.25)))
    return x.select("doc_id", density.alias("density"), "replicated", "repeated", "items", "links", spam.alias("spam"))


def stuffed_pages(docs: DataFrame, hosts_needed: int = HOSTS) -> DataFrame:
    """doc_id of the pages that are spam."""
    return scored(docs, hosts_needed).where("spam").select("doc_id")
