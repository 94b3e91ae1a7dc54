"""Queries over strings: normalisation, error rates, wrapping, label features."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quirework.functions import text as T
from quirework.functions.distance import char_edits, ratio, word_edits
from quirework.operators.ordering import global_rank
from quirework.plans import fixtures as X
from quirework.plans.base import Book
from quirework.sources.tables import table

_book = Book()
QUERIES, SQL = _book.QUERIES, _book.SQL
_q = _book.add
LETTERS = "".join(T.LETTER_PAIRS) + "".join(T.LETTER_PAIRS.values())
ALL_MARKS = X.MARKS
CHARSET = "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789.,;:'-éèàç"

def _sql_strip(x: str) -> str:
    blank = r"[\t\n\v\f\r \x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]+"
    return f"regexp_replace(regexp_replace({x}, '^{blank}', ''), '{blank}$', '')"


def _sql_cer(x: str, tokens: str) -> str:
    return _sql_strip(f"regexp_replace(regexp_replace(replace(translate({x}, '{tokens}', ''), '<unk>', ''), '\\n+', chr(10), 'g'), ' +', ' ', 'g')")


def _sql_wer(x: str, tokens: str) -> str:
    spaced = f"regexp_replace({x}, '({X.sql_class(T.WORD_PUNCTUATION)})', ' \\1 ', 'g')"
    one = f"regexp_replace(translate({spaced}, '{tokens}', ''), '[ \\n]+', ' ', 'g')"
    return f"string_split({_sql_strip(one)}, ' ')"


@_q(X.with_sql(f"SELECT record_id, {_sql_cer('gt', ALL_MARKS)} AS text FROM q_tagged"))
def cer_normalise(spark: SparkSession, d: str) -> DataFrame:
    return X.tagged(spark, d).select("record_id", T.cer_normalise(F.col("gt"), ALL_MARKS).alias("text"))


@_q(X.with_sql(f"SELECT record_id, {_sql_wer('gt', ALL_MARKS)} AS words FROM q_tagged"))
def wer_normalise(spark: SparkSession, d: str) -> DataFrame:
    return X.tagged(spark, d).select("record_id", T.wer_normalise(F.col("gt"), ALL_MARKS).alias("words"))


@_q(X.with_sql(f"SELECT record_id, translate(gt, '{LETTERS}', '') AS text FROM q_tagged"))
def strip_tokens(spark: SparkSession, d: str) -> DataFrame:
    return X.tagged(spark, d).select("record_id", T.strip_tokens(F.col("gt"), LETTERS).alias("text"))


@_q(X.with_sql(f"SELECT record_id, regexp_replace(gt, '{X.sql_class(LETTERS, True)}', '', 'g') AS tokens FROM q_tagged"))
def keep_tokens(spark: SparkSession, d: str) -> DataFrame:
    return X.tagged(spark, d).select("record_id", T.keep_tokens(F.col("gt"), LETTERS).alias("tokens"))


def row_rates(spark: SparkSession, d: str) -> DataFrame:
    """region_id, lang, class, edits and lengths of characters and words for each pair."""
    a, b = T.cer_normalise(F.col("gt"), ""), T.cer_normalise(F.col("pred"), "")
    x = X.pairs(spark, d).select("region_id", "lang", "class", a.alias("a"), b.alias("b"), T.wer_normalise(F.col("gt")).alias("v"), T.wer_normalise(F.col("pred")).alias("w"))
    return x.select("region_id", "lang", "class", char_edits(F.col("a"), F.col("b")).alias("edits"), F.char_length("a").cast("bigint").alias("n"), word_edits(F.col("v"), F.col("w")).alias("word_edits"), F.size("v").cast("bigint").alias("n_words"))


_CHARS = "CASE WHEN {0} = '' THEN [] ELSE string_split({0}, '') END"
_RATES = f"""SELECT region_id, lang, class, {X.sql_edits(_CHARS.format('a'), _CHARS.format('b'))} AS edits, length(a) AS n, {X.sql_edits('v', 'w')} AS word_edits, len(v) AS n_words
FROM (SELECT region_id, lang, class, {_sql_cer('gt', '')} AS a, {_sql_cer('pred', '')} AS b, {_sql_wer('gt', '')} AS v, {_sql_wer('pred', '')} AS w FROM q_pairs)"""


@_q(X.with_sql(f"SELECT lang, CAST(sum(edits) AS BIGINT) AS edits, CAST(sum(n) AS BIGINT) AS nb_chars, sum(edits) / nullif(sum(n), 0) AS cer FROM ({_RATES}) GROUP BY lang"))
def cer(spark: SparkSession, d: str) -> DataFrame:
    """Edits over characters, summed before they are divided."""
    return row_rates(spark, d).groupBy("lang").agg(F.sum("edits").alias("edits"), F.sum("n").alias("nb_chars"), ratio(F.col("edits"), F.col("n")).alias("cer"))


@_q(X.with_sql(f"SELECT lang, CAST(sum(word_edits) AS BIGINT) AS edits, CAST(sum(n_words) AS BIGINT) AS nb_words, sum(word_edits) / nullif(sum(n_words), 0) AS wer FROM ({_RATES}) GROUP BY lang"))
def wer(spark: SparkSession, d: str) -> DataFrame:
    return row_rates(spark, d).groupBy("lang").agg(F.sum("word_edits").alias("edits"), F.sum("n_words").alias("nb_words"), ratio(F.col("word_edits"), F.col("n_words")).alias("wer"))


@_q(X.with_sql(f"SELECT class, region_id, round(edits / greatest(1, n), 3) AS cer FROM ({_RATES})"))
def cers_ranked(spark: SparkSession, d: str) -> DataFrame:
    x = row_rates(spark, d).select("class", "region_id", F.round(F.col("edits") / F.greatest(F.lit(1), F.col("n")), 3).alias("cer"))
    return x.orderBy(F.desc("cer"), "region_id")


_TOKENS_ONLY = f"regexp_replace({{}}, '{X.sql_class(ALL_MARKS, True)}', '', 'g')"


@_q(X.with_sql(f"SELECT dataset, CAST(sum(e) AS BIGINT) AS edits, CAST(sum(n) AS BIGINT) AS nb_tokens, sum(e) / nullif(sum(n), 0) AS cer_tokens FROM (SELECT dataset, {X.sql_edits(_CHARS.format('a'), _CHARS.format('b'))} AS e, length(a) AS n FROM (SELECT dataset, {_TOKENS_ONLY.format('gt')} AS a, {_TOKENS_ONLY.format('pred')} AS b FROM q_tagged)) GROUP BY dataset"))
def cer_ner(spark: SparkSession, d: str) -> DataFrame:
    """The error rate of the tokens alone."""
    x = X.tagged(spark, d).select("dataset", T.keep_tokens(F.col("gt"), ALL_MARKS).alias("a"), T.keep_tokens(F.col("pred"), ALL_MARKS).alias("b"))
    x = x.select("dataset", char_edits(F.col("a"), F.col("b")).alias("e"), F.char_length("a").cast("bigint").alias("n"))
    return x.groupBy("dataset").agg(F.sum("e").alias("edits"), F.sum("n").alias("nb_tokens"), ratio(F.col("e"), F.col("n")).alias("cer_tokens"))


@_q(X.with_sql("SELECT region_id, trim(regexp_replace(regexp_replace(label, '\\n+', chr(10), 'g'), ' +', ' ', 'g'), ' ' || chr(10)) AS text FROM q_regions WHERE label IS NOT NULL"))
def text_label_clean(spark: SparkSession, d: str) -> DataFrame:
    return X.regions(spark, d).where("label is not null").select("region_id", T.text_label_clean(F.col("label")).alias("text"))


def _sql_repair(x: str) -> str:
    """The chain once more, written out for SQL with the places of characters, not taken from the operator's table."""
    steps = "92+110>10 60+101+117+114+111+62>8364 62+101+117+114+111+62>8364 62+102+108+105+103+110+101+62>32 194+164>164 195+187>251 65533> 239+191+169>233 195+167>231 195+169>233 195+180>244 160>32 195+168>232 194+176>176 195+128>192 195+172>192 195+170>234 195+174>238 195+162>226 194+178>178 195+185>249 195>224 172>8364"
    for step in steps.split(" "):
        a, b = (" || ".join(f"chr({c})" for c in side.split("+") if c) or "''" for side in step.split(">"))
        x = f"replace({x}, {a}, {b})"
    return x


@_q(X.with_sql(f"SELECT region_id, {_sql_repair('label')} AS text FROM q_regions WHERE label IS NOT NULL"))
def mojibake_fix(spark: SparkSession, d: str) -> DataFrame:
    """The reference's own ordered chain of repairs; problem 5 has the general way."""
    return X.regions(spark, d).where("label is not null").select("region_id", T.annotation_repair(F.col("label")).alias("text"))


def _sql_alternatives(x: str) -> str:
    made = x
    for spelling in T.ALTERNATIVES:
        made = f"regexp_replace({made}, '(?s){spelling}', '\\1', 'g')"
    return _sql_strip(f"regexp_replace(CASE WHEN contains({x}, '¤') THEN {made} ELSE {x} END, ' +', ' ', 'g')")


@_q(X.with_sql(f"SELECT region_id, {_sql_alternatives('label')} AS text FROM q_regions WHERE label IS NOT NULL"))
def alternatives(spark: SparkSession, d: str) -> DataFrame:
    return X.regions(spark, d).where("label is not null").select("region_id", T.first_alternative(F.col("label")).alias("text"))


_TYPES_SQL = "CASE region_type " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in T.LETTER_TYPES.items()) + " END"
_ENDS_SQL = "CASE b " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in T.LETTER_PAIRS.items()) + " ELSE '' END"


@_q(X.with_sql(f"SELECT region_id, CASE WHEN b IS NULL THEN label ELSE b || label || {_ENDS_SQL} END AS text FROM (SELECT region_id, label, {_TYPES_SQL} AS b FROM q_regions WHERE label IS NOT NULL)"))
def wrap_label(spark: SparkSession, d: str) -> DataFrame:
    begin = F.create_map(*(F.lit(x) for kv in T.LETTER_TYPES.items() for x in kv))
    end = F.create_map(*(F.lit(x) for kv in T.LETTER_PAIRS.items() for x in kv))
    b = F.when(F.col("region_type").isNotNull(), F.element_at(begin, F.col("region_type")))
    x = X.regions(spark, d).where("label is not null").select("region_id", "label", b.alias("b"))
    return x.select("region_id", T.wrapped(F.col("label"), F.col("b"), F.when(F.col("b").isNotNull(), F.element_at(end, F.col("b")))).alias("text"))


_MISSING = {a: b for a, b in T.FOLDED.items() if a not in CHARSET}


@_q(X.with_sql(f"SELECT region_id, translate(label, '{''.join(_MISSING)}', '{''.join(_MISSING.values())}') AS folded, regexp_replace(translate(label, '{''.join(_MISSING)}', '{''.join(_MISSING.values())}'), '{X.sql_class(CHARSET + ' ', True)}', '', 'g') AS kept FROM q_regions WHERE label IS NOT NULL"))
def charset_normalise(spark: SparkSession, d: str) -> DataFrame:
    s = F.col("label")
    return X.regions(spark, d).where("label is not null").select("region_id", T.fold_missing(s, CHARSET).alias("folded"), T.only_charset(s, CHARSET).alias("kept"))


_UP = "translate(replace(replace(upper(label), 'Œ', 'OE'), 'Æ', 'AE'), 'ÀÂÄÇÈÉÊËÎÏÔÖÙÛÜŸ', 'AAACEEEEIIOOUUUY')"


@_q(X.with_sql(f"SELECT region_id, {_UP} AS text FROM q_regions WHERE lang = 'fr'"))
def upper_fold(spark: SparkSession, d: str) -> DataFrame:
    return X.regions(spark, d).where("lang = 'fr'").select("region_id", T.upper_folded(F.col("label")).alias("text"))


def _sql_invalid(limits: dict[str, int]) -> str:
    return " OR ".join("length(text) - length(replace(text, '{}', '')) > {}".format(c.replace("'", "''"), n) for c, n in limits.items())


@_q(f"SELECT doc_id, {_sql_invalid(T.LINE_LIMITS)} AS bad_line, {_sql_invalid(T.PAGE_LIMITS)} AS bad_page FROM documents WHERE text IS NOT NULL")
def label_validity(spark: SparkSession, d: str) -> DataFrame:
    s = F.col("text")
    return table(spark, d, "documents").where("text is not null").select("doc_id", T.is_invalid(s, T.LINE_LIMITS).alias("bad_line"), T.is_invalid(s).alias("bad_page"))


@_q(r"SELECT doc_id, CAST(pos AS INTEGER) AS pos, line FROM (SELECT doc_id, unnest(ls) AS line, generate_subscripts(ls, 1) - 1 AS pos FROM (SELECT doc_id, string_split(text, chr(10)) AS ls FROM documents WHERE text IS NOT NULL)) WHERE length(line) > 5 AND length(line) < 100 AND NOT regexp_matches(line, '^[0-9]+$') AND NOT regexp_matches(list_last(string_split(lower(line), 'n°')), '^ *[0-9]+$')")
def line_filter(spark: SparkSession, d: str) -> DataFrame:
    """Lines of more than 5 and less than 100 characters that are not mere numbers nor end in a margin number."""
    x = table(spark, d, "documents").where("text is not null").select("doc_id", F.posexplode(F.split("text", "\n")).alias("pos", "line"))
    n = F.char_length("line")
    return x.where((n > 5) & (n < 100) & ~F.col("line").rlike("^[0-9]+$") & ~F.substring_index(F.lower("line"), "n°", -1).rlike("^ *[0-9]+$"))


def _sql_wrap(x: str, width: int) -> str:
    state = "{'lines': CAST([] AS VARCHAR[]), 'line': ''}"
    full = f"length(a.line) + length(w) > {width}"
    step = f"{{'lines': CASE WHEN {full} THEN list_append(a.lines, trim(a.line, ' ')) ELSE a.lines END, 'line': CASE WHEN {full} THEN w || ' ' ELSE a.line || w || ' ' END}}"
    as_state = f"list_transform(string_split({x}, ' '), lambda w: {{'lines': CAST([] AS VARCHAR[]), 'line': w}})"
    step = step.replace("length(w)", "length(b.line)").replace("THEN w ||", "THEN b.line ||").replace("|| w ||", "|| b.line ||")
    return f"(SELECT list_append(s.lines, trim(s.line, ' ')) FROM (SELECT list_reduce(list_prepend({state}, {as_state}), lambda a, b: {step}) AS s))"


@_q(X.with_sql(f"SELECT doc_id, {_sql_wrap('text', 80)} AS lines FROM q_sentences"))
def wrap_lines(spark: SparkSession, d: str) -> DataFrame:
    return X.sentences(spark, d).select("doc_id", T.wrap_lines(F.col("text"), 80).alias("lines"))


_FULL_B = "length(a.line) + 1 + length(b.line) > 100"
_WRAP_B = f"""SELECT doc_id, CASE WHEN s.line = '' THEN s.lines ELSE list_append(s.lines, trim(s.line, ' ')) END AS lines FROM (
SELECT doc_id, list_reduce(list_prepend({{'lines': CAST([] AS VARCHAR[]), 'line': ''}}, list_transform(list_filter(regexp_split_to_array(text, '\\s+'), lambda w: w <> ''), lambda w: {{'lines': CAST([] AS VARCHAR[]), 'line': w}})), lambda a, b: {{
'lines': CASE WHEN {_FULL_B} THEN list_append(a.lines, trim(a.line, ' ')) ELSE a.lines END, 'line': CASE WHEN {_FULL_B} THEN b.line ELSE a.line || ' ' || b.line END}}) AS s FROM q_sentences)"""


@_q(X.with_sql(_WRAP_B))
def wrap_lines_b(spark: SparkSession, d: str) -> DataFrame:
    return X.sentences(spark, d).select("doc_id", T.wrap_lines_b(F.col("text"), 100).alias("lines"))


@_q(X.with_sql("SELECT doc_id, array_to_string(list_slice(string_split(text, '. '), CAST(doc_id % n_sentences AS INTEGER) + 1, CAST(doc_id % n_sentences AS INTEGER) + 3), '. ') AS text FROM q_sentences"))
def sentence_window(spark: SparkSession, d: str) -> DataFrame:
    return X.sentences(spark, d).select("doc_id", T.sentence_window(F.col("text"), (F.col("doc_id") % F.col("n_sentences")).cast("int"), 3).alias("text"))


@_q("SELECT doc_id, CASE WHEN regexp_extract(text, '(?s)^(.*\\.) ', 1) <> '' THEN regexp_extract(text, '(?s)^(.*\\.) ', 1) ELSE text END AS text FROM documents WHERE text IS NOT NULL")
def end_at_dot(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").where("text is not null").select("doc_id", T.end_at_dot(F.col("text")).alias("text"))


@_q("SELECT doc_id, CASE WHEN length(text) <= 120 THEN text ELSE regexp_replace(substring(text, 1, 120), ' [^ ]*$', '') END AS text FROM documents WHERE text IS NOT NULL")
def truncate_words(spark: SparkSession, d: str) -> DataFrame:
    """Cutting is the feature here."""
    return table(spark, d, "documents").where("text is not null").select("doc_id", T.truncate_words(F.col("text"), 120).alias("text"))


@_q(X.with_sql("SELECT region_id, array_to_string(list_concat(list_slice(x, 1, len(x) // 2), list_slice(y, len(y) // 2 + 1, len(y))), ' ') AS line FROM (SELECT region_id, string_split(gt, ' ') AS x, string_split(pred, ' ') AS y FROM q_pairs)"))
def splice_lines(spark: SparkSession, d: str) -> DataFrame:
    return X.pairs(spark, d).select("region_id", T.splice(F.col("gt"), F.col("pred")).alias("line"))


@_q("SELECT record_id, filename, CAST(row_number() OVER (ORDER BY list_transform(regexp_extract_all(filename, '([0-9]+|[^0-9]+)'), lambda r: CASE WHEN regexp_matches(r, '^[0-9]') THEN lpad(r, 40, '0') ELSE lower(r) END), record_id) AS BIGINT) AS rank FROM (SELECT DISTINCT record_id, filename FROM label_records)")
def natural_sort(spark: SparkSession, d: str) -> DataFrame:
    """A total order over all file names is asked for, so the rank needs one sorted run; the names alone are sorted."""
    x = table(spark, d, "label_records").select("record_id", "filename").distinct()
    return global_rank(x.withColumn("k", T.natural_key(F.col("filename"))), ["k", "record_id"]).select("record_id", "filename", "rank")


@_q(X.with_sql("SELECT region_id, CASE WHEN regexp_matches(x, '^[0-9]{1,9}$') THEN CAST(x AS INTEGER) END AS number FROM (SELECT region_id, translate(label, '. ⓝⓃ', '') AS x FROM q_regions WHERE label IS NOT NULL)"))
def page_number(spark: SparkSession, d: str) -> DataFrame:
    return X.regions(spark, d).where("label is not null").select("region_id", T.page_number(F.col("label")).alias("number"))


@_q(X.with_sql("SELECT region_id, replace(replace(replace(replace(replace(label, '|', ' '), ' ,', ','), ' .', '.'), ' ;', ';'), ' :', ':') AS text FROM q_regions WHERE label IS NOT NULL"))
def punct_tighten(spark: SparkSession, d: str) -> DataFrame:
    return X.regions(spark, d).where("label is not null").select("region_id", T.tighten(F.col("label")).alias("text"))


_CS_LIST = "string_split('" + CHARSET.replace("'", "''") + "', '')"


@_q(X.with_sql(f"SELECT region_id, list_transform(CASE WHEN label = '' THEN [] ELSE string_split(label, '') END, lambda c: CAST(coalesce(list_position({_CS_LIST}, c), 0) - 1 AS INTEGER)) AS ids FROM q_regions WHERE label IS NOT NULL"))
def encode_chars(spark: SparkSession, d: str) -> DataFrame:
    cs = F.split(F.lit(CHARSET), "")
    return X.regions(spark, d).where("label is not null").select("region_id", T.encode(F.col("label"), cs).alias("ids"))


@_q(X.with_sql(f"SELECT region_id, array_to_string(list_transform(CASE WHEN label = '' THEN [] ELSE string_split(label, '') END, lambda c: CASE WHEN list_contains({_CS_LIST}, c) THEN c ELSE '¤' END), '') AS text FROM q_regions WHERE label IS NOT NULL"))
def decode_chars(spark: SparkSession, d: str) -> DataFrame:
    cs = F.split(F.lit(CHARSET), "")
    x = X.regions(spark, d).where("label is not null").select("region_id", T.encode(F.col("label"), cs).alias("ids"))
    return x.select("region_id", T.decode(F.transform("ids", lambda i: F.when(i >= 0, i)), cs).alias("text"))


@_q(X.with_sql("SELECT record_id, replace(gt, chr(10), '<' || chr(92) || 'n>') AS escaped, gt AS back FROM q_tagged"))
def newline_escape(spark: SparkSession, d: str) -> DataFrame:
    x = X.tagged(spark, d).select("record_id", F.replace("gt", F.lit("\n"), F.lit("<\\n>")).alias("escaped"))
    return x.withColumn("back", F.replace("escaped", F.lit("<\\n>"), F.lit("\n")))


@_q(X.with_sql("SELECT record_id, CAST(len(string_split(gt, chr(10))) AS INTEGER) AS n_lines, CAST(len(string_split(replace(replace(gt, chr(10), ' '), '  ', ' '), ' ')) AS INTEGER) AS n_words, CAST(length(gt) AS INTEGER) AS n_chars FROM q_tagged"))
def label_features(spark: SparkSession, d: str) -> DataFrame:
    return X.tagged(spark, d).select("record_id", T.label_features(F.col("gt")).alias("f")).select("record_id", "f.*")


@_q(X.with_sql("SELECT record_id, x AS words FROM (SELECT record_id, list_slice(string_split(gt, ' '), 1, 100) AS x FROM q_tagged)"))
def token_budget(spark: SparkSession, d: str) -> DataFrame:
    """The first 100 words: trimming to a budget is the feature."""
    return X.tagged(spark, d).select("record_id", F.slice(F.split("gt", " "), 1, 100).alias("words"))


@_q(X.with_sql("SELECT record_id, CASE WHEN dataset LIKE '%NER%' THEN 'ner' WHEN dataset LIKE 'READ%' THEN 'tree' WHEN dataset LIKE 'exopopp%' THEN 'acts' WHEN dataset LIKE 'RIMES%' THEN 'flat' ELSE 'plain' END AS route, split_part(dataset, '_', 1) AS family FROM q_tagged"))
def route_dataset(spark: SparkSession, d: str) -> DataFrame:
    c = F.col("dataset")
    route = F.when(c.contains("NER"), "ner").when(c.startswith("READ"), "tree").when(c.startswith("exopopp"), "acts").when(c.startswith("RIMES"), "flat").otherwise("plain")
    return X.tagged(spark, d).select("record_id", route.alias("route"), F.split_part(c, F.lit("_"), F.lit(1)).alias("family"))


_JOINT = "".join(T.JOINT_TO_SINGLE), "".join(T.JOINT_TO_SINGLE.values())


@_q(X.with_sql(f"SELECT record_id, translate(gt, '{_JOINT[0]}', '{_JOINT[1]}') AS text FROM q_tagged"))
def joint_to_single(spark: SparkSession, d: str) -> DataFrame:
    return X.tagged(spark, d).select("record_id", T.to_single(F.col("gt")).alias("text"))


@_q(X.with_sql("SELECT record_id, 'ⓟ' || raw AS begin_form, raw, 'ⓟ' || raw || 'Ⓟ' AS sem FROM (SELECT record_id, translate(gt, '" + X.MARKS + "', '') AS raw FROM q_tagged)"))
def label_triples(spark: SparkSession, d: str) -> DataFrame:
    """A label plain, with begin markers only, and with both."""
    raw = F.translate("gt", X.MARKS, "")
    return X.tagged(spark, d).select("record_id", F.concat(F.lit("ⓟ"), raw).alias("begin_form"), raw.alias("raw"), T.wrapped(raw, F.lit("ⓟ"), F.lit("Ⓟ")).alias("sem"))
