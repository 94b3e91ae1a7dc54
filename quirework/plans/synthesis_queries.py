"""Queries over schedules, sampling, synthetic text, sources, sinks and streams."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quirework.functions import text as T
from quirework.functions.rng import UNIFORM_SQL, uniform
from quirework.operators import composers as O
from quirework.operators import schedules as S
from quirework.plans import fixtures as X
from quirework.plans.base import Book
from quirework.plans.text_queries import _sql_wrap
from quirework.session import staging_dir
from quirework.sources import corpora as C
from quirework.sources.tables import table
from quirework.streaming import metrics as M

_book = Book()
QUERIES, SQL = _book.QUERIES, _book.SQL
_q = _book.add
_u = UNIFORM_SQL.format


# ---- schedules


@_q("SELECT event_id, round(1.0 + event_id * (0.2 - 1.0) / 300000, 6) AS share, round(least(event_id, 10000) * CAST(0.00002 AS DOUBLE), 6) AS rate FROM events")
def schedule_linear(spark: SparkSession, d: str) -> DataFrame:
    s = F.col("event_id")
    return table(spark, d, "events").select("event_id", F.round(S.linear(1.0, 0.2, s, 300000), 6).alias("share"), F.round(F.least(s, F.lit(10000)) * F.lit(0.00002), 6).alias("rate"))


@_q("SELECT event_id, round(1.0 - (1.0 - 0.1) * (1 - exp(-10.0 * least(event_id, 9999) / 10000)), 6) AS share, round(0.5 * (1 - exp(-10.0 * event_id / 10000)), 6) AS dropout FROM events")
def schedule_exp(spark: SparkSession, d: str) -> DataFrame:
    s = F.col("event_id")
    return table(spark, d, "events").select("event_id", F.round(S.exponential(1.0, 0.1, s, 10000), 6).alias("share"), F.round(S.dropout(0.5, s, 10000), 6).alias("dropout"))


@_q("SELECT event_id, CAST(greatest(2, least(30, floor((event_id - 500) / 300.0) + 1)) AS INTEGER) AS lines FROM events")
def curriculum_lines(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "events").select("event_id", S.curriculum_lines(F.col("event_id"), 500, 300, 2, 30).alias("lines"))


_STEPS = [(0, 1), (2000, 5), (6000, 9)]


@_q("SELECT event_id, CASE " + " ".join(f"WHEN event_id > {a} THEN {n}" for a, n in reversed(S.step_points(_STEPS))) + " ELSE 1 END AS lines FROM events")
def step_table(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "events").select("event_id", S.step_lines(F.col("event_id"), _STEPS).alias("lines"))


@_q(f"SELECT event_id, {_u(chr(39) + '11:' + chr(39) + ' || event_id')} <= greatest(0.2, 1.0 - 0.8 * event_id / 10000) AS synthetic FROM events")
def synth_gate(spark: SparkSession, d: str) -> DataFrame:
    """Whether a step takes a generated sample: a uniform number of its key against the schedule."""
    p = F.greatest(F.lit(0.2), 1.0 - 0.8 * F.col("event_id") / 10000)
    return table(spark, d, "events").select("event_id", (uniform("event_id", seed=11) <= p).alias("synthetic"))


# ---- sampling


@_q(f"WITH w AS (SELECT source, sum(n) OVER (ORDER BY source) AS hi, sum(n) OVER () AS total FROM (SELECT coalesce(source, 'none') AS source, count(*) AS n FROM samples GROUP BY 1)) SELECT event_id AS draw, (SELECT min(source) FROM w WHERE hi > {_u(chr(39) + '3:' + chr(39) + ' || event_id')} * total) AS source FROM events")
def weighted_sample(spark: SparkSession, d: str) -> DataFrame:
    """A draw with replacement for each event, sources weighted by their size: its uniform number falls into one source's stretch of the summed weights. The stretches are as many as there are sources."""
    n = table(spark, d, "samples").groupBy(F.coalesce("source", F.lit("none")).alias("source")).agg(F.count("*").alias("n"))
    one = n.agg(F.array_sort(F.collect_list(F.struct("source", "n"))).alias("rows"))  # one entry a source
    grown = F.aggregate("rows", F.array().cast("array<struct<hi:bigint,source:string>>"), lambda a, r: F.concat(a, F.array(F.struct((r["n"] + F.coalesce(F.try_element_at(a, F.lit(-1))["hi"], F.lit(0))).alias("hi"), r["source"].alias("source")))))
    stretches = one.select(grown.alias("w"))
    draws = table(spark, d, "events").select(F.col("event_id").alias("draw"), uniform("event_id", seed=3).alias("u"))
    total = F.element_at("w", -1)["hi"]
    return draws.join(F.broadcast(stretches)).select("draw", F.filter("w", lambda x: x["hi"] > F.col("u") * total)[0]["source"].alias("source"))


_NOISE = _u("'5:' || record_id || ':' || (i - 1)")


@_q(X.with_sql(f"SELECT record_id, array_to_string(list_transform(ws, lambda w, i: CASE WHEN i > 1 AND {_NOISE} < 0.1 THEN w || w ELSE w END), ' ') AS text FROM (SELECT record_id, string_split(gt, ' ') AS ws FROM q_tagged)"))
def token_noise(spark: SparkSession, d: str) -> DataFrame:
    """One word in ten changed (here: doubled), never the first; which ones depends on keys only."""
    noisy = lambda w, i: F.when((i > 0) & (uniform(F.col("record_id"), i, seed=5) < 0.1), F.concat(w, w)).otherwise(w)
    return X.tagged(spark, d).select("record_id", F.array_join(F.transform(F.split("gt", " "), noisy), " ").alias("text"))


@_q(X.with_sql("SELECT archive, arg_min(region_id, md5('9:' || region_id)) AS region_id FROM q_regions WHERE length(label) > 20 AND length(label) < 150 GROUP BY archive"))
def pick_lines(spark: SparkSession, d: str) -> DataFrame:
    """One fitting line of each archive: filtered first, then the one whose hash is least."""
    n = F.char_length("label")
    x = X.regions(spark, d).where((n > 20) & (n < 150)).select("archive", "region_id", F.md5(F.concat(F.lit("9:"), F.col("region_id").cast("string"))).alias("k"))
    return x.groupBy("archive").agg(F.min_by("region_id", "k").alias("region_id"))


# ---- synthetic text


@_q(X.with_sql("SELECT doc_id, list_slice(lines, 1, 12) AS lines FROM (SELECT doc_id, " + _sql_wrap("window_text", 60) + " AS lines FROM (SELECT doc_id, array_to_string(list_slice(string_split(text, '. '), CAST(doc_id % n_sentences AS INTEGER) + 1, CAST(doc_id % n_sentences AS INTEGER) + 12), '. ') AS window_text FROM q_sentences))"))
def page_text(spark: SparkSession, d: str) -> DataFrame:
    """Page texts of up to 12 lines: a window of sentences, wrapped, its first lines."""
    start = (F.col("doc_id") % F.col("n_sentences")).cast("int")
    return X.sentences(spark, d).select("doc_id", F.slice(T.wrap_lines(T.sentence_window(F.col("text"), start, 12), 60), 1, 12).alias("lines"))


@_q()
def synth_pages(spark: SparkSession, d: str) -> DataFrame:
    """Labels and boxes of composed pages: wrapped lines below each other, each with a box, a margin number and the label in the three renderings."""
    x = page_text(spark, d)
    width = F.array_max(F.transform("lines", lambda s: F.char_length(s)))
    boxes = F.transform("lines", lambda s, i: F.struct(s.alias("text"), F.lit(60).alias("l"), (40 + 48 * i).cast("int").alias("t"), (60 + 12 * F.char_length(s)).cast("int").alias("r"), (80 + 48 * i).cast("int").alias("b")))
    number = (F.floor(uniform("doc_id", seed=21) * 400) + 1).cast("int")
    body = F.array_join("lines", "\n")
    sem = F.concat(F.lit("ⓟⓝ"), number.cast("string"), F.lit("Ⓝⓢⓑ"), body, F.lit("ⒷⓈⓅ"))
    return x.select("doc_id", number.alias("number"), boxes.alias("lines"), (width * 12 + 120).alias("page_width"), body.alias("raw"), sem.alias("sem"))


_PAGE_SQL = "SELECT doc_id, list_slice(lines, 1, 12) AS lines FROM (SELECT doc_id, " + _sql_wrap("window_text", 60) + " AS lines FROM (SELECT doc_id, array_to_string(list_slice(string_split(text, '. '), CAST(doc_id % n_sentences AS INTEGER) + 1, CAST(doc_id % n_sentences AS INTEGER) + 12), '. ') AS window_text FROM q_sentences))"
_U = lambda n: _u(f"'{n}:' || doc_id")


def _some_words(line: str, first: int, n: int) -> str:
    return f"array_to_string(list_slice(string_split({line}, ' '), {first}, {first + n - 1}), ' ')"


_LETTER_SQL = f"""SELECT doc_id, kind, text, CAST(l AS INTEGER) AS l, CAST(t AS INTEGER) AS t, CAST(r AS INTEGER) AS r, CAST(b AS INTEGER) AS b, k FROM (
SELECT doc_id, 0 AS k, 'ⓢ' AS kind, text, 60 AS l, 40 AS t, 60 + 12 * length(text) AS r, 80 AS b FROM (SELECT doc_id, {_some_words('lines[1]', 1, 3)} AS text FROM page WHERE {_U(31)} < 0.8)
UNION ALL SELECT doc_id, 1, 'ⓦ', text, 700, 100, 700 + 12 * length(text), 140 FROM (SELECT doc_id, {_some_words('lines[1]', 4, 3)} AS text FROM page WHERE {_U(32)} < 0.7)
UNION ALL SELECT doc_id, 2, 'ⓞ', text, 120, 180, 120 + 12 * length(text), 220 FROM (SELECT doc_id, {_some_words('lines[-1]', 1, 2)} AS text FROM page WHERE {_U(33)} < 0.6)
UNION ALL SELECT doc_id, 3, 'ⓑ', array_to_string(lines, chr(10)), 60, 260, 60 + 12 * list_max(list_transform(lines, lambda s: length(s))), 260 + 48 * len(lines) FROM page
UNION ALL SELECT doc_id, 4, 'ⓟ', text, 60, 300 + 48 * n, 60 + 12 * length(text), 340 + 48 * n FROM (SELECT doc_id, len(lines) AS n, {_some_words('lines[-1]', 3, 4)} AS text FROM page WHERE {_U(34)} < 0.2)) WHERE text <> ''"""
_CUT = lambda n: f"list_transform(range(0, greatest((len(lines) - 1) // {n}, 0) + 1), lambda i: list_slice(lines, i * {n} + 1, i * {n} + {n}))"


def _letters(spark: SparkSession, d: str) -> DataFrame:
    u = {k: uniform("doc_id", seed=n) for k, n in (("ⓢ", 31), ("ⓦ", 32), ("ⓞ", 33), ("ⓟ", 34))}
    return page_text(spark, d).select("doc_id", O.letter_parts(F.col("lines"), u).alias("parts"))


@_q(X.with_sql(f"SELECT doc_id, string_agg(text, chr(10) ORDER BY k) AS raw, string_agg(kind || text || CASE kind WHEN 'ⓢ' THEN 'Ⓢ' WHEN 'ⓦ' THEN 'Ⓦ' WHEN 'ⓞ' THEN 'Ⓞ' WHEN 'ⓑ' THEN 'Ⓑ' ELSE 'Ⓟ' END, '' ORDER BY k) AS sem FROM (WITH page AS ({_PAGE_SQL}) {_LETTER_SQL}) GROUP BY doc_id"))
def synth_letters(spark: SparkSession, d: str) -> DataFrame:
    """Letters: sender, place and date, opening, body, postscript, each but the body on part of the pages only; plain and tagged."""
    return _letters(spark, d).select("doc_id", O.plain(F.col("parts")).alias("raw"), O.tagged(F.col("parts")).alias("sem"))


@_q(X.with_sql(f"SELECT doc_id, kind, l, t, r, b FROM (WITH page AS ({_PAGE_SQL}) {_LETTER_SQL})"))
def synth_letter_boxes(spark: SparkSession, d: str) -> DataFrame:
    return _letters(spark, d).select("doc_id", F.explode("parts").alias("p")).select("doc_id", "p.kind", "p.l", "p.t", "p.r", "p.b")


@_q(X.with_sql(f"SELECT doc_id, 'ⓟⓝ' || CAST(floor({_U(21)} * 400) + 1 AS INTEGER) || 'Ⓝ' || array_to_string(list_transform({_CUT(3)}, lambda s: 'ⓢⓐ' || {_some_words('s[1]', 1, 2)} || 'Ⓐⓑ' || array_to_string(s, chr(10)) || 'ⒷⓈ'), '') || 'Ⓟ' AS sem FROM ({_PAGE_SQL})"))
def synth_registers(spark: SparkSession, d: str) -> DataFrame:
    """Pages of registers: number, and sections of annotation and body."""
    number = (F.floor(uniform("doc_id", seed=21) * 400) + 1).cast("int")
    return page_text(spark, d).select("doc_id", O.register_page(F.col("lines"), number).alias("sem"))


@_q(X.with_sql(f"SELECT doc_id, 'ⓟ' || array_to_string(list_transform({_CUT(4)}, lambda s: 'ⓜⓝ' || {_some_words('s[1]', 1, 2)} || 'Ⓝⓘ' || {_some_words('s[1]', 3, 1)} || 'Ⓘⓑ' || array_to_string(s, chr(10)) || 'Ⓑ' || CASE WHEN {_U(35)} < 0.5 THEN 'ⓢ+Ⓢ' ELSE '' END || 'Ⓜ'), '') || 'Ⓟ' AS sem FROM ({_PAGE_SQL})"))
def synth_acts(spark: SparkSession, d: str) -> DataFrame:
    """Pages of acts: names and particulars in the margin, paragraphs, signatures on half of them."""
    return page_text(spark, d).select("doc_id", O.act_page(F.col("lines"), uniform("doc_id", seed=35)).alias("sem"))


_HALF = "array_to_string(list_slice(string_split(lines[-1], ' '), 1, greatest(len(string_split(lines[-1], ' ')) // 2, 1)), ' ')"


@_q(X.with_sql(f"SELECT doc_id, list_transform(CASE WHEN len(lines) > 1 THEN list_concat(['    ' || lines[1]], list_slice(lines, 2, len(lines) - 1), CASE WHEN {_U(36)} < 1.0 / 15 AND len(lines) > 2 THEN [lines[len(lines) - 1]] ELSE [] END, [{_HALF}]) ELSE ['    ' || lines[1]] END, lambda s: substring(s, 1, 58)) AS lines FROM ({_PAGE_SQL})"))
def synth_section_lines(spark: SparkSession, d: str) -> DataFrame:
    """Lines of a section: indented, the last one short, now and then one said twice."""
    return page_text(spark, d).select("doc_id", O.section_lines(F.col("lines"), uniform("doc_id", seed=36), 58).alias("lines"))


@_q(X.with_sql("SELECT record_id, CAST(pos // 8 AS BIGINT) AS line, string_agg(word || CASE tag WHEN 'PER' THEN '✻' WHEN 'LOC' THEN '✼' ELSE '' END, ' ' ORDER BY pos) AS text FROM q_words GROUP BY record_id, pos // 8"))
def synth_tagged_lines(spark: SparkSession, d: str) -> DataFrame:
    """Lines of eight words with entity signs after them."""
    rows = F.array_sort(F.collect_list(F.struct("pos", F.concat("word", F.expr("CASE tag WHEN 'PER' THEN '✻' WHEN 'LOC' THEN '✼' ELSE '' END")).alias("w"))))
    x = X.words(spark, d).groupBy("record_id", F.floor(F.col("pos") / 8).alias("line")).agg(rows.alias("r"))
    return x.select("record_id", "line", F.array_join(F.transform("r", lambda r: r["w"]), " ").alias("text"))


_LINE_KINDS = {"short": "length(label) BETWEEN 3 AND 20", "middle": "length(label) BETWEEN 21 AND 60", "long": "length(label) > 60"}


@_q(X.with_sql(" UNION ALL ".join(f"SELECT archive, '{k}' AS kind, arg_min(region_id, md5('{k}:' || region_id)) AS region_id FROM q_regions WHERE {rule} GROUP BY archive" for k, rule in _LINE_KINDS.items())))
def pick_lines_by_kind(spark: SparkSession, d: str) -> DataFrame:
    """For each archive one line of each length, the one whose hash is least: pickers that filter first and need no second try."""
    kind = F.expr("CASE " + " ".join(f"WHEN {rule.replace('length', 'char_length')} THEN '{k}'" for k, rule in _LINE_KINDS.items()) + " END")
    x = X.regions(spark, d).select("archive", "region_id", kind.alias("kind")).where("kind is not null")
    return x.groupBy("archive", "kind").agg(F.min_by("region_id", F.md5(F.concat_ws(":", "kind", F.col("region_id").cast("string")))).alias("region_id"))


@_q("SELECT module, CAST(sum(n) AS BIGINT) AS parameters FROM (VALUES ('encoder', 3 * 64 * 9), ('encoder', 64), ('decoder', 512 * 2048), ('decoder', 2048), ('decoder', 1)) t(module, n) GROUP BY module")
def parameter_counts(spark: SparkSession, d: str) -> DataFrame:
    """Parameters of modules from the shapes of their tensors."""
    shapes = [("encoder", [3, 64, 3, 3]), ("encoder", [64]), ("decoder", [512, 2048]), ("decoder", [2048]), ("decoder", [])]
    x = spark.createDataFrame(shapes, "module string, shape array<bigint>")
    return x.groupBy("module").agg(F.sum(F.aggregate("shape", F.lit(1).cast("bigint"), lambda a, k: a * k)).alias("parameters"))


@_q("SELECT event_id, CASE event_id % 2 WHEN 0 THEN '' ELSE 'le ' END || CASE WHEN event_id % 3 = 0 THEN strftime(ts, '%d %B') ELSE strftime(ts, '%d %B %Y') END AS text FROM events")
def date_text(spark: SparkSession, d: str) -> DataFrame:
    """Dates with or without the year, with or without an article."""
    day = F.when(F.col("event_id") % 3 == 0, F.date_format("ts", "dd MMMM")).otherwise(F.date_format("ts", "dd MMMM yyyy"))
    return table(spark, d, "events").select("event_id", F.concat(F.when(F.col("event_id") % 2 == 0, "").otherwise("le "), day).alias("text"))


@_q("SELECT vec_id, label, CASE label % 4 WHEN 0 THEN 10 WHEN 1 THEN 20 WHEN 2 THEN 30 ELSE -1 END AS id FROM embeddings")
def id_remap(spark: SparkSession, d: str) -> DataFrame:
    m = F.create_map(*(F.lit(x) for x in (0, 10, 1, 20, 2, 30)))
    return table(spark, d, "embeddings").select("vec_id", "label", F.coalesce(F.try_element_at(m, F.col("label") % 4), F.lit(-1)).alias("id"))


_RANKS = {"page": 1.0, "section": 1.1, "act": 1.1, "number": 2.0, "region": 2.1, "body": 3.0, "annotation": 3.0, "entity": 4.0}


@_q("SELECT family, begin_token, CASE token_role " + " ".join(f"WHEN '{k}' THEN CAST({v} AS DOUBLE)" for k, v in _RANKS.items()) + " END AS rank FROM token_pairs")
def entity_rank(spark: SparkSession, d: str) -> DataFrame:
    m = F.create_map(*(F.lit(x) for kv in _RANKS.items() for x in kv))
    return table(spark, d, "token_pairs").select("family", "begin_token", F.try_element_at(m, F.col("token_role")).alias("rank"))


@_q(X.with_sql("SELECT record_id, len(list_filter(paragraphs, lambda p: coalesce(p.region_type, p.mode) = 'body')) AS n FROM q_records WHERE paragraphs IS NOT NULL"))
def region_filter(spark: SparkSession, d: str) -> DataFrame:
    n = F.size(F.filter("paragraphs", lambda p: F.coalesce(p["region_type"], p["mode"]) == "body"))
    return X.records(spark, d).where("paragraphs is not null").select("record_id", n.cast("bigint").alias("n"))


# ---- sources and sinks


@_q(X.with_sql("WITH s AS (SELECT r.record_id, concat_ws('/', r.dataset, r.split, r.filename) AS name, r.split, r.dataset, r.text AS label, false AS added FROM q_records r WHERE r.record_id IN (SELECT record_id FROM samples)) SELECT * FROM s UNION ALL SELECT record_id, name, split, dataset || '-ner', label, true FROM s WHERE split = 'train' AND dataset = 'IAM_NER'").replace("WITH q_records", "WITH q_records", 1).replace(") WITH s AS", "), s AS", 1))
def label_scan(spark: SparkSession, d: str) -> DataFrame:
    return C.samples_of(X.records(spark, d), table(spark, d, "samples"))


def _sql_corpus(x: str) -> str:
    x = "translate({}, '{}', '')".format(x, T.CORPUS_DROPPED)
    for a, b in T.CORPUS_CHANGED.items():
        x = f"replace({x}, '{a}', '{b}')"
    return x


@_q(f"SELECT doc_id, coalesce(source, 'none') AS source, {_sql_corpus('text')} AS text FROM documents WHERE text IS NOT NULL")
def corpus_scan(spark: SparkSession, d: str) -> DataFrame:
    return C.corpus(table(spark, d, "documents"))


@_q(f"SELECT doc_id, source, {_sql_corpus('text')} AS text FROM documents WHERE text IS NOT NULL AND source IN ('harvest_main', 'site_01')")
def corpus_sources(spark: SparkSession, d: str) -> DataFrame:
    """Only some sources: the choice is the feature."""
    return C.corpus(table(spark, d, "documents"), ["harvest_main", "site_01"])


@_q(f"SELECT 'first' AS corpus, doc_id, source, text FROM (SELECT doc_id, coalesce(source, 'none') AS source, {_sql_corpus('text')} AS text FROM documents WHERE text IS NOT NULL) WHERE source = 'site_01' UNION ALL SELECT 'second', doc_id, source, text FROM (SELECT doc_id, coalesce(source, 'none') AS source, {_sql_corpus('text')} AS text FROM documents WHERE text IS NOT NULL) WHERE source IN ('site_01', 'site_02')")
def corpus_multi(spark: SparkSession, d: str) -> DataFrame:
    """Several corpora over one scan; a source may be in more than one."""
    x = C.corpus(table(spark, d, "documents"))
    of = lambda name, sources: x.where(F.col("source").isin(sources)).select(F.lit(name).alias("corpus"), "doc_id", "source", "text")
    return of("first", ["site_01"]).unionByName(of("second", ["site_01", "site_02"]))


@_q(X.with_sql("SELECT 'a' || record_id || '-0' || '-' || lpad(CAST(pos AS VARCHAR), 2, '0') AS line_id, 'a' || record_id || '-0' AS page_id, replace(replace(replace(replace(replace(line, '|', ' '), ' ,', ','), ' .', '.'), ' ;', ';'), ' :', ':') AS text FROM (SELECT record_id, unnest(ls) AS line, generate_subscripts(ls, 1) - 1 AS pos FROM (SELECT record_id, string_split(gt, chr(10)) AS ls FROM q_tagged))"))
def lines_parse(spark: SparkSession, d: str) -> DataFrame:
    """Line files: written out from the records' lines, with a comment between, and parsed again."""
    x = X.tagged(spark, d).select("record_id", F.posexplode(F.split("gt", "\n")).alias("pos", "line"))
    head = F.concat(F.lit("a"), F.col("record_id"), F.lit("-0-"), F.lpad(F.col("pos").cast("string"), 2, "0"))
    rows = x.select(F.concat(head, F.lit(" ok 154 1 10 20 300 40 "), F.replace("line", F.lit(" "), F.lit("|"))).alias("value"))
    notes = x.select(F.concat(F.lit("# "), F.col("line")).alias("value"))
    return C.parse_lines(rows.unionByName(notes)).select("line_id", "page_id", "text")


@_q(X.with_sql("SELECT record_id || '-' || pos AS word_id, tag FROM q_words"))
def ner_lines_parse(spark: SparkSession, d: str) -> DataFrame:
    return C.parse_entities(X.words(spark, d).select(F.concat_ws(" ", F.concat_ws("-", "record_id", "pos"), "tag").alias("value")))


@_q(X.with_sql("SELECT record_id, coalesce(split, '__HIVE_DEFAULT_PARTITION__') AS split, text FROM q_records WHERE text IS NOT NULL").replace("coalesce(split, '__HIVE_DEFAULT_PARTITION__')", "split"))
def label_sink_roundtrip(spark: SparkSession, d: str) -> DataFrame:
    """Labels written as JSON by split and read back."""
    path = f"{staging_dir(spark)}/labels-{uuid.uuid4().hex}"
    C.write_labels(X.records(spark, d).where("text is not null").select("record_id", "split", "text"), path)
    return spark.read.schema("record_id bigint, text string, split string").json(path).select("record_id", "split", "text")


@_q(X.with_sql("SELECT CAST(scan_id AS VARCHAR) AS source, CAST(row_number() OVER (PARTITION BY scan_id ORDER BY pos, region_id) - 1 AS INTEGER) AS pos, coalesce(region_type, 'none') AS type, replace(replace(regexp_replace(label, '[\\x00-\\x08\\x0b\\x0c\\x0e-\\x1f]', '', 'g'), chr(13) || chr(10), chr(10)), chr(13), chr(10)) AS text, coords.l AS l, coords.t AS t, coords.r AS r, coords.b AS b FROM q_regions WHERE label IS NOT NULL AND coords.l IS NOT NULL AND coords.t IS NOT NULL AND coords.r IS NOT NULL AND coords.b IS NOT NULL AND scan_id IS NOT NULL"))
def xml_like_scan(spark: SparkSession, d: str) -> DataFrame:
    """Regions of each scan as an XML letter, read again by the XML parser."""
    safe = lambda c: F.replace(F.replace(F.replace(F.regexp_replace(c, r"[\x00-\x08\x0b\x0c\x0e-\x1f]", ""), F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;"))
    box = F.concat(F.format_string('<box top_left_x="%d" top_left_y="%d" bottom_right_x="%d" bottom_right_y="%d"><type>%s</type><text>', "coords.l", "coords.t", "coords.r", "coords.b", F.coalesce("region_type", F.lit("none"))), safe("label"), F.lit("</text></box>"))
    x = X.regions(spark, d).where("label is not null and scan_id is not null and coords.l is not null and coords.t is not null and coords.r is not null and coords.b is not null").select("scan_id", "pos", "region_id", box.alias("box"))
    rows = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "region_id", "box"))), lambda r: r["box"]), "")
    pages = x.groupBy("scan_id").agg(F.concat(F.lit("<letter><source>"), F.col("scan_id").cast("string"), F.lit("</source>"), rows, F.lit("</letter>")).alias("value"))
    return C.parse_letters(pages.select("value"))


# ---- streams


@_q("SELECT event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY event_type")
def stream_metrics(spark: SparkSession, d: str) -> DataFrame:
    return M.drained(M.rates(M.event_stream(spark, f"{d}/events.parquet")), "complete")


@_q("SELECT date_trunc('hour', ts) AS hour, event_type, count(*) AS n FROM events GROUP BY 1, 2")
def ext_tumbling(spark: SparkSession, d: str) -> DataFrame:
    """The stream's windows, in complete mode."""
    out = M.drained(M.hourly(M.event_stream(spark, f"{d}/events.parquet")), "complete")
    return out.select(F.col("hour").cast("timestamp_ntz").alias("hour"), "event_type", "n")


_GAP = "SELECT user_id, ts, CASE WHEN ts >= lag(ts) OVER (PARTITION BY user_id ORDER BY ts) + INTERVAL 30 MINUTES THEN 1 ELSE 0 END AS new FROM events WHERE ts IS NOT NULL"


@_q(f'SELECT user_id, min(ts) AS begin, max(ts) + INTERVAL 30 MINUTES AS "end", count(*) AS n FROM (SELECT user_id, ts, sum(new) OVER (PARTITION BY user_id ORDER BY ts) AS s FROM ({_GAP})) GROUP BY user_id, s')
def ext_sessions(spark: SparkSession, d: str) -> DataFrame:
    """Sessions of a user's events, closed by half an hour without any."""
    x = M.sessions(table(spark, d, "events"))
    return x.select("user_id", F.col("begin").cast("timestamp_ntz").alias("begin"), F.col("end").cast("timestamp_ntz").alias("end"), "n")
