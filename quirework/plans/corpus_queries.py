"""Joins, aggregates, windows, sorts and set operations over the corpus tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quirework.functions import arrays as A
from quirework.functions import text as T
from quirework.operators.ordering import global_rank, group_rank, running, trailing
from quirework.plans import fixtures as X
from quirework.plans.base import Book
from quirework.sources.tables import table

_book = Book()
QUERIES, SQL = _book.QUERIES, _book.SQL
_q = _book.add


# ---- aggregates


@_q("SELECT event_type, round(sum(value * w) / sum(w), 6) AS mean, CAST(sum(w) AS BIGINT) AS weight FROM (SELECT event_type, value, event_id % 5 + 1 AS w FROM events) GROUP BY event_type")
def weighted_mean(spark: SparkSession, d: str) -> DataFrame:
    x = table(spark, d, "events").select("event_type", "value", (F.col("event_id") % 5 + 1).alias("w"))
    return x.groupBy("event_type").agg(F.round(F.sum(F.col("value") * F.col("w")) / F.sum("w"), 6).alias("mean"), F.sum("w").alias("weight"))


@_q("SELECT user_id, round(sum(value) / sum(event_id % 4 + 1), 6) AS sample_time FROM events GROUP BY user_id")
def sample_time(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "events").groupBy("user_id").agg(F.round(F.sum("value") / F.sum(F.col("event_id") % 4 + 1), 6).alias("sample_time"))


@_q(X.with_sql("SELECT class, greatest(0.1, (count(*) - 1) / (SELECT count(DISTINCT archive) FROM q_pairs)) AS frequency FROM (SELECT DISTINCT archive, CASE WHEN class = 'sender' AND length(gt) < 20 AND NOT contains(gt, chr(10)) THEN 'reference' ELSE class END AS class FROM q_pairs) GROUP BY class"))
def type_frequencies(spark: SparkSession, d: str) -> DataFrame:
    """Share of archives with a region type, the first sighting not counted, at least 0.1; short one-line senders are references."""
    x = X.pairs(spark, d)
    kind = F.when((F.col("class") == "sender") & (F.char_length("gt") < 20) & ~F.col("gt").contains("\n"), "reference").otherwise(F.col("class"))
    total = x.agg(F.countDistinct("archive").alias("n"))
    seen = x.select("archive", kind.alias("class")).distinct().groupBy("class").agg(F.count("*").alias("k"))
    return seen.join(F.broadcast(total)).select("class", F.greatest(F.lit(0.1), (F.col("k") - 1) / F.col("n")).alias("frequency"))  # total is one row


@_q(X.with_sql("SELECT dataset, list_sort(list(DISTINCT c)) AS charset FROM (SELECT dataset, unnest(string_split(gt, '')) AS c FROM q_tagged) WHERE c NOT IN ('', chr(10)) GROUP BY dataset"))
def charset(spark: SparkSession, d: str) -> DataFrame:
    x = X.tagged(spark, d).select("dataset", F.explode(F.array_distinct(T.chars(F.col("gt")))).alias("c")).where("c <> '\\n'")
    return x.groupBy("dataset").agg(F.array_sort(F.collect_set("c")).alias("charset"))


@_q("SELECT label, CAST(i - 1 AS INTEGER) AS pos, round(avg(x), 6) AS mean, round(stddev_pop(x), 6) AS std FROM (SELECT label, unnest(embedding) AS x, generate_subscripts(embedding, 1) AS i FROM (SELECT label, CAST(embedding AS DOUBLE[]) AS embedding FROM embeddings)) GROUP BY label, i")
def channel_stats(spark: SparkSession, d: str) -> DataFrame:
    x = table(spark, d, "embeddings").select("label", F.posexplode("embedding").alias("pos", "x")).withColumn("x", F.col("x").cast("double"))
    return x.groupBy("label", "pos").agg(F.round(F.avg("x"), 6).alias("mean"), F.round(F.stddev_pop("x"), 6).alias("std"))


_BOX = "SELECT archive, min(coords.l) AS l, min(coords.t) AS t, max(coords.r) AS r, max(coords.b) AS b FROM q_regions GROUP BY archive"


@_q(X.with_sql(_BOX))
def bbox_union(spark: SparkSession, d: str) -> DataFrame:
    c = lambda f, k: f(f"coords.{k}").alias(k)
    return X.regions(spark, d).groupBy("archive").agg(c(F.min, "l"), c(F.min, "t"), c(F.max, "r"), c(F.max, "b"))


@_q(X.with_sql("SELECT archive, max(coords.b - coords.t) AS height, max(coords.r - coords.l) AS width, max(page_width) AS page_width FROM q_regions GROUP BY archive"))
def max_dims(spark: SparkSession, d: str) -> DataFrame:
    return X.regions(spark, d).groupBy("archive").agg(F.expr("max(coords.b - coords.t)").alias("height"), F.expr("max(coords.r - coords.l)").alias("width"), F.max("page_width").alias("page_width"))


@_q("SELECT vec_id, round(list_avg(CAST(embedding AS DOUBLE[])), 6) AS confidence FROM embeddings")
def mean_confidence(spark: SparkSession, d: str) -> DataFrame:
    x = F.transform("embedding", lambda v: v.cast("double"))
    return table(spark, d, "embeddings").select("vec_id", F.round(F.aggregate(x, F.lit(0.0).cast("double"), lambda a, v: a + v) / F.size(x), 6).alias("confidence"))


@_q(X.with_sql("SELECT scan_id, list(region_id ORDER BY pos, region_id) AS regions FROM q_regions GROUP BY scan_id HAVING count(*) = 2"))
def page_pairs(spark: SparkSession, d: str) -> DataFrame:
    """Groups of exactly two, in order. Rows are counted before any list is built, so that no larger group is gathered."""
    r = X.regions(spark, d).select("scan_id", "pos", "region_id")
    two = r.groupBy("scan_id").agg(F.count("*").alias("n"), F.min(F.struct("pos", "region_id")).alias("a"), F.max(F.struct("pos", "region_id")).alias("b"))
    return two.where("n = 2").select("scan_id", F.array("a.region_id", "b.region_id").alias("regions"))


# ---- windows


@_q("SELECT user_id, event_id, CAST(sum(CAST(round(value * 100) AS BIGINT)) OVER w AS BIGINT) / CAST(sum(event_id % 7 + 1) OVER w AS BIGINT) AS rate FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN 99 PRECEDING AND CURRENT ROW)")
def trailing_cer(spark: SparkSession, d: str) -> DataFrame:
    """A ratio of sums over the trailing rows, in hundredths so that no order of adding matters; users of any size, see ordering.py."""
    x = table(spark, d, "events").select("user_id", "event_id", "ts", F.round(F.col("value") * 100).cast("bigint").alias("v"), (F.col("event_id") % 7 + 1).alias("n"))
    laid, w = trailing(group_rank(x, ["user_id"], ["ts", "event_id"]), ["user_id"], 100)
    return laid.select("user_id", "event_id", "_own", (F.sum("v").over(w) / F.sum("n").over(w)).alias("rate")).where("_own").drop("_own")


@_q("SELECT user_id, event_id, value, coalesce(value <= min(value) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), true) AS best FROM events WHERE value IS NOT NULL")
def best_so_far(spark: SparkSession, d: str) -> DataFrame:
    """Whether a value is at least as good as all before; ties count."""
    x = table(spark, d, "events").where("value is not null").select("user_id", "event_id", "ts", "value")
    x = running(group_rank(x, ["user_id"], ["ts", "event_id"]), ["user_id"], {"least": ("min", F.col("value"))}, upto=-1)
    return x.select("user_id", "event_id", "value", F.coalesce(F.col("value") <= F.col("least"), F.lit(True)).alias("best"))


@_q("SELECT event_id, CAST((row_number() OVER (ORDER BY event_id) - 1) // 64 AS INTEGER) AS batch FROM events")
def batch_chunks(spark: SparkSession, d: str) -> DataFrame:
    x = global_rank(table(spark, d, "events").select("event_id"), ["event_id"], "k")
    return x.select("event_id", F.floor((F.col("k") - 1) / 64).cast("int").alias("batch"))


@_q(X.with_sql("SELECT record_id, CASE WHEN k <= 0.7 * n THEN 'train' WHEN k <= 0.85 * n THEN 'valid' ELSE 'test' END AS part FROM (SELECT record_id, row_number() OVER (ORDER BY record_id) AS k, count(*) OVER () AS n FROM q_records)"))
def positional_split(spark: SparkSession, d: str) -> DataFrame:
    x = global_rank(X.records(spark, d).select("record_id"), ["record_id"], "k")
    x = x.join(F.broadcast(x.agg(F.count("*").alias("n"))))  # one row
    return x.select("record_id", F.when(F.col("k") <= 0.7 * F.col("n"), "train").when(F.col("k") <= 0.85 * F.col("n"), "valid").otherwise("test").alias("part"))


@_q("SELECT user_id, CAST(s.stop AS INTEGER) AS stop FROM (SELECT user_id, list_reduce(list_prepend({'best': CAST('inf' AS DOUBLE), 'bad': 0, 'i': -1, 'stop': -1}, list_transform(vs, lambda v: {'best': v, 'bad': 0, 'i': 0, 'stop': 0})), lambda a, b: {'best': least(a.best, b.best), 'bad': CASE WHEN b.best < a.best THEN 0 WHEN b.best > a.best + 5 THEN a.bad + 1 ELSE a.bad END, 'i': a.i + 1, 'stop': CASE WHEN a.stop >= 0 THEN a.stop WHEN b.best >= a.best AND b.best > a.best + 5 AND a.bad + 1 >= 3 THEN a.i + 1 ELSE -1 END}) AS s FROM (SELECT user_id, list(value ORDER BY ts, event_id) AS vs FROM events WHERE value IS NOT NULL GROUP BY user_id))")
def early_stop(spark: SparkSession, d: str) -> DataFrame:
    """Place at which patience (3) runs out by values worse than the best by more than 5; what lies between leaves the count alone; -1: never.

    As running aggregates in blocks, so that no user's values are gathered: a new best starts a run, the bad values since the last start are a difference of sums."""
    by = ["user_id"]
    x = table(spark, d, "events").where("value is not null").select("user_id", "ts", "event_id", "value")
    x = running(group_rank(x, by, ["ts", "event_id"]), by, {"best": ("min", F.col("value"))}, upto=-1)
    x = x.withColumns({"start": F.col("best").isNull() | (F.col("value") < F.col("best")), "off": F.coalesce((F.col("value") > F.col("best") + 5).cast("int"), F.lit(0))})
    x = running(x, by, {"bad": ("sum", F.col("off"))})
    x = running(x, by, {"base": ("max", F.when(F.col("start"), F.col("bad")))})
    hit = F.min(F.when((F.col("bad") - F.col("base") >= 3) & (F.col("off") == 1), F.col("k") - 1))
    return x.groupBy("user_id").agg(F.coalesce(hit, F.lit(-1)).cast("int").alias("stop"))


# ---- joins

_TAGS = {"PER": "ⓗ", "LOC": "ⓖ", "O": ""}


@_q(X.with_sql("SELECT record_id, pos, word, CASE tag WHEN 'PER' THEN 'ⓗ' WHEN 'LOC' THEN 'ⓖ' ELSE '' END AS token FROM q_words"))
def word_tag_join(spark: SparkSession, d: str) -> DataFrame:
    """Each word's tag and the tag's token; the table of tags is a constant of three rows."""
    tags = spark.createDataFrame(list(_TAGS.items()), "tag string, token string")
    return X.words(spark, d).join(F.broadcast(tags), "tag").select("record_id", "pos", "word", "token")


@_q(X.with_sql("SELECT record_id FROM q_records r WHERE EXISTS (SELECT 1 FROM samples s WHERE s.record_id = r.record_id AND s.lang = 'fr')"))
def semi_exists(spark: SparkSession, d: str) -> DataFrame:
    return X.records(spark, d).select("record_id").join(table(spark, d, "samples").where("lang = 'fr'").select("record_id"), "record_id", "left_semi")


@_q(X.with_sql("SELECT DISTINCT record_id FROM q_words w WHERE pos = 0 AND word IN (SELECT word FROM q_words WHERE dataset = 'RIMES' AND pos = 0)"))
def split_semi(spark: SparkSession, d: str) -> DataFrame:
    """Records whose first word also opens a record of the given corpus."""
    first = X.words(spark, d).where("pos = 0").select("record_id", "dataset", "word")
    return first.join(first.where("dataset = 'RIMES'").select("word"), "word", "left_semi").select("record_id").distinct()


@_q(X.with_sql("SELECT r.region_id, p.begin_token, p.end_token FROM q_regions r JOIN token_pairs p ON p.family = 'RIMES' AND p.begin_token = CASE r.region_type WHEN 'body' THEN 'ⓑ' WHEN 'sender' THEN 'ⓢ' WHEN 'recipient' THEN 'ⓡ' END"))
def token_lookup(spark: SparkSession, d: str) -> DataFrame:
    """token_pairs is a table of fixed size."""
    begin = F.expr("case region_type when 'body' then 'ⓑ' when 'sender' then 'ⓢ' when 'recipient' then 'ⓡ' end")
    p = table(spark, d, "token_pairs").where("family = 'RIMES'").select("begin_token", "end_token")
    return X.regions(spark, d).select("region_id", begin.alias("begin_token")).join(F.broadcast(p), "begin_token").select("region_id", "begin_token", "end_token")


_CANON = "array_to_string(list_sort(string_split({}, '')), '')"


@_q(X.with_sql(f"SELECT w.record_id, w.pos, w.word, t.token FROM q_words w JOIN (SELECT k, min(token) AS token FROM (SELECT {_CANON.format('word')} AS k, word AS token FROM q_words WHERE dataset = 'RIMES') GROUP BY k) t ON {_CANON.format('w.word')} = t.k"))
def canonical_key_lookup(spark: SparkSession, d: str) -> DataFrame:
    """Words looked up by their letters in any order: the token is the first word of one corpus that has the same letters."""
    w = X.words(spark, d).withColumn("k", T.canonical(F.col("word")))
    tokens = w.where("dataset = 'RIMES'").groupBy("k").agg(F.min("word").alias("token"))
    return w.join(tokens, "k").select("record_id", "pos", "word", "token")


@_q("SELECT e.event_id, r.name FROM events e JOIN (VALUES (0, 2675, 'custom'), (2676, 5569, 'rwth'), (5570, 8963, 'acts'), (8964, 999999999, 'rest')) r(lo, hi, name) ON e.event_id BETWEEN r.lo AND r.hi")
def range_dataset(spark: SparkSession, d: str) -> DataFrame:
    """Row numbers to data sets by inclusive bounds, a constant of four rows."""
    bounds = spark.createDataFrame([(0, 2675, "custom"), (2676, 5569, "rwth"), (5570, 8963, "acts"), (8964, 999999999, "rest")], "lo long, hi long, name string")
    return table(spark, d, "events").join(F.broadcast(bounds), F.col("event_id").between(F.col("lo"), F.col("hi"))).select("event_id", "name")


@_q(X.with_sql("SELECT a.region_id, arg_min(b.region_id, {'d': least(abs(a.coords.r - b.coords.l), abs(a.coords.l - b.coords.r)), 'id': b.region_id}) AS body_id FROM q_regions a JOIN q_regions b ON a.scan_id = b.scan_id WHERE a.region_type = 'reference' AND b.region_type = 'body' AND a.coords IS NOT NULL AND b.coords IS NOT NULL GROUP BY a.region_id"))
def nearest_attach(spark: SparkSession, d: str) -> DataFrame:
    """Each reference's closest body on its page, by the distance of facing edges."""
    r = X.regions(spark, d).where("coords is not null").select("scan_id", "region_id", "region_type", "coords")
    a = r.where("region_type = 'reference'").select("scan_id", "region_id", F.col("coords").alias("x"))
    b = r.where("region_type = 'body'").select("scan_id", F.col("region_id").alias("body_id"), F.col("coords").alias("y"))
    gap = F.least(F.abs(F.col("x.r") - F.col("y.l")), F.abs(F.col("x.l") - F.col("y.r")))
    return a.join(b, "scan_id").groupBy("region_id").agg(F.min_by("body_id", F.struct(gap, "body_id")).alias("body_id"))


@_q("SELECT DISTINCT c FROM (SELECT unnest(charset) AS c FROM label_charsets) WHERE c IS NOT NULL AND c NOT IN (SELECT begin_token FROM token_pairs UNION SELECT end_token FROM token_pairs WHERE end_token IS NOT NULL)")
def charset_minus_layout(spark: SparkSession, d: str) -> DataFrame:
    p = table(spark, d, "token_pairs")
    marks = p.select(F.col("begin_token").alias("c")).union(p.where("end_token is not null").select("end_token"))
    return table(spark, d, "label_charsets").select(F.explode("charset").alias("c")).where("c is not null").distinct().join(marks, "c", "left_anti")


@_q("SELECT dataset, list_sort(list(DISTINCT c)) AS charset FROM (SELECT dataset, unnest(charset) AS c FROM label_charsets) WHERE c IS NOT NULL GROUP BY dataset")
def charset_union(spark: SparkSession, d: str) -> DataFrame:
    x = table(spark, d, "label_charsets").select("dataset", F.explode("charset").alias("c")).where("c is not null")
    return x.groupBy("dataset").agg(F.array_sort(F.collect_set("c")).alias("charset"))


@_q("SELECT unnest(charset) AS c FROM label_charsets WHERE charset_id = 1 INTERSECT SELECT unnest(charset) FROM label_charsets WHERE charset_id = 4")
def charset_intersect(spark: SparkSession, d: str) -> DataFrame:
    of = lambda i: table(spark, d, "label_charsets").where(f"charset_id = {i}").select(F.explode("charset").alias("c"))
    return of(1).intersect(of(4))


@_q(X.with_sql("SELECT c.charset_id, r.record_id FROM label_charsets c JOIN (SELECT record_id, list_distinct(string_split(regexp_replace(gt, '[^A-Za-z0-9]', '', 'g'), '')) AS cs FROM q_tagged) r ON len(list_filter(r.cs, lambda x: NOT coalesce(list_contains(c.charset, x), false))) = 0 AND len(r.cs) > 0"))
def relational_division(spark: SparkSession, d: str) -> DataFrame:
    """Charsets that cover every unaccented letter and digit of a text. label_charsets is a table of fixed size: it is put beside each record as one array."""
    sets = table(spark, d, "label_charsets").select("charset_id", F.array_compact("charset").alias("charset"))
    texts = X.tagged(spark, d).select("record_id", F.array_distinct(T.chars(F.regexp_replace("gt", "[^A-Za-z0-9]", ""))).alias("cs")).where("size(cs) > 0")
    return texts.join(F.broadcast(sets), F.size(F.array_except("cs", "charset")) == 0).select("charset_id", "record_id")


# ---- sorts


@_q("SELECT record_id, md5('7:' || record_id) AS k FROM (SELECT DISTINCT record_id FROM label_records)")
def seeded_shuffle(spark: SparkSession, d: str) -> DataFrame:
    """An order that looks random but is the same every time."""
    return table(spark, d, "label_records").select("record_id").distinct().withColumn("k", F.md5(F.concat(F.lit("7:"), F.col("record_id").cast("string")))).orderBy("k")


@_q("SELECT event_id, value FROM events ORDER BY value DESC NULLS LAST, event_id LIMIT 50")
def limit_eval(spark: SparkSession, d: str) -> DataFrame:
    """The first 50 in a fixed order: the limit is the feature."""
    return table(spark, d, "events").select("event_id", "value").orderBy(F.desc_nulls_last("value"), "event_id").limit(50)


@_q("SELECT c, CAST(row_number() OVER (ORDER BY c) - 1 AS INTEGER) AS idx FROM (SELECT DISTINCT unnest(charset) AS c FROM label_charsets) WHERE c IS NOT NULL")
def vocab(spark: SparkSession, d: str) -> DataFrame:
    x = table(spark, d, "label_charsets").select(F.explode("charset").alias("c")).where("c is not null").distinct()
    return global_rank(x, ["c"], "k").select("c", (F.col("k") - 1).cast("int").alias("idx"))


# ---- arrays, maps, boxes


@_q(X.with_sql("SELECT scan_id, region_id, list_concat(ids, list_transform(generate_series(1, m - len(ids)), lambda x: CAST(-1 AS BIGINT))) AS ids FROM (SELECT scan_id, region_id, ids, max(len(ids)) OVER (PARTITION BY scan_id) AS m FROM (SELECT scan_id, region_id, list_transform(string_split(label, ' '), lambda w: length(w)) AS ids FROM q_regions WHERE label IS NOT NULL))"))
def pad_arrays(spark: SparkSession, d: str) -> DataFrame:
    """Arrays of a batch filled up to its longest one."""
    x = X.regions(spark, d).where("label is not null").select("scan_id", "region_id", F.transform(F.split("label", " "), lambda w: F.char_length(w).cast("bigint")).alias("ids"))
    x = x.withColumn("m", F.max(F.size("ids")).over(W.partitionBy("scan_id")))
    return x.select("scan_id", "region_id", A.pad(F.col("ids"), F.col("m"), F.lit(-1).cast("bigint")).alias("ids"))


@_q(X.with_sql("SELECT region_id, CASE WHEN len(w) <= 2 THEN w ELSE list_concat([w[1]], list_reverse(w[2:len(w) - 1]), [w[len(w)]]) END AS words FROM (SELECT region_id, string_split(label, ' ') AS w FROM q_regions WHERE label IS NOT NULL)"))
def reverse_inner(spark: SparkSession, d: str) -> DataFrame:
    return X.regions(spark, d).where("label is not null").select("region_id", A.reverse_inner(F.split("label", " ")).alias("words"))


@_q("SELECT vec_id, round(1.0 / list_sum(list_transform(CAST(embedding AS DOUBLE[]), lambda x: exp(x - list_max(CAST(embedding AS DOUBLE[]))))), 6) AS confidence FROM embeddings")
def softmax_conf(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "embeddings").select("vec_id", F.round(A.softmax_max(F.transform("embedding", lambda x: x.cast("double"))), 6).alias("confidence"))


@_q("SELECT vec_id, pos, round((x - avg(x) OVER w) / stddev_pop(x) OVER w, 6) AS z FROM (SELECT vec_id, unnest(e) AS x, CAST(generate_subscripts(e, 1) - 1 AS INTEGER) AS pos FROM (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings)) WINDOW w AS (PARTITION BY pos)")
def normalise_vec(spark: SparkSession, d: str) -> DataFrame:
    """Vectors less the mean, over the deviation of each dimension. The statistics are as long as a vector, so they are put beside each row."""
    x = table(spark, d, "embeddings").select("vec_id", F.transform("embedding", lambda v: v.cast("double")).alias("e"))
    stats = x.select(F.posexplode("e").alias("pos", "x")).groupBy("pos").agg(F.avg("x").alias("m"), F.stddev_pop("x").alias("s"))
    one = stats.agg(F.array_sort(F.collect_list(F.struct("pos", "m", "s"))).alias("st"))  # one row, one entry a dimension
    y = x.join(F.broadcast(one)).select("vec_id", A.normalise(F.col("e"), F.transform("st", lambda r: r["m"]), F.transform("st", lambda r: r["s"])).alias("z"))
    return y.select("vec_id", F.posexplode("z").alias("pos", "z")).withColumn("z", F.round("z", 6))


@_q(X.with_sql("SELECT region_id, CAST(floor(coords.l * 0.5) AS INTEGER) AS l, CAST(floor(coords.t * 0.5) AS INTEGER) AS t, CAST(floor(coords.r * 0.5) AS INTEGER) AS r, CAST(floor(coords.b * 0.5) AS INTEGER) AS b FROM q_regions WHERE coords IS NOT NULL"))
def bbox_scale(spark: SparkSession, d: str) -> DataFrame:
    return X.regions(spark, d).where("coords is not null").select("region_id", A.scaled(F.col("coords"), 0.5).alias("x")).select("region_id", "x.*")


@_q(X.with_sql("SELECT region_id, CAST(floor(h * k) AS INTEGER) AS height, CAST(floor(w * k) AS INTEGER) AS width FROM (SELECT region_id, h, w, least(1.0, 200.0 / h, 800.0 / w) AS k FROM (SELECT region_id, CAST(coords.b - coords.t AS DOUBLE) AS h, CAST(coords.r - coords.l AS DOUBLE) AS w FROM q_regions WHERE coords.b > coords.t AND coords.r > coords.l))"))
def fit_dims(spark: SparkSession, d: str) -> DataFrame:
    """Sizes within 200 by 800 that keep the aspect."""
    x = X.regions(spark, d).where("coords.b > coords.t and coords.r > coords.l").selectExpr("region_id", "double(coords.b - coords.t) h", "double(coords.r - coords.l) w")
    k = F.least(F.lit(1.0), 200.0 / F.col("h"), 800.0 / F.col("w"))
    return x.select("region_id", F.floor(F.col("h") * k).cast("int").alias("height"), F.floor(F.col("w") * k).cast("int").alias("width"))


@_q(X.with_sql("SELECT region_id, CAST(ceil((coords.b - coords.t) / 32.0) AS INTEGER) AS rows, CAST(ceil((coords.r - coords.l) / 8.0) AS INTEGER) AS cols FROM q_regions WHERE coords IS NOT NULL"))
def reduced_dims(spark: SparkSession, d: str) -> DataFrame:
    return X.regions(spark, d).where("coords is not null").select("region_id", F.expr("cast(ceil((coords.b - coords.t) / 32.0) as int)").alias("rows"), F.expr("cast(ceil((coords.r - coords.l) / 8.0) as int)").alias("cols"))


@_q("SELECT vec_id, flatten(list_transform(CAST(embedding AS DOUBLE[]), lambda x, i: list_transform(range(0, (vec_id + i) % 4), lambda k: x))) AS conf FROM embeddings")
def repeat_conf(spark: SparkSession, d: str) -> DataFrame:
    """Every confidence as often as its token has characters (none, too)."""
    x = F.transform("embedding", lambda v: v.cast("double"))
    times = F.transform("embedding", lambda v, i: (F.col("vec_id") + i + 1) % 4)
    return table(spark, d, "embeddings").select("vec_id", A.repeat_each(x, times).alias("conf"))


@_q("SELECT record_id, lower(hex(encode(reverse(split_part(filename, '_', 1))))) AS id FROM (SELECT DISTINCT record_id, filename FROM label_records)")
def name_id(spark: SparkSession, d: str) -> DataFrame:
    """The bytes of a name, the last first, as an unbounded number in hexadecimal."""
    x = table(spark, d, "label_records").select("record_id", "filename").distinct()
    return x.select("record_id", F.lower(F.hex(F.encode(F.reverse(F.split_part("filename", F.lit("_"), F.lit(1))), "UTF-8"))).alias("id"))


@_q("SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k FROM events WHERE json_extract(props, '$.k') IS NOT NULL")
def json_props(spark: SparkSession, d: str) -> DataFrame:
    x = table(spark, d, "events").select("event_id", F.from_json("props", "k bigint")["k"].alias("k"))
    return x.where("k is not null")


@_q()
def to_json_rows(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "embeddings").select("vec_id", F.to_json(F.struct("vec_id", "label", "embedding")).alias("json"))


@_q("SELECT charset_id, unnest(map_entries(map_from_entries([('dataset', dataset), ('mode', 'page'), ('version', CAST(version AS VARCHAR))]))) AS e FROM label_charsets".replace("SELECT charset_id, unnest", "SELECT charset_id, e.key AS key, e.value AS value FROM (SELECT charset_id, unnest") + ")")
def map_merge(spark: SparkSession, d: str) -> DataFrame:
    """Settings by charset over general ones: the right side wins."""
    general = F.create_map(F.lit("version"), F.lit("0"), F.lit("mode"), F.lit("page"))
    own = F.create_map(F.lit("version"), F.col("version").cast("string"), F.lit("dataset"), F.col("dataset"))
    kept = F.map_filter(general, lambda k, v: ~F.map_contains_key(own, k))
    return table(spark, d, "label_charsets").select("charset_id", F.explode(F.map_concat(kept, own)).alias("key", "value"))


@_q(X.with_sql("SELECT region_id, min(x) AS l, min(y) AS t, max(x) AS r, max(y) AS b FROM (SELECT region_id, coords.l + (region_id * 31 + k * 17) % (coords.r - coords.l + 1) AS x, coords.t + (region_id * 13 + k * 29) % (coords.b - coords.t + 1) AS y FROM q_regions, range(0, 6) t(k) WHERE coords.r >= coords.l AND coords.b >= coords.t) GROUP BY region_id"))
def polygon_bbox(spark: SparkSession, d: str) -> DataFrame:
    """Boxes of polygons of six points written as 'x,y x,y ...', each somewhere in its region's box."""
    at = "transform(sequence(0, 5), k -> concat(coords.l + (region_id * 31 + k * 17) % (coords.r - coords.l + 1), ',', coords.t + (region_id * 13 + k * 29) % (coords.b - coords.t + 1)))"
    x = X.regions(spark, d).where("coords.r >= coords.l and coords.b >= coords.t").select("region_id", F.array_join(F.expr(at), " ").alias("points"))
    return x.select("region_id", A.box_of(F.col("points")).alias("x")).select("region_id", *(F.col(f"x.{k}").cast("bigint").alias(k) for k in "ltrb"))


@_q("SELECT p AS pos, i AS dim, round(CASE WHEN i % 2 = 0 THEN sin(p / pow(10000.0, i / 64.0)) ELSE cos(p / pow(10000.0, (i - 1) / 64.0)) END, 6) AS v FROM range(0, 100) a(p), range(0, 64) b(i)")
def position_table(spark: SparkSession, d: str) -> DataFrame:
    """Sinusoidal positions, 100 by 64."""
    x = spark.range(100).select(F.col("id").alias("pos"), F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(63).cast("bigint"))).alias("dim"))
    k = F.col("dim") - F.col("dim") % 2
    angle = F.col("pos") / F.pow(F.lit(10000.0), k / 64.0)
    return x.select("pos", "dim", F.round(F.when(F.col("dim") % 2 == 0, F.sin(angle)).otherwise(F.cos(angle)), 6).alias("v"))
