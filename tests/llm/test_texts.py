"""Looks, overlaps, garbled text, terms and stuffed pages."""

import os
import random
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from quirework.functions.edit import edits
from quirework.llm import garble as G
from quirework.llm import looks as K
from quirework.llm import spam as S
from quirework.llm.overlap import compared, cross_split_pairs
from quirework.llm.terms import TermCounts, changes, marked

FOLDER = os.environ.get("QUIREWORK_TESTDATA", "/root/testdata/sf0.001")


def test_looks():
    assert all(len(a) == len(b) for a, b in (K.LATIN_CYRILLIC, K.LATIN_GREEK, K.LATIN_ARMENIAN, K.CYRILLIC_GREEK))
    same = [("Grenzѕtеin", "Grenzstein"), ("ｐａｒｔ，", "part,"), ("été", "été"), ("a b　c", "a b c"), ("z​w­", "zw"), ("Москвa", "Москва")]
    for a, b in same:
        assert K.consistent(a) == K.consistent(b), (a, b)
    differ = [("a", "A"), ("é", "e"), ("x²", "x2"), ("ⓐ", "a"), ("a\nb", "a b"), ("a  b", "a b"), ("ß", "ss")]
    for a, b in differ:
        assert K.consistent(a) != K.consistent(b), (a, b)
    assert K.consistent("Москвa подписал") == "Москва подписал" and K.consistent(None) is None and K.consistent("​") == ""
    assert K.confusables("сор Grenzѕtеin Москва") == (1, 1)
    rng = random.Random(4)
    for _ in range(500):  # the form is a function of looks, and has the same looks
        t = "".join(rng.choice("aаοoСCéе́ xяΩ​1\n") for _ in range(rng.randint(0, 15)))
        assert K.skeleton(K.consistent(t)) == K.skeleton(t) and K.consistent(K.skeleton(t)) == K.consistent(t)


def test_same_print(spark):
    rows = [(0, 1, "сорt"), (0, 2, "copt"), (0, 3, "copt"), (0, 4, "other"), (0, 5, None), (0, 6, ""), (0, 7, "ⓟ​"), (0, 8, "ⓟ"), (0, 2, "copt"), (1, 1, "copt"), (1, 9, "сopt")]
    df = spark.createDataFrame(rows, "owner int, item int, text string")
    got = sorted((r.owner, r.item_a, r.item_b) for r in K.same_print(df).collect())
    assert got == [(0, 1, 2), (0, 1, 3), (1, 1, 9)]
    assert (0, 7, 8) in {(r.owner, r.item_a, r.item_b) for r in K.same_print(df, every=True).collect()}
    assert K.same_print(df.limit(0)).count() == 0


def noisy(rng, t, n):
    t = list(t)
    for _ in range(n):
        k = rng.randrange(len(t))
        t[k : k + 1] = rng.choice([[], [rng.choice("abcxyz")], [t[k], rng.choice("abcxyz")]])
    return "".join(t)


def test_overlap_against_brute_force(spark):
    rng = random.Random(5)
    words = ["".join(rng.choice("abcdefghijklmnopqrstuvw") for _ in range(rng.randint(3, 9))) for _ in range(400)]
    base = [" ".join(rng.choice(words) for _ in range(rng.randint(3, 120))) for _ in range(60)]
    rows = []
    for k, t in enumerate(base):
        rows.append((2 * k, "train", t))
        n = len(compared(t))
        rows.append((2 * k + 1, rng.choice(["valid", "test"]), noisy(rng, t, int(n * rng.choice([0, 0.01, 0.03, 0.06, 0.2])))))
    rows += [(1000, "test", None), (1001, "test", ""), (1002, "train", "ⓟⓅ"), (1003, "test", "ⓟ Ⓟ"), (1004, None, base[0]), (1005, "valid", base[0].upper()), (1, *rows[1][1:]), (1006, "train", "12 mai 1900"), (1007, "test", "13 mai 1900")]
    df = spark.createDataFrame(rows, "record_id bigint, split string, text string").withColumn("cls", F.lit("clash"))
    got = {(r.train_id, r.eval_id) for r in cross_split_pairs(df).collect()}
    kept = {i: (s, compared(t)) for i, s, t in rows if s and K.has_print(t)}
    want = set()
    for i, (s, a) in kept.items():
        for j, (u, b) in kept.items():
            if s == "train" and u != "train" and 10 * edits(a, b) <= max(len(a), len(b)):
                want.add((i, j))
    assert got == want
    assert cross_split_pairs(df.limit(0)).count() == 0


def test_garble_forms():
    for word in ("déjà", "Müller", "ß", "запись", "ⓟⓝ"):
        assert G.is_clean(word)
        for chain in G.CHAINS:
            made = G.misread(word, chain)
            if made is not None and made != word:
                assert G.reread(made, chain) == word
    assert not G.is_clean("dÃ©jÃ\xa0") and not G.is_clean("d�j")
    for right in ("naïf", "NOËL", "£", "§", "Ørvig", "CHÂTEAU", "«SANTû", "½"):
        assert G.is_clean(right)


def test_garbled(spark):
    rows = [("p", 1, "la clé déjà vue"), ("p", 2, "la clÃ© dÃ©jÃ\xa0 vue"), ("p", 3, "la cl� vue"), ("p", 4, "une seule HÃ©lÃ¨ne"), ("p", 5, "naïf § 4 ½"), ("p", 6, None), ("p", 7, ""), ("q", 2, "Müller"), ("q", 3, "ⓑM├╝llerⒷ"), ("q", 3, "ⓑM├╝llerⒷ"), ("p", 8, "frère è")]
    df = spark.createDataFrame(rows, "place string, item_id bigint, text string").withColumn("word", F.lit(1))
    found = {(r.place, r.item_id) for r in G.garbled(df).select("place", "item_id").collect()}
    assert found == {("p", 2), ("p", 3), ("p", 4), ("q", 3)}
    back = {(r.place, r.item_id): (r.text, r.complete) for r in G.restored(df).collect()}
    assert back["p", 2] == ("la clé déjà vue", True) and back["q", 3] == ("ⓑMüllerⒷ", True) and back["p", 4] == ("une seule Hélène", True) and back["p", 3] == ("la clé vue", True)
    assert G.garbled(df.limit(0)).count() == 0


def test_terms_by_deltas(spark):
    rng = random.Random(6)
    make = lambda: " ".join(rng.choice(["a", "b", "ⓟc", "d\ne", "é́", "x y"]) for _ in range(rng.randint(0, 6))) or None
    old = {i: make() for i in range(40)}
    new = {i: (make() if i % 3 == 0 else t) for i, t in old.items() if i % 7} | {100 + i: make() for i in range(9)}
    df = lambda x: spark.createDataFrame(list(x.items()), "record_id bigint, text string")
    entries = ("a", "é́", "zz")
    counts = TermCounts(spark, entries=entries).apply(new=df(old))
    gone, come = changes(df(old), df(new))
    counts.apply(new=come, gone=gone)
    rows = marked(counts.counts(), spark.createDataFrame([(e,) for e in entries], "term string")).collect()
    occ, rec = Counter(), Counter()
    for t in new.values():
        found = re.findall(r"[^ \t\n\rⒶ-ⓩ]+", t or "")
        occ.update(found)
        rec.update(set(found))
    assert {r.term: (r.occurrences, r.records) for r in rows if r.kind == "word"} == {k: (n, rec[k]) for k, n in occ.items()}
    assert {r.term: r.records for r in rows if r.kind == "entry"} == {e: sum(e in (t or "") for t in new.values()) for e in entries}
    assert all((r.mark == "rare") == (r.records <= 1) for r in rows)
    assert TermCounts(spark).apply(new=df({}) if False else df(old).limit(0)).counts().count() == 0


def test_scripts_and_session_looks(spark):
    assert K.confusables("日本語のテキスト ひらがなカタカナ 한국어漢字") == (0, 0)
    assert K.confusables("pаypal") == (1, 0) and K.confusables("сор")[1] == 1
    assert K.consistent("ab۝c\u200bd") == "ab۝cd"
    table = K.look_table(spark)
    K.use(table)
    try:
        assert [K.consistent(x) for x in ("Ꭺ", "ⲟ", "ѵ", "Ϲ", "ꓐ")] == ["A", "o", "v", "C", "B"]
        assert K.consistent("waγ") == "way"  # a mixed token is mended by a looser look
        assert K.consistent("γάμος") == "γάμος" and K.consistent("город") == "город" and K.consistent("Үүр") == "Үүр"
        close = [(script, look) for _, look, script in table[0]]
        assert len(close) == len(set(close))  # letters that a script keeps apart have looks of their own
    finally:
        K.use(((), ()))
    rows = [(0, 1, "Ꭺrc"), (0, 2, "Arc"), (0, 3, "Arc"), (0, 4, "arc"), (1, 5, "Arc"), (0, 1, "Ꭺrc")]
    df = spark.createDataFrame(rows, "owner bigint, item bigint, text string")
    assert sorted(map(tuple, K.same_print(df).collect())) == [(0, 1, 2), (0, 1, 3)]
    of = {(r.owner, r.item): (r.spellings, r.links) for r in K.print_classes(df).collect()}
    assert of == {(0, 1): (2, 2), (0, 2): (2, 1), (0, 3): (2, 1), (0, 4): (1, 0), (1, 5): (1, 0)}


def test_whole_words_are_replaced():
    to = {"Ã©": "é", "Ã©tÃ©": "été"}
    assert G.replaced("Ã©tÃ©, (Ã©) xÃ©x\nÃ©tÃ©", to) == "été, (é) xÃ©x\nété"
    assert G.replaced("", to) == "" and G.replaced("plain", {}) == "plain"


def test_counts_are_opened_again(spark, tmp_path):
    """Another process sees what one wrote; buckets without a changed term keep their files; late entries are counted in all records."""
    import subprocess
    import sys

    df = lambda x: spark.createDataFrame(list(x.items()), "record_id bigint, text string")
    where = str(tmp_path / "terms")
    old = {i: " ".join(f"w{i}x{k}" for k in range(20)) + " all" for i in range(20)}
    counts = TermCounts(spark, where, entries=("a",), bucket_rows=20).apply(new=df(old))
    assert counts.manifest["of"] >= 16 and counts.manifest["rows"] == counts.counts().count() == 20 * 20 + 1 + 1 + 1
    before = dict(counts.manifest["buckets"])
    again = TermCounts(spark, where, bucket_rows=20).apply(new=df({99: "w1x1"}), gone=df({99: None}))
    same = [k for k, v in again.manifest["buckets"].items() if before.get(k) == v]
    assert len(same) >= len(before) - 2 and again.version == 2  # the bucket of the word only; the number of records is unchanged
    assert [tuple(r) for r in again.counts().where("term in ('w1x1', 'all')").select("term", "records").orderBy("term").collect()] == [("all", 20), ("w1x1", 2)]
    code = f"from quirework.session import local_session as s; from quirework.llm.terms import TermCounts as T; t = T(s(1), {where!r}); print('rows', t.counts().count(), t.version)"
    said = subprocess.run([sys.executable, "-c", code], capture_output=True, text=True, cwd=os.getcwd(), env=os.environ | {"PYTHONPATH": os.getcwd()}).stdout
    assert f"rows {again.counts().count()} 2" in said
    with pytest.raises(ValueError):
        TermCounts(spark, where, entries=("zz",))
    more = again.add_entries(("x1", "zz"), df(old | {99: "w1x1"}))
    assert {r.term: r.records for r in more.counts().where("kind = 'entry'").collect()} == {"a": 20, "x1": 21}
    with pytest.raises(RuntimeError):
        counts.apply(new=df({100: "late"}))  # it still stands at version 1
    kept = more.counts().count()
    more.vacuum()
    assert more.counts().count() == kept and TermCounts(spark, where).counts().count() == kept


LINKS = "\n".join(f"* [Old letters](https://a{i}.example/x)" for i in range(9))
PROSE = "The clerk signed the minutes of the meeting. Adelin returned a letter without a seal before noon; the widow kept the ledger. "


@pytest.mark.parametrize(
    "text, spam",
    [
        (LINKS, True),
        (PROSE + LINKS, True),
        (PROSE * 9 + LINKS, False),
        (PROSE, False),
        ("wax seals, wax seals Torin, old letters, wax seals, old letters, wax seals, vintage paper, wax seals", True),
        ("#Waxseals #Oldletters #WaxsealsTorin #Vintagepaper #Waxseals", True),
        ("Wax seals Torin Set 13,82 frs | Old letters Moran Pro 54,73 $ | Wax seals Talé XL 51,44 EUR", True),
        ("Top wax seals, best wax seals, new wax seals. Wax seals? Wax seals! wax seals. Wax seals + wax seals = wax seals. wax seals wax seals wax seals.", True),
        ("\n".join(f"Klara Toron{c}, Ostorlin: {n}, 12" for n, c in enumerate("abcdefgh")), False),
        ("\n".join(f"{n}.9.\tThe clerk kept a copy of the deed number {n}.\t{n + 7}" for n in range(1, 9)), False),
        ("\n".join(f"Word{n}: The clerk has kept the account of year {n} in a box." for n in range(8)), False),
        ("\n".join(f"On {n} May the reader asked for the map {c} of the common.\nAdelin and Berthe met near the old kiln." for n, c in enumerate("abcdefgh")), False),
        ("été à", False),
        ("", False),
        (None, False),
    ],
)
def test_pages(spark, text, spam):
    docs = spark.createDataFrame([(1, text, "s", None)], "doc_id bigint, text string, source string, url string")
    assert (S.stuffed_pages(docs).count() == 1) == spam


def test_hosts_decide(spark):
    """A list of different phrases is spam where other hosts have them, too, and none where nobody else does; hosts of all pages count, also of those in prose."""
    names = "wax seals, black ink, old letters, rare stamps, goose quills, birth records, census search, paper sheets, parish maps, family trees, vellum rolls, copper plates".split(", ")
    page = (1, ", ".join(names), "s", "http://one.example/a")
    prose = [(10 + k, ". ".join(f"The clerk of the parish kept it, {n}, and the deed in a box" for n in names) + ".", "s", f"http://h{k}.example/b") for k in range(3)]
    kind = "doc_id bigint, text string, source string, url string"
    found = lambda rows: sorted(r.doc_id for r in S.stuffed_pages(spark.createDataFrame(rows, kind)).collect())
    assert found([page]) == []
    assert found([page, *prose[:2]]) == [1]
    assert found([page, *((k, t, s, "http://one.example/b") for k, t, s, _ in prose)]) == []  # one host is not enough
    assert found([page, page, (5, None, None, None), *prose]) == [1]


@pytest.mark.skipif(not os.path.exists(FOLDER), reason="no test tables")
def test_phrases_at_any_place(spark):
    """A phrase that other hosts have counts wherever it stands in an item."""
    names = "wax seals, black ink, old letters, rare stamps, goose quills, birth records, census search, paper sheets".split(", ")
    prose = [(10 + k, ". ".join(f"The clerk of the parish kept it, {n}, and the deed in a box" for n in names) + ".", "s", f"http://h{k}.example/b") for k in range(3)]
    docs = [(1, ", ".join(f"a{k} b{k} c{k} {n}" for k, n in enumerate(names)), "s", "http://one.example/a")]
    assert [r.doc_id for r in S.stuffed_pages(spark.createDataFrame(docs + prose, "doc_id bigint, text string, source string, url string")).collect()] == [1]
    rows = S.phrases(spark.createDataFrame([(1, "one two three four five six seven, eight")], "doc_id bigint, text string")).collect()
    assert [r.at for r in rows] == [1, 2, 3, 4, 5, 6, 1] and len({r.phrase for r in rows}) == 7


def test_only_open_phrases_are_counted(spark, monkeypatch):
    """Phrases that the dense pages alone show on enough hosts are not counted over all pages; of the rest nothing is lost on the way, and what nobody asked for stays out of the shuffle."""
    asked = []
    passed = S.passed
    monkeypatch.setattr(S, "passed", lambda used, wanted: asked.append(wanted.count()) or passed(used, wanted))
    shared = "wax seals, black ink, old letters, rare stamps, goose quills, birth records, census search, paper sheets"
    lists = [(k, f"{shared}, own{k} thing{k}", "s", f"http://h{k}.example/b") for k in range(4)]
    prose = (9, "The clerk of the parish kept the deed in a box, and the widow had the ledger of the year before.", "s", "http://h9.example/b")
    got = S.scored(spark.createDataFrame([*lists, prose], "doc_id bigint, text string, source string, url string")).collect()
    assert asked == [4] and sorted(r.doc_id for r in got if r.spam) == [0, 1, 2, 3]
    assert {round(r.replicated, 6) for r in got} == {round(1 - len("own1 thing1 ") / len(f"{shared}, own1 thing1 ".replace(",", "")), 6)}
    used = spark.range(200000).select(F.xxhash64("id").alias("phrase"))
    kept = passed(used, used.sparkSession.range(5000).select(F.xxhash64("id").alias("phrase")))
    assert 5000 <= kept.count() < 30000 and kept.join(spark.range(5000).select(F.xxhash64("id").alias("phrase")), "phrase").count() == 5000


@pytest.mark.parametrize("text", ["a. b;c! \n d?e", "é.\n\n f. g", "x_y a. B_c d.", ".", " . a"])
def test_narrow_stops(text):
    """Texts without wide stops are cut where the general expressions cut them."""
    assert S._NARROW_STOP.split(text) == S._STOP.split(text)
    assert "_" in text or S._PLAIN_WORD.findall(text) == S._WORD.findall(text)


@pytest.mark.parametrize("text, link, price", [("see HTTP://a b", 1, 0), ("https:", 1, 0), ("WWW.a", 1, 0), ("a.com b", 1, 0), ("a.comb b", 0, 0), ("a.comb\nb", 1, 0), ("x.ab/c", 1, 0), ("[a](b", 1, 0), ("[URL", 1, 0), ("<a b", 1, 0), ("a. b: c [d] <e>", 0, 0), ("3,50 €", 0, 1), ("a,50 €", 0, 0), ("3.50EUR", 0, 1), (",50 €", 0, 0)])
def test_anchors(text, link, price):
    assert (S._ANCHOR.search(text) is not None, S._CURRENCY.search(text) is not None) == (bool(link), bool(price))


@pytest.mark.parametrize("name", ["p2_found", "p4_report", "p5_found", "p6_found", "p9_found"])
def test_queries(spark, name):
    from quirework.llm import registry

    assert registry.queries()[name](spark, FOLDER).count() > 0
