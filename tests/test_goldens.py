"""Hand-worked cases and properties of the operators that need no tables."""

import random

import pytest
from pyspark.sql import functions as F

from quirework.functions import arrays as A
from quirework.functions import text as T
from quirework.functions.distance import char_edits, word_edits
from quirework.functions.edit import alignment, edits
from quirework.operators import entities as N
from quirework.operators import layout as L
from quirework.operators import reading as R
from quirework.operators import schedules as S


def one(spark, expr, **cols):
    row = spark.createDataFrame([tuple(cols.values())], list(cols)) if cols else spark.range(1)
    return row.select(expr.alias("x")).first().x


def plain_edits(a, b):
    row = list(range(len(b) + 1))
    for i, c in enumerate(a, 1):
        new = [i]
        for j, e in enumerate(b, 1):
            new.append(min(row[j - 1] + (c != e), row[j] + 1, new[j - 1] + 1))
        row = new
    return row[-1]


def test_rates(spark):
    s = F.lit
    a, b = T.cer_normalise(s("ⓟab cdⓅ"), "ⓟⓅ"), T.cer_normalise(s("ⓟab cxⓅ"), "ⓟⓅ")
    assert one(spark, char_edits(a, b)) == 1 and one(spark, F.char_length(a)) == 5
    assert one(spark, T.wer_normalise(s("a,b ⓟc"), "ⓟ")) == ["a", ",", "b", "c"]
    assert one(spark, T.wer_normalise(s(""))) == [""]
    assert one(spark, T.wer_normalise(s("a\\b(c)"))) == ["a\\b", "(", "c", ")"]
    assert one(spark, T.wer_normalise(s("xⓅⓟy"), "ⓟⓅ")) == ["xy"]
    assert one(spark, word_edits(T.wer_normalise(s("a , b c")), T.wer_normalise(s("a b c")))) == 1
    many = [f"w{i}" for i in range(20500)]
    assert one(spark, word_edits(F.split(s(" ".join(many)), " "), F.split(s(" ".join(many[:-1])), " "))) == 1
    with pytest.raises(ValueError):
        T.keep_tokens(s("a"), "")


def test_text(spark):
    s = F.lit
    assert one(spark, T.wrap_lines(s("aa bb cc"), 5)) == ["aa", "bb", "cc"] or one(spark, T.wrap_lines(s("aa bb cc"), 5)) == ["aa bb", "cc"]
    assert one(spark, T.wrap_lines(s("abcdefg h"), 5)) == ["", "abcdefg", "h"]
    names = spark.createDataFrame([("p10",), ("p2",), ("p1",)], ["n"]).orderBy(T.natural_key(F.col("n"))).collect()
    assert [r.n for r in names] == ["p1", "p2", "p10"]
    assert one(spark, T.canonical(s("cab"))) == one(spark, T.canonical(s("bca"))) == "abc"
    assert one(spark, T.first_alternative(s("x ¤{un/deux}¤ y"))) == "x un y"
    repairs = {"Ã©tÃ©<euro>": "été€", "mÃªme": "même", "oÃ¹": "où", "Ã\x80 bientÃ´t": "À bientôt", "plaÃ®t": "plaît", "gÃ¢teau": "gâteau", "Ã§a": "ça", "voilÃ\xa0": "voilà ", "voilÃ": "voilà", "nÂ°2": "n°2", "mÂ²": "m²", "5¬": "5€", "a\\nb": "a\nb"}
    for wrong, right in repairs.items():
        assert one(spark, T.annotation_repair(s(wrong))) == right
    assert one(spark, T.wrap_lines(s("aa  bbbbbb c dd"), 5)) == ["aa", "bbbbbb", "c dd"]
    assert one(spark, T.wrap_lines_b(s("aa bb\n cc"), 5)) == ["aa", "bb cc"] and one(spark, T.wrap_lines_b(s(" "), 5)) == []
    longest = "9" * 30
    numbers = spark.createDataFrame([(longest,), ("1" + longest,), ("007",), ("8",)], ["n"]).orderBy(T.natural_key(F.col("n"))).collect()
    assert [r.n for r in numbers] == ["007", "8", longest, "1" + longest]
    assert one(spark, T.end_at_dot(s("Eins. Zwei. Dr"))) == "Eins. Zwei."
    assert one(spark, T.encode(s("ba"), F.split(s("abc"), ""))) == [1, 0]
    assert one(spark, T.regions(s("ⓑaⒷxⓑbⒷ"), "ⓑ", "Ⓑ")) == ["a", "b"]
    assert one(spark, A.reverse_inner(F.array(*map(s, [0, 1, 2, 3, 9])))) == [0, 3, 2, 1, 9]
    assert one(spark, A.reverse_inner(F.array(*map(s, [1, 2])))) == [1, 2]
    box = one(spark, A.box_of(s("3,4 10,2 5,9")))
    assert (box.l, box.t, box.r, box.b) == (3, 2, 10, 9)
    for f in (T.cer_normalise, T.wer_normalise, T.text_label_clean, T.annotation_repair, T.first_alternative, T.end_at_dot, T.page_number):
        assert one(spark, f(s(None).cast("string"))) is None


def test_schedules(spark):
    assert one(spark, S.linear(1.0, 0.2, F.lit(150000), 300000)) == pytest.approx(0.6)
    assert S.step_points([(0, 1), (10, 3)]) == [(0, 1), (5, 2), (10, 3)]
    assert one(spark, S.curriculum_lines(F.lit(0), 500, 300, 2, 30)) == 2


def test_flat_repair(spark):
    r = lambda t: tuple(one(spark, L.flat_repair(F.lit(t))))
    assert r("ⓑaⓞb") == ("ⓑaⒷⓞbⓄ", 2)
    assert r("aⒷb") == ("ab", 1)
    assert r("") == ("", 0)


def test_tree_repair():
    assert L.tree_repair("")[:2] == ("ⓟⓅ", 2)
    assert L.tree_repair("ⓑxⒷ")[:2] == ("ⓟⓢⓑxⒷⓈⓅ", 4)
    rng = random.Random(1)
    for grammar, signs in ((L.READ, "ⓟⓅⓝⓃⓢⓈⓐⒶⓑⒷxy"), (L.ACTS, "ⓟⓅⓜⓂⓝⓃⓑⒷⓘⒾxy")):
        for _ in range(400):
            text = "".join(rng.choice(signs) for _ in range(rng.randint(0, 25)))
            made, ops, at = L.tree_repair(text, grammar)
            assert L.tree_repair(made, grammar)[:2] == (made, 0), text
            assert len(at) == len(made) and all(i < 0 or text[i] == c for c, i in zip(made, at))
            assert [c for c in made if c in "xy"] == [c for c in text if c in "xy"]


def test_graphs():
    two = (["D", "b", "o"], {(0, 1), (0, 2), (1, 2)})
    only = (["D", "b"], {(0, 1)})
    assert L.graph_distance(two, only) == (3, True) == L.graph_distance(only, two)
    assert L.graph_distance(two, two) == (0, True)
    nodes, edges = L.layout_graph("ⓟⓝⓢⓐⓑⓢⓑ", L.READ)
    assert len(nodes) == 8 and len(edges) == 7 + 3
    assert L.graph_edits("ⓟⓢⓑ", "ⓟⓢⓑ", L.READ)[0] == 0
    assert L.graph_edits("", "", L.READ) == (0, 1, True)


def _least_cost(a, b):
    best = [10**9]

    def go(i, to, used):
        if i == len(a[0]):
            best[0] = min(best[0], L._mapping_cost(a, b, to))
            return
        for j in {*range(len(b[0]))} - used:
            go(i + 1, [*to, j], used | {j})
        go(i + 1, [*to, -1], used)

    go(0, [], set())
    return best[0]


def test_graph_distance_of_small_graphs():
    rng = random.Random(3)

    def graph():
        n = rng.randint(0, 5)
        return [rng.choice("xyz") for _ in range(n)], {(x, y) for x in range(n) for y in range(n) if x != y and rng.random() < 0.3}

    for _ in range(150):
        a, b = graph(), graph()
        assert L.graph_distance(a, b, 10**7) == (_least_cost(a, b), True), (a, b)


def test_graph_distance_of_long_pages():
    """A region in the middle of a page is a node, three edges and one that bridges the gap; a renamed one costs 1."""
    rng = random.Random(4)
    text = "ⓟⓜ" + "".join(rng.choice("ⓝⓑⓘⓢ") for _ in range(300))
    for k in (1, 2, 3):
        at = range(50, 50 + 70 * k, 70)
        less = "".join(c for i, c in enumerate(text) if i not in at)
        assert L.graph_edits(text, less, L.ACTS)[0] == L.graph_edits(less, text, L.ACTS)[0] <= 5 * k
    assert L.graph_edits(text, text[:99] + {"ⓝ": "ⓑ"}.get(text[99], "ⓝ") + text[100:], L.ACTS)[::2] == (1, True)
    assert L.graph_edits(text, text, L.ACTS)[::2] == (0, True)


def test_average_precision():
    marks = [n / 100 for n in range(5, 51, 5)]
    got = L.average_precisions(["abcd", "efgh"], ["abcd", "zzzz", "efgx"], marks)
    assert got[4] == pytest.approx(0.8333, abs=1e-4) and got[:4] == [0.5] * 4 and sum(got) / 10 == pytest.approx(0.7, abs=1e-3)
    assert L.average_precisions([], ["a"], [0.5]) == [0.0] and L.average_precisions([""], [], [0.5]) == [0.0]


def test_edits_and_alignment():
    rng = random.Random(2)
    for _ in range(300):
        a, b = ("".join(rng.choice("abc") for _ in range(rng.randint(0, 12))) for _ in range(2))
        d = plain_edits(a, b)
        assert edits(a, b) == d
        pairs = alignment(a, b)
        assert sum(i < 0 or j < 0 or a[i] != b[j] for i, j in pairs) == d
        assert [i for i, _ in pairs if i >= 0] == list(range(len(a))) and [j for _, j in pairs if j >= 0] == list(range(len(b)))


def test_entities():
    rows = N.bio_of("Anna✻ Lee✻ in Rom✼, ✼", "✻✼")
    assert rows == [("Anna", "B-✻"), ("Lee", "I-✻"), ("in", "O"), ("Rom", "B-✼"), ("✼", "O")]
    text, labels, counts = N.char_labels(rows)
    assert len(text) == len(labels) and counts["All"] == 2
    assert N.entity_scores(rows, rows) == (2, 2, 2)
    assert N.entity_scores(rows, []) == (2, 0, 0)
    assert N.entity_scores([], []) == (0, 0, 0)
    assert N.bio_of("", "✻") == []


def test_reading_order():
    box = lambda i, l, t, r, b, label="x": {"id": i, "l": l, "t": t, "r": r, "b": b, "label": label}
    page = [box(1, 500, 0, 900, 50), box(2, 0, 0, 400, 50), box(3, 0, 100, 900, 150), box(4, 0, 40, 300, 90)]
    assert [x["id"] for x in R.letter_order(page)][:2] == [2, 1]
    assert R.letter_order([]) == []
    reg = [box(1, 0, 0, 50, 20, "12"), box(2, 600, 100, 900, 300), box(3, 0, 110, 200, 160), box(4, 600, 400, 900, 500)]
    assert [(x["id"], m) for x, m, _ in R.register_order(reg, 1000)] == [(1, "page_number"), (3, "annotation"), (2, "body"), (4, "body")]
    assert R.register_order([box(1, 0, 0, 10, 10)], 1000)[0][1] == "annotation"
