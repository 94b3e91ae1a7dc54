"""Near-copies across splits that share no rare or long stretch."""

import random

import numpy as np

from quirework.functions.edit import edits
from quirework.llm import overlap as O
from quirework.llm.overlap import compared, cross_split_pairs


def spread(rng, text, n):
    """text with n letters replaced at even distances."""
    out = list(text)
    for k in range(n):
        at = (2 * k + 1) * len(out) // (2 * n)
        out[at] = rng.choice([c for c in "abcdefgh" if c != out[at]])
    return "".join(out)


def found_and_true(spark, train, evals):
    rows = [(k, "train", t) for k, t in enumerate(train)] + [(10_000 + k, "test", t) for k, t in enumerate(evals)]
    df = spark.createDataFrame(rows, "record_id bigint, split string, text string")
    found = {(r.train_id, r.eval_id) for r in cross_split_pairs(df).collect()}
    each = [(k, compared(t)) for k, t in enumerate(train)]
    true = {(k, 10_000 + m) for m, u in enumerate(map(compared, evals)) for k, t in each if abs(len(t) - len(u)) <= max(len(t), len(u)) // 10 and edits(t, u) <= max(len(t), len(u)) // 10}
    return found, true


def test_variants_of_a_form(spark):
    rng = random.Random(1)
    form = "".join(rng.choice("abcdefgh") for _ in range(400))
    train = [form[:k] + "xyz" + form[k:] for k in range(0, 400, 5)]
    found, true = found_and_true(spark, train, [spread(rng, form, 30), spread(rng, train[7], 36)])
    assert found == true and len(true) >= 80


def mixed(rng, text, n):
    """text with n edits of any kind at any place."""
    out = list(text)
    for _ in range(n):
        at = rng.randrange(len(out))
        out[at : at + 1] = rng.choice([[], [rng.choice("ijklmnop")], [out[at], rng.choice("ijklmnop")]])
    return "".join(out)


def test_edits_up_to_the_tolerance(spark):
    rng = random.Random(2)
    train = ["".join(rng.choice("abcdefgh") for _ in range(n)) for n in (81, 85, 100, 119, 150, 200, 300, 600, 1100, 2500) for _ in range(6)]
    evals = [f(rng, t, len(t) * share // 100) for t in train for f in (spread, mixed) for share in (8, 9, 10)]
    found, true = found_and_true(spark, train, evals)
    assert found == true and len(true) >= 0.9 * len(evals)


def test_short_texts_of_common_grams(spark):
    rng = random.Random(3)
    line = "".join(rng.choice("abcdefgh") for _ in range(30))
    train = [line[:k] + a + line[k + 1 :] for k in range(30) for a in "xyz"]
    found, true = found_and_true(spark, train, [spread(rng, line, 2), spread(rng, line, 3), line[:12] + line[14:], "abcdefghi"])
    assert found == true and len(true) >= 90


def test_fingerprints():
    rng = random.Random(4)
    letters = lambda n: "".join(rng.choice("abcdefgh") for _ in range(n))
    for _ in range(50):
        shared = letters(O.SEED + O.WINNOW - 1)
        a, b = letters(rng.randrange(80)) + shared + letters(rng.randrange(80)), letters(rng.randrange(80)) + shared + letters(rng.randrange(80))
        assert {h for h, _ in O.seeds_of(a)} & {h for h, _ in O.seeds_of(b)}
        places = [k for _, k in O.seeds_of(a)]
        assert all(q - p <= O.WINNOW for p, q in zip(places, places[1:])) and places == sorted(set(places))
    assert O.seeds_of("short") == [] and len(O.seeds_of("a" * 12)) == 1
    for _ in range(40):
        a = letters(300)
        b = mixed(rng, a, 20)
        n, stretches, longest = O.aligned(a, b)
        assert n >= len(a) - 20 - 20 and longest >= 12 and stretches <= 42
        found = O.chain(a, b)
        assert found == sorted(found) and [q for _, q in found] == sorted(q for _, q in found) and len(found) > 5
    assert O.aligned("", "") == (0, 0, 0) and O.aligned("abc", "abc") == (3, 1, 3) and O.aligned("abc", "xyz") == (0, 0, 0)
    assert O.aligned("a" * 40, "a" * 40)[0] == 40


def test_classes_coverage_and_spans(spark):
    rng = random.Random(5)
    letters = lambda n: "".join(rng.choice("abcdefgh") for _ in range(n))
    text, other, part = letters(200), letters(200), letters(60)
    rows = [(1, "train", text), (2, "train", text), (3, "train", part + letters(100)), (4, "test", text[:50] + "z" + text[51:]), (5, "valid", text), (6, "test", letters(90) + part + letters(50)), (7, "test", other), (8, None, text), (9, "test", None), (10, "valid", "abc"), (11, "train", "abc"), (5, "valid", text)]
    df = spark.createDataFrame(rows, "record_id bigint, split string, text string")
    links = {r.record_id: r.links for r in O.cross_split_classes(df).collect()}
    assert links == {1: 2, 2: 2, 3: 0, 4: 1, 5: 1, 6: 0, 7: 0, 10: 1, 11: 1}
    covered = {r.record_id: (r.length, r.covered) for r in O.coverage(df).collect()}
    assert covered[5] == (200, 200) and covered[10] == (3, 3) and covered[7] == (200, 0) and 36 <= covered[6][1] <= 60 and 150 < covered[4][1] < 200
    pairs = {(r.edits, r.kept, r.stretches) for r in O.spans(df).collect()}
    assert pairs == {(0, 200, 1), (1, 199, 2), (0, 3, 1)}
    assert O.coverage(df.limit(0)).count() == O.spans(df.limit(0)).count() == O.cross_split_classes(df.limit(0)).count() == 0


def test_few_pairs_of_a_cell_are_looked_at(spark):
    """Texts of one form and one length: of all pairs few meet in enough pieces, and none within the tolerance is lost."""
    rng = random.Random(6)
    phrases = ["".join(rng.choice("abcdefgh") for _ in range(25)) for _ in range(12)]
    made = lambda: "".join(rng.choice(phrases) + "".join(rng.choice("abcdefgh") for _ in range(15)) for _ in range(6))
    train = [made() for _ in range(400)]
    evals = [made() for _ in range(100)] + [f(rng, t, 23) for t in train[:40] for f in (spread, mixed)]
    norms = train + evals
    lengths = np.array([len(t) for t in norms])
    order = np.argsort(lengths, kind="stable")
    ts, es = order[order < len(train)], order[order >= len(train)]
    met = [(int(t), int(e)) for i, j in O._met(norms, lengths, ts, es, True) for t, e in zip(i, j)]
    met += [(int(t), int(e)) for i, j in O._met(norms, lengths, es, ts, False) for e, t in zip(i, j)]
    near = {(k, len(train) + 100 + 2 * k + f) for k in range(40) for f in (0, 1)}
    assert near <= set(met) and len(met) == len(set(met)) <= 0.02 * len(ts) * len(es)


def test_every_length_of_short_texts(spark):
    rng = random.Random(7)
    train = ["".join(rng.choice("abcd") for _ in range(n)) for n in range(9, 75) for _ in range(4)]
    evals = [f(rng, t, len(t) // 10) for t in train for f in (spread, mixed)]
    found, true = found_and_true(spark, train, evals)
    assert found == true and len(true) >= len(train)
