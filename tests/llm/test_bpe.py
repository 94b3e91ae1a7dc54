"""The tokenizer against the library's, round trips, streams, budgets and packing."""

import os
import random
from collections import Counter, defaultdict

import pytest

from quirework.llm import bpe as B
from quirework.llm.budget import language, token_budget
from quirework.llm.encode import decode_ids, encode_texts
from quirework.llm.packing import pack, pack_documents, pack_windows

FILE = os.path.join(B.TOKENIZERS, B.BYTE_BPE)
pytestmark = pytest.mark.skipif(not os.path.exists(FILE), reason="no tokenizer files")
PARTS = ["a", "b", "the", " ", "  ", "\n", "\t", " ", "é", "中", "1", "²", "'s", "'", "!", "\U0001f600", "ⓟ", "　", " x", "\x1c", "<|endoftext|>"]


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(FILE)
    t.encode_special_tokens = True
    return lambda s: t.encode(s, add_special_tokens=False).ids


def test_equals_library(library):
    rng, k = random.Random(0), B.tokenizer()
    for _ in range(1500):
        s = "".join(rng.choice(PARTS) for _ in range(rng.randint(0, 40)))
        assert k.encode(s) == library(s), repr(s)
        assert k.decode(k.encode(s)) == s
        assert sum(map(k.count, k.units(s))) == k.count(s)
    assert k.encode(None) == k.encode("") == []


def test_streams(library, monkeypatch):
    monkeypatch.setattr(B, "BLOCK", 50)
    rng, k = random.Random(1), B.tokenizer()
    for _ in range(800):
        s = "".join(rng.choice(PARTS) * rng.choice([1, 1, 1, 3, 120]) for _ in range(rng.randint(0, 20)))
        assert k.encode(s) == library(s), repr(s)


def test_transducer(library):
    """Long pieces through the window of the sufficient lookahead."""
    rng, k = random.Random(2), B.tokenizer()
    words = [w for w in (v.decode("utf-8", "ignore") for v in k.merges.bytes_of.values()) if w.isalpha()]
    assert 0 < k.merges.lookahead < 2000
    for _ in range(40):
        for s in ("".join(rng.choice(words) for _ in range(300)), "".join(rng.choice("abcdeéü中文字") for _ in range(1500)), rng.choice(words) * 400):
            t = B.PieceTransducer(k.merges, block=rng.choice([8, 64, 256]))
            data, out = s.encode(), []
            while data:
                n = rng.randint(1, 400)
                out += t.push(data[:n])
                assert len(t.held) <= t.block + k.merges.lookahead + n
                data = data[n:]
            assert [*out, *t.finish()] == library(s)


def test_encode_rows(spark, library):
    rows = [(1, "Déjà vu\n\nici"), (2, None), (3, ""), (4, " \n"), (5, "x" * 200_000), (1, "Déjà vu\n\nici")]
    docs = spark.createDataFrame([(*r, "e") for r in rows], "doc_id bigint, text string, ids string")
    out = encode_texts(docs)
    got = sorted((r.doc_id, tuple(r.ids)) for r in out.collect())
    assert got == sorted((i, tuple(library(t)) if t else ()) for i, t in rows)
    back = {r.doc_id: r.text for r in decode_ids(out).collect()}
    assert back[5] == "x" * 200_000 and back[2] == back[3] == ""
    assert encode_texts(docs.limit(0)).count() == 0


def test_other_kinds_are_refused(tmp_path):
    with pytest.raises(ValueError):
        B.Tokenizer(os.path.join(B.TOKENIZERS, "word_bpe_49k.json"))


def test_budget(spark):
    k = B.tokenizer()
    records = spark.createDataFrame([(1, "un deux  trois"), (1, "un deux  trois"), (2, None), (3, "quatre\ncinq")], "record_id bigint, text string")
    samples = spark.createDataFrame(
        [(1, 1, "s", "FR", "d", 1), (2, 1, "s", "fr", "d", 2), (3, 2, "s", "fr", "d", 1), (4, 3, None, None, "d", 1), (4, 3, "late", None, "d", 9), (5, 99, "s", "fr", "d", 1), (6, None, "s", "fr", "d", 1)],
        "sample_id bigint, record_id bigint, source string, lang string, domain string, loaded_at int",
    )
    got = {(r.source, r.lang, r.domain): (r.n_records, r.n_tokens) for r in token_budget(records, samples, ["source", "lang", "domain"]).collect()}
    assert got == {("s", "fr", "d"): (2, k.count("un deux  trois")), (None, None, "d"): (1, k.count("quatre\ncinq"))}
    assert token_budget(records.limit(0), samples, ["source"]).count() == 0
    assert [r.x for r in spark.createDataFrame([(" FR-ch ",), ("",), (None,)], "l string").select(language("l").alias("x")).collect()] == ["fr", None, None]


def test_pack_windows():
    rng = random.Random(3)
    items = [(rng.randrange(9), i, rng.choice([0, 1, 50, 300, 900, 2048, 5000])) for i in range(600)]
    total = sum(n for _, _, n in items)
    out = pack_windows(items, 2048)
    rooms = Counter()
    parts = defaultdict(list)
    for key, part, container, window, first, n in out:
        rooms[container] += n
        parts[key].append((part, first, n, window))
    assert max(rooms.values()) <= 2048 and sum(rooms.values()) == total and total / (len(rooms) * 2048) > 0.97
    for window, key, n in items:
        rows = sorted(parts[key])
        assert sum(x[2] for x in rows) == n and [x[0] for x in rows] == list(range(len(rows))) and {x[3] for x in rows} == {window}
        assert [x[1] for x in rows] == [sum(x[2] for x in rows[:k]) for k in range(len(rows))]
        assert len(rows) == 1 or n > 2048
    assert pack_windows([], 2048) == []


@pytest.mark.parametrize("wanted", [None, {"x": 0.2, "y": 0.3, None: 0.5}, {"x": 3, "y": 1}])
def test_mixture_of_windows(spark, wanted):
    """After every window no source is further from its share of what was given out than its longest item, as long as no source has run dry."""
    rng = random.Random(5)
    rows = [(i, rng.choice(["x", "x", "x", "y", None, "z"]), rng.choice([1, 40, 300, 1500, 2500])) for i in range(6000)]
    sizes = spark.createDataFrame(rows, "doc_id bigint, source string, n_tokens bigint")
    out = pack(sizes, 2048, shard_tokens=300_000, proportions=wanted, window=16).collect()
    budget, of = 16 * 2048, Counter()
    for _, s, n in rows:
        of[s] += n
    shares = {s: (wanted or of).get(s, 0) / sum((wanted or of).values()) for s in of}
    dry = min(of[s] / v for s, v in shares.items() if v) if wanted else sum(of.values())
    per = defaultdict(Counter)
    for r in out:
        per[r.window][r.source] += r.n_tokens
    assert sorted(per) == list(range(len(per))) and len({r.container.split("-")[0] for r in out}) > 5
    taken, windows = Counter(), 0
    for w in sorted(per):
        taken.update(per[w])
        windows += 1
        if (w + 1) * budget <= dry:
            for s, share in shares.items():
                assert abs(taken[s] - windows * budget * share) <= 2500, (w, s)
                assert abs(per[w][s] - budget * share) <= 2 * 2500
    assert windows >= 20 and sum(taken.values()) == sum(of.values())


def test_pack(spark):
    rows = [(i, ["x", "y", None][i % 3], 100 + i % 700) for i in range(4000)]
    sizes = spark.createDataFrame(rows, "doc_id bigint, source string, n_tokens bigint")
    out = pack(sizes, 2048, shard_tokens=200_000).collect()
    rooms = Counter()
    for r in out:
        rooms[r.container] += r.n_tokens
    assert max(rooms.values()) <= 2048 and sum(rooms.values()) == sum(r[2] for r in rows)
    assert sum(rooms.values()) / (len(rooms) * 2048) > 0.97
    assert pack(sizes.limit(0)).count() == 0
    docs = spark.createDataFrame([(1, None, "a b c"), (2, "s", None)], "doc_id bigint, source string, text string")
    assert {(r.doc_id, r.n_tokens) for r in pack_documents(docs).collect()} == {(1, 3), (2, 0)}
