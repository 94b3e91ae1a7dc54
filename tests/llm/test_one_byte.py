"""One-byte text read in another one-byte encoding."""

from quirework.llm import garble as G


def test_one_byte_text_in_another_encoding(spark):
    words = {"Müller": ("cp1252", "cp437"), "façade": ("cp1252", "mac_roman"), "запись": ("koi8-r", "cp1251"), "frère": ("cp850", "cp1252"), "château": ("cp1252", "cp1251")}
    made = {w: w.encode(a).decode(b) for w, (a, b) in words.items()}
    rows = [("p", k, w) for k, w in enumerate(words)] + [("p", 10 + k, w) for k, w in enumerate(words)] + [("p", 20 + k, f"vu {m}") for k, m in enumerate(made.values())]
    rows += [("p", 30, "« ½ § »"), ("p", 31, "«"), ("p", 32, "«"), ("p", 33, "Ørvig"), *(("p", 40 + k, "fœur") for k in range(4)), ("p", 50, "fоur")]
    df = spark.createDataFrame(rows, "place string, item_id bigint, text string")
    assert {r.item_id: r.original for r in G.garbled(df).collect()} == {20 + k: w for k, w in enumerate(words)}
