"""Decontamination over several blocks gives what one block gives, row by row."""

import random
from collections import Counter

from folium.llm import decontamination


def rows_of(df):
    return Counter((r["doc_id"], r["n_words"], tuple((s["begin"], s["end"]) for s in r["spans"]), tuple(r["items"])) for r in df.collect())


def test_blocks_change_nothing(spark):
    rng = random.Random(4)
    words = [f"w{k}" for k in range(30)]
    items = [(k, " ".join(rng.choices(words, k=rng.choice((2, 3, 9, 10, 11, 25))))) for k in range(40)] + [(7, "w1 w2"), (None, "w3 w4"), (8, None), (8, "")]
    texts = []
    for k in range(120):
        tail = rng.choice(items)[1] or ""
        texts.append(None if k % 17 == 0 else " ".join(rng.choices(words, k=rng.choice((0, 1, 8, 40)))) + " " + tail.upper())
    # Ids are shared and null, and some rows are equal.
    docs = spark.createDataFrame([(k % 9 if k % 5 else None, t) for k, t in enumerate(texts)] + [(1, texts[3])] * 3, "doc_id long, text string")
    bench = spark.createDataFrame(items, "item_id long, text string")
    one = rows_of(decontamination.find_leaks(docs, bench, keep=["doc_id"]))
    assert sum(one.values()) == 123 and any(spans for _, _, spans, _ in one)
    for group_bytes in (1, 500, 1 << 20):
        assert rows_of(decontamination.find_leaks(docs, bench, keep=["doc_id"], block_bytes=60, group_bytes=group_bytes)) == one


def test_rows_that_share_an_id_stay_apart(spark):
    docs = spark.createDataFrame([(1, "a b c d e f g h i j k l m n o"), (1, "clean")], "doc_id long, text string")
    bench = spark.createDataFrame([(k, f"{a} {b}") for k, (a, b) in enumerate(zip("abcdefgh", "bcdefghi", strict=True))], "item_id long, text string")
    for size in (1, 1 << 20):
        found = decontamination.find_leaks(docs, bench, keep=["doc_id"], block_bytes=size)
        assert rows_of(found) == Counter({(1, 15, ((0, 9),), tuple("01234567")): 1, (1, 1, (), ()): 1})
