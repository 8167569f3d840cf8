"""Nulls, long texts, ties, repeated rows and columns of other names, operator by operator."""

import hashlib
import re
from collections import Counter

from pyspark.sql import functions as F

from folium.llm import chat_format, decontamination, html_text, jaccard_join, line_dedup, mixing, shared, sharding, topk_search, warc

CLASHES = "text2 label n cid tokens keys copy keeper digest again archive refers_to record_type x far floor score rank query_id shard block epoch size target position example target_turn loss_start n_turns n_chars n_lines doc spans items _id _key".split()


def clashing(df):
    return df.withColumns({c: F.lit("mine") for c in CLASHES if c not in df.columns})


def test_html(spark):
    rows = [(1, None, None), (None, "u", "<p>a"), (2, "u", "<p>" + "word " * 200_000), (2, "u", "<p>" + "word " * 200_000), (3, "u", "")]
    found = html_text.op1(clashing(spark.createDataFrame(rows, "page_id long, url string, html string"))).collect()
    assert Counter((r["page_id"], r["n_chars"], r["n_lines"]) for r in found) == Counter({(1, 0, 0): 1, (None, 1, 1): 1, (2, 999_999, 1): 2, (3, 0, 0): 1})


def test_chats(spark):
    long = "x" * 300_000
    rows = [(1, 0, "user", "b"), (1, 0, "user", "a"), (1, 0, "user", "a"), (1, 1, "assistant", long), (1, 1, "assistant", long), (2, None, None, None), (None, 3, "assistant", "n")]
    found = {r["conv_id"]: r for r in chat_format.op3(clashing(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"))).collect()}
    assert set(found) == {-1, 1, 2, None}
    assert found[1]["n_turns"] == 5 and found[1]["loss_chars"] == 600_000 and found[1]["loss_sha256"] == hashlib.sha256((long * 2).encode()).hexdigest()
    assert found[1]["turns_sha256"] == hashlib.sha256("".join(f"{r}\n{t}\n" for r, t in [("user", "a"), ("user", "a"), ("user", "b"), ("assistant", long), ("assistant", long)]).encode()).hexdigest()
    assert (found[2]["n_turns"], found[2]["loss_chars"], found[None]["loss_chars"]) == (1, 0, 1)


def test_similar_documents(spark):
    long = [f"w{k}" for k in range(120_000)]
    near = long.copy()
    near[5] = "other"
    rows = [(5, " ".join(long)), (4, " ".join(near)), (4, " ".join(near)), (None, None), (None, ""), (9, None), (7, "one two"), (6, "ONE two ")]
    found = Counter((r["doc_id"], r["n_shingles"], r["component_id"]) for r in jaccard_join.op6(clashing(spark.createDataFrame(rows, "doc_id long, text string"))).collect())
    assert found == Counter({(5, 119_996, 4): 1, (4, 119_996, 4): 2, (None, 0, None): 2, (9, 0, 9): 1, (7, 1, 6): 1, (6, 1, 6): 1})


def test_archives(spark):
    long = "é" * 1_500_000
    rows = [(1, None, long), (1, "u", long), (None, None, None), (2, "u", "short"), (3, "u", "short"), (0, "u", long)]
    found = Counter((r["page_id"], r["payload_bytes"], r["record_type"], r["refers_to"]) for r in warc.op7(clashing(spark.createDataFrame(rows, "page_id long, url string, html string"))).collect())
    assert found == Counter({(1, 3_000_000, "response", None): 2, (None, 0, "response", None): 1, (2, 5, "response", None): 1, (3, 5, "response", None): 1, (0, 3_000_000, "revisit", 1): 1})


def test_leaks(spark):
    rows = [(1, "word " * 300_000 + "alpha beta gamma"), (1, "alpha beta gamma"), (None, "alpha beta gamma"), (2, None)]
    docs = clashing(spark.createDataFrame(rows, "doc_id long, text string"))
    items = clashing(spark.createDataFrame([(1, "Alpha beta gamma"), (1, "Alpha beta gamma"), (2, None)], "item_id long, text string"))
    found = Counter((r["doc_id"], r["n_words"], r["n_hit"], r["n_items"]) for r in decontamination.op8(docs, items).collect())
    assert found == Counter({(1, 300_003, 3, 1): 1, (1, 3, 3, 1): 1, (None, 3, 3, 1): 1, (2, 0, 0, 0): 1})


def test_search(spark):
    rows = [(0, [1.0, 0.0]), (3, [1.0, 0.0]), (2, [1.0, 0.0]), (2, [1.0, 0.0]), (1, [0.5, 0.5]), (50, None), (None, [1.0, 1.0]), (4, [None, 1.0]), (100, [0.0]), (150, [])]
    found = [tuple(r) for r in topk_search.op9(clashing(spark.createDataFrame(rows, "vec_id long, embedding array<double>"))).orderBy("query_id", "rank").collect()]
    assert found == [(0, 1, 2, 65536), (0, 2, 2, 65536), (0, 3, 3, 65536), (0, 4, 1, 32768)]


def test_lines_shards_and_mixes(spark):
    rows = [(1, "a common line here", "en", "a"), (2, "a common line here", None, "a"), (2, "a common line here", None, "a"), (None, None, None, None), (3, "word " * 150_000, "en", "b")]
    docs = clashing(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string"))
    assert Counter((r["doc_id"], r["n_lines"], r["n_dropped"]) for r in line_dedup.op2(docs).collect()) == Counter({(1, 1, 0): 1, (2, 1, 1): 2, (None, 1, 0): 1, (3, 1, 0): 1})
    shards = sharding.op4(docs).collect()
    assert Counter(r["size"] for r in shards) == Counter({34: 3, 16: 1, 750_016: 1}) and len({r["shard"] for r in shards if r["doc_id"] == 2}) == 1
    assert len({(r["shard"], r["slot"]) for r in shards}) == 5
    mixed = mixing.op10(docs).collect()
    assert Counter((r["doc_id"], r["size"], r["source_size"]) for r in mixed) == Counter({(1, 4, 12): 1, (2, 4, 12): 2, (None, 0, 0): 1, (3, 150_000, 150_000): 1})
    assert all(r["taken"] <= 3 * r["size"] for r in mixed)


def test_a_fill_among_many_documents_of_one_size(spark):
    """All documents have one size, so the last epoch's fill is a choice within one group; reruns agree."""
    rows = [(k, 0, "ab"[k % 3 == 0], 7) for k in range(2000)]
    sizes = spark.createDataFrame(rows, "doc_id long, copy long, source string, size long")
    found = mixing.mix(sizes, blocks=8).where("epoch is not null").groupBy("doc_id").agg(F.count(F.lit(1)).alias("n")).collect()
    again = mixing.mix(sizes.orderBy(F.rand(3)).repartition(5), blocks=8).where("epoch is not null").groupBy("doc_id").agg(F.count(F.lit(1)).alias("n")).collect()
    assert sorted(map(tuple, found)) == sorted(map(tuple, again))
    goal = {r["source"]: r["target"] for r in mixing.targets(sizes).collect()}
    taken = Counter()
    for doc, n in found:
        taken["ab"[doc % 3 == 0]] += 7 * n
    assert all(0 <= goal[s] - taken[s] < 7 for s in "ab")
    counts = Counter(r["n"] for r in found if r["doc_id"] % 3 == 0)
    assert max(counts) - min(counts) <= 1


def test_the_driver_plans_a_mix_in_steps(spark):
    """A plan of many joins fills the driver, which renders it anew after each stage: the mix reads its documents once, in two joins."""
    sizes = spark.createDataFrame([(k, 0, "ab"[k % 3 == 0], 1 + k % 5) for k in range(300)], "doc_id long, copy long, source string, size long")
    plan = mixing.mix(sizes, blocks=8)._jdf.queryExecution().optimizedPlan().toString()
    assert len(re.findall(r"Join (Inner|Left)", plan)) == 2 and len(re.findall(r"\bRelation ", plan)) == 3


def test_the_driver_gives_memory_back(spark, monkeypatch):
    assert shared.trim_driver(spark)  # on Linux, from JDK 17.0.9 on
    calls = []
    monkeypatch.setattr(shared, "trim_driver", calls.append)
    sizes = spark.createDataFrame([(k, 0, "a", 1 + k) for k in range(9)], "doc_id long, copy long, source string, size long")
    mixing.mix(sizes, blocks=2)
    assert calls == [spark]


def test_similar_documents_that_share_an_id_or_have_none(spark):
    """Many classes stand for one id: each meets its own text only, and none is lost."""
    base = [[f"w{k}-{j}" for j in range(40)] for k in range(30)]
    rows = [(i, " ".join(b)) for b in base for i in (None, 7)] + [(100 + k, " ".join(["x", *b])) for k, b in enumerate(base)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    found = jaccard_join.op6(docs)
    assert Counter((r["doc_id"], r["component_id"]) for r in found.collect()) == Counter({(None, 7): 30, (7, 7): 30, **{(100 + k, 7): 1 for k in range(30)}})
    rows = jaccard_join.write_table(docs.select("doc_id", jaccard_join._copy().alias("copy"), "text").mapInArrow(jaccard_join._classes, "doc_id long, copy long, n long, cid long, check long"), "t")
    sets = jaccard_join._surviving_sets(docs, jaccard_join._in_classes(rows, {}), {}, [])
    assert sets.count() == 60
