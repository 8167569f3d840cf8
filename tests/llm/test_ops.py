"""The training-data operators against brute force, round trips and SQL, on small tables with every odd case."""

import hashlib
import math
import os
import random
import re
import zlib

import duckdb
import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from folium.llm import chat_format, components, decontamination, hashing, html_text, jaccard_join, line_dedup, mixing, quality, queries, shared, sharding, topk_search, warc
from folium.llm.fm_index import FMIndex

DATA = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def table(spark, rows, schema=DOCS):
    return spark.createDataFrame(rows, schema)


def documents(spark, texts, ids=None):
    ids = range(len(texts)) if ids is None else ids
    return table(spark, [(i, t, "en", f"s{k % 3}", 0) for k, (i, t) in enumerate(zip(ids, texts, strict=True))])


def by_id(df, key="doc_id"):
    return {r[key]: r.asDict() for r in df.collect()}


# ---- Whole tables against SQL ----


@pytest.fixture(scope="module")
def con():
    found = duckdb.connect()
    for name in "documents embeddings pages benchmark labels conversations".split():
        found.execute(f"CREATE VIEW {name} AS SELECT * FROM '{DATA}/{name}.parquet'")
    return found


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_sql(spark, con, name):
    found = queries.queries()[name](spark, DATA)
    result = con.execute(queries.oracle_sql()[name])
    names = [d[0] for d in result.description]
    pick = lambda cols, rows: sorted((tuple(r[cols.index(c)] for c in sorted(names)) for r in rows), key=repr)
    assert pick(list(found.columns), found.collect()) == pick(names, result.fetchall())


@pytest.mark.parametrize("name", sorted(queries.queries()))
def test_empty_tables(spark, name, tmp_path):
    for t in "documents embeddings pages benchmark labels conversations".split():
        spark.read.parquet(f"{DATA}/{t}.parquet").limit(0).write.parquet(str(tmp_path / f"{t}.parquet"))
    rows = queries.queries()[name](spark, str(tmp_path)).collect()
    assert [r["conv_id"] for r in rows] == [-1] if name.startswith("op3_") else rows == []


# ---- Shared parts ----


def test_words_and_shingles():
    texts = pa.array(["The cat  sat\ton\nthe MAT", "", None, "x" * 10, "ä cat", " the cat sat "])
    values = hashing.byte_values()
    found = {}
    for low, high, bounds, words in hashing.tokenise(texts, hashing.SPACED, values):
        for r in range(high - low):
            found[low + r] = words[bounds[r] : bounds[r + 1]].tolist()
    assert [len(found[i]) for i in range(6)] == [6, 0, 0, 1, 2, 3]
    assert found[0][:3] == found[5] and found[0][0] == found[0][4] and found[4][1] == found[0][1]


def test_long_texts_hash_as_short_ones(monkeypatch):
    text = " ".join(f"w{i % 977}" for i in range(20_000))
    whole = next(hashing.tokenise(pa.array([text]), hashing.SPACED, hashing.byte_values()))[3]
    monkeypatch.setattr(hashing, "SLAB", 1000)
    pieces = next(hashing.tokenise(pa.array([text]), hashing.SPACED, hashing.byte_values(), spans=True))
    assert (whole == pieces[3]).all() and text[pieces[4][5] : pieces[5][5]] == "w5"


def test_components(spark, monkeypatch):
    rng = random.Random(3)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(200)] + [(1000, 1000 + k) for k in range(1, 200)] + [(2000 + k, 2001 + k) for k in range(40)]
    parent = {}

    def root(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in edges:
        a, b = root(a), root(b)
        parent[max(a, b)] = min(a, b)
    expected = {x: root(x) for a, b in edges if a != b for x in (a, b)}
    for few in (components.FEW_EDGES, 0):
        monkeypatch.setattr(components, "FEW_EDGES", few)
        assert {r["node"]: r["component"] for r in components.connected_components(table(spark, edges, "u long, v long")).collect()} == expected


def test_written_tables_are_read_back(spark):
    df = shared.write_table(spark.range(3), "t")
    assert df.count() == 3 and "folium" in df.inputFiles()[0]


# ---- 1 HTML ----


def test_html_layout():
    page = "<title>t</title><p>One<p>Two <b>bold<br>line<ul><li>a<li>b<ol start=3><li>x<li>y</ol></ul><table><tr><th>Name<th>Qty<tr><td>Apple<td>10<tr><td rowspan=2>two<td>1<tr><td>2</table><div hidden>no</div><p style='display:none'>no<p style='visibility:hidden'>no <i style='visibility:visible'>yes</i><pre> a\n  b</pre><script>'</p>'</script>end &amp; &lt;"
    assert html_text.html_to_text(page).split("\n") == ["One", "", "Two bold", "line", "", "- a", "- b", "  3. x", "  4. y", "", "Name  | Qty", "Apple | 10", "two   | 1", "      | 2", "", "yes", "", " a", "  b", "", "end & <"]


@pytest.mark.parametrize("page", [None, "", "<", "<a", "</", "<!--", "<p", '<p class="', "<table><td>", "</p></p>", "<" * 1000, "<div>" * 5000 + "x", "<table><tr><td>" * 60 + "x", "&#0;&bogus;", "<li>x", "<tr><td>x"])
def test_odd_html(page):
    assert isinstance(html_text.html_to_text(page), str)


@pytest.mark.parametrize("parent", ["table", "thead", "tbody", "tfoot", "tr"])
def test_html_keeps_text_outside_cells(parent):
    inner = "note<tr><td>x</td></tr>" if parent != "tr" else "<tr>note<td>x</td></tr>"
    page = f"<table>{inner}</table>" if parent in ("table", "tr") else f"<table><{parent}>{inner}</{parent}></table>"
    assert html_text.html_to_text(page) == "note\nx"
    assert html_text.html_to_text(page.replace("<td>x</td>", "")) == "note"
    assert html_text.html_to_text(page.replace(f"<{parent}>", f"<{parent} style='display: none'>", 1)) == ""


def test_html_keeps_text_outside_cells_in_order():
    page = "<table>a<tfoot>b<tr>c<td>5</td>d</tr></tfoot><thead>e<tr><td>1</td></tr></thead><tbody><tr>f<td>2<table><tr>g<td>3</td></tr></table></td></tr></tbody></table>"
    assert html_text.html_to_text(page).split() == list("abcdef12g35")


def test_html_keeps_all_visible_words(spark):
    from html import unescape

    for row in spark.read.parquet(f"{DATA}/pages.parquet").collect():
        bare = re.sub(r"(?s)<head>.*?</head>|<script>.*?</script>|<style>.*?</style>|<!--.*?-->", "", row["html"])
        found = re.sub(r"(?m)^\s*- ", "", html_text.html_to_text(row["html"]))
        assert unescape(re.sub("<[^>]*>", " ", bare)).split() == found.split()


# ---- 2 Lines ----


def test_lines(spark):
    line, other = "A common line here", "another long line"
    texts = [f"{line}\nx\n{line}", f"  {line.upper()}\t\nshort\nshort", None, "", f"{other}\n{other}", f"y\n{other} ", "short\nshort", f"{line}\n"]
    found = line_dedup.dedup_lines(documents(spark, texts, [1, 2, 3, 4, 5, 5, 6, None]).withColumn("n_lines_extra", F.lit(1)))
    rows = sorted(((r["doc_id"], r["text"], r["n_lines"], r["n_dropped"]) for r in found.collect()), key=repr)
    expected = [(1, texts[0], 3, 0), (2, "short\nshort", 3, 1), (3, "", 1, 0), (4, "", 1, 0), (5, texts[4], 2, 0), (5, texts[5], 2, 0), (6, "short\nshort", 2, 0), (None, "", 2, 1)]
    assert rows == sorted(expected, key=repr)
    three = line_dedup.dedup_lines(documents(spark, [line, line, line]), min_docs=3)
    assert [r["n_dropped"] for r in three.orderBy("doc_id").collect()] == [0, 1, 1]


# ---- 3 Chats ----


@pytest.mark.parametrize("text", ["", "<|im_end|>", "<\\|x", "<\\\\||", "a<", "|", "<<||>>", "\\n", "<|im_start|>assistant\n"])
def test_chat_round_trip(text):
    role = text + "\n\\r"
    written = chat_format.write_turn(role, text) + chat_format.write_turn("user", text)
    assert chat_format.read_turns(written) == [(role, text), ("user", text)]


def test_examples(spark):
    rows = [(1, 0, "system", "s"), (1, 1, "user", "u"), (1, 2, "assistant", "a1"), (1, 3, "user", None), (1, 4, "assistant", "a<|2"), (1, 5, "user", "end"), (2, 0, "user", "only"), (None, 0, "assistant", "n"), (3, None, None, None)]
    found = chat_format.format_chats(table(spark, rows, "conv_id long, turn long, role string, text string")).collect()
    mine = sorted((r for r in found if r["conv_id"] == 1), key=lambda r: r["example"])
    assert [r["text"][r["loss_start"] : r["loss_end"]] for r in mine] == ["a1", "a<\\|2", ""]
    assert all(b["text"].startswith(a["text"]) for a, b in zip(mine, mine[1:], strict=False))
    back = {r["conv_id"]: r for r in chat_format.read_examples(spark.createDataFrame(found, chat_format.EXAMPLES)).collect()}
    assert (back[1]["n_turns"], back[1]["loss_chars"], back[2]["loss_chars"], back[3]["n_turns"], back[None]["loss_chars"]) == (6, 6, 0, 1, 1)
    assert back[1]["loss_sha256"] == hashlib.sha256(b"a1a<|2").hexdigest()


# ---- 4 Shards ----


def test_shards(spark):
    docs = documents(spark, [f"text {i % 700}" for i in range(3000)] + [None, ""], [*range(3000), None, None])
    rows = sharding.op4(docs).collect()
    slots = {}
    for r in rows:
        slots.setdefault(r["shard"], []).append(r["slot"])
        assert r["grown_shard"] in (r["shard"], 40) and r["shard"] // 5 == r["rack"] and r["rack"] // 4 == r["region"]
    assert all(sorted(s) == list(range(len(s))) for s in slots.values()) and set(slots) <= set(range(40))
    assert len(slots) == 40 and max(map(len, slots.values())) < 2 * 75
    assert {r["text_crc32"] for r in rows if r["doc_id"] == 0} == {zlib.crc32(b"text 0")}


# ---- 5 Quality ----


def test_classifier(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "labels"))
    found = quality.op5(docs, labels)
    rows = found.join(labels, "doc_id").where("held_out").collect()
    assert np.mean([r["predicted"] == r["quality"] for r in rows]) > 0.97
    assert found.count() == docs.count()
    blind = quality.op5(docs.withColumns({"source": F.lit("x"), "lang": F.lit("y")}), labels.withColumn("quality", F.when(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 1, 1 - F.col("quality")).otherwise(F.col("quality"))))
    assert sorted(map(tuple, blind.collect())) == sorted(map(tuple, found.collect()))


def test_scores_of_odd_texts(spark):
    docs = documents(spark, [None, "", " ", "!!!", "a" * 300_000, "word " * 50_000])
    rows = quality.op5(docs, table(spark, [(0, None), (None, 1), (99, 1)], "doc_id long, quality int")).collect()
    assert [r["score"] for r in rows] == [0.5] * 6


# ---- 6 Similar documents ----


def brute_components(texts, ids):
    sets = []
    for t in texts:
        words = re.findall("[^\x20\x09-\x0d]+", (t or "").translate({c: c + 32 for c in range(65, 91)}))
        sets.append({tuple(words[i : i + 5]) for i in range(len(words) - 4)} or ({tuple(words)} if words else set()))
    parent = list(range(len(sets)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, a in enumerate(sets):
        for j in range(i):
            both = len(a & sets[j])
            if both and 100 * both >= 75 * len(a | sets[j]):
                parent[max(root(i), root(j))] = min(root(i), root(j))
    least = {}
    for i, d in enumerate(ids):
        least[root(i)] = min(least.get(root(i), d), d)
    return [(d, len(sets[i]), least[root(i)]) for i, d in enumerate(ids)]


def near_copies(seed, n=260):
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(60)]
    base = [[rng.choice(words) for _ in range(rng.choice((3, 5, 12, 40, 80)))] for _ in range(12)]
    texts = []
    for _ in range(n):
        text = list(rng.choice(base))
        for _ in range(rng.choice((0, 0, 1, 1, 2, 4, 7))):
            at = rng.randrange(len(text) + 1)
            text[at : at + rng.choice((0, 1))] = [rng.choice(words)]
        texts.append(" ".join(text) + rng.choice(("", "\n", " ")))
    return texts + [None, "", " \t", "one", "ONE", "a b c d", "A b c d"]


@pytest.mark.parametrize("seed", [1, 2])
def test_similar_documents(spark, seed, monkeypatch):
    texts = near_copies(seed)
    ids = random.Random(seed).sample(range(10_000), len(texts))
    monkeypatch.setattr(jaccard_join, "SLICE", 4)
    monkeypatch.setattr(jaccard_join, "CROWD", 8)
    found = jaccard_join.op6(documents(spark, texts, ids)).collect()
    assert sorted((r["doc_id"], r["n_shingles"], r["component_id"]) for r in found) == sorted(brute_components(texts, ids))


def test_links_that_clustering_misses(spark, monkeypatch):
    """Without any clustering, the token-group matrix alone finds every link."""
    texts = near_copies(5, 150)
    monkeypatch.setattr(jaccard_join, "FIRSTS", 0)
    found = jaccard_join.op6(documents(spark, texts)).collect()
    assert sorted((r["doc_id"], r["n_shingles"], r["component_id"]) for r in found) == sorted(brute_components(texts, range(len(texts))))


def test_repeated_and_null_ids(spark):
    text = " ".join(f"w{i}" for i in range(30))
    rows = jaccard_join.op6(documents(spark, [text, text, text + " x", "other words entirely here now ok", text], [7, 7, None, None, 9])).collect()
    assert sorted((str(r["doc_id"]), str(r["component_id"])) for r in rows) == [("7", "7"), ("7", "7"), ("9", "7"), ("None", "7"), ("None", "None")]


def shared_by_brute_force(sets):
    """sets: (id, label, tokens) of distinct ids."""
    return {i: sum(any(t in other and label != theirs for _, theirs, other in sets) for t in own) for i, label, own in sets}


@pytest.mark.parametrize("seed", range(4))
@pytest.mark.parametrize("labels", [1, 3, 1000])
def test_shared_counts(seed, labels):
    """Packs that hold some classes again, common tokens, bundles of one label, and many buckets."""
    rng = random.Random(seed)
    universe = [rng.randrange(1 << 64) for _ in range(120)] + [0, 1, (1 << 64) - 1]
    sets = [(rng.randrange(-(1 << 62), 1 << 62), k % labels if labels < 1000 else k, set(rng.choices(universe[: rng.choice((5, 40, 123))], k=rng.choice((1, 10, 60))))) for k in range(40)]
    buckets, parts, rows, out = rng.choice((1, 7)), 3, {}, {}
    for number in range(6):
        own = sets[number * 6 : number * 6 + 10] + rng.sample(sets[:6], 2)
        own = list({s[0]: s for s in own}.values())
        for row in jaccard_join._pack([np.array(sorted(t), dtype=np.uint64) for _, _, t in own], [i for i, _, _ in own], [x for _, x, _ in own], buckets):
            rows.setdefault(row[0], []).append(row)
    for own in rows.values():
        found = jaccard_join._sharer(parts)(pa.Table.from_batches([jaccard_join._batch_of(own, ["bucket", "kind", "ids", "runs", "labels", "tokens"])]))
        for row in found.to_pylist():
            out.setdefault(row["part"], []).append(row)
    total = {}
    for own in out.values():
        for row in jaccard_join._totals(pa.Table.from_pylist(own)).to_pylist():
            was = total.get(row["cid"], (0, 0))
            total[row["cid"]] = was[0] + row["shared"], was[1] + row["packs"]
    assert {i: s / p for i, (s, p) in total.items() if p} == shared_by_brute_force(sets)


def test_a_common_token_is_one_entry_of_a_pack():
    common = np.arange(50, dtype=np.uint64)
    rows = list(jaccard_join._pack([np.append(common, np.uint64(1000 + k)) for k in range(300)], list(range(300)), list(range(300)), 1))
    entries = [r for r in rows if r[1] == jaccard_join.ENTRIES]
    assert sum(len(r[5]) // 4 for r in entries) == 50 + 300


def test_classes_that_share_a_number(spark):
    rows = table(spark, [(1, 0, 3, 7, 1), (2, 0, 3, 7, 2), (3, 0, 3, 7, 1), (4, 0, 3, 8, 5), (5, 0, 0, 9, 1), (6, 0, 0, 9, 2)], "doc_id long, copy long, n long, cid long, check long")
    renamed = jaccard_join._renamed(rows, [])
    assert renamed == {(7, 2): 7 ^ 3}
    assert {r["doc_id"]: r["cid"] for r in jaccard_join._in_classes(rows, renamed).collect()} == {1: 7, 2: 4, 3: 7, 4: 8, 5: 9, 6: 9}
    tokens = np.array([1, 2], dtype=np.uint64)
    number, check = jaccard_join.class_and_check(tokens)
    assert jaccard_join.class_of(tokens, {}) == number and jaccard_join.class_of(tokens, {(number, check): 5}) == 5


def test_one_of_each_decides_by_row(spark):
    copied, lone, other = (" ".join(f"{c}{k}" for k in range(40)) for c in "xyz")
    rows = [(1, copied, "en", "a", 0), (2, copied, "en", "a", 0), (2, lone, "en", "a", 0), (3, lone + " end", "en", "a", 0), (3, lone + " end", "en", "b", 0), (None, other, "en", "a", 0), (None, other, "en", "a", 0), (None, other + " end", "en", "a", 0), (None, None, "en", "a", 0), (None, None, "en", "a", 0), (4, "alone", "en", "a", 0)]
    found = jaccard_join.keep_one_of_each(table(spark, rows)).collect()
    assert [r["text"] for r in found].count(None) == 2 and (4, "alone") in [(r["doc_id"], r["text"]) for r in found]
    assert {(r["doc_id"], r["text"]) for r in found if r["doc_id"] in (1, 2, 3)} == {(1, copied), (2, lone)}
    assert len(found) == 6 and sum((r["text"] or "").startswith("z") for r in found) == 1


# ---- 7 WARC ----


def test_archives(spark, tmp_path):
    body, small = "x" * 1000, "y" * 999
    rows = [(1, "http://a\r\nb", body), (2, None, body), (3, "u", small), (4, "u", small), (5, "u", None), (6, "u", "é" * 600), (None, "u", body), (9, "u", "z" * 2000), (9, "v", "z" * 2000), (8, "v", "z" * 2000)]
    pages = table(spark, rows, "page_id long, url string, html string")
    folder = f"file://{tmp_path}/w"
    manifest = warc.write_archives(pages, folder, archive_bytes=1500)
    found = sorted(((r["page_id"], r["payload_bytes"], r["record_type"], r["refers_to"]) for r in warc.read_archives(manifest, folder).collect()), key=repr)
    expected = [(1, 1000, "revisit", 2), (2, 1000, "response", None), (3, 999, "response", None), (4, 999, "response", None), (5, 0, "response", None), (6, 1200, "response", None), (None, 1000, "revisit", 2), (9, 2000, "response", None), (9, 2000, "response", None), (8, 2000, "revisit", 9)]
    assert found == sorted(expected, key=repr)
    names = os.listdir(tmp_path / "w")
    assert not [n for n in names if n.startswith("_")] and sum(n.endswith(".idx") for n in names) == manifest.count() > 1


def test_normalised_members(tmp_path):
    store = warc.Store(str(tmp_path))
    raws = [warc.record(k, "u", b"\r\n\r\n" * k, hashlib.sha1(b"\r\n\r\n" * k).digest(), None) for k in range(5)]
    deflate = zlib.compressobj(6, zlib.DEFLATED, 31)
    (tmp_path / "whole").write_bytes(b"".join(map(deflate.compress, raws)) + deflate.flush())
    assert warc.normalise(store, "whole", "out") == 5
    import gzip

    assert gzip.decompress((tmp_path / "out").read_bytes()) == b"".join(raws)
    cut = (tmp_path / "whole").read_bytes()[:-40]
    (tmp_path / "cut").write_bytes(cut)
    with pytest.raises(ValueError, match="within a record"):
        warc.normalise(store, "cut", "out2")


# ---- 8 Benchmark ----


def test_fm_index_against_search():
    rng = random.Random(1)
    for _ in range(60):
        text = []
        for _ in range(rng.randrange(1, 8)):
            text += [rng.randrange(1, 5) for _ in range(rng.randrange(1, 30))] + [0]
        index = FMIndex(np.array(text), 5, sample=rng.choice((1, 3, 16)))
        for n in (1, 2, 4):
            patterns = np.array([[rng.randrange(1, 5) for _ in range(n)] for _ in range(20)])
            which, low, high = index.search(patterns)
            found = {int(w): sorted(index.locate(np.arange(a, b)).tolist()) for w, a, b in zip(which, low, high, strict=True)}
            for k, p in enumerate(patterns.tolist()):
                assert found.get(k, []) == [i for i in range(len(text) - n + 1) if text[i : i + n] == p]


def test_leaks(spark):
    item = "Alpha beta gamma delta epsilon zeta eta theta iota kappa lambda"
    words = item.split()
    docs = documents(spark, [f"Before, {item.upper()}! After.", " ".join(words[:9]), None, "", "x tiny-item y", " ".join(words[1:] + words), "clean words only"])
    items = table(spark, [(2, item), (10, item), (3, "tiny item"), (4, None), (5, "--"), (None, "after")], "item_id long, text string")
    found = by_id(decontamination.op8(docs, items))
    assert [found[i]["n_hit"] for i in range(7)] == [12, 0, 0, 0, 2, 21, 0]
    assert [found[i]["n_words"] for i in (0, 2, 5)] == [13, 0, 21]
    assert found[0]["items_sha256"] == hashlib.sha256(b",10,2").hexdigest() and found[0]["n_items"] == 3
    blocks = decontamination.find_leaks(docs.select("doc_id", "text"), items, keep=["doc_id"], block_bytes=20)
    one = decontamination.find_leaks(docs.select("doc_id", "text"), items, keep=["doc_id"])
    assert by_id(blocks) == by_id(one)
    cut = by_id(decontamination.remove_leaks(docs, items))
    assert cut[0]["text"] == "Before, ." and cut[4]["text"] == "x  y" and cut[6]["text"] == "clean words only" and 5 not in cut and cut[2]["text"] is None


# ---- 9 Search ----


def test_top_k_by_brute_force(spark, monkeypatch):
    rng = np.random.default_rng(2)
    vectors = [(i, [float(x) for x in rng.normal(size=8)]) for i in range(400)] + [(i, vectors_i) for i, vectors_i in ((400, None), (401, [None] * 8), (402, [float("nan")] * 8), (403, [float("inf")] + [0.0] * 7), (404, []), (450, [1.0, 2.0]), (451, [2.0, 2.0]), (None, [1.0] * 8))]
    vectors += [(500 + i, [0.5] * 8) for i in range(60)] + [(700, [0.5] * 8), (700, [0.5] * 8)]
    monkeypatch.setattr(topk_search, "SHARD_BYTES", 97 * 8 * 40)
    monkeypatch.setattr(topk_search, "QUERY_ROWS", 3)
    found = topk_search.op9(table(spark, vectors, "vec_id long, embedding array<double>")).collect()
    good = [(i, [math.floor(256 * v) for v in x]) for i, x in vectors if i is not None and x and all(v is not None and math.isfinite(v) for v in x)]
    expected = set()
    for q, x in good:
        if q % 50 == 0:
            scores = sorted(((-sum(map(int.__mul__, x, y)), i) for i, y in good if i != q and len(y) == len(x)))[:5]
            expected |= {(q, k, i, -s) for k, (s, i) in enumerate(scores, 1)}
    assert {(r["query_id"], r["rank"], r["vec_id"], r["score"]) for r in found} >= {e for e in expected if e[0] != 700}
    assert {r["query_id"] for r in found} == {e[0] for e in expected}


def test_scores_beyond_floats():
    big = np.array([1e12, 3.0])
    assert topk_search.exact_scores(big, np.array([[1e12, 1.0], [1e6, 1.0]])).tolist() == [(1 << 63) - 1, 10**18 + 3]


# ---- 10 Mixing ----


def water(sizes):
    weights = [1 + k % 3 for k in range(len(sizes))]
    capped, total = set(), sum(sizes)
    while True:
        rest = total - sum(3 * sizes[k] for k in capped)
        free = sum(w for k, w in enumerate(weights) if k not in capped)
        targets = [3.0 * s if k in capped else rest * weights[k] / free for k, s in enumerate(sizes)]
        over = {k for k, s in enumerate(sizes) if k not in capped and targets[k] > 3 * s}
        if not over:
            return targets
        capped |= over


def test_mixing(spark):
    rng = random.Random(4)
    rows = [(i, " ".join(["w"] * rng.choice((0, 1, 5, 30, 200))), "en", None if i % 50 == 0 else rng.choice("aaaaabcdZ"), 0) for i in range(1500)]
    rows += [(1, "x y", "en", "a", 0), (1, "x y", "en", "a", 0), (None, "x", "en", "b", 0), (3000, None, "en", "empty", 0)]
    found = mixing.op10(table(spark, rows)).collect()
    assert len(found) == len(rows) and all(r["taken"] <= 3 * r["size"] and (r["size"] == 0 or r["taken"] % r["size"] == 0) for r in found)
    order = sorted({r[3] for r in rows}, key=lambda s: (s is None, s or ""))
    sizes = [sum(len((t or "").split()) for _, t, _, s, _ in rows if s == source) for source in order]
    for source, size, target in zip(order, sizes, water(sizes), strict=True):
        own = [r for r in found if r["source"] == source]
        assert {r["source_size"] for r in own} == {size} and all(math.isclose(r["target"], target, abs_tol=1e-6) for r in own)
        assert abs(sum(r["taken"] for r in own) - target) <= 30
    again = mixing.op10(table(spark, rows[::-1]).repartition(7)).collect()
    assert sorted(map(str, again)) == sorted(map(str, found))


@pytest.mark.parametrize("seed", range(3))
def test_mixing_goes_on_past_a_long_document(spark, seed):
    rng = random.Random(seed)
    sizes = [(i, 0, source, rng.randint(1, 40)) for source in "abc" for i in range(60)] + [(60, 0, source, 3000) for source in "abc"]
    found = mixing.mix(table(spark, sizes, "doc_id long, copy long, source string, size long"), blocks=12, seed=seed).collect()
    assert {(r["doc_id"], r["source"]) for r in found} == {(i, source) for i, _, source, _ in sizes}
    for source in "abc":
        own = [r for r in found if r["source"] == source]
        epochs = {i: sum(r["doc_id"] == i and r["epoch"] is not None for r in own) for i in range(61)}
        taken, target = sum(r["size"] for r in own if r["epoch"] is not None), own[0]["target"]
        spare = [size for i, _, s, size in sizes if s == source and epochs[i] == min(epochs.values())]
        assert max(epochs.values()) - min(epochs.values()) <= 1 and max(epochs.values()) <= 3
        assert taken <= target + 1e-6 and all(size > target - taken for size in spare)


def test_quotas_are_exact_and_even(spark):
    blocks = table(spark, [(f"s{k % 3}" if k % 7 else None, 1, k) for k in range(500)], "source string, epoch int, block long")
    rows = mixing.split_quotas(blocks, 16).collect()
    shards, sources = {}, {}
    for r in rows:
        shards[r["shard"]] = shards.get(r["shard"], 0) + r["quota"]
        sources[r["source"]] = sources.get(r["source"], 0) + r["quota"]
    assert sum(shards.values()) == 500 and set(shards) == set(range(16)) and max(shards.values()) - min(shards.values()) <= 4
    assert sources == {r["source"]: r["count"] for r in blocks.groupBy("source").count().collect()}


# ---- Columns of other tables ----


def test_clashing_columns(spark):
    names = ["_id", "_row", "n_lines", "n_words", "spans", "items", "quality_score", "shard", "slot", "region", "_tree", "h1", "keeper", "label", "cid", "n", "component_id", "tokens"]
    docs = documents(spark, ["a common line of text", "a common line of text\nb", None], [1, 2, None]).withColumns({c: F.lit("mine") for c in names})
    items = table(spark, [(1, "common line")], "item_id long, text string")
    assert by_id(line_dedup.dedup_lines(docs))[2]["text"] == "b"
    assert by_id(decontamination.remove_leaks(docs, items))[1]["text"] == "a  of text"
    weights = np.zeros((1 << quality.BITS) + 1)
    assert {r["quality_score"] for r in quality.score(docs, weights).collect()} == {0.5}
    assert jaccard_join.keep_one_of_each(docs).count() == 3 and jaccard_join.similar_documents(docs).count() == 3
    rows = sharding.number_rows(sharding.shard_documents(docs), "shard", [F.col("doc_id")]).collect()
    assert len(rows) == 3 and all(isinstance(r["shard"], int) and r["keeper"] == "mine" for r in rows)
    assert len(mixing.op10(docs).collect()) == 3
