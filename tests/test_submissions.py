"""Faults of single operators that the queries do not meet, on small tables."""

import base64
import random

import pytest
from pyspark.sql import functions as F

from folium.functions import spans as S
from folium.functions import text as X
from folium.operators import ledger, mutation, quality, regions, submissions, validation, views
from folium.operators import spans as O
from folium.sources import files
from folium.sources.html_blocks import inline_text, tree
from folium.sources.tex_blocks import unwrap
from folium.streaming import ingest


def test_intervals_by_brute_force(spark):
    rng = random.Random(1)
    make = lambda n: [(rng.randrange(3), k, s, s + rng.choice((0, 1, 3, 40, 3000))) for k, s in enumerate(rng.choices(range(4000), k=n))]
    a, b = make(120), make(120)
    left = spark.createDataFrame(a, "user long, i long, a_start long, a_end long")
    right = spark.createDataFrame(b, "user long, j long, b_start long, b_end long")
    pairs = sorted((i, j) for u, i, s, e in a for v, j, t, f in b if u == v and s < f and e > t)
    inner = spark.createDataFrame(a, "doc_id long, i long, start long, end long")
    outer = spark.createDataFrame(b, "doc_id long, j long, start long, end long")
    held = sorted((i, j) for u, i, s, e in a for v, j, t, f in b if u == v and t <= s and e <= f)
    for width in (1, 64, 512):
        assert sorted((r["i"], r["j"]) for r in O.overlapping(left, right, "user", width).collect()) == pairs
        assert sorted((r["i"], r["outer_j"]) for r in O.contained(inner, outer, width=width).collect()) == held


def test_numbers_by_ranges(spark):
    rng = random.Random(2)
    rows = [(rng.choice("ab") if k % 9 else None, k) for k in rng.sample(range(-500, 500), 300)]
    for width in (1, 7, 1 << 16):
        found = {(r["source"], r["doc_id"]): r["ord"] for r in ledger.numbered(spark.createDataFrame(rows, "source string, doc_id long"), "source", "doc_id", width).collect()}
        for source in (None, "a", "b"):
            own = sorted(k for s, k in rows if s == source)
            assert [found[source, k] for k in own] == list(range(1, len(own) + 1))


def test_one_submission_for_each_block(spark):
    blocks = spark.createDataFrame([(1, "b1", "old", ["x"], False, "h"), (1, "b2", None, [], False, None)], "doc_id long, block_id string, target string, history array<string>, user_edited boolean, reviewed_hash string")
    submitted = spark.createDataFrame([(1, "b1", "late", 2), (1, "b1", "soon", 1), (1, "b2", "a", 1), (1, "b2", "a", 1)], "doc_id long, block_id string, target string, seq int")
    found = {r["block_id"]: r for r in mutation.translate(blocks, submitted).collect()}
    assert len(found) == 2 and found["b1"]["target"] == "late" and found["b1"]["history"] == ["x", "old"] and found["b2"]["target"] == "a"
    assert [r["block_id"] for r in mutation.repeated_submissions(submitted).orderBy("block_id").collect()] == ["b1", "b2"]


def test_equal_files_are_imported_once(spark):
    table = spark.createDataFrame([("b.txt", bytearray(b"x\n\ny")), ("a.txt", bytearray(b"x\n\ny")), ("a.txt", bytearray(b"x\n\ny")), ("c.md", bytearray(b"z"))], "path string, content binary")
    rows = files.fragments_of(files.import_rows(table))
    assert sorted((r["path"], r["text"]) for r in rows.collect()) == [("a.txt", "x"), ("a.txt", "y"), ("c.md", "z")]
    check = ledger.partition_check(rows.select("doc_id", "atom_id"), rows.select("doc_id", F.array("atom_id").alias("source_ids")))
    assert all(r["ok"] for r in check.collect())


def test_a_stream_imports_each_content_once(spark, tmp_path):
    out = str(tmp_path / "out")
    for number, (name, text) in enumerate((("a.txt", "one"), ("b.txt", "one"), ("c.txt", "two"))):
        (tmp_path / "in").mkdir(exist_ok=True)
        (tmp_path / "in" / name).write_text(text)
        ingest.import_stream(spark, str(tmp_path / "in"), out, str(tmp_path / "at")).awaitTermination()
        assert spark.read.parquet(out).count() == (1, 1, 2)[number]
    assert sorted(r["text"] for r in spark.read.parquet(out).collect()) == ["one", "two"]


def test_rollup_keeps_five_samples(spark):
    rows = [(1, f"{k:03d}: missing translation") for k in range(40)] + [(1, "Structure not reviewed")] * 2 + [(2, "x: second-pass review required")]
    found = {(r["doc_id"], r["kind"]): (r["n"], r["samples"]) for r in quality.rollup(spark.createDataFrame(rows, "doc_id long, message string"), "doc_id").collect()}
    assert found == {(1, "missing translation"): (40, "000,001,002,003,004"), (1, "Structure not reviewed"): (2, ""), (2, "second-pass review required"): (1, "x")}


def test_gates_of_tables_and_pairs(spark):
    schema = "doc_id long, block_id string, kind string, text string, target string, structure_note string, difference_explanation string, duplicate_explanation string, reviewed_hash string, target_hash string, n_same long"
    rows = [(1, "t", "table", "a | b\nc | d", "one line", "n", None, None, "h", "h", 1), (1, "p", "paragraph", "two\nlines", "one line", "n", None, None, "h", "h", 1), (1, "q", "table", "a\nb", "one", "n", None, None, "h", "h", 1)]
    assert [(r["block_id"], r["code"]) for r in quality.gates(spark.createDataFrame(rows, schema)).collect()] == [("t", "rows")]


def test_whole_errors_and_warnings(spark):
    docs = spark.createDataFrame([(1, True, True, 0, "f", "f", "y", "y")], "doc_id long, structure_reviewed boolean, terms_reviewed boolean, n_terms long, review_fingerprint string, fingerprint string, stored_hash string, source_hash string")
    atoms = spark.createDataFrame([(1, "a1")], "doc_id long, atom_id string")
    block = "doc_id long, block_id string, kind string, text string, source_ids array<string>, target string, structure_note string, difference_explanation string, duplicate_explanation string, reviewed_hash string, target_hash string, source_spans array<struct<s:int,e:int>>, target_spans array<struct<s:int,e:int>>"
    issues = spark.createDataFrame([(1, "tex-env-1", "a b", validation.BATCH, 1), (1, "tex-env-2", "a b", validation.BATCH, 2)], "doc_id long, issue_id string, resolution string, resolved_by string, ord long")
    notes = spark.createDataFrame([(1, "n1", "b1", "target", 0, 3, "one"), (1, "n2", "gone", "source", 0, 1, "x")], "doc_id long, note_id string, block_id string, side string, start int, end int, quote string")
    whole = spark.createDataFrame([(1, "b1", "paragraph", "ein", ["a1"], "one", "n", None, None, "h", "h", [(0, 3)], [(0, 3)])], block)
    found = validation.verdict(docs, atoms, whole, issues, notes).first()
    assert (found["ok"], found["n_errors"], found["n_warnings"]) == (True, 0, 3)
    loose = whole.withColumn("target_spans", F.array(F.struct(F.lit(0).alias("s"), F.lit(2).alias("e"))))
    assert [r["message"] for r in validation.errors(docs, atoms, loose, issues).collect()] == ["b1: target alignment must cover all non-whitespace exactly once"]
    rolled = validation.limitation_rollup(issues)
    assert rolled.first()["warning"] == validation.LIMITATION + "tex-env x2; samples: tex-env-1, tex-env-2; a b"
    assert validation.warning_rollup(validation.warnings(whole, issues, notes), rolled).count() == 2


def test_edits_move_later_spans(spark):
    blocks = spark.createDataFrame([(1, "b", "ab cd ef", [(0, 2), (3, 5), (6, 8)], [], False, "h")], "doc_id long, block_id string, target string, target_spans array<struct<s:int,e:int>>, history array<string>, user_edited boolean, reviewed_hash string")
    edits = spark.createDataFrame([(1, "b", 1, "xyz!")], "doc_id long, block_id string, at int, new_text string")
    row = submissions.edit_translations(blocks, edits)[0].first()
    assert row["target"] == "ab xyz! ef" and [tuple(s) for s in row["target_spans"]] == [(0, 2), (3, 7), (8, 10)] and row["user_edited"] and row["reviewed_hash"] is None
    for at, text, error in ((3, "x", "Invalid target span"), (-1, "x", "Invalid target span"), (0, " ", "Translation cannot be empty")):
        out, refused = submissions.edit_translations(blocks, spark.createDataFrame([(1, "b", at, text)], edits.schema))
        assert refused.first()["error"] == error and out.first()["target"] == "ab cd ef"


def test_exports_are_checked(spark, tmp_path):
    docs = spark.createDataFrame([(1, "a <b>"), (2, "c"), (3, "d")], "doc_id long, title string")
    blocks = spark.createDataFrame([(k, 1, "b1", "paragraph", "x < y") for k in (1, 2, 3)], "doc_id long, ord int, block_id string, kind string, text string")
    assets = spark.createDataFrame([(1, "p.png", bytearray(b"\x00\x01"))], "doc_id long, asset string, content binary")
    shots = views.snapshots_with_assets(views.snapshots(docs, blocks), assets)
    pages = shots.withColumn("page", views.as_page(F.lit("t"), F.col("snapshot")))
    pages = pages.withColumn("page", F.when(F.col("doc_id") == 3, F.concat("page", F.lit("<link href='x.css'>"))).otherwise(F.col("page")))
    out, refused = views.export(spark, pages, spark.createDataFrame([(2, "open")], "doc_id long, message string"), str(tmp_path / "out"))
    assert [r["doc_id"] for r in out.collect()] == [1] and "data:image/png;base64," + base64.b64encode(b"\x00\x01").decode() in out.first()["page"]
    assert {r["doc_id"]: r["error"] for r in refused.collect()} == {2: "Complete translation and review before export", 3: "Export integrity check failed: refers to something outside"}


@pytest.mark.parametrize(("group", "found"), [("ab", [("ab", None, None)]), ({"text": "a", "occurrence": 2}, [("a", 2, None)]), (["a", {"text": "b", "anchor": "ab"}], [("a", None, None), ("b", None, "ab")])])
def test_fragments_of_a_group(group, found):
    assert S.fragments_of(group) == found


@pytest.mark.parametrize("group", [None, [], [""], {"text": 3}, 7, {"text": "a", "anchor": ""}, {"text": "a", "anchor": "b"}])
def test_odd_groups(group):
    with pytest.raises(S.FragmentError):
        S.fragments_of(group)


@pytest.mark.parametrize(("tex", "plain"), [("\\textbf{a \\emph{b}} c", "a b c"), ("\\emph word\\quad x", "wordx"), ("\\textbf{a {b} c}", "\\textbf{a {b} c}"), ("\\emph \\textit{x}", "x"), ("\\quadrant \\textbfx{a}", "\\quadrant \\textbfx{a}"), ("\\textbf{open", "\\textbf{open"), ("a} \\textit{b}", "a} b"), ("\\mathrm {x}y", "xy")])
def test_styles_are_unwrapped(tex, plain):
    assert unwrap(tex) == plain


@pytest.mark.parametrize(("html", "text"), [("a<p>b</p>c", "a\nb\nc"), ("a <div>b</div>", "a b"), ("<p>a</p><p>b</p>", "a\nb"), ("x<br>y", "x\ny"), ("a<math></math><p>b</p>", "ab\n"), ("m<sup>2</sup>", "m²"), ("<ul><li>a<li>b</ul>", "a\nb")])
def test_inline_text_of_blocks(html, text):
    found = inline_text(tree(f"<div>{html}</div>").children[0])
    assert found.rstrip("\n") == text.rstrip("\n")


def test_text_predicates(spark):
    rows = spark.createDataFrame([("Figure 3: a",), ("Fig 3",), ("† note",), ("$a$ $$b$$",), ("$a$ b",), (" ",), (None,)], "t string")
    found = rows.select(X.is_caption(F.col("t")).alias("c"), X.starts_footnote(F.col("t")).alias("f"), X.is_math_only(F.col("t")).alias("m")).collect()
    assert [r["c"] for r in found] == [True, False, False, False, False, False, False] and [r["f"] for r in found] == [False, False, True, False, False, False, False]
    assert [r["m"] for r in found] == [False, False, False, True, False, False, False]


def test_images_that_may_not_be_copied(spark):
    images = spark.createDataFrame([(1, f"b{k}", "in/d", t) for k, t in enumerate(("a.png", "x/../a.png", "../d/a.png", "../a.png", "//e/a.png", "data:x", "/in/d/a.png", "a.svg", "b.png"))], "doc_id long, block_id string, folder string, target string")
    there = spark.createDataFrame([("in/d/a.png",), ("in/a.png",), ("in/d/a.svg",)], "path string")
    found = {r["block_id"]: r["asset"] for r in regions.local_images(images, there).collect()}
    assert [found[f"b{k}"] is not None for k in range(9)] == [True, True, True, False, False, False, False, False, False]


def test_faults_of_a_batch_by_the_plain_check():
    import re

    import numpy as np
    import pyarrow as pa

    from folium.functions import codepoints as C

    rng = random.Random(5)
    texts = ["".join(rng.choices("ab  　é𝄞\n", k=rng.choice((0, 1, 5, 12)))) for _ in range(400)] + [None, "  ", "x"]
    for low, high, offsets, solid in C.slabs(pa.array(texts)):
        own = [t or "" for t in texts[low:high]]
        starts, ends, counts = C.words(offsets, solid)
        assert list(zip(starts.tolist(), ends.tolist(), strict=True)) == [m.span() for t in own for m in re.finditer(r"\S+", t)]
        given = []
        for t, n in zip(own, counts.tolist(), strict=True):
            spans = [m.span() for m in re.finditer(r"\S+", t)]
            for _ in range(rng.choice((0, 0, 1))):
                spans = [(s + rng.choice((0, 0, -1, 1)), e + rng.choice((0, 0, 1))) for s, e in spans]
            spans += [(s, s + 1) for s, _ in spans[:1] if rng.random() < 0.3]
            given.append(rng.sample(spans, len(spans) - (rng.random() < 0.2 and len(spans) > 0)))
        row = np.repeat(np.arange(len(own)), [len(g) for g in given])
        flat = np.array([x for g in given for x in g], dtype=np.int64).reshape(-1, 2)
        found = C.FAULTS[C.first_faults(offsets, solid, row, flat[:, 0], flat[:, 1])].tolist()
        assert found == [S.first_fault(t, g) for t, g in zip(own, given, strict=True)]
        assert len(set(found)) == 4
