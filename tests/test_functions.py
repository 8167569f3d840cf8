"""Truth tables of the text, span and reader functions."""

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from folium.functions import reading
from folium.functions import spans as S
from folium.functions import text as X


def column(spark, expression, rows, schema):
    return [r[0] for r in spark.createDataFrame(rows, schema).select(expression).collect()]


def test_term_matches(spark):
    table = [
        ("A feed-forward network follows attention.", "feed-forward network / FFN", True),
        ("The FFN is applied twice.", "feed-forward network / FFN", True),
        ("A feed–forward network.", "feed-forward network / FFN", True),
        ("ＦＦＮ is the abbreviation.", "feed-forward network / FFN", True),
        ("The FFNN differs.", "feed-forward network / FFN", False),
        ("A forward network alone.", "feed-forward network / FFN", False),
        ("Compute the signal/noise ratio.", "signal/noise ratio", True),
        ("Noise ratio alone.", "signal/noise ratio", False),
        ("Use input/output.", "input/output", True),
        ("Use output.", "input/output", False),
        ("Choose a key.", "query / key / value", True),
        ("Any paragraph.", " / ", False),
    ]
    rows = spark.createDataFrame([r[:2] for r in table], "t string, n string").select(X.nfkc("t").alias("t"), "n")
    assert [r[0] for r in rows.select(X.term_matches(F.col("t"), F.col("n"))).collect()] == [r[2] for r in table]


def test_numbers_are_unicode_aware(spark):
    found = column(spark, F.array_join(X.multiset(F.col("t"), X.NUMBERS), ","), [("−5 kW, 1,200.5 and é5 x7 3e-4",), (None,)], "t string")
    assert found == ["1,200.5,3e-4,−5", ""]


def test_differences(spark):
    rows = [("5 kW", "5 千瓦"), ("5 kW", "6 kW"), ("see [1, 2] $x$", "[1, 2] $x$"), ("a", None)]
    assert column(spark, X.differences(F.col("a"), F.col("b")), rows, "a string, b string") == [["units"], ["numbers"], [], []]


def test_lines(spark):
    rows = [("1. Introduction",), ("Abstract",), ("Figure 3: A plot",), ("Ends here.",), ("by Smith et al.",), ("by J.",), ("∗ note",), ("| a | b |",), ("$$x=1$$",)]
    assert column(spark, X.line_kind(F.col("t")), rows, "t string") == ["heading", "heading", "caption", "paragraph", "paragraph", "paragraph", "footnote", "table", "formula"]
    assert column(spark, X.ends_sentence(F.col("t")), rows, "t string")[3:6] == [True, False, False]


def test_issue_prefix_and_explanations(spark):
    assert column(spark, X.issue_prefix(F.col("t")), [("tex-env-12",), ("image-b00003",), ("page",), ("docx-sym-a1",)], "t string") == ["tex-env", "image", "page", "docx-sym"]
    rows = [("ignore",), ("known limitation, n/a, skip it ok done",), ("the figure of the archive was compared by hand",), ("the sample figure was checked by hand",)]
    assert column(spark, F.coalesce(X.explanation_error(F.col("t"), evidence=True), F.lit("ok")), rows, "t string") == ["too short", "too weak", "no evidence", "ok"]
    assert column(spark, X.category_error(F.col("t")), [("tex-env",), ("page",), ("x",), (None,)], "t string") == [None, "only by id", "unknown", "missing"]


def test_formula_markup(spark):
    rows = [("MultiHead(Q,K,V) = Wᴼ",), (r"\frac{a}{b}",), ("$$ $$",), ("$$x=1",), ("$E=mc^2$",), ("$$\nx=1\n$$",)]
    assert column(spark, X.has_formula_markup(F.col("t")), rows, "t string") == [False] * 4 + [True] * 2


@pytest.mark.parametrize(
    ("text", "tokens"),
    [
        ("spend $30, $50, or even $100 to prepare", [("text", "spend $30, $50, or even $100 to prepare")]),
        (r"spend \$30, \$50", [("text", r"spend \$30, \$50")]),
        ("spend $30 then use $h(p)$.", [("text", "spend $30 then use "), ("inline", "h(p)"), ("text", ".")]),
        ("$$h(p)=1$$", [("display", "h(p)=1")]),
        ("$1+2$", [("inline", "1+2")]),
        (r"$a\$b$", [("inline", r"a\$b")]),
        ("$$\na=b\n$$", [("display", "\na=b\n")]),
        ("$n=$512", [("inline", "n="), ("text", "512")]),
        ("38²$=$1,444", [("text", "38²"), ("inline", "="), ("text", "1,444")]),
        (r"1$\rightarrow$2", [("text", "1"), ("inline", r"\rightarrow"), ("text", "2")]),
        ("$$ $$", [("text", "$$ $$")]),
    ],
)
def test_split_math(text, tokens):
    assert reading.split_math(text) == tokens


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet="$\\ a1,.\n", max_size=30))
def test_split_math_loses_nothing(text):
    signs = {"text": "", "inline": "$", "display": "$$"}
    assert "".join(signs[k] + v + signs[k] for k, v in reading.split_math(text)) == text


@pytest.mark.parametrize(
    ("text", "rows", "header"),
    [
        ("| Item | Value |\n| --- | ---: |\n| Alpha | 8 |", [["Item", "Value"], ["Alpha", "8"]], True),
        ("Item | Value\nAlpha | 8\nBeta | ", [["Item", "Value"], ["Alpha", "8"], ["Beta", ""]], False),
        ("Item\tValue\n\t8\nBeta\t", [["Item", "Value"], ["", "8"], ["Beta", ""]], False),
        ("A | B | C\nx || 8", [["A", "B", "C"], ["x", "", "8"]], False),
        ("😀 Item | Value\n模型 | 8", [["😀 Item", "Value"], ["模型", "8"]], False),
        ("E | V\n$a\\|b$ | 8", [["E", "V"], ["$a\\|b$", "8"]], False),
    ],
)
def test_tables_with_offsets(text, rows, header):
    found = reading.parse_table(text)
    assert found[0] is header
    assert [[c[0] for c in r] for r in found[1]] == rows
    assert all(text[a:b] == c for r in found[1] for c, a, b in r)


@pytest.mark.parametrize("text", ["Ordinary prose.", "A | B\nx | y | z", "A | B\nnot a row", ""])
def test_no_table(text):
    assert reading.parse_table(text) is None


def test_locating_fragments():
    used = []
    assert (S.locate("ab ab", "ab", used, 2), S.locate("ab ab", "ab", used, 1)) == ((3, 5), (0, 2))
    assert S.locate("ab ab", "ab", [], anchor=" ab") == (3, 5)
    for kwargs, message in (({"occurrence": 1}, "already used"), ({"occurrence": 3}, "not found"), ({"anchor": "x"}, "anchor must contain"), ({"occurrence": True}, "positive"), ({"occurrence": 0}, "positive")):
        with pytest.raises(S.FragmentError, match=message):
            S.locate("ab ab", "ab", [(0, 2)], **kwargs)


@settings(max_examples=150, deadline=None)
@given(st.text(alphabet="ab \n", max_size=12), st.lists(st.tuples(st.integers(0, 12), st.integers(0, 12)), max_size=4))
def test_cover_faults_against_a_naive_check(text, spans):
    ordered = sorted(spans)
    bad = any(s >= e or e > len(text) for s, e in ordered) or any(b[0] < a[1] for a, b in zip(ordered, ordered[1:], strict=False))
    held = {i for s, e in spans for i in range(s, e)}
    bare = any(not c.isspace() and i not in held for i, c in enumerate(text))
    assert (S.first_fault(text, spans) is None) == (not bad and not bare)


def test_cover_error_agrees_with_the_fast_check(spark):
    rows = [("ab cd", [(0, 2), (3, 5)]), ("ab cd", [(0, 2)]), ("ab cd", [(0, 3), (2, 5)]), ("ab", [(0, 3)]), ("", []), ("a b", [])]
    found = column(spark, S.cover_error(F.col("t"), F.col("s")), rows, "t string, s array<struct<s:int,e:int>>")
    assert found == [S.first_fault(t, s) for t, s in rows] == [None, "uncovered", "overlap", "out of range", None, "uncovered"]


def test_notes_and_edits(spark):
    assert column(spark, S.note_status(F.col("t"), F.lit(1), F.lit(2), F.lit("😀")), [("a😀b",), ("ab",), (None,)], "t string") == ["attached", "orphaned", "orphaned"]
    moved = column(spark, S.shift_spans(F.col("s"), F.lit(0), F.lit(2), F.lit(5)), [([(0, 2), (3, 4)],)], "s array<struct<s:int,e:int>>")
    assert [tuple(x) for x in moved[0]] == [(0, 5), (6, 7)]
