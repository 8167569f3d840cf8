"""Drawings, formulas and tables that would grow."""

import random

import pytest

from folium.llm.html_text import WIDEST_TABLE, html_to_text


def test_drawings_show_their_texts():
    page = "<p>a<svg><title>no</title><g><text x=1>Label <tspan>one</tspan></text><defs><text>no</text></defs><text style='display:none'>no</text><text visibility=1>two</text></g><foreignObject><div>three</div></foreignObject></svg>b"
    assert html_to_text(page) == "a\nLabel one\ntwo\nthree\nb"
    assert html_to_text("<div style='visibility:hidden'><svg><text>no</text></svg></div>") == ""


def test_formulas_hide_their_annotations():
    assert html_to_text("<p>x <math><semantics><mi>y</mi><annotation>no</annotation><annotation-xml>no</annotation-xml></semantics></math> z") == "x y z"


def test_a_long_cell_does_not_widen_all_rows():
    page = "<table>" + "<tr><td>a<td>b" * 2000 + "<tr><td>" + "word " * 8000 + "<td>c</table>"
    text = html_to_text(page)
    assert len(text) < len(page) and text.split("\n")[0] == "a | b" and text.endswith("word | c")


@pytest.mark.parametrize("page", ["<table><tr><td colspan=1000 rowspan=65534>x" + "<tr><td>a" * 5000, "<table><tr>" + "<td>abc" * 3000 + ("<tr>" + "<td colspan=1000>" * 3 + "<td>x") * 1000, "<table>" + ("<tr>" + "<td>" + "y" * 119) * 2000 + "<tr>" + "<td>z" * 150])
def test_hostile_tables_stay_small(page):
    text = html_to_text(page)
    assert len(text) < 10 * len(page) and max(map(len, text.split("\n"))) <= max(len(page), 4 * WIDEST_TABLE)


@pytest.mark.parametrize("seed", range(5))
def test_tables_by_a_plain_renderer(seed):
    """Plain grids: each row is its cells, padded to the widest of the column, with bars between."""
    rng = random.Random(seed)
    columns = rng.randrange(1, 6)
    grid = [["w" * rng.randrange(1, 9) for _ in range(columns)] for _ in range(rng.randrange(1, 8))]
    widths = [max(len(row[c]) for row in grid) for c in range(columns)]
    page = "<table>" + "".join("<tr>" + "".join(f"<td>{x}" for x in row) for row in grid) + "</table>"
    assert html_to_text(page).split("\n") == [" | ".join(x.ljust(w) for x, w in zip(row, widths, strict=True)).rstrip() for row in grid]


def test_tables_within_tables_are_laid_out():
    assert html_to_text("<table><tr><td>" * 60 + "x<td>y").split() == ["x", "|", "y"]
