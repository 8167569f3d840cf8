"""Reader text: prose and mathematics, tables with code point offsets."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T

# An amount of money after a dollar sign, and what may follow it.
AMOUNT = r"(?:\d{1,3}(?:,\d{3})+|\d+)(?:\.\d+)?"
AFTER_AMOUNT = r"(?=[ \t\n\r .;:!?%)\]}'\"’”]|,(?:[ \t\n\r ]|\Z)|\Z)"

#: At a dollar sign, in this order: an escaped sign, a display formula, money, an inline formula.
_TOKEN = re.compile(
    r"(?P<escaped>\\\$)"
    r"|\$\$(?P<display>(?:\\\$|(?!\$\$)[\s\S])+?)\$\$"
    rf"|(?P<money>\${AMOUNT}{AFTER_AMOUNT})"
    r"|\$(?P<inline>(?![ \t\n\r $])(?:\\\$|[^$\n\r]|(?<=[ \t \\$])\$)*?(?:\\\$|[^$\n\r ]))(?<![ \t \\])\$"
)
_LEADING_AMOUNT = re.compile(rf"{AMOUNT}\s")


def split_math(text: str) -> list[tuple[str, str]]:
    """(type, value) tokens: text, inline, display. What is not certainly a formula stays text."""
    out: list[tuple[str, str]] = []
    held: list[str] = []

    def formula(kind: str, body: str) -> None:
        if before := "".join(held):
            out.append(("text", before))
        held.clear()
        out.append((kind, body))

    at = 0
    while at < len(text):
        mark = re.compile(r"\\\$|\$").search(text, at)
        if mark is None:
            held.append(text[at:])
            break
        held.append(text[at : mark.start()])
        found = _TOKEN.match(text, mark.start())
        if found and found.lastgroup == "display" and found["display"].strip():
            formula("display", found["display"])
        elif found and found.lastgroup == "inline" and found["inline"].strip() and not _LEADING_AMOUNT.match(found["inline"]):
            formula("inline", found["inline"])
        elif found and found.lastgroup in ("escaped", "money"):
            held.append(found[0])
        else:
            held.append(text[mark.start()])
            at = mark.start() + 1
            continue
        at = found.end()
    if "".join(held):
        out.append(("text", "".join(held)))
    return out


@F.pandas_udf(T.ArrayType(T.StructType([T.StructField("type", T.StringType()), T.StructField("value", T.StringType())])))
def math_tokens(text: pd.Series) -> pd.Series:
    return text.map(lambda t: [{"type": k, "value": v} for k, v in split_math(t or "")])


_RULE = re.compile(r":?-{3,}:?")


def _cells(line: str, offset: int, separator: str) -> list[tuple[str, int, int]]:
    """Cells of a line between separators that no odd run of backslashes escapes."""
    cuts = [m.end() - 1 for m in re.finditer(r"(?<!\\)(?:\\\\)*\|", line)] if separator == "|" else [m.start() for m in re.finditer("\t", line)]
    edges = [-1, *cuts, len(line)]
    found = []
    for left, right in zip(edges, edges[1:], strict=False):
        raw = line[left + 1 : right]
        text = raw.strip()
        begin = left + 1 + (len(raw) - len(raw.lstrip()) if text else len(raw))
        found.append((text, offset + begin, offset + begin + len(text)))
    if separator == "|" and cuts[0] == 0:
        found = found[1:]
        if cuts[-1] == len(line) - 1:
            found = found[:-1]
    return found


def _lines(text: str) -> Iterator[tuple[str, int]]:
    at = 0
    for line in text.split("\n"):
        bare = line.strip(" \r")
        if bare:
            yield bare, at + line.index(bare)
        at += len(line) + 1


def parse_table(text: str) -> tuple[bool, list[list[tuple[str, int, int]]]] | None:
    """(has a header row, rows of cells as text, start, end), or None where the text is not surely a table."""
    rows, kinds = [], set()
    for line, offset in _lines(text):
        kind = "|" if re.search(r"(?<!\\)(?:\\\\)*\|", line) else "\t"
        kinds.add(kind)
        if len(kinds) > 1 or kind not in line:
            return None
        rows.append(_cells(line, offset, kind))
    if len(rows) < 2 or len(rows[0]) < 2 or len({len(r) for r in rows}) > 1:
        return None
    # A border at the end of every row is one only if the second row is a rule without it.
    if rows[1][-1][0] == "" and all(_RULE.fullmatch(c[0]) for c in rows[1][:-1]) and all(r[-1][0] == "" for r in rows):
        rows = [r[:-1] for r in rows]
    header = all(_RULE.fullmatch(c[0]) for c in rows[1])
    return header, [r for i, r in enumerate(rows) if not (header and i == 1)]


_CELL = T.StructType([T.StructField("text", T.StringType()), T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType())])


@F.pandas_udf(T.StructType([T.StructField("header", T.BooleanType()), T.StructField("rows", T.ArrayType(T.ArrayType(_CELL)))]))
def table_cells(text: pd.Series) -> pd.DataFrame:
    headers, tables = [], []
    for t in text:
        found = parse_table(t or "")
        headers.append(found and found[0])
        tables.append(found and [[{"text": c, "start": a, "end": b} for c, a, b in row] for row in found[1]])
    return pd.DataFrame({"header": pd.Series(headers, dtype="object"), "rows": pd.Series(tables, dtype="object")})
