"""Blocks of Markdown at the top level: headings, code, tables, formulas, paragraphs; other lines stay unclassified."""

from __future__ import annotations

import re

from folium.sources.fragments import Fragment, Import

_ATX, _SETEXT = re.compile(r" {0,3}#{1,6}(?:[ \t]|$)"), re.compile(r" {0,3}(?:=+|-+)[ \t]*$")
_FENCE = re.compile(r" {0,3}(`{3,}(?=[^`]*$)|~{3,})")
_RULE = re.compile(r" {0,3}(?:(?:\*[ \t]*){3,}|(?:-[ \t]*){3,}|(?:_[ \t]*){3,})$")
_ITEM = re.compile(r" {0,3}(?:[-+*]|\d{1,9}[.)])(?:[ \t]|$)")
_QUOTE, _DEFINITION = re.compile(r" {0,3}>"), re.compile(r" {0,3}\[[^\]]+\]:\s*\S")
_TABLE_RULE = re.compile(r" {0,3}\|?[ \t]*:?-+:?[ \t]*(?:\|[ \t]*:?-+:?[ \t]*)*\|?[ \t]*$")
_IMAGE = re.compile(r"!\[([^\]]*)\]\(([^)\s]+)\)")


def _starts_other(line: str) -> bool:
    return bool(_ATX.match(line) or _FENCE.match(line) or _RULE.match(line) or _QUOTE.match(line) or _ITEM.match(line))


def _cells(line: str) -> int:
    return len(re.findall(r"(?<!\\)\|", line.strip().strip("|"))) + 1


def _extent(lines: list[str], i: int) -> tuple[int, str]:
    """Line after the block that begins at line i, and its kind."""
    n, line = len(lines), lines[i]
    if fence := _FENCE.match(line):
        close = re.compile(rf" {{0,3}}{re.escape(fence[1][0])}{{{len(fence[1])},}}[ \t]*$")
        end = next((j for j in range(i + 1, n) if close.match(lines[j])), n - 1)
        return end + 1, "code"
    if _ATX.match(line):
        return i + 1, "heading"
    if _RULE.match(line):
        return i + 1, "unclassified" if not line.strip() else "paragraph"
    if line.startswith(("    ", "\t")):
        j = i
        while j < n and (lines[j].startswith(("    ", "\t")) or not lines[j].strip()):
            j += 1
        while not lines[j - 1].strip():
            j -= 1
        return j, "code"
    if _DEFINITION.match(line):
        return i + 1, "unclassified"
    if "|" in line and i + 1 < n and _TABLE_RULE.match(lines[i + 1]) and "-" in lines[i + 1] and _cells(line) == _cells(lines[i + 1]):
        j = i + 2
        while j < n and lines[j].strip() and not _starts_other(lines[j]):
            j += 1
        return j, "table"
    if _QUOTE.match(line) or _ITEM.match(line):
        j = i + 1
        while j < n and (lines[j].strip() and (not _starts_other(lines[j]) or _QUOTE.match(lines[j]) or _ITEM.match(lines[j])) or (not lines[j].strip() and j + 1 < n and (_ITEM.match(lines[j + 1]) or lines[j + 1].startswith("  ")) and _ITEM.match(line))):
            j += 1
        return j, "paragraph"
    j = i + 1
    while j < n and lines[j].strip():
        if _SETEXT.match(lines[j]):
            return j + 1, "heading"
        if _starts_other(lines[j]):
            break
        j += 1
    return j, "paragraph"


def read_markdown(source: str) -> Import:
    out = Import()
    kept = source.removeprefix("﻿").splitlines(keepends=True)
    lines = [line.rstrip("\r\n") for line in kept]
    offsets = [0]
    for line in kept:
        offsets.append(offsets[-1] + len(line))
    i = 0
    while i < len(lines):
        if not lines[i].strip():
            i += 1
            continue
        end, kind = _extent(lines, i)
        text = "".join(kept[i:end]).rstrip("\r\n")
        kind = "formula" if kind == "paragraph" and text.lstrip().startswith("$$") else kind
        if image := _IMAGE.fullmatch(text.strip()):
            kind = "figure"
            out.links.append((len(out.fragments) + 1, image[2]))
            if re.match(r"[a-zA-Z][a-zA-Z0-9+.-]*:|//", image[2]):
                out.issues.append((f"image-b{len(out.fragments) + 1:05d}", f"Image {image[2]} is not in the source folder"))
        out.fragments.append(Fragment(kind, text, offsets[i], offsets[end], i + 1, end))
        i = end
    return out
