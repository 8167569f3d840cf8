"""Atoms of plain texts with code point offsets and line numbers, without a shuffle."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

ATOMS = "doc_id long, ord int, atom_id string, text string, start int, end int, line_start int, line_end int"
_BREAK = {"line": re.compile(r"\n"), "paragraph": re.compile(r"\n\s*\n")}


def fragments(text: str, unit: str = "paragraph") -> Iterator[tuple[str, int, int, int, int]]:
    """(text, start, end, first line, last line) of the paragraphs or lines that are not blank.

    A byte order mark is dropped, and only line ends are trimmed: other blanks belong to the atom.
    """
    text = text.removeprefix("﻿")
    at = line = 0
    edges = [(m.start(), m.end()) for m in _BREAK[unit].finditer(text)] + [(len(text), len(text))]
    begin = 0
    for stop, following in edges:
        raw = text[begin:stop]
        bare = raw.strip("\r\n")
        if bare.strip():
            start = begin + len(raw) - len(raw.lstrip("\r\n"))
            line += text.count("\n", at, start)
            last = line + bare.count("\n")
            yield bare, start, start + len(bare), line + 1, last + 1
            at, line = start + len(bare), last
        begin = following


def atoms(docs: DataFrame, unit: str = "line") -> DataFrame:
    """One row per atom of each document; docs has doc_id and text."""

    def generate(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for doc, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist(), strict=True):
                rows += [(doc, k, f"a{k:05d}", *found) for k, found in enumerate(fragments(text or "", unit), 1)]
            types = (pa.int64(), pa.int32(), pa.string(), pa.string(), pa.int32(), pa.int32(), pa.int32(), pa.int32())
            columns = list(zip(*rows, strict=True)) or [()] * len(types)
            names = ["doc_id", "ord", "atom_id", "text", "start", "end", "line_start", "line_end"]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names=names)

    return docs.select("doc_id", "text").mapInArrow(generate, ATOMS)
