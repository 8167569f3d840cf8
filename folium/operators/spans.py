"""Operators over spans: tokens, occurrences, overlaps, greedy alignment."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from folium.functions import codepoints as C
from folium.functions import spans as S


def _per_text(rows: DataFrame, find, schema: str, names: list[str], types: list[pa.DataType]) -> DataFrame:
    """A generator over texts without a shuffle: find(text) gives tuples, each of which becomes a row with doc_id."""

    def generate(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = [(doc, *found) for doc, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist(), strict=True) for found in find(text or "")]
            columns = list(zip(*out, strict=True)) or [()] * (len(types) + 1)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, [pa.int64(), *types], strict=True)], names=["doc_id", *names])

    return rows.select("doc_id", "text").mapInArrow(generate, schema)


_SPANS = "array<struct<s:int,e:int>>"


def token_spans(docs: DataFrame) -> DataFrame:
    """doc_id, text, spans: the words of each text as one sorted array of spans."""

    def generate(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for low, high, offsets, solid in C.slabs(batch.column("text")):
                starts, ends, counts = C.words(offsets, solid)
                flat = pa.StructArray.from_arrays([pa.array(x, pa.int32()) for x in (starts, ends)], names=["s", "e"])
                spans = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(counts)]), pa.int32()), flat)
                yield pa.RecordBatch.from_arrays([batch.column(c).slice(low, high - low) for c in ("doc_id", "text")] + [spans], names=["doc_id", "text", "spans"])

    return docs.select("doc_id", "text").mapInArrow(generate, f"doc_id long, text string, spans {_SPANS}")


def cover_faults(spanned: DataFrame) -> DataFrame:
    """doc_id, spans, fault: cover_error of each text, by a few passes over all code points and spans of a slab."""

    def generate(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for low, high, offsets, solid in C.slabs(batch.column("text")):
                spans = batch.column("spans").slice(low, high - low)
                counts = pc.fill_null(pc.list_value_length(spans), 0).to_numpy(zero_copy_only=False)
                flat = spans.flatten()
                row = np.repeat(np.arange(high - low), counts)
                found = C.first_faults(offsets, solid, row, *(flat.field(c).to_numpy(zero_copy_only=False).astype(np.int64) for c in ("s", "e")))
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(low, high - low), spans, pa.array(C.FAULTS[found].tolist(), pa.string())], names=["doc_id", "spans", "fault"])

    return spanned.select("doc_id", "text", "spans").mapInArrow(generate, f"doc_id long, spans {_SPANS}, fault string")


def occurrences(docs: DataFrame, needle: str) -> DataFrame:
    """doc_id, n (from 1), start, end of all occurrences of a needle, overlapping ones too."""
    return _per_text(docs, lambda t: [(n, p, p + len(needle)) for n, p in enumerate(S.positions(t, needle), 1)], "doc_id long, n int, start int, end int", ["n", "start", "end"], [pa.int32()] * 3)


def _pieces(start: Column, end: Column, width: int) -> Column:
    """Numbers of the pieces of a text that an interval touches; an empty interval is in the piece of its place."""
    first = F.floor(start / width).cast("long")
    return F.sequence(first, F.greatest(first, F.floor((end - 1) / width).cast("long")))


def contained(inner: DataFrame, outer: DataFrame, key: str = "doc_id", width: int = 512) -> DataFrame:
    """inner rows joined with the outer rows (start, end renamed outer_*) that hold them, within a key.

    A text is cut into pieces of `width`; an inner row meets only what touches the piece that it begins in, so a very long
    text is many keys of a join, not one.
    """
    wide = outer.select(F.col(key), *[F.col(c).alias(f"outer_{c}") for c in outer.columns if c != key])
    wide = wide.withColumn("_piece", F.explode(_pieces(F.col("outer_start"), F.col("outer_end"), width)))
    both = inner.withColumn("_piece", F.floor(F.col("start") / width).cast("long")).join(wide, [key, "_piece"])
    return both.where((F.col("outer_start") <= F.col("start")) & (F.col("end") <= F.col("outer_end"))).drop("_piece")


def overlapping(a: DataFrame, b: DataFrame, key: str, width: int = 512) -> DataFrame:
    """Pairs of rows of a and b (a_start, a_end; b_start, b_end) that overlap, within a key; each pair meets in the piece where the overlap begins."""
    left = a.withColumn("_piece", F.explode(_pieces(F.col("a_start"), F.col("a_end"), width)))
    right = b.withColumn("_piece", F.explode(_pieces(F.col("b_start"), F.col("b_end"), width)))
    first = F.floor(F.greatest("a_start", "b_start") / width).cast("long")
    return left.join(right, [key, "_piece"]).where(S.overlaps(F.col("a_start"), F.col("a_end"), F.col("b_start"), F.col("b_end")) & (F.col("_piece") == first)).drop("_piece")


def violations(spans: DataFrame, key: str, limit: Column) -> DataFrame:
    """Spans (s, e, id) that are empty, out of [0, limit) or overlap an earlier one, with the fault."""
    before = F.max("e").over(Window.partitionBy(key).orderBy("s", "e", "id").rowsBetween(Window.unboundedPreceding, -1))
    fault = F.when((F.col("s") < 0) | (F.col("e") > limit) | (F.col("s") >= F.col("e")), "out of range").when(before > F.col("s"), "overlap")
    return spans.withColumn("fault", fault).where(F.col("fault").isNotNull())


def greedy_alignment(docs: DataFrame, groups: list[list[str]]) -> DataFrame:
    """doc_id, group, spans, error: fragments take the first free occurrence, group after group; an error refuses the document."""

    def place(text: str) -> Iterator[tuple]:
        try:
            found = S.locate_groups(text, groups)
        except S.FragmentError as error:
            yield 0, None, str(error)
            return
        for k, spans in enumerate(found, 1):
            yield k, [{"s": s, "e": e} for s, e in spans], None

    kind = pa.list_(pa.struct([("s", pa.int32()), ("e", pa.int32())]))
    return _per_text(docs, place, "doc_id long, group int, spans array<struct<s:int,e:int>>, error string", ["group", "spans", "error"], [pa.int32(), kind, pa.string()])


def dedup_labels(pairs: DataFrame, key: list[str], label: list[str], order: list[str], annotated: Column, edited: Column) -> DataFrame:
    """Rows without later repeats of a label within a key; annotated rows, and rows of edited keys, all stay."""
    first = F.row_number().over(Window.partitionBy(*key, *label).orderBy(*order)) == 1
    return pairs.withColumn("_first", first).where(F.col("_first") | annotated | edited).drop("_first")
