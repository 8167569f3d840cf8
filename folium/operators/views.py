"""Bounded projections for readers and agents, and verified snapshots."""

from __future__ import annotations

import base64
import json
import re

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from folium.functions import text as X
from folium.operators import ledger

TASK_LIMIT, WINDOW_LIMIT, PREVIEW = 16, 24, 160


def summary(block: DataFrame) -> DataFrame:
    return block.select("doc_id", "block_id", "kind", F.substring("text", 1, PREVIEW).alias("text"), (X.strip(F.coalesce("structure_note", F.lit(""))) != "").alias("has_structure_note"), F.size("source_ids").alias("source_count"))


def public_blocks(blocks: DataFrame) -> DataFrame:
    """What an agent sees of a block: no history and no long note, but the hash that a review must name."""
    mode = ["table_mode"] if "table_mode" in blocks.columns else []
    shown = ["doc_id", "ord", "block_id", "kind", "text", "source_ids", "asset", "target", "reviewed_hash", "user_edited", *mode]
    return blocks.select(*shown, F.sha2(F.col("target").cast("binary"), 256).alias("translation_hash"), (X.strip(F.coalesce("structure_note", F.lit(""))) != "").alias("has_structure_note"))


def with_refs(rows: DataFrame, shown: DataFrame) -> DataFrame:
    """rows with `ref`: where a block is shown already (doc_id, block_id in shown) all but its id and place is null."""
    seen = shown.select("doc_id", "block_id").distinct().withColumn("ref", F.lit(True))
    both = rows.join(seen, ["doc_id", "block_id"], "left").withColumn("ref", F.coalesce("ref", F.lit(False)))
    kept = ("doc_id", "block_id", "ord", "ref")
    return both.select(*[F.col(c) if c in kept else F.when(~F.col("ref"), F.col(c)).alias(c) for c in both.columns])


def listing(docs: DataFrame) -> DataFrame:
    """Documents by id, as a page of a reader lists them."""
    return docs.select("doc_id", "title", "stage", "revision").orderBy("doc_id")


def projection_meta(docs: DataFrame, blocks: DataFrame, atoms: DataFrame) -> DataFrame:
    """The head of every view: doc_id, title, revision, stage, fingerprint, source_file, schema_version and the numbers of blocks and atoms."""
    counts = [rows.groupBy("doc_id").agg(F.count(F.lit(1)).alias(name)) for rows, name in ((blocks, "block_count"), (atoms, "atom_count"))]
    both = docs.join(counts[0], "doc_id", "left").join(counts[1], "doc_id", "left").na.fill(0, ["block_count", "atom_count"])
    return both.select("doc_id", "title", "revision", "stage", "fingerprint", "source_file", "schema_version", F.lit(True).alias("projection"), "block_count", "atom_count")


def shows_text(kind: Column, asset: Column, target: Column) -> Column:
    """Whether a reader shows a block's text beside its image: not that of untranslated figures and formulas."""
    return ~((F.coalesce(asset, F.lit("")) != "") & target.isNull() & kind.isin("figure", "formula"))


def plain_references(blocks: DataFrame, notes: DataFrame) -> DataFrame:
    """doc_id, block_id of references shown in one column: untranslated, or word for word, unedited and without an attached note on the translation."""
    held = notes.where("side = 'target' and status <> 'orphaned'").select("doc_id", "block_id").distinct().withColumn("_held", F.lit(True))
    both = blocks.where("kind = 'reference'").join(held, ["doc_id", "block_id"], "left")
    copied = (F.col("target") == F.col("text")) & ~F.coalesce("user_edited", F.lit(False)) & F.col("_held").isNull()
    return both.where(F.col("target").isNull() | copied).select("doc_id", "block_id")


def preview(candidates: DataFrame) -> DataFrame:
    """doc_id, preview: the structure candidates of each document as Markdown, a page after the other."""
    line = F.concat(F.lit("- `"), "id", F.lit("` **"), "kind_hint", F.lit("** ("), "column", F.lit(") "), "text_preview")
    pages = candidates.groupBy("doc_id", "page").agg(F.array_sort(F.collect_list(F.struct("ord", line.alias("line")))).alias("_lines"))
    whole = F.concat(F.lit("## Page "), F.col("page").cast("string"), F.lit("\n"), F.array_join(F.col("_lines.line"), "\n"))
    return pages.groupBy("doc_id").agg(F.array_join(F.array_sort(F.collect_list(F.struct("page", whole.alias("text"))))["text"], "\n\n").alias("preview"))


def outline(blocks: DataFrame) -> DataFrame:
    return blocks.where(F.col("kind") == "heading").select("doc_id", "ord", "block_id", F.substring("text", 1, PREVIEW).alias("text"), X.heading_level(F.col("text")).alias("level"))


def search(blocks: DataFrame, query: str) -> DataFrame:
    """Blocks that hold a text or its translation, whatever its case; an empty query finds all."""
    seen = blocks.where(~F.col("kind").isin("excluded", "page"))
    return seen.where(F.lower(F.concat_ws(" ", "text", "target")).contains(query.lower()))


def tasks(blocks: DataFrame, pending: Column, limit: int = TASK_LIMIT, window: int = WINDOW_LIMIT) -> DataFrame:
    """Per document the first pending blocks with their neighbours and enclosing sections, each row once.

    role: task, neighbour or section; text is shown once, rows of the section beyond `window` are left out and flagged.
    """
    chosen = ledger.first_pending(blocks.where(pending), "doc_id", ["ord"], limit).select("doc_id", "ord")
    placed = ledger.sections(blocks, F.col("kind") == "heading")
    near = ledger.neighbours(placed, chosen, "doc_id").select("doc_id", "ord", F.when(F.col("chosen") == 1, "task").otherwise("neighbour").alias("role"))
    bounds = placed.join(chosen, ["doc_id", "ord"]).groupBy("doc_id").agg(F.min(F.coalesce("section_start", F.lit(0))).alias("_from"), F.max(F.coalesce("section_end", F.lit(2**31 - 1))).alias("_to"))
    inside = placed.join(bounds, "doc_id").where((F.col("ord") >= F.col("_from")) & (F.col("ord") < F.col("_to")))
    first = ledger.first_pending(inside, "doc_id", ["ord"], window).select("doc_id", "ord", F.lit("section").alias("role"))
    roles = near.unionByName(first).groupBy("doc_id", "ord").agg(F.min_by("role", F.when(F.col("role") == "task", 0).when(F.col("role") == "neighbour", 1).otherwise(2)).alias("role"))
    return blocks.join(roles, ["doc_id", "ord"])


def progress(blocks: DataFrame, current_hash: Column) -> DataFrame:
    """Per document how much is untranslated and how much awaits a review."""
    needed = X.needs_translation(F.col("kind"), F.col("target").isNotNull())
    stale = needed & F.col("target").isNotNull() & ~F.coalesce(F.col("reviewed_hash") == current_hash, F.lit(False))
    return blocks.groupBy("doc_id").agg(F.count(F.when(needed & F.col("target").isNull(), 1)).alias("pending_translate"), F.count(F.when(stale, 1)).alias("pending_review"), F.count("reviewed_hash").alias("reviewed"))


def stage(structure_reviewed: Column, has_terms: Column, untranslated: Column, unreviewed: Column, errors: Column) -> Column:
    return F.when(~structure_reviewed, "structure").when(~has_terms, "terms").when(untranslated > 0, "translate").when(unreviewed > 0, "review").when(errors > 0, "full_review").otherwise("complete")


def public_documents(docs: DataFrame, blocks: DataFrame, notes: DataFrame, verdicts: DataFrame) -> DataFrame:
    """doc_id, document: what a reader is given of each document, as one JSON object.

    blocks: as public_blocks gives them; notes: note_id, block_id and status; verdicts: doc_id, ok and counts.
    """
    listed = lambda rows, name, order: rows.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct(order, *[c for c in rows.columns if c not in ("doc_id", order)]))).alias(name))
    said = verdicts.select("doc_id", F.struct(*[c for c in verdicts.columns if c != "doc_id"]).alias("validation"))
    both = docs.join(listed(blocks, "blocks", "ord"), "doc_id", "left").join(listed(notes, "notes", "note_id"), "doc_id", "left").join(said, "doc_id", "left")
    return both.select("doc_id", F.to_json(F.struct(*docs.columns, "blocks", "notes", "validation")).alias("document"))


# ---- Snapshots ----


def snapshots(docs: DataFrame, blocks: DataFrame) -> DataFrame:
    """doc_id, snapshot: one JSON object per document with its blocks in order."""
    rows = blocks.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("ord", "block_id", "kind", "text"))).alias("blocks"))
    return docs.join(rows, "doc_id", "left").select("doc_id", F.to_json(F.struct(*[c for c in docs.columns], "blocks")).alias("snapshot"))


def escape_snapshot(snapshot: Column) -> Column:
    """JSON that may stand inside a script element."""
    for char, code in (("<", "\\u003c"), (" ", "\\u2028"), (" ", "\\u2029")):
        snapshot = F.replace(snapshot, F.lit(char), F.lit(code))
    return snapshot


def as_page(title: Column, snapshot: Column) -> Column:
    """A page that holds a snapshot and needs nothing else."""
    name = F.replace(F.replace(title, F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;"))
    return F.concat(F.lit('<!doctype html><html><head><meta charset="utf-8"><title>'), name, F.lit('</title></head><body><script id="snapshot" type="application/json">'), escape_snapshot(snapshot), F.lit("</script></body></html>"))


def page_errors(page: str, snapshot: str) -> list[str]:
    """Why a written page may not be trusted."""
    found = re.search(r'<script id="snapshot" type="application/json">(.*?)</script>', page, re.S)
    errors = []
    if found is None or json.loads(found[1]) != json.loads(snapshot):
        errors.append("another snapshot")
    if re.search(r"""\bsrc\s*=\s*["']?(?!data:)|<link\b|@import|url\(\s*["']?(?!data:)""", re.sub(r"(?s)<script.*?</script>", "", page)):
        errors.append("refers to something outside")
    if "charset" not in page.encode()[:1024].decode(errors="replace"):
        errors.append("no character set near the beginning")
    for data in re.findall(r"data:[\w/+.-]+;base64,([^\"')]*)", page):
        try:
            base64.b64decode(data, validate=True)
        except ValueError:
            errors.append("bad base64")
    return errors


def data_uris(assets: DataFrame) -> DataFrame:
    """doc_id, asset, uri: the bytes of images (content) as they stand in a page that needs nothing else."""
    suffix = F.lower(F.regexp_extract("asset", r"\.([^.]+)$", 1))
    kind = F.when(suffix.isin("jpg", "jpeg"), "image/jpeg").when(suffix.isin("png", "gif", "webp"), F.concat(F.lit("image/"), suffix)).when(suffix == "svg", "image/svg+xml").otherwise("application/octet-stream")
    return assets.select("doc_id", "asset", F.concat(F.lit("data:"), kind, F.lit(";base64,"), F.base64("content")).alias("uri"))


def snapshots_with_assets(shots: DataFrame, assets: DataFrame) -> DataFrame:
    """doc_id, snapshot: each document's snapshot and its images by name, in one JSON object."""
    held = data_uris(assets).groupBy("doc_id").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("asset", "uri")))).alias("_assets"))
    both = shots.join(held, "doc_id", "left")
    images = F.coalesce(F.to_json("_assets"), F.lit("{}"))
    return both.select("doc_id", F.concat(F.lit('{"document":'), "snapshot", F.lit(',"assets":'), images, F.lit("}")).alias("snapshot"))


@F.pandas_udf(T.ArrayType(T.StringType()))
def _faults(page: pd.Series, snapshot: pd.Series) -> pd.Series:
    return pd.Series([page_errors(p, s) for p, s in zip(page, snapshot, strict=True)])


def export(spark: SparkSession, pages: DataFrame, errors: DataFrame, path: str) -> tuple[DataFrame, DataFrame]:
    """Writes the pages (doc_id, page, snapshot) of documents without errors to a folder; returns them as read back, and the refusals.

    A page is checked before it is written; after that it is read again, and a page that differs from what was checked is an error.
    """
    sound = pages.withColumn("_faults", _faults("page", "snapshot")).withColumn("_sha256", F.sha2(F.col("page").cast("binary"), 256))
    open_work = errors.select("doc_id", F.lit("Complete translation and review before export").alias("error")).distinct()
    broken = sound.where(F.size("_faults") > 0).select("doc_id", F.concat(F.lit("Export integrity check failed: "), F.array_join("_faults", ", ")).alias("error"))
    good = sound.where(F.size("_faults") == 0).join(open_work.select("doc_id"), "doc_id", "left_anti")
    good.select("doc_id", "page", "_sha256").write.mode("overwrite").parquet(path)
    back = spark.read.parquet(path)
    if not back.where(F.sha2(F.col("page").cast("binary"), 256) != F.col("_sha256")).isEmpty():
        raise ValueError("Export integrity check failed: saved pages differ from checked content")
    return back.select("doc_id", "page"), open_work.join(pages.select("doc_id").distinct(), "doc_id", "left_semi").unionByName(broken)
