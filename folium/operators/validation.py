"""The whole verdict on documents: ledger, structure, glossary, issues, translations, reviews, notes and source in one relation.

Errors and warnings are rows (doc_id, message); a document without error rows passes. Every check is a join or an
aggregate over all documents at once, and only counts and a few samples per document are gathered.

Tables: docs (doc_id, structure_reviewed, terms_reviewed, n_terms, review_fingerprint, fingerprint, stored_hash, source_hash),
atoms (doc_id, atom_id), blocks (doc_id, block_id, kind, text, source_ids, target, structure_note, difference_explanation,
duplicate_explanation, reviewed_hash, target_hash and, if translations are aligned, source_spans and target_spans),
issues (doc_id, issue_id, resolution, resolved_by) and notes (doc_id, note_id, block_id, side, start, end, quote).
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from folium.functions import spans as S
from folium.functions import text as X
from folium.operators import ledger, quality

# What is said of documents, and how an issue is marked that a batch of limitations resolved.
NO_PARTITION = "Source ledger is not an exact partition"
SAME_IDS = "Duplicate block ids"
WRONG_MODE = "table_mode must be text/image on a table block"
NO_IMAGE = "image table needs a non-empty verified source image"
NO_LABELS = "image table needs source labels for translation"
NO_FORMULA = "formula needs $...$ or $$...$$ math formatting, or a verified source image"
LIMITATION = "Confirmed known limitation (not actually fixed): "
BATCH = "limitation_batch"


def visual_error(kind: Column, text: Column, asset: Column, table_mode: Column, asset_bytes: Column) -> Column:
    """Why a table or formula is not shown as it should be; null if it is. asset_bytes: size of the asset's file, null if there is none."""
    blank = X.strip(F.coalesce(text, F.lit(""))) == ""
    no_file = asset.isNull() | asset.rlike(r"[/\\]") | (F.coalesce(asset_bytes, F.lit(0)) <= 0)
    return (
        F.when(table_mode.isNotNull() & ((kind != "table") | ~table_mode.isin("text", "image")), WRONG_MODE)
        .when((table_mode == "image") & no_file, NO_IMAGE)
        .when((table_mode == "image") & blank, NO_LABELS)
        .when((kind == "formula") & (F.coalesce(asset, F.lit("")) == "") & ~X.has_formula_markup(F.coalesce(text, F.lit(""))), NO_FORMULA)
    )


def confirmed_limitations(issues: DataFrame) -> DataFrame:
    """doc_id, issue_id, category, resolution of issues that a batch of limitations resolved."""
    sure = issues.where((F.col("resolved_by") == BATCH) & (X.strip(F.coalesce("resolution", F.lit(""))) != ""))
    return sure.select("doc_id", "issue_id", X.issue_prefix(F.col("issue_id")).alias("category"), "resolution")


def note_states(notes: DataFrame, blocks: DataFrame) -> DataFrame:
    """notes with status: attached where the quote still stands at its place in the block's text or translation, else orphaned."""
    sides = blocks.select("doc_id", "block_id", F.col("text").alias("_text"), F.coalesce("target", F.lit("")).alias("_target")).dropDuplicates(["doc_id", "block_id"])
    both = notes.join(sides, ["doc_id", "block_id"], "left")
    value = F.when(F.col("side") == "source", F.col("_text")).otherwise(F.col("_target"))
    return both.withColumn("status", S.note_status(value, F.col("start"), F.col("end"), F.col("quote"))).drop("_text", "_target")


def errors(docs: DataFrame, atoms: DataFrame, blocks: DataFrame, issues: DataFrame) -> DataFrame:
    """doc_id, message of everything that keeps documents from being complete."""
    split = ledger.partition_check(atoms, blocks).where("not ok").select("doc_id", F.lit(NO_PARTITION).alias("message"))
    twice = blocks.groupBy("doc_id", "block_id").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    twice = twice.select("doc_id", F.lit(SAME_IDS).alias("message")).distinct()
    keyed = blocks.withColumn("_digest", F.sha2(X.strip(F.col("target")).cast("binary"), 256))
    same = keyed.where("target is not null").groupBy("doc_id", "_digest").agg(F.count(F.lit(1)).alias("n_same"))
    gated = quality.gates(keyed.join(same, ["doc_id", "_digest"], "left").withColumn("n_same", F.coalesce("n_same", F.lit(1)))).select("doc_id", "message")
    parts = [split, twice, quality.document_errors(docs, issues), gated]
    if {"source_spans", "target_spans"} <= set(blocks.columns):
        open_work = X.needs_translation(F.col("kind"), F.col("target").isNotNull()) & F.col("target").isNotNull()
        loose = quality.alignment_errors(blocks.where(open_work))
        parts.append(loose.select("doc_id", F.concat("block_id", F.lit(": "), "side", F.lit(" alignment must cover all non-whitespace exactly once")).alias("message")))
    if {"asset", "table_mode", "asset_bytes"} <= set(blocks.columns):
        wrong = visual_error(F.col("kind"), F.col("text"), F.col("asset"), F.col("table_mode"), F.col("asset_bytes"))
        parts.append(blocks.select("doc_id", F.concat("block_id", F.lit(": "), wrong).alias("message")).where("message is not null"))
    return reduce(DataFrame.unionByName, parts)


def warnings(blocks: DataFrame, issues: DataFrame, notes: DataFrame) -> DataFrame:
    """doc_id, message of what a reader should know: limitations that were confirmed, and notes that lost their place."""
    known = confirmed_limitations(issues)
    known = known.select("doc_id", F.concat(F.lit(LIMITATION), "issue_id", F.lit(" ["), "category", F.lit("] "), X.shorten(F.col("resolution"))).alias("message"))
    lost = note_states(notes, blocks).where("status = 'orphaned'").select("doc_id", F.concat(F.lit("Note "), "note_id", F.lit(" needs reattachment")).alias("message"))
    return known.unionByName(lost)


def verdict(docs: DataFrame, atoms: DataFrame, blocks: DataFrame, issues: DataFrame, notes: DataFrame) -> DataFrame:
    """doc_id, ok, n_errors, n_warnings, blocks, translated, reviewed of every document."""
    bad = errors(docs, atoms, blocks, issues).groupBy("doc_id").agg(F.count(F.lit(1)).alias("n_errors"))
    odd = warnings(blocks, issues, notes).groupBy("doc_id").agg(F.count(F.lit(1)).alias("n_warnings"))
    held = blocks.groupBy("doc_id").agg(F.count(F.lit(1)).alias("blocks"), F.count("target").alias("translated"), F.count("reviewed_hash").alias("reviewed"))
    both = docs.select("doc_id").join(bad, "doc_id", "left").join(odd, "doc_id", "left").join(held, "doc_id", "left")
    both = both.na.fill(0, ["n_errors", "n_warnings", "blocks", "translated", "reviewed"])
    return both.select("doc_id", (F.col("n_errors") == 0).alias("ok"), "n_errors", "n_warnings", "blocks", "translated", "reviewed")


def limitation_rollup(issues: DataFrame, samples: int = 3) -> DataFrame:
    """doc_id, category, n, sample_ids, summary and the one warning that stands for all limitations of a category.

    issues has `ord`, the order of extraction; the summary is the resolution of the first.
    """
    known = confirmed_limitations(issues).join(issues.select("doc_id", "issue_id", "ord").distinct(), ["doc_id", "issue_id"])
    counts = known.groupBy("doc_id", "category").agg(F.count(F.lit(1)).alias("n"), F.min_by("resolution", F.struct("ord", "issue_id", "resolution")).alias("_first"))
    # Only the first few ids of a category leave each task.
    ids = known.groupBy("doc_id", "category", "issue_id").agg(F.min("ord").alias("ord"))
    ranked = ids.withColumn("_at", F.row_number().over(Window.partitionBy("doc_id", "category").orderBy("ord", "issue_id"))).where(F.col("_at") <= samples)
    first = ranked.groupBy("doc_id", "category").agg(F.array_join(F.array_sort(F.collect_list(F.struct("_at", "issue_id")))["issue_id"], ", ").alias("sample_ids"))
    both = counts.join(first, ["doc_id", "category"]).withColumn("summary", X.shorten(F.col("_first")))
    line = F.concat(F.lit(LIMITATION), F.concat_ws("; ", F.concat("category", F.lit(" x"), F.col("n").cast("string")), F.concat(F.lit("samples: "), "sample_ids"), F.nullif("summary", F.lit(""))))
    return both.select("doc_id", "category", "n", "sample_ids", "summary", line.alias("warning"))


def warning_rollup(found: DataFrame, limitations: DataFrame) -> DataFrame:
    """doc_id, message: warnings as a progress report shows them, those of limitations as one for each category."""
    other = found.where(~F.col("message").startswith(LIMITATION))
    return other.unionByName(limitations.select("doc_id", F.col("warning").alias("message")))
