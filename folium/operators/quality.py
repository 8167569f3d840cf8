"""Quality gates as relations of errors: no row means that a document passes."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from folium.functions import spans as S
from folium.functions import text as X


def repeated(texts: DataFrame, key: list[str], text: Column) -> DataFrame:
    """Rows whose stripped text another row of the key has too, with the number of them.

    Counts are pre-aggregated by a digest and joined back, so that a text that is very common meets in no single task.
    """
    digest = F.sha2(X.strip(text).cast("binary"), 256)
    keyed = texts.withColumn("_digest", digest)
    counts = keyed.groupBy(*key, "_digest").agg(F.count(F.lit(1)).alias("n_same")).where("n_same > 1")
    return keyed.join(counts, [*key, "_digest"]).drop("_digest")


def turns_as_pairs(conversations: DataFrame) -> DataFrame:
    """Stand-in for a text and its translation: each user turn and the assistant turn that follows it."""
    order = Window.partitionBy("conv_id").orderBy("turn")
    rows = conversations.select("conv_id", "turn", "role", "text", F.lead("role").over(order).alias("_role"), F.lead("text").over(order).alias("target"))
    return rows.where((F.col("role") == "user") & (F.col("_role") == "assistant")).select("conv_id", "turn", F.col("text").alias("source"), "target")


def gates(blocks: DataFrame) -> DataFrame:
    """Errors of blocks: doc_id, block_id, code, message.

    blocks: doc_id, block_id, kind, text, target, structure_note, difference_explanation,
    duplicate_explanation, reviewed_hash, target_hash, n_same, and spans of source and target if any.
    """
    b = blocks.withColumn("_needs", X.needs_translation(F.col("kind"), F.col("target").isNotNull()))
    note_missing = F.coalesce(F.col("structure_note"), F.lit("")) == ""
    is_reference = F.col("kind") == "reference"
    open_work = F.col("_needs") & F.col("target").isNotNull()
    b = b.withColumn("_differences", F.when(open_work, X.differences(F.col("text"), F.col("target"))))
    found = [
        (is_reference & (X.strip(F.coalesce("text", F.lit(""))) == ""), "reference", F.lit("preserved reference text cannot be empty")),
        (~F.col("_needs") & note_missing, "note", F.when(is_reference, "reference content needs source-check reason").otherwise("visual/verbatim/excluded content needs disposition reason")),
        (F.col("_needs") & F.col("target").isNull(), "missing", F.lit("missing translation")),
        (open_work & (F.col("kind") == "table") & (F.size(F.filter(F.split("text", "\n"), lambda x: x.contains("|") | x.contains("\t"))) > 1) & (X.nonblank_lines(F.col("target")) < 2), "rows", F.lit("table row boundaries lost; keep translated rows on separate lines")),
        (open_work & (F.col("n_same") > 1) & F.col("duplicate_explanation").isNull(), "duplicate", F.lit("repeated translation requires duplicate_explanation")),
        ((F.size("_differences") > 0) & F.col("difference_explanation").isNull(), "difference", F.concat(F.lit("unexplained differences ["), F.array_join("_differences", ", "), F.lit("]"))),
        (open_work & ~F.coalesce(F.col("reviewed_hash") == F.col("target_hash"), F.lit(False)), "review", F.lit("second-pass review required")),
    ]
    errors = F.array_compact(F.array(*[F.when(F.coalesce(when, F.lit(False)), F.struct(F.lit(code).alias("code"), F.concat("block_id", F.lit(": "), what).alias("message"))) for when, code, what in found]))
    return b.select("doc_id", "block_id", F.explode(errors).alias("e")).select("doc_id", "block_id", "e.code", "e.message")


def alignment_errors(aligned: DataFrame) -> DataFrame:
    """doc_id, block_id, side, error of translations whose spans do not cover a side."""
    sides = [aligned.select("doc_id", "block_id", F.lit(side).alias("side"), S.cover_error(F.col(text), F.col(spans)).alias("error")) for side, text, spans in (("source", "text", "source_spans"), ("target", "target", "target_spans"))]
    return reduce(DataFrame.unionByName, sides).where(F.col("error").isNotNull())


def pair_errors(pairs: DataFrame) -> DataFrame:
    """doc_id, block_id, error of translations whose groups (pair_id, source, target: lists of spans) repeat an id or lack a side."""
    found = pairs.groupBy("doc_id", "block_id").agg(F.count(F.lit(1)).alias("_n"), F.count_distinct("pair_id").alias("_ids"), F.max((F.coalesce(F.size("source"), F.lit(0)) <= 0).cast("int")).alias("_a"), F.max((F.coalesce(F.size("target"), F.lit(0)) <= 0).cast("int")).alias("_b"))
    error = F.when(F.col("_n") > F.col("_ids"), "Unique semantic alignment groups required").when(F.greatest("_a", "_b") == 1, "Every alignment group needs both sides")
    return found.select("doc_id", "block_id", error.alias("error")).where("error is not null")


def document_errors(docs: DataFrame, issues: DataFrame) -> DataFrame:
    """Errors of whole documents: structure, glossary, fingerprint and source hash, and issues without a resolution."""
    checks = [(~F.col("structure_reviewed"), "Structure not reviewed"), (~F.col("terms_reviewed") & (F.col("n_terms") == 0), "Glossary decision required (empty glossary allowed with explicit submission)"), (~F.coalesce(F.col("review_fingerprint") == F.col("fingerprint"), F.lit(False)), "Current whole-document review required"), (F.col("stored_hash") != F.col("source_hash"), "Immutable source hash mismatch")]
    messages = F.array_compact(F.array(*[F.when(when, F.lit(message)) for when, message in checks]))
    whole = docs.select("doc_id", F.explode(messages).alias("message"))
    unresolved = issues.where(F.coalesce("resolution", F.lit("")) == "").select("doc_id", F.concat(F.lit("Unresolved extraction issue: "), "issue_id").alias("message"))
    return whole.unionByName(unresolved)


REPETITIVE = r"^(\S+): (missing\b.*|second-pass review required)$"


def rollup(errors: DataFrame, key: str, samples: int = 5) -> DataFrame:
    """Per key and repetitive kind of message: the number and the first few block ids; other messages stay on their own."""
    kind = F.regexp_extract("message", REPETITIVE, 2)
    split = errors.withColumn("kind", F.when(kind != "", kind).otherwise(F.col("message"))).withColumn("_block", F.regexp_extract("message", REPETITIVE, 1))
    counts = split.groupBy(key, "kind").agg(F.count(F.lit(1)).alias("n"))
    # Every task keeps only the first few block ids of a kind before they are shuffled.
    placed = split.where("_block <> ''").withColumn("_at", F.row_number().over(Window.partitionBy(key, "kind").orderBy("_block"))).where(F.col("_at") <= samples)
    first = placed.groupBy(F.col(key).alias("_key"), F.col("kind").alias("_kind")).agg(F.concat_ws(",", F.array_sort(F.collect_list("_block"))).alias("samples"))
    both = counts.join(first, F.col(key).eqNullSafe(F.col("_key")) & (F.col("kind") == F.col("_kind")), "left")
    return both.select(key, "kind", "n", F.coalesce("samples", F.lit("")).alias("samples"))
