"""Submissions by agents and edits by users, over all documents at once.

Each operation takes tables and a relation of requests, and returns the table after those that may apply. What is refused
is a relation of its own (doc_id, error), so a caller can hold both against the log. A request names its document; a document
takes all of an operation's requests or none.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from folium.functions import spans as S
from folium.functions import text as X
from folium.operators import ledger, mutation

# Names of crops, and the kinds that may be given an image.
CROP_NAME = r"^region-[a-f0-9]{16}\.png$"
VISUAL = ("caption", "figure", "formula")
# What is said of requests that are refused.
FROZEN = "Structure is frozen after translation/annotation; start structural correction before translation"
NO_PARTITION = "Structure must account for every source atom exactly once (including excluded items)"
SAME_IDS = "Duplicate block ids"
EMPTY_REFERENCE = "preserved reference text cannot be empty"
MERGE_NOTE = "Merge requires structure_note"
MERGE_ONCE = "Merge from must list other blocks once"
VISUAL_ONLY = "Only a missing visual on a caption/figure/formula may be attached"
CROP_REQUIRED = "Existing local crop asset required"
VISUAL_EVIDENCE = "Visual attachment evidence required"
GLOSSARY_FIRST = "Submit glossary before translation (empty list permitted)"
STRUCTURE_FIRST = "Review structure first"
SUBMITTED_TWICE = "Duplicate block submission"
TEXT_REQUIRED = "Translation text required"
ROWS_LOST = "table row boundaries lost; keep translated rows on separate lines"
SOURCE_UNCOVERED = "source alignment must cover all non-whitespace exactly once"
TARGET_UNCOVERED = "target alignment must cover all non-whitespace exactly once"
OLD_HASH = "Review must target the current translation hash"
REVIEW_NOTE = "Review evidence note required"
TERM_FIELDS = "Terms require unique ids, en, zh, definition"
TERMS_EDITED = "User-edited terms must be preserved via UI"
STALE_REVIEW = "Whole review fingerprint stale"
FULL_EVIDENCE = "Full-review evidence required"
UNTRANSLATED = "Translate with Agent first"
NO_SPAN = "Invalid target span"
EMPTY_TRANSLATION = "Translation cannot be empty"
NO_ANCHOR = "Invalid annotation anchor"
MOVED_SELECTION = "Selection changed; reselect text to attach note"
NO_SUBMISSION = "submission_id is required"
NO_AGENT = "agent is required"
NO_REVISION = "task snapshot is required to bind revision; refusing to stamp the latest document revision"
NO_BLOCK = "each assembled block needs an id"
NO_HASH = "task snapshot is required to bind translation_hash; refusing to hash the latest translation"
REVIEW_MISSING = "Current whole-document review required"
PROTECTED = "user-edited translation is protected"


def _blank(c: str) -> Column:
    return X.strip(F.coalesce(F.col(c), F.lit(""))) == ""


def _allowed(requests: DataFrame, refused: DataFrame) -> DataFrame:
    return requests.join(refused.select("doc_id").distinct(), "doc_id", "left_anti")


# ---- Structure ----


def frozen(blocks: DataFrame, notes: DataFrame) -> DataFrame:
    """doc_id, error of documents whose structure is fixed, as they have a translation or a note."""
    begun = blocks.where("target is not null").select("doc_id").union(notes.select("doc_id")).distinct()
    return begun.select("doc_id", F.lit(FROZEN).alias("error"))


def structure_refusals(blocks: DataFrame, atoms: DataFrame, new: DataFrame, notes: DataFrame) -> DataFrame:
    """doc_id, error of documents whose new structure (blocks as new) may not replace the old one."""
    asked = new.select("doc_id").distinct()
    named = mutation.structure_errors(new).select("doc_id", "error")
    split = ledger.partition_check(atoms.join(asked, "doc_id", "left_semi"), new).where("not ok")
    split = split.select("doc_id", F.lit(NO_PARTITION).alias("error"))
    twice = new.groupBy("doc_id", "block_id").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("doc_id", F.lit(SAME_IDS).alias("error"))
    empty = new.where((F.col("kind") == "reference") & _blank("text")).select("doc_id", F.lit(EMPTY_REFERENCE).alias("error"))
    return reduce(DataFrame.unionByName, [frozen(blocks, notes).join(asked, "doc_id", "left_semi"), named, split, twice, empty]).distinct()


def replace_structure(blocks: DataFrame, atoms: DataFrame, new: DataFrame, notes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Blocks after whole new structures (doc_id, block_id, ord, kind, text, source_ids, structure_note), and the refusals.

    A document is replaced whole or not at all; blocks of the documents that nothing is asked for stay.
    """
    refused = structure_refusals(blocks, atoms, new, notes)
    good = _allowed(new, refused)
    kept = blocks.join(good.select("doc_id").distinct(), "doc_id", "left_anti")
    return kept.unionByName(good, allowMissingColumns=True).select(*blocks.columns), refused


def patch_structure(blocks: DataFrame, updates: DataFrame, merges: DataFrame, default_note: str | None = None) -> DataFrame:
    """The extracted blocks after updates and merges; what is said of a block beats the default note.

    updates: doc_id, block_id, seq and kind, text, structure_note, source_change, each null where it stays; of several the last
    that states a field counts. merges: doc_id, from_id, into_id, ord, structure_note; a merge's note is its target's, and as the
    sources grow, an old source_change falls.
    """
    fields = ["kind", "text", "structure_note", "source_change"]
    last = updates.groupBy("doc_id", "block_id").agg(*[F.max_by(c, F.when(F.col(c).isNotNull(), F.col("seq"))).alias(f"_{c}") for c in fields])
    both = blocks.join(last, ["doc_id", "block_id"], "left")
    touched = F.col("_text").isNotNull()
    change = F.coalesce("_source_change", F.when(touched, F.lit("")).otherwise(F.col("source_change")))
    patched = both.select("doc_id", "block_id", "ord", "source_ids", *[F.coalesce(f"_{c}", c).alias(c) for c in ("kind", "text", "structure_note")], change.alias("source_change"))
    grown = mutation.merge_blocks(patched.select("doc_id", "block_id", "ord", "source_ids", "text"), merges)
    notes = merges.groupBy("doc_id", F.col("into_id").alias("block_id")).agg(F.max_by("structure_note", F.struct("ord", "from_id")).alias("_note"))
    out = grown.join(patched.select("doc_id", "block_id", "kind", "structure_note", "source_change"), ["doc_id", "block_id"]).join(notes, ["doc_id", "block_id"], "left")
    note = F.coalesce("_note", "structure_note")
    note = note if default_note is None else F.when(X.strip(F.coalesce(note, F.lit(""))) == "", F.lit(default_note)).otherwise(note)
    return out.select("doc_id", "block_id", "ord", "kind", "text", "source_ids", note.alias("structure_note"), F.when(F.col("_note").isNotNull(), F.lit("")).otherwise(F.col("source_change")).alias("source_change"))


def merge_refusals(blocks: DataFrame, merges: DataFrame) -> DataFrame:
    """doc_id, error of merges without a note, of unknown blocks, of a block into itself or of one block twice."""
    known = blocks.select("doc_id", F.col("block_id").alias("_known")).distinct()
    lost = merges.select("doc_id", F.explode(F.array("from_id", "into_id")).alias("_known")).join(known, ["doc_id", "_known"], "left_anti")
    parts = [
        lost.select("doc_id", F.concat(F.lit("Unknown block "), "_known").alias("error")),
        merges.where(_blank("structure_note")).select("doc_id", F.lit(MERGE_NOTE).alias("error")),
        merges.where("from_id = into_id").select("doc_id", F.lit(MERGE_ONCE).alias("error")),
        merges.groupBy("doc_id", "from_id").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("doc_id", F.lit(MERGE_ONCE).alias("error")),
    ]
    return reduce(DataFrame.unionByName, parts).distinct()


# ---- Assets, terms, translations, reviews ----


def attach_assets(blocks: DataFrame, requests: DataFrame, files: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Blocks after missing images were attached (doc_id, block_id, asset, note), and the refusals; files are the crops that exist (doc_id, asset).

    Text and spans stay; the note is added to the structure's, and a whole-document review falls.
    """
    there = files.select("doc_id", "asset", F.lit(True).alias("_there")).distinct()
    target = blocks.select("doc_id", "block_id", F.col("kind").alias("_kind"), F.col("asset").alias("_own"))
    asked = requests.join(target, ["doc_id", "block_id"], "left").join(there, ["doc_id", "asset"], "left")
    error = (
        F.when(F.col("_kind").isNull(), "Unknown block")
        .when(~F.col("_kind").isin(*VISUAL) | (F.coalesce("_own", F.lit("")) != ""), VISUAL_ONLY)
        .when(F.col("asset").isNull() | ~F.col("asset").rlike(CROP_NAME) | F.col("_there").isNull(), CROP_REQUIRED)
        .when(_blank("note"), VISUAL_EVIDENCE)
    )
    refused = asked.select("doc_id", error.alias("error")).where("error is not null").distinct()
    good = mutation.one_for_each_block(_allowed(requests, refused), ["asset", "note"])
    both = blocks.join(good, ["doc_id", "block_id"], "left")
    hit = F.col("_asset").isNotNull()
    note = F.when(hit, F.concat(F.coalesce("structure_note", F.lit("")), F.lit("\n"), "_note")).otherwise(F.col("structure_note"))
    return both.withColumn("structure_note", note).withColumn("asset", F.when(hit, F.col("_asset")).otherwise(F.col("asset"))).select(*blocks.columns), refused


def translation_refusals(blocks: DataFrame, docs: DataFrame, submitted: DataFrame) -> DataFrame:
    """doc_id, error of submitted translations (doc_id, block_id, target, source_spans, target_spans) that may not apply.

    docs: doc_id, structure_reviewed, terms_reviewed, n_terms.
    """
    asked = submitted.select("doc_id").distinct().join(docs, "doc_id", "left")
    early = F.when(~F.coalesce("terms_reviewed", F.lit(False)) & (F.coalesce("n_terms", F.lit(0)) == 0), GLOSSARY_FIRST).when(~F.coalesce("structure_reviewed", F.lit(False)), STRUCTURE_FIRST)
    twice = mutation.repeated_submissions(submitted).select("doc_id", F.lit(SUBMITTED_TWICE).alias("error"))
    own = blocks.select("doc_id", "block_id", F.col("kind").alias("_kind"), F.col("text").alias("_text"), F.col("user_edited").alias("_edited"))
    both = submitted.join(own, ["doc_id", "block_id"], "left")
    named = lambda message: F.concat("block_id", F.lit(f": {message}"))
    rows_of = F.size(F.filter(F.split("_text", "\n"), lambda x: x.contains("|") | x.contains("\t")))
    fault = (
        F.when(F.col("_kind").isNull(), F.concat(F.lit("Unknown block "), "block_id"))
        .when(F.coalesce("_edited", F.lit(False)), named(PROTECTED))
        .when(_blank("target"), F.lit(TEXT_REQUIRED))
        .when((F.col("_kind") == "table") & (rows_of > 1) & (X.nonblank_lines(F.col("target")) < 2), named(ROWS_LOST))
        .when(~S.spans_valid(F.col("_text"), F.col("source_spans")), named(SOURCE_UNCOVERED))
        .when(~S.spans_valid(F.col("target"), F.col("target_spans")), named(TARGET_UNCOVERED))
    )
    parts = [asked.select("doc_id", early.alias("error")), twice, both.select("doc_id", fault.alias("error"))]
    return reduce(DataFrame.unionByName, parts).where("error is not null").distinct()


def submit_translations(blocks: DataFrame, docs: DataFrame, submitted: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Blocks after translations, document by document, and the refusals."""
    refused = translation_refusals(blocks, docs, submitted)
    return mutation.translate(blocks, _allowed(submitted, refused)), refused


def submit_reviews(blocks: DataFrame, submitted: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Blocks after reviews (doc_id, block_id, hash, note), and the refusals: a review is of the translation as it is now."""
    current = blocks.select("doc_id", "block_id", F.sha2(F.col("target").cast("binary"), 256).alias("_now"))
    both = submitted.join(current, ["doc_id", "block_id"], "left")
    fault = F.when(~F.coalesce(F.col("hash") == F.col("_now"), F.lit(False)), OLD_HASH).when(_blank("note"), REVIEW_NOTE)
    twice = mutation.repeated_submissions(submitted).select("doc_id", F.lit(SUBMITTED_TWICE).alias("error"))
    refused = both.select("doc_id", fault.alias("error")).where("error is not null").unionByName(twice).distinct()
    return mutation.review(blocks, _allowed(submitted, refused)), refused


def submit_terms(terms: DataFrame, docs: DataFrame, submitted: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Glossaries after whole new ones (doc_id, term_id, en, zh, definition), and the refusals: terms that users edited stay."""
    asked = submitted.select("doc_id").distinct()
    faults = mutation.term_errors(submitted).select("doc_id", F.lit(TERM_FIELDS).alias("error"))
    edited = terms.where("user_edited").join(asked, "doc_id", "left_semi").select("doc_id", F.lit(TERMS_EDITED).alias("error"))
    early = asked.join(docs.where("structure_reviewed").select("doc_id"), "doc_id", "left_anti").select("doc_id", F.lit(STRUCTURE_FIRST).alias("error"))
    refused = reduce(DataFrame.unionByName, [early, faults, edited]).distinct()
    good = _allowed(submitted, refused).withColumn("user_edited", F.lit(False))
    return terms.join(good.select("doc_id").distinct(), "doc_id", "left_anti").unionByName(good.select(*terms.columns)), refused


def full_reviews(docs: DataFrame, requests: DataFrame, errors: DataFrame) -> tuple[DataFrame, DataFrame]:
    """docs after reviews of whole documents (doc_id, fingerprint, note), and the refusals.

    errors: validation errors as they are without the review; any but the missing review itself refuses it.
    """
    own = docs.select("doc_id", F.col("fingerprint").alias("_now"))
    fault = F.when(~F.coalesce(F.col("fingerprint") == F.col("_now"), F.lit(False)), STALE_REVIEW).when(_blank("note"), FULL_EVIDENCE)
    stale = requests.join(own, "doc_id", "left").select("doc_id", fault.alias("error")).where("error is not null")
    open_work = errors.where(F.col("message") != REVIEW_MISSING).join(requests.select("doc_id").distinct(), "doc_id", "left_semi")
    refused = stale.unionByName(open_work.select("doc_id", F.col("message").alias("error"))).distinct()
    done = _allowed(requests, refused).groupBy("doc_id").agg(F.max("fingerprint").alias("_reviewed"))
    both = docs.join(done, "doc_id", "left")
    return both.withColumn("review_fingerprint", F.coalesce("_reviewed", "review_fingerprint")).select(*docs.columns), refused


# ---- Edits by users ----


def edit_translations(blocks: DataFrame, edits: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Blocks after users rewrote one span of a translation (doc_id, block_id, at, new_text), and the refusals.

    blocks has target_spans, sorted; `at` is the place of a span among them, from 0. All later spans move, the old
    translation goes to the history, the block is protected from agents and its review falls.
    """
    one = mutation.one_for_each_block(edits, ["at", "new_text"])
    both = blocks.join(one, ["doc_id", "block_id"], "left")
    span = F.get(F.col("target_spans"), F.col("_at"))
    fault = F.when(F.col("target").isNull(), UNTRANSLATED).when((F.col("_at") < 0) | span.isNull(), NO_SPAN).when(X.strip(F.col("_new_text")) == "", EMPTY_TRANSLATION)
    asked = F.col("_at").isNotNull()
    refused = both.where(asked).select("doc_id", "block_id", fault.alias("error")).where("error is not null")
    hit = asked & fault.isNull()
    head, tail = F.substr("target", F.lit(1), span["s"]), F.substr("target", span["e"] + 1, F.length("target"))
    moved = S.shift_spans(F.col("target_spans"), span["s"], span["e"], F.length("_new_text"))
    changes = {
        "history": F.when(hit, F.concat("history", F.array("target"))).otherwise(F.col("history")),
        "target_spans": F.when(hit, moved).otherwise(F.col("target_spans")),
        "target": F.when(hit, F.concat(head, "_new_text", tail)).otherwise(F.col("target")),
        "user_edited": F.when(hit, F.lit(True)).otherwise(F.col("user_edited")),
        "reviewed_hash": F.when(~hit, F.col("reviewed_hash")),
    }
    return both.withColumns(changes).select(*blocks.columns), refused


def edit_notes(notes: DataFrame, blocks: DataFrame, put: DataFrame, deleted: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Notes after some were put (whole rows; of several with one id the last by seq) and some deleted (doc_id, note_id), and the refusals."""
    from folium.operators.validation import note_states

    newest = Window.partitionBy("doc_id", "note_id").orderBy(F.col("seq").desc())
    last = put.withColumn("_at", F.row_number().over(newest)).where("_at = 1").drop("_at")
    states = note_states(last, blocks)
    wrong = ~F.coalesce(F.col("side").isin("source", "target") & (F.col("start") >= 0) & (F.col("start") < F.col("end")), F.lit(False))
    fault = F.when(wrong, NO_ANCHOR).when(F.col("status") != "attached", MOVED_SELECTION)
    refused = states.select("doc_id", "note_id", fault.alias("error")).where("error is not null")
    good = states.where(fault.isNull()).select(*notes.columns)
    return mutation.upsert(notes, good, ["doc_id", "note_id"]).join(deleted.select("doc_id", "note_id"), ["doc_id", "note_id"], "left_anti"), refused


def edit_terms(terms: DataFrame, edits: DataFrame) -> DataFrame:
    """Glossaries after users changed the words or definition of terms (doc_id, term_id, zh, definition), which agents then leave alone."""
    new = edits.groupBy("doc_id", "term_id").agg(F.max(F.struct("zh", "definition")).alias("_new"))
    both = terms.join(new, ["doc_id", "term_id"], "left")
    hit = F.col("_new").isNotNull()
    changes = {c: F.when(hit, F.col(f"_new.{c}")).otherwise(F.col(c)) for c in ("zh", "definition")}
    return both.withColumns({**changes, "user_edited": F.when(hit, F.lit(True)).otherwise(F.col("user_edited"))}).select(*terms.columns)


# ---- Envelopes ----


def assemble(requests: DataFrame, snapshot: DataFrame, operation: str) -> tuple[DataFrame, DataFrame]:
    """Rows of an envelope bound to the snapshot that an agent read, and the refusals.

    requests: doc_id, block_id, submission_id, agent and, for reviews, hash or null; snapshot: doc_id, revision, block_id, translation_hash as they
    were read. The revision and missing hashes are the snapshot's, never those of the document as it is now.
    """
    if operation not in ("translate", "review"):
        raise ValueError("assemble operation must be translate or review")
    revisions = snapshot.groupBy("doc_id").agg(F.max("revision").alias("revision"))
    hashes = snapshot.where(~_blank("translation_hash")).groupBy("doc_id", "block_id").agg(F.min("translation_hash").alias("_bound"))
    both = requests.join(revisions, "doc_id", "left").join(hashes, ["doc_id", "block_id"], "left")
    bound = F.coalesce(F.nullif("hash", F.lit("")), "_bound") if operation == "review" else F.lit(None).cast("string")
    fault = (
        F.when(_blank("submission_id"), NO_SUBMISSION)
        .when(_blank("agent"), NO_AGENT)
        .when(F.col("revision").isNull(), NO_REVISION)
        .when(_blank("block_id"), NO_BLOCK)
    )
    if operation == "review":
        fault = fault.when(bound.isNull(), F.concat("block_id", F.lit(f": {NO_HASH}")))
    refused = both.select("doc_id", fault.alias("error")).where("error is not null").distinct()
    rows = _allowed(both, refused)
    return rows.select("doc_id", "revision", "submission_id", "agent", F.lit(operation).alias("operation"), "block_id", bound.alias("translation_hash")), refused


