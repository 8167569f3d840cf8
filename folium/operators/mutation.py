"""The revisioned log of submissions and the edits of structure that it carries.

A log is folded per document in order. The fold streams a document's rows, dealt and sorted by
Spark, and holds only the submissions seen so far, so a very long log needs no more memory
than its distinct submissions.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from folium.functions import text as X

OUTCOMES = ("applied", "replayed", "conflict", "stale")


def step(seen: dict[str, tuple[str, int]], revision: int, submission: str | None, digest: str, stated: int | None) -> tuple[str, int]:
    """Outcome and revision of one submission: a replay comes before the check of revisions; stated None takes the current one."""
    if submission is not None and submission in seen:
        return ("replayed" if seen[submission][0] == digest else "conflict"), revision
    if stated is not None and stated != revision:
        return "stale", revision
    if submission is not None:
        seen[submission] = (digest, revision + 1)
    return "applied", revision + 1


def replay(log: DataFrame) -> DataFrame:
    """log (doc_id, seq, submission_id, digest, stated) with outcome and revision after each row.

    stated: the revision that the submission was made for; null for user edits, which always apply; a negative
    number -k states k revisions before the current one.
    """

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now: object = object()
        seen: dict[str, tuple[str, int]] = {}
        revision = 0
        for batch in batches:
            outcomes, revisions = [], []
            for doc, submission, digest, stated in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "submission_id", "digest", "stated")), strict=True):
                if doc != now:
                    now, seen, revision = doc, {}, 0
                at = revision + stated if stated is not None and stated < 0 else stated
                outcome, revision = step(seen, revision, submission, digest, at)
                outcomes.append(outcome)
                revisions.append(revision)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(outcomes, pa.string()), pa.array(revisions, pa.int64())], names=[*batch.schema.names, "outcome", "revision"])

    rows = log.select("doc_id", "seq", "submission_id", "digest", "stated")
    dealt = rows.repartition("doc_id").sortWithinPartitions("doc_id", "seq")
    return dealt.mapInArrow(fold, "doc_id long, seq long, submission_id string, digest string, stated int, outcome string, revision long")


def submission_conflicts(log: DataFrame) -> DataFrame:
    """Submission ids that were used with different payloads."""
    return log.groupBy("doc_id", "submission_id").agg(F.count_distinct("digest").alias("n_digests"), F.count(F.lit(1)).alias("n_rows")).where("n_digests > 1")


# ---- Structure ----


def last_targets(merges: list[tuple]) -> list[tuple]:
    """Merged id, the block that holds it in the end and its place there, from pairs (from_id, into_id) in order.

    A block that was merged away is not merged again, and none is merged into itself or what it holds.
    """
    held: dict = {}
    up: dict = {}
    for source, into in merges:
        root, path = into, []
        while root in up:
            path.append(root)
            root = up[root]
        up.update(dict.fromkeys(path, root))
        if source not in up and root != source:
            up[source] = root
            held.setdefault(root, []).append(source)
    out = []
    for root in held:
        todo, at = held[root][::-1] if root not in up else [], 0
        while todo:
            source = todo.pop()
            out.append((source, root, at))
            at += 1
            todo += held.get(source, [])[::-1]
    return out


def _last_targets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    now, pairs = None, []

    def found() -> pa.RecordBatch:
        rows = [(now, *row) for row in last_targets(pairs)]
        return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate(types)], names=["doc_id", "block_id", "_into", "_merge"])

    for batch in batches:
        types = [*batch.schema.types, pa.int64()]
        for doc, *pair in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if doc != now:
                if pairs:
                    yield found()
                now, pairs = doc, []
            pairs.append(tuple(pair))
    if pairs:
        yield found()


def merge_blocks(blocks: DataFrame, merges: DataFrame) -> DataFrame:
    """Blocks (doc_id, block_id, ord, source_ids, text) after merges (doc_id, from_id, into_id, ord), one after the other.

    The sources of merged blocks follow the target's own, in order of the merges' ord; the merged blocks go.
    Chains are followed to their last target; a block brings what was merged into it. One document's merges are held at a time.
    """
    own = blocks.select(F.col("doc_id").alias("_doc"), F.col("block_id").alias("_block"), F.col("ord").alias("_own"))
    asked = merges.join(own, (F.col("doc_id") == F.col("_doc")) & (F.col("from_id") == F.col("_block")))
    dealt = asked.repartition("doc_id").sortWithinPartitions("doc_id", "ord", "_own", "from_id", "into_id").select("doc_id", "from_id", "into_id")
    kinds = [f.dataType.simpleString() for f in dealt.schema]
    gone = dealt.mapInArrow(_last_targets, ", ".join(f"{c} {t}" for c, t in zip(("doc_id", "block_id", "_into", "_merge"), [*kinds, "long"], strict=True)))
    moved = blocks.join(gone, ["doc_id", "block_id"], "left")
    placed = moved.select("doc_id", F.coalesce("_into", "block_id").alias("block_id"), F.struct(F.coalesce("_merge", F.lit(-1)).alias("at"), F.col("ord"), F.col("source_ids"), F.col("text")).alias("part"))
    grown = placed.groupBy("doc_id", "block_id").agg(F.array_sort(F.collect_list("part")).alias("parts"))
    return grown.select("doc_id", "block_id", F.col("parts")[0]["ord"].alias("ord"), F.flatten("parts.source_ids").alias("source_ids"), F.array_join("parts.text", " ").alias("text"))


def unexplained_changes(blocks: DataFrame, atoms: DataFrame) -> DataFrame:
    """Blocks whose canonical text differs from that of their atoms, in order of source_ids, without a reason."""
    used = blocks.select("doc_id", "block_id", F.posexplode("source_ids").alias("_at", "atom_id"))
    joined = used.join(atoms.select("doc_id", "atom_id", F.col("text").alias("_source")), ["doc_id", "atom_id"], "left")
    sources = joined.groupBy("doc_id", "block_id").agg(F.array_join(F.array_sort(F.collect_list(F.struct("_at", "_source")))["_source"], "\n").alias("_source"))
    both = blocks.join(sources, ["doc_id", "block_id"])
    return both.where((X.canonical("text") != X.canonical("_source")) & (X.strip(F.coalesce("source_change", F.lit(""))) == "")).select("doc_id", "block_id")


def structure_errors(blocks: DataFrame) -> DataFrame:
    """doc_id, block_id, error of structural decisions without sources, without a reason or of an unknown kind."""
    from folium.schema import KINDS

    error = F.when(~F.col("kind").isin(*KINDS), "Unknown content kind").when((F.size("source_ids") <= 0) | (X.strip(F.coalesce("structure_note", F.lit(""))) == ""), "Each structural decision requires source ids and a reason")
    return blocks.select("doc_id", "block_id", error.alias("error")).where(F.col("error").isNotNull())


def inherited_assets(old: DataFrame, new: DataFrame) -> DataFrame:
    """Assets follow source sets: old (doc_id, asset, source_ids) and new (doc_id, block_id, source_ids).

    Returns doc_id, asset, block_id, status: kept where a new block holds all of an asset's sources, split where blocks
    hold some only, lost where none holds any. Sources are joined by element and counted: no set is compared with all others.
    """
    needs = old.select("doc_id", "asset", F.size(F.array_distinct("source_ids")).alias("_need"), F.explode(F.array_distinct("source_ids")).alias("_s"))
    holds = new.select("doc_id", "block_id", F.explode(F.array_distinct("source_ids")).alias("_s"))
    met = needs.join(holds, ["doc_id", "_s"], "left").groupBy("doc_id", "asset", "block_id").agg(F.first("_need").alias("_need"), F.count(F.lit(1)).alias("_got"))
    whole = F.col("block_id").isNotNull() & (F.col("_got") == F.col("_need"))
    kept = F.max(whole.cast("int")).over(Window.partitionBy("doc_id", "asset"))
    found = F.max(F.col("block_id").isNotNull().cast("int")).over(Window.partitionBy("doc_id", "asset"))
    ranked = met.withColumn("_whole", whole).withColumn("_kept", kept).withColumn("_found", found)
    ranked = ranked.where((F.col("_kept") == 0) | F.col("_whole")).where((F.col("_found") == 0) | F.col("block_id").isNotNull())
    return ranked.select("doc_id", "asset", "block_id", F.when(F.col("_whole"), "kept").when(F.col("block_id").isNotNull(), "split").otherwise("lost").alias("status"))


def asset_conflicts(inherited: DataFrame) -> DataFrame:
    """Blocks that would inherit several assets: they need an explicit one."""
    return inherited.where("status = 'kept'").groupBy("doc_id", "block_id").agg(F.count_distinct("asset").alias("n_assets")).where("n_assets > 1")


# ---- Translations, reviews, notes, terms ----


def one_for_each_block(submitted: DataFrame, columns: list[str]) -> DataFrame:
    """One row for each block: the last by `seq` if there is such a column, else the greatest; so no submission doubles a block."""
    order = [F.col(c) for c in (["seq"] if "seq" in submitted.columns else []) + columns]
    last = submitted.groupBy("doc_id", "block_id").agg(F.max(F.struct(*order, *[F.col(c).alias(f"_{c}") for c in columns])).alias("_last"))
    return last.select("doc_id", "block_id", *[F.col(f"_last._{c}").alias(f"_{c}") for c in columns])


def repeated_submissions(submitted: DataFrame) -> DataFrame:
    """doc_id, block_id of blocks that a submission holds more than once: such a submission is refused."""
    return submitted.groupBy("doc_id", "block_id").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("doc_id", "block_id")


def translate(blocks: DataFrame, submitted: DataFrame) -> DataFrame:
    """Blocks with submitted translations where the user has not edited them: the old one goes to the history, the review falls."""
    new = one_for_each_block(submitted, ["target"]).withColumnRenamed("_target", "_new")
    both = blocks.join(new, ["doc_id", "block_id"], "left")
    applies = F.col("_new").isNotNull() & ~F.coalesce("user_edited", F.lit(False))
    history = F.when(applies & F.col("target").isNotNull(), F.concat("history", F.array("target"))).otherwise(F.col("history"))
    return both.withColumn("history", history).withColumn("reviewed_hash", F.when(~applies, F.col("reviewed_hash"))).withColumn("target", F.when(applies, F.col("_new")).otherwise(F.col("target"))).drop("_new")


def review(blocks: DataFrame, submitted: DataFrame) -> DataFrame:
    """Blocks reviewed where the submitted hash is that of the translation as it is now and the note is not blank."""
    new = one_for_each_block(submitted, ["hash", "note"])
    both = blocks.join(new, ["doc_id", "block_id"], "left")
    current = F.sha2(F.col("target").cast("binary"), 256)
    good = F.coalesce((F.col("_hash") == current) & (X.strip(F.col("_note")) != ""), F.lit(False))
    return both.withColumn("reviewed_hash", F.when(good, F.col("_hash")).otherwise(F.col("reviewed_hash"))).drop("_hash", "_note")


def upsert(table: DataFrame, changes: DataFrame, key: list[str], deleted: Column | None = None) -> DataFrame:
    """Rows of a table replaced or added by their key, and deleted where the condition on changes holds."""
    kept = table.join(changes.select(*key), key, "left_anti")
    fresh = changes if deleted is None else changes.where(~deleted)
    return kept.unionByName(fresh.select(*table.columns))


def term_errors(terms: DataFrame) -> DataFrame:
    """doc_id, term_id, error: ids are unique and no field is blank."""
    n = F.count(F.lit(1)).over(Window.partitionBy("doc_id", "term_id"))
    blank = F.lit(False)
    for c in ("term_id", "en", "zh", "definition"):
        blank = blank | (X.strip(F.coalesce(c, F.lit(""))) == "")
    error = F.when(blank, "blank field").when(F.col("_n") > 1, "repeated id")
    return terms.withColumn("_n", n).select("doc_id", "term_id", error.alias("error")).where(F.col("error").isNotNull()).distinct()
