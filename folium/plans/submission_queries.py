"""Queries of whole validation, of submissions and of user edits, over stand-ins that each docstring names.

A document is a row of documents; its lines are atoms a00001 on, and a block b00001 on for each.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from folium.functions import text as X
from folium.operators import ledger, quality, regions, submissions, validation, views
from folium.sources.plain import atoms


def _t(spark, sf, name):
    return spark.read.parquet(f"{sf}/{name}.parquet")


def _lines(spark, sf, labelled=False):
    docs = _t(spark, sf, "documents").select("doc_id", "text")
    if labelled:
        docs = docs.join(_t(spark, sf, "labels"), "doc_id", "left")
    rows = docs.select(*[c for c in docs.columns if c != "text"], F.posexplode(F.split("text", "\n")).alias("n", "text")).withColumn("ord", F.col("n") + 1).drop("n")
    return rows.withColumn("block_id", F.format_string("b%05d", "ord")).withColumn("source_ids", F.array(F.format_string("a%05d", "ord"))).withColumn("kind", F.lit("paragraph")).withColumn("structure_note", F.lit("kept"))


def _atoms(spark, sf):
    return _lines(spark, sf).select("doc_id", F.col("source_ids")[0].alias("atom_id"), "text", "ord")


def _whole():
    return F.array(F.struct(F.lit(0).alias("s"), F.length("text").alias("e")))


def _no_text():
    return F.lit(None).cast("string")


def validate_whole(spark, sf):
    """Labelled documents are their own translation, reviewed where quality is 1; every seventh lost its last block, every
    eleventh uses its first block id twice; structure, glossary, whole review, source hash and an issue depend on the id;
    labelled documents have a note that quotes their first line, changed where toxic."""
    lines = _lines(spark, sf, labelled=True)
    last = F.size(F.split("text", "\n"))
    sizes = _t(spark, sf, "documents").select("doc_id", last.alias("_lines"))
    blocks = lines.join(sizes, "doc_id").where((F.col("doc_id") % 7 != 0) | (F.col("ord") < F.col("_lines")))
    twice = (F.col("doc_id") % 11 == 0) & (F.col("ord") == 2)
    blocks = blocks.select("doc_id", F.when(twice, "b00001").otherwise(F.col("block_id")).alias("block_id"), "kind", "text", "source_ids", F.when(F.col("quality").isNotNull(), F.col("text")).alias("target"), "structure_note", _no_text().alias("difference_explanation"), _no_text().alias("duplicate_explanation"), F.when(F.col("quality") == 1, "h").alias("reviewed_hash"), F.lit("h").alias("target_hash"))
    i = F.col("doc_id")
    docs = _t(spark, sf, "documents").select("doc_id", (i % 2 == 0).alias("structure_reviewed"), (i % 3 == 0).alias("terms_reviewed"), (i % 4).alias("n_terms"), F.when(i % 5 == 0, "f").otherwise("g").alias("review_fingerprint"), F.lit("f").alias("fingerprint"), F.when(i % 13 == 0, "x").otherwise("y").alias("stored_hash"), F.lit("y").alias("source_hash"))
    issues = docs.where(i % 6 == 0).select("doc_id", F.concat(F.lit("tex-env-"), i.cast("string")).alias("issue_id"), F.when(i % 12 != 0, "the file is missing").alias("resolution"), F.when(i % 18 == 0, validation.BATCH).otherwise("agent").alias("resolved_by"))
    quote = F.substring("text", 1, 3)
    notes = lines.where("ord = 1 and quality is not null").select("doc_id", F.lit("n1").alias("note_id"), "block_id", F.lit("source").alias("side"), F.lit(0).alias("start"), F.lit(3).alias("end"), F.when(F.col("toxic") == 1, F.concat(quote, F.lit("!"))).otherwise(quote).alias("quote"))
    return validation.verdict(docs, _atoms(spark, sf), blocks, issues, notes.join(blocks.select("doc_id").distinct(), "doc_id", "left_semi"))


def limitation_rollup(spark, sf):
    """Events are issues of their user, of a category for each type; those of high value were resolved in a batch."""
    e = _t(spark, sf, "events")
    issues = e.select(F.col("user_id").alias("doc_id"), F.concat_ws("-", F.lit("tex"), "event_type", F.col("event_id").cast("string")).alias("issue_id"), F.concat(F.lit("the file of event "), F.col("event_id").cast("string"), F.lit(" is missing")).alias("resolution"), F.when(F.col("value") > 50, validation.BATCH).otherwise("agent").alias("resolved_by"), F.col("event_id").alias("ord"))
    return validation.limitation_rollup(issues)


def structure_replaced(spark, sf):
    """New blocks hold two lines each; some lack a note, some a block, and some documents are annotated already."""
    atoms, lines, i = _atoms(spark, sf), _lines(spark, sf), F.col("doc_id")
    blocks = lines.select("doc_id", "block_id", "ord", "kind", "text", "source_ids", "structure_note", _no_text().alias("target"))
    new = ledger.blocks_of(atoms, 2).withColumn("kind", F.when(i % 17 == 0, "novel").otherwise("paragraph")).withColumn("structure_note", F.when((i % 5 == 0) & (F.col("ord") == 1), " ").otherwise("two lines"))
    new = new.where((i % 7 != 0) | (F.col("ord") > 1))
    notes = _t(spark, sf, "documents").where(i % 9 == 0).select("doc_id")
    out, refused = submissions.replace_structure(blocks, atoms, new, notes)
    counts = out.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n_blocks"))
    return counts.join(refused.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n_refusals")), "doc_id", "left").na.fill(0, ["n_refusals"])


def structure_patched(spark, sf):
    """Every second line is merged into the one before it; every fourth from the first becomes a heading, by the later of two updates."""
    lines = _lines(spark, sf)
    blocks = lines.select("doc_id", "block_id", "ord", "kind", "text", "source_ids", F.lit("").alias("structure_note"), F.lit("old").alias("source_change"))
    first = lines.where("ord % 4 = 1").select("doc_id", "block_id", F.lit(1).alias("seq"), F.lit("caption").alias("kind"), _no_text().alias("text"), F.lit("by an update").alias("structure_note"), _no_text().alias("source_change"))
    updates = first.unionByName(first.withColumn("seq", F.lit(2)).withColumn("kind", F.lit("heading")).withColumn("structure_note", _no_text()))
    merges = lines.where("ord % 2 = 0").select("doc_id", F.col("block_id").alias("from_id"), F.format_string("b%05d", F.col("ord") - 1).alias("into_id"), "ord", F.when(F.col("ord") % 4 == 0, "by a merge").alias("structure_note"))
    out = submissions.patch_structure(blocks, updates, merges, default_note="by default")
    return out.select("doc_id", "block_id", "kind", F.size("source_ids").cast("long").alias("n_sources"), "structure_note", "source_change", F.sha2(F.col("text").cast("binary"), 256).alias("text_sha256"))


def merges_refused(spark, sf):
    """Merges of every fifth line into one that does not exist, into itself, and without a note."""
    lines = _lines(spark, sf)
    into = F.when(F.col("doc_id") % 3 == 0, F.lit("b99999")).when(F.col("doc_id") % 3 == 1, F.col("block_id")).otherwise(F.lit("b00001"))
    merges = lines.where("ord % 5 = 0").select("doc_id", F.col("block_id").alias("from_id"), into.alias("into_id"), "ord", F.when(F.col("doc_id") % 4 == 0, "").otherwise("why").alias("structure_note"))
    return submissions.merge_refusals(lines, merges)


def assets_attached(spark, sf):
    """Every third line is a figure without an image; the third line asks for one, in some documents under a wrong name, for a paragraph or without a file."""
    lines, i = _lines(spark, sf), F.col("doc_id")
    blocks = lines.select("doc_id", "block_id", F.when(F.col("ord") % 3 == 0, "figure").otherwise("paragraph").alias("kind"), _no_text().alias("asset"), "structure_note")
    name = F.when(i % 5 == 0, "other.png").otherwise("region-0123456789abcdef.png")
    requests = lines.where((F.col("ord") == 3) | ((i % 7 == 0) & (F.col("ord") == 1))).select("doc_id", "block_id", name.alias("asset"), F.lit("cut from the page").alias("note"))
    files = _t(spark, sf, "documents").where(i % 11 != 0).select("doc_id", F.lit("region-0123456789abcdef.png").alias("asset"))
    out, refused = submissions.attach_assets(blocks, requests, files)
    counts = out.groupBy("doc_id").agg(F.count("asset").alias("n_attached"), F.count(F.when(F.col("structure_note").contains("cut"), 1)).alias("n_noted"))
    return counts.join(refused.groupBy("doc_id").agg(F.array_join(F.array_sort(F.collect_list("error")), "; ").alias("errors")), "doc_id", "left")


def translations_submitted(spark, sf):
    """Labelled documents submit their lines as translations; toxic ones leave the first empty, every fiftieth is protected, every ninth has no glossary."""
    lines, i = _lines(spark, sf, labelled=True), F.col("doc_id")
    blocks = lines.select("doc_id", "block_id", "kind", "text", _no_text().alias("target"), F.array().cast("array<string>").alias("history"), ((i % 50 == 0) & (F.col("ord") == 1)).alias("user_edited"), F.lit("h").alias("reviewed_hash"))
    submitted = lines.where("quality is not null").select("doc_id", "block_id", F.when((F.col("toxic") == 1) & (F.col("ord") == 1), "").otherwise(F.col("text")).alias("target"), _whole().alias("source_spans"), _whole().alias("target_spans"))
    docs = _t(spark, sf, "documents").select("doc_id", F.lit(True).alias("structure_reviewed"), (i % 9 != 0).alias("terms_reviewed"), F.lit(0).alias("n_terms"))
    out, refused = submissions.submit_translations(blocks, docs, submitted)
    counts = out.groupBy("doc_id").agg(F.count("target").alias("n_translated"), F.count("reviewed_hash").alias("n_reviewed"))
    return counts.join(refused.groupBy("doc_id").agg(F.array_join(F.array_sort(F.collect_list("error")), "; ").alias("errors")), "doc_id", "left")


def reviews_submitted(spark, sf):
    """Labelled documents review the translation of each line; where quality is 0 an older one, and every tenth forgets a note."""
    lines, i = _lines(spark, sf, labelled=True), F.col("doc_id")
    blocks = lines.select("doc_id", "block_id", F.col("text").alias("target"), _no_text().alias("reviewed_hash"))
    requests = lines.where("quality is not null").select("doc_id", "block_id", F.when(F.col("quality") == 1, F.sha2(F.col("text").cast("binary"), 256)).otherwise("old").alias("hash"), F.when((i % 10 == 0) & (F.col("ord") == 1), " ").otherwise("read").alias("note"))
    out, refused = submissions.submit_reviews(blocks, requests)
    counts = out.groupBy("doc_id").agg(F.count("reviewed_hash").alias("n_reviewed"))
    return counts.join(refused.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n_refusals")), "doc_id", "left").na.fill(0, ["n_refusals"])


def terms_submitted(spark, sf):
    """Benchmark items are glossaries of ten documents, with some terms edited by users; each fourth item is submitted again, some blank."""
    b = _t(spark, sf, "benchmark").select((F.col("item_id") % 10).alias("doc_id"), F.col("item_id").cast("string").alias("term_id"), F.col("text").alias("en"), F.col("text").alias("zh"), F.col("text").alias("definition"), "item_id")
    terms = b.select("doc_id", "term_id", "en", "zh", "definition", (F.col("item_id") % 17 == 0).alias("user_edited"))
    new = b.where("item_id % 4 = 0").select("doc_id", "term_id", "en", "zh", F.when(F.col("item_id") % 16 == 8, "").otherwise("new").alias("definition"))
    docs = b.select("doc_id", (F.col("doc_id") != 6).alias("structure_reviewed")).distinct()
    out, refused = submissions.submit_terms(terms, docs, new)
    counts = out.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n_terms"), F.count(F.when(F.col("definition") == "new", 1)).alias("n_new"))
    return counts.join(refused.groupBy("doc_id").agg(F.array_join(F.array_sort(F.collect_list("error")), "; ").alias("errors")), "doc_id", "left")


def full_review_submitted(spark, sf):
    """Labelled documents ask for a whole review, with an old fingerprint where quality is 0; every sixth has an open issue."""
    i = F.col("doc_id")
    docs = _t(spark, sf, "documents").select("doc_id", F.lit("old").alias("review_fingerprint"), F.sha2(F.col("text").cast("binary"), 256).alias("fingerprint"))
    requests = docs.join(_t(spark, sf, "labels"), "doc_id").select("doc_id", F.when(F.col("quality") == 1, F.col("fingerprint")).otherwise("old").alias("fingerprint"), F.when(F.col("toxic") == 1, "").otherwise("read").alias("note"))
    found = docs.where(i % 6 == 0).select("doc_id", F.concat(F.lit("Unresolved extraction issue: x-"), i.cast("string")).alias("message")).unionByName(docs.select("doc_id", F.lit("Current whole-document review required").alias("message")))
    out, refused = submissions.full_reviews(docs, requests, found)
    counts = refused.groupBy("doc_id").agg(F.array_join(F.array_sort(F.collect_list("error")), "; ").alias("errors"))
    return out.select("doc_id", (F.col("review_fingerprint") == F.col("fingerprint")).alias("current")).join(counts, "doc_id", "left")


def translation_edited(spark, sf):
    """A document is its own translation with a span for each line; the user rewrites the line of number id mod 5, where there is one."""
    placed = atoms(_t(spark, sf, "documents"), "line").groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct(F.col("start").alias("s"), F.col("end").alias("e")))).alias("target_spans"))
    blocks = _t(spark, sf, "documents").join(placed, "doc_id").select("doc_id", F.lit("b00001").alias("block_id"), F.col("text").alias("target"), "target_spans", F.array().cast("array<string>").alias("history"), F.lit(False).alias("user_edited"), F.lit("h").alias("reviewed_hash"))
    edits = blocks.select("doc_id", "block_id", (F.col("doc_id") % 5).cast("int").alias("at"), F.lit("[edited]").alias("new_text"))
    out, refused = submissions.edit_translations(blocks, edits)
    shown = out.select("doc_id", F.sha2(F.col("target").cast("binary"), 256).alias("target_sha256"), F.size("history").cast("long").alias("n_history"), "user_edited", F.col("reviewed_hash").isNotNull().alias("reviewed"), F.element_at("target_spans", -1)["e"].cast("long").alias("last_end"))
    return shown.join(refused.select("doc_id", "error"), "doc_id", "left")


def notes_edited(spark, sf):
    """Labelled documents have a note on their first line; a second version comes for each, with another quote where toxic, and every fourth is deleted."""
    lines = _lines(spark, sf, labelled=True).where("ord = 1 and quality is not null")
    blocks = lines.select("doc_id", "block_id", "text", _no_text().alias("target"))
    quote = F.substring("text", 1, 3)
    notes = lines.select("doc_id", F.lit("n1").alias("note_id"), "block_id", F.lit("source").alias("side"), F.lit(0).alias("start"), F.lit(3).alias("end"), quote.alias("quote"), F.lit("old").alias("body"))
    put = notes.withColumn("body", F.lit("new")).join(lines.select("doc_id", "toxic"), "doc_id").withColumn("quote", F.when(F.col("toxic") == 1, F.concat("quote", F.lit("!"))).otherwise(F.col("quote"))).drop("toxic")
    versions = put.withColumn("seq", F.lit(2)).unionByName(put.withColumn("body", F.lit("older")).withColumn("seq", F.lit(1)))
    out, refused = submissions.edit_notes(notes, blocks, versions, notes.where(F.col("doc_id") % 4 == 0))
    return out.select("doc_id", "body").join(refused.select("doc_id", "error"), "doc_id", "full_outer")


def terms_edited(spark, sf):
    """Users change every third benchmark item's definition."""
    terms = _t(spark, sf, "benchmark").select(F.lit(1).alias("doc_id"), F.col("item_id").cast("string").alias("term_id"), F.col("text").alias("zh"), F.col("text").alias("definition"), F.lit(False).alias("user_edited"))
    edits = terms.where(F.col("term_id").cast("long") % 3 == 0).select("doc_id", "term_id", "zh", F.lit("changed").alias("definition"))
    return submissions.edit_terms(terms, edits).select("term_id", F.sha2(F.col("definition").cast("binary"), 256).alias("definition_sha256"), "user_edited")


def review_assembled(spark, sf):
    """Lines of labelled documents are reviewed; the snapshot that the agent read has documents of quality 1, without the hash of a second line where toxic."""
    lines = _lines(spark, sf, labelled=True).where("quality is not null")
    requests = lines.select("doc_id", "block_id", F.lit("s1").alias("submission_id"), F.when(F.col("doc_id") % 8 == 0, "").otherwise("me").alias("agent"), _no_text().alias("hash"))
    snapshot = lines.where("quality = 1").select("doc_id", (F.col("doc_id") % 9).alias("revision"), "block_id", F.when((F.col("toxic") == 0) | (F.col("ord") != 2), F.sha2(F.col("text").cast("binary"), 256)).alias("translation_hash"))
    rows, refused = submissions.assemble(requests, snapshot, "review")
    counts = rows.groupBy("doc_id", "revision").agg(F.count("translation_hash").alias("n_blocks"))
    return counts.join(refused.groupBy("doc_id").agg(F.array_join(F.array_sort(F.collect_list("error")), "; ").alias("errors")), "doc_id", "full_outer")


def public_view(spark, sf):
    """Lines of documents as agents see them; those of a number divisible by three were shown before."""
    lines = _lines(spark, sf, labelled=True)
    blocks = lines.select("doc_id", "ord", "block_id", "kind", "text", "source_ids", _no_text().alias("asset"), F.when(F.col("quality") == 1, F.col("text")).alias("target"), _no_text().alias("reviewed_hash"), F.lit(False).alias("user_edited"), "structure_note")
    shown = views.with_refs(views.public_blocks(blocks), lines.where("ord % 3 = 0"))
    return shown.select("doc_id", F.col("ord").cast("long").alias("ord"), "ref", F.sha2(F.col("text").cast("binary"), 256).alias("text_sha256"), "translation_hash", "has_structure_note")


def documents_published(spark, sf):
    """Documents with their lines, a note where labelled, and a verdict that fails where quality is 0."""
    lines = _lines(spark, sf, labelled=True)
    notes = lines.where("ord = 1 and toxic is not null").select("doc_id", F.lit("n1").alias("note_id"), F.when(F.col("toxic") == 1, "orphaned").otherwise("attached").alias("status"))
    verdicts = _t(spark, sf, "labels").select("doc_id", (F.col("quality") == 1).alias("ok"), (1 - F.col("quality")).alias("n_errors"))
    docs = _t(spark, sf, "documents").select("doc_id", F.col("source").alias("title"))
    found = views.public_documents(docs, lines.select("doc_id", "ord", "block_id", F.sha2(F.col("text").cast("binary"), 256).alias("text")), notes, verdicts)
    return found.select("doc_id", F.sha2(F.col("document").cast("binary"), 256).alias("document_sha256"))


def projection_meta(spark, sf):
    docs = _t(spark, sf, "documents").select("doc_id", F.col("source").alias("title"), (F.col("doc_id") % 9).alias("revision"), F.lit("translate").alias("stage"), F.sha2(F.col("text").cast("binary"), 256).alias("fingerprint"), F.concat(F.col("doc_id").cast("string"), F.lit(".txt")).alias("source_file"), F.lit(1).alias("schema_version"))
    found = views.projection_meta(docs, _lines(spark, sf), _atoms(spark, sf).where("text <> ''"))
    return found.select("doc_id", "title", "revision", "stage", "fingerprint", "source_file", F.col("schema_version").cast("long").alias("schema_version"), "projection", "block_count", "atom_count")


def reader_columns(spark, sf):
    """Line items of orders as blocks: references (R), figures (A) and others, translated by their own number where tax is low, noted where the quantity is high."""
    items = _t(spark, sf, "lineitem").select(F.col("l_orderkey").alias("doc_id"), F.concat_ws("-", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity").alias("block_id"), F.when(F.col("l_returnflag") == "R", "reference").when(F.col("l_returnflag") == "A", "figure").otherwise("paragraph").alias("kind"), F.col("l_partkey").cast("string").alias("text"), F.when(F.col("l_tax") < 0.05, F.col("l_partkey").cast("string")).alias("target"), (F.col("l_discount") > 0.08).alias("user_edited"), F.when(F.col("l_discount") < 0.03, "a.png").alias("asset"), "l_quantity")
    notes = items.where("l_quantity > 40").select("doc_id", "block_id", F.lit("target").alias("side"), F.lit("attached").alias("status"))
    plain = views.plain_references(items, notes).groupBy("doc_id").agg(F.count(F.lit(1)).alias("n_plain"))
    shown = items.groupBy("doc_id").agg(F.count(F.when(views.shows_text(F.col("kind"), F.col("asset"), F.col("target")), 1)).alias("n_texts"))
    return shown.join(plain, "doc_id", "left").na.fill(0, ["n_plain"])


def images_resolved(spark, sf):
    """Pages refer to images beside them, above their folder, elsewhere and without a file."""
    i = F.col("page_id")
    name = F.concat(F.lit("pic"), i.cast("string"))
    target = F.when(i % 5 == 0, F.concat(F.lit("http://e.org/"), name, F.lit(".png"))).when(i % 5 == 1, F.concat(F.lit("sub/../"), name, F.lit(".PNG"))).when(i % 5 == 2, F.concat(F.lit("../../"), name, F.lit(".png"))).when(i % 5 == 3, F.concat(F.lit("./"), name, F.lit(".png"))).otherwise(F.concat(name, F.lit(".txt")))
    images = _t(spark, sf, "pages").select(i.alias("doc_id"), F.lit("b00001").alias("block_id"), F.concat(F.lit("in/"), i.cast("string")).alias("folder"), target.alias("target"))
    files = images.select(F.explode(F.array(*[F.concat("folder", F.lit("/pic"), F.col("doc_id").cast("string"), F.lit(x)) for x in (".PNG", ".txt")])).alias("path"))
    files = files.union(images.where("doc_id % 2 = 0").select(F.concat("folder", F.lit("/pic"), F.col("doc_id").cast("string"), F.lit(".png"))))
    return regions.local_images(images, files).select("doc_id", "asset", "copied_from", "issue_id")


def crops_of_images(spark, sf):
    """Parts are images that a document crops: as wide as their size and as high as their price, cut by shares of their number."""
    k = F.col("p_partkey")
    box = regions.source_crop(F.col("p_size").cast("long") * 10, F.floor("p_retailprice"), k % 7 * 9000, k % 5 * 11000, k % 11 * 9000, k % 3 * 40000)
    return _t(spark, sf, "part").select("p_partkey", box.alias("b")).select("p_partkey", *[F.col(f"b.{c}").cast("long").alias(c) for c in ("x0", "y0", "x1", "y1")])


def metafile_points(spark, sf):
    """Parts are points of a metafile in mode 1, in a window of its own, and in one without extent."""
    k, lit = F.col("p_partkey"), F.lit
    world = [lit(2.0), lit(0.5), lit(-1.0), lit(3.0), lit(7.0), lit(-4.0)]
    mode = F.when(k % 3 == 0, 1).otherwise(8)
    window = [lit(10.0), lit(20.0), F.when(k % 3 == 1, 100.0).otherwise(0.0), lit(50.0)]
    point = regions.device_point(F.col("p_size").cast("double"), k.cast("double"), world, mode, window, [lit(5.0), lit(6.0), lit(200.0), lit(25.0)])
    return _t(spark, sf, "part").select("p_partkey", F.round(point["x"], 4).alias("x"), F.round(point["y"], 4).alias("y"))


def visual_errors(spark, sf):
    """Line items are tables and formulas with and without an image, a mode and formula signs."""
    n = F.col("l_linenumber")
    kind = F.when(n % 3 == 0, "table").when(n % 3 == 1, "formula").otherwise("figure")
    mode = F.when(n % 2 == 0, F.when(F.col("l_returnflag") == "A", "image").when(F.col("l_returnflag") == "R", "text"))
    text = F.when(F.col("l_linestatus") == "O", F.concat(F.lit("$x_"), n.cast("string"), F.lit("$"))).otherwise(F.lit(" "))
    asset = F.when(F.col("l_tax") > 0.04, "a.png")
    error = validation.visual_error(kind, text, asset, mode, F.when(F.col("l_discount") > 0.02, 9))
    return _t(spark, sf, "lineitem").groupBy(error.alias("error")).agg(F.count(F.lit(1)).alias("n"))


def math_wrapped(spark, sf):
    """Documents as formulas, in a display where the id is even, and whether what comes out is nothing but a formula."""
    wrapped = X.wrap_math(F.col("text"), F.col("doc_id") % 2 == 0)
    return _t(spark, sf, "documents").select("doc_id", F.sha2(wrapped.cast("binary"), 256).alias("formula_sha256"), X.is_math_only(wrapped).alias("alone"), X.is_math_only(F.col("text")).alias("was_alone"))


def pairs_checked(spark, sf):
    """Turns of a conversation are groups of one translation; user turns lack a source where the turn is even, some ids repeat."""
    spans = F.array(F.struct(F.lit(0).alias("s"), F.lit(1).alias("e")))
    pairs = _t(spark, sf, "conversations").select(F.col("conv_id").alias("doc_id"), F.lit("b00001").alias("block_id"), F.when(F.col("conv_id") % 7 == 0, 0).otherwise(F.col("turn")).alias("pair_id"), F.when((F.col("role") != "user") | (F.col("turn") % 4 != 0), spans).alias("source"), spans.alias("target"))
    return quality.pair_errors(pairs).select("doc_id", "error")


QUERIES = {
    f.__name__: f
    for f in (
        validate_whole, limitation_rollup, structure_replaced, structure_patched, merges_refused, assets_attached, translations_submitted, reviews_submitted, terms_submitted, full_review_submitted, translation_edited,
        notes_edited, terms_edited, review_assembled, public_view, documents_published, projection_meta, reader_columns, images_resolved, crops_of_images, metafile_points, visual_errors, math_wrapped, pairs_checked,
    )
}

_L = "SELECT doc_id, i AS ord, l[i] AS text FROM (SELECT doc_id, string_split(text, chr(10)) AS l, unnest(range(1, len(string_split(text, chr(10))) + 1)) AS i FROM documents)"
_LL = f"SELECT l.*, quality, toxic, printf('b%05d', ord) AS block_id FROM ({_L}) l JOIN labels USING (doc_id)"
_PLACED = f"SELECT *, coalesce(sum(length(text) + 1) OVER (PARTITION BY doc_id ORDER BY ord ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS s FROM ({_L})"

ORACLES = {
    "validate_whole": f"""
WITH z AS (SELECT doc_id, len(string_split(text, chr(10))) AS n FROM documents),
b AS (SELECT l.doc_id, l.ord, trim(l.text) AS t, quality FROM ({_L}) l JOIN z USING (doc_id) LEFT JOIN labels USING (doc_id) WHERE doc_id % 7 <> 0 OR ord < n),
s AS (SELECT *, count(*) OVER (PARTITION BY doc_id, t) AS same FROM b),
g AS (SELECT doc_id, count(*) AS blocks, count(quality) AS translated, count(*) FILTER (WHERE quality = 1) AS reviewed,
  count(*) FILTER (WHERE quality IS NULL) + count(*) FILTER (WHERE quality IS NOT NULL AND same > 1) + count(*) FILTER (WHERE quality = 0) + (doc_id % 11 = 0 AND count(*) >= 2)::INT AS e FROM s GROUP BY doc_id),
d AS (SELECT doc_id, (doc_id % 7 = 0)::INT + (doc_id % 2 <> 0)::INT + (doc_id % 3 <> 0 AND doc_id % 4 = 0)::INT + (doc_id % 5 <> 0)::INT + (doc_id % 13 = 0)::INT + (doc_id % 12 = 0)::INT AS e FROM documents),
w AS (SELECT d.doc_id, (d.doc_id % 18 = 0 AND d.doc_id % 12 <> 0)::INT + coalesce(toxic, 0) * (g.doc_id IS NOT NULL)::INT AS n FROM documents d LEFT JOIN labels USING (doc_id) LEFT JOIN g ON g.doc_id = d.doc_id)
SELECT d.doc_id, d.e + coalesce(g.e, 0) = 0 AS ok, (d.e + coalesce(g.e, 0))::BIGINT AS n_errors, n::BIGINT AS n_warnings, coalesce(blocks, 0)::BIGINT AS blocks, coalesce(translated, 0)::BIGINT AS translated, coalesce(reviewed, 0)::BIGINT AS reviewed
FROM d LEFT JOIN g ON g.doc_id = d.doc_id JOIN w ON w.doc_id = d.doc_id""",
    "limitation_rollup": """
WITH i AS (SELECT user_id AS doc_id, 'tex-' || event_type AS category, 'tex-' || event_type || '-' || event_id AS id, event_id, row_number() OVER (PARTITION BY user_id, event_type ORDER BY event_id) AS k FROM events WHERE value > 50),
g AS (SELECT doc_id, category, count(*)::BIGINT AS n, string_agg(id, ', ' ORDER BY k) FILTER (WHERE k <= 3) AS sample_ids, 'the file of event ' || min(event_id) || ' is missing' AS summary FROM i GROUP BY ALL)
SELECT *, 'Confirmed known limitation (not actually fixed): ' || category || ' x' || n || '; samples: ' || sample_ids || '; ' || summary AS warning FROM g""",
    "structure_replaced": f"""
WITH l AS (SELECT doc_id, count(*) AS n, count(*) FILTER (WHERE trim(text) <> '') AS a FROM ({_L}) GROUP BY 1),
r AS (SELECT *, (doc_id % 9 = 0 AND (doc_id % 7 <> 0 OR n > 2))::INT + (doc_id % 17 = 0 AND (doc_id % 7 <> 0 OR n > 2))::INT + (doc_id % 5 = 0 AND doc_id % 7 <> 0 AND doc_id % 17 <> 0)::INT + (doc_id % 7 = 0 AND n > 2)::INT AS e FROM l)
SELECT doc_id, CASE WHEN e > 0 OR (doc_id % 7 = 0 AND n <= 2) THEN n ELSE (n + 1) // 2 END::BIGINT AS n_blocks, e::BIGINT AS n_refusals FROM r""",
    "structure_patched": f"""
SELECT doc_id, printf('b%05d', k * 2 + 1) AS block_id, CASE WHEN k % 2 = 0 THEN 'heading' ELSE 'paragraph' END AS kind, count(*)::BIGINT AS n_sources,
       CASE WHEN k % 2 = 0 THEN 'by an update' WHEN count(*) = 2 THEN 'by a merge' ELSE 'by default' END AS structure_note, CASE WHEN k % 2 = 1 AND count(*) = 2 THEN '' ELSE 'old' END AS source_change, sha256(string_agg(text, ' ' ORDER BY ord)) AS text_sha256
FROM (SELECT *, (ord - 1) // 2 AS k FROM ({_L})) GROUP BY doc_id, k""",
    "merges_refused": f"""
WITH d AS (SELECT doc_id FROM ({_L}) GROUP BY 1 HAVING count(*) >= 5)
SELECT doc_id, 'Unknown block b99999' AS error FROM d WHERE doc_id % 3 = 0 UNION ALL SELECT doc_id, 'Merge requires structure_note' FROM d WHERE doc_id % 4 = 0 UNION ALL SELECT doc_id, 'Merge from must list other blocks once' FROM d WHERE doc_id % 3 = 1""",
    "assets_attached": f"""
WITH l AS (SELECT doc_id, count(*) AS n FROM ({_L}) GROUP BY 1), e AS (
  SELECT doc_id, CASE WHEN doc_id % 5 = 0 OR doc_id % 11 = 0 THEN 'Existing local crop asset required' END AS error FROM l WHERE n >= 3
  UNION SELECT doc_id, 'Only a missing visual on a caption/figure/formula may be attached' FROM l WHERE doc_id % 7 = 0),
r AS (SELECT doc_id, string_agg(error, '; ' ORDER BY error) AS errors FROM e WHERE error IS NOT NULL GROUP BY 1)
SELECT l.doc_id, (n >= 3 AND errors IS NULL)::INT::BIGINT AS n_attached, (n >= 3 AND errors IS NULL)::INT::BIGINT AS n_noted, errors FROM l LEFT JOIN r USING (doc_id)""",
    "translations_submitted": f"""
WITH s AS (SELECT *, CASE WHEN toxic = 1 AND ord = 1 THEN '' ELSE text END AS target FROM ({_LL})), e AS (
  SELECT doc_id, CASE WHEN doc_id % 50 = 0 AND ord = 1 THEN block_id || ': user-edited translation is protected' WHEN trim(target) = '' THEN 'Translation text required' END AS error FROM s
  UNION SELECT doc_id, CASE WHEN doc_id % 9 = 0 THEN 'Submit glossary before translation (empty list permitted)' END FROM s),
r AS (SELECT doc_id, string_agg(error, '; ' ORDER BY error) AS errors FROM e WHERE error IS NOT NULL GROUP BY 1),
n AS (SELECT l.doc_id, count(*) AS n, bool_or(quality IS NOT NULL) AS asked FROM ({_L}) l LEFT JOIN labels USING (doc_id) GROUP BY 1)
SELECT n.doc_id, CASE WHEN asked AND errors IS NULL THEN n ELSE 0 END::BIGINT AS n_translated, CASE WHEN asked AND errors IS NULL THEN 0 ELSE n END::BIGINT AS n_reviewed, errors FROM n LEFT JOIN r USING (doc_id)""",
    "reviews_submitted": f"""
WITH n AS (SELECT l.doc_id, count(*) AS n, max(quality) AS q FROM ({_L}) l LEFT JOIN labels USING (doc_id) GROUP BY 1),
r AS (SELECT *, CASE WHEN q = 0 THEN 1 WHEN q = 1 AND doc_id % 10 = 0 THEN 1 ELSE 0 END AS e FROM n)
SELECT doc_id, CASE WHEN q = 1 AND e = 0 THEN n ELSE 0 END::BIGINT AS n_reviewed, e::BIGINT AS n_refusals FROM r""",
    "terms_submitted": """
WITH b AS (SELECT item_id % 10 AS doc_id, item_id FROM benchmark), a AS (SELECT DISTINCT doc_id FROM b WHERE item_id % 4 = 0), e AS (
  SELECT doc_id, 'Review structure first' AS error FROM a WHERE doc_id = 6 UNION SELECT doc_id, 'Terms require unique ids, en, zh, definition' FROM b WHERE item_id % 4 = 0 AND item_id % 16 = 8
  UNION SELECT a.doc_id, 'User-edited terms must be preserved via UI' FROM a JOIN b USING (doc_id) WHERE item_id % 17 = 0),
r AS (SELECT doc_id, string_agg(error, '; ' ORDER BY error) AS errors FROM e GROUP BY 1)
SELECT b.doc_id, CASE WHEN max(a.doc_id) IS NOT NULL AND max(errors) IS NULL THEN count(*) FILTER (WHERE item_id % 4 = 0) ELSE count(*) END::BIGINT AS n_terms,
       CASE WHEN max(a.doc_id) IS NOT NULL AND max(errors) IS NULL THEN count(*) FILTER (WHERE item_id % 4 = 0) ELSE 0 END::BIGINT AS n_new, max(errors) AS errors
FROM b LEFT JOIN a USING (doc_id) LEFT JOIN r USING (doc_id) GROUP BY b.doc_id""",
    "full_review_submitted": """
WITH e AS (SELECT doc_id, CASE WHEN quality = 0 THEN 'Whole review fingerprint stale' WHEN toxic = 1 THEN 'Full-review evidence required' END AS error FROM documents JOIN labels USING (doc_id)
  UNION SELECT doc_id, 'Unresolved extraction issue: x-' || doc_id FROM documents JOIN labels USING (doc_id) WHERE doc_id % 6 = 0),
r AS (SELECT doc_id, string_agg(error, '; ' ORDER BY error) AS errors FROM e WHERE error IS NOT NULL GROUP BY 1)
SELECT d.doc_id, l.doc_id IS NOT NULL AND errors IS NULL AS "current", errors FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id LEFT JOIN r ON r.doc_id = d.doc_id""",
    "translation_edited": f"""
WITH p AS (SELECT doc_id, s, s + length(text) AS e, row_number() OVER (PARTITION BY doc_id ORDER BY ord) - 1 AS k FROM ({_PLACED}) WHERE trim(text) <> ''),
m AS (SELECT doc_id, max(e) AS last_end FROM p GROUP BY 1), x AS (SELECT * FROM p WHERE k = doc_id % 5)
SELECT d.doc_id, CASE WHEN x.k IS NULL THEN sha256(text) ELSE sha256(substr(text, 1, x.s) || '[edited]' || substr(text, x.e + 1)) END AS target_sha256, (x.k IS NOT NULL)::INT::BIGINT AS n_history, x.k IS NOT NULL AS user_edited, x.k IS NULL AS reviewed,
       (last_end + CASE WHEN x.k IS NULL THEN 0 ELSE 8 - (x.e - x.s) END)::BIGINT AS last_end, CASE WHEN x.k IS NULL THEN 'Invalid target span' END AS error
FROM documents d JOIN m USING (doc_id) LEFT JOIN x ON x.doc_id = d.doc_id""",
    "notes_edited": """
SELECT doc_id, CASE WHEN doc_id % 4 = 0 THEN NULL WHEN toxic = 1 THEN 'old' ELSE 'new' END AS body, CASE WHEN toxic = 1 THEN 'Selection changed; reselect text to attach note' END AS error
FROM documents JOIN labels USING (doc_id) WHERE doc_id % 4 <> 0 OR toxic = 1""",
    "terms_edited": "SELECT item_id::VARCHAR AS term_id, sha256(CASE WHEN item_id % 3 = 0 THEN 'changed' ELSE text END) AS definition_sha256, item_id % 3 = 0 AS user_edited FROM benchmark",
    "review_assembled": f"""
WITH l AS ({_LL}), e AS (
  SELECT doc_id, CASE WHEN doc_id % 8 = 0 THEN 'agent is required' WHEN quality = 0 THEN 'task snapshot is required to bind revision; refusing to stamp the latest document revision'
    WHEN toxic = 1 AND ord = 2 THEN block_id || ': task snapshot is required to bind translation_hash; refusing to hash the latest translation' END AS error FROM l GROUP BY ALL),
r AS (SELECT doc_id, string_agg(error, '; ' ORDER BY error) AS errors FROM e WHERE error IS NOT NULL GROUP BY 1),
n AS (SELECT doc_id, count(*)::BIGINT AS n FROM l GROUP BY 1)
SELECT doc_id, CASE WHEN errors IS NULL THEN (doc_id % 9)::BIGINT END AS revision, CASE WHEN errors IS NULL THEN n END AS n_blocks, errors FROM n LEFT JOIN r USING (doc_id)""",
    "public_view": f"""
SELECT l.doc_id, ord::BIGINT AS ord, ord % 3 = 0 AS ref, CASE WHEN ord % 3 <> 0 THEN sha256(text) END AS text_sha256, CASE WHEN ord % 3 <> 0 AND quality = 1 THEN sha256(text) END AS translation_hash, CASE WHEN ord % 3 <> 0 THEN true END AS has_structure_note
FROM ({_L}) l LEFT JOIN labels USING (doc_id)""",
    "documents_published": f"""
WITH b AS (SELECT doc_id, string_agg('{{"ord":' || ord || ',"block_id":"' || printf('b%05d', ord) || '","text":"' || sha256(text) || '"}}', ',' ORDER BY ord) AS b FROM ({_L}) GROUP BY 1)
SELECT d.doc_id, sha256('{{"doc_id":' || d.doc_id || ',"title":"' || source || '","blocks":[' || b || ']' || CASE WHEN toxic IS NULL THEN '' ELSE ',"notes":[{{"note_id":"n1","status":"' || CASE toxic WHEN 1 THEN 'orphaned' ELSE 'attached' END || '"}}]' END
  || CASE WHEN quality IS NULL THEN '' ELSE ',"validation":{{"ok":' || (quality = 1)::VARCHAR || ',"n_errors":' || (1 - quality) || '}}' END || '}}') AS document_sha256
FROM documents d JOIN b USING (doc_id) LEFT JOIN labels l ON l.doc_id = d.doc_id""",
    "projection_meta": f"""
SELECT d.doc_id, source AS title, d.doc_id % 9 AS revision, 'translate' AS stage, sha256(d.text) AS fingerprint, d.doc_id || '.txt' AS source_file, 1::BIGINT AS schema_version, true AS projection, n AS block_count, a AS atom_count
FROM documents d JOIN (SELECT doc_id, count(*)::BIGINT AS n, (count(*) FILTER (WHERE text <> ''))::BIGINT AS a FROM ({_L}) GROUP BY 1) USING (doc_id)""",
    "reader_columns": """
SELECT l_orderkey AS doc_id, (count(*) FILTER (WHERE NOT (l_returnflag = 'A' AND l_discount < 0.03 AND NOT l_tax < 0.05)))::BIGINT AS n_texts,
       (count(*) FILTER (WHERE l_returnflag = 'R' AND (NOT l_tax < 0.05 OR (l_discount <= 0.08 AND l_quantity <= 40))))::BIGINT AS n_plain FROM lineitem GROUP BY 1""",
    "images_resolved": """
SELECT page_id AS doc_id, CASE WHEN page_id % 5 = 1 OR (page_id % 5 = 3 AND page_id % 2 = 0) THEN 'image-b00001.png' END AS asset,
       CASE WHEN page_id % 5 = 1 THEN 'in/' || page_id || '/pic' || page_id || '.PNG' WHEN page_id % 5 = 3 AND page_id % 2 = 0 THEN 'in/' || page_id || '/pic' || page_id || '.png' END AS copied_from,
       CASE WHEN NOT (page_id % 5 = 1 OR (page_id % 5 = 3 AND page_id % 2 = 0)) THEN 'image-b00001' END AS issue_id FROM pages""",
    "crops_of_images": """
WITH p AS (SELECT p_partkey AS k, p_size * 10 AS w, floor(p_retailprice) AS h FROM part),
a AS (SELECT *, greatest(0, least(round_even(w * (k % 7 * 9000) / 100000.0, 0), w - 1)) AS x0, greatest(0, least(round_even(h * (k % 5 * 11000) / 100000.0, 0), h - 1)) AS y0 FROM p)
SELECT k AS p_partkey, x0::BIGINT AS x0, y0::BIGINT AS y0, greatest(x0 + 1, least(round_even(w * (1.0::DOUBLE - k % 11 * 9000 / 100000.0::DOUBLE), 0), w))::BIGINT AS x1, greatest(y0 + 1, least(round_even(h * (1.0::DOUBLE - k % 3 * 40000 / 100000.0::DOUBLE), 0), h))::BIGINT AS y1 FROM a""",
    "metafile_points": """
WITH w AS (SELECT p_partkey AS k, 2.0::DOUBLE * p_size - p_partkey + 7 AS x, 0.5::DOUBLE * p_size + 3.0::DOUBLE * p_partkey - 4 AS y FROM part)
SELECT k AS p_partkey, round(CASE k % 3 WHEN 0 THEN x + 5 WHEN 1 THEN (x - 10) * 200 / 100 + 5 ELSE x END, 4) AS x, round(CASE k % 3 WHEN 0 THEN y + 6 WHEN 1 THEN (y - 20) * 25 / 50 + 6 ELSE y END, 4) AS y FROM w""",
    "visual_errors": """
WITH i AS (SELECT CASE l_linenumber % 3 WHEN 0 THEN 'table' WHEN 1 THEN 'formula' ELSE 'figure' END AS kind, CASE WHEN l_linenumber % 2 = 0 THEN CASE l_returnflag WHEN 'A' THEN 'image' WHEN 'R' THEN 'text' END END AS mode, l_linestatus = 'O' AS has_text, l_tax > 0.04 AS has_asset, l_discount > 0.02 AS has_file FROM lineitem)
SELECT CASE WHEN mode IS NOT NULL AND kind <> 'table' THEN 'table_mode must be text/image on a table block' WHEN mode = 'image' AND NOT (has_asset AND has_file) THEN 'image table needs a non-empty verified source image'
  WHEN mode = 'image' AND NOT has_text THEN 'image table needs source labels for translation' WHEN kind = 'formula' AND NOT has_asset AND NOT has_text THEN 'formula needs $...$ or $$...$$ math formatting, or a verified source image' END AS error, count(*)::BIGINT AS n FROM i GROUP BY 1""",
    "math_wrapped": r"""
WITH b AS (SELECT doc_id, trim(regexp_replace(replace(text, '$', ''), '\s+', ' ', 'g')) AS b FROM documents)
SELECT doc_id, sha256(CASE WHEN doc_id % 2 = 0 THEN '$$' || b || '$$' ELSE '$' || b || '$' END) AS formula_sha256, b <> '' AS alone, false AS was_alone FROM b""",
    "pairs_checked": """
SELECT conv_id AS doc_id, CASE WHEN conv_id % 7 = 0 AND count(*) > 1 THEN 'Unique semantic alignment groups required' ELSE 'Every alignment group needs both sides' END AS error
FROM conversations GROUP BY conv_id HAVING (conv_id % 7 = 0 AND count(*) > 1) OR bool_or(role = 'user' AND turn % 4 = 0)""",
}
