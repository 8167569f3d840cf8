"""Queries of the submission log, structure edits, assets, views and snapshots."""

from __future__ import annotations

from pyspark.sql import functions as F

from folium.functions import text as X
from folium.operators import ledger, mutation, views
from folium.sources.plain import atoms


def _t(spark, sf, name):
    return spark.read.parquet(f"{sf}/{name}.parquet")


def _log(spark, sf):
    """Stand-in: a user's events in order are submissions for one document; each fourth states an old revision."""
    e = _t(spark, sf, "events")
    return e.select(F.col("user_id").alias("doc_id"), F.col("event_id").alias("seq"), (F.col("event_id") * 7 % 40).cast("string").alias("submission_id"), F.col("event_type").alias("digest"), F.when(F.col("event_id") % 4 == 0, -1).cast("int").alias("stated"))


def mutation_log_replay(spark, sf):
    return mutation.replay(_log(spark, sf)).select("doc_id", "seq", "outcome", "revision")


def submission_conflicts(spark, sf):
    return mutation.submission_conflicts(_log(spark, sf))


def structure_merge(spark, sf):
    """Every second line of a document is merged into the one before it."""
    lines = atoms(_t(spark, sf, "documents"), "line")
    blocks = lines.select("doc_id", F.format_string("b%05d", "ord").alias("block_id"), "ord", F.array("atom_id").alias("source_ids"), "text")
    merges = lines.where("ord % 2 = 0").select("doc_id", F.format_string("b%05d", "ord").alias("from_id"), F.format_string("b%05d", F.col("ord") - 1).alias("into_id"), "ord")
    out = mutation.merge_blocks(blocks, merges)
    return out.select("doc_id", "block_id", F.array_join("source_ids", ",").alias("source_ids"), F.sha2(F.col("text").cast("binary"), 256).alias("text_sha256"))


def asset_inheritance(spark, sf):
    """Stand-in: an order's parts of the first two lines are an asset's sources; blocks hold its lines by return flag."""
    items = _t(spark, sf, "lineitem")
    old = items.where("l_linenumber <= 2").groupBy(F.col("l_orderkey").alias("doc_id")).agg(F.collect_set("l_linenumber").alias("source_ids")).withColumn("asset", F.lit("image"))
    new = items.groupBy(F.col("l_orderkey").alias("doc_id"), F.col("l_returnflag").alias("block_id")).agg(F.collect_set("l_linenumber").alias("source_ids"))
    return mutation.inherited_assets(old, new)


def term_check(spark, sf):
    """Stand-in: benchmark items are terms; every third has no definition, and ids repeat every fifty."""
    b = _t(spark, sf, "benchmark")
    terms = b.select(F.lit(1).alias("doc_id"), (F.col("item_id") % 30).cast("string").alias("term_id"), F.col("text").alias("en"), F.col("text").alias("zh"), F.when(F.col("item_id") % 3 != 0, F.col("text")).otherwise("").alias("definition"))
    return mutation.term_errors(terms).select("term_id", "error")


def translate_and_review(spark, sf):
    """Stand-in: labelled documents get their own text as translation, toxic ones were edited by the user; reviews come for quality 1."""
    docs = _t(spark, sf, "documents").join(_t(spark, sf, "labels"), "doc_id", "left")
    blocks = docs.select(F.col("source").alias("doc_id"), F.col("doc_id").cast("string").alias("block_id"), "text", F.when(F.col("doc_id") % 2 == 0, "old").alias("target"), F.array().cast("array<string>").alias("history"), (F.coalesce("toxic", F.lit(0)) == 1).alias("user_edited"), F.lit("h").alias("reviewed_hash"), "quality")
    done = mutation.translate(blocks, blocks.where("quality is not null").select("doc_id", "block_id", F.col("text").alias("target")))
    done = mutation.review(done, blocks.where("quality = 1").select("doc_id", "block_id", F.sha2(F.col("text").cast("binary"), 256).alias("hash"), F.lit("read").alias("note")))
    return done.select("doc_id", "block_id", F.size("history").cast("long").alias("n_history"), F.coalesce(F.length("target"), F.lit(-1)).cast("long").alias("n_target"), (F.coalesce("reviewed_hash", F.lit("")) == F.sha2(F.col("text").cast("binary"), 256)).alias("reviewed"))


def _blocks(spark, sf):
    lines = _t(spark, sf, "documents").select("doc_id", F.posexplode(F.split("text", "\n")).alias("n", "text"))
    kind = F.when(X.n_words(F.col("text")) <= 2, "heading").otherwise("paragraph")
    return lines.select("doc_id", (F.col("n") + 1).alias("ord"), F.format_string("b%05d", F.col("n") + 1).alias("block_id"), kind.alias("kind"), "text")


def task_view(spark, sf):
    """Pending are lines of a number divisible by three: 16 per document, their neighbours and up to 24 rows of their sections."""
    found = views.tasks(_blocks(spark, sf), F.col("ord") % 3 == 0)
    return found.select("doc_id", F.col("ord").cast("long").alias("ord"), "role")


def snapshot_export(spark, sf):
    docs = _t(spark, sf, "documents").select("doc_id", "lang", "source")
    shots = views.snapshots(docs, _blocks(spark, sf))
    return shots.select("doc_id", F.sha2(views.as_page(F.lit("a < b"), F.col("snapshot")).cast("binary"), 256).alias("page_sha256"), F.length("snapshot").cast("long").alias("n_chars"))


def issue_asset_rollup(spark, sf):
    """Sum up a coverage of lines by source and kind, with totals."""
    rows = _blocks(spark, sf).join(_t(spark, sf, "documents").select("doc_id", "source"), "doc_id")
    return rows.rollup("source", "kind").agg(F.count(F.lit(1)).alias("n_blocks"), F.grouping_id().cast("long").alias("level"))


def partition_of_merged(spark, sf):
    """Merged blocks still hold every atom exactly once."""
    lines = atoms(_t(spark, sf, "documents"), "line")
    blocks = lines.select("doc_id", F.format_string("b%05d", "ord").alias("block_id"), "ord", F.array("atom_id").alias("source_ids"), "text")
    merges = lines.where("ord % 2 = 0").select("doc_id", F.format_string("b%05d", "ord").alias("from_id"), F.format_string("b%05d", F.col("ord") - 1).alias("into_id"), "ord")
    found = ledger.partition_check(lines, mutation.merge_blocks(blocks, merges))
    return found.groupBy("ok").agg(F.count(F.lit(1)).alias("n_documents"), F.sum("n_atoms").alias("n_atoms"))


QUERIES = {f.__name__: f for f in (mutation_log_replay, submission_conflicts, structure_merge, asset_inheritance, term_check, translate_and_review, task_view, snapshot_export, issue_asset_rollup, partition_of_merged)}

_LINES = "SELECT doc_id, i AS ord, l[i] AS line FROM (SELECT doc_id, string_split(text, chr(10)) AS l, unnest(range(1, len(string_split(text, chr(10))) + 1)) AS i FROM documents)"
_LOG = "SELECT user_id AS doc_id, event_id AS seq, (event_id * 7 % 40)::VARCHAR AS sid, event_type AS digest, event_id % 4 = 0 AS stale FROM events"
_KIND = r"CASE WHEN trim(line) = '' OR len(string_split(trim(regexp_replace(line, '\s+', ' ', 'g')), ' ')) <= 2 THEN 'heading' ELSE 'paragraph' END"

ORACLES = {
    "mutation_log_replay": f"""
WITH l AS ({_LOG}), f AS (SELECT doc_id, sid, min(seq) AS first_seq, min_by(digest, seq) AS first_digest FROM l WHERE NOT stale GROUP BY ALL),
o AS (SELECT l.*, CASE WHEN first_seq IS NULL OR seq < first_seq THEN 'stale' WHEN seq = first_seq THEN 'applied' WHEN digest = first_digest THEN 'replayed' ELSE 'conflict' END AS outcome FROM l LEFT JOIN f USING (doc_id, sid))
SELECT doc_id, seq, outcome, (sum((outcome = 'applied')::INT) OVER (PARTITION BY doc_id ORDER BY seq ROWS UNBOUNDED PRECEDING))::BIGINT AS revision FROM o""",
    "submission_conflicts": f"SELECT doc_id, sid AS submission_id, count(DISTINCT digest)::BIGINT AS n_digests, count(*)::BIGINT AS n_rows FROM ({_LOG}) GROUP BY ALL HAVING count(DISTINCT digest) > 1",
    "structure_merge": f"""
SELECT doc_id, printf('b%05d', (ord - 1) // 2 * 2 + 1) AS block_id, string_agg(printf('a%05d', ord), ',' ORDER BY ord) AS source_ids, sha256(string_agg(line, ' ' ORDER BY ord)) AS text_sha256 FROM ({_LINES}) GROUP BY doc_id, (ord - 1) // 2""",
    "asset_inheritance": """
WITH s AS (SELECT l_orderkey AS doc_id, count(DISTINCT l_linenumber) AS need FROM lineitem WHERE l_linenumber <= 2 GROUP BY 1),
m AS (SELECT l_orderkey AS doc_id, l_returnflag AS block_id, count(DISTINCT l_linenumber) AS got FROM lineitem WHERE l_linenumber <= 2 GROUP BY ALL),
j AS (SELECT s.doc_id, block_id, got = need AS kept, bool_or(got = need) OVER (PARTITION BY s.doc_id) AS any_kept FROM s JOIN m USING (doc_id))
SELECT doc_id, 'image' AS asset, block_id, CASE WHEN kept THEN 'kept' ELSE 'split' END AS status FROM j WHERE kept OR NOT any_kept""",
    "term_check": "SELECT DISTINCT (item_id % 30)::VARCHAR AS term_id, CASE WHEN item_id % 3 = 0 THEN 'blank field' ELSE 'repeated id' END AS error FROM (SELECT *, count(*) OVER (PARTITION BY item_id % 30) AS n FROM benchmark) WHERE item_id % 3 = 0 OR n > 1",
    "translate_and_review": """
WITH d AS (SELECT source, d.doc_id, text, quality, quality IS NOT NULL AND toxic <> 1 AS t FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id)
SELECT source AS doc_id, doc_id::VARCHAR AS block_id, (t AND doc_id % 2 = 0)::INT::BIGINT AS n_history, (CASE WHEN t THEN length(text) WHEN doc_id % 2 = 0 THEN 3 ELSE -1 END)::BIGINT AS n_target, t AND quality = 1 AS reviewed FROM d""",
    "task_view": f"""
WITH b AS (SELECT doc_id, ord, {_KIND} AS kind FROM ({_LINES})), c AS (SELECT doc_id, ord FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY ord) AS k FROM b WHERE ord % 3 = 0) WHERE k <= 16),
s AS (SELECT *, last_value(CASE WHEN kind = 'heading' THEN ord END IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY ord ROWS UNBOUNDED PRECEDING) AS a, first_value(CASE WHEN kind = 'heading' THEN ord END IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY ord ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS z FROM b),
w AS (SELECT doc_id, min(coalesce(a, 0)) AS f, max(coalesce(z, 2147483647)) AS t FROM s JOIN c USING (doc_id, ord) GROUP BY 1),
i AS (SELECT doc_id, ord FROM (SELECT s.doc_id, s.ord, row_number() OVER (PARTITION BY s.doc_id ORDER BY s.ord) AS k FROM s JOIN w ON s.doc_id = w.doc_id AND ord >= f AND ord < t) WHERE k <= 24),
r AS (SELECT doc_id, ord, 2 AS p FROM i UNION ALL SELECT doc_id, ord, 0 FROM c UNION ALL SELECT b.doc_id, b.ord, 1 FROM b JOIN c ON b.doc_id = c.doc_id AND abs(b.ord - c.ord) = 1)
SELECT doc_id, ord::BIGINT AS ord, ['task', 'neighbour', 'section'][min(p) + 1] AS role FROM r GROUP BY doc_id, ord""",
    "snapshot_export": f"""
WITH b AS (SELECT doc_id, string_agg('{{"ord":' || ord || ',"block_id":"' || printf('b%05d', ord) || '","kind":"' || {_KIND} || '","text":' || to_json(line)::VARCHAR || '}}', ',' ORDER BY ord) AS blocks FROM ({_LINES}) GROUP BY doc_id),
s AS (SELECT doc_id, '{{"doc_id":' || doc_id || ',"lang":"' || lang || '","source":"' || source || '","blocks":[' || blocks || ']}}' AS j FROM documents JOIN b USING (doc_id))
SELECT doc_id, sha256('<!doctype html><html><head><meta charset="utf-8"><title>a &lt; b</title></head><body><script id="snapshot" type="application/json">' || replace(j, '<', '\\u003c') || '</script></body></html>') AS page_sha256, length(j)::BIGINT AS n_chars FROM s""",
    "issue_asset_rollup": f"""
SELECT source, kind, count(*)::BIGINT AS n_blocks, grouping(source, kind)::BIGINT AS level FROM (SELECT doc_id, {_KIND} AS kind FROM ({_LINES})) JOIN documents USING (doc_id) GROUP BY ROLLUP (source, kind)""",
    "partition_of_merged": f"SELECT true AS ok, count(DISTINCT doc_id)::BIGINT AS n_documents, count(*)::BIGINT AS n_atoms FROM ({_LINES})",
}
