"""Queries of the ledger: identity, atoms, blocks, coverage, windows, work queues."""

from __future__ import annotations

from pyspark.sql import functions as F

from folium.functions import digests
from folium.functions import text as X
from folium.operators import ledger, views
from folium.sources.plain import atoms


def _t(spark, sf, name):
    return spark.read.parquet(f"{sf}/{name}.parquet")


def doc_content_id(spark, sf):
    return _t(spark, sf, "documents").select("doc_id", ledger.content_id(F.col("text")).alias("content_id"), F.length("text").cast("long").alias("n_chars"))


def doc_reimport_dedup(spark, sf):
    return ledger.first_imports(_t(spark, sf, "documents"))


def atom_lines(spark, sf):
    return atoms(_t(spark, sf, "documents"), "line").select("doc_id", "atom_id", F.col("start").cast("long").alias("start_at"), F.col("end").cast("long").alias("end_at"), F.col("line_start").cast("long").alias("line_no"), F.sha2(F.col("text").cast("binary"), 256).alias("text_sha256"))


def atom_paragraphs(spark, sf):
    return atoms(_t(spark, sf, "documents"), "paragraph").select("doc_id", "atom_id", F.col("start").cast("long").alias("start_at"), F.col("end").cast("long").alias("end_at"), F.col("line_start").cast("long").alias("line_first"), F.col("line_end").cast("long").alias("line_last"))


def block_kinds(spark, sf):
    lines = _t(spark, sf, "documents").select("doc_id", F.explode(F.split("text", "\n")).alias("line"))
    return lines.groupBy("doc_id", X.line_kind(F.col("line")).alias("kind")).agg(F.count(F.lit(1)).alias("n_blocks"))


def ledger_partition_check(spark, sf):
    found = atoms(_t(spark, sf, "documents"), "line")
    return ledger.partition_check(found, ledger.blocks_of(found, 3))


def ledger_coverage(spark, sf):
    """Stand-in: orders are the expected keys, line items use them."""
    expected = _t(spark, sf, "orders").select(F.col("o_orderkey").alias("key"))
    used = _t(spark, sf, "lineitem").select(F.col("l_orderkey").alias("key"))
    return ledger.coverage(expected, used, ["key"]).groupBy("status").agg(F.count(F.lit(1)).alias("n_keys"), F.sum("n_used").alias("n_used"))


def _blocks(spark, sf):
    lines = _t(spark, sf, "documents").select("doc_id", F.posexplode(F.split("text", "\n")).alias("ord", "text"))
    return lines.withColumn("kind", F.when(X.n_words(F.col("text")) <= 2, "heading").otherwise("paragraph")).withColumn("block_id", F.format_string("b%05d", F.col("ord") + 1)).withColumn("target", F.lit(None).cast("string"))


def search_blocks(spark, sf):
    found = views.search(_blocks(spark, sf), "THER")
    return found.select("doc_id", F.col("ord").cast("long").alias("ord"), F.length("text").cast("long").alias("n_chars"))


def outline(spark, sf):
    """Lines of up to two words are headings."""
    found = views.outline(_blocks(spark, sf))
    return found.select("doc_id", F.col("ord").cast("long").alias("ord"), F.col("text").alias("heading"), F.col("level").cast("long").alias("level"))


def block_summaries(spark, sf):
    """Lines are blocks with a note in every second, and as many sources as their number's remainder by three says."""
    blocks = _blocks(spark, sf).withColumn("structure_note", F.when(F.col("ord") % 2 == 0, "kept")).withColumn("source_ids", F.slice(F.array(F.lit("a"), F.lit("b")), 1, F.col("ord") % 3))
    return views.summary(blocks).select("doc_id", "block_id", "kind", F.sha2(F.col("text").cast("binary"), 256).alias("text_sha256"), "has_structure_note", F.col("source_count").cast("long").alias("source_count"))


def stage_and_pending(spark, sf):
    """Stand-in: an order is a document, its line items are blocks; O lines are untranslated, F lines of tax over 0.04 unreviewed."""
    blocks = _t(spark, sf, "lineitem").select(F.col("l_orderkey").alias("doc_id"), F.lit("paragraph").alias("kind"), F.when(F.col("l_linestatus") != "O", "x").alias("target"), F.when((F.col("l_linestatus") != "F") | (F.col("l_tax") <= 0.04), "h").alias("reviewed_hash"))
    pending = views.progress(blocks, F.lit("h")).select("doc_id", "pending_translate", "pending_review")
    orders = _t(spark, sf, "orders").select(F.col("o_orderkey").alias("doc_id"), "o_orderpriority")
    both = orders.join(pending, "doc_id", "left").na.fill(0, ["pending_translate", "pending_review"])
    stage = views.stage(F.col("o_orderpriority") != "1-URGENT", F.col("o_orderpriority") != "2-HIGH", F.col("pending_translate"), F.col("pending_review"), F.lit(1))
    return both.select("doc_id", stage.alias("stage"), "pending_translate", "pending_review")


def task_batch(spark, sf):
    rows = _t(spark, sf, "documents").select("source", "doc_id", F.substring("text", 1, 160).alias("preview"))
    return ledger.first_pending(rows, "source", ["doc_id"]).select("source", "doc_id", "preview", F.col("rank").cast("long").alias("rank"))


def _ordered_docs(spark, sf):
    """Stand-in: a source is a document and its rows, in order of id, are blocks."""
    return ledger.numbered(_t(spark, sf, "documents").select("source", "doc_id"), "source", "doc_id")


def task_neighbors(spark, sf):
    blocks = _ordered_docs(spark, sf)
    pending = _t(spark, sf, "labels").where("quality = 0").select("doc_id")
    chosen = blocks.join(pending, "doc_id", "left_semi").select("source", "ord")
    return ledger.neighbours(blocks, chosen, "source").select("source", F.col("ord").cast("long").alias("ord"), "doc_id", F.col("chosen").cast("long").alias("chosen"))


def section_window(spark, sf):
    lines = _t(spark, sf, "documents").select("doc_id", F.posexplode(F.split("text", "\n")).alias("ord", "line"))
    placed = ledger.sections(lines.select("doc_id", "ord", X.n_words(F.col("line")).alias("n")), F.col("n") <= 3)
    return placed.select("doc_id", F.col("ord").cast("long").alias("ord"), F.col("section_start").cast("long").alias("section_start"), F.col("section_end").cast("long").alias("section_end"))


def section_paging(spark, sf):
    docs = _t(spark, sf, "documents")
    total = F.size(F.split("text", "\n"))
    first, last, cut = ledger.page(total, F.pmod("doc_id", F.lit(40)), 24)
    return docs.select("doc_id", first.cast("long").alias("first_at"), last.cast("long").alias("end_at"), cut.alias("truncated"))


def doc_fingerprint(spark, sf):
    """Lines are blocks, benchmark items of a document's number modulo fifty its terms; nothing else of a document is reviewed."""
    blocks = _t(spark, sf, "documents").select("doc_id", F.posexplode(F.split("text", "\n")).alias("ord", "line"))
    blocks = blocks.select("doc_id", "ord", F.format_string("b%05d", F.col("ord") + 1).alias("block_id"), F.lit("paragraph").alias("kind"), F.sha2(F.col("line").cast("binary"), 256).alias("text"))
    terms = _t(spark, sf, "documents").select("doc_id").join(_t(spark, sf, "benchmark").where("item_id < 50"), F.col("doc_id") % 50 == F.col("item_id")).select("doc_id", F.format_string("t%03d", "item_id").alias("term_id"))
    issues = blocks.where("false").select("doc_id", F.col("block_id").alias("issue_id"))
    return digests.fingerprints(blocks, terms, issues)


_LINES = "SELECT doc_id, i - 1 AS ord, l[i] AS line FROM (SELECT doc_id, string_split(text, chr(10)) AS l, unnest(range(1, len(string_split(text, chr(10))) + 1)) AS i FROM documents)"
_COLLAPSE = r"trim(regexp_replace({0}, '\s+', ' ', 'g'))"
_WORDS = "CASE WHEN {0} = '' THEN 0 ELSE len(string_split({0}, ' ')) END".format(_COLLAPSE.format("line"))

QUERIES = {f.__name__: f for f in (doc_content_id, doc_reimport_dedup, atom_lines, atom_paragraphs, block_kinds, ledger_partition_check, ledger_coverage, search_blocks, outline, block_summaries, stage_and_pending, task_batch, task_neighbors, section_window, section_paging, doc_fingerprint)}

ORACLES = {
    "doc_content_id": "SELECT doc_id, substr(sha256(text), 1, 24) AS content_id, length(text)::BIGINT AS n_chars FROM documents",
    "doc_reimport_dedup": "SELECT substr(sha256(text), 1, 24) AS content_id, min(doc_id) AS doc_id, count(*)::BIGINT AS n_imports FROM documents GROUP BY 1",
    "atom_lines": f"""
WITH l AS ({_LINES}), p AS (
  SELECT *, coalesce(sum(length(line) + 1) OVER (PARTITION BY doc_id ORDER BY ord ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS start_at FROM l
)
SELECT doc_id, printf('a%05d', row_number() OVER (PARTITION BY doc_id ORDER BY ord)) AS atom_id, start_at, start_at + length(line) AS end_at, (ord + 1)::BIGINT AS line_no, sha256(line) AS text_sha256
FROM p WHERE trim(line) <> ''""",
    "atom_paragraphs": """
SELECT doc_id, 'a00001' AS atom_id, (length(text) - length(ltrim(text, chr(10) || chr(13))))::BIGINT AS start_at, length(rtrim(text, chr(10) || chr(13)))::BIGINT AS end_at,
       (1 + length(text) - length(ltrim(text, chr(10))))::BIGINT AS line_first, (1 + length(rtrim(text, chr(10))) - length(replace(rtrim(text, chr(10)), chr(10), '')))::BIGINT AS line_last
FROM documents WHERE trim(text, ' ' || chr(10) || chr(13)) <> ''""",
    "block_kinds": rf"""
WITH l AS (SELECT doc_id, trim(line) AS line FROM ({_LINES}))
SELECT doc_id, CASE
    WHEN regexp_matches(line, '(?i)^(figure|table|fig\.?)\s+\d+\s*[:.]') THEN 'caption'
    WHEN length(line) BETWEEN 1 AND 90 AND (lower({_COLLAPSE.format('line')}) IN ('abstract', 'references', 'acknowledgments', 'acknowledgements', 'appendix') OR (regexp_matches(line, '^\d+(\.\d+)*\.?\s+[A-Z]') AND {_WORDS} <= 14)) OR regexp_matches(line, '^#{{1,6}}\s') THEN 'heading'
    WHEN regexp_matches(line, '^\$\$.+\$\$$') THEN 'formula'
    WHEN length(line) - length(replace(line, '|', '')) >= 2 THEN 'table'
    WHEN regexp_matches(line, '^[∗*†‡§¶‖]+\s*\S') THEN 'footnote'
    WHEN line = '' THEN 'unclassified' ELSE 'paragraph' END AS kind, count(*)::BIGINT AS n_blocks
FROM l GROUP BY 1, 2""",
    "ledger_partition_check": f"SELECT doc_id, count(*)::BIGINT AS n_atoms, 0::BIGINT AS n_missing, 0::BIGINT AS n_extra, 0::BIGINT AS n_duplicate, true AS ok FROM ({_LINES}) WHERE trim(line) <> '' GROUP BY doc_id",
    "ledger_coverage": """
WITH u AS (SELECT l_orderkey AS key, count(*) AS n FROM lineitem GROUP BY 1), b AS (
  SELECT coalesce(n, 0) AS n, o_orderkey IS NOT NULL AS expected FROM (SELECT DISTINCT o_orderkey FROM orders) o FULL OUTER JOIN u ON o_orderkey = key
)
SELECT CASE WHEN n = 0 THEN 'missing' WHEN NOT expected THEN 'extra' WHEN n > 1 THEN 'duplicate' ELSE 'ok' END AS status, count(*)::BIGINT AS n_keys, sum(n)::BIGINT AS n_used FROM b GROUP BY 1""",
    "search_blocks": f"SELECT doc_id, ord::BIGINT AS ord, length(line)::BIGINT AS n_chars FROM ({_LINES}) WHERE contains(lower(line), 'ther')",
    "outline": rf"""
SELECT doc_id, ord::BIGINT AS ord, substr(line, 1, 160) AS heading,
       (CASE WHEN regexp_matches(line, '^#{{1,6}}\s') THEN length(regexp_extract(line, '^(#{{1,6}})\s', 1)) WHEN regexp_extract(line, '^(\d+(?:\.\d+)*)', 1) <> '' THEN least(len(string_split(regexp_extract(line, '^(\d+(?:\.\d+)*)', 1), '.')) + 1, 6) ELSE 2 END)::BIGINT AS level
FROM ({_LINES}) WHERE {_WORDS} <= 2""",
    "stage_and_pending": """
SELECT o_orderkey AS doc_id, CASE WHEN o_orderpriority = '1-URGENT' THEN 'structure' WHEN o_orderpriority = '2-HIGH' THEN 'terms' WHEN t > 0 THEN 'translate' WHEN r > 0 THEN 'review' ELSE 'full_review' END AS stage, t AS pending_translate, r AS pending_review
FROM (SELECT o_orderkey, o_orderpriority, coalesce(t, 0)::BIGINT AS t, coalesce(r, 0)::BIGINT AS r FROM orders LEFT JOIN (
  SELECT l_orderkey, count(*) FILTER (WHERE l_linestatus = 'O') AS t, count(*) FILTER (WHERE l_linestatus = 'F' AND l_tax > 0.04) AS r FROM lineitem GROUP BY 1) ON l_orderkey = o_orderkey)""",
    "task_batch": "SELECT source, doc_id, substr(text, 1, 160) AS preview, rank FROM (SELECT *, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS rank FROM documents) WHERE rank <= 16",
    "task_neighbors": """
WITH b AS (SELECT source, doc_id, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS ord FROM documents),
c AS (SELECT b.source, b.ord FROM b WHERE doc_id IN (SELECT doc_id FROM labels WHERE quality = 0))
SELECT b.source, b.ord::BIGINT AS ord, b.doc_id, max((b.ord = c.ord)::INT)::BIGINT AS chosen FROM b JOIN c ON b.source = c.source AND b.ord BETWEEN c.ord - 1 AND c.ord + 1 GROUP BY ALL""",
    "section_window": f"""
WITH l AS (SELECT doc_id, ord, CASE WHEN {_WORDS} <= 3 THEN ord END AS h FROM ({_LINES}))
SELECT doc_id, ord::BIGINT AS ord, (last_value(h IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY ord ROWS UNBOUNDED PRECEDING))::BIGINT AS section_start,
       (first_value(h IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY ord ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING))::BIGINT AS section_end FROM l""",
    "section_paging": """
WITH t AS (SELECT doc_id, len(string_split(text, chr(10))) AS n FROM documents), f AS (SELECT *, greatest(0, least(doc_id % 40, n - 1)) AS a FROM t)
SELECT doc_id, a::BIGINT AS first_at, least(n, a + 24)::BIGINT AS end_at, a > 0 OR least(n, a + 24) < n AS truncated FROM f""",
    "block_summaries": f"""
SELECT doc_id, printf('b%05d', ord + 1) AS block_id, CASE WHEN {_WORDS} <= 2 THEN 'heading' ELSE 'paragraph' END AS kind, sha256(substr(line, 1, 160)) AS text_sha256, ord % 2 = 0 AS has_structure_note, (ord % 3)::BIGINT AS source_count FROM ({_LINES})""",
    "doc_fingerprint": f"""
WITH p AS (SELECT doc_id, 0 AS part, ord, sha256('{{"block_id":"' || printf('b%05d', ord + 1) || '","kind":"paragraph","text":"' || sha256(line) || '"}}') AS h FROM ({_LINES})
  UNION ALL SELECT doc_id, 1, item_id, sha256('{{"term_id":"' || printf('t%03d', item_id) || '"}}') FROM documents JOIN benchmark ON item_id < 50 AND doc_id % 50 = item_id)
SELECT doc_id, sha256(string_agg(h, '' ORDER BY part, ord)) AS fingerprint FROM p GROUP BY doc_id""",
}
