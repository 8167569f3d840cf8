"""Queries of the importers over pages, and of event windows."""

from __future__ import annotations

import io
import zipfile

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T

from folium.functions import text as X
from folium.operators import ledger, mutation, regions, views
from folium.sources import files
from folium.streaming import ingest


def _t(spark, sf, name):
    return spark.read.parquet(f"{sf}/{name}.parquet")


def _as_files(table, key, text, suffix):
    return table.select(F.concat(F.col(key).cast("string"), F.lit(suffix)).alias("path"), F.encode(F.coalesce(text, F.lit("")), "UTF-8").alias("content"))


def _import(table, key, text, suffix):
    return files.import_rows(_as_files(table, key, text, suffix))


def _pages(spark, sf):
    return files.fragments_of(_import(_t(spark, sf, "pages"), "page_id", F.col("html"), ".html"))


def _result(rows):
    return rows.select("path", "doc_id", "block_id", "kind", F.sha2(F.col("text").cast("binary"), 256).alias("text_sha256"), F.col("start").cast("long").alias("start_at"), F.col("end").cast("long").alias("end_at"))


def html_blocks(spark, sf):
    """Blocks of pages, and whether each stands at its place in the page as it is."""
    html = _t(spark, sf, "pages").select(F.concat(F.col("page_id").cast("string"), F.lit(".html")).alias("path"), "html")
    there = F.substr("html", F.col("start") + 1, F.col("end") - F.col("start")) == F.col("text")
    return _pages(spark, sf).join(html, "path").select("path", "doc_id", "block_id", "kind", F.sha2(F.col("text").cast("binary"), 256).alias("text_sha256"), there.alias("located"))


def _marked():
    """A text of words and stops, its lines marked, so that only what is put around it has a meaning in Markdown, TeX or Word."""
    return F.concat(F.lit("w "), F.regexp_replace(F.regexp_replace("text", r"[^\p{L}\p{N} .,\n]", ""), r"\n", "\nw "))


def markdown_blocks(spark, sf):
    """Documents between a heading, a fence, a table, a formula, a list and an image."""
    number = F.col("doc_id").cast("string")
    text = F.concat(F.lit("# Doc "), number, F.lit("\n\n"), _marked(), F.lit("\n\n```\n"), _marked(), F.lit("\n```\n\n| a | b |\n|---|---|\n| 1 | "), number, F.lit(" |\n\n$$x="), number, F.lit("$$\n\n- one\n- two\n\n![far](http://e.org/a.png)\n"))
    return _result(files.fragments_of(_import(_t(spark, sf, "documents"), "doc_id", text, ".md")))


def tex_blocks(spark, sf):
    """Documents between a title, a section, an equation, a verbatim and an environment that is not known."""
    number = F.col("doc_id").cast("string")
    text = F.concat(F.lit("\\documentclass{article} % gone\n\\title{Doc \\textbf{"), number, F.lit("}}\n\\begin{document}\n\\section*{Intro "), number, F.lit("}\n"), _marked(), F.lit("\n\\begin{equation}x="), number, F.lit("\\end{equation}\n\\begin{verbatim}\n"), _marked(), F.lit("\n\\end{verbatim}\n\\begin{odd}kept\\end{odd}\n\\end{document}\n"))
    return _result(files.fragments_of(_import(_t(spark, sf, "documents"), "doc_id", text, ".tex"))).drop("start_at", "end_at")


_W = "http://schemas.openxmlformats.org/wordprocessingml/2006/main"
_RELATED = "http://schemas.openxmlformats.org/officeDocument/2006/relationships"


@F.pandas_udf(T.BinaryType())
def _as_docx(text: pd.Series, number: pd.Series) -> pd.Series:
    """Word files with a heading, a paragraph for each line, a raised word, a hidden one, an image 40 by 30, cut at the left, and a table."""

    def one(lines: list[str], n: int) -> bytes:
        run = lambda x, more="": f'<w:r><w:rPr>{more}</w:rPr><w:t xml:space="preserve">{x}</w:t></w:r>'
        paragraphs = "".join(f"<w:p>{run(x)}</w:p>" for x in lines)
        image = f'<w:p><w:r><w:drawing><a:blipFill xmlns:a="http://schemas.openxmlformats.org/drawingml/2006/main" xmlns:r="{_RELATED}"><a:blip r:embed="r1"/><a:srcRect l="25000"/></a:blipFill></w:drawing></w:r></w:p>'
        cell = lambda x: f"<w:tc><w:p>{run(x)}</w:p></w:tc>"
        odd = f"<w:p>{run('x')}{run('2', '<w:vertAlign w:val=\"superscript\"/>')}{run('gone', '<w:vanish/>')}</w:p>"
        body = f"<w:document xmlns:w='{_W}'><w:body><w:p><w:pPr><w:pStyle w:val='Heading1'/></w:pPr>{run(f'Doc {n}')}</w:p>{paragraphs}{odd}{image}<w:tbl><w:tr>{cell('a')}{cell(n)}</w:tr></w:tbl></w:body></w:document>"
        out = io.BytesIO()
        with zipfile.ZipFile(out, "w") as made:
            held = {"word/document.xml": body.encode(), "word/_rels/document.xml.rels": b'<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships"><Relationship Id="r1" Target="media/i.png"/></Relationships>', "word/media/i.png": b"\x89PNG\r\n\x1a\n\0\0\0\rIHDR\0\0\0\x28\0\0\0\x1e"}
            for name, content in held.items():
                made.writestr(zipfile.ZipInfo(name), content)
        return out.getvalue()

    return pd.Series([one(t.split("\n"), n) for t, n in zip(text, number, strict=True)])


def _word_files(spark, sf):
    return _t(spark, sf, "documents").select(F.concat(F.col("doc_id").cast("string"), F.lit(".docx")).alias("path"), _as_docx(_marked(), F.col("doc_id")).alias("content"))


def docx_blocks(spark, sf):
    """Blocks of Word documents; a table of their numbers makes all of them different."""
    rows = files.fragments_of(files.import_rows(_word_files(spark, sf)))
    return rows.select("path", "block_id", "kind", F.sha2(F.col("text").cast("binary"), 256).alias("text_sha256"), F.col("start").cast("long").alias("start_at"))


def docx_images(spark, sf):
    """Images of Word documents with the box that is left of them."""
    found = files.images_of_documents(_word_files(spark, sf))
    cut = [F.coalesce(f"cut_{side}", F.lit(0)) for side in ("left", "top", "right", "bottom")]
    box = regions.source_crop(F.col("width"), F.col("height"), *cut)
    counted = found.groupBy("block_id", "asset", F.octet_length("content").cast("long").alias("n_bytes"), box.alias("b")).agg(F.count(F.lit(1)).alias("n"))
    return counted.select("block_id", "asset", "n_bytes", *[F.col(f"b.{c}").cast("long").alias(c) for c in ("x0", "y0", "x1", "y1")], "n")


def text_import(spark, sf):
    return _result(files.fragments_of(_import(_t(spark, sf, "documents"), "doc_id", F.col("text"), ".txt")))


def import_issues(spark, sf):
    """Each third document gets a last paragraph that is a remote image, which no importer fetches."""
    text = F.when(F.col("doc_id") % 3 == 0, F.concat("text", F.lit("\n\n![far](http://example.org/a.png)\n"))).otherwise(F.col("text"))
    found = files.import_rows(_as_files(_t(spark, sf, "documents"), "doc_id", text, ".md"))
    return files.issues_of(found).groupBy(X.issue_prefix(F.col("issue_id")).alias("category")).agg(F.count(F.lit(1)).alias("n"))


def html_script_stripped(spark, sf):
    """Characters and blocks of each page, and blocks that hold what only scripts and styles say."""
    hidden = F.col("text").contains("track(") | F.col("text").contains("margin:0")
    return _pages(spark, sf).groupBy("path").agg(F.sum(F.length("text")).alias("n_chars"), F.count(F.lit(1)).alias("n_blocks"), F.count(F.when(hidden, 1)).alias("n_hidden"))


def html_title_outline(spark, sf):
    return views.outline(_pages(spark, sf)).select("doc_id", "block_id", F.col("text").alias("heading"), F.col("level").cast("long").alias("level"))


def html_list_text(spark, sf):
    """Paragraphs of each page in order; a list that is no block of its own is one."""
    rows = _pages(spark, sf).where("kind = 'paragraph'").groupBy("path").agg(F.array_sort(F.collect_list(F.struct("ord", "text"))).alias("p"))
    return rows.select("path", F.size("p").cast("long").alias("n_items"), F.sha2(F.array_join(F.col("p.text"), "\n").cast("binary"), 256).alias("text_sha256"))


def html_partition(spark, sf):
    """Every atom of the importer is in exactly one block."""
    rows = _pages(spark, sf)
    found = ledger.partition_check(rows.select("doc_id", "atom_id"), rows.select("doc_id", F.array("atom_id").alias("source_ids")))
    return found.groupBy("ok").agg(F.count(F.lit(1)).alias("n_documents"))


def images_linked(spark, sf):
    """Markdown documents and pages show an image beside them that every second folder holds, and one that is far."""
    number = F.col("doc_id").cast("string")
    text = F.concat(_marked(), F.lit("\n\n![near](i"), number, F.lit(".png)\n\n![far](//e.org/x.png)\n"))
    docs = _t(spark, sf, "documents").select(F.concat(F.lit("d"), number, F.lit("/a.md")).alias("path"), F.encode(text, "UTF-8").alias("content"))
    page = F.col("page_id").cast("string")
    html = F.concat(F.lit("<p>x<img src='i"), page, F.lit(".png'></p>"))
    pages = _t(spark, sf, "pages").select(F.concat(F.lit("d"), page, F.lit("/b.html")).alias("path"), F.encode(html, "UTF-8").alias("content"))
    there = _t(spark, sf, "documents").where("doc_id % 2 = 0").select(F.concat(F.lit("d"), number, F.lit("/i"), number, F.lit(".png")).alias("path"))
    found = regions.local_images(files.image_links(docs.unionByName(pages)), there)
    return found.select("folder", "block_id", "target", "asset", "copied_from", "issue_id")


def files_supported(spark, sf):
    """Documents are files of kinds that importers know and do not know, in any case."""
    suffix = F.element_at(F.array(*[F.lit(x) for x in (".txt", ".MD", ".doc", "", ".TeX", ".html.bak")]), (F.col("doc_id") % 6 + 1).cast("int"))
    paths = _t(spark, sf, "documents").select(F.concat(F.lit("in/"), F.col("doc_id").cast("string"), suffix).alias("path"))
    return files.supported(paths)


def known_files_left_out(spark, sf):
    """Documents of an even number were imported before; what is imported now are contents that none of them has."""
    docs = _t(spark, sf, "documents")
    known = docs.where("doc_id % 2 = 0").select(ledger.content_id(F.col("text")).alias("doc_id"))
    rows = files.import_rows(_as_files(docs, "doc_id", F.col("text"), ".txt"), known)
    return rows.select("doc_id").distinct()


def assets_served(spark, sf):
    """Requests for the images of orders: those that a line item or the order's page names are served."""
    items = _t(spark, sf, "lineitem").select(F.col("l_orderkey").alias("doc_id"), F.when(F.col("l_tax") > 0.04, F.concat(F.lit("p"), F.col("l_linenumber").cast("string"), F.lit(".png"))).alias("asset"))
    pages = _t(spark, sf, "orders").select(F.col("o_orderkey").alias("doc_id"), F.when(F.col("o_orderstatus") == "F", "page.png").alias("asset"))
    requests = _t(spark, sf, "orders").select(F.col("o_orderkey").alias("doc_id"), F.explode(F.array(F.lit("p1.png"), F.lit("page.png"), F.lit("../x"))).alias("asset"))
    return regions.served_assets(requests, items, pages)


def documents_listed(spark, sf):
    docs = _t(spark, sf, "documents").select("doc_id", F.col("source").alias("title"), F.lit("translate").alias("stage"), (F.col("doc_id") % 9).alias("revision"))
    return views.listing(docs)


def rows_upserted(spark, sf):
    """Suppliers of an even number change their balance, every tenth goes, and customers of small numbers come in."""
    table = _t(spark, sf, "supplier").select(F.col("s_suppkey").alias("key"), F.col("s_acctbal").alias("value"))
    changes = table.where("key % 2 = 0").withColumn("value", F.lit(0.0)).unionByName(_t(spark, sf, "customer").where("c_custkey <= 50").select((F.col("c_custkey") + 1_000_000).alias("key"), F.col("c_acctbal").alias("value")))
    return mutation.upsert(table, changes, ["key"], deleted=F.col("key") % 10 == 0)


def event_windows(spark, sf):
    return ingest.event_windows(_t(spark, sf, "events")).withColumn("window_start", F.date_format("window_start", "yyyy-MM-dd"))


QUERIES = {f.__name__: f for f in (html_blocks, markdown_blocks, tex_blocks, docx_blocks, docx_images, text_import, import_issues, html_script_stripped, html_title_outline, html_list_text, html_partition, images_linked, files_supported, known_files_left_out, assets_served, documents_listed, rows_upserted, event_windows)}

_CLEAN = r"""trim(regexp_replace(replace(replace(replace(replace(replace(replace(regexp_replace(regexp_replace({0}, '</?p>|<br>|</?li>', ' ', 'g'), '<[^>]*>', '', 'g'), '&quot;', '"'), '&copy;', '©'), '&middot;', '·'), '&lt;', '<'), '&gt;', '>'), '&amp;', '&'), '\s+', ' ', 'g'))"""
#: The pages' blocks: the navigation, whose list is no block, the advertisement, the heading, an article whose first paragraph never closes, the footer.
_HTML = rf"""
WITH h AS (SELECT min(page_id::VARCHAR || '.html') AS path, html, regexp_replace(regexp_replace(html, '(?s)<(?:script\b.*?</script|style\b.*?</style)>', '', 'g'), '(?s)<!--.*?-->', '', 'g') AS b FROM pages GROUP BY html),
p AS (SELECT path, html, list_concat(list_concat(list_transform(regexp_extract_all(b, '(?s)<ul>(.*?)</ul>', 1), lambda x: {{'k': 'paragraph', 't': x}}), list_transform(regexp_extract_all(b, '(?s)<div[^>]*>(.*?)</div>', 1), lambda x: {{'k': 'paragraph', 't': x}})),
  [{{'k': 'heading', 't': regexp_extract(b, '(?s)<h1>(.*?)</h1>', 1)}}, {{'k': 'paragraph', 't': regexp_extract(b, '(?s)</h1>(.*)</article>', 1)}}, {{'k': 'paragraph', 't': regexp_extract(b, '(?s)<footer>(.*?)</footer>', 1)}}]) AS l FROM h),
u AS (SELECT path, html, i, l[i].k AS kind, {_CLEAN.format('l[i].t')} AS text FROM (SELECT *, unnest(range(1, len(l) + 1)) AS i FROM p)),
r AS (SELECT path, substr(sha256(html), 1, 24) AS doc_id, row_number() OVER (PARTITION BY path ORDER BY i) AS ord, kind, text, contains(html, text) AS located FROM u WHERE text <> '')"""
_BARE_SQL = r"regexp_replace(text, '[^\pL\pN .,\n]', '', 'g')"
_MARKED_SQL = f"'w ' || replace({_BARE_SQL}, chr(10), chr(10) || 'w ')"

ORACLES = {
    "text_import": """
SELECT min(doc_id::VARCHAR || '.txt') AS path, substr(sha256(text), 1, 24) AS doc_id, 'b00001' AS block_id, 'paragraph' AS kind, sha256(trim(text, chr(10) || chr(13))) AS text_sha256,
       (length(text) - length(ltrim(text, chr(10) || chr(13))))::BIGINT AS start_at, length(rtrim(text, chr(10) || chr(13)))::BIGINT AS end_at
FROM documents WHERE trim(text, ' ' || chr(10) || chr(13)) <> '' GROUP BY text""",
    "import_issues": "SELECT 'image' AS category, count(DISTINCT text)::BIGINT AS n FROM documents WHERE doc_id % 3 = 0",
    "html_blocks": _HTML + " SELECT path, doc_id, printf('b%05d', ord) AS block_id, kind, sha256(text) AS text_sha256, located FROM r",
    "html_script_stripped": _HTML + " SELECT path, sum(length(text))::BIGINT AS n_chars, count(*)::BIGINT AS n_blocks, 0::BIGINT AS n_hidden FROM r GROUP BY path",
    "html_title_outline": _HTML + " SELECT doc_id, printf('b%05d', ord) AS block_id, substr(text, 1, 160) AS heading, 2::BIGINT AS level FROM r WHERE kind = 'heading'",
    "html_list_text": _HTML + " SELECT path, count(*)::BIGINT AS n_items, sha256(string_agg(text, chr(10) ORDER BY ord)) AS text_sha256 FROM r WHERE kind = 'paragraph' GROUP BY path",
    "markdown_blocks": rf"""
WITH d AS (SELECT doc_id, doc_id::VARCHAR AS n, {_MARKED_SQL} AS w FROM documents),
p AS (SELECT doc_id, unnest([{{'k': 'heading', 't': '# Doc ' || n, 'g': 2}}, {{'k': 'paragraph', 't': w, 'g': 2}}, {{'k': 'code', 't': '```' || chr(10) || w || chr(10) || '```', 'g': 2}}, {{'k': 'table', 't': '| a | b |' || chr(10) || '|---|---|' || chr(10) || '| 1 | ' || n || ' |', 'g': 2}},
  {{'k': 'formula', 't': '$$x=' || n || '$$', 'g': 2}}, {{'k': 'paragraph', 't': '- one' || chr(10) || '- two', 'g': 2}}, {{'k': 'figure', 't': '![far](http://e.org/a.png)', 'g': 1}}]) AS b, unnest(range(1, 8)) AS i FROM d),
s AS (SELECT *, coalesce(sum(length(b.t) + b.g) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS start_at FROM p),
whole AS (SELECT doc_id, substr(sha256(string_agg(b.t || repeat(chr(10), b.g), '' ORDER BY i)), 1, 24) AS id FROM p GROUP BY doc_id)
SELECT doc_id::VARCHAR || '.md' AS path, id AS doc_id, printf('b%05d', i) AS block_id, b.k AS kind, sha256(b.t) AS text_sha256, start_at, (start_at + length(b.t) + 1)::BIGINT AS end_at FROM s JOIN whole USING (doc_id)""",
    "tex_blocks": rf"""
WITH d AS (SELECT doc_id, doc_id::VARCHAR AS n, {_MARKED_SQL} AS w FROM documents),
f AS (SELECT *, substr(sha256('\documentclass{{article}} % gone' || chr(10) || '\title{{Doc \textbf{{' || n || '}}}}' || chr(10) || '\begin{{document}}' || chr(10) || '\section*{{Intro ' || n || '}}' || chr(10) || w || chr(10) || '\begin{{equation}}x=' || n
  || '\end{{equation}}' || chr(10) || '\begin{{verbatim}}' || chr(10) || w || chr(10) || '\end{{verbatim}}' || chr(10) || '\begin{{odd}}kept\end{{odd}}' || chr(10) || '\end{{document}}' || chr(10)), 1, 24) AS id FROM d),
p AS (SELECT n, id, unnest([{{'k': 'heading', 't': 'Doc ' || n}}, {{'k': 'heading', 't': 'Intro ' || n}}, {{'k': 'paragraph', 't': w}}, {{'k': 'formula', 't': 'x=' || n}}, {{'k': 'code', 't': w}}, {{'k': 'paragraph', 't': 'kept'}}]) AS b, unnest(range(1, 7)) AS i FROM f)
SELECT n || '.tex' AS path, id AS doc_id, printf('b%05d', i) AS block_id, b.k AS kind, sha256(trim(b.t, ' ' || chr(10))) AS text_sha256 FROM p""",
    "docx_blocks": rf"""
WITH d AS (SELECT doc_id, string_split({_MARKED_SQL}, chr(10)) AS l FROM documents),
p AS (SELECT doc_id, list_concat(list_concat(['Doc ' || doc_id], l), ['x²', '[image]', 'a | ' || doc_id]) AS t, len(l) AS n FROM d),
u AS (SELECT doc_id, n, unnest(t) AS t, unnest(range(1, len(t) + 1)) AS i FROM p)
SELECT doc_id || '.docx' AS path, printf('b%05d', i) AS block_id, CASE WHEN i = 1 THEN 'heading' WHEN i = n + 3 THEN 'figure' WHEN i = n + 4 THEN 'table' ELSE 'paragraph' END AS kind, sha256(t) AS text_sha256,
       coalesce(sum(length(t) + 1) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS start_at FROM u""",
    "docx_images": f"""
SELECT printf('b%05d', n) AS block_id, printf('image-b%05d.png', n) AS asset, 24::BIGINT AS n_bytes, 10::BIGINT AS x0, 0::BIGINT AS y0, 40::BIGINT AS x1, 30::BIGINT AS y1, count(*)::BIGINT AS n FROM (SELECT len(string_split(text, chr(10))) + 3 AS n FROM documents) GROUP BY 1, 2""",
    "images_linked": """
WITH f AS (SELECT doc_id AS n, 'b00002' AS b FROM documents UNION ALL SELECT page_id, 'b00002' FROM pages), g AS (SELECT n, b, n % 2 = 0 AND n IN (SELECT doc_id FROM documents) AS found FROM f)
SELECT 'd' || n AS folder, b AS block_id, 'i' || n || '.png' AS target, CASE WHEN found THEN 'image-b00002.png' END AS asset, CASE WHEN found THEN 'd' || n || '/i' || n || '.png' END AS copied_from, CASE WHEN NOT found THEN 'image-b00002' END AS issue_id FROM g
UNION ALL SELECT 'd' || doc_id, 'b00003', '//e.org/x.png', NULL, NULL, 'image-b00003' FROM documents""",
    "files_supported": "SELECT 'in/' || doc_id || ['.txt', '.MD', '.doc', '', '.TeX', '.html.bak'][doc_id % 6 + 1] AS path FROM documents WHERE doc_id % 6 IN (0, 1, 4)",
    "known_files_left_out": "SELECT DISTINCT substr(sha256(text), 1, 24) AS doc_id FROM documents WHERE trim(text, ' ' || chr(10) || chr(13)) <> '' AND text NOT IN (SELECT text FROM documents WHERE doc_id % 2 = 0)",
    "assets_served": """
WITH a AS (SELECT DISTINCT l_orderkey AS doc_id, 'p' || l_linenumber || '.png' AS asset FROM lineitem WHERE l_tax > 0.04 UNION SELECT o_orderkey, 'page.png' FROM orders WHERE o_orderstatus = 'F')
SELECT o_orderkey AS doc_id, asset FROM orders JOIN a ON o_orderkey = doc_id WHERE asset IN ('p1.png', 'page.png')""",
    "documents_listed": "SELECT doc_id, source AS title, 'translate' AS stage, doc_id % 9 AS revision FROM documents",
    "rows_upserted": """
SELECT s_suppkey AS key, CASE WHEN s_suppkey % 2 = 0 THEN 0.0 ELSE s_acctbal END::DOUBLE AS value FROM supplier WHERE s_suppkey % 10 <> 0
UNION ALL SELECT c_custkey + 1000000, c_acctbal FROM customer WHERE c_custkey <= 50 AND c_custkey % 10 <> 0""",
    "html_partition": "SELECT true AS ok, count(DISTINCT sha256(html))::BIGINT AS n_documents FROM pages",
    "event_windows": "SELECT strftime(date_trunc('day', ts), '%Y-%m-%d') AS window_start, event_type, count(*)::BIGINT AS n, round(sum(value), 4) AS total FROM events GROUP BY ALL",
}
