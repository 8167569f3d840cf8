"""Queries of page layout over boxes that are derived from the lines of documents.

Stand-in: line n of a document is on page n div 40 in the column (n mod 40) div 20; every tenth line
spans the page. No page geometry is in the tables.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from folium.operators import layout, regions


def boxes(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    lines = docs.select("doc_id", F.posexplode(F.split("text", "\n")).alias("n", "text"))
    slot, column = F.col("n") % 40, F.floor((F.col("n") % 40) / 20)
    full = F.col("n") % 10 == 0
    x0 = F.when(full, 40.0).otherwise(40.0 + 280.0 * column)
    x1 = F.when(full, 560.0).otherwise(x0 + F.least(F.lit(240.0), 5.0 * F.length("text")))
    y0 = 80.0 + 13.0 * (slot % 20)
    return lines.select("doc_id", F.format_string("a%05d", F.col("n") + 1).alias("atom_id"), F.col("n").alias("ord"), (F.floor(F.col("n") / 40) + 1).cast("int").alias("page"), "text", x0.alias("x0"), y0.alias("y0"), x1.alias("x1"), (y0 + 12.0 - (F.length("text") % 5)).alias("y1"), F.lit(600.0).alias("page_w"), F.lit(400.0).alias("page_h"))


def _prose(spark, sf):
    return layout.with_page_size(boxes(spark, sf))


def layout_body_height(spark, sf):
    return layout.body_heights(_prose(spark, sf)).select("doc_id", F.col("page").cast("long").alias("page"), "body_height")


def layout_margins(spark, sf):
    """Pages of four lines: the first line of a page is a running head near its top, the last its number near its foot."""
    lines = boxes(spark, sf).withColumn("page", (F.floor(F.col("ord") / 4) + 1).cast("int"))
    head, foot = F.col("ord") % 4 == 0, F.col("ord") % 4 == 3
    text = F.when(head, F.concat(F.lit("Running  head "), F.col("doc_id").cast("string"))).when(foot, (F.col("page") % 2000).cast("string")).otherwise(F.col("text"))
    lines = lines.withColumn("text", text).withColumn("y0", F.when(head, 10.0).when(foot, 380.0).otherwise(F.col("y0"))).withColumn("y1", F.when(head, 20.0).when(foot, 390.0).otherwise(F.col("y1")))
    found = layout.mark_margins(layout.with_page_size(lines))
    return found.where(F.col("kind").isin("header", "footer")).select("doc_id", "atom_id", "kind", "margin_flag")


def layout_gutter(spark, sf):
    found = layout.gutters(_prose(spark, sf))
    return found.select("doc_id", F.col("page").cast("long").alias("page"), "gutter", "n_left", "n_right", "n_straddling")


def layout_columns(spark, sf):
    return layout.assign_columns(_prose(spark, sf)).select("doc_id", "atom_id", "column")


def layout_reading_order(spark, sf):
    sided = _prose(spark, sf).withColumn("column", F.when(F.col("ord") % 10 == 0, "full").when(F.col("x0") < 300, "left").otherwise("right"))
    return layout.reading_order(sided).select("doc_id", "atom_id", F.col("place").cast("long").alias("place"))


def layout_micro_host(spark, sf):
    """Every seventh line becomes a glyph of 8 by 6 points."""
    lines = _prose(spark, sf)
    glyph = F.col("ord") % 7 == 3
    shrunk = lines.withColumn("text", F.when(glyph, "x").otherwise(F.col("text"))).withColumn("x1", F.when(glyph, F.col("x0") + 8).otherwise(F.col("x1"))).withColumn("y0", F.when(glyph, F.col("y0") - 4).otherwise(F.col("y0"))).withColumn("y1", F.when(glyph, F.col("y0") + 6).otherwise(F.col("y1")))
    return layout.micro_hosts(shrunk).select("doc_id", "atom_id", "host_id")


def _book(spark, sf):
    """Stand-in: pages of two long lines that belong together, letters only, with a page number and, from three pages on, a running head."""
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    lines = docs.select("doc_id", F.size(F.split("text", "\n")).alias("n_lines"), F.posexplode(F.split("text", "\n")).alias("n", "text"))
    lines = lines.select("doc_id", "n", (F.floor(F.col("n") / 2) + 1).cast("int").alias("page"), F.floor((F.col("n_lines") + 1) / 2).alias("pages"), F.concat(F.lit("word "), F.regexp_replace("text", r"[^\p{L} ]", "")).alias("text"))
    top = 100.0 + 13.0 * (F.col("n") % 2)
    body = lines.select("doc_id", F.format_string("a%05d", F.col("n") + 1).alias("atom_id"), F.col("n").cast("long").alias("ord"), "page", "text", F.lit(50.0).alias("x0"), top.alias("y0"), F.lit(540.0).alias("x1"), (top + 12).alias("y1"))
    first = lines.where("n % 2 = 0")
    head = first.where("pages >= 3").select("doc_id", F.format_string("h%05d", "page").alias("atom_id"), (F.col("n") + 1_000_000).cast("long").alias("ord"), "page", F.lit("running head").alias("text"), F.lit(50.0).alias("x0"), F.lit(10.0).alias("y0"), F.lit(250.0).alias("x1"), F.lit(20.0).alias("y1"))
    foot = first.select("doc_id", F.format_string("f%05d", "page").alias("atom_id"), (F.col("n") + 2_000_000).cast("long").alias("ord"), "page", (F.col("page") % 1000).cast("string").alias("text"), F.lit(290.0).alias("x0"), F.lit(780.0).alias("y0"), F.lit(310.0).alias("x1"), F.lit(790.0).alias("y1"))
    return body.unionByName(head).unionByName(foot).withColumn("page_w", F.lit(600.0)).withColumn("page_h", F.lit(800.0))


def _shown(found):
    return found.select("doc_id", "id", F.col("page").cast("long").alias("page"), "column", "kind_hint", F.concat_ws(",", "atom_ids").alias("atom_ids"), "confidence", F.concat_ws(",", "hard_spots").alias("hard_spots"))


def layout_candidates(spark, sf):
    return _shown(layout.candidates(_book(spark, sf)))


def layout_two_columns(spark, sf):
    """Candidates of the pages of two columns; tests hold the rules against pages of their own."""
    return _shown(layout.candidates(boxes(spark, sf)))


def hard_spots(spark, sf):
    return layout.hard_spot_counts(layout.candidates(_book(spark, sf)))


def candidate_preview(spark, sf):
    """Documents' candidates as Markdown: how many pages and candidates each shows."""
    from folium.operators import views

    found = views.preview(layout.candidates(_book(spark, sf)))
    return found.select("doc_id", F.regexp_count("preview", F.lit(r"(?m)^## Page ")).cast("long").alias("n_pages"), F.regexp_count("preview", F.lit(r"(?m)^- `c")).cast("long").alias("n_candidates"))


def _words(spark, sf):
    """Stand-in: a line is a row of words 20 points wide and 10 apart, with a wide gap after every fifth, every second one a point lower."""
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    lines = docs.select("doc_id", F.posexplode(F.split("text", "\n")).alias("n", "line"))
    words = lines.select("doc_id", "n", F.posexplode(F.filter(F.split("line", " "), lambda w: w != "")).alias("k", "text"))
    x0 = 30.0 * F.col("k") + 40.0 * F.floor(F.col("k") / 5)
    top = 20.0 * (F.col("n") % 40) + F.col("k") % 2
    return words.select("doc_id", (F.floor(F.col("n") / 40) + 1).cast("int").alias("page"), x0.alias("x0"), top.alias("top"), (x0 + 20).alias("x1"), (top + 10).alias("bottom"), "text")


def lines_of_words(spark, sf):
    found = layout.words_to_lines(_words(spark, sf))
    return found.select("doc_id", F.col("page").cast("long").alias("page"), "x0", "y0", "x1", F.sha2(F.col("text").cast("binary"), 256).alias("text_sha256"))


def low_text_pages(spark, sf):
    """Each line is a page of its own; every fiftieth holds a character that could not be read."""
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    lines = docs.select("doc_id", F.posexplode(F.split("text", "\n")).alias("n", "line"))
    words = lines.select("doc_id", (F.col("n") + 1).cast("int").alias("page"), F.posexplode(F.filter(F.split("line", " "), lambda w: w != "")).alias("k", "w"))
    text = F.when((F.col("page") % 50 == 0) & (F.col("k") == 0), F.concat("w", F.lit("\ufffd"))).otherwise(F.col("w"))
    return layout.low_text_pages(words.select("doc_id", "page", text.alias("text"))).select("doc_id", F.col("page").cast("long").alias("page"), "n_words", "unreadable")


def crop_risks(spark, sf):
    """Parts are images of 20 by 10 pixels with ink along the left, the top or inside; a box of the page is grown where ink touches."""
    k = F.col("p_partkey") % 3
    row = lambda first: F.concat(F.lit(first), F.repeat(F.lit("FF"), 19))
    left = F.repeat(row("00"), 10)
    top = F.concat(F.repeat(F.lit("00"), 20), F.repeat(row("FF"), 9))
    inside = F.concat(F.repeat(row("FF"), 5), F.repeat(F.lit("FF"), 5), F.repeat(F.lit("00"), 8), F.repeat(F.lit("FF"), 7), F.repeat(row("FF"), 4))
    pixels = F.unhex(F.when(k == 0, left).when(k == 1, top).otherwise(inside))
    parts = spark.read.parquet(f"{sf}/part.parquet").select("p_partkey", regions.edge_risks(pixels, F.lit(20)).alias("risks"), (F.col("p_size") * 1.0).alias("x0"), F.lit(5.0).alias("y0"), F.lit(90.0).alias("x1"), F.lit(80.0).alias("y1"))
    box = layout.grown_box(F.col("risks"), F.lit(95.0), F.lit(85.0))
    return parts.select("p_partkey", F.array_join("risks", ",").alias("risks"), box["x0"].alias("x0"), box["y0"].alias("y0"), box["x1"].alias("x1"), box["y1"].alias("y1"))


def crops_named(spark, sf):
    """Parts are boxes to crop from pages of 60 by 1,500 points; some reach beyond them."""
    parts = spark.read.parquet(f"{sf}/part.parquet")
    x1, y1 = F.col("p_size") * 2.0, F.floor("p_retailprice").cast("double")
    error = regions.crop_error(F.lit(0.0), F.lit(10.0), x1, y1, F.lit(60.0), F.lit(1500.0))
    name = regions.crop_name(F.col("p_size"), [F.col("p_partkey")])
    return parts.select("p_partkey", error.alias("error"), name.alias("name"))


def layout_coverage(spark, sf):
    """Every atom is in exactly one candidate."""
    from folium.operators import ledger

    lines = boxes(spark, sf)
    used = layout.candidates(lines).select("doc_id", F.explode("atom_ids").alias("atom_id"))
    return ledger.coverage(lines, used, ["doc_id", "atom_id"]).groupBy("status").agg(F.count(F.lit(1)).alias("n_atoms"))


def layout_cross_page(spark, sf):
    """Every line with the line that follows it, on pages of four lines."""
    lines = _prose(spark, sf).withColumn("page", (F.floor(F.col("ord") / 4) + 1).cast("int"))
    return layout.cross_page(lines.select("doc_id", "ord", "page", "text")).where("flag is not null").select("doc_id", F.col("ord").cast("long").alias("ord"), "flag")


def crop_containment(spark, sf):
    """Boxes of lines that a crop of the page's left half, from 100 to 200 points down, holds."""
    lines = _prose(spark, sf)
    crops = lines.select("doc_id", "page").distinct().select("doc_id", "page", F.lit(40.0).alias("o_x0"), F.lit(100.0).alias("o_y0"), F.lit(282.0).alias("o_x1"), F.lit(200.0).alias("o_y1"))
    return layout.boxes_inside(lines, crops, ["doc_id", "page"]).select("doc_id", "atom_id")


QUERIES = {f.__name__: f for f in (layout_body_height, layout_margins, layout_gutter, layout_columns, layout_reading_order, layout_micro_host, layout_candidates, layout_two_columns, hard_spots, candidate_preview, lines_of_words, low_text_pages, crop_risks, crops_named, layout_coverage, layout_cross_page, crop_containment)}

_LINES = "SELECT doc_id, i - 1 AS n, l[i] AS text FROM (SELECT doc_id, string_split(text, chr(10)) AS l, unnest(range(1, len(string_split(text, chr(10))) + 1)) AS i FROM documents)"
_BOX = f"""SELECT doc_id, printf('a%05d', n + 1) AS atom_id, n AS ord, (n // 40 + 1) AS page, text, x0, 80.0::DOUBLE + 13 * ((n % 40) % 20) AS y0,
  CASE WHEN n % 10 = 0 THEN 560.0::DOUBLE ELSE x0 + least(240.0, 5.0 * length(text)) END AS x1, 80.0::DOUBLE + 13 * ((n % 40) % 20) + 12 - length(text) % 5 AS y1
FROM (SELECT *, CASE WHEN n % 10 = 0 THEN 40.0::DOUBLE ELSE 40.0 + 280 * ((n % 40) // 20) END AS x0 FROM ({_LINES}))"""
_NORM = r"lower(trim(regexp_replace(text, '\s+', ' ', 'g')))"
_TRIM = r"trim(text, ' ' || chr(9) || chr(10) || chr(13))"
_GUTTER = f"""
WITH m AS (SELECT * FROM ({_BOX}) WHERE x1 - x0 >= 120 AND x1 - x0 < 330), t AS (SELECT *, unnest(range(0, 46)) AS i FROM m), g AS (SELECT *, 210.0 + 4 * i AS g FROM t),
c AS (SELECT doc_id, page, i, g, count(*) FILTER (WHERE x1 < g - 2) AS l, count(*) FILTER (WHERE x1 >= g - 2 AND x0 > g + 2) AS r, count(*) FILTER (WHERE x1 >= g - 2 AND x0 <= g + 2) AS s FROM g GROUP BY ALL),
o AS (SELECT *, row_number() OVER (PARTITION BY doc_id, page ORDER BY l * r - 20 * s DESC, i) AS k FROM c WHERE l + r + s >= 8 AND l >= 4 AND r >= 4 AND s <= greatest(2, floor((l + r) * 0.08)))
SELECT doc_id, page::BIGINT AS page, g::DOUBLE AS gutter, l AS n_left, r AS n_right, s AS n_straddling FROM o WHERE k = 1"""

_BOOK = f"""
WITH l AS (SELECT doc_id, n // 2 + 1 AS page, n FROM ({_LINES})), p AS (SELECT doc_id, page, string_agg(printf('a%05d', n + 1), ',' ORDER BY n) AS atoms, max(page) OVER (PARTITION BY doc_id) AS pages FROM l GROUP BY doc_id, page),
u AS (SELECT doc_id, page, 1 AS k, 'header' AS kind, printf('h%05d', page) AS atoms, 'repeated_margin' AS flag FROM p WHERE pages >= 3 UNION ALL SELECT doc_id, page, 2, 'paragraph', atoms, CASE WHEN pages > 1 THEN 'possible_cross_page' ELSE '' END FROM p UNION ALL SELECT doc_id, page, 3, 'footer', printf('f%05d', page), 'page_number' FROM p),
c AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY page, k) AS ord FROM u)"""
_WORDS = f"""
WITH w AS (SELECT doc_id, n, unnest(list_filter(string_split(text, ' '), lambda x: x <> '')) AS w, unnest(range(0, len(list_filter(string_split(text, ' '), lambda x: x <> '')))) AS k FROM ({_LINES}))"""

ORACLES = {
    "layout_candidates": _BOOK + """
SELECT doc_id, printf('c%05d', ord) AS id, page::BIGINT AS page, CASE kind WHEN 'paragraph' THEN 'full' ELSE kind END AS "column", kind AS kind_hint, atoms AS atom_ids, CASE WHEN flag = '' THEN 0.84 ELSE 0.72 END::DOUBLE AS confidence, flag AS hard_spots FROM c""",
    "hard_spots": _BOOK + " SELECT flag, count(*)::BIGINT AS n FROM c WHERE flag <> '' GROUP BY flag",
    "candidate_preview": _BOOK + " SELECT doc_id, count(DISTINCT page)::BIGINT AS n_pages, count(*)::BIGINT AS n_candidates FROM c GROUP BY doc_id",
    "lines_of_words": _WORDS + """
SELECT doc_id, (n // 40 + 1)::BIGINT AS page, (min(k) * 30 + 40 * (k // 5))::DOUBLE AS x0, (20.0::DOUBLE * (n % 40) + min(k % 2)) AS y0, (max(k) * 30 + 40 * (k // 5) + 20)::DOUBLE AS x1, sha256(string_agg(w, ' ' ORDER BY k)) AS text_sha256 FROM w GROUP BY doc_id, n, k // 5""",
    "low_text_pages": _WORDS + """
SELECT doc_id, (n + 1)::BIGINT AS page, count(*)::BIGINT AS n_words, (n + 1) % 50 = 0 OR bool_or(contains(w, chr(65533))) AS unreadable FROM w GROUP BY doc_id, n HAVING count(*) < 8 OR (n + 1) % 50 = 0 OR bool_or(contains(w, chr(65533)))""",
    "crop_risks": """
SELECT p_partkey, ['left', 'top', ''][p_partkey % 3 + 1] AS risks, (CASE WHEN p_partkey % 3 = 0 THEN greatest(0, p_size - 10) ELSE p_size END)::DOUBLE AS x0, CASE WHEN p_partkey % 3 = 1 THEN 0 ELSE 5 END::DOUBLE AS y0, 90.0::DOUBLE AS x1, 80.0::DOUBLE AS y1 FROM part""",
    "crops_named": """
SELECT p_partkey, CASE WHEN NOT (p_size > 0 AND p_size * 2 <= 60 AND floor(p_retailprice) > 10 AND floor(p_retailprice) <= 1500) THEN 'Invalid page or top-left point bounding box' END AS error,
       'region-' || substr(sha256(p_size || ',' || p_partkey), 1, 16) || '.png' AS name FROM part""",
    "layout_body_height": f"""
WITH h AS (SELECT doc_id, page, y1 - y0 AS h, length({_TRIM}) > 20 AND y1 - y0 BETWEEN 6 AND 22 AS good FROM ({_BOX})),
p AS (SELECT doc_id, page, list_sort(list(h) FILTER (WHERE good)) AS a, list_sort(list(h) FILTER (WHERE h > 0)) AS b FROM h GROUP BY ALL)
SELECT doc_id, page::BIGINT AS page, CASE WHEN len(a) > 0 THEN a[len(a) // 2 + 1] WHEN len(b) > 0 THEN b[len(b) // 2 + 1] ELSE 10.0 END::DOUBLE AS body_height FROM p""",
    "layout_margins": f"""
WITH b AS (SELECT doc_id, atom_id, ord, ord // 4 + 1 AS page FROM ({_BOX})), c AS (SELECT doc_id, count(DISTINCT page) AS n FROM b GROUP BY 1)
SELECT doc_id, atom_id, CASE WHEN ord % 4 = 0 THEN 'header' ELSE 'footer' END AS kind, CASE WHEN ord % 4 = 0 THEN 'repeated_margin' ELSE 'page_number' END AS margin_flag
FROM b JOIN c USING (doc_id) WHERE (ord % 4 = 0 AND n >= 3) OR (ord % 4 = 3 AND page % 2000 < 1000)""",
    "layout_gutter": _GUTTER,
    "layout_columns": f"""
WITH b AS ({_BOX}), w AS (SELECT doc_id, page FROM b GROUP BY ALL HAVING count(*) FILTER (WHERE x1 - x0 >= 330) >= 4 AND count(*) FILTER (WHERE x1 - x0 >= 330) >= 0.4 * count(*)),
g AS (SELECT doc_id, page, gutter FROM ({_GUTTER}) WHERE (doc_id, page) NOT IN (SELECT (doc_id, page) FROM w))
SELECT b.doc_id, atom_id, CASE WHEN gutter IS NULL THEN CASE WHEN x1 - x0 >= 330 THEN 'full' ELSE 'single' END WHEN x1 - x0 >= 330 OR (x0 < gutter - 6 AND x1 > gutter + 6) THEN 'full'
  WHEN x1 < gutter - 1 THEN 'left' WHEN x0 > gutter + 1 THEN 'right' WHEN (x0 + x1) / 2 < gutter THEN 'left' ELSE 'right' END AS "column"
FROM b LEFT JOIN g ON b.doc_id = g.doc_id AND b.page = g.page""",
    "layout_reading_order": f"""
WITH s AS (SELECT *, CASE WHEN ord % 10 = 0 THEN 0 WHEN x0 < 300 THEN 1 ELSE 2 END AS side FROM ({_BOX})), d AS (SELECT *, sum((side = 0)::INT) OVER (PARTITION BY doc_id, page ORDER BY y0, x0, ord ROWS UNBOUNDED PRECEDING) AS band FROM s)
SELECT doc_id, atom_id, row_number() OVER (PARTITION BY doc_id, page ORDER BY band, side, y0, x0, ord) AS place FROM d""",
    "layout_micro_host": f"""
WITH b AS (SELECT doc_id, page, ord, atom_id, x0, CASE WHEN ord % 7 = 3 THEN 'x' ELSE text END AS text, CASE WHEN ord % 7 = 3 THEN x0 + 8 ELSE x1 END AS x1, CASE WHEN ord % 7 = 3 THEN y0 - 4 ELSE y0 END AS y0, CASE WHEN ord % 7 = 3 THEN y0 + 2 ELSE y1 END AS y1 FROM ({_BOX})),
p AS (SELECT doc_id, page, list_sort(list(y1 - y0) FILTER (WHERE length({_TRIM}) > 20 AND y1 - y0 BETWEEN 6 AND 22)) AS a, list_sort(list(y1 - y0) FILTER (WHERE y1 - y0 > 0)) AS c FROM b GROUP BY ALL),
h AS (SELECT doc_id, page, CASE WHEN len(a) > 0 THEN a[len(a) // 2 + 1] WHEN len(c) > 0 THEN c[len(c) // 2 + 1] ELSE 10.0 END AS body FROM p),
m AS (SELECT b.*, length({_TRIM}) BETWEEN 1 AND 18 AND y1 - y0 < body * 0.78 AND x1 - x0 < 48 AS micro FROM b JOIN h USING (doc_id, page)),
j AS (SELECT g.doc_id, g.page, g.atom_id, t.atom_id AS host_id, least(g.y1, t.y1) - greatest(g.y0, t.y0) AS shared, t.ord AS t_ord FROM m g JOIN m t ON g.doc_id = t.doc_id AND g.page = t.page AND g.micro AND NOT t.micro AND g.x0 >= t.x0 - 2 AND g.x1 <= t.x1 + 4)
SELECT doc_id, atom_id, host_id FROM (SELECT *, row_number() OVER (PARTITION BY doc_id, page, atom_id ORDER BY shared DESC, t_ord) AS k FROM j WHERE shared > 0) WHERE k = 1""",
    "layout_coverage": f"SELECT 'ok' AS status, count(*)::BIGINT AS n_atoms FROM ({_LINES})",
    "layout_cross_page": rf"""
WITH i AS (SELECT doc_id, ord, ord // 4 + 1 AS page, text, lead(ord // 4 + 1) OVER w AS np, lead(text) OVER w AS nt FROM ({_BOX}) WINDOW w AS (PARTITION BY doc_id ORDER BY ord)),
f AS (SELECT doc_id, ord, rtrim(text) AS t, trim(nt) AS nt, np = page + 1 AS turns FROM i),
c AS (SELECT *, regexp_matches(t, '[.?!]$') AND NOT regexp_matches(t, '(?i)(et al|e\.g|i\.e|vs|fig|dr|mr|mrs|prof|al)\.$') AND NOT regexp_matches(t, '\b[A-Z]\.$') AS ends,
  length(nt) BETWEEN 1 AND 90 AND (lower(nt) IN ('abstract', 'references', 'acknowledgments', 'acknowledgements', 'appendix') OR (regexp_matches(nt, '^\d+(\.\d+)*\.?\s+[A-Z]') AND len(string_split(nt, ' ')) <= 14)) AS heading FROM f)
SELECT doc_id, ord::BIGINT AS ord, CASE WHEN ends_with(t, '-') THEN 'possible_cross_page_hyphen' ELSE 'possible_cross_page' END AS flag FROM c WHERE turns AND (ends_with(t, '-') OR (NOT heading AND NOT ends))""",
    "crop_containment": f"SELECT doc_id, atom_id FROM ({_BOX}) WHERE x0 >= 38 AND y0 >= 98 AND x1 <= 284 AND y1 <= 202",
}
