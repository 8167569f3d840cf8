"""Queries of alignment, quality gates, terms, issues and reader text."""

from __future__ import annotations

from pyspark.sql import functions as F

from folium.functions import reading
from folium.functions import spans as S
from folium.functions import text as X
from folium.operators import issues, quality
from folium.operators import spans as O
from folium.sources.plain import atoms


def _t(spark, sf, name):
    return spark.read.parquet(f"{sf}/{name}.parquet")


def _long(*names):
    return [F.col(n).cast("long").alias(n) for n in names]


def number_multiset_diff(spark, sf):
    pairs = quality.turns_as_pairs(_t(spark, sf, "conversations"))
    a, b = X.multiset(F.col("source"), X.NUMBERS), X.multiset(F.col("target"), X.NUMBERS)
    return pairs.select("conv_id", "turn", F.array_join(a, ",").alias("source_numbers"), F.array_join(b, ",").alias("target_numbers"), (a != b).alias("differs"))


def citation_formula_diff(spark, sf):
    """Turns as one run of letters, followed by a number with a unit, a citation and a formula, which change in every second, fifth and third answer."""
    pairs = quality.turns_as_pairs(_t(spark, sf, "conversations"))
    letters = lambda c: F.regexp_replace(F.lower(c), "[^a-z]+", "q")
    change = lambda c, n, one, other: F.when(F.col(c) % n == 0, one).otherwise(other)
    source = F.concat(letters("source"), F.lit(" runs at 5 kW [3] $a$"))
    target = F.concat(letters("target"), F.lit(" 5 "), change("conv_id", 2, "MW", "kW"), F.lit(" "), change("conv_id", 5, "[3, 4]", "[3]"), F.lit(" "), change("conv_id", 3, "$b$", "$a$"))
    found = X.differences(source, target)
    return pairs.select("conv_id", "turn", *[F.array_contains(found, c).alias(f"{c}_differ") for c in ("numbers", "units", "formulas", "citations")])


def duplicate_texts_need_reason(spark, sf):
    docs = _t(spark, sf, "documents").select("doc_id", "text")
    return quality.repeated(docs, [], F.col("text")).select("doc_id", "n_same")


def span_coverage(spark, sf):
    found = O.cover_faults(O.token_spans(_t(spark, sf, "documents")))
    covered = F.aggregate("spans", F.lit(0), lambda n, s: n + s["e"] - s["s"])
    return found.select("doc_id", F.size("spans").cast("long").alias("n_spans"), covered.cast("long").alias("n_covered"), F.col("fault").isNull().alias("valid"))


def span_violations(spark, sf):
    """Stand-in: spans made from event numbers, per user."""
    e = _t(spark, sf, "events")
    spans = e.select("user_id", F.col("event_id").alias("id"), (F.col("event_id") * 37 % 997).alias("s"), (F.col("event_id") * 37 % 997 + F.col("event_id") % 11 - 1).alias("e"))
    return O.violations(spans, "user_id", F.lit(990)).select("user_id", "id", "s", "e", "fault")


def exact_match_positions(spark, sf):
    return O.occurrences(_t(spark, sf, "documents"), "anan").select("doc_id", *_long("n", "start", "end"))


def nth_occurrence(spark, sf):
    found = O.occurrences(_t(spark, sf, "documents"), "the ")
    return found.where("n = 3").select("doc_id", *_long("start"))


def anchored_match(spark, sf):
    docs = _t(spark, sf, "documents")
    lines = atoms(docs, "line").select("doc_id", "ord", "start", "end")
    found = O.contained(O.occurrences(docs, "thth"), lines)
    return found.groupBy("doc_id", F.col("outer_ord").cast("long").alias("line")).agg(F.count(F.lit(1)).alias("n_matches"))


def pair_offsets_whole(spark, sf):
    pairs = quality.turns_as_pairs(_t(spark, sf, "conversations"))
    whole = [F.array(F.struct(F.lit(0).alias("s"), F.length(c).alias("e"))) for c in ("source", "target")]
    return pairs.select("conv_id", "turn", F.length("source").cast("long").alias("source_end"), F.length("target").cast("long").alias("target_end"), (S.spans_valid(F.col("source"), whole[0]) & S.spans_valid(F.col("target"), whole[1])).alias("valid"))


def pair_offsets_greedy(spark, sf):
    found = O.greedy_alignment(_t(spark, sf, "documents"), [["the"], ["th", "the"], ["thth"]])
    return found.select("doc_id", *_long("group"), F.to_json("spans").alias("spans"), "error")


def span_edit_shift(spark, sf):
    """The first line of each document becomes `[edited]`: where all lines are then."""
    found = atoms(_t(spark, sf, "documents"), "line").groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct(F.col("start").alias("s"), F.col("end").alias("e")))).alias("spans"))
    first = F.col("spans")[0]
    moved = found.select("doc_id", F.posexplode(S.shift_spans(F.col("spans"), first["s"], first["e"], F.lit(8))).alias("ord", "span"))
    return moved.select("doc_id", *_long("ord"), F.col("span.s").cast("long").alias("start_at"), F.col("span.e").cast("long").alias("end_at"))


def note_status(spark, sf):
    """Stand-in: a note on each labelled document quotes its characters 5 to 15; toxic ones quote them upper-cased."""
    notes = _t(spark, sf, "documents").join(_t(spark, sf, "labels"), "doc_id")
    quote = F.when(F.col("toxic") == 1, F.upper(F.substring("text", 6, 10))).otherwise(F.substring("text", 6, 10))
    return notes.select("doc_id", S.note_status(F.col("text"), F.lit(5), F.lit(15), quote).alias("status"))


def note_overlap(spark, sf):
    """Stand-in: clicks are notes and other events are segments, per user."""
    e = _t(spark, sf, "events").select("user_id", "event_id", "event_type", (F.col("event_id") % 500).alias("s"))
    a = e.where("event_type = 'click'").select("user_id", F.col("event_id").alias("note_id"), F.col("s").alias("a_start"), (F.col("s") + 6).alias("a_end"))
    b = e.where("event_type <> 'click'").select("user_id", F.col("event_id").alias("segment_id"), F.col("s").alias("b_start"), (F.col("s") + 9).alias("b_end"))
    return O.overlapping(a, b, "user_id").select("user_id", "note_id", "segment_id")


def term_matches(spark, sf):
    """Every two words that follow each other in a benchmark item are a term: they are joined with those of documents."""
    words = F.split(X.term_normal(F.col("text")), " ")
    pairs = lambda key, table: _t(spark, sf, table).select(key, words.alias("w")).where(F.size("w") >= 2).select(key, F.explode(F.array_distinct(F.transform(F.sequence(F.lit(1), F.size("w") - 1), lambda i: F.concat_ws(" ", F.element_at("w", i), F.element_at("w", i + 1))))).alias("term"))
    return pairs("doc_id", "documents").join(pairs("item_id", "benchmark"), "term").groupBy("doc_id", "item_id").agg(F.count(F.lit(1)).alias("n_terms"))


TERMS = ("the / of", "input/output", "therhean", "und / der / die", "a b / is the", " / ")


def term_alias_matches(spark, sf):
    docs = _t(spark, sf, "documents").select("doc_id", "text")
    hits = [F.count(F.when(X.term_matches(F.col("text"), F.lit(t)), 1)).alias(f"term_{k}") for k, t in enumerate(TERMS)]
    return docs.agg(*hits)


def _priced(spark, sf):
    """Stand-in: documents without dollar signs, followed by a price and two formulas."""
    number = F.col("doc_id").cast("string")
    text = F.concat(F.replace("text", F.lit("$"), F.lit("S")), F.lit(" costs $"), number, F.lit(" now, $x_"), number, F.lit("$ and $$y="), number, F.lit("$$ end"))
    return _t(spark, sf, "documents").select("doc_id", reading.math_tokens(text).alias("tokens"))


def math_tokens(spark, sf):
    tokens = _priced(spark, sf).select("doc_id", F.posexplode("tokens").alias("ord", "token"))
    return tokens.select("doc_id", *_long("ord"), F.col("token.type").alias("type"), F.sha2(F.col("token.value").cast("binary"), 256).alias("value_sha256"))


def currency_amounts(spark, sf):
    """Amounts of money that stay text, and the formulas beside them."""
    tokens = F.col("tokens")
    prose = F.array_join(F.transform(F.filter(tokens, lambda t: t["type"] == "text"), lambda t: t["value"]), " ")
    amounts = F.regexp_extract_all(prose, F.lit(r"\$(" + reading.AMOUNT + ")"), 1)
    formulas = F.transform(F.filter(tokens, lambda t: t["type"] != "text"), lambda t: t["value"])
    return _priced(spark, sf).select("doc_id", F.array_join(amounts, " ").alias("amounts"), F.array_join(formulas, " ").alias("formulas"))


def table_shape(spark, sf):
    """Documents as tables: a header, a rule and a row for each line that is not blank, with its number."""
    lines = F.filter(F.split(F.regexp_replace("text", r"[|\\\t]", ""), "\n"), lambda x: F.trim(x) != "")
    rows = F.array_join(F.transform(lines, lambda x, i: F.concat(F.lit("| "), (i + 1).cast("string"), F.lit(" | "), x, F.lit(" |"))), "\n")
    found = _t(spark, sf, "documents").withColumn("t", reading.table_cells(F.concat(F.lit("| n | text |\n|---|:---:|\n"), rows)))
    cells = F.array_join(F.transform(F.flatten("t.rows"), lambda c: c["text"]), "|")
    return found.select("doc_id", F.col("t.header").alias("header"), F.size("t.rows").cast("long").alias("n_rows"), F.size(F.col("t.rows")[0]).cast("long").alias("n_columns"), F.sha2(cells.cast("binary"), 256).alias("cells_sha256"))


def table_rows_preserved(spark, sf):
    pairs = quality.turns_as_pairs(_t(spark, sf, "conversations"))
    return pairs.select("conv_id", "turn", X.nonblank_lines(F.col("source")).cast("long").alias("source_rows"), X.nonblank_lines(F.col("target")).cast("long").alias("target_rows"), X.rows_preserved(F.col("source"), F.col("target")).alias("preserved"))


def _issues(spark, sf):
    """Stand-in: events are issues of the category of their type; those of high value are resolved."""
    e = _t(spark, sf, "events")
    return e.select(F.concat_ws("-", F.lit("tex"), "event_type", F.col("event_id").cast("string")).alias("issue_id"), F.col("event_id").alias("ord"), (F.col("value") > 50).alias("resolved"))


def issue_summary(spark, sf):
    return issues.summary(_issues(spark, sf))


def limitation_batch(spark, sf):
    """Categories renamed to those that may be batched; one good request and one for a category without open issues, so none applies; then the good one alone."""
    rows = _t(spark, sf, "events").select(F.when(F.col("event_type") == "click", "tex-env").when(F.col("event_type") == "view", "image").otherwise("page").alias("category"), F.col("event_id").alias("issue_id"), (F.col("value") > 50).alias("resolved"))
    why = "the sample file was checked and the figure is missing from the archive"
    good = spark.createDataFrame([("tex-env", why, "checked source a00012 by hand, sample b00001")], "category string, resolution string, evidence string")
    bad = good.unionByName(spark.createDataFrame([("docx-ole", why, "checked source a00012 by hand, sample b00001")], good.schema))
    out = None
    for name, asked in (("good", good), ("bad", bad)):
        found = issues.resolve_batch(rows, asked).groupBy("category").agg(F.count("batch_resolution").alias("n_resolved"), F.count(F.lit(1)).alias("n")).withColumn("request", F.lit(name))
        out = found if out is None else out.unionByName(found)
    return out.select("request", "category", "n_resolved", "n")


def evidence_screen(spark, sf):
    """Stand-in: a document's whole text is an explanation."""
    text = F.col("text")
    return _t(spark, sf, "documents").select("doc_id", X.is_filler(text).alias("weak"), X.has_evidence(text).alias("evidence"), F.coalesce(X.explanation_error(text, evidence=True), F.lit("ok")).alias("verdict"))


def short_resolution(spark, sf):
    return _t(spark, sf, "documents").select("doc_id", X.shorten(F.col("text")).alias("short"))


def _errors(spark, sf):
    """Stand-in: a document's text is its own translation where it is labelled, and its review is stale where quality is 0."""
    docs = _t(spark, sf, "documents").select("source", "doc_id", "text")
    same = quality.repeated(docs, [], F.col("text")).select("doc_id", "n_same")
    labels = _t(spark, sf, "labels")
    joined = docs.join(labels, "doc_id", "left").join(same, "doc_id", "left")
    labelled = F.col("quality").isNotNull()
    blocks = joined.select(F.col("source").alias("doc_id"), F.col("doc_id").cast("string").alias("block_id"), F.lit("paragraph").alias("kind"), "text", F.when(labelled, F.col("text")).alias("target"), F.lit("kept").alias("structure_note"), F.lit(None).cast("string").alias("difference_explanation"), F.when(F.col("toxic") == 1, "as in the source").alias("duplicate_explanation"), F.when(F.col("quality") == 1, "h").alias("reviewed_hash"), F.lit("h").alias("target_hash"), F.coalesce("n_same", F.lit(1)).alias("n_same"))
    return quality.gates(blocks)


def validate_report(spark, sf):
    return _errors(spark, sf)


def progress_rollup(spark, sf):
    return quality.rollup(_errors(spark, sf), "doc_id")


def label_dedup(spark, sf):
    """Stand-in: a line is a label; documents labelled toxic are annotated, those of quality 0 were edited."""
    lines = _t(spark, sf, "documents").select("doc_id", F.posexplode(F.split("text", "\n")).alias("ord", "line"))
    rows = lines.join(_t(spark, sf, "labels"), "doc_id", "left").withColumn("label", F.sha2(X.collapse(F.col("line")).cast("binary"), 256))
    on = lambda c, v: F.coalesce(F.col(c) == v, F.lit(False))
    kept = O.dedup_labels(rows, ["doc_id"], ["label"], ["ord"], on("toxic", 1) & (F.col("ord") % 2 == 0), on("quality", 0))
    return kept.select("doc_id", *_long("ord"), "label")


def canonical_source(spark, sf):
    """Digests of canonical texts: equal where only case, signs or blanks differ."""
    return _t(spark, sf, "documents").select("doc_id", F.sha2(X.canonical("text").cast("binary"), 256).alias("canonical_sha256"))


QUERIES = {
    f.__name__: f
    for f in (
        number_multiset_diff, citation_formula_diff, duplicate_texts_need_reason, span_coverage, span_violations, exact_match_positions, nth_occurrence, anchored_match, pair_offsets_whole, pair_offsets_greedy,
        span_edit_shift, note_status, note_overlap, term_matches, term_alias_matches, math_tokens, currency_amounts, table_shape, table_rows_preserved, issue_summary, limitation_batch, evidence_screen, short_resolution,
        validate_report, progress_rollup, label_dedup, canonical_source,
    )
}

_PAIRS = "SELECT conv_id, turn, source, target FROM (SELECT conv_id, turn, role, text AS source, lead(role) OVER w AS next_role, lead(text) OVER w AS target FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn)) WHERE role = 'user' AND next_role = 'assistant'"
_NUM = r"array_to_string(list_sort(regexp_extract_all({0}, '(?:^|[^\pL\pM\pN_])([−-]?\p{{Nd}}+(?:[.,]\p{{Nd}}+)*(?:[eE][+−-]?\p{{Nd}}+)?)', 1)), ',')"
_LINES = "SELECT doc_id, i - 1 AS ord, l[i] AS line FROM (SELECT doc_id, string_split(text, chr(10)) AS l, unnest(range(1, len(string_split(text, chr(10))) + 1)) AS i FROM documents)"
_PLACED = f"SELECT *, coalesce(sum(length(line) + 1) OVER (PARTITION BY doc_id ORDER BY ord ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS s FROM ({_LINES})"
_AT = "SELECT doc_id, unnest(list_filter(range(0, greatest(length(text) - {n} + 1, 0)), lambda i: substr(text, i + 1, {n}) = '{needle}')) AS p FROM documents"
_COL = r"trim(regexp_replace({0}, '\s+', ' ', 'g'))"
_NORM = r"trim(regexp_replace(lower(text), '[^\pL\pN]+', ' ', 'g'))"
_FILLER = r"length(array_to_string(list_filter(regexp_extract_all({x}, '[a-z0-9]+'), lambda w: w NOT IN ('ignore','skip','na','ok','done','resolved','limitation','limitations','known')), '')) + length(regexp_replace({x}, '[^一-鿿]', '', 'g')) < 8"
_CLEAN = "replace(replace(replace(replace(replace(replace(lower(trim(f)), 'known limitation', ' '), 'known-limitation', ' '), 'n/a', ' '), '已知限制', ' '), '忽略', ' '), '跳过', ' ')"
_EVIDENCE = "(regexp_matches(lower(f), '\\pN') OR " + " OR ".join(f"contains(lower(f), '{w}')" for w in X.EVIDENCE_WORDS) + ")"
_SAME = "SELECT text, count(*) AS n FROM documents GROUP BY 1"
_ERRORS = f"""
SELECT d.source AS doc_id, d.doc_id::VARCHAR AS block_id, e.code, d.doc_id::VARCHAR || ': ' || e.message AS message
FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id JOIN ({_SAME}) s ON s.text = d.text
CROSS JOIN LATERAL (
  SELECT 'missing' AS code, 'missing translation' AS message WHERE l.quality IS NULL
  UNION ALL SELECT 'duplicate', 'repeated translation requires duplicate_explanation' WHERE l.quality IS NOT NULL AND s.n > 1 AND l.toxic <> 1
  UNION ALL SELECT 'review', 'second-pass review required' WHERE l.quality = 0
) e"""

ORACLES = {
    "number_multiset_diff": f"SELECT conv_id, turn, {_NUM.format('source')} AS source_numbers, {_NUM.format('target')} AS target_numbers, {_NUM.format('source')} <> {_NUM.format('target')} AS differs FROM ({_PAIRS})",
    "duplicate_texts_need_reason": "SELECT doc_id, n AS n_same FROM documents JOIN (SELECT trim(text) AS t, count(*)::BIGINT AS n FROM documents GROUP BY 1 HAVING count(*) > 1) ON trim(text) = t",
    "span_coverage": r"SELECT doc_id, len(regexp_extract_all(text, '\S+'))::BIGINT AS n_spans, length(regexp_replace(text, '\s', '', 'g'))::BIGINT AS n_covered, true AS valid FROM documents",
    "span_violations": """
WITH s AS (SELECT user_id, event_id AS id, event_id * 37 % 997 AS s, event_id * 37 % 997 + event_id % 11 - 1 AS e FROM events),
f AS (SELECT *, CASE WHEN s < 0 OR e > 990 OR s >= e THEN 'out of range' WHEN max(e) OVER (PARTITION BY user_id ORDER BY s, e, id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) > s THEN 'overlap' END AS fault FROM s)
SELECT * FROM f WHERE fault IS NOT NULL""",
    "exact_match_positions": f"SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY p)::BIGINT AS n, p::BIGINT AS start, (p + 4)::BIGINT AS \"end\" FROM ({_AT.format(n=4, needle='anan')})",
    "nth_occurrence": "SELECT doc_id, length(array_to_string(string_split(text, 'the ')[1:3], 'the '))::BIGINT AS start FROM documents WHERE len(string_split(text, 'the ')) > 3",
    "anchored_match": f"""
SELECT m.doc_id, (l.ord + 1)::BIGINT AS line, count(*)::BIGINT AS n_matches FROM ({_AT.format(n=4, needle='thth')}) m JOIN ({_PLACED}) l ON m.doc_id = l.doc_id AND l.s <= m.p AND m.p + 4 <= l.s + length(l.line) GROUP BY ALL""",
    "pair_offsets_whole": f"SELECT conv_id, turn, length(source)::BIGINT AS source_end, length(target)::BIGINT AS target_end, length(source) > 0 AND length(target) > 0 AS valid FROM ({_PAIRS})",
    "span_edit_shift": f"""
SELECT doc_id, ord::BIGINT AS ord, CASE WHEN ord = 0 THEN 0 ELSE s + 8 - n END::BIGINT AS start_at, CASE WHEN ord = 0 THEN 8 ELSE s + length(line) + 8 - n END::BIGINT AS end_at
FROM (SELECT *, first_value(length(line)) OVER (PARTITION BY doc_id ORDER BY ord) AS n FROM ({_PLACED}))""",
    "note_status": "SELECT doc_id, CASE WHEN substr(text, 6, 10) = CASE WHEN toxic = 1 THEN upper(substr(text, 6, 10)) ELSE substr(text, 6, 10) END THEN 'attached' ELSE 'orphaned' END AS status FROM documents JOIN labels USING (doc_id)",
    "note_overlap": """
SELECT a.user_id, a.event_id AS note_id, b.event_id AS segment_id FROM events a JOIN events b ON a.user_id = b.user_id AND a.event_type = 'click' AND b.event_type <> 'click'
AND a.event_id % 500 < b.event_id % 500 + 9 AND b.event_id % 500 < a.event_id % 500 + 6""",
    "term_matches": f"""
WITH d AS (SELECT doc_id, string_split({_NORM}, ' ') AS w FROM documents), t AS (SELECT item_id, string_split({_NORM}, ' ') AS w FROM benchmark),
dp AS (SELECT DISTINCT doc_id, w[i] || ' ' || w[i + 1] AS term FROM (SELECT doc_id, w, unnest(range(1, len(w))) AS i FROM d)), tp AS (SELECT DISTINCT item_id, w[i] || ' ' || w[i + 1] AS term FROM (SELECT item_id, w, unnest(range(1, len(w))) AS i FROM t))
SELECT doc_id, item_id, count(*)::BIGINT AS n_terms FROM dp JOIN tp USING (term) GROUP BY ALL""",
    "term_alias_matches": f"""
WITH d AS (SELECT ' ' || {_NORM} || ' ' AS h FROM documents)
SELECT count(*) FILTER (WHERE contains(h, ' the ') OR contains(h, ' of ') OR contains(h, ' the of '))::BIGINT AS term_0, count(*) FILTER (WHERE contains(h, ' input output '))::BIGINT AS term_1,
       count(*) FILTER (WHERE contains(h, ' therhean '))::BIGINT AS term_2, count(*) FILTER (WHERE contains(h, ' und ') OR contains(h, ' der ') OR contains(h, ' die ') OR contains(h, ' und der die '))::BIGINT AS term_3,
       count(*) FILTER (WHERE contains(h, ' a b ') OR contains(h, ' is the ') OR contains(h, ' a b is the '))::BIGINT AS term_4, 0::BIGINT AS term_5 FROM d""",
    "currency_amounts": "SELECT doc_id, doc_id::VARCHAR AS amounts, 'x_' || doc_id || ' y=' || doc_id AS formulas FROM documents",
    "math_tokens": """
WITH t AS (SELECT doc_id, unnest([{'k': 'text', 'v': replace(text, '$', 'S') || ' costs $' || doc_id || ' now, '}, {'k': 'inline', 'v': 'x_' || doc_id}, {'k': 'text', 'v': ' and '}, {'k': 'display', 'v': 'y=' || doc_id}, {'k': 'text', 'v': ' end'}]) AS t, unnest(range(0, 5)) AS ord FROM documents)
SELECT doc_id, ord, t.k AS type, sha256(t.v) AS value_sha256 FROM t""",
    "table_shape": rf"""
WITH l AS (SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY ord) AS i, trim(regexp_replace(line, '[|\\\t]', '', 'g')) AS line FROM ({_LINES}) WHERE trim(regexp_replace(line, '[|\\\t]', '', 'g')) <> '')
SELECT doc_id, true AS header, (count(*) + 1)::BIGINT AS n_rows, 2::BIGINT AS n_columns, sha256('n|text|' || string_agg(i || '|' || line, '|' ORDER BY i)) AS cells_sha256 FROM l GROUP BY doc_id""",
    "citation_formula_diff": f"SELECT conv_id, turn, conv_id % 5 = 0 AS numbers_differ, conv_id % 2 = 0 AS units_differ, conv_id % 3 = 0 AS formulas_differ, conv_id % 5 = 0 AS citations_differ FROM ({_PAIRS})",
    "pair_offsets_greedy": """
WITH d AS (SELECT doc_id, list_filter(range(0, length(text)), lambda i: substr(text, i + 1, 2) = 'th') AS h, text FROM documents),
p AS (SELECT doc_id, h, list_filter(h, lambda i: substr(text, i + 1, 3) = 'the') AS e, list_filter(h, lambda i: substr(text, i + 1, 4) = 'thth') AS x FROM d),
a AS (SELECT *, e[1] AS a FROM p), b AS (SELECT *, list_filter(h, lambda i: i + 2 <= a OR a + 3 <= i)[1] AS b FROM a),
c AS (SELECT *, list_filter(e, lambda i: (i + 3 <= a OR a + 3 <= i) AND (i + 3 <= b OR b + 2 <= i))[1] AS c FROM b),
z AS (SELECT *, list_filter(x, lambda i: (i + 4 <= a OR a + 3 <= i) AND (i + 4 <= b OR b + 2 <= i) AND (i + 4 <= c OR c + 3 <= i))[1] AS z FROM c),
f AS (SELECT *, CASE WHEN a IS NULL THEN 'fragment not found' WHEN b IS NULL OR c IS NULL THEN 'fragment already used' WHEN z IS NULL THEN CASE WHEN len(x) = 0 THEN 'fragment not found' ELSE 'fragment already used' END END AS error FROM z)
SELECT doc_id, 0::BIGINT AS "group", NULL AS spans, error FROM f WHERE error IS NOT NULL
UNION ALL SELECT doc_id, 1, '[{"s":' || a || ',"e":' || a + 3 || '}]', NULL FROM f WHERE error IS NULL
UNION ALL SELECT doc_id, 2, '[{"s":' || b || ',"e":' || b + 2 || '},{"s":' || c || ',"e":' || c + 3 || '}]', NULL FROM f WHERE error IS NULL
UNION ALL SELECT doc_id, 3, '[{"s":' || z || ',"e":' || z + 4 || '}]', NULL FROM f WHERE error IS NULL""",
    "table_rows_preserved": f"""
WITH p AS (SELECT conv_id, turn, len(list_filter(string_split(source, chr(10)), lambda x: trim(x) <> ''))::BIGINT AS a, len(list_filter(string_split(target, chr(10)), lambda x: trim(x) <> ''))::BIGINT AS b FROM ({_PAIRS}))
SELECT conv_id, turn, a AS source_rows, b AS target_rows, NOT (a > 1 AND b <= 1) AS preserved FROM p""",
    "issue_summary": """
WITH i AS (SELECT 'tex-' || event_type AS category, 'tex-' || event_type || '-' || event_id AS id, event_id, value > 50 AS done FROM events), r AS (SELECT *, row_number() OVER (PARTITION BY category ORDER BY done, event_id) AS k FROM i)
SELECT category, count(*) FILTER (WHERE NOT done)::BIGINT AS unresolved, count(*) FILTER (WHERE done)::BIGINT AS resolved, string_agg(id, ',' ORDER BY k) FILTER (WHERE k <= 3) AS sample_ids FROM r GROUP BY category""",
    "limitation_batch": """
WITH i AS (SELECT CASE event_type WHEN 'click' THEN 'tex-env' WHEN 'view' THEN 'image' ELSE 'page' END AS category, value > 50 AS done FROM events)
SELECT request, category, count(*) FILTER (WHERE request = 'good' AND category = 'tex-env' AND NOT done)::BIGINT AS n_resolved, count(*)::BIGINT AS n FROM i, (SELECT unnest(['good', 'bad']) AS request) GROUP BY ALL""",
    "evidence_screen": f"""
WITH d AS (SELECT doc_id, text AS f FROM documents), v AS (SELECT doc_id, f, {_FILLER.format(x=_CLEAN)} AS weak, {_EVIDENCE} AS evidence FROM d)
SELECT doc_id, weak, evidence, CASE WHEN length(trim(f)) < 24 THEN 'too short' WHEN weak THEN 'too weak' WHEN NOT evidence THEN 'no evidence' ELSE 'ok' END AS verdict FROM v""",
    "canonical_source": r"SELECT doc_id, sha256(replace(regexp_replace(lower(text), '[^\pL\pN]', '', 'g'), 'ß', 'ss')) AS canonical_sha256 FROM documents",
    "short_resolution": f"SELECT doc_id, CASE WHEN length(c) <= 120 THEN c ELSE rtrim(substr(c, 1, 120)) || '…' END AS short FROM (SELECT doc_id, {_COL.format('text')} AS c FROM documents)",
    "validate_report": _ERRORS,
    "progress_rollup": f"""
WITH e AS ({_ERRORS}), k AS (SELECT doc_id, CASE WHEN code IN ('missing', 'review') THEN substr(message, length(block_id) + 3) ELSE message END AS kind, CASE WHEN code IN ('missing', 'review') THEN block_id ELSE '' END AS b FROM e),
r AS (SELECT *, row_number() OVER (PARTITION BY doc_id, kind ORDER BY b) AS i FROM k)
SELECT doc_id, kind, count(*)::BIGINT AS n, string_agg(b, ',' ORDER BY b) FILTER (WHERE i <= 5) AS samples FROM r GROUP BY ALL""",
    "label_dedup": f"""
WITH r AS (SELECT l.doc_id, ord, sha256({_COL.format('line')}) AS label, toxic, quality FROM ({_LINES}) l LEFT JOIN labels ON l.doc_id = labels.doc_id), n AS (SELECT *, row_number() OVER (PARTITION BY doc_id, label ORDER BY ord) AS k FROM r)
SELECT doc_id, ord::BIGINT AS ord, label FROM n WHERE k = 1 OR (toxic = 1 AND ord % 2 = 0) OR quality = 0""",
}
