"""Operator 2, line dedup.

Lines are exploded, normalised (blanks stripped at both ends, A-Z lower-cased) and hashed to
128 bits; distinct documents are counted per hash. A key of at least MIN_CHARS code points
found in at least MIN_DOCS documents loses all its lines except in the smallest doc_id holding
it. What stays is reassembled by position.

Only hashes and positions are shuffled by key, and the join that sends decisions back to lines
is one that Spark splits where a line is very common; texts move once, by document.

Defined cases: a null or empty text is one empty line; a very long text is split and put together once,
in time proportional to its lines; null ids are together one document, which comes after all others and for
which the id 2^63-1 stands; rows sharing a doc_id are one document for counting, and each such
row loses or keeps its own lines; an empty table gives no rows; columns
n_lines and n_dropped of the input are replaced, other columns stay.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folium.llm.shared import BLANKS, fold_ascii, write_table

MIN_CHARS = 10
MIN_DOCS = 2
LAST_ID = (1 << 63) - 1


def lines_of(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n", -1)


def line_key(line: Column) -> Column:
    return fold_ascii(F.btrim(line, F.lit(BLANKS)))


def _row_key() -> list[Column]:
    text = F.coalesce(F.col("text"), F.lit(""))
    return [F.coalesce(F.col("doc_id"), F.lit(LAST_ID)).alias("_lines_id"), F.xxhash64(text, F.length(text)).alias("_lines_row")]


def dedup_lines(docs: DataFrame, min_chars: int = MIN_CHARS, min_docs: int = MIN_DOCS) -> DataFrame:
    """All columns of docs with `text` rewritten, plus n_lines and n_dropped."""
    keyed = docs.select(*_row_key(), F.posexplode(lines_of(F.col("text"))).alias("pos", "line"))
    keyed = keyed.withColumn("key", line_key(F.col("line"))).where(F.length("key") >= min_chars)
    hashes = write_table(keyed.select("_lines_id", "_lines_row", "pos", F.xxhash64("key").alias("h1"), F.xxhash64(F.lit(7), "key").alias("h2")), "line-hashes")

    if min_docs <= 2:
        seen = hashes.groupBy("h1", "h2").agg(F.min("_lines_id").alias("keeper"), F.max("_lines_id").alias("_last"))
        shared = seen.where((F.col("keeper") < F.col("_last")) | F.lit(min_docs < 2))
    else:
        seen = hashes.select("h1", "h2", "_lines_id").distinct().groupBy("h1", "h2").agg(F.min("_lines_id").alias("keeper"), F.count(F.lit(1)).alias("_n"))
        shared = seen.where(F.col("_n") >= min_docs)
    shared = write_table(shared.select(F.col("h1").alias("g1"), F.col("h2").alias("g2"), "keeper"), "line-shared")
    dropped = hashes.join(shared, (F.col("h1") == F.col("g1")) & (F.col("h2") == F.col("g2")) & (F.col("_lines_id") != F.col("keeper")))
    dropped = dropped.groupBy(F.col("_lines_id").alias("_lines_did"), F.col("_lines_row").alias("_lines_drow")).agg(F.collect_set("pos").alias("_lines_drop"))

    marked = docs.select("*", *_row_key())
    marked = marked.join(dropped, (F.col("_lines_id") == F.col("_lines_did")) & (F.col("_lines_row") == F.col("_lines_drow")), "left")
    # A text is split once: its lines are bound to `lines`, from which what stays is taken by position.
    marked = marked.withColumn("_lines_left", F.transform(F.array(lines_of(F.col("text"))), _reassembled)[0])
    marked = marked.withColumn("n_lines", F.col("_lines_left.n")).withColumn("n_dropped", F.coalesce(F.array_size("_lines_drop"), F.lit(0)).cast("long"))
    text = F.coalesce(F.col("_lines_left.text"), F.col("text"), F.lit(""))
    return marked.withColumn("text", text).drop("_lines_id", "_lines_row", "_lines_did", "_lines_drow", "_lines_drop", "_lines_left")


def _reassembled(lines: Column) -> Column:
    """Number of the lines and, where some are dropped, the text of those that stay."""
    left = F.array_except(F.sequence(F.lit(1), F.size(lines)), F.transform("_lines_drop", lambda p: p + 1))
    text = F.array_join(F.transform(left, lambda p: F.element_at(lines, p)), "\n")
    return F.struct(F.size(lines).cast("long").alias("n"), F.when(F.col("_lines_drop").isNotNull(), text).alias("text"))


def op2(docs: DataFrame) -> DataFrame:
    """doc_id, n_lines, n_dropped, kept_sha256 of every row of documents."""
    out = dedup_lines(docs.select("doc_id", "text"))
    return out.select("doc_id", "n_lines", "n_dropped", F.sha2(F.col("text").cast("binary"), 256).alias("kept_sha256"))


ORACLE = r"""
WITH l AS (
  SELECT doc_id, pos, string_split(coalesce(text, ''), chr(10))[pos] AS line
  FROM (SELECT doc_id, text, unnest(range(1, len(string_split(coalesce(text, ''), chr(10))) + 1)) AS pos FROM documents)
), k AS (
  SELECT *, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM l
), s AS (
  SELECT key, min(doc_id) AS keeper FROM k WHERE length(key) >= 10 GROUP BY key HAVING count(DISTINCT doc_id) >= 2
), m AS (
  SELECT k.doc_id, k.pos, k.line, s.key IS NOT NULL AND k.doc_id <> s.keeper AS gone FROM k LEFT JOIN s ON k.key = s.key
)
SELECT doc_id, count(*)::BIGINT AS n_lines, (count(*) FILTER (WHERE gone))::BIGINT AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT gone), '')) AS kept_sha256
FROM m GROUP BY doc_id
"""
