"""The ledger: identity of documents, atoms partitioned by blocks, windows over blocks in reading order."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def content_id(content: Column) -> Column:
    """First 24 hex digits of the SHA-256 of the original bytes."""
    return F.substring(F.sha2(content.cast("binary"), 256), 1, 24)


def first_imports(docs: DataFrame) -> DataFrame:
    """content_id, doc_id (the first import), n_imports: later imports of the same bytes give the first document."""
    return docs.groupBy(content_id(F.col("text")).alias("content_id")).agg(F.min("doc_id").alias("doc_id"), F.count(F.lit(1)).alias("n_imports"))


def coverage(expected: DataFrame, used: DataFrame, key: list[str]) -> DataFrame:
    """The keys that are missing, extra or used more than once, with how often they are used."""
    uses = used.groupBy(*key).agg(F.count(F.lit(1)).alias("n_used"))
    both = expected.select(*key).distinct().withColumn("_expected", F.lit(True)).join(uses, key, "full_outer")
    n = F.coalesce("n_used", F.lit(0)).cast("long")
    status = F.when(n == 0, "missing").when(F.col("_expected").isNull(), "extra").when(n > 1, "duplicate").otherwise("ok")
    return both.select(*key, n.alias("n_used"), status.alias("status"))


def partition_check(atoms: DataFrame, blocks: DataFrame) -> DataFrame:
    """Per document, whether the blocks' source_ids are an exact partition of its atoms."""
    used = blocks.select("doc_id", F.explode("source_ids").alias("atom_id"))
    found = coverage(atoms, used, ["doc_id", "atom_id"])
    counts = [F.count(F.when(F.col("status") == s, 1)).alias(f"n_{s}") for s in ("missing", "extra", "duplicate")]
    out = found.groupBy("doc_id").agg(F.count(F.when(F.col("status") != "extra", 1)).alias("n_atoms"), *counts)
    return out.withColumn("ok", (F.col("n_missing") + F.col("n_extra") + F.col("n_duplicate")) == 0)


def blocks_of(atoms: DataFrame, per_block: int) -> DataFrame:
    """Blocks of consecutive atoms: doc_id, ord, block_id, source_ids, text."""
    placed = atoms.withColumn("_block", F.floor((F.col("ord") - 1) / per_block).cast("int") + 1)
    grouped = placed.groupBy("doc_id", "_block").agg(F.array_sort(F.collect_list(F.struct("ord", "atom_id", "text"))).alias("_atoms"))
    return grouped.select("doc_id", F.col("_block").alias("ord"), F.format_string("b%05d", "_block").alias("block_id"), F.col("_atoms.atom_id").alias("source_ids"), F.array_join(F.col("_atoms.text"), "\n").alias("text"))


def sections(blocks: DataFrame, is_heading: Column, key: str = "doc_id") -> DataFrame:
    """Every block with the place of the last heading at or before it and of the next heading after it."""
    order = Window.partitionBy(key).orderBy("ord")
    at = F.when(is_heading, F.col("ord"))
    before = F.last(at, ignorenulls=True).over(order.rowsBetween(Window.unboundedPreceding, 0))
    after = F.first(at, ignorenulls=True).over(order.rowsBetween(1, Window.unboundedFollowing))
    return blocks.withColumn("section_start", before).withColumn("section_end", after)


def page(total: Column, offset: Column, limit: int) -> tuple[Column, Column, Column]:
    """Clamped first and last place (half-open) of a page of a section, and whether rows are left out."""
    first = F.greatest(F.lit(0), F.least(offset, F.greatest(total - 1, F.lit(0))))
    last = F.least(total, first + limit)
    return first, last, (first > 0) | (last < total)


def numbered(rows: DataFrame, key: str, number: str, width: int = 1 << 16) -> DataFrame:
    """rows with `ord`, from 1 in order of a whole number within a key.

    Ranges of `width` numbers are counted, and a row's place in its range is added to the counts of the ranges before, so
    a key that holds a third of all rows is sorted in as many tasks as it has ranges. Rows of one number are in any order.
    """
    ranged = rows.withColumn("_range", F.floor(F.col(number) / width).cast("long"))
    counts = ranged.groupBy(F.col(key).alias("_key"), F.col("_range").alias("_of")).agg(F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy("_key").orderBy("_of").rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.select("_key", "_of", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    placed = ranged.withColumn("_at", F.row_number().over(Window.partitionBy(key, "_range").orderBy(number)))
    both = placed.join(counts, F.col(key).eqNullSafe(F.col("_key")) & F.col("_range").eqNullSafe(F.col("_of")))
    return both.withColumn("ord", (F.col("_before") + F.col("_at")).cast("long")).drop("_range", "_key", "_of", "_before", "_at")


def neighbours(blocks: DataFrame, chosen: DataFrame, key: str, reach: int = 1) -> DataFrame:
    """The blocks up to `reach` places from a chosen one, each once, and whether it is chosen itself."""
    near = chosen.select(key, F.explode(F.sequence(F.col("ord") - reach, F.col("ord") + reach)).alias("ord"), F.col("ord").alias("_of"))
    near = near.groupBy(key, "ord").agg(F.max((F.col("ord") == F.col("_of")).cast("int")).alias("chosen"))
    return blocks.join(near, [key, "ord"])


def first_pending(blocks: DataFrame, key: str, order: list[str], limit: int = 16) -> DataFrame:
    """The first `limit` rows of each key, numbered; Spark keeps no more than those per task before the shuffle."""
    window = Window.partitionBy(key).orderBy(*order)
    return blocks.withColumn("rank", F.row_number().over(window)).where(F.col("rank") <= limit)
