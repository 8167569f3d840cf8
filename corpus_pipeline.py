"""Documents to a sharded training corpus: quality, near duplicates, benchmark leaks, mixture, shards.

Each stage takes (spark, docs, sf_dir), docs being its predecessor's rows as read back from Parquet,
and works on all of them. All but the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from folium.llm import decontamination, jaccard_join, mixing, quality, sharding
from folium.llm.shared import new_folder, remove, table, tidy, write_table

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]

#: The classifier, hash orders and shards are ours, so SQL cannot give these rows; tests hold them against brute force.
ORACLE_SQL = None


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier does not reject."""
    weights = quality.train(docs, table(spark, sf_dir, "labels"))
    scored = quality.score(docs.select(*COLUMNS), weights)
    return scored.where(F.col("quality_score") >= 0.5).select(*COLUMNS)


def keep_one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates, the one of the smallest doc_id."""
    return jaccard_join.keep_one_of_each(docs.select(*COLUMNS))


def remove_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the passages that hold benchmark phrases; one that is nothing else goes."""
    clean = decontamination.remove_leaks(docs.select(*COLUMNS), table(spark, sf_dir, "benchmark"))
    return clean.withColumn("n_chars", F.when(F.col("text").isNotNull(), F.length("text").cast("long")).otherwise(F.col("n_chars"))).select(*COLUMNS)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them: a row for each time."""
    sizes = write_table(mixing.number_copies(mixing.document_sizes(docs)), "mix-sizes")
    times = mixing.mix(sizes).where(F.col("epoch").isNotNull()).groupBy("doc_id", "copy", "source").agg(F.count(F.lit(1)).cast("int").alias("_times"))
    times = write_table(times.select(F.col("doc_id").alias("_id"), F.col("copy").alias("_copy"), F.col("source").alias("_source"), "_times"), "mix-times")
    text = F.coalesce(F.col("text"), F.lit(""))
    plain = docs.select(*COLUMNS, F.xxhash64(text, F.length(text)).alias("copy"))
    same = Window.partitionBy("doc_id", "copy").orderBy("source")
    numbered = plain.withColumn("copy", F.col("copy") + F.row_number().over(same) - 1)
    taken = numbered.join(times, F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("copy") == F.col("_copy")) & F.col("source").eqNullSafe(F.col("_source")))
    return taken.select(*COLUMNS, F.explode(F.sequence(F.lit(1), F.col("_times"))).alias("_time")).select(*COLUMNS)


def shard(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every row with its shard and its slot there."""
    rows = sharding.shard_documents(docs.select(*COLUMNS), grow=False)
    text = F.coalesce(F.col("text"), F.lit(""))
    return sharding.number_rows(rows, "shard", [F.col("doc_id"), F.crc32(text.cast("binary")), F.length(text)]).select(*COLUMNS, "region", "rack", "shard", "slot")


STAGES = [
    ("quality classifier", keep_good),
    ("n-gram Jaccard join", keep_one_of_each),
    ("benchmark decontamination", remove_leaks),
    ("mixing sources to target weights", mix_sources),
    ("sharding", shard),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; each stage's rows are written to the shared folder and read again, and go when the next are written."""
    docs, last = table(spark, sf_dir, "documents"), None
    for name, stage in STAGES[:-1]:
        path = new_folder(spark, "pipeline-" + name.replace(" ", "-"))
        with tidy(spark):
            stage(spark, docs, sf_dir).write.parquet(path)
        if last is not None:
            remove(spark, last)
        docs, last = spark.read.parquet(path), path
    return STAGES[-1][1](spark, docs, sf_dir)
