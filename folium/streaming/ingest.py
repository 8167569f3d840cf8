"""Structured Streaming over landing folders and event tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folium.operators.ledger import content_id
from folium.sources.files import import_rows, supported


def landing_files(spark: SparkSession, folder: str) -> DataFrame:
    """A stream of the files of a known kind that arrive in a folder."""
    schema = "path string, modificationTime timestamp, length long, content binary"
    return supported(spark.readStream.format("binaryFile").schema(schema).option("recursiveFileLookup", "true").load(folder))


def import_stream(spark: SparkSession, folder: str, out: str, checkpoint: str, known: DataFrame | None = None):
    """Imports files as they arrive, each content once.

    The ids that were seen are the stream's state, so a batch costs what it holds, not what came before it. A micro-batch is
    written under its own number and replaces what an earlier attempt wrote there, so a replay adds nothing.
    known: doc_id of documents that were imported by other means.
    """
    once = landing_files(spark, folder).select("path", "content", content_id(F.col("content")).alias("_id")).dropDuplicates(["_id"])

    def land(batch: DataFrame, number: int) -> None:
        import_rows(batch.select("path", "content"), known).write.mode("overwrite").parquet(f"{out}/batch={number}")

    return once.writeStream.foreachBatch(land).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def event_windows(events: DataFrame, late: str = "1 hour", width: str = "1 day") -> DataFrame:
    """Events per window and type; events later than the watermark are left out of a stream."""
    timed = events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late)
    counts = timed.groupBy(F.window("ts", width).alias("w"), "event_type").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("value"), 4).alias("total"))
    return counts.select(F.col("w.start").alias("window_start"), "event_type", "n", "total")
