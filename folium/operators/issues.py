"""Extraction issues: summaries by category and batches of confirmed limitations."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from folium.functions import text as X


def summary(issues: DataFrame, samples: int = 3) -> DataFrame:
    """category, unresolved, resolved, sample_ids (unresolved first, in order); issues has issue_id, ord, resolved."""
    named = issues.withColumn("category", X.issue_prefix(F.col("issue_id")))
    placed = named.withColumn("_at", F.row_number().over(Window.partitionBy("category").orderBy("resolved", "ord")))
    counts = named.groupBy("category").agg(F.count(F.when(~F.col("resolved"), 1)).alias("unresolved"), F.count(F.when(F.col("resolved"), 1)).alias("resolved"))
    # Spark keeps only the first few of each category in every task before it shuffles them.
    first = placed.where(F.col("_at") <= samples).groupBy("category").agg(F.concat_ws(",", F.array_sort(F.collect_list(F.struct("_at", "issue_id")))["issue_id"]).alias("sample_ids"))
    return counts.join(first, "category")


def batch_errors(requests: DataFrame, issues: DataFrame) -> DataFrame:
    """category, error of every refused request; requests has category, resolution, evidence; issues has category, resolved."""
    n = issues.where(~F.col("resolved")).groupBy("category").agg(F.count(F.lit(1)).alias("n_open"))
    same = F.count(F.lit(1)).over(Window.partitionBy("category"))
    asked = requests.withColumn("_same", same).join(n, "category", "left")
    error = F.coalesce(X.category_error(F.col("category")), F.when(F.col("_same") > 1, "duplicate"), X.explanation_error(F.col("resolution")), X.explanation_error(F.col("evidence"), evidence=True), F.when(F.col("n_open").isNull(), "no unresolved issue"))
    return asked.select("category", error.alias("error")).where(F.col("error").isNotNull())


def resolve_batch(issues: DataFrame, requests: DataFrame) -> DataFrame:
    """Issues after a batch: all requests apply or none does. Resolved issues stay as they are."""
    faults = batch_errors(requests, issues).agg(F.count(F.lit(1)).alias("_faults"))
    asked = requests.select("category", F.col("resolution").alias("_resolution"), F.col("evidence").alias("_evidence")).dropDuplicates(["category"])
    out = issues.join(F.broadcast(asked), "category", "left").crossJoin(faults)  # one row; requests are a stated list
    hit = F.col("_resolution").isNotNull() & ~F.col("resolved") & (F.col("_faults") == 0)
    return out.select(*issues.columns, F.when(hit, F.col("_resolution")).alias("batch_resolution"), F.when(hit, F.col("_evidence")).alias("batch_evidence"))
