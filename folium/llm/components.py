"""Connected components of a graph that stays distributed, by alternating large and small stars."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folium.llm.shared import new_folder, remove, tidy_worker

MOST_ROUNDS = 60
#: A graph of at most so many edges, 16 bytes each, is finished by one task; larger ones contract until they are that small.
FEW_EDGES = 1_000_000


def least_labels(u: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Nodes of a graph and the least node of each one's component."""
    nodes, ends = np.unique(np.concatenate([u, v]), return_inverse=True)
    a, b = ends[: len(u)], ends[len(u) :]
    label = np.arange(len(nodes))
    while True:
        low = np.minimum(label[a], label[b])
        new = label.copy()
        np.minimum.at(new, label[a], low)
        np.minimum.at(new, label[b], low)
        new = new[new]
        if (new == label).all():
            return nodes, nodes[label]
        label = new


def _finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    parts = [[b.column(c).to_numpy() for c in ("u", "v")] for b in batches]
    if parts:
        found = least_labels(*(np.concatenate([p[k] for p in parts]) for k in (0, 1)))
        yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in found], names=["node", "component"])


def _lowest(edges: DataFrame) -> DataFrame:
    """(node, least): the least of each node and its neighbours; partial minima are made before the shuffle."""
    return edges.groupBy(F.col("u").alias("node")).agg(F.min("v").alias("_m")).select("node", F.least("node", "_m").alias("least"))


def _both_ways(edges: DataFrame) -> DataFrame:
    return edges.select("u", "v").union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))


def connected_components(edges: DataFrame) -> DataFrame:
    """node, component (its least node) for every node of edges (u, v); both are numbers.

    Each round writes its edges to the shared folder. A star's centre may have any number of edges:
    its minimum is pre-aggregated, and the join that spreads it is one that Spark can split.
    """
    spark = edges.sparkSession
    folder = new_folder(spark, "components")

    def keep(df: DataFrame, name: str) -> DataFrame:
        df.write.parquet(f"{folder}/{name}")
        return spark.read.schema("u long, v long").parquet(f"{folder}/{name}")

    def state(df: DataFrame) -> tuple:
        row = df.agg(F.count(F.lit(1)), F.sum((F.xxhash64("u", "v") % 1_000_003).cast("long"))).first()
        return tuple(row)

    now = keep(edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct().hint("rebalance"), "0")
    seen = state(now)
    for k in range(1, MOST_ROUNDS):
        if seen[0] <= FEW_EDGES:
            return now.repartition(1).mapInArrow(tidy_worker(_finish), "node long, component long")
        near = _both_ways(now)
        large = near.join(_lowest(near), F.col("u") == F.col("node")).where("v > u").select(F.col("v").alias("u"), F.col("least").alias("v"))
        large = large.where("u <> v").distinct()
        down = large.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
        small = down.join(_lowest(down), F.col("u") == F.col("node"))
        small = small.select(F.col("v").alias("u"), F.col("least").alias("v")).union(small.select("u", F.col("least").alias("v"))).where("u <> v").distinct()
        following = keep(small, str(k))
        if k > 1:
            remove(spark, f"{folder}/{k - 2}")
        if (was := seen) == (seen := state(following)):
            return following.select(F.col("u").alias("node"), F.col("v").alias("component")).union(following.select(F.col("v").alias("node"), F.col("v").alias("component"))).distinct()
        now = following
    raise RuntimeError("components did not settle")
