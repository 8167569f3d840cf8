"""Operator 9, exact top-k search: pivot-table elimination.

Vectors are integers, floor(SCALE * x). The rows' distances to many pivots are computed once and
kept with the rows. For a query, the largest |d(query, pivot) - d(row, pivot)| bounds the
distance from below, and so the inner product from above, by (|q|^2 + |x|^2 - d^2) / 2. Rows are
evaluated in order of their bounds until the k-th best score exceeds every bound that is left.
The bounds have a margin for rounding and scores are exact integers, so results do not depend
on the pivots, which a bounded number of rows supplies.

The queries are a stated set. They are written once, with a floor for each: its k-th best score among
the sampled rows, below which no row of any shard is evaluated. Every row then goes to one shard of bounded
size and stays there; the shard's task streams the written queries past it, a block at a time, and only
the best of each shard and query are shuffled. So a row is moved once, however many queries there are, and the
queries are read once for each shard.

Defined cases: a vector that is null, empty or holds null or non-finite components takes no
part, neither as a query nor as a row; vectors only meet those of their own length; repeated
rows are rows of their own, but no query meets a row with its own id; a null id takes no part; equal scores
go to the smaller vec_id, and repeated rows with one id are all in the result; columns but vec_id and embedding
are ignored; an empty table gives no rows; scores outside 64 bits become the nearest 64-bit number.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
from pyarrow import fs
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from folium.llm.shared import write_table

SCALE = 256
TOP = 5
QUERY_STEP = 50
PIVOTS = 32
#: Rows, of the smallest ids by hash, from which pivots are chosen.
PIVOT_SAMPLE = 2048
#: Bytes of vectors and distances that a shard holds, about.
SHARD_BYTES = 64 << 20
#: Queries that are held beside a shard at a time.
QUERY_ROWS = 2_048
FIRST_LOOK = 64


def usable(vectors: DataFrame, scale: int = SCALE) -> DataFrame:
    """vec_id and the integer vector as doubles."""
    x = F.col("embedding")
    fine = F.col("vec_id").isNotNull() & x.isNotNull() & (F.size(x) > 0) & F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))
    scaled = F.transform(x, lambda v: _floor(v.cast("double") * scale))
    return vectors.where(F.coalesce(fine, F.lit(False))).select(F.col("vec_id").cast("long").alias("vec_id"), scaled.alias("x"))


def _floor(v):
    """Floor as a double; doubles from 2^52 on are whole already, and Spark's floor is a 64-bit number."""
    return F.when(F.abs(v) < float(1 << 52), F.floor(v).cast("double")).otherwise(v)


def choose_pivots(sample: np.ndarray, n: int = PIVOTS) -> np.ndarray:
    """Far-apart rows of a sample: each next one is the farthest from those before."""
    chosen = [int(np.argmax((sample**2).sum(axis=1)))]
    nearest = ((sample - sample[chosen[0]]) ** 2).sum(axis=1)
    while len(chosen) < min(n, len(sample)) and nearest.max() > 0:
        chosen.append(int(np.argmax(nearest)))
        nearest = np.minimum(nearest, ((sample - sample[chosen[-1]]) ** 2).sum(axis=1))
    return sample[chosen]


def distances(x: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    squares = (x**2).sum(axis=1)[:, None] + (pivots**2).sum(axis=1)[None, :] - 2 * (x @ pivots.T)
    return np.sqrt(np.maximum(squares, 0))


def exact_scores(q: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """Integer inner products; past 2^53 by whole numbers of any size, kept within 64 bits."""
    largest = np.abs(q).max(initial=0) * np.abs(rows).max(initial=0) * len(q)
    if largest < 2.0**53:
        return (rows @ q).astype(np.int64)
    whole = [int(v) for v in q]
    found = [sum(a * int(b) for a, b in zip(whole, row, strict=True)) for row in rows]
    return np.array([min(max(s, -(1 << 63)), (1 << 63) - 1) for s in found], dtype=np.int64)


def search(q_ids: np.ndarray, q: np.ndarray, q_far: np.ndarray, floors: np.ndarray, ids: np.ndarray, rows: np.ndarray, far: np.ndarray, top: int) -> list[tuple[int, int, int]]:
    """(query, row, score) of the best rows of a shard for each query, by elimination; rows sure to score below a query's floor are left out."""
    norms, q_norms = (rows**2).sum(axis=1), (q**2).sum(axis=1)
    # Slack for the rounding of norms and square roots, relative to the largest values there are.
    scale = float(max(norms.max(initial=0), q_norms.max(initial=0), (far**2).max(initial=0), (q_far**2).max(initial=0)))
    slack = 1e-9 * scale + 1.0
    out = []
    for k in range(len(q)):
        bound = np.abs(far - q_far[k]).max(axis=1) if far.shape[1] else np.zeros(len(rows))
        upper = (q_norms[k] + norms - bound**2) / 2 + slack
        upper[(ids == q_ids[k]) | (upper < floors[k])] = -np.inf
        look, done, best = FIRST_LOOK, 0, (np.zeros(0, np.int64), np.zeros(0, np.int64))
        left = int(np.isfinite(upper).sum())
        ranked = np.argpartition(-upper, look)[: look + 1] if left > look else np.argsort(-upper, kind="stable")[:left]
        whole = left <= look
        ranked = ranked[np.argsort(-upper[ranked], kind="stable")]
        while done < left:
            if len(best[0]) == top and upper[ranked[done]] < best[0][-1]:
                break
            if done + look > len(ranked) and not whole:
                keep = np.flatnonzero(upper >= (best[0][-1] if len(best[0]) == top else -np.inf))
                keep = keep[np.isfinite(upper[keep])]
                ranked = keep[np.argsort(-upper[keep], kind="stable")]
                # Those evaluated had the highest bounds; evaluating a few of them again does no harm.
                done, left, whole, best = 0, len(ranked), True, (np.zeros(0, np.int64), np.zeros(0, np.int64))
                continue
            now = ranked[done : done + look]
            scores = np.concatenate([best[0], exact_scores(q[k], rows[now])])
            where = np.concatenate([best[1], now])
            pick = np.lexsort((ids[where], -scores))[:top]
            best = scores[pick], where[pick]
            done += len(now)
            look *= 2
        out += [(int(q_ids[k]), int(ids[w]), int(s)) for s, w in zip(*best, strict=True)]
    return out


def floors_of(q_ids: np.ndarray, q: np.ndarray, ids: np.ndarray, rows: np.ndarray, top: int) -> np.ndarray:
    """For each query a score that at least `top` of some rows reach; -inf where there are not as many."""
    scores = q @ rows.T
    scores[q_ids[:, None] == ids[None, :]] = -np.inf
    if len(rows) < top:
        return np.full(len(q), -np.inf)
    best = np.partition(scores, len(rows) - top, axis=1)[:, len(rows) - top]
    # Room for the rounding of scores beyond 2^53.
    return best - 1e-9 * np.abs(best) - 1.0


def _matrix(column: pa.Array) -> np.ndarray:
    """Lists of one length as rows of a matrix."""
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


def _columns(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    return batch.column("vec_id").to_numpy(), _matrix(batch.column("x")), _matrix(batch.column("far"))


def _streamer(files: list[str], top: int, query_rows: int):
    """Searches a task's rows for all queries in the files, a block of them at a time."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [_columns(b) for b in batches if b.num_rows]
        if not held:
            return
        ids, rows, far = (np.concatenate([h[k] for h in held]) for k in range(3))
        order = np.argsort(ids, kind="stable")
        ids, rows, far = ids[order], rows[order], far[order]
        for file in files:
            system, path = fs.FileSystem.from_uri(file)
            with system.open_input_file(path) as source:
                for block in pq.ParquetFile(source).iter_batches(batch_size=query_rows, columns=["vec_id", "x", "far", "floor"]):
                    if not block.num_rows:
                        continue
                    found = search(*_columns(block), block.column("floor").to_numpy(), ids, rows, far, top)
                    columns = list(zip(*found, strict=True)) or [(), (), ()]
                    yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names=["query_id", "vec_id", "score"])

    return run


def top_k(vectors: DataFrame, is_query, top: int = TOP) -> DataFrame:
    """query_id, rank, vec_id, score: the best rows for each row for which is_query holds."""
    spark = vectors.sparkSession
    data = write_table(usable(vectors), "vectors")
    sizes = data.groupBy(F.size("x").alias("dim")).agg(F.count(F.lit(1)).alias("n"), F.count(F.when(is_query, 1)).alias("nq")).collect()  # one row per vector length
    parts = []
    for dim, n, nq in sizes:
        if not nq:
            continue
        own = data.where(F.size("x") == dim)
        sample = own.orderBy(F.xxhash64("vec_id"), "vec_id", "x").limit(PIVOT_SAMPLE).toArrow().combine_chunks()
        sample_ids, sample_rows = sample["vec_id"].to_numpy(), _matrix(sample["x"].combine_chunks())
        pivots = choose_pivots(sample_rows)

        def with_distances(batches: Iterator[pa.RecordBatch], pivots=pivots) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                far = distances(_matrix(batch.column("x")), pivots) if batch.num_rows else np.zeros((0, len(pivots)))
                column = pa.FixedSizeListArray.from_arrays(pa.array(far.ravel()), len(pivots)).cast(pa.list_(pa.float64()))
                yield pa.RecordBatch.from_arrays([batch.column("vec_id"), batch.column("x"), column], names=["vec_id", "x", "far"])

        def with_floors(batches: Iterator[pa.RecordBatch], ids=sample_ids, rows=sample_rows) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                floors = floors_of(batch.column("vec_id").to_numpy(), _matrix(batch.column("x")), ids, rows, top) if batch.num_rows else []
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(floors, pa.float64())], names=[*batch.schema.names, "floor"])

        schema = "vec_id long, x array<double>, far array<double>"
        pivot_table = write_table(own.mapInArrow(with_distances, schema), "pivot-table")
        queries = write_table(pivot_table.where(is_query).mapInArrow(with_floors, schema + ", floor double"), "queries", small=True)
        shards = -(-n * 8 * (dim + len(pivots)) // SHARD_BYTES)
        shards = max(shards, min(spark.sparkContext.defaultParallelism, n // 1024 + 1))
        rows = pivot_table.repartition(shards, "vec_id")
        parts.append(rows.mapInArrow(_streamer(queries.inputFiles(), top, QUERY_ROWS), "query_id long, vec_id long, score long"))
    if not parts:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    found = parts[0]
    for part in parts[1:]:
        found = found.unionByName(part)
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= top).select("query_id", "rank", "vec_id", "score")


def op9(vectors: DataFrame) -> DataFrame:
    """The five highest integer inner products for every row whose id is divisible by 50."""
    return top_k(vectors, F.col("vec_id") % QUERY_STEP == 0)


ORACLE = r"""
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS x FROM embeddings
  WHERE embedding IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), p AS (
  SELECT q.vec_id AS query_id, r.vec_id, list_inner_product(q.x, r.x)::BIGINT AS score
  FROM v q JOIN v r ON q.vec_id % 50 = 0 AND q.vec_id <> r.vec_id AND len(q.x) = len(r.x)
)
SELECT query_id, rank::INTEGER AS rank, vec_id, score
FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM p) WHERE rank <= 5
"""
