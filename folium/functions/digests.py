"""Digests that do not depend on the order of keys: canonical JSON, then SHA-256."""

from __future__ import annotations

import hashlib
import json

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def canonical_json(value: object) -> str:
    return json.dumps(value, ensure_ascii=False, sort_keys=True)


@F.pandas_udf(T.StringType())
def json_digest(text: pd.Series) -> pd.Series:
    """SHA-256 of a JSON text in canonical form; null stays null."""
    return text.map(lambda t: None if t is None else hashlib.sha256(canonical_json(json.loads(t)).encode()).hexdigest())


def bytes_digest(content: Column) -> Column:
    return F.sha2(content.cast("binary"), 256)


#: What a review of a whole document is bound to; a table mode counts only where a block has one.
REVIEWED = ("block_id", "kind", "text", "source_ids", "target", "reviewed_hash")


def fingerprints(blocks: DataFrame, terms: DataFrame, issues: DataFrame) -> DataFrame:
    """doc_id, fingerprint of each document's blocks in order, its terms and its issues.

    Notes, assets, histories and reading settings do not enter, so they never make a review stale.
    """
    mode = [F.col("table_mode")] if "table_mode" in blocks.columns else []
    shown = F.to_json(F.struct(*[c for c in REVIEWED if c in blocks.columns], *mode))  # nulls are left out
    parts = [blocks.select("doc_id", F.lit(0).alias("part"), F.col("ord").cast("string").alias("_key"), F.col("ord").cast("long").alias("_ord"), bytes_digest(shown).alias("_hash"))]
    for k, (rows, key) in enumerate(((terms, "term_id"), (issues, "issue_id")), 1):
        parts.append(rows.select("doc_id", F.lit(k).alias("part"), F.col(key).alias("_key"), F.lit(0).cast("long").alias("_ord"), bytes_digest(F.to_json(F.struct(*[c for c in sorted(rows.columns) if c != "doc_id"]))).alias("_hash")))
    every = parts[0].unionByName(parts[1]).unionByName(parts[2])
    listed = F.array_sort(F.collect_list(F.struct("part", "_ord", "_key", "_hash")))
    return every.groupBy("doc_id").agg(bytes_digest(F.array_join(listed["_hash"], "")).alias("fingerprint"))
