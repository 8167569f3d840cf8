"""The hash tree against a walk from the same hashes, and what moves when weights change."""

import math
import struct
from collections import Counter

import pytest
import xxhash
from pyspark.sql import functions as F

from folium.llm import sharding


def hash64(*values):
    seed = 42
    for v in values:
        if v is not None:
            seed = xxhash.xxh64_intdigest(struct.pack("<q", v), seed)
    return seed


def walk(key, leaves):
    """Region, rack and shard of a key, one level after the other."""
    leaves = [x for x in leaves if x.weight > 0]
    for name in ("region", "rack", "shard"):
        nodes = Counter()
        for leaf in leaves:
            nodes[getattr(leaf, name)] += leaf.weight
        draws = {node: -math.log(((hash64(key, sharding.SALT[name], node) >> 12) + 0.5) / 2**52) / weight for node, weight in nodes.items()}
        best = min(draws, key=draws.get)
        leaves = [x for x in leaves if getattr(x, name) == best]
    return leaves[0].region, leaves[0].rack, leaves[0].shard


@pytest.mark.parametrize(("shards", "weights"), [(40, None), (40, {7: 3.0, 9: 0.0}), (1, None), (7, {0: 0.0}), (23, {22: 5.0}), (40, dict.fromkeys(range(20), 0.0))])
def test_descent_by_brute_force(spark, shards, weights):
    ids = spark.range(300).select(F.when(F.col("id") > 0, F.col("id") * 7919 - 1000).alias("doc_id"))
    for r in sharding.shard_documents(ids, shards, weights).collect():
        assert (r["region"], r["rack"], r["shard"]) == walk(r["doc_id"], sharding.topology(shards, weights))
        assert r["grown_shard"] == walk(r["doc_id"], sharding.topology(shards + 1, weights, base=shards))[2] and r["grown_shard"] in (r["shard"], shards)


def test_growth_goes_on_taking_rows_only_into_new_shards(spark):
    ids = spark.range(3000).withColumnRenamed("id", "doc_id")
    found = {n: {r["doc_id"]: r["shard"] for r in sharding.descend(ids, F.col("doc_id"), sharding.topology(n, base=40)).collect()} for n in (40, 41, 42, 43)}
    for n in (40, 41, 42):
        moved = {found[n + 1][i] for i in found[n] if found[n + 1][i] != found[n][i]}
        assert moved == {n}
    counts = Counter(found[43].values())
    assert len(counts) == 43 and max(counts.values()) < 2 * 3000 / 43


def test_only_subtrees_whose_weights_change_move(spark):
    """Shards 7 and 9 are in rack 1 of region 0: rows move into region 0, into rack 1, into 7 or out of 9, and nowhere else."""
    docs = spark.range(4000).withColumnRenamed("id", "doc_id")
    before, after = ({r["doc_id"]: r for r in sharding.shard_documents(docs, 40, w).collect()} for w in (None, {7: 3.0, 9: 0.0}))
    for i, old in before.items():
        new = after[i]
        if old["region"] != new["region"]:
            assert new["region"] == 0
        elif old["rack"] != new["rack"]:
            assert new["rack"] == 1
        elif old["shard"] != new["shard"]:
            assert new["shard"] == 7 or old["shard"] == 9
    counts = Counter(r["shard"] for r in after.values())
    assert 9 not in counts and abs(counts[7] / 4000 - 3 / 41) < 0.02
