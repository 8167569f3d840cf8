"""Operator 4, sharding: a hierarchical weighted hash tree (native).

A document descends region, rack and shard. At each level every sibling draws an exponential
variable from a hash of (document, node) at the rate of its subtree's weight, and the smallest
draw wins; only the winner's children draw at the next level, so a document costs as many hashes
as there are regions, racks of a region and shards of a rack. A draw depends on the node and its weight
alone: where a weight changes, documents move only into or out of the subtrees whose weights
change, and within those only between children whose weights change.

The base tree has racks of SHARDS_PER_RACK shards and regions of RACKS_PER_REGION racks. A shard that is
added to it later is a region of its own, so it takes rows only into itself (law `key`).

Defined cases: a null id draws like any other value (all null ids share one shard); a null
text has no bytes and the checksum of an empty text; very long texts only count; equal draws go to the node of the
smallest number; repeated rows share a shard and take separate slots; an empty table gives no rows; columns
region, rack, shard, grown_shard and slot of the input are replaced, others stay.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

SHARDS = 40
SHARDS_PER_RACK, RACKS_PER_REGION = 5, 4
#: Rows that are numbered by one task at a time.
ROWS_PER_RUN = 50_000
OVERHEAD_BYTES = 16


@dataclass(frozen=True)
class Leaf:
    region: int
    rack: int
    shard: int
    weight: float = 1.0


def topology(shards: int, weights: dict[int, float] | None = None, base: int | None = None) -> list[Leaf]:
    """The base tree of `base` shards (all, if not given); each further shard is a region with one rack."""
    base = shards if base is None else min(base, shards)
    per_region = SHARDS_PER_RACK * RACKS_PER_REGION
    regions, racks = -(-base // per_region), -(-base // SHARDS_PER_RACK)
    places = [(s // per_region, s // SHARDS_PER_RACK) if s < base else (regions + s - base, racks + s - base) for s in range(shards)]
    return [Leaf(*places[s], s, (weights or {}).get(s, 1.0)) for s in range(shards)]


@dataclass(frozen=True)
class Level:
    """The nodes of one level: number, weight and children (of the level below) of each."""

    name: str
    weights: dict[int, float]
    children: dict[int, list[int]]


def levels(leaves: list[Leaf]) -> list[Level]:
    """Root, regions and racks with their children, and the weights of those children."""
    leaves = [leaf for leaf in leaves if leaf.weight > 0]
    if not leaves:
        raise ValueError("no shard has a weight")
    out = []
    for name, parent, child in (("region", lambda x: 0, lambda x: x.region), ("rack", lambda x: x.region, lambda x: x.rack), ("shard", lambda x: x.rack, lambda x: x.shard)):
        weights: dict[int, float] = {}
        children: dict[int, list[int]] = {}
        for leaf in leaves:
            weights[child(leaf)] = weights.get(child(leaf), 0.0) + leaf.weight
            if child(leaf) not in children.setdefault(parent(leaf), []):
                children[parent(leaf)].append(child(leaf))
        out.append(Level(name, weights, children))
    return out


#: Tells the draws of regions, racks and shards apart.
SALT = {"region": 1, "rack": 2, "shard": 3}


def draw(key: Column, level: str, node: Column, weight: Column) -> Column:
    """An exponential variable with the node's weight as its rate, from 52 bits of a hash."""
    bits = F.shiftrightunsigned(F.xxhash64(key, F.lit(SALT[level]).cast("long"), node.cast("long")), 12).cast("double")
    return -F.log((bits + F.lit(0.5)) / F.lit(float(1 << 52))) / weight


def _winner(key: Column, level: Level, parent: Column | None) -> Column:
    """The struct (draw, node) that wins among the children of a node."""
    if parent is None:
        nodes = [(F.lit(node), F.lit(level.weights[node])) for node in level.children[0]]
        draws = [F.struct(draw(key, level.name, node, weight).alias("draw"), node.alias("node")) for node, weight in nodes]
        return draws[0] if len(draws) == 1 else F.least(*draws)
    # Children and weights of every possible parent, as constants that its number looks up.
    numbers = range(max(level.children) + 1)
    lists = F.array(*[F.array(*[F.struct(F.lit(c).alias("node"), F.lit(level.weights[c]).alias("weight")) for c in level.children[p]]) if p in level.children else F.lit(None) for p in numbers])
    own = F.element_at(lists, parent + 1)
    most = max(map(len, level.children.values()))
    draws = []
    for k in range(most):
        child = F.get(own, F.lit(k))
        draws.append(F.when(child.isNotNull(), F.struct(draw(key, level.name, child["node"], child["weight"]).alias("draw"), child["node"].alias("node"))))
    return draws[0] if most == 1 else F.least(*draws)


def descend(docs: DataFrame, key: Column, leaves: list[Leaf]) -> DataFrame:
    """docs with _shards_region (the struct (draw, node) that won), region, rack and shard."""
    regions, racks, shards = levels(leaves)
    # Some child always wins. Spark cannot know that, and would push null checks with the whole descent in them below joins.
    some = lambda node: F.coalesce(node, F.lit(0))
    out = docs.withColumn("_shards_region", _winner(key, regions, None)).withColumn("region", some(F.col("_shards_region.node")))
    out = out.withColumn("rack", some(_winner(key, racks, F.col("region"))["node"]))
    return out.withColumn("shard", some(_winner(key, shards, F.col("rack"))["node"]))


def number_rows(rows: DataFrame, by: str, order: list[Column], rows_per_run: int = ROWS_PER_RUN) -> DataFrame:
    """A gapless number from 0 in `slot` for the rows of each value of `by`.

    Rows go to runs by a hash of their order columns; a task numbers one run, and the runs' counts give the
    offsets. No task gets a whole shard, however few shards there are.
    """
    total = rows.count()
    runs = max(1, total // rows_per_run // SHARDS + 1)
    spread = rows.withColumn("_shards_run", F.pmod(F.xxhash64(*order), F.lit(runs)).cast("int"))
    counts = spread.groupBy(by, "_shards_run").agg(F.count(F.lit(1)).alias("_shards_n"))
    before = Window.partitionBy(by).orderBy("_shards_run").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select(F.col(by).alias("_shards_by"), F.col("_shards_run").alias("_shards_r"), F.coalesce(F.sum("_shards_n").over(before), F.lit(0)).alias("_shards_before"))
    inside = Window.partitionBy(by, "_shards_run").orderBy(*order)
    numbered = spread.withColumn("_shards_at", F.row_number().over(inside) - 1)
    joined = numbered.join(offsets, (F.col(by) == F.col("_shards_by")) & (F.col("_shards_run") == F.col("_shards_r")))
    return joined.withColumn("slot", (F.col("_shards_before") + F.col("_shards_at")).cast("long")).drop("_shards_run", "_shards_by", "_shards_r", "_shards_n", "_shards_at", "_shards_before")


def shard_documents(docs: DataFrame, shards: int = SHARDS, weights: dict[int, float] | None = None, grow: bool = True) -> DataFrame:
    """Shard, and with grow the shard under one shard more, of every row; all columns of docs are kept."""
    out = descend(docs.drop("region", "rack", "shard"), F.col("doc_id"), topology(shards, weights))
    if grow:
        # One more shard is one more region: the draws of the others, and all below them, stay as they are.
        added = topology(shards + 1, weights, base=shards)[-1]
        own = draw(F.col("doc_id"), "region", F.lit(added.region), F.lit(added.weight))
        out = out.withColumn("grown_shard", F.when(F.lit(added.weight > 0) & (own < F.col("_shards_region.draw")), F.lit(added.shard)).otherwise(F.col("shard")))
    return out.drop("_shards_region")


def op4(docs: DataFrame) -> DataFrame:
    """doc_id, size, text_crc32, law, region, rack, shard, slot, grown_shard for every row of documents."""
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = docs.select("doc_id", (F.octet_length(text) + OVERHEAD_BYTES).cast("long").alias("size"), F.crc32(text.cast("binary")).cast("long").alias("text_crc32"))
    out = number_rows(shard_documents(rows), "shard", [F.col("doc_id"), F.col("size"), F.col("text_crc32")])
    return out.select("doc_id", "size", "text_crc32", F.lit("key").alias("law"), "region", "rack", "shard", "slot", "grown_shard")
