"""Operator 10, mixing sources to target weights: a multivariate-hypergeometric splitting tree (native).

Each source's documents are permuted by a hash and cut into blocks. A source's target fixes an
exact quota: whole epochs over all its blocks, then whole blocks of one more epoch, then a part
of one last block at document level and, until none fits, other documents of the source, the
largest first. A binary tree over the output shards partitions the pool of all quota blocks: at
each node the blocks are put in a hash order of that node and exactly the left side's share goes
left, so the left side's count of each source is one multivariate hypergeometric draw. The leaf
counts are the quotas of (source, shard); each shard then draws its quota as a disjoint run of the
source's permuted blocks and shuffles its documents locally.

Only block rows, whose number is bounded by BLOCKS plus twice the sources, meet in one task;
documents move as ids and sizes, never as texts.

Defined cases: a null or blank text has size 0 and is never taken; a very long text counts whole and is taken only where it
fits; equal draws go by doc_id and copy; a null source is a source of
its own, last in order; repeated rows are documents of their own; a source without words has
target 0; an empty table gives no rows; other columns of the input are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from folium.llm.shared import BLANKS, clear, write_table

MOST_REPEATS = 3
WEIGHTS = (1, 2, 3)
SHARDS = 16
#: Tables of sources and blocks are broadcast up to so many rows; beyond, Spark joins them by key.
SMALL_ROWS = 100_000
#: Blocks of all sources in one epoch, about; a source has at least one.
BLOCKS = 4096
SEED = 20_240_607


def word_count(text: Column) -> Column:
    """Number of `[^\\x20\\x09-\\x0D]+` in a text: each word with the blanks behind it becomes one character, in one pass."""
    begun = F.ltrim(F.coalesce(text, F.lit("")), F.lit(BLANKS))
    return F.length(F.regexp_replace(begun, r"[^\x20\x09-\x0D]++[\x20\x09-\x0D]*+", ".")).cast("long")


def targets(sizes: DataFrame, most_repeats: int = MOST_REPEATS) -> DataFrame:
    """source, source_size, weight and target of every source; sizes has source and size."""
    sources = sizes.groupBy("source").agg(F.sum("size").cast("long").alias("source_size"), F.count(F.lit(1)).alias("n_docs"))
    by_code_point = Window.orderBy(F.col("source").asc_nulls_last())
    rank = F.row_number().over(by_code_point)
    sources = sources.withColumn("weight", F.element_at(F.array(*[F.lit(w) for w in WEIGHTS]), F.pmod(rank - 1, F.lit(len(WEIGHTS))) + 1).cast("double"))
    cap = (F.col("source_size") * most_repeats).cast("double")
    sources = sources.withColumn("_cap", cap).withColumn("_level", cap / F.col("weight"))
    whole = Window.partitionBy()
    order = Window.orderBy("_level", F.col("source").asc_nulls_last())
    earlier = order.rowsBetween(Window.unboundedPreceding, -1)
    filled = F.coalesce(F.sum("_cap").over(earlier), F.lit(0.0))
    rest = F.col("_all") - filled
    weights_left = F.col("_weights") - F.coalesce(F.sum("weight").over(earlier), F.lit(0.0))
    sources = sources.withColumn("_all", F.sum("source_size").over(whole).cast("double")).withColumn("_weights", F.sum("weight").over(whole))
    # The water level if this source and all after it are below their caps: the first such level holds for all.
    sources = sources.withColumn("_water", rest / weights_left)
    level = F.min(F.when(F.col("_level") >= F.col("_water"), F.struct(F.col("_level"), F.col("_water")))).over(whole)["_water"]
    return sources.withColumn("_found", level).select("source", "source_size", "n_docs", "weight", F.when(F.col("_level") >= F.col("_found"), F.col("weight") * F.col("_found")).otherwise(F.col("_cap")).alias("target"))


def _same(a: Column, b: Column) -> Column:
    return a.eqNullSafe(b)


def split_quotas(blocks: DataFrame, shards: int, seed: int = SEED) -> DataFrame:
    """Quota of blocks for each (source, shard): blocks has a row for each block that the mix takes.

    Down the tree, a node over shards [low, high) sends the first floor(n * left / all) of its n
    blocks in hash order to its left half, so all shards get the same number, at most one apart per level.
    """
    nodes = blocks.withColumn("_low", F.lit(0)).withColumn("_high", F.lit(shards))
    depth = max(1, (shards - 1).bit_length()) if shards > 1 else 0
    for level in range(depth):
        order = Window.partitionBy("_low", "_high").orderBy(F.xxhash64("source", "epoch", "block", "_low", "_high", F.lit(seed + level)), "source", "epoch", "block")
        middle = F.floor((F.col("_low") + F.col("_high")) / 2).cast("int")
        nodes = nodes.withColumn("_mid", middle).withColumn("_n", F.count(F.lit(1)).over(Window.partitionBy("_low", "_high"))).withColumn("_at", F.row_number().over(order))
        goes_left = F.col("_at") <= F.floor(F.col("_n") * (F.col("_mid") - F.col("_low")) / (F.col("_high") - F.col("_low")))
        leaf = F.col("_high") - F.col("_low") <= 1
        nodes = nodes.withColumn("_new_low", F.when(leaf | goes_left, F.col("_low")).otherwise(F.col("_mid"))).withColumn("_high", F.when(leaf, F.col("_high")).when(goes_left, F.col("_mid")).otherwise(F.col("_high")))
        nodes = nodes.withColumn("_low", F.col("_new_low")).drop("_mid", "_n", "_at", "_new_low")
    return nodes.groupBy("source", F.col("_low").alias("shard")).agg(F.count(F.lit(1)).alias("quota"))


def _with_size(state: Column, group: Column) -> Column:
    """Words left and how many documents of each size are picked, after as many as fit of the documents of one more size."""
    n = F.least(group["n"], F.floor(state["left"] / group["size"]).cast("long"))
    more = F.array(F.struct(group["size"].alias("size"), n.alias("n")))
    return F.struct((state["left"] - n * group["size"]).alias("left"), F.when(n > 0, F.concat(state["picks"], more)).otherwise(state["picks"]).alias("picks"))


def _last_of_each_size(rows: DataFrame) -> DataFrame:
    """The _n-th document, in hash order, of each source and size: _source, _size and its `_last` (_draw, doc_id, copy).

    Many documents may have one size, so ranges of the hash are counted, and only the range in which the last place falls is sorted.
    """
    ranged = rows.withColumn("_range", F.shiftright("_draw", 52))
    counts = ranged.groupBy("source", "size", "_range").agg(F.count(F.lit(1)).alias("_in"), F.first("_n").alias("_most"))
    before = Window.partitionBy("source", "size").orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.withColumn("_room", F.col("_most") - F.coalesce(F.sum("_in").over(before), F.lit(0)))
    counts = counts.where("_room > 0 and _room <= _in").select(F.col("source").alias("_s"), F.col("size").alias("_z"), F.col("_range").alias("_r"), "_room")
    cut = ranged.join(counts, _same(F.col("source"), F.col("_s")) & (F.col("size") == F.col("_z")) & (F.col("_range") == F.col("_r")))
    in_range = Window.partitionBy("source", "size", "_range").orderBy("_draw", "doc_id", "copy")
    last = cut.withColumn("_at", F.row_number().over(in_range)).where("_at = _room")
    return last.select(F.col("source").alias("_source"), F.col("size").alias("_size"), F.struct("_draw", "doc_id", "copy").alias("_last"))


def mix(sizes: DataFrame, shards: int = SHARDS, most_repeats: int = MOST_REPEATS, blocks: int = BLOCKS, seed: int = SEED) -> DataFrame:
    """A row for each time that the mix takes a document, with its place.

    sizes: doc_id, copy (tells rows with one doc_id apart), source, size. Returns doc_id, copy, source, size,
    source_size, target, epoch, shard, position; a document that is not taken has one row with a null epoch.
    Each step is written, as the driver plans a query of many joins anew whenever one of its stages ends.
    """
    used_up: list[str] = []
    goal = write_table(targets(sizes, most_repeats), "mix-targets", scratch=used_up)
    small = F.broadcast if goal.count() * (most_repeats + 1) + 2 * blocks * most_repeats <= SMALL_ROWS else lambda x: x
    total_docs = F.sum("n_docs").over(Window.partitionBy())
    plan = goal.withColumn("n_blocks", F.greatest(F.lit(1), F.ceil(F.lit(blocks) * F.col("n_docs") / total_docs)).cast("long"))
    plan = plan.withColumn("epochs", F.when(F.col("source_size") > 0, F.least(F.floor(F.col("target") / F.col("source_size")), F.lit(most_repeats))).otherwise(0).cast("int"))
    plan = plan.withColumn("rest", F.when(F.col("epochs") >= most_repeats, F.lit(0.0)).otherwise(F.col("target") - F.col("epochs") * F.col("source_size")))
    plan = plan.withColumnRenamed("source", "_source")
    draw = F.xxhash64("doc_id", "copy", "size", F.lit(seed))
    placed = sizes.join(small(plan), _same(F.col("source"), F.col("_source"))).drop("_source")
    placed = placed.withColumn("_draw", draw).withColumn("block", F.pmod(F.col("_draw"), F.col("n_blocks")))
    placed = write_table(placed.select("doc_id", "copy", "source", "size", "_draw", "block"), "mix-documents", scratch=used_up)

    per_block = placed.groupBy("source", "block").agg(F.sum("size").alias("words"))
    in_order = Window.partitionBy("source").orderBy(F.xxhash64("block", F.lit(seed)), "block")
    before = F.coalesce(F.sum("words").over(in_order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    per_block = per_block.withColumn("rank", F.row_number().over(in_order)).withColumn("_before", before)
    per_block = per_block.join(small(plan), _same(F.col("source"), F.col("_source"))).drop("_source")
    per_block = per_block.withColumn("whole", F.col("_before") + F.col("words") <= F.col("rest")).withColumn("room", F.when(~F.col("whole") & (F.col("_before") < F.col("rest")), F.col("rest") - F.col("_before")))
    per_block = write_table(per_block.select("source", "block", "words", "rank", "epochs", "whole", "room", "rest", "source_size", "target"), "mix-blocks", scratch=used_up)

    # Block rows of all epochs that the mix draws from; the last, partial block counts as one.
    taken = F.col("epochs") + F.when(F.col("whole") | F.col("room").isNotNull(), 1).otherwise(0)
    drawn = per_block.where(taken > 0).select("source", "block", "rank", F.explode(F.sequence(F.lit(1), taken)).alias("epoch"))
    quotas = split_quotas(drawn, shards, seed)
    # A shard's quota of a source is a run of the source's blocks in permuted order.
    runs = Window.partitionBy("source").orderBy("shard")
    quotas = quotas.withColumn("_to", F.sum("quota").over(runs)).withColumn("_from", F.col("_to") - F.col("quota")).withColumnRenamed("source", "_source")
    permuted = Window.partitionBy("source").orderBy(F.xxhash64("block", "epoch", F.lit(seed + 1)), "epoch", "block")
    drawn = drawn.withColumn("_place", F.row_number().over(permuted) - 1)
    drawn = drawn.join(small(quotas), _same(F.col("source"), F.col("_source")) & (F.col("_place") >= F.col("_from")) & (F.col("_place") < F.col("_to")))
    drawn = write_table(drawn.select("source", "block", "epoch", "shard"), "mix-drawn").withColumnsRenamed({"source": "_source", "block": "_block"})

    # The partial block: its documents in hash order as far as they fit.
    edges = per_block.withColumnsRenamed({"source": "_source", "block": "_block"}).select("_source", "_block", "room", "whole", "epochs", "source_size", "target")
    rows = placed.join(small(edges), _same(F.col("source"), F.col("_source")) & (F.col("block") == F.col("_block"))).drop("_source", "_block")
    in_block = Window.partitionBy("source", "block").orderBy("_draw", "doc_id", "copy").rowsBetween(Window.unboundedPreceding, 0)
    partial = rows.where(F.col("room").isNotNull()).withColumn("_fits", F.sum("size").over(in_block) <= F.col("room"))
    rows = rows.where(F.col("room").isNull()).withColumn("_fits", F.col("whole")).unionByName(partial)
    rows = write_table(rows.select("doc_id", "copy", "source", "size", "source_size", "target", "block", "epochs", "room", "_draw", "_fits"), "mix-rows")
    # What is left is filled from all documents of the source that are not in yet, the largest that fits first, until none fits.
    left = rows.where(F.col("room").isNotNull()).groupBy("source").agg(F.first("room").alias("_room"), F.sum(F.when(F.col("_fits"), F.col("size")).otherwise(0)).alias("_used"))
    left = left.select(F.col("source").alias("_source"), (F.col("_room") - F.col("_used")).alias("_gap"))
    spare = rows.where(~F.col("_fits") & (F.col("size") > 0)).join(small(left), _same(F.col("source"), F.col("_source")))
    spare = spare.where(F.col("size") <= F.col("_gap")).groupBy("source", "size").agg(F.count(F.lit(1)).alias("n"), F.first("_gap").alias("_gap"))
    spare = spare.groupBy("source").agg(F.sort_array(F.collect_list(F.struct("size", "n")), asc=False).alias("_sizes"), F.first("_gap").alias("_gap"))
    picks = F.aggregate("_sizes", F.struct(F.col("_gap").alias("left"), F.array().cast("array<struct<size:bigint,n:bigint>>").alias("picks")), _with_size)
    spare = spare.select(F.col("source").alias("_source"), F.explode(picks["picks"]).alias("_pick")).select("_source", F.col("_pick.size").alias("_size"), F.col("_pick.n").alias("_n"))
    spare = write_table(spare, "mix-picks", small=True, scratch=used_up)
    picked = rows.where(~F.col("_fits")).join(small(spare), _same(F.col("source"), F.col("_source")) & (F.col("size") == F.col("_size")))
    last = write_table(_last_of_each_size(picked.select("doc_id", "copy", "source", "size", "_draw", "_n")), "mix-last", small=True)
    clear(rows.sparkSession, used_up)
    rows = rows.join(small(last), _same(F.col("source"), F.col("_source")) & (F.col("size") == F.col("_size")), "left")
    rows = rows.withColumn("_extra", F.col("_fits") | F.coalesce(F.struct("_draw", "doc_id", "copy") <= F.col("_last"), F.lit(False)))

    # Epochs of a document: the whole ones, and one more if it is in the fraction.
    n = F.col("epochs") + F.when(F.col("_extra"), 1).otherwise(0)
    rows = rows.withColumn("epoch", F.explode_outer(F.when((n > 0) & (F.col("size") > 0), F.sequence(F.lit(1), n))))
    rows = rows.select("doc_id", "copy", "source", "size", "source_size", "target", "block", "epoch", "_draw")
    out = rows.join(small(drawn.withColumnRenamed("epoch", "_epoch")), _same(F.col("source"), F.col("_source")) & (F.col("block") == F.col("_block")) & (F.col("epoch") == F.col("_epoch")), "left")
    # A document picked from outside the blocks goes to a shard by its hash.
    shard = F.when(F.col("epoch").isNotNull(), F.coalesce(F.col("shard"), F.pmod(F.col("_draw"), F.lit(shards)).cast("int")))
    out = out.withColumn("shard", shard).withColumn("position", F.when(F.col("epoch").isNotNull(), F.xxhash64("doc_id", "copy", "epoch", F.lit(seed + 2))))
    return out.select("doc_id", "copy", "source", "size", "source_size", "target", "epoch", "shard", "position")


def document_sizes(docs: DataFrame) -> DataFrame:
    """doc_id, copy, source and size in words; copy is a checksum of the row, so that ids may repeat."""
    text = F.coalesce(F.col("text"), F.lit(""))
    return docs.select("doc_id", F.xxhash64(text, F.length(text)).alias("copy"), "source", word_count(F.col("text")).alias("size"))


def number_copies(sizes: DataFrame) -> DataFrame:
    """Makes (doc_id, copy) unique: equal rows get numbers. Few rows share an id; windows are small."""
    same = Window.partitionBy("doc_id", "copy").orderBy("source")
    return sizes.withColumn("copy", F.col("copy") + F.row_number().over(same) - 1)


def op10(docs: DataFrame) -> DataFrame:
    """doc_id, size, source_size, target, taken for every row of documents, with the shards that hold it."""
    sizes = write_table(number_copies(document_sizes(docs)), "mix-sizes")
    rows = mix(sizes)
    out = rows.groupBy("doc_id", "copy", "source").agg(F.first("size").alias("size"), F.first("source_size").alias("source_size"), F.first("target").alias("target"), (F.count("epoch") * F.first("size")).cast("long").alias("taken"), F.concat_ws(",", F.array_sort(F.collect_list("shard")).cast("array<string>")).alias("shards"))
    return out.select("doc_id", "source", "size", "source_size", "target", "taken", "shards")
