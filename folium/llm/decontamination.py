"""Operator 8, benchmark decontamination: an FM-index per training shard.

The benchmark is the stated set of test phrases, taken in blocks of bounded size, each of which one task
turns into phrases and writes to the shared folder. A task reads its documents once and cuts
them into shards; it goes through the blocks, of which it holds one at a time. Words outside the block's vocabulary become separators, and a run of
known words shorter than the shortest phrase, which cannot hold one, is left out. Over the rest
the shard builds an FM-index: all phrases are searched backwards through wavelet-tree ranks, their
rows are located by sampled suffix positions, and the occurrences merge into removal spans.

Hits of all blocks meet where the document is, so documents are never shuffled, and the number of blocks
changes no result.

Defined cases: a null or wordless text has no words and no hits; a very long text is a shard of its own; a null or
wordless item has no phrase; an item longer than a block is a block of its own; items with one id count as one, and a null id counts as an empty one; repeated rows are
each searched; an empty documents or benchmark table gives no rows or no hits;
columns n_words, spans and items of the input are replaced, others stay.
"""

from __future__ import annotations

import pickle
import uuid
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from folium.llm import hashing
from folium.llm.fm_index import FMIndex
from folium.llm.shared import lean_batches, new_folder, tidy_worker
from folium.llm.store import Store

WINDOW = 10
#: Bytes of benchmark text that a block holds, about; its phrases take some ten times that.
BLOCK_BYTES = 4 << 20
SHARD_WORDS = 1 << 20
#: Bytes of documents for which a task goes through the blocks once, about, where there are several.
GROUP_BYTES = 32 << 20

FOUND = T.StructType(
    [
        T.StructField("n_words", T.LongType()),
        T.StructField("spans", T.ArrayType(T.StructType([T.StructField("begin", T.IntegerType()), T.StructField("end", T.IntegerType())]))),
        T.StructField("items", T.ArrayType(T.StringType())),
    ]
)
_FOUND_TYPES = (pa.int64(), pa.list_(pa.struct([("begin", pa.int32()), ("end", pa.int32())])), pa.list_(pa.string()))


@dataclass
class Phrases:
    """Distinct phrases of a block, as numbers of its vocabulary, and the items that hold each."""

    vocabulary: np.ndarray
    by_length: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]]  # phrases, bounds into items, items
    item_names: list[str]

    @property
    def shortest(self) -> int:
        return min(self.by_length)


def phrases_of(item_ids: list, texts: pa.Array, window: int = WINDOW) -> Phrases | None:
    names = sorted({"" if i is None else str(i) for i in item_ids})
    number = {name: k for k, name in enumerate(names)}
    found: dict[int, list[tuple[np.ndarray, int]]] = {}
    values = hashing.byte_values()
    for low, high, bounds, words in hashing.tokenise(texts, hashing.ALNUM, values):
        for row in range(high - low):
            own = words[bounds[row] : bounds[row + 1]]
            if len(own):
                n = min(window, len(own))
                item = item_ids[low + row]
                found.setdefault(n, []).append((np.lib.stride_tricks.sliding_window_view(own, n), number["" if item is None else str(item)]))
    if not found:
        return None
    vocabulary = np.unique(np.concatenate([w.ravel() for group in found.values() for w, _ in group]))
    by_length = {}
    for n, group in found.items():
        windows = (np.searchsorted(vocabulary, np.concatenate([w for w, _ in group])) + 1).astype(np.int32)
        items = np.concatenate([np.full(len(w), item) for w, item in group])
        phrases, which = np.unique(windows, axis=0, return_inverse=True)
        pairs = np.unique(np.stack([which.ravel(), items], axis=1), axis=0)
        by_length[n] = (phrases, np.searchsorted(pairs[:, 0], np.arange(len(phrases) + 1)), pairs[:, 1])
    return Phrases(vocabulary, by_length, names)


def numbers_of(words: np.ndarray, vocabulary: np.ndarray) -> np.ndarray:
    """Place of each word in the sorted vocabulary, from 1; 0 for a word that isn't there."""
    at = np.searchsorted(vocabulary, words)
    at[at == len(vocabulary)] = 0
    return np.where(vocabulary[at] == words, at + 1, 0)


def search_shard(words: np.ndarray, bounds: np.ndarray, phrases: Phrases) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hits in a shard of documents: flags of words, and distinct (document, item) pairs."""
    none = np.zeros(len(words), dtype=bool), np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64)
    numbers = numbers_of(words, phrases.vocabulary)
    known = numbers > 0
    first = known.copy()
    first[1:] &= ~known[:-1]
    heads = bounds[:-1][bounds[:-1] < bounds[1:]]
    first[heads] = known[heads]
    starts = np.flatnonzero(first)
    if not len(starts):
        return none
    last = known.copy()
    last[:-1] &= ~known[1:] | first[1:]
    ends = np.flatnonzero(last) + 1
    long = ends - starts >= phrases.shortest
    starts, ends = starts[long], ends[long]
    if not len(starts):
        return none
    # The segments, each with a separator behind it; source tells the word of each symbol.
    sizes = ends - starts + 1
    total = np.concatenate([[0], np.cumsum(sizes)])
    source = np.arange(total[-1]) + np.repeat(starts - total[:-1], sizes)
    text = np.zeros(total[-1], dtype=np.int64)
    inside = np.ones(total[-1], dtype=bool)
    inside[total[1:] - 1] = False
    text[inside] = numbers[source[inside]]
    index = FMIndex(text, len(phrases.vocabulary) + 1)

    change = np.zeros(len(words) + 1, dtype=np.int64)
    docs, items = [], []
    for n, (patterns, item_bounds, item_of) in phrases.by_length.items():
        which, low, high = index.search(patterns)
        if not len(which):
            continue
        count = high - low
        rows = np.arange(count.sum()) + np.repeat(low - np.concatenate([[0], np.cumsum(count)[:-1]]), count)
        at = source[index.locate(rows)]
        np.add.at(change, at, 1)
        np.add.at(change, at + n, -1)
        doc = np.searchsorted(bounds, at, side="right") - 1
        pairs = np.unique(np.stack([doc, np.repeat(which, count)], axis=1), axis=0)
        many = item_bounds[pairs[:, 1] + 1] - item_bounds[pairs[:, 1]]
        places = np.arange(many.sum()) + np.repeat(item_bounds[pairs[:, 1]] - np.concatenate([[0], np.cumsum(many)[:-1]]), many)
        docs.append(np.repeat(pairs[:, 0], many))
        items.append(item_of[places])
    if not docs:
        return none
    pairs = np.unique(np.stack([np.concatenate(docs), np.concatenate(items)], axis=1), axis=0)
    return np.cumsum(change[:-1]) > 0, pairs[:, 0], pairs[:, 1]


def _shards(texts: pa.Array, shard_words: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Words and document bounds of consecutive documents, about shard_words at a time."""
    parts, n, bounds = [], 0, [np.zeros(1, dtype=np.int64)]
    for _, _, own, words in hashing.tokenise(texts, hashing.ALNUM, hashing.byte_values()):
        parts.append(words)
        bounds.append(own[1:] + n)
        n += len(words)
        if n >= shard_words:
            yield np.concatenate(parts), np.concatenate(bounds)
            parts, n, bounds = [], 0, [np.zeros(1, dtype=np.int64)]
    if len(bounds) > 1:
        yield np.concatenate(parts), np.concatenate(bounds)


def find_in_texts(texts: pa.Array, blocks: Iterable[Callable[[], Phrases]], shard_words: int = SHARD_WORDS) -> list[pa.Array]:
    """n_words, spans and items of each text; a span is a maximal range of hit words. A block is loaded when its turn comes."""
    shards = list(_shards(texts, shard_words))
    hits = [np.zeros(len(words), dtype=bool) for words, _ in shards]
    items: list[list[set[str]]] = [[set() for _ in range(len(bounds) - 1)] for _, bounds in shards]
    for load in blocks:
        phrases = load()
        for k, (words, bounds) in enumerate(shards):
            hit, doc, item = search_shard(words, bounds, phrases)
            hits[k] |= hit
            for d, i in zip(doc.tolist(), item.tolist(), strict=True):
                items[k][d].add(phrases.item_names[i])
    counts = np.concatenate([np.diff(bounds) for _, bounds in shards]) if shards else np.zeros(0, dtype=np.int64)
    spans = [s for hit, (_, bounds) in zip(hits, shards, strict=True) for s in _spans(hit, bounds)]
    return [pa.array(x, t) for x, t in zip((counts, spans, [sorted(x) for own in items for x in own]), _FOUND_TYPES, strict=True)]


def _spans(hit: np.ndarray, bounds: np.ndarray) -> list[list[dict[str, int]]]:
    """The ranges of hit words of each document in a shard."""
    out: list[list[dict[str, int]]] = [[] for _ in range(len(bounds) - 1)]
    edge = np.diff(np.concatenate([[0], hit.astype(np.int8), [0]]))
    for a, b in zip(np.flatnonzero(edge == 1), np.flatnonzero(edge == -1), strict=True):  # runs of neighbouring documents touch
        k = int(np.searchsorted(bounds, a, side="right")) - 1
        while a < b:
            stop = min(b, bounds[k + 1])
            if stop > a:
                out[k].append({"begin": int(a - bounds[k]), "end": int(stop - bounds[k])})
            a, k = stop, k + 1
    return out


_loaded: dict[str, Phrases] = {}


def _loader(folder: str, name: str) -> Callable[[], Phrases]:
    """Reads a block; a worker keeps the last one."""

    def load() -> Phrases:
        if name not in _loaded:
            _loaded.clear()
            with Store(folder).stream(name) as stream:
                _loaded[name] = Phrases(*pickle.loads(stream.read()))
        return _loaded[name]

    return load


def _finder(folder: str, names: list[str], keep: list[str], group_bytes: int) -> Callable:
    def groups(batches: Iterator[pa.RecordBatch]) -> Iterator[list[pa.RecordBatch]]:
        group, held = [], 0
        for batch in batches:
            group.append(batch)
            held += batch.column("text").nbytes
            if len(names) < 2 or held >= group_bytes:
                yield group
                group, held = [], 0
        if group:
            yield group

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in groups(batches):
            texts = pa.concat_arrays([batch.column("text") for batch in group])
            found = find_in_texts(texts, [_loader(folder, name) for name in names])
            at = 0
            for batch in group:
                yield pa.RecordBatch.from_arrays([batch.column(c) for c in keep] + [x.slice(at, batch.num_rows) for x in found], names=keep + FOUND.names)
                at += batch.num_rows

    return find


def _write_blocks(benchmark: DataFrame, folder: str, block_bytes: int) -> list[str]:
    """Writes each block's phrases as a file and returns the files' names; the driver sees no text."""
    rows = benchmark.select(F.col("item_id").cast("string").alias("item_id"), "text").distinct()
    total = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n = max(1, -(-total // block_bytes))

    def build(block: pa.Table) -> pa.Table:
        phrases = phrases_of(block["item_id"].to_pylist(), block["text"].combine_chunks(), WINDOW)
        if phrases is None:
            return pa.table({"name": pa.array([], pa.string())})
        name = f"block-{uuid.uuid4().hex}.pickle"  # another attempt writes another file
        with Store(folder).create(name) as out:
            out.write(pickle.dumps((phrases.vocabulary, phrases.by_length, phrases.item_names), protocol=5))
        return pa.table({"name": [name]})

    dealt = rows.withColumn("_block", F.pmod(F.xxhash64("item_id", "text"), F.lit(n)))
    return sorted(row["name"] for row in dealt.groupBy("_block").applyInArrow(build, "name string").collect())  # a name for each block


def _prepared(docs: DataFrame, benchmark: DataFrame, keep: list[str] | None, block_bytes: int, group_bytes: int) -> tuple[DataFrame, list[str], Callable]:
    """The rows to search, the columns that stay, and the function that searches batches of them."""
    keep = [c for c in (docs.columns if keep is None else keep) if c not in FOUND.names]
    folder = new_folder(docs.sparkSession, "benchmark")
    names = _write_blocks(benchmark, folder, block_bytes)
    return lean_batches(docs).select(*dict.fromkeys([*keep, "text"])), keep, _finder(folder, names, keep, group_bytes)


def find_leaks(docs: DataFrame, benchmark: DataFrame, keep: list[str] | None = None, block_bytes: int = BLOCK_BYTES, group_bytes: int = GROUP_BYTES) -> DataFrame:
    """The kept columns of every document with n_words, spans (of words, half-open) and items (sorted as strings)."""
    source, keep, find = _prepared(docs, benchmark, keep, block_bytes, group_bytes)
    return source.mapInArrow(tidy_worker(find), T.StructType([docs.schema[c] for c in keep] + FOUND.fields))


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    values = hashing.byte_values()
    for batch in batches:
        texts, spans = batch.column("text").to_pylist(), batch.column("spans").to_pylist()
        dirty = [i for i, s in enumerate(spans) if s]
        for i in dirty:
            raw = (texts[i] or "").encode()
            (_, _, _, _, starts, ends), = hashing.tokenise(pa.array([texts[i]]), hashing.ALNUM, values, spans=True)
            kept, at = [], 0
            for span in spans[i]:
                kept.append(raw[at : starts[span["begin"]]])
                at = ends[span["end"] - 1]
            texts[i] = b"".join([*kept, raw[at:]]).decode()
        names = [c for c in batch.schema.names if c != "spans"]
        yield pa.RecordBatch.from_arrays([pa.array(texts, pa.string()) if c == "text" else batch.column(c) for c in names], names=names)


def _cleaner(find: Callable) -> Callable:
    """Searches batches, leaves out the documents of which no word is left, and cuts the others, all in one worker."""

    def clean(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in find(batches):
            hit = [sum(s["end"] - s["begin"] for s in spans) for spans in batch.column("spans").to_pylist()]
            stays = [h == 0 or n > h for h, n in zip(hit, batch.column("n_words").to_pylist(), strict=True)]
            left = batch.filter(pa.array(stays, pa.bool_()))
            yield from _cut(iter([left.select([c for c in left.schema.names if c not in ("n_words", "items")])]))

    return clean


def remove_leaks(docs: DataFrame, benchmark: DataFrame, block_bytes: int = BLOCK_BYTES, group_bytes: int = GROUP_BYTES) -> DataFrame:
    """Documents with every removal span cut out; a document of which no words are left goes."""
    source, keep, find = _prepared(docs, benchmark, None, block_bytes, group_bytes)
    return source.mapInArrow(tidy_worker(_cleaner(find)), T.StructType([docs.schema[c] for c in keep]))


def op8(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items_sha256, contaminated of every row of documents."""
    found = find_leaks(docs.select("doc_id", "text"), benchmark, keep=["doc_id"])
    n_hit = F.aggregate("spans", F.lit(0).cast("long"), lambda n, s: n + s["end"] - s["begin"])
    out = found.withColumn("n_hit", n_hit)
    return out.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ",").cast("binary"), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"))


ORACLE = r"""
WITH d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents
), b AS (
  SELECT item_id, w, least(10, len(w)) AS n FROM (
    SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark)
  WHERE len(w) > 0
), bw AS (
  SELECT DISTINCT item_id, n, array_to_string(w[i:i + n - 1], ' ') AS g FROM (SELECT item_id, n, w, unnest(range(1, len(w) - n + 2)) AS i FROM b)
), dw AS (
  SELECT doc_id, i, n, array_to_string(w[i:i + n - 1], ' ') AS g
  FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM d, (SELECT DISTINCT n FROM bw) WHERE len(w) >= n)
), o AS (
  SELECT dw.doc_id, dw.i, dw.n, bw.item_id FROM dw JOIN bw ON dw.n = bw.n AND dw.g = bw.g
), h AS (
  SELECT doc_id, count(DISTINCT p)::BIGINT AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS p FROM o) GROUP BY doc_id
), t AS (
  SELECT doc_id, count(*)::BIGINT AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS item FROM o) GROUP BY doc_id
)
SELECT d.doc_id, len(d.w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
       sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN h ON d.doc_id = h.doc_id LEFT JOIN t ON d.doc_id = t.doc_id
"""
