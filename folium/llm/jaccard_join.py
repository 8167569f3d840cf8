"""Operator 6, n-gram Jaccard join: a token-group matrix.

A document's set holds its distinct shingles of WIDTH words as 64-bit hashes. Documents of equal
sets are one class. Two classes link when 100 * |A n B| >= SIMILARITY * |A u B|.

1. A class whose tokens are mostly its own can link with nothing. Tokens are gathered in packs and dealt
   by value, one entry for each distinct token of a pack: a token that classes of a pack share is
   counted there and goes on as a mark, so however many classes hold a token, a bucket gets no more than one
   entry of it from each pack. Only classes that share at least SIMILARITY % of their tokens with
   another class go on.
2. These are partitioned into groups: under each of a few min-hash keys, sets are compared with
   the key's representatives, and what exact links connect is a group. Groups are sliced by size, so
   that no token union grows beyond SLICE members and bounds are tight.
3. The token-group matrix: step 1 again, with groups for classes, leaves the queries that hold
   enough tokens of other groups. The matrix stores each slice's token union as rows (token, slice).
   The end in the smaller group is the query. The sizes of the two ends say how many tokens they
   must have in common, so of the query's tokens outside its group the rarest, beyond what it may
   miss, hold one that leads to the slice; rows of the matrix are matched by bands of size, and
   members that cannot have enough in common with others are left out. The overlap with the whole
   union is then counted, and slices below the bound stay closed.
4. A qualifying group is first tried by one member. Groups that are still apart after components
   are merged are opened, and the query is checked against all members of fitting size.
5. Components over groups, then over documents; links are never gathered on the driver.

Every step drops only pairs that cannot link, so no link between different texts is lost.

Defined cases: a null, blank or empty text has an empty set and links with nothing; rows with
one doc_id are documents of their own with one id; a null id never becomes a component's id unless all
ids of the component are null; a very long text is a set like others; ties do not occur, as a component's id is
its least; columns but doc_id and text are ignored; an empty table gives no rows. Sets are told apart by
128 bits of a digest: classes are numbered by 64 of them, and where two sets agree in these, by a check of the
other 64, one gets another number. Shingles are told apart by 64 bits.
"""

from __future__ import annotations

import hashlib
import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from folium.llm import hashing
from folium.llm.components import connected_components
from folium.llm.shared import clear, lean_batches, tidy_worker, write_table

WIDTH = 5
SIMILARITY = 75
#: Tokens that a bucket of the sharing filter holds, about.
BUCKET_TOKENS = 2_000_000
#: Tokens that a task gathers before it deals them out.
PACK_TOKENS = 1 << 20
#: Min-hash keys of a set; under each, sets are compared with up to FIRSTS sets that represent those before them.
ROUNDS, FIRSTS = 3, 8
#: Sets under one key that one task clusters, about; beyond, the key is split.
CROWD = 4096
#: Classes that go on from step 1 are broadcast up to so many, 32 bytes each.
FEW_CLASSES = 500_000
#: Sets that may share a class number with another; more would need a bad hash, not more documents.
MOST_RENAMED = 10_000
#: Members of a group, of sizes in one of BANDS bands to a doubling, that share one token union.
SLICE, BANDS = 256, 8


def shingle_sets(texts: pa.Array, width: int = WIDTH) -> Iterator[np.ndarray]:
    """The sorted distinct shingle hashes of each text."""
    values = hashing.byte_values()
    for low, high, bounds, words in hashing.tokenise(texts, hashing.SPACED, values):
        for row in range(high - low):
            yield np.unique(hashing.shingle_hashes(words[bounds[row] : bounds[row + 1]], width))


#: Sets whose class number another set has too, by (number, check), with the number they get instead.
Renamed = dict[tuple[int, int], int]


def class_and_check(tokens: np.ndarray) -> tuple[int, int]:
    return struct.unpack("<qq", hashlib.blake2b(tokens.tobytes(), digest_size=16).digest())


def class_of(tokens: np.ndarray, renamed: Renamed) -> int:
    found = class_and_check(tokens)
    return renamed.get(found, found[0])


def needed(n: Column, m: Column) -> Column:
    """Tokens that sets of n and m must have in common to link."""
    return F.ceil((n + m) * SIMILARITY / (100 + SIMILARITY)).cast("long")


def smallest(n: Column) -> Column:
    """Size of the smallest set that a set of n may link with."""
    return F.ceil(n * SIMILARITY / 100).cast("long")


def size_band(n: Column) -> Column:
    return F.floor(F.log2(n.cast("double")) * BANDS).cast("int")


def _classes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        sizes, classes = [], []
        for tokens in shingle_sets(batch.column("text")):
            sizes.append(len(tokens))
            classes.append(class_and_check(tokens))
        cids, checks = zip(*classes, strict=True) if classes else ((), ())
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("copy"), *[pa.array(c, pa.int64()) for c in (sizes, cids, checks)]], names=["doc_id", "copy", "n", "cid", "check"])


#: Rows of the sharing filter: the entries of a bucket; or counts of classes made in a pack; or bundles, that is
#: classes of one label that hold the same tokens of a pack, under one number. Buckets pass the last two on.
ENTRIES, COUNTS, BUNDLES = 0, 1, 2
_PACKED = "bucket int, kind int, ids binary, runs binary, labels binary, tokens binary"
_PARTED = "part int, kind int, ids binary, counts binary, members binary"


def _starts(ordered: np.ndarray) -> np.ndarray:
    """Where a sorted array changes, its beginning included."""
    return np.flatnonzero(np.concatenate([[True], ordered[1:] != ordered[:-1]]))


def _bundles(own: np.ndarray, head: np.ndarray, seed: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Names of the distinct runs of sets, one run of each, and which of them each run is; equal sets in any order are one."""
    values = hashing.mix64(own.astype(np.uint64) + np.uint64(1))
    twice = hashing.mix64(values + np.uint64(hashing.BASE))
    signature = np.stack([np.add.reduceat(values, head), np.add.reduceat(twice, head)], axis=1)
    _, first, which = np.unique(signature.view([("a", np.uint64), ("b", np.uint64)]).ravel(), return_index=True, return_inverse=True)
    return hashing.mix64(np.arange(len(first), dtype=np.uint64) + np.uint64(seed)).view(np.int64), first, which.ravel()


def _pack(sets: list[np.ndarray], ids: list[int], labels: list[int], buckets: int) -> Iterator[tuple]:
    """Rows of _PACKED for some sets of distinct ids; a label is of sets that do not count as each other's sharers."""
    cid, label = np.array(ids, dtype=np.int64), np.array(labels, dtype=np.int64)
    tokens = np.concatenate(sets)
    order = np.argsort(tokens)
    own = np.repeat(np.arange(len(sets), dtype=np.int32), [len(s) for s in sets])[order]
    tokens = tokens[order]
    del order
    head = _starts(tokens)
    size = np.diff(np.concatenate([head, [len(tokens)]]))
    code = np.unique(label, return_inverse=True)[1].astype(np.int32)[own]
    mixed, alone = np.minimum.reduceat(code, head) != np.maximum.reduceat(code, head), size == 1
    del code
    low = label[own[head]]
    counts = np.bincount(own[np.repeat(mixed, size)], minlength=len(cid))
    seed = int.from_bytes(hashlib.blake2b(cid.tobytes(), digest_size=8).digest()) >> 1  # another attempt makes the same rows
    where = seed % buckets
    yield where, COUNTS, cid.tobytes(), counts.astype(np.uint32).tobytes(), b"", b""
    # Each token's bearer by its place in names: a mark for a shared one, the class, or the bundle of classes that hold it.
    bearer, names = np.where(alone, own[head] + 1, 0), np.concatenate([[0], cid])
    many = np.flatnonzero(~alone & ~mixed)
    if len(many):
        inside, sizes = np.repeat(~alone & ~mixed, size), size[many]
        bundles, first, which = _bundles(own[inside], np.concatenate([[0], np.cumsum(sizes)[:-1]]), seed)
        bearer[many], names, sizes = which + len(names), np.concatenate([names, bundles]), sizes[first]
        picks = np.repeat(head[many][first] - np.concatenate([[0], np.cumsum(sizes)[:-1]]), sizes) + np.arange(sizes.sum())
        yield where, BUNDLES, bundles.tobytes(), sizes.astype(np.uint32).tobytes(), b"", cid[own[picks]].tobytes()
    entry = tokens[head]
    del tokens, own
    bucket = ((entry >> np.uint64(32)) * np.uint64(buckets) >> np.uint64(32)).astype(np.int64)
    # Within a bucket, entries of one bearer stand together.
    order = np.argsort(bucket << 32 | bearer)
    bearer = names[bearer]
    bucket, entry, bearer, mixed, low = bucket[order], entry[order].astype(np.uint32), bearer[order], mixed[order], low[order]
    first = np.flatnonzero(np.concatenate([[True], (bucket[1:] != bucket[:-1]) | (bearer[1:] != bearer[:-1]) | (mixed[1:] != mixed[:-1])]))
    runs = np.diff(np.concatenate([first, [len(entry)]]))
    # A run's length has its lowest bit set for marks.
    runs = (runs * 2 + mixed[first]).astype(np.uint32)
    number = bucket[_starts(bucket)]
    edges = np.concatenate([number, [buckets]])
    token_at, run_at = np.searchsorted(bucket, edges), np.searchsorted(bucket[first], edges)
    bearer, low = bearer[first], low[first]
    for k, (a, b, c, d) in enumerate(zip(token_at, token_at[1:], run_at, run_at[1:], strict=False)):
        yield int(number[k]), ENTRIES, bearer[c:d].tobytes(), runs[c:d].tobytes(), low[c:d].tobytes(), entry[a:b].tobytes()


def _batch_of(rows: list[tuple], names: list[str]) -> pa.RecordBatch:
    kinds = [pa.int32(), pa.int32(), *[pa.binary()] * (len(names) - 2)]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)


def _packer(buckets: int, renamed: Renamed):
    """Packs the sets of texts, each its own label, or given sets with their labels."""
    names = ["bucket", "kind", "ids", "runs", "labels", "tokens"]

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sets: list[np.ndarray] = []
        ids: list[int] = []
        labels: list[int] = []
        met: set[int] = set()
        held = 0
        for batch in batches:
            if "text" in batch.schema.names:
                rows = ((c := class_of(t, renamed), c, t) for t in shingle_sets(batch.column("text")))
            else:
                rows = zip(batch.column("cid").to_pylist(), batch.column("label").to_pylist(), _token_arrays(batch.column("tokens")), strict=True)
            for cid, label, tokens in rows:
                if len(tokens) and cid not in met:
                    met.add(cid)
                    sets.append(tokens)
                    ids.append(cid)
                    labels.append(label)
                    held += len(tokens)
                    if held >= PACK_TOKENS:
                        packed = _batch_of(list(_pack(sets, ids, labels, buckets)), names)
                        sets, ids, labels, met, held = [], [], [], set(), 0
                        yield packed
        if sets:
            yield _batch_of(list(_pack(sets, ids, labels, buckets)), names)

    return pack


def _token_arrays(column: pa.Array) -> Iterator[np.ndarray]:
    flat, offsets = column.flatten().to_numpy(zero_copy_only=False).view(np.uint64), np.concatenate([[0], np.cumsum(column.value_lengths().to_numpy(zero_copy_only=False))])
    for low, high in zip(offsets, offsets[1:], strict=False):
        yield flat[int(low) : int(high)]


def _joined(parts: list[bytes], kind: type) -> np.ndarray:
    return np.concatenate([np.frombuffer(x, dtype=kind) for x in parts]) if parts else np.zeros(0, dtype=kind)


def _dealt(ids: np.ndarray, parts: int) -> Iterator[tuple[int, np.ndarray]]:
    """For each part of the ids, the places of those in it."""
    if not len(ids):
        return
    part = (ids.view(np.uint64) % np.uint64(parts)).astype(np.int64)
    order = np.argsort(part, kind="stable")
    head = _starts(part[order])
    for a, b in zip(head, np.concatenate([head[1:], [len(ids)]]), strict=True):
        yield int(part[order[a]]), order[a:b]


def _sharer(parts: int):
    """How many entries of each bearer in a bucket hold a token that another label has too; other rows are passed on, dealt by id."""

    def count(block: pa.Table) -> pa.Table:
        rows = list(zip(*(block[c].to_pylist() for c in ("kind", "ids", "runs", "labels", "tokens")), strict=True))
        out: list[tuple] = []
        entries = [r for r in rows if r[0] == ENTRIES]
        if entries:
            runs = _joined([r[2] for r in entries], np.uint32)
            length, marks = runs >> 1, (runs & 1).astype(bool)
            bearers, number = np.unique(_joined([r[1] for r in entries], np.int64), return_inverse=True)
            label = np.unique(_joined([r[3] for r in entries], np.int64), return_inverse=True)[1].ravel().astype(np.int32)
            both = _joined([r[4] for r in entries], np.uint32).astype(np.uint64)
            both <<= np.uint64(32)
            both |= np.repeat(np.arange(len(runs), dtype=np.uint64), length)
            both.sort()
            run = both.astype(np.uint32)  # the low half
            both >>= np.uint64(32)
            head = _starts(both)
            n_tokens = len(both)
            del both
            mixed = np.minimum.reduceat(label[run], head) != np.maximum.reduceat(label[run], head)
            mixed |= np.bitwise_or.reduceat(marks[run], head)
            mixed = np.repeat(mixed, np.diff(np.concatenate([head, [n_tokens]]))) & ~marks[run]
            counts = np.bincount(number.ravel()[run[mixed]], minlength=len(bearers))
            some = np.flatnonzero(counts)
            bearers, counts = bearers[some], counts[some].astype(np.uint32)
            out += [(part, ENTRIES, bearers[at].tobytes(), counts[at].tobytes(), b"") for part, at in _dealt(bearers, parts)]
        for kind, ids, runs, _, members in rows:
            if kind == COUNTS:
                ids, runs = np.frombuffer(ids, np.int64), np.frombuffer(runs, np.uint32)
                out += [(part, COUNTS, ids[at].tobytes(), runs[at].tobytes(), b"") for part, at in _dealt(ids, parts)]
            elif kind == BUNDLES:
                ids, sizes, members = np.frombuffer(ids, np.int64), np.frombuffer(runs, np.uint32), np.frombuffer(members, np.int64)
                begin = np.concatenate([[0], np.cumsum(sizes, dtype=np.int64)])
                for part, at in _dealt(ids, parts):
                    own = np.concatenate([members[begin[k] : begin[k + 1]] for k in at])
                    out.append((part, BUNDLES, ids[at].tobytes(), sizes[at].tobytes(), own.tobytes()))
        return pa.Table.from_batches([_batch_of(out, ["part", "kind", "ids", "counts", "members"])]) if out else pa.table({"part": pa.array([], pa.int32()), "kind": pa.array([], pa.int32()), **{c: pa.array([], pa.binary()) for c in ("ids", "counts", "members")}})

    return count


def _totals(block: pa.Table) -> pa.Table:
    """cid, shared, packs: what a part's rows add to each class."""
    rows = list(zip(*(block[c].to_pylist() for c in ("kind", "ids", "counts", "members")), strict=True))
    columns = {kind: [_joined([r[k] for r in rows if r[0] == kind], t) for k, t in ((1, np.int64), (2, np.uint32), (3, np.int64))] for kind in (ENTRIES, COUNTS, BUNDLES)}
    bearers, number = np.unique(columns[ENTRIES][0], return_inverse=True)
    counts = np.bincount(number.ravel(), weights=columns[ENTRIES][1], minlength=len(bearers)).astype(np.int64)
    names, sizes, members = columns[BUNDLES]
    at = np.minimum(np.searchsorted(bearers, names), max(0, len(bearers) - 1))
    of_bundle = np.where(bearers[at] == names, counts[at], 0) if len(bearers) and len(names) else np.zeros(len(names), dtype=np.int64)
    direct, made, _ = columns[COUNTS]
    ids = np.concatenate([bearers, direct, members])
    shared = np.concatenate([counts, made.astype(np.int64), np.repeat(of_bundle, sizes)])
    packs = np.repeat([0, 1, 0], [len(bearers), len(direct), len(members)])
    ids, number = np.unique(ids, return_inverse=True)
    sums = [np.bincount(number.ravel(), weights=x, minlength=len(ids)).astype(np.int64) for x in (shared, packs)]
    return pa.table({"cid": pa.array(ids, pa.int64()), "shared": pa.array(sums[0]), "packs": pa.array(sums[1])})


def shared_counts(rows: DataFrame, total: int, renamed: Renamed) -> DataFrame:
    """cid, shared: how many tokens of a set are in sets of other labels. rows: text, or cid, label, tokens; total: their tokens.

    Each pack that holds a class counts all its tokens, so the sum is divided by the number of packs. Tokens of a bucket that
    agree in the 32 bits kept count as equal, so a count may be too high by a few, never too low.
    """
    buckets = max(1, -(-total // BUCKET_TOKENS))
    parts = max(1, buckets // 8)
    # Sorted, a task makes the same packs whenever it is run: what buckets got from a lost executor fits what they get again.
    ordered = rows.sortWithinPartitions(*([F.xxhash64("text"), F.length("text")] if "text" in rows.columns else ["cid"]))
    packed = ordered.mapInArrow(tidy_worker(_packer(buckets, renamed)), _PACKED)
    # One task for each bucket, whatever the session's number of partitions is: a task's share does not grow with the tokens.
    counted = packed.repartitionById(buckets, F.col("bucket")).groupBy("bucket").applyInArrow(tidy_worker(_sharer(parts)), _PARTED)
    totals = counted.repartitionById(parts, F.col("part")).groupBy("part").applyInArrow(tidy_worker(_totals), "cid long, shared long, packs long")
    sums = totals.groupBy("cid").agg(F.sum("shared").alias("_shared"), F.sum("packs").alias("_packs")).where("_packs > 0")  # names of bundles are in none
    return sums.select("cid", F.floor(F.col("_shared") / F.col("_packs")).cast("long").alias("shared"))


def _renamed(rows: DataFrame, scratch: list[str]) -> Renamed:
    """Sets that share a class number with another set: all but one of each number, nearly always none.

    Some N * N / 2^65 of N sets agree in 64 bits, about ten of 2 * 10^10.
    """
    again = rows.where("n > 0").groupBy("cid").agg(F.min("check").alias("_least"), F.max("check").alias("_most")).where("_least <> _most")
    again = write_table(again.select(F.col("cid").alias("_c"), "_least"), "jaccard-again", small=True, scratch=scratch)
    if again.isEmpty():
        return {}
    strays = rows.join(again, (F.col("cid") == F.col("_c")) & (F.col("check") != F.col("_least"))).select("cid", "check").distinct()
    found = strays.limit(MOST_RENAMED + 1).collect()
    if len(found) > MOST_RENAMED:
        raise RuntimeError("far too many sets share a class number")
    return {(r["cid"], r["check"]): r["cid"] ^ (r["check"] | 1) for r in found}


def _in_classes(rows: DataFrame, renamed: Renamed) -> DataFrame:
    """rows without check, with the class numbers that renamed sets get."""
    cid = F.col("cid")
    for (old, check), new in renamed.items():
        cid = F.when((F.col("cid") == old) & (F.col("check") == check), F.lit(new)).otherwise(cid)
    return rows.withColumn("cid", cid).drop("check")


def _sets(renamed: Renamed):
    seeds = hashing.mix64(np.arange(1, ROUNDS + 1, dtype=np.uint64))

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for cid, shared, tokens in zip(batch.column("cid").to_pylist(), batch.column("shared").to_pylist(), shingle_sets(batch.column("text")), strict=True):
                if class_of(tokens, renamed) == cid:
                    rows.append((cid, len(tokens), max(0, len(tokens) - shared), tokens.view(np.int64), np.array([hashing.mix64(tokens ^ s).min() for s in seeds]).view(np.int64)))
            if rows:
                cids, sizes, alone, sets, keys = zip(*rows, strict=True)
                yield pa.RecordBatch.from_arrays([pa.array(cids, pa.int64()), pa.array(sizes, pa.int64()), pa.array(alone, pa.int64()), pa.array(list(sets), pa.list_(pa.int64())), pa.array(list(keys), pa.list_(pa.int64()))], names=["cid", "n", "alone", "tokens", "keys"])

    return make


def _close_in_size(a: Column, b: Column) -> Column:
    return F.least(a, b) * 100 >= F.greatest(a, b) * SIMILARITY


def _linked(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The pairs (a, b) whose sets link; their other columns stay."""
    left = sets.select(F.col("cid").alias("_a"), F.col("n").alias("_na"), F.col("tokens").alias("_ta"))
    right = sets.select(F.col("cid").alias("_b"), F.col("n").alias("_nb"), F.col("tokens").alias("_tb"))
    met = pairs.join(left, F.col("a") == F.col("_a")).join(right, (F.col("b") == F.col("_b")) & _close_in_size(F.col("_na"), F.col("_nb")))
    both = F.size(F.array_intersect("_ta", "_tb"))
    return met.where(both * 100 >= (F.col("_na") + F.col("_nb") - both) * SIMILARITY).select(*pairs.columns)


def _surviving_sets(docs: DataFrame, rows: DataFrame, renamed: Renamed, scratch: list[str]) -> DataFrame:
    """cid, n, alone (tokens that no other class has), tokens, keys of the classes that share enough of their tokens with others."""
    shared = shared_counts(docs.select("text"), rows.agg(F.sum("n")).first()[0] or 0, renamed)
    classes = rows.where("n > 0").groupBy("cid").agg(F.min(F.struct("doc_id", "copy")).alias("rep"), F.first("n").alias("n"))
    enough = write_table(classes.join(shared, "cid").where(F.col("shared") >= smallest(F.col("n"))).select("cid", F.col("rep.doc_id").alias("rep"), F.col("rep.copy").alias("rep_copy"), "shared"), "jaccard-enough", small=True, scratch=scratch)
    # Few enough rows of four numbers go to the texts; else the texts are dealt by id. An id that many rows share, or none, is
    # told apart by the checksum of the text.
    enough = F.broadcast(enough) if enough.count() <= FEW_CLASSES else enough
    found = docs.select("doc_id", _copy().alias("_own"), "text").join(enough, F.col("doc_id").eqNullSafe(F.col("rep")) & (F.col("_own") == F.col("rep_copy")))
    sets = found.select("cid", "shared", "text").mapInArrow(tidy_worker(_sets(renamed)), "cid long, n long, alone long, tokens array<bigint>, keys array<bigint>")
    return write_table(sets.groupBy("cid").agg(F.first("n").alias("n"), F.first("alone").alias("alone"), F.first("tokens").alias("tokens"), F.first("keys").alias("keys")), "jaccard-sets", scratch=scratch)


def _links(a: np.ndarray, b: np.ndarray) -> bool:
    if 100 * min(len(a), len(b)) < SIMILARITY * max(len(a), len(b)):
        return False
    both = len(np.intersect1d(a, b, assume_unique=True))
    return 100 * both >= SIMILARITY * (len(a) + len(b) - both)


def _clusterer(most: int):
    """Links of the sets under one key with the key's first few sets that link with none before them."""

    def cluster(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now: object = None
        firsts: list[tuple[int, np.ndarray]] = []
        for batch in batches:
            edges: list[tuple[int, int]] = []
            keys = zip(*(batch.column(c).to_pylist() for c in ("round", "key", "sub", "cid")), strict=True)
            for (*group, cid), tokens in zip(keys, _token_arrays(batch.column("tokens")), strict=True):
                if group != now:
                    now, firsts = group, []
                met = [other for other, theirs in firsts if _links(tokens, theirs)]
                edges += [(cid, other) for other in met]
                if not met and len(firsts) < most:
                    firsts.append((cid, tokens.copy()))
            columns = list(zip(*edges, strict=True)) or [(), ()]
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names=["u", "v"])

    return cluster


def _groups(sets: DataFrame, scratch: list[str]) -> DataFrame:
    """cid, n, label, slice: every class in a group of classes that exact links connect."""
    keyed = sets.select("cid", "alone", "tokens", F.posexplode("keys").alias("round", "key"))
    crowds = sets.select("cid", F.posexplode("keys").alias("round", "key")).groupBy("round", "key").agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") > CROWD)
    crowds = write_table(crowds.select(F.col("round").alias("_r"), F.col("key").alias("_k"), "_n"), "jaccard-crowds", small=True, scratch=scratch)
    crowds = F.broadcast(crowds) if crowds.count() <= FEW_CLASSES else crowds
    keyed = keyed.join(crowds, (F.col("round") == F.col("_r")) & (F.col("key") == F.col("_k")), "left")
    keyed = keyed.withColumn("sub", F.pmod(F.xxhash64("cid", "round"), F.ceil(F.coalesce("_n", F.lit(1)) / CROWD))).select("round", "key", "sub", "cid", "alone", "tokens")
    # Those with the fewest tokens of their own come first: they are the likeliest to link with what follows.
    dealt = keyed.repartition("round", "key", "sub").sortWithinPartitions("round", "key", "sub", "alone", "cid")
    edges = write_table(dealt.mapInArrow(tidy_worker(_clusterer(FIRSTS)), "u long, v long"), "jaccard-links", small=True, scratch=scratch)
    labels = connected_components(edges)
    every = sets.select("cid", "n").join(labels, F.col("cid") == F.col("node"), "left").select("cid", "n", F.coalesce("component", "cid").alias("label"))
    every = write_table(every, "jaccard-labelled-sets", small=True, scratch=scratch)
    sizes = every.groupBy(F.col("label").alias("_l")).agg(F.count(F.lit(1)).alias("size"))
    sized = every.join(sizes, F.col("label") == F.col("_l")).withColumn("band", size_band(F.col("n")))
    slices = F.pmod(F.xxhash64("cid"), F.ceil(F.col("size") / SLICE))
    return write_table(sized.select("cid", "n", "label", "size", "band", F.xxhash64("label", "band", slices).alias("slice")), "jaccard-groups", small=True, scratch=scratch)


def _qualifying(sets: DataFrame, groups: DataFrame, scratch: list[str]) -> DataFrame:
    """cid, home (its label), slice, label: queries and the slices of other groups whose unions may hold a link."""
    labelled = sets.select(F.col("cid").alias("_c"), "tokens").join(groups, F.col("_c") == F.col("cid")).select("cid", "n", "label", "slice", "tokens")
    shared = shared_counts(labelled.select("cid", "label", "tokens"), groups.agg(F.sum("n")).first()[0] or 0, {})
    able = shared.withColumnRenamed("cid", "_a").join(groups, F.col("_a") == F.col("cid")).where(F.col("shared") >= smallest(F.col("n")))
    able = write_table(able.select(*groups.columns), "jaccard-able", small=True, scratch=scratch)
    # A link across groups has two able ends, so only tokens of able classes count from here on.
    cells = sets.select(F.col("cid").alias("_c"), F.explode("tokens").alias("token")).join(able, F.col("_c") == F.col("cid")).drop("_c")
    cells = write_table(cells, "jaccard-cells", scratch=scratch)
    across = cells.groupBy("token").agg(F.min("label").alias("_low"), F.max("label").alias("_high"), F.count(F.lit(1)).alias("df")).where("_low <> _high")
    cells = write_table(cells.join(across.select(F.col("token").alias("_t"), "df"), F.col("token") == F.col("_t")).drop("_t"), "jaccard-matrix", scratch=scratch)
    # `held` tokens are all that a class can have in common with others, so its partners have at most `top` tokens.
    counts = cells.groupBy("cid").agg(F.count(F.lit(1)).alias("held"), *[F.first(c).alias(c) for c in ("n", "label", "size", "band", "slice")])
    top = F.floor(F.col("held") * (100 + SIMILARITY) / SIMILARITY).cast("long") - F.col("n")
    held = write_table(counts.withColumn("top", top).where(F.col("top") >= smallest(F.col("n"))), "jaccard-held", small=True, scratch=scratch)
    spans = held.groupBy(F.col("slice").alias("_z")).agg(F.min("n").alias("least"), F.max("top").alias("top"))
    matrix = cells.join(held.select(F.col("cid").alias("_h")), F.col("cid") == F.col("_h")).select("token", "slice", "label", "size", "band").distinct()
    matrix = write_table(matrix.join(spans, F.col("slice") == F.col("_z")).drop("_z"), "jaccard-unions", scratch=scratch)
    # The end in the smaller group is the query. For each band of partner sizes, its tokens outside its own group, in order
    # of rarity, as far as they cannot all be missed.
    largest = F.least(F.col("top"), F.floor(F.col("n") * 100 / SIMILARITY).cast("long"))
    queries = held.select(F.col("cid").alias("_p"), F.col("held").alias("_held"), F.explode(F.sequence(size_band(smallest(F.col("n"))), size_band(largest))).alias("_band"), "n")
    least_of_band = F.greatest(F.ceil(F.pow(F.lit(2.0), F.col("_band") / BANDS) - 1e-9).cast("long"), smallest(F.col("n")))
    queries = queries.withColumn("_take", (F.col("_held") - needed(F.col("n"), least_of_band) + 1).cast("int")).where("_take > 0").groupBy("_p").agg(F.collect_list(F.struct("_band", "_take")).alias("_takes"))
    probes = cells.groupBy("cid").agg(*[F.first(c).alias(c) for c in ("n", "label", "size")], F.array_sort(F.collect_list(F.struct("df", "token"))).alias("_cells"))
    probes = probes.join(queries, F.col("cid") == F.col("_p")).select("cid", "n", F.col("label").alias("home"), F.col("size").alias("_size"), "_cells", F.explode("_takes").alias("_t"))
    probes = probes.select("cid", "n", "home", "_size", F.col("_t._band").alias("_band"), F.explode(F.slice("_cells", F.lit(1), F.col("_t._take"))["token"]).alias("_token"))
    smaller = (F.col("_size") < F.col("size")) | ((F.col("_size") == F.col("size")) & (F.col("home") < F.col("label")))
    meets = (F.col("_token") == F.col("token")) & (F.col("_band") == F.col("band")) & smaller & (F.col("n") <= F.col("top"))
    candidates = probes.join(matrix, meets).select("cid", "n", "home", "slice", "label", "least").distinct()
    unions = matrix.groupBy(F.col("slice").alias("_s")).agg(F.collect_set("token").alias("union"))
    bounded = candidates.join(unions, F.col("slice") == F.col("_s")).join(sets.select(F.col("cid").alias("_q"), "tokens"), F.col("cid") == F.col("_q"))
    enough = needed(F.col("n"), F.greatest(F.col("least"), smallest(F.col("n"))))
    return write_table(bounded.where(F.size(F.array_intersect("tokens", "union")) >= enough).select("cid", "home", "slice", "label"), "jaccard-qualifying", small=True, scratch=scratch)


def _group_components(sets: DataFrame, groups: DataFrame, scratch: list[str]) -> DataFrame | None:
    """node, component over the labels of groups that link; null if none do."""
    opened = _qualifying(sets, groups, scratch)
    if opened.isEmpty():
        return None
    tried = groups.groupBy(F.col("slice").alias("_s")).agg(F.min("cid").alias("b"))
    by_one = opened.join(tried, F.col("slice") == F.col("_s")).select(F.col("cid").alias("a"), "b", "home", "label").distinct()
    edges = write_table(_linked(by_one, sets).select(F.col("home").alias("u"), F.col("label").alias("v")).distinct(), "jaccard-edges", small=True, scratch=scratch)
    merged = write_table(connected_components(edges), "jaccard-merged", small=True, scratch=scratch)
    at_home = merged.select(F.col("node").alias("_h"), F.col("component").alias("_hc"))
    there = merged.select(F.col("node").alias("_g"), F.col("component").alias("_gc"))
    apart = opened.join(at_home, F.col("home") == F.col("_h"), "left").join(there, F.col("label") == F.col("_g"), "left")
    apart = write_table(apart.where(F.coalesce("_hc", "home") != F.coalesce("_gc", "label")).select("cid", "home", "slice", "label"), "jaccard-apart", small=True, scratch=scratch)
    if apart.isEmpty():
        return merged
    members = groups.select(F.col("cid").alias("b"), F.col("n").alias("_nb"), F.col("slice").alias("_s"))
    own = groups.select(F.col("cid").alias("_c"), F.col("n").alias("_na"))
    pairs = apart.join(own, F.col("cid") == F.col("_c")).join(members, (F.col("slice") == F.col("_s")) & _close_in_size(F.col("_na"), F.col("_nb")))
    more = _linked(pairs.select(F.col("cid").alias("a"), "b", "home", "label"), sets).select(F.col("home").alias("u"), F.col("label").alias("v"))
    return connected_components(edges.union(more).distinct())


def _copy() -> Column:
    """A checksum of the text, which tells rows with one doc_id apart."""
    text = F.coalesce(F.col("text"), F.lit(""))
    return F.xxhash64(text, F.length(text))


def _in_components(docs: DataFrame) -> DataFrame:
    """doc_id, copy, n (size of the set), cid (class), component_id and label for every row of docs; the label is null where a row is alone."""
    scratch: list[str] = []
    rows = write_table(lean_batches(docs).select(F.col("doc_id").cast("long").alias("doc_id"), _copy().alias("copy"), "text").mapInArrow(tidy_worker(_classes), "doc_id long, copy long, n long, cid long, check long"), "jaccard-classes", scratch=scratch)
    renamed = _renamed(rows, scratch)
    rows = _in_classes(rows, renamed)
    sets = _surviving_sets(docs, rows, renamed, scratch)
    groups = _groups(sets, scratch)
    merged = _group_components(sets, groups, scratch)
    labels = groups.select(F.col("cid").alias("_cid"), "label")
    if merged is not None:
        labels = labels.join(merged, F.col("label") == F.col("node"), "left").select("_cid", F.coalesce("component", "label").alias("label"))
    labels = write_table(labels, "jaccard-labels", small=True, scratch=scratch)
    found = rows.join(labels, (F.col("cid") == F.col("_cid")) & (F.col("n") > 0), "left").select("doc_id", "copy", "n", "cid", F.coalesce("label", "cid").alias("label"))
    found = write_table(found, "jaccard-labelled")
    clear(docs.sparkSession, scratch)
    least = write_table(found.where("n > 0").groupBy(F.col("label").alias("_label")).agg(F.min("doc_id").alias("least"), F.count(F.lit(1)).alias("_size")).where("_size > 1").select("_label", "least"), "jaccard-least", small=True)
    out = found.join(least, (F.col("label") == F.col("_label")) & (F.col("n") > 0), "left")
    return out.select("doc_id", "copy", "n", "cid", F.coalesce("least", "doc_id").alias("component_id"), F.col("_label").alias("label"))


def similar_documents(docs: DataFrame) -> DataFrame:
    """doc_id, n (size of the set), cid (class) and component_id for every row of docs."""
    return _in_components(docs).select("doc_id", "n", "cid", "component_id")


def keep_one_of_each(docs: DataFrame) -> DataFrame:
    """The rows without all but one of every component, one of the smallest doc_id; ids may repeat or be null."""
    found = _in_components(docs.select("doc_id", "text")).where("label is not null")
    rows = found.groupBy("label", "doc_id", "copy").agg(F.count(F.lit(1)).alias("_n"))
    first = rows.groupBy(F.col("label").alias("_label")).agg(F.min(F.struct(F.col("doc_id").isNull().alias("void"), "doc_id", "copy")).alias("_first"))
    kept = F.col("doc_id").eqNullSafe(F.col("_first.doc_id")) & (F.col("copy") == F.col("_first.copy"))
    rows = rows.join(first, F.col("label") == F.col("_label")).withColumn("_kept", kept).where(~F.col("_kept") | (F.col("_n") > 1))
    rows = write_table(rows.select(F.col("doc_id").alias("_jaccard_id"), F.col("copy").alias("_jaccard_copy"), "_kept"), "jaccard-repeated", small=True)
    names = docs.columns
    own = docs.withColumn("_jaccard_own", _copy())
    same = F.col("doc_id").cast("long").eqNullSafe(F.col("_jaccard_id")) & (F.col("_jaccard_own") == F.col("_jaccard_copy"))
    left = own.join(rows.where(~F.col("_kept")).drop("_kept"), same, "left_anti")
    equal = rows.where("_kept").drop("_kept")
    if equal.isEmpty():
        return left.select(*names)
    # Equal rows with one id: the first of them stays.
    order = Window.partitionBy("doc_id", "_jaccard_own").orderBy(F.to_json(F.struct(*names)))
    one = left.join(equal, same, "left_semi").withColumn("_jaccard_row", F.row_number().over(order)).where("_jaccard_row = 1")
    return left.join(equal, same, "left_anti").select(*names).unionByName(one.select(*names))


def op6(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles, class_id, component_id of every row of documents."""
    return similar_documents(docs.select("doc_id", "text")).select("doc_id", F.col("n").alias("n_shingles"), F.col("cid").alias("class_id"), "component_id")
