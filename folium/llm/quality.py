"""Operator 5, quality classifier: hashed word n-gram logistic regression with FTRL updates.

A text is cut into tokens, runs of letters and digits or of other signs. Its features are the
hashes of token n-grams and of n-grams of token shapes (case, length, digit, sign, whether a token
repeats the one before); a feature's value is its share of the text's n-grams. Weights are
learned by follow-the-regularised-leader (proximal, per coordinate) over a bounded sample of
labelled rows in a fixed order, so reruns agree. A score is the logistic of a sparse dot product.

Learning sees only labels of rows whose crc32(doc_id as text) mod 3 is not 1; labels, lang, source
and doc_id never enter a score. The sample is the SAMPLE rows of the smallest hashes of doc_id:
its features are computed where the documents are, and one task that reads at most SAMPLE rows
of sparse features learns; the weights are a table of fixed size.

Defined cases: a null or empty text is scored by the intercept alone; labels without a document, null
labels and null ids are not learned from; documents with several labels count once per
label, and rows that share a labelled id each, within SAMPLE rows in all; a very long text is scored whole;
without a usable label all weights are 0 and every score is 0.5; an empty table gives no rows;
a column quality_score of the input is replaced, others stay.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from folium.llm import hashing
from folium.llm.shared import lean_batches, tidy_worker

BITS = 18
#: Labelled rows that are learned from, at most.
SAMPLE = 8_000
EPOCHS = 2
ALPHA, BETA, L1, L2 = 0.5, 1.0, 0.02, 0.1
#: Values are shares of a text's n-grams times this; a text counts as having FEWEST n-grams at least, so that a few words say little.
GAIN, FEWEST = 20.0, 64

_SIGNS = np.uint64(0x5157)
_UPPER = hashing.byte_class([(0x41, 0x5A)])
_DIGIT = hashing.byte_class([(0x30, 0x39)])
_LOWER = hashing.byte_class([(0x61, 0x7A), (0x80, 0xFF)])


def features(texts: pa.Array, bits: int = BITS) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """For row ranges: low, high, bounds and the feature of each n-gram; 4 features for each token."""
    values = hashing.byte_values(fold_case=False)
    data, offsets = hashing.buffers(texts)
    for low, high in hashing.slabs(offsets):
        begin, end = int(offsets[low]), int(offsets[high])
        raw, cuts = data[begin:end], offsets[low : high + 1] - begin
        kind = hashing.ALNUM[raw]
        turns = np.flatnonzero(kind[1:] != kind[:-1]) + 1
        starts, ends, words = hashing.words_of(raw, np.concatenate([cuts, turns]), hashing.SPACED, values)
        bounds = np.searchsorted(starts, cuts)
        if not len(words):
            yield low, high, bounds * 4, np.zeros(0, dtype=np.int64)
            continue
        sums = {name: np.concatenate([[0], np.cumsum(flags[raw])]) for name, flags in (("upper", _UPPER), ("digit", _DIGIT), ("lower", _LOWER))}
        has = {name: total[ends] - total[starts] for name, total in sums.items()}
        length = np.minimum(ends - starts, 31)
        row = np.repeat(np.arange(high - low), np.diff(bounds))
        again = np.zeros(len(words), dtype=np.int64)
        again[1:] = (words[1:] == words[:-1]) & (row[1:] == row[:-1])
        again[1:-1] |= (words[2:] == words[:-2]) & (row[2:] == row[:-2])
        shape = np.minimum(has["upper"], 2) + 3 * (has["lower"] > 0) + 6 * (has["digit"] > 0) + 12 * kind[starts]
        size = np.searchsorted([2, 4, 7, 11, 16, 24], length)
        shape = hashing.mix64((shape + 24 * (size + 7 * again)).astype(np.uint64) + _SIGNS)
        out = np.empty((len(words), 4), dtype=np.uint64)
        out[:, 0] = hashing.mix64(words + np.uint64(1))
        out[:, 1] = out[:, 2] = out[:, 3] = 0
        head = np.zeros(len(words), dtype=bool)
        head[bounds[:-1][bounds[:-1] < bounds[1:]]] = True
        step = np.uint64(hashing.STEP)

        def previous(row: np.ndarray, head=head) -> np.ndarray:
            moved = np.concatenate([row[:1] * np.uint64(0), row[:-1]])
            moved[head] = 0
            return moved

        out[:, 1] = hashing.mix64(words + previous(words) * step + np.uint64(2))
        out[:, 2] = hashing.mix64(shape + np.uint64(3))
        before = previous(shape)
        out[:, 3] = hashing.mix64(shape + before * step + previous(before) * np.uint64(hashing.STEP**2 & hashing.MASK) + np.uint64(4))
        yield low, high, bounds * 4, (out.ravel() >> np.uint64(64 - bits)).astype(np.int64)


def learn(rows: list[tuple[np.ndarray, np.ndarray, int]], bits: int = BITS, epochs: int = EPOCHS) -> np.ndarray:
    """FTRL-proximal weights, the intercept last; rows hold features, their values and the label."""
    z, n = np.zeros((1 << bits) + 1), np.zeros((1 << bits) + 1)
    for _ in range(epochs):
        for at, x, label in rows:
            w = _weights(z[at], n[at])
            p = 1 / (1 + np.exp(-np.clip(w @ x, -35, 35)))
            g = (p - label) * x
            sigma = (np.sqrt(n[at] + g * g) - np.sqrt(n[at])) / ALPHA
            z[at] += g - sigma * w
            n[at] += g * g
    return _weights(z, n)


def _weights(z: np.ndarray, n: np.ndarray) -> np.ndarray:
    free = np.abs(z) > L1
    return np.where(free, -(z - np.sign(z) * L1) / ((BETA + np.sqrt(n)) / ALPHA + L2), 0.0)


def dot_products(texts: pa.Array, weights: np.ndarray, bits: int = BITS) -> np.ndarray:
    """The score of each text."""
    out = np.empty(len(texts))
    for low, high, bounds, at in features(texts, bits):
        counts, sums = np.diff(bounds), np.zeros(high - low)
        some = counts > 0
        if some.any():  # each text's own sum, whatever texts stand beside it
            sums[some] = np.add.reduceat(weights[at], bounds[:-1][some])
        out[low:high] = weights[-1] + GAIN * sums / np.maximum(counts, FEWEST)
    return 1 / (1 + np.exp(-np.clip(out, -35, 35)))


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 3 == 1, F.lit(False))


def _sparse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    keys = ["doc_id", "quality", "text_key"]
    for batch in batches:
        at_lists, x_lists = [], []
        for low, high, bounds, at in features(batch.column("text")):
            for row in range(high - low):
                own, counts = np.unique(at[bounds[row] : bounds[row + 1]], return_counts=True)
                at_lists.append(own.astype(np.int32))
                x_lists.append((GAIN * counts / max(FEWEST, counts.sum())).astype(np.float32))
        yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in keys), pa.array(at_lists, pa.list_(pa.int32())), pa.array(x_lists, pa.list_(pa.float32()))], names=[*keys, "at", "x"])


def _learner(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    rows = []
    for batch in batches:
        for doc, label, at, x in zip(*(batch.column(c) for c in ("doc_id", "quality", "at", "x")), strict=True):
            at, x = at.values.to_numpy(), x.values.to_numpy()
            order = hashing.mix64(np.array([doc.as_py()], dtype=np.int64).astype(np.uint64))[0]
            rows.append((int(order), doc.as_py(), label.as_py(), at, x))
    rows.sort(key=lambda r: (r[0], r[1], r[2], len(r[3]), r[4].tobytes()))
    top = 1 << BITS
    weights = learn([(np.append(at, top), np.append(x, 1.0).astype(np.float64), label) for _, _, label, at, x in rows])
    yield pa.RecordBatch.from_arrays([pa.array([weights.astype(np.float64).tobytes()], pa.binary())], names=["weights"])


def train(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> np.ndarray:
    """Weights from at most `sample` labelled rows outside the held-out fold."""
    usable = labels.where(F.col("doc_id").isNotNull() & F.col("quality").isin(0, 1) & ~held_out(F.col("doc_id"))).select("doc_id", F.col("quality").cast("int").alias("quality"))
    by_hash = [F.xxhash64("doc_id"), F.col("doc_id"), F.col("quality")]
    chosen = usable.orderBy(*by_hash).limit(sample)
    text = F.coalesce(F.col("text"), F.lit(""))
    texts = lean_batches(docs).select("doc_id", "text").join(F.broadcast(chosen), "doc_id")  # SAMPLE rows of two numbers
    keyed = texts.select("doc_id", "quality", F.xxhash64(text, F.length(text)).alias("text_key"), "text")
    sparse = keyed.mapInArrow(tidy_worker(_sparse), "doc_id long, quality int, text_key long, at array<int>, x array<float>")
    # Rows may share an id, so the bound holds for rows again after the join.
    bounded = sparse.orderBy(*by_hash, "text_key").limit(sample).drop("text_key")
    found = bounded.coalesce(1).mapInArrow(tidy_worker(_learner), "weights binary").collect()  # one row of fixed size
    return np.frombuffer(found[0][0]) if found else np.zeros((1 << BITS) + 1)


def score(docs: DataFrame, weights: np.ndarray, keep: list[str] | None = None) -> DataFrame:
    """The kept columns of docs with `quality_score`, higher for texts that are likelier to have label 1."""
    keep = [c for c in (docs.columns if keep is None else keep) if c != "quality_score"]
    shared = docs.sparkSession.sparkContext.broadcast(weights)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            scores = pa.array(dot_products(batch.column("text"), shared.value), pa.float64())
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in keep], scores], names=[*keep, "quality_score"])

    schema = T.StructType([*[docs.schema[c] for c in keep], T.StructField("quality_score", T.DoubleType())])
    return lean_batches(docs).select(*dict.fromkeys([*keep, "text"])).mapInArrow(tidy_worker(run), schema)


def op5(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score, predicted of every row of documents."""
    out = score(docs.select("doc_id", "text"), train(docs, labels), keep=["doc_id"])
    return out.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), F.col("quality_score").alias("score"), (F.col("quality_score") >= 0.5).cast("int").alias("predicted"))
