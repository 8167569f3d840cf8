"""The learner and the scores against plain loops, and the bound on what is learned from."""

import math
import random
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from folium.llm import quality


def texts(n, seed=1):
    rng = random.Random(seed)
    return [" ".join(rng.choice(["Alpha", "beta", "gamma,", "42", "!!", "Δ"]) for _ in range(rng.randrange(0, 60))) for _ in range(n)]


def test_ftrl_by_a_plain_loop():
    rng = random.Random(2)
    rows = [(np.array(sorted(rng.sample(range(50), 6)) + [64]), np.array([rng.random() * 4 for _ in range(6)] + [1.0]), rng.randrange(2)) for _ in range(60)]
    z, n, w = {}, {}, {}

    def weight(i):
        if abs(z.get(i, 0.0)) <= quality.L1:
            return 0.0
        return -(z[i] - math.copysign(quality.L1, z[i])) / ((quality.BETA + math.sqrt(n[i])) / quality.ALPHA + quality.L2)

    for _ in range(quality.EPOCHS):
        for at, x, label in rows:
            w = {int(i): weight(int(i)) for i in at}
            p = 1 / (1 + math.exp(-sum(w[int(i)] * v for i, v in zip(at, x, strict=True))))
            for i, v in zip(at.tolist(), x.tolist(), strict=True):
                g = (p - label) * v
                sigma = (math.sqrt(n.get(i, 0.0) + g * g) - math.sqrt(n.get(i, 0.0))) / quality.ALPHA
                z[i] = z.get(i, 0.0) + g - sigma * w[i]
                n[i] = n.get(i, 0.0) + g * g
    found = quality.learn(rows, bits=6)
    assert np.allclose(found, [weight(i) if i in z else 0.0 for i in range(65)])


def test_scores_are_sparse_dot_products_whatever_stands_beside():
    rows = [*texts(300), "", None]
    weights = np.random.default_rng(3).normal(size=(1 << quality.BITS) + 1)
    whole = quality.dot_products(pa.array(rows, pa.string()), weights)
    assert whole.tolist() == [quality.dot_products(pa.array([t], pa.string()), weights)[0] for t in rows]
    for text, score in zip(rows, whole, strict=True):
        own = [int(f) for _, _, _, at in quality.features(pa.array([text], pa.string())) for f in at]
        expected = weights[-1] + quality.GAIN * sum(weights[f] for f in own) / max(quality.FEWEST, len(own))
        assert math.isclose(score, 1 / (1 + math.exp(-expected)), rel_tol=1e-9)


def test_no_more_rows_than_the_bound_are_learned_from(spark, monkeypatch):
    """One label whose id many rows share: the bound holds for rows, and which of them are taken is fixed."""
    one, other = [i for i in range(50) if zlib.crc32(str(i).encode()) % 3 != 1][:2]
    docs = spark.createDataFrame([(one, t) for t in texts(400)] + [(other, "other words")], "doc_id long, text string")
    labels = spark.createDataFrame([(one, 1), (other, 0)], "doc_id long, quality int")
    seen = []
    learner = quality._learner

    def counting(batches):
        held = list(batches)
        assert sum(b.num_rows for b in held) <= 10
        yield from learner(iter(held))

    monkeypatch.setattr(quality, "_learner", counting)
    for rows in (docs, docs.orderBy(F.rand(5)).repartition(7)):
        seen.append(quality.train(rows, labels, sample=10))
    assert (seen[0] == seen[1]).all() and seen[0].any()
