"""The pipeline's stages against brute force on a small corpus, and rerun to the same rows."""

import corpus_pipeline

DATA = "/root/testdata/sf0.001"


def words(text):
    import re

    return re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", (text or "").lower())


def test_stages(spark, tmp_path):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    kept, seen = {}, docs
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, seen, DATA).write.parquet(str(tmp_path / str(k)))
        seen = spark.read.parquet(str(tmp_path / str(k)))
        kept[name] = seen.collect()
        if k < len(corpus_pipeline.STAGES) - 1:
            assert seen.columns == docs.columns
    labels = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{DATA}/labels.parquet").collect()}
    good, one, clean, mixed, sharded = kept.values()
    left = {r["doc_id"] for r in good}
    right = [(i in left) == (q == 1) for i, q in labels.items()]
    assert sum(right) / len(right) > 0.9

    sets = {r["doc_id"]: {tuple(w[i : i + 5]) for i in range(len(w) - 4)} or {tuple(w)} for r in good if (w := (r["text"] or "").lower().split())}
    survivors = {r["doc_id"] for r in one}
    links = {(a, b) for a in sets for b in sets if b < a and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b])}
    parent = {d: d for d in left}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in links:
        parent[max(root(a), root(b))] = min(root(a), root(b))
    assert survivors == {root(d) for d in left}

    windows = set()
    for r in spark.read.parquet(f"{DATA}/benchmark.parquet").collect():
        w = words(r["text"])
        n = min(10, len(w))
        windows |= {tuple(w[i : i + n]) for i in range(len(w) - n + 1) if n}
    sizes = {len(w) for w in windows}
    before = {r["doc_id"]: r["text"] for r in one}
    for r in clean:
        old = words(before[r["doc_id"]])
        dirty = any(tuple(old[i : i + n]) in windows for n in sizes for i in range(len(old) - n + 1))
        assert (r["text"] != before[r["doc_id"]]) == dirty and r["n_chars"] == len(r["text"])

    times = {}
    for r in mixed:
        times[r["doc_id"]] = times.get(r["doc_id"], 0) + 1
    assert set(times) <= {r["doc_id"] for r in clean} and max(times.values()) <= 3
    assert len(sharded) == len(mixed)
    slots = {}
    for r in sharded:
        slots.setdefault(r["shard"], []).append(r["slot"])
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())


def test_run_twice(spark):
    first, second = (sorted(map(str, corpus_pipeline.run(spark, DATA).collect())) for _ in range(2))
    assert first == second


def test_nothing_is_left_behind(spark, tmp_path):
    import os

    from folium.llm import jaccard_join, shared

    folder = shared.shared_folder(spark).removeprefix("file://").removeprefix("file:") + "/folium"
    before = set(os.listdir(folder)) if os.path.isdir(folder) else set()
    with shared.tidy(spark):
        jaccard_join.op6(spark.read.parquet(f"{DATA}/documents.parquet")).write.parquet(str(tmp_path / "out"))
        assert {x.rsplit("-", 1)[0] for x in set(os.listdir(folder)) - before} >= {"jaccard-labelled"}
    assert set(os.listdir(folder)) == before
    corpus_pipeline.run(spark, DATA)
    assert [x for x in set(os.listdir(folder)) - before if x.startswith("pipeline-")] != []
    assert sum(x.startswith("pipeline-") for x in set(os.listdir(folder)) - before) == 1


def test_odd_rows(spark, tmp_path):
    schema = "doc_id long, text string, lang string, source string, n_chars long, shard int, label string"
    rows = [(1, None, None, None, None, 1, "x"), (1, "a b c", "en", None, 5, 1, "x"), (None, "a b c", "en", "s", 5, 1, "x"), (2, "", "en", "s", 0, 1, "x"), (3, "word " * 20_000, "en", "s", 100_000, 1, "x")]
    seen = spark.createDataFrame(rows, schema)
    for name in ("labels", "benchmark"):
        spark.read.parquet(f"{DATA}/{name}.parquet").limit(0).write.parquet(str(tmp_path / f"{name}.parquet"))
    for _, stage in corpus_pipeline.STAGES:
        seen = stage(spark, seen, str(tmp_path))
    assert seen.count() >= 1 and seen.columns[:5] == corpus_pipeline.COLUMNS
