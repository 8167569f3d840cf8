"""Line dedup of long texts."""

from pyspark.sql import functions as F

from folium.llm import line_dedup


def test_a_long_text_with_many_drops(spark):
    lines = [f"line number {k} of the text" for k in range(20_000)]
    docs = spark.createDataFrame([(1, "\n".join(lines[::3])), (2, "\n".join(lines))], "doc_id long, text string")
    found = {r["doc_id"]: r for r in line_dedup.dedup_lines(docs).collect()}
    kept = [x for k, x in enumerate(lines) if k % 3]
    assert found[2]["text"] == "\n".join(kept) and (found[2]["n_lines"], found[2]["n_dropped"]) == (20_000, 20_000 - len(kept))
    assert found[1]["n_dropped"] == 0


def test_a_text_is_split_once(spark):
    docs = spark.createDataFrame([(1, "a")], "doc_id long, text string")
    plan = line_dedup.dedup_lines(docs)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("split(") == 1


def test_null_ids_are_one_last_document(spark):
    line = "a line of some length"
    docs = spark.createDataFrame([(None, line), (None, line + "\nx"), (5, line)], "doc_id long, text string")
    assert sorted(r["n_dropped"] for r in line_dedup.dedup_lines(docs.where(F.col("doc_id").isNull())).collect()) == [0, 0]
    assert sorted((str(r["doc_id"]), r["n_dropped"]) for r in line_dedup.dedup_lines(docs).collect()) == [("5", 0), ("None", 1), ("None", 1)]
