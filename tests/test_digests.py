from pyspark.sql import functions as F

from folium.functions import digests


def test_key_order_does_not_matter(spark):
    rows = [('{"b": 1, "a": "é"}',), ('{"a":"é","b":1}',), ('{"a":"e","b":1}',), (None,)]
    found = [r[0] for r in spark.createDataFrame(rows, "t string").select(digests.json_digest("t")).collect()]
    assert found[0] == found[1] != found[2] and found[3] is None


def test_fingerprints(spark):
    blocks = spark.createDataFrame([(1, 1, "b1", "heading", "H", None), (1, 2, "b2", "paragraph", "x", "y")], "doc_id long, ord int, block_id string, kind string, text string, target string")
    terms = spark.createDataFrame([(1, "t1", "en")], "doc_id long, term_id string, en string")
    issues = spark.createDataFrame([], "doc_id long, issue_id string, resolution string")
    of = lambda b, t=terms: digests.fingerprints(b, t, issues).first()["fingerprint"]
    base = of(blocks)
    assert of(blocks.withColumn("history", F.lit("old")).withColumn("asset", F.lit("i"))) == base
    assert of(blocks.withColumn("table_mode", F.lit(None).cast("string"))) == base
    assert of(blocks.withColumn("table_mode", F.lit("image"))) != base
    assert of(blocks.withColumn("ord", 3 - F.col("ord"))) != base
    assert of(blocks, terms.withColumn("en", F.lit("other"))) != base
