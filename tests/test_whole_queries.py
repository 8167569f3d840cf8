"""Registered queries over whole tables, where a cut would show."""

import duckdb

from folium.plans import catalogue


def test_cross_page_neighbours(spark, tmp_path):
    text = "\n".join("and goes on" if k in (39, 79, 80) else "a sentence ends." for k in range(120))
    spark.createDataFrame([(1, text)], "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    found = catalogue.queries()["layout_cross_page"](spark, str(tmp_path)).collect()
    assert {(r["ord"], r["flag"]) for r in found} == {(39, "possible_cross_page"), (79, "possible_cross_page")}


def test_coverage_uses_all_line_items(spark):
    data = "/root/testdata/sf0.001"
    found = {r["status"]: r for r in catalogue.queries()["ledger_coverage"](spark, data).collect()}
    counts = duckdb.connect().execute(f"SELECT count(*) FROM '{data}/lineitem.parquet' GROUP BY l_orderkey").fetchall()
    assert sum(r["n_used"] for r in found.values()) == sum(n for (n,) in counts)
    assert found["duplicate"]["n_keys"] == sum(n > 1 for (n,) in counts) and found["ok"]["n_keys"] == sum(n == 1 for (n,) in counts)


def test_evidence_anywhere_in_the_text(spark, tmp_path):
    rows = [(1, "Plain words that say what was done here\nsee a00012"), (2, "short\nbut the second line says quite enough of it"), (3, "Plain words that say what was done here\nand go on")]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    found = {r["doc_id"]: (r["weak"], r["evidence"], r["verdict"]) for r in catalogue.queries()["evidence_screen"](spark, str(tmp_path)).collect()}
    assert found == {1: (False, True, "ok"), 2: (False, False, "no evidence"), 3: (False, False, "no evidence")}
