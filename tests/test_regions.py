import numpy as np
from pyspark.sql import functions as F

from folium.operators import layout, regions


def test_edge_risks(spark):
    white = np.full((40, 60), 255, dtype=np.uint8)
    touching, dots, inner = white.copy(), white.copy(), white.copy()
    touching[1, 10:14] = 0
    touching[5:9, -1] = 200
    dots[0, ::3] = 0
    inner[3:30, 3:50] = 0
    rows = [(bytearray(p.tobytes()), 60) for p in (white, touching, dots, inner)] + [(None, 60)]
    found = spark.createDataFrame(rows, "p binary, w int").select(regions.edge_risks("p", "w")).collect()
    assert [r[0] for r in found] == [[], ["top", "right"], [], [], None]


def test_crops(spark):
    boxes = spark.createDataFrame([(1, 0.0, 0.0, 10.0, 10.0), (1, 5.0, 0.0, 5.0, 10.0), (1, 0.0, 0.0, 700.0, 10.0), (1, None, 0.0, 7.0, 1.0)], "page int, x0 double, y0 double, x1 double, y1 double")
    box = [F.col(c) for c in ("x0", "y0", "x1", "y1")]
    found = boxes.select(regions.crop_error(*box, F.lit(600.0), F.lit(800.0)), regions.crop_name(F.col("page"), box), layout.grown_box(F.array(F.lit("left"), F.lit("right")), F.lit(600.0), F.lit(800.0))).collect()
    assert [r[0] is None for r in found] == [True, False, False, False]
    assert found[0][1].startswith("region-") and len(found[0][1]) == 27 and tuple(found[0][2]) == (0.0, 0.0, 20.0, 10.0)


def test_crop_coverage(spark):
    blocks = spark.createDataFrame([(1, b, k, f"{b}.png", s) for b, k, s in (("b1", "figure", ["a1"]), ("b2", "table", ["a1", "a2"]), ("b3", "figure", ["a3"]), ("b4", "figure", ["a1"]), ("b5", "paragraph", ["a2"]))], "doc_id long, block_id string, kind string, asset string, source_ids array<string>")
    crops = spark.createDataFrame([(1, f"b{k}.png", 1, 0.0, 0.0, 50.0, 50.0, "s", "a", "s", "changed" if k == 4 else "a") for k in range(1, 6)], "doc_id long, asset string, crop_page int, c_x0 double, c_y0 double, c_x1 double, c_y1 double, crop_source string, crop_asset string, source_hash string, asset_hash string")
    atoms = spark.createDataFrame([(1, "a1", 1, "in", -1.0, 0.0, 51.0, 50.0), (1, "a2", 1, "out", 0.0, 0.0, 60.0, 9.0), (1, "a3", 2, "other", 1.0, 1.0, 2.0, 2.0)], "doc_id long, atom_id string, page int, text string, x0 double, y0 double, x1 double, y1 double")
    found = {r["block_id"]: r["error"] for r in regions.coverage_errors(blocks, crops, atoms).collect()}
    assert set(found) == {"b2", "b3", "b4"} and "a2" in found["b2"] and "other pages" in found["b3"] and "provenance" in found["b4"]
    ask = spark.createDataFrame([(1, "b1.png"), (1, "../x"), (2, "b1.png")], "doc_id long, asset string")
    assert regions.served_assets(ask, blocks, crops.select("doc_id", "asset")).count() == 1
