"""Image regions: crops with their provenance, and ink that touches a crop's border.

Pixels come as rows of one byte each (0 black to 255 white), since nothing here renders pages.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# A pixel darker than this is ink; the band looked at; the share of a side and the least run that count.
INK_BELOW, BAND, RUN_SHARE, LEAST_RUN, SLACK = 245, 2, 0.005, 3, 2.0
SIDES = ("top", "right", "bottom", "left")


def longest_run(flags: np.ndarray) -> int:
    edges = np.flatnonzero(np.diff(np.concatenate([[0], flags.astype(np.int8), [0]])))
    return int((edges[1::2] - edges[::2]).max(initial=0))


def risky_sides(pixels: np.ndarray) -> list[str]:
    """Sides along which ink runs within the outermost pixels."""
    ink = pixels < INK_BELOW
    bands = {"top": ink[:BAND].any(axis=0), "right": ink[:, -BAND:].any(axis=1), "bottom": ink[-BAND:].any(axis=0), "left": ink[:, :BAND].any(axis=1)}
    return [side for side in SIDES if longest_run(bands[side]) >= max(LEAST_RUN, math.ceil(len(bands[side]) * RUN_SHARE))]


@F.pandas_udf(T.ArrayType(T.StringType()))
def edge_risks(pixels: pd.Series, width: pd.Series) -> pd.Series:
    return pd.Series([None if p is None or not w else risky_sides(np.frombuffer(p, dtype=np.uint8).reshape(-1, int(w))) for p, w in zip(pixels, width, strict=True)])


def crop_error(x0: Column, y0: Column, x1: Column, y1: Column, page_w: Column, page_h: Column) -> Column:
    """Why a box may not be cropped from a page; null if it may."""
    inside = (x0 >= 0) & (x0 < x1) & (x1 <= page_w) & (y0 >= 0) & (y0 < y1) & (y1 <= page_h)
    return F.when(~F.coalesce(inside, F.lit(False)), "Invalid page or top-left point bounding box")


def crop_name(page: Column, box: list[Column]) -> Column:
    """A name that page and box decide."""
    key = F.concat_ws(",", page.cast("string"), *[b.cast("string") for b in box])
    return F.concat(F.lit("region-"), F.substring(F.sha2(key.cast("binary"), 256), 1, 16), F.lit(".png"))


def source_crop(width: Column, height: Column, left: Column, top: Column, right: Column, bottom: Column) -> Column:
    """The pixel box that is left of an image when a document cuts shares off its sides, in thousandths of a percent; never empty."""
    share = lambda size, cut: F.bround(size * cut / 100000.0).cast("long")
    x0 = F.greatest(F.lit(0), F.least(share(width, left), width - 1))
    y0 = F.greatest(F.lit(0), F.least(share(height, top), height - 1))
    x1 = F.greatest(x0 + 1, F.least(F.bround(width * (1.0 - right / 100000.0)).cast("long"), width))
    y1 = F.greatest(y0 + 1, F.least(F.bround(height * (1.0 - bottom / 100000.0)).cast("long"), height))
    return F.when((width > 0) & (height > 0), F.struct(x0.alias("x0"), y0.alias("y0"), x1.alias("x1"), y1.alias("y1")))


def device_point(x: Column, y: Column, world: list[Column], mode: Column, window: list[Column], viewport: list[Column]) -> Column:
    """A point of a metafile on its device: first the world's matrix (m11, m12, m21, m22, dx, dy), then, but in mode 1, window to viewport.

    window and viewport: origin x and y, extent x and y. Mode 1 moves by the viewport's origin alone; a window without extent moves nothing.
    """
    m11, m12, m21, m22, dx, dy = world
    wx, wy = m11 * x + m21 * y + dx, m12 * x + m22 * y + dy
    scaled = [(w - window[k]) * viewport[k + 2] / F.nullif(window[k + 2], F.lit(0)) + viewport[k] for k, w in enumerate((wx, wy))]
    flat = (window[2] == 0) | (window[3] == 0)
    out = [F.when(mode == 1, w + viewport[k]).when(flat, w).otherwise(scaled[k]) for k, w in enumerate((wx, wy))]
    return F.struct(out[0].cast("double").alias("x"), out[1].cast("double").alias("y"))


IMAGE_SUFFIXES = ("png", "jpg", "jpeg", "webp")


def local_images(images: DataFrame, files: DataFrame) -> DataFrame:
    """images (doc_id, block_id, folder, target) with asset where a file in the document's folder (path in files) is meant, else with an issue.

    A target with a scheme or two slashes is never fetched; one that leaves the folder, has no image's suffix or no file is not embedded.
    """
    steps = F.filter(F.split(F.concat_ws("/", "folder", "target"), "/"), lambda x: (x != "") & (x != "."))
    done = F.aggregate(steps, F.array().cast("array<string>"), lambda held, x: F.when(x != "..", F.concat(held, F.array(x))).otherwise(F.slice(held, 1, F.greatest(F.size(held) - 1, F.lit(0)))))
    there = files.select(F.col("path").alias("_path"), F.lit(True).alias("_there")).distinct()
    rooted = F.when(F.col("target").startswith("/"), F.lit(None)).otherwise(F.array_join(done, "/"))
    both = images.withColumn("_path", rooted).join(there, "_path", "left")
    suffix = F.lower(F.regexp_extract("target", r"\.([^./]+)$", 1))
    remote = F.col("target").rlike(r"^(?:[a-zA-Z][a-zA-Z0-9+.-]*:|//)")
    inside = F.col("_path").startswith(F.concat("folder", F.lit("/")))
    safe = F.coalesce(~remote & inside & suffix.isin(*IMAGE_SUFFIXES) & F.col("_there"), F.lit(False))
    name = F.concat(F.lit("image-"), "block_id", F.lit("."), suffix)
    issue = F.concat(F.lit("image-"), "block_id")
    return both.select(*images.columns, F.when(safe, name).alias("asset"), F.when(safe, F.col("_path")).alias("copied_from"), F.when(~safe, issue).alias("issue_id"), F.when(~safe, "Image not embedded (remote, missing or unsafe path)").alias("message"))


def coverage_errors(blocks: DataFrame, crops: DataFrame, atoms: DataFrame) -> DataFrame:
    """doc_id, block_id, error of figures and tables whose crop does not hold their sources.

    blocks: doc_id, block_id, kind, asset, source_ids; crops: doc_id, asset, crop_page, c_x0, c_y0, c_x1, c_y1, crop_source,
    crop_asset (hashes when it was cut), source_hash, asset_hash (hashes now); atoms: doc_id, atom_id, page, text and box.
    """
    cut = blocks.where(F.col("kind").isin("figure", "table") & F.col("asset").isNotNull()).join(crops, ["doc_id", "asset"])
    moved = (F.col("crop_source") != F.col("source_hash")) | (F.col("crop_asset") != F.col("asset_hash")) | ~((F.col("c_x0") < F.col("c_x1")) & (F.col("c_y0") < F.col("c_y1")))
    stale = F.coalesce(moved, F.lit(True))
    sources = cut.select("*", F.explode_outer("source_ids").alias("atom_id")).join(atoms.where("trim(text) <> '' and x0 is not null"), ["doc_id", "atom_id"], "left")
    outside = (F.col("x0") < F.col("c_x0") - SLACK) | (F.col("y0") < F.col("c_y0") - SLACK) | (F.col("x1") > F.col("c_x1") + SLACK) | (F.col("y1") > F.col("c_y1") + SLACK)
    found = sources.groupBy("doc_id", "block_id", "kind", "crop_page").agg(F.max(stale.cast("int")).alias("stale"), F.max((F.col("page") != F.col("crop_page")).cast("int")).alias("elsewhere"), F.array_sort(F.collect_set(F.when(outside, F.col("atom_id")))).alias("out"))
    error = F.when(F.col("stale") == 1, "crop provenance differs from source/image; regenerate the crop").when(F.col("elsewhere") == 1, F.concat(F.lit("single-page "), "kind", F.lit(" crop has sources on other pages; recheck image placement")))
    error = error.when(F.size("out") > 0, F.concat("kind", F.lit(" crop excludes source bounds on page "), F.col("crop_page").cast("string"), F.lit(": "), F.array_join(F.slice("out", 1, 5), ", "), F.lit("; recrop all panels/labels")))
    return found.select("doc_id", "block_id", error.alias("error")).where(F.col("error").isNotNull())


def served_assets(requests: DataFrame, blocks: DataFrame, pages: DataFrame) -> DataFrame:
    """Requests (doc_id, asset) for assets that a block or a page of the document names; others are refused."""
    allowed = blocks.select("doc_id", "asset").union(pages.select("doc_id", "asset")).where("asset is not null").distinct()
    return requests.join(allowed, ["doc_id", "asset"], "left_semi")
