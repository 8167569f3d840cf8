"""Files of a folder as fragments and issues: one scan, one pass, a content-addressed id for each file.

Importing is idempotent: files whose bytes were imported before are left out before they are read by an importer.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folium.operators.ledger import content_id
from folium.sources import plain
from folium.sources.docx_blocks import read_docx
from folium.sources.fragments import Fragment, Import
from folium.sources.html_blocks import read_html
from folium.sources.markdown_blocks import read_markdown
from folium.sources.tex_blocks import read_tex


def read_text(source: str) -> Import:
    return Import([Fragment("paragraph", *found) for found in plain.fragments(source)])


def _decoded(read: Callable[[str], Import]) -> Callable[[bytes], Import]:
    return lambda raw: read(raw.decode("utf-8-sig"))


READERS: dict[str, Callable[[bytes], Import]] = {".txt": _decoded(read_text), ".md": _decoded(read_markdown), ".markdown": _decoded(read_markdown), ".html": _decoded(read_html), ".htm": _decoded(read_html), ".tex": _decoded(read_tex), ".docx": read_docx}
ROWS = "doc_id string, path string, ord int, atom_id string, block_id string, kind string, text string, start int, end int, line_start int, line_end int, issue_id string, message string"
_TYPES = [pa.string(), pa.string(), pa.int32(), pa.string(), pa.string(), pa.string(), pa.string(), *[pa.int32()] * 4, pa.string(), pa.string()]
_NAMES = [c.split()[0] for c in ROWS.split(", ")]


def _rows(path: str, raw: bytes) -> Iterator[tuple]:
    doc = hashlib.sha256(raw).hexdigest()[:24]
    suffix = "." + path.rsplit(".", 1)[-1].lower()
    try:
        found = READERS[suffix](raw)
    except (UnicodeDecodeError, ValueError, KeyError) as error:
        found = Import(issues=[("import-1", f"{type(error).__name__}: {error}")])
    for k, f in enumerate(found.fragments, 1):
        yield (doc, path, k, f"a{k:05d}", f"b{k:05d}", f.kind, f.text, f.start, f.end, f.line_start, f.line_end, None, None)
    for issue, message in found.issues:
        yield (doc, path, *[None] * 9, issue, message)


def _import(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = [row for path, raw in zip(batch.column("path").to_pylist(), batch.column("content"), strict=True) for row in _rows(path, raw.as_py())]
        columns = list(zip(*rows, strict=True)) or [()] * len(_TYPES)
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, _TYPES, strict=True)], names=_NAMES)


def supported(files: DataFrame) -> DataFrame:
    """Files of a known kind; the suffix is looked at whatever its case."""
    return files.where(F.lower(F.regexp_extract("path", r"\.[^./]+$", 0)).isin(*READERS))


def import_files(spark: SparkSession, folder: str, known: DataFrame | None = None) -> DataFrame:
    """Rows of fragments (with atom and block ids) and of issues of all files in a folder that `known` (doc_id) lacks."""
    files = supported(spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folder).select("path", "content"))
    return import_rows(files, known)


def import_rows(files: DataFrame, known: DataFrame | None = None) -> DataFrame:
    """Rows of the files whose bytes are not known; of files with equal bytes the one of the least path is imported."""
    first = files.select(content_id(F.col("content")).alias("_id"), F.struct("path", "content").alias("_file"))
    if known is not None:
        first = first.join(known.select(F.col("doc_id").alias("_id")).distinct(), "_id", "left_anti")
    one = first.groupBy("_id").agg(F.min("_file").alias("_file"))
    return one.select("_file.path", "_file.content").mapInArrow(_import, ROWS)


ASSETS = "doc_id string, block_id string, asset string, content binary, cut_left int, cut_top int, cut_right int, cut_bottom int, width int, height int"
_ASSET_TYPES = [pa.string(), pa.string(), pa.string(), pa.binary(), *[pa.int32()] * 6]


def image_size(content: bytes) -> tuple[int | None, int | None]:
    """Width and height of a PNG, GIF or JPEG by its head; nulls for anything else."""
    if content[:8] == b"\x89PNG\r\n\x1a\n" and len(content) >= 24:
        return int.from_bytes(content[16:20]), int.from_bytes(content[20:24])
    if content[:6] in (b"GIF87a", b"GIF89a") and len(content) >= 10:
        return int.from_bytes(content[6:8], "little"), int.from_bytes(content[8:10], "little")
    at = 2
    while content[:2] == b"\xff\xd8" and at + 9 <= len(content) and content[at] == 0xFF:
        if 0xC0 <= content[at + 1] <= 0xCF and content[at + 1] not in (0xC4, 0xC8, 0xCC):
            return int.from_bytes(content[at + 7 : at + 9]), int.from_bytes(content[at + 5 : at + 7])
        at += 2 + int.from_bytes(content[at + 2 : at + 4])
    return None, None


LINKS = "doc_id string, block_id string, folder string, target string"


def _links(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = []
        for path, raw in zip(batch.column("path").to_pylist(), batch.column("content"), strict=True):
            content = raw.as_py()
            doc, suffix = hashlib.sha256(content).hexdigest()[:24], "." + path.rsplit(".", 1)[-1].lower()
            try:
                found = READERS[suffix](content).links
            except (UnicodeDecodeError, ValueError, KeyError):  # an issue of the import
                found = []
            rows += [(doc, f"b{n:05d}", path.rpartition("/")[0], target) for n, target in found]
        columns = list(zip(*rows, strict=True)) or [()] * 4
        yield pa.RecordBatch.from_arrays([pa.array(c, pa.string()) for c in columns], names=[c.split()[0] for c in LINKS.split(", ")])


def image_links(documents: DataFrame) -> DataFrame:
    """doc_id, block_id, folder, target of the images that HTML and Markdown files show; local_images tells which may be copied."""
    one = documents.select(content_id(F.col("content")).alias("_id"), F.struct("path", "content").alias("_file")).groupBy("_id").agg(F.min("_file").alias("_file"))
    return supported(one.select("_file.path", "_file.content")).mapInArrow(_links, LINKS)


def _assets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for raw in batch.column("content"):
            content = raw.as_py()
            try:
                found = read_docx(content).assets
            except (UnicodeDecodeError, ValueError, KeyError):  # an issue of the import
                found = []
            doc = hashlib.sha256(content).hexdigest()[:24]
            rows = [(doc, f"b{a.fragment:05d}", a.name, a.content, *(a.crop or (None,) * 4), *image_size(a.content)) for a in found]
            columns = list(zip(*rows, strict=True)) or [()] * len(_ASSET_TYPES)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, _ASSET_TYPES, strict=True)], names=[c.split()[0] for c in ASSETS.split(", ")])


def images_of_documents(documents: DataFrame) -> DataFrame:
    """doc_id, block_id, asset, content of the images in Word documents, with the shares that are cut off, and their sizes in pixels."""
    word = documents.where(F.lower("path").endswith(".docx"))
    return word.groupBy(content_id(F.col("content")).alias("_id")).agg(F.first("content").alias("content")).select("content").mapInArrow(_assets, ASSETS)


def fragments_of(imported: DataFrame) -> DataFrame:
    return imported.where("atom_id is not null").drop("issue_id", "message")


def issues_of(imported: DataFrame) -> DataFrame:
    return imported.where("issue_id is not null").select("doc_id", "path", "issue_id", "message")
