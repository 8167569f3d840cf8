"""Operator 7, WARC: a monolithic gzip normaliser.

Pages become WARC/1.1 archives. Each archive is first one gzip stream over all its records. The
normaliser inflates that stream once, from front to back, rewrites every record as a gzip member
of its own and writes a sidecar index with the offset, length, type and id of each member; the
whole-file stream is then removed. Reading goes by the sidecar and inflates single members.

Of records with equal payloads of at least MIN_BYTES, the one with the largest page_id is a
response and the others revisit it. The decision is made from digests alone, which Spark joins
with split partitions where one payload is very common; bodies move once, by page.

Archives are written under a name of the attempt and then renamed, in the folder that the
session's spark.checkpoint.dir names; a lost executor's archive is written again.

Defined cases: a null html is an empty payload; a null url is an empty target; rows that share the
largest page_id of a payload are all responses; a null page_id is never referred to, unless all
ids of the payload are null, when all its rows are responses; repeated rows are records of their own; a very long
html is one record, which a task holds whole; columns but page_id, url and html are ignored;
an empty table gives no rows.
"""

from __future__ import annotations

import base64
import hashlib
import json
import uuid
import zlib
from collections.abc import Callable, Iterator
from typing import BinaryIO

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folium.llm.shared import lean_batches, new_folder, write_table
from folium.llm.store import Store

MIN_BYTES = 1000
#: Payload bytes after which a task begins another archive.
ARCHIVE_BYTES = 256 << 20
CHUNK = 1 << 20
LEVEL = 1
DATE = "2024-01-01T00:00:00Z"
ID = "urn:page:"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
_GZIP = 31  # zlib's window bits for a gzip header


def one_line(text: str) -> str:
    """A header value: controls and line ends are percent-encoded."""
    return "".join(c if c >= " " and c != "\x7f" else f"%{ord(c):02X}" for c in text)


def base32_digest(payload_sha1: bytes) -> str:
    return "sha1:" + base64.b32encode(payload_sha1).decode()


def record(page_id: int | None, url: str, payload: bytes, sha1: bytes, refers_to: int | None) -> bytes:
    """One record: a response with its payload, or a revisit that has headers alone."""
    revisit = refers_to is not None
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if revisit else http + payload
    head = [
        "WARC/1.1",
        f"WARC-Type: {'revisit' if revisit else 'response'}",
        f"WARC-Record-ID: <{ID}{'' if page_id is None else page_id}>",
        f"WARC-Date: {DATE}",
        f"WARC-Target-URI: {one_line(url)}",
        f"WARC-Payload-Digest: {base32_digest(sha1)}",
        *([f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: <{ID}{refers_to}>"] if revisit else []),
        "Content-Type: application/http; msgtype=response",
        f"Content-Length: {len(block)}",
    ]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def parse(raw: bytes) -> dict:
    """Headers, HTTP length and payload of one record."""
    head, _, rest = raw.partition(b"\r\n\r\n")
    lines = head.decode().split("\r\n")
    if not lines[0].startswith("WARC/"):
        raise ValueError("not a WARC record")
    fields = dict(line.split(": ", 1) if ": " in line else (line.rstrip(":"), "") for line in lines[1:])
    block = rest[: int(fields["Content-Length"])]
    http, _, payload = block.partition(b"\r\n\r\n")
    length = next(int(x.split(b":")[1]) for x in http.split(b"\r\n") if x.lower().startswith(b"content-length:"))
    return {"fields": fields, "http_length": length, "payload": payload}


def records_of(stream: BinaryIO) -> Iterator[bytes]:
    """The records in one whole-file gzip stream, inflated once; memory holds one record and a chunk, however well it is packed."""
    inflate, held = zlib.decompressobj(_GZIP), bytearray()
    need = None
    while True:
        if need is None and (at := held.find(b"\r\n\r\n")) >= 0:
            lines = held[:at].split(b"\r\n")
            need = at + 4 + next(int(x.split(b":")[1]) for x in lines if x.lower().startswith(b"content-length:")) + 4
        if need is not None and len(held) >= need:
            yield bytes(held[:need])
            del held[:need]
            need = None
            continue
        chunk = inflate.unconsumed_tail or stream.read(CHUNK)
        more = inflate.decompress(chunk, CHUNK) if chunk else inflate.flush()
        if not chunk and not more:
            break
        held += more
    if held.strip():
        raise ValueError("the stream ends within a record")


def normalise(store: Store, monolith: str, archive: str) -> int:
    """Rewrites each record of a whole-file stream as a member of its own, with a sidecar index; returns the number of records."""
    offset, n = 0, 0
    with store.stream(monolith) as stream, store.create(archive) as out, store.create(archive + ".idx") as sidecar:
        for raw in records_of(stream):
            deflate = zlib.compressobj(LEVEL, zlib.DEFLATED, _GZIP)
            member = deflate.compress(raw) + deflate.flush()
            out.write(member)
            fields = parse(raw)["fields"]
            sidecar.write(json.dumps({"offset": offset, "length": len(member), "type": fields["WARC-Type"], "id": fields["WARC-Record-ID"]}).encode() + b"\n")
            offset, n = offset + len(member), n + 1
    return n


def _writer(folder: str, archive_bytes: int) -> Callable:
    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store = Store(folder)
        attempt = uuid.uuid4().hex
        names, counts = [], []
        out = deflate = None
        filled = 0

        def close() -> None:
            nonlocal out, filled
            if out is None:
                return
            out.write(deflate.flush())
            out.close()
            name = f"part-{attempt}-{len(names):05d}.warc.gz"
            n = normalise(store, f"_{name}.whole", f"_{name}")
            store.rename(f"_{name}.idx", f"{name}.idx")
            store.rename(f"_{name}", name)
            store.drop(f"_{name}.whole")
            names.append(name)
            counts.append(n)
            out, filled = None, 0

        for batch in batches:
            columns = [batch.column(c) for c in ("page_id", "url", "html", "keeper")]
            for row in range(batch.num_rows):
                page_id, url, html, keeper = (c[row].as_py() for c in columns)
                if out is None:
                    out = store.create(f"_part-{attempt}-{len(names):05d}.warc.gz.whole")
                    deflate = zlib.compressobj(LEVEL, zlib.DEFLATED, _GZIP)
                payload = (html or "").encode()
                raw = record(page_id, url or "", payload, hashlib.sha1(payload).digest(), keeper)
                out.write(deflate.compress(raw))
                filled += len(raw)
                if filled >= archive_bytes:
                    close()
        close()
        yield pa.RecordBatch.from_arrays([pa.array(names, pa.string()), pa.array(counts, pa.int64())], names=["archive", "n_records"])

    return write


def _reader(folder: str) -> Callable:
    def number(value: str) -> int | None:
        digits = value.strip("<>").removeprefix(ID)
        return int(digits) if digits else None

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store = Store(folder)
        for batch in batches:
            for name in batch.column("archive").to_pylist():
                rows = []
                with store.stream(name + ".idx") as sidecar:
                    index = [json.loads(line) for line in sidecar.read().splitlines()]
                with store.seekable(name) as archive:
                    for entry in index:
                        archive.seek(entry["offset"])
                        found = parse(zlib.decompress(archive.read(entry["length"]), _GZIP))
                        fields = found["fields"]
                        stated = base64.b32decode(fields["WARC-Payload-Digest"].removeprefix("sha1:")).hex()
                        revisit = fields["WARC-Type"] == "revisit"
                        digest = stated if revisit else hashlib.sha1(found["payload"]).hexdigest()
                        if digest != stated:
                            raise ValueError(f"{name}: the payload of {entry['id']} has another digest")
                        size = found["http_length"] if revisit else len(found["payload"])
                        rows.append((number(fields["WARC-Record-ID"]), size, digest, fields["WARC-Type"], number(fields["WARC-Refers-To"]) if revisit else None))
                types = (pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64())
                columns = list(zip(*rows, strict=True)) or [()] * 5
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names=["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"])

    return read


def revisits(pages: DataFrame, min_bytes: int = MIN_BYTES) -> DataFrame:
    """row key and keeper of every page whose payload another page's response holds."""
    body = F.coalesce(F.col("html"), F.lit("")).cast("binary")
    digests = pages.where(F.octet_length("html") >= min_bytes).select("page_id", F.sha1(body).alias("digest"))
    digests = write_table(digests, "warc-digests")
    keepers = digests.groupBy("digest").agg(F.max("page_id").alias("keeper"), F.count(F.lit(1)).alias("n")).where((F.col("n") > 1) & F.col("keeper").isNotNull())
    keepers = write_table(keepers.select(F.col("digest").alias("shared"), "keeper"), "warc-keepers")
    found = digests.join(keepers, F.col("digest") == F.col("shared"))
    return found.where(~F.col("page_id").eqNullSafe(F.col("keeper"))).select(F.col("page_id").alias("again"), F.col("digest").alias("again_digest"), "keeper").distinct()


def write_archives(pages: DataFrame, folder: str, archive_bytes: int = ARCHIVE_BYTES) -> DataFrame:
    """Writes all pages as archives with sidecars under folder; returns a table of archive and n_records."""
    body = F.coalesce(F.col("html"), F.lit("")).cast("binary")
    rows = lean_batches(pages).select("page_id", "url", "html", F.sha1(body).alias("digest"))
    marked = rows.join(revisits(pages), F.col("page_id").eqNullSafe(F.col("again")) & (F.col("digest") == F.col("again_digest")), "left")
    manifest = marked.select(F.col("page_id").cast("long").alias("page_id"), "url", "html", F.col("keeper").cast("long").alias("keeper")).mapInArrow(_writer(folder, archive_bytes), "archive string, n_records long")
    return write_table(manifest, "warc-manifest")


def read_archives(manifest: DataFrame, folder: str) -> DataFrame:
    """page_id, payload_bytes, payload_digest, record_type and refers_to of every record, read by the sidecars."""
    tasks = max(1, manifest.count())
    return manifest.repartition(tasks, "archive").select("archive").mapInArrow(_reader(folder), "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long")


def op7(pages: DataFrame) -> DataFrame:
    """Writes every page to WARC archives and reads them back: page_id, payload_bytes, payload_digest, record_type, refers_to."""
    folder = new_folder(pages.sparkSession, "warc")
    return read_archives(write_archives(pages, folder), folder)


ORACLE = r"""
WITH p AS (
  SELECT page_id, coalesce(html, '') AS html FROM pages
), d AS (
  SELECT page_id, octet_length(encode(html))::BIGINT AS payload_bytes, sha1(html) AS payload_digest FROM p
), k AS (
  SELECT *, CASE WHEN payload_bytes >= 1000 THEN max(page_id) OVER (PARTITION BY payload_digest) ELSE page_id END AS keeper FROM d
)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN page_id = keeper THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id <> keeper THEN keeper END AS refers_to
FROM k
"""
