"""A well-packed stream is inflated a chunk at a time."""

import hashlib
import tracemalloc
import zlib

from folium.llm import warc


def test_memory_holds_a_record_and_a_chunk(tmp_path):
    deflate = zlib.compressobj(9, zlib.DEFLATED, 31)
    body = bytes(5 << 20)
    with open(tmp_path / "whole", "wb") as out:
        for k in range(20):
            out.write(deflate.compress(warc.record(k, "u", body, hashlib.sha1(body).digest(), None)))
        out.write(deflate.flush())
    tracemalloc.start()
    with open(tmp_path / "whole", "rb") as stream:
        assert sum(1 for _ in warc.records_of(stream)) == 20
    assert tracemalloc.get_traced_memory()[1] < 40 << 20
    tracemalloc.stop()
