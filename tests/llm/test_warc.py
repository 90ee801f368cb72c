"""Round trips of payloads through archives."""

import base64
import gzip
import hashlib
from pathlib import Path

from tapeworks.llm.common import folder
from tapeworks.llm.warc import archive, planned_chunks, read_archives, write_archives

SCHEMA = "page_id long, url string, html string, size string, sha string"
PAGES = [
    (1, "http://a/é?x=%20\r\n", "<p>é</p>"), (2, None, None), (3, "u", ""), (4, "http://b", "<p>é</p>"), (5, "", "long " * 50_000), (6, "x", "long " * 50_000),
    (7, "same", "one"), (7, "same", "one"), (None, "none", "one"), (None, "none", "alone"), (9, "crlf", "WARC/1.1\r\n\r\nContent-Length: 5\r\n\r\n"),
]


def digest(data):
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


def pages(spark, rows=PAGES):
    return spark.createDataFrame([(*r, "s", "h") for r in rows], SCHEMA).repartition(2)


def test_round_trip(spark):
    got = archive(pages(spark), chunk=1000).collect()
    last = [r for r in got if r.last]
    assert len(last) == len(PAGES)
    bodies = sorted((r[0] is not None, r[0] or 0, (r[2] or "").encode()) for r in PAGES)
    assert sorted((r.id is not None, r.id or 0, r.payload_bytes, r.payload_digest) for r in last) == sorted((x, i, len(b), digest(b)) for x, i, b in bodies)
    kinds = {(r.id, r.payload_bytes): (r.record_type, r.refers_to) for r in last}
    assert kinds[1, 9] == ("response", None) and kinds[4, 9] == ("revisit", 1)
    assert kinds[2, 0] == ("response", None) and kinds[3, 0] == ("revisit", 2)
    assert kinds[6, 250_000] == ("revisit", 5) and kinds[7, 3] == ("response", None)
    assert kinds[None, 3] == ("revisit", 7) and kinds[None, 5] == ("response", None)
    targets = {r.id: r.target for r in last if r.id}
    assert targets[1] == "http://a/%C3%A9?x=%20%0D%0A" and targets[2] is None and targets[4] == "http://b"
    chunks = sorted((r.chunk, bytes(r.data), r.payload_bytes, r.payload_digest) for r in got if r.id == 5)
    assert len(chunks) == 250 and b"".join(c[1] for c in chunks) == b"long " * 50_000
    assert all(size == 1000 * (n + 1) and shown == digest((b"long " * 50_000)[:size]) for n, _, size, shown in chunks)


def test_least_bytes(spark):
    last = archive(pages(spark), least_bytes=10).where("last").collect()
    assert {(r.id, r.record_type) for r in last if r.payload_bytes < 10} == {(r.id, "response") for r in last if r.payload_bytes < 10}
    assert {r.id for r in last if r.record_type == "revisit"} == {6}


def test_archives_are_gzip_members(spark, tmp_path):
    to = f"file://{tmp_path}/warc"
    files = write_archives(planned_chunks(pages(spark), "page_id", "url", "html", 0, 1000), to, most=1)
    paths = [r.file for r in files.collect()]
    assert len(paths) == len(PAGES) == len(list(Path(tmp_path, "warc").iterdir()))  # a new archive beyond each size
    text = b"".join(gzip.decompress(Path(p).read_bytes()) for p in paths)
    assert text.count(b"WARC-Type: response") + text.count(b"WARC-Type: revisit") == len(PAGES)
    assert read_archives(files, to).where("last").count() == len(PAGES)


def test_empty(spark):
    assert archive(pages(spark, [])).count() == 0
    assert folder(spark, "x") != folder(spark, "x")
