"""WARC archives written from and read as a chunked record table.

A payload travels as rows of record identifier, chunk number and at most
``CHUNK`` bytes.  The writer appends chunks to the open record, the reader
returns them while it inflates the archive; each chunk row carries the digest
and the length of the payload up to its end.  The reader holds a chunk; the writer's plan
holds the payload of a row, which is one value of the input, while it is cut.

Records of equal payload become one response and revisits that name it.
Archives are written below the folder the cluster shares, under a name of their
own for each attempt of a task; the list of archives holds those of successful
attempts alone.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import re
import uuid
import zlib
from collections.abc import Iterator
from urllib.parse import quote

import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tapeworks.llm.common import folder, query, store, table

CHUNK = 64 << 10
ARCHIVE = 1 << 30
SCHEME = "urn:x-record:"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
DATE = "1970-01-01T00:00:00Z"
CHUNK_SCHEMA = (
    "id long, record_type string, refers_to long, target string, declared_digest string, chunk long, data binary, "
    "payload_bytes long, payload_digest string, last boolean"
)


def base32(digest: bytes) -> str:
    return base64.b32encode(digest).decode()


def planned_chunks(pages: DataFrame, ident: str, url: str, payload: str, least_bytes: int, chunk: int) -> DataFrame:
    """Chunk rows of all records, with what their headers say, each record's in order."""
    body = F.encode(F.coalesce(F.col(payload).cast("string"), F.lit("")), "UTF-8")
    rows = pages.select(F.col(ident).cast("long").alias("id"), F.col(url).cast("string").alias("url"), body.alias("body"))
    rows = rows.withColumns({"sha": F.sha1("body"), "size": F.length("body").cast("long")})
    shared = rows.where(F.col("size") >= least_bytes).groupBy("sha").agg(F.min("id").alias("first"), F.count(F.lit(1)).alias("n"))
    shared = shared.where("n > 1").drop("n")
    known = rows.join(shared, "sha", "left")
    again = F.col("first").isNotNull() & ~F.col("id").eqNullSafe(F.col("first")) & (F.col("size") >= least_bytes)
    known = known.withColumn("refers", F.when(again, F.col("first")))
    sent = F.when(F.col("refers").isNull(), F.col("body")).otherwise(F.lit(b""))
    parts = F.transform(
        F.sequence(F.lit(0), F.floor(F.greatest(F.octet_length("sent") - 1, F.lit(0)) / chunk).cast("int")),
        lambda i: F.struct(i.alias("chunk"), F.substring("sent", i * chunk + 1, F.lit(chunk)).alias("data")),
    )
    return known.withColumn("sent", sent).select("id", "url", "sha", "size", "refers", F.inline(parts))


def _header(record: dict) -> bytes:
    """WARC and HTTP headers of a record; the payload's length is known from its row."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {record['size']}\r\n\r\n".encode()
    revisit = record["refers"] is not None
    lines = [
        "WARC/1.1", f"WARC-Type: {'revisit' if revisit else 'response'}", f"WARC-Record-ID: <{SCHEME}{record['id']}>", f"WARC-Date: {DATE}",
        f"WARC-Payload-Digest: sha1:{base32(bytes.fromhex(record['sha']))}", "Content-Type: application/http; msgtype=response",
        f"Content-Length: {len(http) + (0 if revisit else record['size'])}",
    ]
    if record["url"] is not None:
        lines.append(f"WARC-Target-URI: {quote(record['url'], safe=':/?#[]@!$&()*+,;=%~-._', errors='surrogatepass')}")
    if revisit:
        lines += [f"WARC-Refers-To: <{SCHEME}{record['refers']}>", f"WARC-Profile: {PROFILE}"]
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + http


def write_archives(chunks: DataFrame, to: str, level: int = 6, most: int = ARCHIVE) -> DataFrame:
    """Write chunk rows as ``.warc.gz`` files, a gzip member per record; returns ``file`` and ``records``, stored."""

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, base = fs.FileSystem.from_uri(to)
        out, member, path, records, done = None, None, "", 0, []
        for b in batches:
            for record in (dict(zip(b.schema.names, row)) for row in zip(*[c.to_pylist() for c in b.columns])):
                if record["chunk"] == 0:
                    if member:
                        out.write(member.compress(b"\r\n\r\n") + member.flush())
                    if out is not None and out.tell() >= most:
                        out.close()
                        done.append((path, records))
                        out = None
                    if out is None:
                        path, records = f"{base}/part-{TaskContext.get().partitionId():05d}-{uuid.uuid4().hex}.warc.gz", 0
                        system.create_dir(base, recursive=True)
                        out = system.open_output_stream(path, compression=None)
                    member, records = zlib.compressobj(level, zlib.DEFLATED, 31), records + 1
                    out.write(member.compress(_header(record)))
                out.write(member.compress(record["data"]))
        if out is not None:
            out.write(member.compress(b"\r\n\r\n") + member.flush())
            out.close()
            done.append((path, records))
        yield pa.RecordBatch.from_arrays([pa.array([p for p, _ in done], pa.string()), pa.array([n for _, n in done], pa.int64())], ["file", "records"])

    return store(chunks.mapInArrow(write, "file string, records long"), "archives")


def _records(stream, chunk: int) -> Iterator[tuple]:
    """Chunk rows of one inflated archive."""
    while line := stream.readline():
        if not line.strip():
            continue
        if not line.startswith(b"WARC/"):
            raise ValueError(f"no record begins here: {line[:60]!r}")
        head = {}
        while (line := stream.readline()).strip():
            name, _, value = line.decode().partition(":")
            head[name.strip().lower()] = value.strip()
        left, declared = int(head["content-length"]), 0
        while left and (line := stream.readline()):
            left -= len(line)
            if not line.strip():
                break
            if found := re.match(rb"(?i)content-length:\s*(\d+)", line):
                declared = int(found[1])
        kind, digest, size, number = head["warc-type"], hashlib.sha1(usedforsecurity=False), 0, 0
        number_of = lambda name: None if "None" in head[name] else int(head[name].removeprefix(f"<{SCHEME}").removesuffix(">"))
        common = (number_of("warc-record-id"), kind, number_of("warc-refers-to") if "warc-refers-to" in head else None,
                  head.get("warc-target-uri"), head["warc-payload-digest"].removeprefix("sha1:"))
        while True:
            data = stream.read(min(left, chunk))
            if len(data) < min(left, chunk):
                raise ValueError("the archive ends inside a record")
            left, size = left - len(data), size + len(data)
            digest.update(data)
            shown = (declared, common[4]) if kind == "revisit" else (size, base32(digest.copy().digest()))
            yield (*common, number, data, *shown, not left)
            number += 1
            if not left:
                break


def read_archives(archives: DataFrame, to: str, chunk: int = CHUNK, batch: int = 16 << 20) -> DataFrame:
    """Chunk rows of the archives listed in ``file``.

    ``payload_bytes`` and ``payload_digest`` are those of the payload up to the end of
    the chunk; a revisit has one empty chunk and shows what its headers declare.
    """
    names = CHUNK_SCHEMA.replace(",", "").split()[::2]
    types = [pa.int64(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.binary(), pa.int64(), pa.string(), pa.bool_()]

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, _ = fs.FileSystem.from_uri(to)
        rows, held = [], 0
        for b in batches:
            for path in b.column(0).to_pylist():
                with system.open_input_stream(path, compression=None, buffer_size=1 << 20) as raw, gzip.GzipFile(fileobj=raw) as stream:
                    for row in _records(stream, chunk):
                        rows.append(row)
                        held += len(row[6]) + 200
                        if held >= batch:
                            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names)
                            rows, held = [], 0
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names)

    n = max(1, archives.count())
    return archives.select("file").repartition(min(n, 100_000), "file").mapInArrow(read, CHUNK_SCHEMA)


def qualified(spark: SparkSession, path: str) -> str:
    """A path with the scheme and host of the file system it lies on: without a scheme, the cluster's default one."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    uri = p.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(p).toString()
    return uri.replace("file:/", "file:///", 1) if re.match("file:/[^/]", uri) else uri


def archive(pages: DataFrame, ident: str = "page_id", url: str = "url", payload: str = "html", least_bytes: int = 0, chunk: int = CHUNK) -> DataFrame:
    """Write a WARC record per row and read the archives back as chunk rows.

    A null payload is empty.  Of records with equal payloads of at least ``least_bytes``
    bytes, that with the smallest id is the response and the others revisit it; rows
    that share that smallest id are all responses, and rows with a null id revisit any
    record with an id.  A null url leaves the target out; blanks, control and non-ASCII
    characters of others are percent-encoded.  Equal rows give a record each.
    """
    to = qualified(pages.sparkSession, folder(pages.sparkSession, "warc"))
    files = write_archives(planned_chunks(pages, ident, url, payload, least_bytes, chunk), to)
    return read_archives(files, to, chunk)


_ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
OP2_SQL = f"""
WITH p AS (SELECT page_id, coalesce(html, '') AS body, sha1(coalesce(html, '')) AS h FROM pages),
d AS (
  SELECT page_id, strlen(body) AS payload_bytes, min(page_id) OVER (PARTITION BY h) AS first,
    array_to_string(list_transform(range(32), lambda i: substr('{_ALPHABET}', 1 +
      ((('0x' || substr(h, (5 * (i // 4) + 1)::BIGINT, 5))::BIGINT >> (15 - 5 * (i % 4))::INT) & 31)::INT, 1)), '') AS payload_digest FROM p)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN page_id <> first THEN first END AS refers_to FROM d
"""


@query("op2_warc", OP2_SQL)
def op2(spark, d):
    records = archive(table(spark, d, "pages")).where("last")
    return records.select(F.col("id").alias("page_id"), "payload_bytes", "payload_digest", "record_type", "refers_to")
