"""WARC archives: writing, normalising and reading.

Crawlers often gzip a whole archive as one stream, in which no record can be reached without inflating
all before it. The normaliser inflates such a stream once, rewrites every record as a gzip member of its
own, and writes a sidecar index of offsets, by which a record is read alone.
"""

from __future__ import annotations

import base64
import hashlib
import json
import os
import uuid
import zlib
from collections.abc import Iterator
from typing import BinaryIO

import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import batches, delete, new_path, store

GZIP, LEVEL, PART = 31, 3, 1 << 20
#: WARC time of all records: a crawl date is not in the input, and reruns must agree.
DATE = "2024-01-01T00:00:00Z"
HTTP = "HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n"


def record(fields: list[tuple[str, str]], block: bytes) -> bytes:
    head = "".join(f"{name}: {value}\r\n" for name, value in [*fields, ("Content-Length", str(len(block)))])
    return b"WARC/1.1\r\n" + head.encode() + b"\r\n" + block + b"\r\n\r\n"


def record_id(ident: object) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'page:{ident}')}>"


def header_value(text: str) -> str:
    """One line: control characters and the escape character are percent-encoded."""
    return "".join(f"%{ord(ch):02X}" if ord(ch) < 32 or ch == "%" or ord(ch) == 127 else ch for ch in text)


def page_record(ident: object, url: str | None, payload: bytes, digest: str, original: object | None) -> bytes:
    """A response with its payload, or a revisit that refers to the response of equal payload."""
    revisit = original is not None
    fields = [("WARC-Type", "revisit" if revisit else "response"), ("WARC-Record-ID", record_id(ident)), ("WARC-Date", DATE), ("WARC-Target-URI", header_value(url or "")), ("WARC-Payload-Digest", f"sha1:{digest}"), ("X-Page-Id", json.dumps(ident))]
    if revisit:
        fields += [("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"), ("WARC-Refers-To", record_id(original)), ("X-Refers-To-Page-Id", json.dumps(original))]
    fields.append(("Content-Type", "application/http;msgtype=response"))
    return record(fields, (HTTP % len(payload)).encode() + (b"" if revisit else payload))


class Stream:
    """Bytes of a gzip file, of one member or of many, inflated part by part."""

    def __init__(self, file: BinaryIO):
        self.file, self.inflate, self.held, self.over = file, zlib.decompressobj(GZIP), bytearray(), False

    def more(self) -> bool:
        """Inflate about PART more bytes, whatever the ratio; False at the end."""
        if self.over:
            return False
        data = self.inflate.unconsumed_tail or self.inflate.unused_data or self.file.read(PART)
        if self.inflate.eof:
            self.inflate = zlib.decompressobj(GZIP)
        if not data:
            self.over = True
            return False
        self.held += self.inflate.decompress(data, PART)
        return True

    def until(self, mark: bytes) -> bytes | None:
        """Bytes up to and with ``mark``; None at a clean end."""
        start = 0
        while (at := self.held.find(mark, start)) < 0:
            start = max(0, len(self.held) - len(mark) + 1)
            if not self.more():
                if self.held.strip():
                    raise ValueError("truncated WARC header")
                return None
        return self.take(at + len(mark))

    def take(self, n: int) -> bytes:
        while len(self.held) < n:
            if not self.more():
                raise ValueError("truncated WARC record")
        out = bytes(self.held[:n])
        del self.held[:n]
        return out


def records(file: BinaryIO) -> Iterator[tuple[dict[str, str], bytes, bytes]]:
    """(header fields in lower case, block, raw record) of each record, in order, one at a time."""
    stream = Stream(file)
    while (head := stream.until(b"\r\n\r\n")) is not None:
        lines = head.decode("utf-8", "surrogateescape").split("\r\n")
        if not lines[0].startswith("WARC/"):
            raise ValueError(f"not a WARC record: {lines[0][:40]!r}")
        fields = {name.strip().lower(): value.strip() for name, _, value in (x.partition(":") for x in lines[1:] if x)}
        block = stream.take(int(fields["content-length"]))
        tail = stream.take(4)
        if tail != b"\r\n\r\n":
            raise ValueError("a WARC record does not end where its length says")
        yield fields, block, head + block + tail


def normalise(source: BinaryIO, archive: BinaryIO, index: BinaryIO) -> int:
    """Rewrite one gzip stream with a member per record and a JSON line of its place in ``index``.

    The stream is inflated once and a record at a time is held. Returns the number of records."""
    offset = count = 0
    for fields, _, raw in records(source):
        deflate = zlib.compressobj(LEVEL, zlib.DEFLATED, GZIP)
        member = deflate.compress(raw) + deflate.flush()
        archive.write(member)
        entry = {"offset": offset, "length": len(member), "type": fields.get("warc-type"), "id": fields.get("warc-record-id"), "uri": fields.get("warc-target-uri")}
        index.write(json.dumps(entry).encode() + b"\n")
        offset += len(member)
        count += 1
    return count


def payload_of(fields: dict[str, str], block: bytes) -> tuple[object, int, str, str, object]:
    """(page id, payload bytes, base32 SHA-1, type, page id referred to) of a page's record.

    A response's figures come from its payload and must agree with its headers."""
    head, _, payload = block.partition(b"\r\n\r\n")
    size = next(int(x.split(b":")[1]) for x in head.split(b"\r\n") if x.lower().startswith(b"content-length:"))
    digest = fields["warc-payload-digest"].removeprefix("sha1:")
    kind = fields["warc-type"]
    if kind == "response" and (len(payload) != size or base64.b32encode(hashlib.sha1(payload).digest()).decode() != digest):
        raise ValueError(f"payload of {fields['warc-record-id']} does not match its header")
    original = json.loads(fields["x-refers-to-page-id"]) if kind == "revisit" else None
    return json.loads(fields["x-page-id"]), size, digest, kind, original


class Output:
    """A file that appears under its name only when it is whole; a repeated task replaces it."""

    def __init__(self, path: str):
        self.fs, self.path = fs.FileSystem.from_uri(path)
        self.fs.create_dir(os.path.dirname(self.path), recursive=True)
        self.temp = f"{self.path}.{uuid.uuid4().hex}"
        self.file = self.fs.open_output_stream(self.temp, compression=None)

    def commit(self) -> None:
        self.file.close()
        self.fs.move(self.temp, self.path)


def uri(path: str) -> str:
    return path if "://" in path else "file:" + path if path.startswith("//") else f"file://{path.removeprefix('file:')}"


def write_archives(pages: DataFrame, folder: str, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", least: int = 0) -> DataFrame:
    """Write ``pages`` as monolithic archives, one for each partition; returns (path, records).

    Of records with equal payloads of at least ``least`` bytes the one with the smallest id is the
    response and the others revisit it. Null payloads are empty ones. Rows that repeat the smallest id
    are all responses; a null id is never the smallest unless all are null, and then all are responses.
    """
    spark = pages.sparkSession
    batches(spark)
    rows = pages.select(F.col(id_col).alias("id"), F.col(url_col).cast("string").alias("url"), F.coalesce(F.col(html_col).cast("binary"), F.lit(b"")).alias("payload"))
    rows = rows.withColumn("digest", F.sha1("payload"))
    first = rows.where(F.length("payload") >= least).groupBy("digest").agg(F.min("id").alias("first"), F.count("*").alias("c")).where("c > 1").select("digest", "first")
    rows = rows.join(first, "digest", "left").withColumn("original", F.when(~F.col("id").eqNullSafe(F.col("first")), F.col("first")))
    target = uri(folder)

    def write(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out, deflate, count = None, None, 0
        for part in parts:
            for ident, url, payload, digest, original in zip(*(part.column(c).to_pylist() for c in ("id", "url", "payload", "digest", "original")), strict=True):
                if out is None:
                    out, deflate = Output(f"{target}/part-{TaskContext.get().partitionId():06d}.warc.gz"), zlib.compressobj(1, zlib.DEFLATED, GZIP)
                bare = base64.b32encode(bytes.fromhex(digest)).decode()
                out.file.write(deflate.compress(page_record(ident, url, payload, bare, original)))
                count += 1
        if out is not None:
            out.file.write(deflate.flush())
            out.commit()
            yield pa.RecordBatch.from_arrays([pa.array([f"{target}/{os.path.basename(out.path)}"]), pa.array([count], pa.int64())], ["path", "records"])

    return store(rows.select("id", "url", "payload", "digest", "original").mapInArrow(write, "path string, records bigint"), "written")


def normalise_archives(archives: DataFrame, folder: str) -> DataFrame:
    """Normalise each archive (path) into ``folder``; returns (path, index, records)."""
    target = uri(folder)

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            for path in part.column("path").to_pylist():
                where, inner = fs.FileSystem.from_uri(path)
                out = Output(f"{target}/{os.path.basename(inner)}")
                index = Output(f"{target}/{os.path.basename(inner)}.index.jsonl")
                with where.open_input_stream(inner, compression=None) as source:
                    count = normalise(source, out.file, index.file)
                out.commit()
                index.commit()
                yield pa.RecordBatch.from_arrays([pa.array([f"{target}/{os.path.basename(out.path)}"]), pa.array([f"{target}/{os.path.basename(index.path)}"]), pa.array([count], pa.int64())], ["path", "index", "records"])

    n = max(archives.count(), 1)
    return store(archives.select("path").repartition(n).mapInArrow(run, "path string, index string, records bigint"), "normalised")


def read_archives(archives: DataFrame, id_type: str = "bigint", id_name: str = "page_id") -> DataFrame:
    """The page records of normalised archives (path, index), each read by its place in the index."""

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            for path, index in zip(part.column("path").to_pylist(), part.column("index").to_pylist(), strict=True):
                where, inner = fs.FileSystem.from_uri(path)
                with where.open_input_stream(fs.FileSystem.from_uri(index)[1], compression=None) as lines, where.open_input_file(inner) as archive:
                    rest, rows = b"", []
                    while data := lines.read(PART):
                        *whole, rest = (rest + data).split(b"\n")
                        for line in whole:
                            entry = json.loads(line)
                            archive.seek(entry["offset"])
                            raw = pa.BufferReader(archive.read(entry["length"]))
                            rows += [payload_of(fields, block) for fields, block, _ in records(raw)]
                        if len(rows) >= 10_000:
                            yield batch(rows)
                            rows = []
                    if rows:
                        yield batch(rows)

    kinds = {"bigint": pa.int64(), "int": pa.int32()}

    def batch(rows: list[tuple]) -> pa.RecordBatch:
        ident, size, digest, kind, original = zip(*rows, strict=True)
        kind_of_id = kinds.get(id_type, pa.string())
        return pa.RecordBatch.from_arrays([pa.array(ident, kind_of_id), pa.array(size, pa.int64()), pa.array(digest), pa.array(kind), pa.array(original, kind_of_id)], [id_name, "payload_bytes", "payload_digest", "record_type", "refers_to"])

    n = max(archives.count(), 1)
    return archives.select("path", "index").repartition(n).mapInArrow(run, f"{id_name} {id_type}, payload_bytes bigint, payload_digest string, record_type string, refers_to {id_type}")


def op2_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All pages through monolithic archives, the normaliser and back by the index."""
    raw, neat = new_path(spark, "warc"), new_path(spark, "warc-members")
    written = write_archives(spark.read.parquet(f"{sf_dir}/pages.parquet"), raw)
    normalised = normalise_archives(written, neat)
    delete(spark, raw)
    return read_archives(normalised)


OP2_SQL = """
with p as (select page_id, strlen(coalesce(html, '')) as n, sha1(coalesce(html, '')) as d from pages),
q as (select *, min(page_id) over (partition by d) as first from p)
select page_id, n::bigint as payload_bytes,
       array_to_string(list_transform(range(32), lambda k: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', ((('0x' || substr(d, (k // 8 * 10 + 1)::int, 10))::bigint >> (35 - 5 * (k % 8))::int) & 31)::int + 1, 1)), '') as payload_digest,
       case when page_id = first then 'response' else 'revisit' end as record_type,
       case when page_id <> first then first end as refers_to
from q
"""
