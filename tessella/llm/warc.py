"""Operator 6: WARC archives through a chunked record table.

Pages become chunk rows right behind the scan: (row, record, chunk_no, last, url, total, sha1, data), at
most CHUNK bytes each, where sha1 is the running digest up to the chunk, so the last chunk has the
payload's.  The chunks are slices of the batch that the scan hands over: no payload is copied as a
whole, and none is shuffled as one row.  The table is written once; from its last chunks alone (no
data) the revisits are found, and chunk rows are then brought together by row and written in order.
Writers and readers carry running SHA-1 digests from chunk to chunk too; each record is its own gzip
member.  Of records with equal payloads of at least MIN_BYTES bytes, the one with the largest id is a
response and the others revisit it; a revisit keeps the HTTP header, with the payload's length, but
not the payload.

Null payloads are empty.  Rows of a null page_id are left out: a record has an id.  Repeated (page_id,
payload) rows are written each: all are responses where the id is the largest of its payload.  An empty
table gives no archives.  Extra columns are ignored.
"""

from __future__ import annotations

import base64
import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

CHUNK, MIN_BYTES, FILE_BYTES = 256 << 10, 1000, 512 << 20
_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


_CHUNK_ROWS = "row long, record long, chunk_no int, last boolean, url string, total long, sha1 binary, data binary"


def chunk_table(pages: DataFrame, id_column: str = "page_id", payload: str = "html", url: str = "url") -> DataFrame:
    """Chunk rows of all pages, as a written table; row tells records of one id apart, url stands in first chunks."""
    rows = pages.select(F.monotonically_increasing_id().alias("row"), F.col(id_column).cast("long").alias("record"), F.coalesce(F.col(url).cast("string"), F.lit("")).alias("url"), F.encode(F.coalesce(F.col(payload).cast("string"), F.lit("")), "UTF-8").alias("payload")).where("record IS NOT NULL")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in common.slices(batches, "payload"):
            data = b.column("payload")
            wide = pa.types.is_large_binary(data.type)
            _, places, buffer = data.buffers()
            at = np.frombuffer(places, np.int64 if wide else np.int32)[data.offset : data.offset + len(data) + 1].astype(np.int64)
            view = memoryview(buffer) if buffer is not None else memoryview(b"")
            source, number, last, sums, cuts = [], [], [], [], [int(at[0])]
            for k in range(len(data)):
                sha, low, high, n = hashlib.sha1(), int(at[k]), int(at[k + 1]), 0
                while True:
                    end = min(high, low + CHUNK)
                    sha.update(view[low:end])
                    source.append(k)
                    number.append(n)
                    last.append(end == high)
                    sums.append(sha.digest())
                    cuts.append(end)
                    low, n = end, n + 1
                    if end == high:
                        break
            pieces = pa.Array.from_buffers(pa.large_binary() if wide else pa.binary(), len(source), [None, pa.py_buffer(np.array(cuts, np.int64 if wide else np.int32)), buffer if buffer is not None else pa.py_buffer(b"")])
            take = pa.array(source, pa.int64())
            first = pa.array([n == 0 for n in number])
            urls = pc.if_else(first, b.column("url").take(take), pa.scalar(None, b.column("url").type))
            total = pa.array(np.diff(at)[source])
            yield pa.RecordBatch.from_arrays([b.column("row").take(take), b.column("record").take(take), pa.array(number, pa.int32()), pa.array(last), urls, total, pa.array(sums, pa.binary()), pieces], ["row", "record", "chunk_no", "last", "url", "total", "sha1", "data"])

    out = common.in_arrow(rows, run, _CHUNK_ROWS)
    path = common.work_path(pages.sparkSession, "chunks")
    out.write.option("compression", "zstd").parquet(path)  # all payloads once more: packed well
    return pages.sparkSession.read.schema(out.schema).parquet(path)


def plan(chunks: DataFrame) -> DataFrame:
    """row, digest (of the whole payload), refers_to (null: a response), from the last chunks without their data."""
    ends = chunks.where("last").select("row", "record", "total", F.col("sha1").alias("digest"))
    # only digests of several rows go on; a hot digest is one row here after map-side sums
    chosen = ends.where(f"total >= {MIN_BYTES}").groupBy("digest").agg(F.max("record").alias("response"), F.count(F.lit(1)).alias("n")).where("n > 1").select("digest", "response")
    revisits = ends.where(f"total >= {MIN_BYTES}").join(chosen, "digest").where("record <> response").select("row", F.col("response").alias("refers_to"))
    return ends.select("row", "digest").join(revisits, "row", "left")


def ordered(chunks: DataFrame) -> DataFrame:
    """Chunk rows with their records' digests and revisits, each record's together and in order, for `write`."""
    rows = chunks.drop("sha1").repartition(common.partitions(chunks.sparkSession), "row").join(plan(chunks), "row")
    rows = rows.where("refers_to IS NULL OR chunk_no = 0")
    empty = F.col("refers_to").isNotNull()
    return rows.sortWithinPartitions("row", "chunk_no").select(
        "record", "chunk_no", (F.col("last") | empty).alias("last"), "url", "total", F.col("digest").alias("sha1"), "refers_to", F.when(empty, F.lit(b"")).otherwise(F.col("data")).alias("data")
    )


def _urn(record: int) -> str:
    return f"<urn:x-page:{record}>"


def _head(record: int, url: str, total: int, sha1: bytes, refers_to: int | None) -> bytes:
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {total}\r\n\r\n".encode()
    lines = ["WARC/1.1", f"WARC-Type: {'response' if refers_to is None else 'revisit'}", f"WARC-Record-ID: {_urn(record)}", "WARC-Date: 1970-01-01T00:00:00Z", f"WARC-Target-URI: {' '.join(url.split())}"]
    lines += [f"WARC-Payload-Digest: sha1:{base64.b32encode(sha1).decode()}", "Content-Type: application/http; msgtype=response"]
    if refers_to is not None:
        lines += [f"WARC-Refers-To: {_urn(refers_to)}", f"WARC-Profile: {_PROFILE}"]
    lines += [f"Content-Length: {len(http) + (total if refers_to is None else 0)}", "", ""]
    return "\r\n".join(lines).encode() + http


class Archive:
    """Takes chunk rows in order, writes gzip members, starts a new file after FILE_BYTES."""

    def __init__(self, uri: str, file_bytes: int = FILE_BYTES):
        self.uri, self.file_bytes, self.file, self.n, self.records = uri, file_bytes, None, 0, 0
        self.done: list[tuple[str, int, int]] = []

    def chunk(self, record: int, chunk_no: int, last: bool, url: str, total: int, sha1: bytes, refers_to: int | None, data: bytes) -> None:
        if chunk_no == 0:
            self.file = self.file or common.SharedFile(f"{self.uri}-{self.n:04d}.warc.gz")
            self.gzip, self.sha = zlib.compressobj(1, zlib.DEFLATED, 31), hashlib.sha1()
            self.left = total if refers_to is None else 0
            self.file.write(self.gzip.compress(_head(record, url, total, sha1, refers_to)))
        self.sha.update(data)
        self.left -= len(data)
        self.file.write(self.gzip.compress(data))
        if last:
            if self.left or refers_to is None and self.sha.digest() != sha1:
                raise ValueError(f"record {record}: its chunks don't make its payload")
            self.file.write(self.gzip.compress(b"\r\n\r\n") + self.gzip.flush())
            self.records += 1
            if self.file.size >= self.file_bytes:
                self.close()

    def close(self) -> None:
        if self.file:
            self.file.close()
            self.done.append((f"{self.uri}-{self.n:04d}.warc.gz", self.records, self.file.size))
            self.file, self.records = None, 0
            self.n += 1


def write(rows: DataFrame, path: str | None = None) -> DataFrame:
    """Archives of chunk rows; returns uri, records, bytes of each file."""
    spark = rows.sparkSession
    path = path or common.work_path(spark, "warc")
    names = ["record", "chunk_no", "last", "url", "total", "sha1", "refers_to", "data"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        out = Archive(f"{path}/part-{TaskContext.get().partitionId():06d}")
        for b in common.slices(batches, "data"):
            for row in zip(*[b.column(n).to_pylist() for n in names]):
                out.chunk(*row)
        out.close()
        if out.done:
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*out.done)], ["uri", "records", "bytes"])

    found = common.in_arrow(rows.select(*names), run, "uri string, records long, bytes long").collect()  # one row a file
    return common.file_frame(spark, [tuple(r) for r in sorted(found)], "uri string, records long, bytes long")


class _Stream:
    """Lines and runs of bytes out of gzip members, decompressed piece by piece."""

    def __init__(self, f):
        self.f, self.z, self.buf, self.raw = f, zlib.decompressobj(31), bytearray(), b""

    def more(self) -> bool:
        if self.z.eof:
            self.raw, self.z = self.z.unused_data, zlib.decompressobj(31)
        while True:
            self.raw = self.raw or self.f.read(1 << 18)
            if not self.raw:
                return False
            got = self.z.decompress(self.raw, 1 << 18)
            self.raw = self.z.unconsumed_tail
            self.buf += got
            if self.z.eof:
                self.raw, self.z = self.z.unused_data, zlib.decompressobj(31)
            if got:
                return True

    def head(self) -> list[str] | None:
        """Lines up to an empty one; None at the end."""
        at = 0
        while (k := self.buf.find(b"\r\n\r\n", at)) < 0:
            at = max(0, len(self.buf) - 3)
            if not self.more():
                if self.buf.strip():
                    raise ValueError("an archive ends inside a record")
                return None
        lines = bytes(self.buf[:k]).decode().split("\r\n")
        del self.buf[: k + 4]
        return lines

    def run(self, n: int) -> Iterator[bytes]:
        while n:
            if not self.buf and not self.more():
                raise ValueError("an archive ends inside a record")
            part = bytes(self.buf[: min(n, CHUNK)])
            del self.buf[: len(part)]
            n -= len(part)
            yield part


def _number(urn: str | None) -> int | None:
    return None if urn is None else int(urn.strip("<>").rpartition(":")[2])


def read_file(uri: str) -> Iterator[tuple]:
    """(record, chunk_no, last, type, refers_to, total, the digest in its header, digest so far or None, data)."""
    fs, path = common.filesystem(uri)
    with fs.open_input_file(path) as f:
        s = _Stream(f)
        while (lines := s.head()) is not None:
            h = {k.lower(): v for k, _, v in (x.partition(": ") for x in lines[1:])}
            http = s.head()
            left = int(h["content-length"]) - len("\r\n".join(http).encode()) - 4
            total = int(next(x for x in http if x.lower().startswith("content-length: ")).partition(": ")[2])
            kind, record, target = h["warc-type"], _number(h["warc-record-id"]), _number(h.get("warc-refers-to"))
            told = base64.b32decode(h["warc-payload-digest"].partition(":")[2]).hex()
            sha, k, got = hashlib.sha1(), 0, 0
            for part in s.run(left):
                sha.update(part)
                got += len(part)
                yield record, k, got == left, kind, target, total, told, sha.hexdigest() if got == left else None, part
                k += 1
            if not left:
                yield record, 0, True, kind, target, total, told, sha.hexdigest(), b""
            if b"".join(s.run(4)) != b"\r\n\r\n":
                raise ValueError(f"record {record} isn't ended")


def read_chunks(files: DataFrame) -> DataFrame:
    """The record table of archives, payload bytes as chunk rows."""
    names = ["record", "chunk_no", "last", "record_type", "refers_to", "total", "data"]
    kinds = [pa.int64(), pa.int32(), pa.bool_(), pa.string(), pa.int64(), pa.int64(), pa.binary()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows, size = [], 0
        for b in batches:
            for uri in b.column("uri").to_pylist():
                for r in read_file(uri):
                    rows.append((*r[:6], r[8]))
                    size += len(r[8])
                    if size >= 4 << 20:
                        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names)
                        rows, size = [], 0
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names)

    return common.in_arrow(files.select("uri"), run, "record long, chunk_no int, last boolean, record_type string, refers_to long, total long, data binary")


def read_records(files: DataFrame) -> DataFrame:
    """page_id, payload_bytes, payload_digest, record_type, refers_to; responses' digests are those of the bytes read."""
    names = ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"]
    kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for uri in b.column("uri").to_pylist():
                rows, got = [], 0
                for record, _, last, kind, target, total, told, sha, data in read_file(uri):
                    got += len(data)
                    if last:
                        if kind == "response" and (got != total or sha != told):
                            raise ValueError(f"record {record} of {uri} was damaged")
                        rows.append((record, total, told, kind, target))
                        got = 0
                    if len(rows) >= 5000:
                        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names)
                        rows = []
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names)

    return common.in_arrow(files.select("uri"), run, "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long")
