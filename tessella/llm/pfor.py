"""Operator 5: token ids in patched frame-of-reference files.

A file holds blocks of BLOCK ids.  A block is its minimum (u32), bit width (u8), number of
exceptions (u16) and of ids (u16), the low `width` bits of each id less the minimum, and the
exceptions as positions (u8) and whole differences (u32).  The width is the one of PERCENTILES
of the block's bit lengths that makes the block smallest.  After the blocks come the documents'
ids and lengths, the blocks' start offsets, and a footer that gives their sizes.

Null texts are empty (only the end id).  Rows may repeat: equal ids follow each other, by text hash.
Rows of a null doc_id have no place in the order and are left out.  Extra columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common, tokens

BLOCK, MAGIC = 256, b"PFORIDS1"
PERCENTILES = (50, 75, 88, 94, 97, 99, 100)
FOOTER = struct.Struct("<QQQ8s")
_HEAD = np.dtype([("low", "<u4"), ("width", "u1"), ("exceptions", "<u2"), ("n", "<u2")])


_LENGTHS = np.frexp(np.arange(1 << 16, dtype=np.float64))[1].astype(np.uint8)


def _bits(x: np.ndarray) -> np.ndarray:
    """Bit lengths of unsigned 32-bit numbers (longer ones are exact in a double's exponent)."""
    if x.size and x.max() < 1 << 16:
        return _LENGTHS[x]
    return np.frexp(x.astype(np.float64))[1].astype(np.uint8)


def _pack_low(own: np.ndarray, w: int) -> np.ndarray:
    """The low w bits (1 to 16) of each number by row; eight numbers are w bytes, in two 64-bit words."""
    x = (own & np.uint32((1 << w) - 1)).astype(np.uint64)
    x = x[:, ::2] | x[:, 1::2] << np.uint64(w)
    x = x[:, ::2] | x[:, 1::2] << np.uint64(2 * w)
    low, high = x[:, ::2], x[:, 1::2]
    words = np.empty((*low.shape, 2), "<u8")
    if w == 16:
        words[..., 0], words[..., 1] = low, high
    else:
        words[..., 0], words[..., 1] = low | high << np.uint64(4 * w), high >> np.uint64(64 - 4 * w)
    return words.view(np.uint8).reshape(len(own), -1, 16)[:, :, :w].reshape(len(own), -1)


def _unpack_low(body: np.ndarray, w: int) -> np.ndarray:
    """What _pack_low packed, by row."""
    eights = np.zeros((len(body), body.shape[1] // w, 16), np.uint8)
    eights[:, :, :w] = body.reshape(len(body), -1, w)
    words = eights.view("<u8").astype(np.uint64)
    halves = np.empty_like(words)
    if w == 16:
        halves[:] = words
    else:
        halves[..., 0], halves[..., 1] = words[..., 0], words[..., 0] >> np.uint64(4 * w) | words[..., 1] << np.uint64(64 - 4 * w)
    out, mask = np.empty((*halves.shape, 4), np.uint32), np.uint64((1 << w) - 1)
    for k in range(4):
        out[..., k] = halves >> np.uint64(k * w) & mask
    return out.reshape(len(body), -1)


def pack_blocks(ids: np.ndarray) -> list[bytes]:
    """Each block of BLOCK ids (the last may be shorter) as bytes."""
    if not len(ids):
        return []
    n = -(-len(ids) // BLOCK)
    full = np.empty(n * BLOCK, np.uint32)
    full[: len(ids)], full[len(ids) :] = ids, ids[-1]
    full = full.reshape(n, BLOCK)
    low = full.min(1)
    diff = full - low[:, None]
    bits = _bits(diff)
    shorter = np.cumsum(np.bincount((np.arange(n)[:, None] * 33 + bits).reshape(-1), minlength=33 * n).reshape(n, 33), 1)  # ids of at most so many bits
    cost, width = None, None
    for p in PERCENTILES:
        w = (shorter < -(-p * BLOCK // 100)).sum(1)
        c = w * (BLOCK // 8) + 5 * (BLOCK - shorter[np.arange(n), w])
        cost, width = (c, w) if cost is None else (np.minimum(cost, c), np.where(c < cost, w, width))
    out: list[bytes] = [b""] * n
    above = bits > width[:, None]
    for w in np.unique(width).tolist():
        rows = np.flatnonzero(width == w)
        if 0 < w <= 16:
            body = _pack_low(diff[rows], w)
        else:
            planes = np.unpackbits(diff[rows].astype("<u4").view(np.uint8).reshape(len(rows), BLOCK, -1), axis=2, bitorder="little")[:, :, :w]
            body = np.packbits(planes.reshape(len(rows), BLOCK * w), axis=1, bitorder="little")
        body, own = body.tobytes(), above[rows]
        at, patch, end = np.nonzero(own)[1].astype(np.uint8).tobytes(), diff[rows][own].astype("<u4").tobytes(), 0
        size = BLOCK * w // 8
        for k, (r, first, many) in enumerate(zip(rows.tolist(), low[rows].tolist(), np.count_nonzero(own, axis=1).tolist())):
            head = struct.pack("<IBHH", first, w, many, BLOCK if r < n - 1 else len(ids) - (n - 1) * BLOCK)
            start, end = end, end + many
            out[r] = head + body[k * size : (k + 1) * size] + at[start:end] + patch[4 * start : 4 * end]
    return out


def unpack_blocks(data: bytes, starts: np.ndarray) -> np.ndarray:
    """The ids of blocks that start at these offsets of data."""
    if not len(starts):
        return np.zeros(0, np.uint32)
    raw = np.frombuffer(data, np.uint8)
    head = raw[starts[:, None] + np.arange(_HEAD.itemsize)].reshape(-1).view(_HEAD)
    out = np.empty((len(starts), BLOCK), np.uint32)
    for w in np.unique(head["width"]):
        rows, size = np.flatnonzero(head["width"] == w), BLOCK * int(w) // 8
        if 0 < w <= 16:
            out[rows] = _unpack_low(raw[(starts[rows] + _HEAD.itemsize)[:, None] + np.arange(size)], int(w))
        elif w:
            body = raw[(starts[rows] + _HEAD.itemsize)[:, None] + np.arange(size)]
            planes = np.unpackbits(body, axis=1, bitorder="little").reshape(len(rows), BLOCK, int(w))
            full = np.zeros((len(rows), BLOCK, 32), np.uint8)
            full[:, :, : int(w)] = planes
            out[rows] = np.packbits(full, axis=2, bitorder="little").view("<u4")[:, :, 0]
        else:
            out[rows] = 0
    for r in np.flatnonzero(head["exceptions"]):
        k = int(head["exceptions"][r])
        at = int(starts[r]) + _HEAD.itemsize + BLOCK * int(head["width"][r]) // 8
        out[r, raw[at : at + k]] = np.frombuffer(data, "<u4", k, at + k)
    out += head["low"][:, None]
    return np.concatenate([out[:-1].reshape(-1), out[-1, : head["n"][-1]]])


class Writer:
    """Streams documents' ids into one file."""

    def __init__(self, uri: str):
        self.file, self.rest, self.held = common.SharedFile(uri), [], 0
        self.docs: list[int] = []
        self.lengths: list[int] = []
        self.starts: list[int] = []
        self.file.write(MAGIC)

    def add(self, doc: int, ids: bytes) -> None:
        self.docs.append(doc)
        self.lengths.append(len(ids) // 4)
        self.rest.append(ids)
        self.held += len(ids)
        if self.held >= 4 << 20:
            self._flush(False)

    def _flush(self, last: bool) -> None:
        ids = np.frombuffer(b"".join(self.rest), "<u4")
        n = len(ids) if last else len(ids) // BLOCK * BLOCK
        for at in range(0, n, 256 * BLOCK):
            for b in pack_blocks(ids[at : min(n, at + 256 * BLOCK)]):
                self.starts.append(self.file.size)
                self.file.write(b)
        self.rest = [ids[n:].tobytes()]
        self.held = len(self.rest[0])

    def close(self) -> tuple[int, int]:
        self._flush(True)
        end = self.file.size
        self.file.write(np.array(self.docs, "<i8").tobytes() + np.array(self.lengths, "<i8").tobytes() + np.array(self.starts, "<u8").tobytes())
        self.file.write(FOOTER.pack(end, len(self.docs), len(self.starts), MAGIC))
        self.file.close()
        return len(self.docs), sum(self.lengths)


def read_file(uri: str, blocks: int = 2048) -> Iterator[tuple[int, int, int, bytes, bool]]:
    """(doc_id, ids of the file before the document, its ids, a run of them, whether the last run)."""
    fs, path = common.filesystem(uri)
    with fs.open_input_file(path) as f:
        f.seek(f.size() - FOOTER.size)
        end, n_docs, n_blocks, magic = FOOTER.unpack(f.read(FOOTER.size))
        if magic != MAGIC:
            raise ValueError(f"{uri} isn't a file of this format")
        f.seek(end)
        docs = np.frombuffer(f.read(8 * n_docs), "<i8")
        lengths = np.frombuffer(f.read(8 * n_docs), "<i8")
        starts = np.append(np.frombuffer(f.read(8 * n_blocks), "<u8"), end).astype(np.int64)
        have, at = np.zeros(0, np.uint32), 0
        k = 0
        for doc, n in zip(docs.tolist(), lengths.tolist()):
            left, first = n, at
            while True:
                take = min(left, len(have))
                left -= take
                yield doc, first, n, have[:take].astype("<u4").tobytes(), left == 0
                have = have[take:]
                if not left:
                    break
                f.seek(int(starts[k]))
                to = min(n_blocks, k + blocks)
                have = unpack_blocks(f.read(int(starts[to] - starts[k])), starts[k:to] - starts[k])
                k = to
            at += n


def write_tokens(docs: DataFrame, vocabulary: str, end_id: int, path: str | None = None) -> DataFrame:
    """Writes documents' ids in ascending doc_id order; returns the files: uri, base (ids before it), documents, ids."""
    spark = docs.sparkSession
    path = path or common.work_path(spark, "tokens")
    end = np.array([end_id], "<u4").tobytes()

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        shard, out = TaskContext.get().partitionId(), None
        uri = f"{path}/shard-{shard:06d}.pfor"
        enc = tokens.encoder(vocabulary)
        for b in common.slices(batches):
            out = out or Writer(uri)
            for doc, ids in zip(b.column("doc_id").to_pylist(), enc.encode(common.texts_of(b))):
                out.add(doc, ids + end)
        if out:
            n, total = out.close()
            yield pa.RecordBatch.from_pydict({"shard": [shard], "uri": [uri], "documents": [n], "ids": [total]}, schema=pa.schema([("shard", pa.int32()), ("uri", pa.string()), ("documents", pa.int64()), ("ids", pa.int64())]))

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"), F.xxhash64("text").alias("h"))
    rows = rows.where("doc_id IS NOT NULL").repartitionByRange(common.partitions(spark), "doc_id", "h").sortWithinPartitions("doc_id", "h").select("doc_id", "text")
    found = sorted(common.in_arrow(rows, write, "shard int, uri string, documents long, ids long", tokens.KEPT).collect())  # one row a file
    base, files = 0, []
    for r in found:
        files.append((r.uri, base, r.documents, r.ids))
        base += r.ids
    return common.file_frame(spark, files, "uri string, base long, documents long, ids long")


def read_tokens(files: DataFrame) -> DataFrame:
    """A row per document, read from the files: doc_id, start, n_tokens, ids_crc32."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64()), ("ids_crc32", pa.int64())])
        for b in batches:
            for uri, base in zip(b.column("uri").to_pylist(), b.column("base").to_pylist()):
                rows, crc = [], 0
                for doc, first, n, ids, last in read_file(uri):
                    crc = zlib.crc32(ids, crc)
                    if last:
                        rows.append((doc, base + first, n, crc))
                        crc = 0
                    if len(rows) >= 10_000:
                        yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*rows)], schema=schema)
                        rows = []
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*rows)], schema=schema)

    return common.in_arrow(files, read, "doc_id long, start long, n_tokens long, ids_crc32 long")
