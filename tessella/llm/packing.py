"""Operator 7: hierarchical multi-length packing.

A document's ids go to the shortest tier (context size) that holds them; those over the longest
tier give whole windows first.  In each tier the longest waiting piece opens a window, the gap
is filled with the longest pieces that fit, of this tier and then of shorter ones, and at last
with a cut one, so windows are full.  Only what is left at the end of a partition stays short.
Windows of one tier form step groups of GROUP_TOKENS ids each, so all steps carry the same load.

The packing is local to an input partition: no shuffle, whatever the sizes or keys.
Null texts are empty (one end id).  Repeated rows are packed each, and so are rows of a null doc_id, which
the pieces keep.  An empty table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

from bisect import bisect_right, insort
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

from . import common, tokens

TIERS = (512, 1024, 2048)
GROUP_TOKENS = 32_768
#: Ids that wait for a window in one task at most.
WAITING_TOKENS = 2_000_000

SCHEMA = "doc_id long, start long, length long, ids binary, doc_tokens long, sequence_id long, offset long, tier int, step_group long"


class Packer:
    """Takes documents' ids, returns pieces: (doc_id, start, ids, doc_tokens, sequence_id, offset, tier, step_group)."""

    def __init__(self, first_id: int, tiers: tuple[int, ...] = TIERS, group_tokens: int = GROUP_TOKENS, waiting: int = WAITING_TOKENS):
        self.tiers, self.group_tokens, self.waiting = tiers, group_tokens, waiting
        self.queues: list[list] = [[] for _ in tiers]  # of (length, serial, doc, start, ids, doc_tokens), ascending
        self.sizes = [0] * len(tiers)
        self.serial = 0
        self.next_sequence = self.next_group = first_id
        self.groups: dict[int, list[int]] = {}
        self.out: list[tuple] = []

    def add(self, doc: int, ids: bytes) -> None:
        n, top, at = len(ids) // 4, self.tiers[-1], 0
        while n - at >= top:
            self._emit([(doc, at, ids[4 * at : 4 * (at + top)], n)], top)
            at += top
        if at < n:
            self._queue(doc, at, ids[4 * at :], n)
        if sum(self.sizes) > self.waiting:
            self._pack(final=False)

    def finish(self) -> None:
        self._pack(final=True)

    def _queue(self, doc: int, start: int, ids: bytes, n: int) -> None:
        size = len(ids) // 4
        k = next(i for i, t in enumerate(self.tiers) if size <= t)
        self.serial += 1
        insort(self.queues[k], (size, self.serial, doc, start, ids, n))
        self.sizes[k] += size

    def _take(self, k: int, most: int) -> tuple | None:
        """The longest waiting piece of at most `most` ids in tier k or a shorter one."""
        for j in range(k, -1, -1):
            if i := bisect_right(self.queues[j], (most, 1 << 62)):
                piece = self.queues[j].pop(i - 1)
                self.sizes[j] -= piece[0]
                return piece
        return None

    def _cut(self, k: int, gap: int) -> tuple | None:
        """The first `gap` ids of a waiting piece that is longer; its rest waits on."""
        for j in range(k + 1):
            if self.queues[j]:
                size, _, doc, start, ids, n = self.queues[j].pop()
                self.sizes[j] -= size
                self._queue(doc, start + gap, ids[4 * gap :], n)
                return doc, start, ids[: 4 * gap], n
        return None

    def _pack(self, final: bool) -> None:
        for k in reversed(range(len(self.tiers))):
            tier = self.tiers[k]
            while self.queues[k]:
                if not final and sum(self.sizes[: k + 1]) < 2 * tier:
                    break
                room, pieces = tier, []
                while room:
                    if p := self._take(k, room):
                        pieces.append((p[2], p[3], p[4], p[5]))
                        room -= p[0]
                    elif p := self._cut(k, room):
                        pieces.append(p)
                        room = 0
                    else:
                        break
                self._emit(pieces, tier)

    def _emit(self, pieces: list[tuple], tier: int) -> None:
        size = sum(len(p[2]) // 4 for p in pieces)
        group = self.groups.get(tier)
        if not group or group[1] + size > self.group_tokens:
            group = self.groups[tier] = [self.next_group, 0]
            self.next_group += 1
        group[1] += size
        at = 0
        for doc, start, ids, n in pieces:
            self.out.append((doc, start, len(ids) // 4, ids, n, self.next_sequence, at, tier, group[0]))
            at += len(ids) // 4
        self.next_sequence += 1


def pack_documents(docs: DataFrame, vocabulary: str, end_id: int, tiers: tuple[int, ...] = TIERS) -> DataFrame:
    """A row per piece (SCHEMA); ids are little-endian unsigned 32-bit."""
    end = end_id.to_bytes(4, "little")

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        enc = tokens.encoder(vocabulary)
        packer = Packer(TaskContext.get().partitionId() << 40, tiers)
        names = [x.split()[0] for x in SCHEMA.split(", ")]
        kinds = [pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int64()]

        def out() -> Iterator[pa.RecordBatch]:
            rows, packer.out = packer.out, []
            for at in range(0, len(rows), 2000):
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows[at : at + 2000]), kinds)], names)

        for b in common.slices(batches):
            for doc, ids in zip(b.column("doc_id").to_pylist(), enc.encode(common.texts_of(b))):
                packer.add(doc, ids + end)
            yield from out()
        packer.finish()
        yield from out()

    return common.in_arrow(docs.select("doc_id", "text"), pack, SCHEMA, tokens.KEPT)
