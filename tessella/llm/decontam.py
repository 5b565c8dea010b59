"""Operator 3: benchmark decontamination by q-gram lemma filtering and banded alignment.

Texts are normalised to lower-case letters and digits with single spaces.  A region of a document
within `e` edits of an item of L characters shares at least L - Q + 1 - e*Q of its q-grams, all on
diagonals (document position less item position) at most e apart.  So q-grams shared with an item
are counted in overlapping bands of diagonals, 2e + 1 wide or more, and only bands that reach this
bound are aligned: a banded edit distance of the whole item against the best piece of the region.

The budget is e = floor(RATE * L), less where the bound would fall under one q-gram; items shorter
than Q must occur exactly, between word ends.  Items without letters or digits match nothing.

The benchmark is broadcast in blocks of at most BLOCK_CHARS characters (a longer item is one alone),
each scanned against all documents.  With several blocks the matches of each are written before the
next block is sent and the block is given up, so driver and workers hold one block at a time however
large the benchmark is.

Null and empty texts match nothing.  Repeated rows, and benchmark rows that share an item_id, are each
reported; benchmark rows of a null item_id or text match nothing.  Empty tables give no rows or no
matches.  Extra columns of any name pass through `clean`.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import common

Q, RATE = 10, 0.06
BLOCK_CHARS = 8_000_000
_MIX = np.uint64(0x9E3779B97F4A7C15)
_B = [np.uint64(pow(0x100000001B3, k, 1 << 64)) for k in range(Q + 1)]
_BITS = 20


@cache
def _classes() -> np.ndarray:
    """1 for letters and digits, by code point."""
    return np.fromiter((chr(c).isalnum() for c in range(0x110000)), bool, 0x110000)


def normal(text: str) -> tuple[np.ndarray, np.ndarray]:
    """(code points of the normalised text, their places in text.lower())."""
    raw = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), "<u4")
    word = _classes()[raw]
    keep = word.copy()
    keep[1:] |= word[:-1]  # the first character after a word becomes its space
    at = np.flatnonzero(keep)
    return np.where(word[at], raw[at], np.uint32(32)), at


def grams(codes: np.ndarray) -> np.ndarray:
    """A hash of each run of Q codes."""
    if len(codes) < Q:
        return np.zeros(0, np.uint64)
    h1 = codes.astype(np.uint64)
    h2 = h1[:-1] * _B[1] + h1[1:]
    h4 = h2[:-2] * _B[2] + h2[2:]
    h8 = h4[:-4] * _B[4] + h4[4:]
    return (h8[:-2] * _B[2] + h2[8:]) * _MIX


def budget(n: int) -> tuple[int, int]:
    """(edits, least number of shared q-grams) for an item of n normalised characters."""
    e = int(RATE * n)
    while e and n - Q + 1 - e * Q < 1:
        e -= 1
    return e, n - Q + 1 - e * Q


def aligned(item: np.ndarray, doc: np.ndarray, first: int, last: int, e: int) -> tuple[int, int, int] | None:
    """(edits, start, end) of the best piece of doc for the whole item, starting at places first..last; None over e edits.

    Row i of the table holds the piece ends i + first - e .. i + last + e: a band."""
    lo, width = first - e, last - first + 2 * e + 1
    big = len(item) + len(doc) + 1
    j = lo + np.arange(width)  # piece end for no characters of the item
    cost = np.where((j >= 0) & (j <= len(doc)), 0, big).astype(np.int64)
    start = j.copy()
    ramp = np.arange(width)
    for i, c in enumerate(item.tolist()):
        j = j + 1
        inside = (j >= 1) & (j <= len(doc))
        same = np.zeros(width, bool)
        same[inside] = doc[j[inside] - 1] == c
        best, origin = cost + ~same, start  # substitute or match
        drop = np.append(cost[1:] + 1, big)  # the item's character is missing
        less = drop < best
        best, origin = np.where(less, drop, best), np.where(less, np.append(start[1:], 0), origin)
        best[(j < 0) | (j > len(doc))] = big
        run = best - ramp  # insertions: a running minimum along the row
        low = np.minimum.accumulate(run)
        where = np.maximum.accumulate(np.where(run == low, ramp, 0))
        cost, start = np.minimum(low + ramp, big), origin[where]
        if cost.min() > e:
            return None
    k = int(cost.argmin())
    return (int(cost[k]), int(start[k]), int(j[k])) if cost[k] <= e else None


def exact(item: np.ndarray, doc: np.ndarray, first: int, last: int) -> tuple[int, int, int] | None:
    """The same for no edits at all, by searching bytes."""
    want, have, at = item.tobytes(), doc[first : last + len(item)].tobytes(), -1
    while (at := have.find(want, at + 1)) >= 0:
        if at % 4 == 0:
            return 0, first + at // 4, first + at // 4 + len(item)
    return None


class Benchmark:
    """Items' q-grams, sorted, with a bit table before them."""

    def __init__(self, items: list[tuple[int, str]]):
        self.ids, self.codes, self.short = [], [], []
        for item, text in items:
            codes, _ = normal(text or "")
            while len(codes) and codes[-1] == 32:
                codes = codes[:-1]
            if len(codes) >= Q:
                self.ids.append(item)
                self.codes.append(codes)
            elif len(codes):
                self.short.append((item, "".join(map(chr, codes))))
        #: Item ids by benchmark row: long items, then short ones.
        self.names = [*self.ids, *[item for item, _ in self.short]]
        own = [grams(c) for c in self.codes]
        h = np.concatenate(own) if own else np.zeros(0, np.uint64)
        order = np.argsort(h, kind="stable")
        self.h = h[order]
        self.item = np.repeat(np.arange(len(own)), [len(x) for x in own])[order].astype(np.int64)
        self.pos = np.concatenate([np.arange(len(x)) for x in own])[order].astype(np.int64) if own else np.zeros(0, np.int64)
        self.table = np.zeros(1 << _BITS, bool)
        self.table[self.h >> np.uint64(64 - _BITS)] = True
        self.e, self.least = np.array([budget(len(c)) for c in self.codes], np.int64).reshape(-1, 2).T
        self.length = np.array([len(c) for c in self.codes], np.int64)

    def matches(self, text: str) -> list[tuple[int, int, int, int]]:
        """(item_id, edits, start, end), places in text.lower(); one for each benchmark row that occurs, its best."""
        codes, at = normal(text)
        out: dict[int, tuple[int, int, int]] = {}
        if self.short:
            flat = f" {''.join(map(chr, codes)).strip()} "
            for row, (_, s) in enumerate(self.short, len(self.ids)):
                if (k := flat.find(f" {s} ")) >= 0:
                    out[row] = (0, int(at[k]), int(at[k + len(s) - 1]) + 1)
        g = grams(codes)
        hit = np.flatnonzero(self.table[g >> np.uint64(64 - _BITS)]) if len(g) and len(self.h) else []
        if len(hit):
            a, b = np.searchsorted(self.h, g[hit]), np.searchsorted(self.h, g[hit], "right")
            n = b - a
            if total := int(n.sum()):
                doc_at = np.repeat(hit, n)
                row = np.arange(total) - np.repeat(np.cumsum(n) - n, n) + np.repeat(a, n)
                item = self.item[row]
                # an item with too few hits in the whole document has too few in each band
                enough = (np.bincount(item, minlength=len(self.least)) >= self.least)[item]
                if enough.any():
                    self._bands(codes, at, doc_at[enough], item[enough], self.pos[row[enough]], out)
        return sorted((self.names[row], *found) for row, found in out.items())

    def _bands(self, codes: np.ndarray, at: np.ndarray, doc_at: np.ndarray, item: np.ndarray, pos: np.ndarray, out: dict) -> None:
        shift = len(codes) + 1
        diagonal = doc_at - pos + int(self.length.max())
        half = 2 * self.e[item] + 1  # bands start every half and are two halves wide: any 2e + 1 diagonals lie in one
        band = diagonal // half
        key = np.concatenate([item * (2 * shift + 2 * int(self.length.max())) + band, (item * (2 * shift + 2 * int(self.length.max())) + band - 1)])
        # a q-gram of the item counts once in a band, so repeats in the document don't add up
        gram = key * (int(self.length.max()) + 1) + np.concatenate([pos, pos])
        gram = np.unique(gram)
        keys, count = np.unique(gram // (int(self.length.max()) + 1), return_counts=True)
        size = 2 * shift + 2 * int(self.length.max())
        which = (keys + 1) // size  # band -1 belongs to its own item
        for k in np.flatnonzero(count >= self.least[which]):
            i = int(which[k])
            first = (int(keys[k]) - i * size) * (2 * int(self.e[i]) + 1) - int(self.length.max())
            last, e = first + 2 * (2 * int(self.e[i]) + 1) - 1, int(self.e[i])
            if i in out and not out[i][0]:
                continue
            if found := exact(self.codes[i], codes, max(0, first), last) or aligned(self.codes[i], codes, first, last, e):
                cost, s, t = found
                if i not in out or cost < out[i][0]:
                    out[i] = (cost, int(at[s]), int(at[t - 1]) + 1)


def _blocks(benchmark: DataFrame) -> Iterator[list[tuple[int, str]]]:
    """The items in runs of at most BLOCK_CHARS characters (a longer item makes its own)."""
    rows = benchmark.select(F.col("item_id").cast("long"), F.col("text").cast("string")).where("item_id IS NOT NULL AND text IS NOT NULL")
    block, size = [], 0
    for item, text in rows.toLocalIterator():
        if block and size + len(text) > BLOCK_CHARS:
            yield block
            block, size = [], 0
        block.append((item, text))
        size += len(text)
    if block:
        yield block


_MATCHES = T.ArrayType(T.StructType().add("item_id", "long").add("edits", "integer").add("start", "long").add("end", "long"))


def _scan(docs: DataFrame, sent, into: str) -> DataFrame:
    """docs with a column of the matches of one block (a broadcast variable)."""
    names = docs.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bench = Benchmark(sent.value)
        for b in common.slices(batches):
            found = [bench.matches(t) if t else [] for t in common.texts_of(b)]
            new = pa.array([[{"item_id": i, "edits": e, "start": s, "end": t} for i, e, s, t in x] for x in found], pa.list_(pa.struct([("item_id", pa.int64()), ("edits", pa.int32()), ("start", pa.int64()), ("end", pa.int64())])))
            yield pa.RecordBatch.from_arrays([*[b.column(n) for n in names], new], [*names, into])

    return common.in_arrow(docs, run, T.StructType([*docs.schema.fields]).add(into, _MATCHES))


def matched(docs: DataFrame, benchmark: DataFrame, into: str = "_matches") -> DataFrame:
    """docs with a column of matches: array of (item_id, edits, start, end), empty where the document is clean."""
    sc = docs.sparkSession.sparkContext
    blocks = iter(_blocks(benchmark))
    block, following = next(blocks, []), next(blocks, None)
    if following is None:
        return _scan(docs, sc.broadcast(block), into)
    row = common.fresh("_row", docs.columns)
    rows = common.written(docs.withColumn(row, F.monotonically_increasing_id()), "documents")
    found: DataFrame | None = None
    while block:
        sent = sc.broadcast(block)
        part = common.written(_scan(rows.select(row, "text"), sent, into).where(F.size(into) > 0).select(row, F.explode(into).alias(into)), "matches")
        sent.destroy()
        found = part if found is None else found.union(part)
        block, following = following, next(blocks, None)
    found = found.groupBy(row).agg(F.collect_list(into).alias(into))
    return rows.join(found, row, "left").select(*[F.col(f"`{c}`") for c in docs.columns], F.coalesce(into, F.array().cast(_MATCHES)).alias(into))


def report(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """doc_id, contaminated, n_items, item_ids (ascending), spans (item:start:end:edits)."""
    out = matched(docs.select("doc_id", "text"), benchmark)
    m = F.array_sort("_matches")
    return out.select(
        "doc_id", (F.size("_matches") > 0).alias("contaminated"), F.size("_matches").alias("n_items"), F.transform(m, lambda x: x["item_id"]).alias("item_ids"),
        F.array_join(F.transform(m, lambda x: F.concat_ws(":", x["item_id"], x["start"], x["end"], x["edits"])), ",").alias("spans"),
    )


def clean(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The documents in which no item occurs, all columns."""
    into = common.fresh("_matches", docs.columns)
    return matched(docs, benchmark, into).where(F.size(into) == 0).drop(into)
