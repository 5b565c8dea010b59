"""Operator 1: substring dedup over sliding sentence spans.

A text splits into sentences after . ! ? before white space, and at line ends.  Sentences split into
pieces of at most WINDOW words: of every WINDOW consecutive words of a sentence, one ends a piece after
the word of the smallest checksum (the last one of equals), so that the pieces of a passage depend on
what stands before and after it in its first and last WINDOW - 1 words alone.  From every piece a run starts:
the fewest consecutive pieces, RUN at least, that hold MIN_WORDS words or more.  Any passage of
4 * WINDOW + MIN_WORDS - 2 words (50) or more holds a whole run of its own pieces, whatever surrounds it.
Runs are hashed to 128 bits (two polynomials over the hashes of their lower-case words) and joined over all
documents.  The first
occurrence of a run, by document and place, stays; the pieces covered by any other occurrence go.

Words, pieces and runs of a whole batch of documents are found in numpy arrays, so making the run table is
cheap, and it is made twice, for the counts and for the join, rather than written (which would cost more disk).
Only hashes that occur at least twice are joined back, found by map-side counts, so a run that is in
a third of the documents is one row on its side of the join; the other side is split by adaptive
execution where such a run makes a partition large.

Null and empty texts have no pieces and stay as they are.  Rows with one doc_id are one document
at several places: their equal runs at equal places are all first.  Rows of a null doc_id stay whole.
Extra columns pass through `dedup`; names with
a leading underscore are its own.  White space between kept pieces stays as it was.
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
from .bagminhash import mix

RUN, MIN_WORDS, WINDOW = 3, 20, 8
_U = np.uint64
_BASE = (0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93 | 1)
_SPACE = np.zeros(0x3002, bool)  # no white space beyond U+3000
_SPACE[[c for c in range(0x3001) if chr(c).isspace()]] = True
_KIND = np.zeros(0x3002, np.int8)
_KIND[[ord(c) for c in ".!?…"]] = 1  # ends a sentence
_KIND[[ord(c) for c in "\"')]»”"]] = 2  # may stand behind


@cache
def _powers(which: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of an odd base and of its inverse."""
    base = _BASE[which]
    up, down = np.full(n, base, _U), np.full(n, pow(base, -1, 1 << 64), _U)
    up[0] = down[0] = 1
    return np.multiply.accumulate(up), np.multiply.accumulate(down)


def _spans_hash(x: np.ndarray, starts: np.ndarray, ends: np.ndarray, which: int) -> np.ndarray:
    """A 64-bit hash of x[start:end] for each pair."""
    up, down = _powers(which, 1 << max(16, len(x).bit_length()))
    sums = np.zeros(len(x) + 1, _U)
    np.cumsum((x + _U(1)) * up[: len(x)], out=sums[1:])
    return mix((sums[ends] - sums[starts]) * down[starts] + (ends - starts).astype(_U) * _U(0xD6E8FEB86659FD93))


class Batch:
    """Words and pieces of several texts, as arrays over all of them.

    words of text d are first_word[d] .. first_word[d + 1]; pieces likewise; piece p ends before word ends[p]."""

    def __init__(self, texts: list[str]):
        low = [t.lower() for t in texts]
        flat = "\n".join([*low, ""])
        code = np.frombuffer(flat.encode("utf-32-le", "surrogatepass"), "<u4")
        small = np.minimum(code, np.uint32(0x3001))
        space = _SPACE[small]
        edge = np.diff(np.concatenate([[True], space]).view(np.int8))
        self.start, self.stop = np.flatnonzero(edge == -1), np.flatnonzero(edge == 1)
        self.at = np.cumsum([0, *[len(t) + 1 for t in low]])  # where each text starts
        self.first_word = np.searchsorted(self.start, self.at)
        n = len(self.start)
        self.hash = _spans_hash(code.astype(_U), self.start, self.stop, 0)
        # a word ends its sentence by . ! ? before closing signs, or before a line end
        kind = _KIND[small]
        inner = np.maximum.accumulate(np.where(kind != 2, np.arange(len(code)), -1))[self.stop - 1] if n else self.stop
        last = (inner >= self.start) & (kind[inner] == 1) if n else np.zeros(0, bool)
        lines = np.concatenate([[0], np.cumsum(code == 10)])
        following = np.append(self.start[1:], len(code)) if n else self.start
        last |= lines[following] > lines[self.stop]
        if n >= WINDOW:
            number = np.cumsum(last) - last
            whole = np.flatnonzero(number[WINDOW - 1 :] == number[: 1 - WINDOW])  # windows within a sentence
            if len(whole):
                keys = ((self.hash >> _U(33)).astype(np.int64) << 31) - np.arange(n)  # of equals, the last is the smallest
                least = keys[: 1 - WINDOW].copy()
                for k in range(1, WINDOW):
                    np.minimum(least, keys[k : k + len(least)], out=least)
                last[-least[whole] & (1 << 31) - 1] = True
        self.ends = np.flatnonzero(last) + 1
        self.first_piece = np.searchsorted(self.ends, self.first_word, "right")
        self.lengths = [len(t) for t in low]

    def runs(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(text, first piece, piece after the last) of each run, pieces counted over the batch."""
        n = len(self.ends)
        first = np.arange(n)
        begin = np.concatenate([[0], self.ends[:-1]]) if n else self.ends
        end = np.maximum(first + RUN, np.searchsorted(self.ends, begin + MIN_WORDS) + 1)
        text = np.repeat(np.arange(len(self.first_piece) - 1), np.diff(self.first_piece))
        keep = end <= self.first_piece[1:][text] if n else np.zeros(0, bool)
        return text[keep], first[keep], end[keep]

    def hashes(self, first: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """128 bits of each run of pieces."""
        begin = np.concatenate([[0], self.ends])[first]
        return tuple(_spans_hash(x, begin, self.ends[end - 1], k) for k, x in ((0, self.hash), (1, mix(self.hash ^ _U(0x94D049BB133111EB)))))

    def places(self, d: int, text: str) -> np.ndarray:
        """Where each piece of text d ends in it: white space behind goes with a piece, before the first word with the first."""
        a, b = self.first_word[d], self.first_word[d + 1]
        if len(text) == self.lengths[d]:
            after = np.append(self.start[a + 1 : b], self.at[d] + len(text)) - self.at[d]
        else:  # lower case has another length: read the words of the text itself
            after = np.append(_word_starts(text)[1:], len(text))
        return after[self.ends[self.first_piece[d] : self.first_piece[d + 1]] - a - 1]


def _word_starts(text: str) -> np.ndarray:
    """Starts of the words of one text."""
    space = _SPACE[np.minimum(np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4"), np.uint32(0x3001))]
    return np.flatnonzero(np.diff(np.concatenate([[True], space]).view(np.int8)) == -1)


def run_table(docs: DataFrame) -> DataFrame:
    """doc_id, place (2 * first piece, 1 more if the document has the run before), h1, h2."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in common.slices(batches, rows=2000, size=1 << 20):
            batch = Batch(common.texts_of(b))
            text, first, end = batch.runs()
            h1, h2 = batch.hashes(first, end)
            order = np.argsort(h1, kind="stable")  # of one hash, documents and places ascend
            same = (h1[order[1:]] == h1[order[:-1]]) & (h2[order[1:]] == h2[order[:-1]]) & (text[order[1:]] == text[order[:-1]])
            again = np.zeros(len(h1), bool)
            again[order[1:][same]] = True
            ids = b.column("doc_id").to_numpy()[text]
            place = 2 * (first - batch.first_piece[text]) + again
            yield pa.RecordBatch.from_arrays([pa.array(ids), pa.array(place.astype(np.int32)), pa.array(h1.view(np.int64)), pa.array(h2.view(np.int64))], ["doc_id", "place", "h1", "h2"])

    return common.in_arrow(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").where("doc_id IS NOT NULL"), run, "doc_id long, place int, h1 long, h2 long")


def repeats(docs: DataFrame) -> DataFrame:
    """doc_id, starts (first pieces of its repeated runs), sources (documents that hold them first)."""
    table = run_table(docs)
    first = table.groupBy("h1", "h2").agg(F.min("doc_id").alias("first_doc"), F.count(F.lit(1)).alias("n")).where("n > 1").drop("n")
    first = common.written(first, "repeated")  # so that the join's hot partitions can be split
    hits = table.join(first, ["h1", "h2"]).where("doc_id > first_doc OR place % 2 = 1")
    return hits.groupBy("doc_id").agg(F.collect_set(F.expr("place div 2").cast("int")).alias("starts"), F.array_sort(F.collect_set("first_doc")).alias("sources"))


def _cut(text: str, ends: np.ndarray, covered: np.ndarray) -> tuple[str, list[tuple[int, int]]]:
    """(what stays, removed character ranges) for pieces that end at `ends`."""
    kept, removed, at = [], [], 0
    for end, gone in zip(ends.tolist(), covered.tolist()):
        if not gone:
            kept.append(text[at:end])
        elif removed and removed[-1][1] == at:
            removed[-1] = (removed[-1][0], end)
        else:
            removed.append((at, end))
        at = end
    return "".join(kept) + text[at:], removed


def dedup(docs: DataFrame) -> DataFrame:
    """docs with text cut, and _sentences, _removed (struct start, end; places in the old text), _sources."""
    found = repeats(docs).withColumnsRenamed({"doc_id": "_doc", "starts": "_starts", "sources": "_first"})
    rows = docs.join(found, docs["doc_id"].cast("long") == found["_doc"], "left").drop("_doc")
    names = docs.columns
    spans = T.ArrayType(T.StructType().add("start", "long").add("end", "long"))
    schema = T.StructType([*docs.schema.fields]).add("_sentences", "long").add("_removed", spans).add("_sources", T.ArrayType(T.LongType()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in common.slices(batches, rows=2000, size=1 << 20):
            texts = b.column("text").to_pylist()
            batch = Batch([t or "" for t in texts])
            _, first, end = batch.runs()
            run_at = dict(zip(first.tolist(), end.tolist()))
            gone: list[list[dict]] = []
            for d, starts in enumerate(b.column("_starts").to_pylist()):
                gone.append([])
                if not starts:
                    continue
                base, n = int(batch.first_piece[d]), int(batch.first_piece[d + 1] - batch.first_piece[d])
                step = np.zeros(n + 1, np.int64)
                np.add.at(step, starts, 1)
                np.add.at(step, [run_at[base + s] - base for s in starts], -1)
                texts[d], removed = _cut(texts[d], batch.places(d, texts[d]), np.cumsum(step[:-1]) > 0)
                gone[-1] = [{"start": x, "end": y} for x, y in removed]
            cols = [pa.array(texts, pa.string()) if n == "text" else b.column(n) for n in names]
            sources = [x or [] for x in b.column("_first").to_pylist()]
            more = [pa.array(np.diff(batch.first_piece)), pa.array(gone, pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))), pa.array(sources, pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays([*cols, *more], [*names, "_sentences", "_removed", "_sources"])

    return common.in_arrow(rows, run, schema)


def report(docs: DataFrame) -> DataFrame:
    """doc_id, n_sentences (pieces), n_spans, removed_chars, kept_chars, kept_sha256, spans (start:end), source_docs."""
    out = dedup(docs.select("doc_id", "text"))
    size = F.aggregate("_removed", F.lit(0).cast("long"), lambda a, x: a + x["end"] - x["start"])
    return out.select(
        "doc_id", F.col("_sentences").alias("n_sentences"), F.size("_removed").cast("long").alias("n_spans"), size.alias("removed_chars"), F.length(F.coalesce("text", F.lit(""))).cast("long").alias("kept_chars"),
        F.sha2(F.coalesce("text", F.lit("")), 256).alias("kept_sha256"), F.array_join(F.transform("_removed", lambda x: F.concat_ws(":", x["start"], x["end"])), ",").alias("spans"), F.col("_sources").alias("source_docs"),
    )
