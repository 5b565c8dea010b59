"""Operator 9: near-duplicates by BagMinHash over multisets of five-word shingles.

A shingle of weight w takes part with the levels 0 to w of a weight axis that is cut into dyadic
blocks [0, 1), [1, 2), [2, 4), [4, 8) ...  Each block of each shingle has its own Poisson process,
of a rate equal to its width, that deals points to registers at random; a block that the weight
fills only partly keeps the points below the weight.  A register's value is the time of its first
point, so two documents agree in it with the probability of their weighted Jaccard similarity, and
a shingle costs as many blocks as its weight has bits.  Points after a document's time bound are
never made; the few documents with a register still empty then go on with a larger bound.

Equal normalised texts are one class representative before any signature is made.  Registers are
banded; in a bucket each document meets the bucket's smallest one, and pairs are verified on their
whole shingle multisets.  What a bucket's smallest member doesn't settle (buckets whose documents
are in several components yet) is settled block by block: a bucket is dealt into lots of about LOT
documents, each pair of lots goes to one task, and the task computes there all similarities between
different components that the metric 1 - similarity leaves open, each pair in the first band that it
shares.  No pair is ever a row; a block gives the links of a spanning forest.  So the rows that move
grow with n * n / LOT in a bucket of n documents of several components, and nothing is left out.
Components are found by label propagation over written tables.

Texts are lower case; words are runs of letters, digits and marks other than white space.  Texts
of one to four words are one shingle.  Null texts and texts without words are each their own class.
Extra columns are ignored.  Rows of one doc_id keep a row each; where their texts
differ, a copy of another document's text counts as such, else the text of the smallest hash stands for the doc_id.  Rows of a null doc_id are left out.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

SHINGLE, SIMILAR = 5, 0.8
BANDS, ROWS = 28, 6
REGISTERS = BANDS * ROWS
#: Documents of a bucket that one task compares with as many others at most, about.
LOT = 200
_U = np.uint64
_WORD_B = pow(0x9E3779B97F4A7C15 | 1, 1, 1 << 64)


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


@cache
def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of an odd base and of its inverse."""
    b, inverse = _U(_WORD_B), _U(pow(_WORD_B, -1, 1 << 64))
    up, down = np.full(n, b, _U), np.full(n, inverse, _U)
    up[0] = down[0] = 1
    return np.multiply.accumulate(up), np.multiply.accumulate(down)


_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 28, 29, 30, 31, 32]] = True


def word_hashes(text: str) -> np.ndarray:
    """A hash of each word, in order."""
    raw = np.frombuffer(" ".join(text.lower().split()).encode("utf-8", "surrogatepass") if not text.isascii() else text.lower().encode(), np.uint8)
    if not len(raw):
        return np.zeros(0, _U)
    space = _SPACE[raw]
    edge = np.diff(np.concatenate([[True], space, [True]]).view(np.int8))
    starts, ends = np.flatnonzero(edge == -1), np.flatnonzero(edge == 1)
    size = 1 << max(12, int(len(raw)).bit_length())
    up, down = _powers(size)
    sums = np.zeros(len(raw) + 1, _U)
    np.cumsum((raw.astype(_U) + _U(1)) * up[: len(raw)], out=sums[1:])
    return mix((sums[ends] - sums[starts]) * down[starts] + (ends - starts).astype(_U) * _U(0xD6E8FEB86659FD93))


def shingles(words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(hashes, weights) of a document's shingle multiset, hashes ascending."""
    if not len(words):
        return np.zeros(0, _U), np.zeros(0, np.int64)
    n = min(SHINGLE, len(words))
    h = words[: len(words) - n + 1].copy()
    for k in range(1, n):
        h = h * _U(0x2545F4914F6CDD1D) + words[k : len(words) - n + 1 + k]
    return np.unique(mix(h + _U(n)), return_counts=True)


def blocks(h: np.ndarray, w: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(block hash, block width, accepted width, place in h) of each dyadic block that a weight reaches."""
    at, low, k = np.arange(len(h)), 1, 1
    out = [(mix(h ^ _U(0xA0761D6478BD642F)), np.ones(len(h)), np.ones(len(h)), at)]
    while len(at := at[w[at] > low]):
        salt = _U(0xA0761D6478BD642F ^ (k * 0xE7037ED1A0B428DB & (1 << 64) - 1))
        out.append((mix(h[at] ^ salt), np.full(len(at), float(low)), np.minimum(w[at] - low, low).astype(float), at))
        low, k = 2 * low, k + 1
    return tuple(np.concatenate(x) for x in zip(*out))


def _uniform(x: np.ndarray) -> np.ndarray:
    return ((x >> _U(11)).astype(np.float64) + 0.5) * 2.0**-53


def signatures_of(bags: list[tuple[np.ndarray, np.ndarray]], m: int = REGISTERS) -> np.ndarray:
    """m unsigned 64-bit register values for each multiset (the bits of first times, mixed); equal multisets give equal ones."""
    todo = np.arange(len(bags))
    out = np.zeros((len(bags), m), _U)
    slack = 1.0
    while len(todo):
        sizes = [len(bags[k][0]) for k in todo]
        total = np.array([float(bags[k][1].sum()) for k in todo])
        bound = slack * m / total * (np.log(m) + 3)
        doc = np.repeat(np.arange(len(todo)), sizes)
        h, w = np.concatenate([bags[k][0] for k in todo]), np.concatenate([bags[k][1] for k in todo])
        seed, rate, take, owner = blocks(h, w)
        doc = doc[owner]
        limit = bound[doc]
        sig = np.full(len(todo) * m, np.inf)
        t = np.zeros(len(seed))
        step = _U(0)
        while len(seed):
            step += _U(1)
            r = mix(seed + np.multiply(step, _U(0x8EBC6AF09C88C6E3)))
            t = t - np.log(_uniform(r)) / rate
            live = np.flatnonzero(t <= limit)
            seed, rate, take, doc, limit, t = seed[live], rate[live], take[live], doc[live], limit[live], t[live]
            r = mix(r[live] ^ _U(0x589965CC75374CC3))
            at, when = doc * m + (r % _U(m)).astype(np.int64), t
            if len(cut := np.flatnonzero(take < rate)):
                keep = np.ones(len(t), bool)
                keep[cut] = _uniform(mix(r[cut] + _U(1))) * rate[cut] < take[cut]
                at, when = at[keep], t[keep]
            np.minimum.at(sig, at, when)
        sig = sig.reshape(-1, m)
        full = np.isfinite(sig).all(1)
        out[todo[full]] = mix(sig[full].view(_U))
        todo = todo[~full]
        slack *= 2
    return out


def signature(h: np.ndarray, w: np.ndarray, m: int = REGISTERS) -> np.ndarray:
    return signatures_of([(h, w)], m)[0]


def similarity(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> float:
    """Weighted Jaccard of two multisets."""
    if not len(a[0]) or not len(b[0]):
        return 0.0
    both, i, j = np.intersect1d(a[0], b[0], assume_unique=True, return_indices=True)
    low = int(np.minimum(a[1][i], b[1][j]).sum())
    return low / (int(a[1].sum()) + int(b[1].sum()) - low)


def read_documents(docs: DataFrame) -> DataFrame:
    """doc, th (a hash of the text), ka, kb (128 bits of the word sequence), bands (BANDS hashes).

    Documents without words have null keys and no bands; rows of a null doc_id are left out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in common.slices(batches, rows=500, size=2 << 20):
            words = [word_hashes(t) for t in common.texts_of(b)]
            bags = [shingles(w) for w in words]
            some = [k for k, w in enumerate(words) if len(w)]
            keys = [xxhash.xxh3_128_digest(w.tobytes()) if len(w) else None for w in words]
            bands: list[np.ndarray | None] = [None] * len(words)
            if some:
                s = signatures_of([bags[k] for k in some])
                key = np.zeros((len(some), BANDS), _U)
                for k in range(ROWS):
                    key = mix(key * _U(0x2545F4914F6CDD1D) + s[:, k : BANDS * ROWS : ROWS])
                for n, k in enumerate(some):
                    bands[k] = key[n].view(np.int64)
            ints = [(None, None) if k is None else struct.unpack("<qq", k) for k in keys]
            cols = [b.column("doc"), b.column("th"), pa.array([a for a, _ in ints], pa.int64()), pa.array([c for _, c in ints], pa.int64()), pa.array(bands, pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays(cols, ["doc", "th", "ka", "kb", "bands"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc"), "text", F.xxhash64(F.coalesce("text", F.lit(""))).alias("th")).where("doc IS NOT NULL")
    return common.in_arrow(rows, run, "doc long, th long, ka long, kb long, bands array<long>")


#: Has Spark sift the larger side of a join by a Bloom filter of the smaller one, of 4 MB, before the shuffle;
#: used for up to SIFTED_DOCUMENTS documents, beyond which such a filter lets nearly all through.
SIFTED_DOCUMENTS = 4_000_000
_SIFTED = {
    "spark.sql.optimizer.runtime.bloomFilter.enabled": "true", "spark.sql.optimizer.runtime.bloomFilter.applicationSideScanSizeThreshold": "0", "spark.sql.optimizer.runtime.bloomFilter.creationSideThreshold": "10g",
    "spark.sql.optimizer.runtime.bloomFilter.expectedNumItems": "4000000", "spark.sql.optimizer.runtime.bloomFilter.numBits": "33554432",
}


def texts_among(texts: DataFrame, used: DataFrame) -> DataFrame:
    """The texts of the documents in `used` (doc), a row each, as a table; other texts hardly reach the shuffle."""
    spark = texts.sparkSession
    if used.count() > SIFTED_DOCUMENTS:
        return common.written(texts.join(used, "doc", "left_semi"), "texts").groupBy("doc").agg(F.min_by("text", F.xxhash64("text")).alias("text"))
    before = {k: spark.conf.get(k) for k in _SIFTED}
    try:
        for k, x in _SIFTED.items():
            spark.conf.set(k, x)
        # the filter is made only where a side has a condition; this one is true of all
        found = common.written(texts.join(used.where(F.col("doc") > F.lit(-(2**63)).cast("long")), "doc", "left_semi"), "texts")
    finally:
        for k, x in before.items():
            spark.conf.set(k, x)
    return found.groupBy("doc").agg(F.min_by("text", F.xxhash64("text")).alias("text"))


def verified(pairs: DataFrame, texts: DataFrame, share: int = 2000) -> DataFrame:
    """a, b, j: weighted Jaccard of each pair, computed on whole multisets.

    Pairs are gathered by `a` in shares of about `share` partners, each with one copy of a's text, so
    a document with very many partners is worked on by many tasks."""
    partners = pairs.groupBy("a").agg(F.count(F.lit(1)).alias("n")).where(f"n > {share}")
    pairs = pairs.join(partners, "a", "left").withColumn("lot", F.when(F.col("n").isNull(), 0).otherwise(F.pmod(F.xxhash64("b"), F.ceil(F.col("n") / share))).cast("int"))
    pairs = common.written(pairs.select("a", "b", "lot"), "pairs")
    t = texts.select("doc", "text")
    used = common.written(pairs.select(F.col("a").alias("doc")).union(pairs.select("b")).distinct(), "used")
    t = texts_among(t, used)
    heads = pairs.select("a", "lot").distinct().join(t.withColumnRenamed("doc", "a"), "a").select("a", "lot", F.lit(None).cast("long").alias("b"), "text")
    rest = pairs.select("a", "lot", "b").join(t.withColumnRenamed("doc", "b"), "b").select("a", "lot", "b", "text")
    rows = heads.union(rest).repartition(common.partitions(texts.sparkSession), "a", "lot").sortWithinPartitions("a", "lot", F.asc_nulls_first("b"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        head = None
        for batch in common.slices(batches):
            one, two, j = [], [], []
            for a, b, text in zip(batch.column("a").to_pylist(), batch.column("b").to_pylist(), common.texts_of(batch)):
                bag = shingles(word_hashes(text))
                if b is None:
                    head = bag
                else:
                    one.append(a)
                    two.append(b)
                    j.append(similarity(head, bag))
            yield pa.RecordBatch.from_arrays([pa.array(one, pa.int64()), pa.array(two, pa.int64()), pa.array(j, pa.float64())], ["a", "b", "j"])

    return common.in_arrow(rows.select("a", "b", "text"), run, "a long, b long, j double")


def _items(bags: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    """(number of an item, its multiset) for items that several multisets have; a shingle of weight w is w items."""
    h = np.concatenate([np.repeat(h, w) for h, w in bags])
    owner = np.repeat(np.arange(len(bags)), [int(w.sum()) for _, w in bags])
    level = np.concatenate([np.arange(int(w.sum())) - np.repeat(np.cumsum(w) - w, w) for _, w in bags]).astype(_U)
    _, number, n = np.unique(mix(h + level * _U(0xE7037ED1A0B428DB)), return_inverse=True, return_counts=True)
    keep = n[number] > 1
    _, number = np.unique(number[keep], return_inverse=True)
    return number, owner[keep]


def similarities(bags: list[tuple[np.ndarray, np.ndarray]], wanted: np.ndarray, width: int = 4096) -> np.ndarray:
    """Weighted Jaccard of the wanted pairs (a matrix of Booleans), 0 elsewhere."""
    n = len(bags)
    total = np.array([float(w.sum()) for _, w in bags])
    both = np.zeros((n, n))
    number, owner = _items(bags)
    columns = int(number.max()) + 1 if len(number) else 0
    if wanted.sum() * 70e-6 < n * n * columns * 1e-10:  # few pairs: one by one
        for i, j in np.argwhere(wanted).tolist():
            both[i, j] = np.minimum(*_aligned(bags[i], bags[j])).sum()
    else:
        order = np.argsort(number, kind="stable")
        number, owner = number[order], owner[order]
        for low in range(0, columns, width):
            a, b = np.searchsorted(number, [low, low + width])
            x = np.zeros((n, width), np.float32)
            x[owner[a:b], number[a:b] - low] = 1
            both += x @ x.T  # counts below 2**24 are exact
    return np.where(wanted, both / np.maximum(total[:, None] + total[None, :] - both, 1.0), 0.0)


def _aligned(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    _, i, j = np.intersect1d(a[0], b[0], assume_unique=True, return_indices=True)
    return a[1][i], b[1][j]


def _forest(links: np.ndarray, comp: list[int]) -> list[int]:
    """Of links (rows of two places), those that join components that none before joined."""
    root: dict[int, int] = {}

    def find(x: int) -> int:
        while (y := root.get(x, x)) != x:
            root[x] = root.get(y, y)
            x = y
        return x

    out = []
    for k, (i, j) in enumerate(links.tolist()):
        a, b = find(comp[i]), find(comp[j])
        if a != b:
            root[max(a, b)] = min(a, b)
            out.append(k)
    return out


def block_links(band: int, same_lot: bool, docs: list[int], lots: np.ndarray, comp: np.ndarray, j: np.ndarray, bands: np.ndarray, texts: list[str]) -> list[tuple[int, int]]:
    """Links between different components of one block's documents: within a lot, or between its two lots."""
    wanted = comp[:, None] < comp[None, :]
    wanted = wanted | wanted.T
    wanted &= np.abs(j[:, None] - j[None, :]) <= 1 - SIMILAR + 1e-9
    wanted &= np.triu(np.ones_like(wanted), 1) if same_lot else lots[:, None] < lots[None, :]
    for k in range(band):  # met before
        wanted &= bands[:, k][:, None] != bands[:, k][None, :]
    used = np.flatnonzero(wanted.any(0) | wanted.any(1))
    if not len(used):
        return []
    bags = [shingles(word_hashes(texts[k])) for k in used]
    at = np.argwhere(similarities(bags, wanted[np.ix_(used, used)]) >= SIMILAR)
    pairs = used[at]
    return [(docs[pairs[k, 0]], docs[pairs[k, 1]]) for k in _forest(pairs, comp.tolist())]


def settled(open_: DataFrame, sigs: DataFrame, texts: DataFrame) -> DataFrame:
    """Links (a, b) between components in buckets: rows band, h, doc, comp, j (to the bucket's hub), n (its size)."""
    lots = F.ceil(F.col("n") / LOT).cast("int")
    rows = open_.withColumn("lots", lots).withColumn("lot", F.pmod(F.xxhash64("doc"), F.col("lots")).cast("int"))
    rows = rows.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("lots") - 1)))
    rows = rows.select("band", "h", F.least("lot", "other").alias("x"), F.greatest("lot", "other").alias("y"), "lot", "doc", "comp", "j")
    used = common.written(open_.select("doc").distinct(), "used")
    found = texts_among(texts.select("doc", "text"), used).join(sigs.select("doc", "bands"), "doc")
    rows = rows.join(common.written(found, "texts"), "doc").repartition(common.partitions(texts.sparkSession), "band", "h", "x", "y").sortWithinPartitions("band", "h", "x", "y")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, group = None, []

        def links() -> pa.RecordBatch:
            found = []
            if len(group) > 1:
                docs, lots, comp, j, bands, texts_ = zip(*group)
                found = block_links(key[0], key[2] == key[3], docs, np.array(lots), np.array(comp), np.array(j), np.array(bands), texts_)
            return pa.RecordBatch.from_arrays([pa.array([p[k] for p in found], pa.int64()) for k in (0, 1)], ["a", "b"])

        for batch in common.slices(batches):
            columns = [batch.column(c).to_pylist() for c in ("band", "h", "x", "y", "lot", "doc", "comp", "j", "bands", "text")]
            for band, h, x, y, lot, doc, comp, j, bands, text in zip(*columns):
                if (band, h, x, y) != key:
                    yield links()
                    key, group = (band, h, x, y), []
                group.append((doc, lot, comp, j, bands, text or ""))
        yield links()

    return common.in_arrow(rows.select("band", "h", "x", "y", "lot", "doc", "comp", "j", "bands", "text"), run, "a long, b long")


def components(edges: DataFrame, name: str = "labels", rounds: int = 60) -> DataFrame:
    """(doc, comp) of all documents in edges (a, b); comp is the smallest document.

    Alternates large-star and small-star steps over written tables until nothing changes."""
    e = common.written(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct(), name)
    for _ in range(rounds):
        both = e.select("u", "v").union(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("u", "m"))
        # large star: each node's larger neighbours point at its smallest one
        large = both.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        # small star: a node and its smaller neighbours point at the smallest of them
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select(F.explode(F.array(F.struct(F.col("u"), F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("x")).select("x.u", "x.v").where("u <> v").distinct()
        new = common.written(small, name)
        # a star forest: no node that is pointed at points on, and each node points once
        open_ = new.groupBy("u").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("u").union(new.select("u").join(new.select(F.col("v").alias("u")), "u", "left_semi"))
        e = new
        if open_.isEmpty():
            break
    else:
        raise RuntimeError("components did not settle")
    return e.select(F.col("u").alias("doc"), F.col("v").alias("comp")).union(e.select(F.col("v").alias("doc"), F.col("v").alias("comp")).distinct())


def near_classes(docs: DataFrame) -> DataFrame:
    """doc_id, class_id: the smallest doc_id of its component of similarity SIMILAR or more."""
    read = common.written(read_documents(docs), "signatures")
    # of equal texts the smallest doc_id stands for all; only groups of several meet their members again
    groups = read.where("ka IS NOT NULL").groupBy("ka", "kb").agg(F.min("doc").alias("rep"), F.count(F.lit(1)).alias("n")).where("n > 1").select("ka", "kb", "rep")
    groups = common.written(groups, "copies")
    copies = common.written(read.select("doc", "ka", "kb").join(groups, ["ka", "kb"]).where("doc <> rep").groupBy("doc").agg(F.min("rep").alias("rep")), "copies")
    sigs = read.where("ka IS NOT NULL").join(copies, "doc", "left_anti")
    sigs = common.written(sigs.groupBy("doc").agg(F.min_by("bands", "th").alias("bands")), "signatures")
    texts = docs.select(F.col("doc_id").cast("long").alias("doc"), F.coalesce("text", F.lit("")).alias("text"))
    buckets = sigs.select("doc", F.posexplode("bands").alias("band", "h"))
    hubs = common.written(buckets.groupBy("band", "h").agg(F.min("doc").alias("hub"), F.count(F.lit(1)).alias("n")).where("n > 1"), "hubs")
    placed = common.written(buckets.join(hubs, ["band", "h"]), "buckets")
    # each document with the smallest one of its bucket
    star = placed.where("doc <> hub").select(F.col("hub").alias("a"), F.col("doc").alias("b")).distinct()
    scored = common.written(verified(star, texts), "scored")
    first = common.written(components(scored.where(F.col("j") >= SIMILAR).select("a", "b")), "components")
    # buckets whose documents are in several components: pairs across them that the metric leaves open
    known = scored.select(F.col("a").alias("hub"), F.col("b").alias("doc"), "j")
    state = placed.join(first, "doc", "left").withColumn("comp", F.coalesce("comp", "doc")).join(known, ["hub", "doc"], "left").withColumn("j", F.coalesce("j", F.lit(1.0)))
    state = common.written(state, "state")
    split = state.groupBy("band", "h").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi")).where("lo <> hi").select("band", "h")
    open_ = common.written(state.join(split, ["band", "h"]).where("doc <> hub").select("band", "h", "doc", "comp", "j", "n"), "open")
    if not open_.isEmpty():
        late = common.written(settled(open_, sigs, texts), "late")
        if not late.isEmpty():
            first = components(late.union(first.select(F.col("doc").alias("a"), F.col("comp").alias("b"))))
    ids = docs.select(F.col("doc_id").cast("long").alias("doc")).where("doc IS NOT NULL")
    out = ids.join(copies, "doc", "left").withColumn("rep", F.coalesce("rep", "doc")).join(first.withColumnsRenamed({"doc": "rep", "comp": "class_id"}), "rep", "left")
    return out.select(F.col("doc").alias("doc_id"), F.coalesce("class_id", "rep").alias("class_id"))


def report(docs: DataFrame) -> DataFrame:
    return near_classes(docs)


def keep_one(docs: DataFrame) -> DataFrame:
    """The row of each class whose doc_id is the class's, once, all columns; rows of a null doc_id stay."""
    kept = near_classes(docs.select("doc_id", "text")).where("doc_id = class_id").select("doc_id").distinct()
    once = docs.where("doc_id IS NOT NULL").dropDuplicates(["doc_id"]).join(kept, "doc_id", "left_semi")
    return once.select(docs.columns).unionByName(docs.where("doc_id IS NULL"))
