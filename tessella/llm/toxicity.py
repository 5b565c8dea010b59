"""Operator 4: toxicity by noisy-channel deobfuscation.

A character language model (four-grams over 26 letters and the word end, counted over all
documents) and a channel of leetspeak, inserted separators, spacing and repetition span a lattice
for every suspicious token; Viterbi decoding, exact over all contexts of three letters, restores the likeliest.  Restored and written
words, and their first 4 to 6 letters, are the features of a logistic model.

The model is fitted on at most TRAIN_DOCS labelled documents (those of the smallest doc_id hashes),
of which crc32(doc_id as text) mod 5 is not 0, on the driver; the features of all documents are looked
up on the executors.  Scores use the text alone.

Null and empty texts score the base rate.  Repeated rows score alike; a document labelled twice
counts as toxic if either label is.  Without labels of both kinds every score is the base rate of those
there are (0 without any).  Extra columns of any name pass through `reject`; extra label columns are ignored.
"""

from __future__ import annotations

import math
import re
import unicodedata
import zlib
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import common

TRAIN_DOCS, FEATURES, LEAST_DOCS = 8000, 3000, 3
MEMO_TOKENS = 400_000
LETTERS = 27  # 0 is the word end
GRAMS = LETTERS**4

# --- language model --------------------------------------------------------------------------


@cache
def _letter_table() -> np.ndarray:
    """Code point to 1..26 for Latin letters without marks, else 0."""
    out = np.zeros(0x110000, np.uint8)
    for c in range(0x250):
        base = unicodedata.normalize("NFKD", chr(c).lower())[:1]
        out[c] = ord(base) - 96 if "a" <= base <= "z" else 0
    out[0xDF] = 19
    return out


def gram_counts(texts: list[str]) -> np.ndarray:
    """Counts of letter four-grams; a text begins with a word end."""
    raw = np.frombuffer(("   ".join(["", *texts, ""])).encode("utf-32-le", "surrogatepass"), "<u4")
    c = _letter_table()[raw].astype(np.int32)
    g = ((c[:-3] * LETTERS + c[1:-2]) * LETTERS + c[2:-1]) * LETTERS + c[3:]
    return np.bincount(g[(c[3:] > 0) | (c[2:-1] > 0)], minlength=GRAMS)


def count_grams(docs: DataFrame) -> np.ndarray:
    """Four-gram counts over all documents: one row for each gram of a partition, GRAMS rows on the driver at most."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(GRAMS, np.int64)
        for b in common.slices(batches, size=2 << 20):
            total += gram_counts(common.texts_of(b))
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(total[at])], ["gram", "n"])

    rows = common.in_arrow(docs.select("text"), run, "gram int, n long").groupBy("gram").agg(F.sum("n").alias("n"))
    out = np.zeros(GRAMS, np.int64)
    found = rows.toArrow()
    out[found.column("gram").to_numpy()] = found.column("n").to_numpy()
    return out


def log_probabilities(counts: np.ndarray) -> np.ndarray:
    """ln P(letter | three before), each order leaning on the shorter one."""
    p = np.full(LETTERS, 1 / LETTERS)
    full = counts.reshape((LETTERS,) * 4).astype(np.float64)
    for skip in (3, 2, 1, 0):
        n = full.sum(axis=tuple(range(skip))) if skip else full
        p = (n + 8 * p) / (n.sum(-1, keepdims=True) + 8)
    return np.log(p).astype(np.float32).reshape(-1)


# --- channel and decoder ---------------------------------------------------------------------

_LEET = {
    "0": "o", "1": "il", "2": "z", "3": "e", "4": "a", "5": "s", "6": "gb", "7": "t", "8": "b", "9": "g", "@": "a", "$": "s", "!": "i", "|": "il", "+": "t", "€": "e", "£": "l", "¡": "i", "(": "c", "<": "c", "¢": "c", "}": "", "µ": "u", "§": "s",
}
_SEPARATORS = frozenset(".-_~'`´^·•,:;/\\=\"")
_WILD = frozenset("*#%?")
_LEET_COST, _DOUBLE_COST, _SEPARATOR_COST, _WILD_COST, _WILD_NONE, _END_COST = 0.7, 1.2, 0.3, 1.5, 2.0, 2.0


def _options(c: str, n: int) -> list[tuple[tuple[int, ...], float]]:
    """(letters, cost) that a run of n characters c may stand for; 0 is a word end."""
    code = int(_letter_table()[ord(c)])
    if code:
        if n == 1:
            return [((code,), 0.0)]
        one, two = ((code,), _DOUBLE_COST if n == 2 else 0.2), ((code, code), 0.0 if n == 2 else 0.5)
        return [one, two]
    if c in _LEET:
        found = []
        for x in _LEET[c]:
            k = ord(x) - 96
            found += [((k,), _LEET_COST)] if n == 1 else [((k,), _LEET_COST + 0.5), ((k, k), _LEET_COST)]
        return [*found, ((), 4.0)]
    if c in _SEPARATORS:
        return [((), _SEPARATOR_COST), ((0,), _END_COST)]
    return [((0,), 1.0)]


def _step(live: dict[int, tuple[float, tuple]], ways: list[tuple[tuple[int, ...], float]], logp: np.ndarray) -> dict[int, tuple[float, tuple]]:
    """The best path into each context after one of the ways (letters, price)."""
    lp, cube = logp.item, LETTERS**3
    new: dict[int, tuple[float, tuple]] = {}
    for way, price in ways:
        for context, (score, path) in live.items():
            k, s, t = context, score - price, path
            for x in way:
                if x == 0 and k % LETTERS == 0:
                    continue  # one word end in a row
                s += lp(k * LETTERS + x)
                k = (k * LETTERS + x) % cube
                t = (t, x)
            if k not in new or new[k][0] < s:
                new[k] = (s, t)
    return new


class _Dense:
    """One step over all contexts: the score of each, the context and way that it came from, and the step before;
    `instead` has the paths into contexts that came by another way."""

    __slots__ = ("score", "source", "chosen", "ways", "before", "instead")

    def __init__(self, score, source, chosen, ways, before):
        self.score, self.source, self.chosen, self.ways, self.before = score, source, chosen, ways, before
        self.instead: dict[int, tuple] = {}

    def live(self) -> dict[int, tuple[float, tuple]]:
        return {k: (self.score.item(k), (self, k)) for k in np.flatnonzero(self.score > -np.inf).tolist()}


_CUBE, _SQUARE = LETTERS**3, LETTERS**2


def _scores(state) -> np.ndarray:
    if isinstance(state, _Dense):
        return state.score
    out = np.full(_CUBE, -np.inf)
    out[np.fromiter(state, np.int64, len(state))] = np.fromiter((s for s, _ in state.values()), np.float64, len(state))
    return out


def _wide_step(state, ways: list[tuple[tuple[int, ...], float]], logp: np.ndarray) -> _Dense:
    """The same as _step in arrays, for many contexts or ways."""
    table, start = logp.reshape(_CUBE, LETTERS), _scores(state)
    best, source, chosen = np.full(_CUBE, -np.inf), np.zeros(_CUBE, np.int64), np.zeros(_CUBE, np.int8)
    for number, (way, price) in enumerate(ways):
        s, origin = start - price, np.arange(_CUBE)
        for x in way:
            sums = (s + table[:, x]).reshape(LETTERS, _SQUARE)
            if x == 0:
                sums[:, ::LETTERS] = -np.inf  # one word end in a row: these contexts stay as they are
            first = sums.argmax(0)
            new, came = np.full(_CUBE, -np.inf), np.zeros(_CUBE, np.int64)
            new[x::LETTERS] = sums[first, np.arange(_SQUARE)]
            came[x::LETTERS] = origin[first * _SQUARE + np.arange(_SQUARE)]
            if x == 0:
                stay = np.arange(0, _CUBE, LETTERS)
                stay = stay[s[stay] > new[stay]]
                new[stay], came[stay] = s[stay], origin[stay]
            s, origin = new, came
        better = s > best
        best[better], source[better], chosen[better] = s[better], origin[better], number
    return _Dense(best, source, chosen, [w for w, _ in ways], state)


_LETTER_WAYS = [(k,) for k in range(LETTERS)]


def _wild_step(state, logp: np.ndarray, cost: float) -> _Dense:
    """The best path into each context after any one letter."""
    sums = (_scores(state)[:, None] + logp.reshape(_CUBE, LETTERS)).reshape(LETTERS, _CUBE)
    first = sums.argmax(0)
    best = sums[first, np.arange(_CUBE)] - cost
    best[::LETTERS] = -np.inf  # a letter, no word end
    return _Dense(best, first * _SQUARE + np.arange(_CUBE) // LETTERS, (np.arange(_CUBE) % LETTERS).astype(np.int8), _LETTER_WAYS, state)


def _either(none: dict[int, tuple[float, tuple]], state):
    """The better path into each context, `none` first."""
    if isinstance(state, _Dense):
        score = state.score.copy()
        out = _Dense(score, state.source, state.chosen, state.ways, state.before)
        for k, (s, path) in none.items():
            if s >= score[k]:
                score[k], out.instead[k] = s, path
        return out
    return none | {k: x for k, x in state.items() if k not in none or none[k][0] < x[0]}


def _wild_run(state, n: int, logp: np.ndarray, spaced: bool) -> list:
    """States after a run of n wildcards: nothing, or n letters, each its own; spaced: word ends may fall before any of them.

    n letters cost n * _WILD_COST at least, nothing _WILD_NONE; what follows can make up for the three
    letters of context and the last word end alone.  Runs so long that letters can't win are nothing, exactly."""
    live = state.live() if isinstance(state, _Dense) else state
    none = {k: (s - _WILD_NONE, t) for k, (s, t) in live.items()}
    if n * _WILD_COST > _WILD_NONE - 4.0 * _floor(logp):
        return [none]
    for _ in range(n):
        if spaced:
            ends = _wide_step(state, [((), 0.0), ((0,), _END_COST)], logp)
            state = _wild_step(ends, logp, _WILD_COST)
        elif isinstance(state, dict) and len(state) * LETTERS <= 2000:
            state = _step(state, [((k,), _WILD_COST) for k in range(1, LETTERS)], logp)
        else:
            state = _wild_step(state, logp, _WILD_COST)
    return [none, state]


_FLOORS: dict[int, tuple[np.ndarray, float]] = {}
#: Scores of wildcards at a token's end under the model of _FLOORS, by their number.
_RESTS: dict[int, np.ndarray] = {}


def _floor(logp: np.ndarray) -> float:
    """The least entry of a model."""
    known = _FLOORS.get(id(logp))
    if known is None or known[0] is not logp:
        _FLOORS.clear()
        _RESTS.clear()
        _FLOORS[id(logp)] = known = logp, float(logp.min())
    return known[1]


def _letters(path: tuple) -> list[int]:
    """What a path wrote."""
    out: list[int] = []
    while path:
        before, x = path
        if not isinstance(before, _Dense):
            out.append(x)
            path = before
            continue
        path = None
        while isinstance(before, _Dense):
            if x in before.instead:
                path = before.instead[x]
                break
            k = int(before.source[x])
            written, c = [], k
            for y in before.ways[before.chosen[x]]:
                if y or c % LETTERS:
                    written.append(y)
                    c = (c * LETTERS + y) % _CUBE
            out += reversed(written)
            x, before = k, before.before
        if path is None:
            path = before[x][1]
    return out[::-1]


def _end(states: list, logp: np.ndarray) -> tuple:
    """The best path of several states, with the last word ended."""
    top, path = -math.inf, ()
    for state in states:
        if isinstance(state, _Dense):
            total = state.score + _ends(logp)
            k = int(total.argmax())
            score, found = total.item(k), (state, k)
        else:
            score, found = max(((s + (logp.item(k * LETTERS) if k % LETTERS else 0.0), t) for k, (s, t) in state.items()), key=lambda x: x[0])
        if score > top:
            top, path = score, found
    return path


def _ends(logp: np.ndarray) -> np.ndarray:
    """What ending the last word costs in each context."""
    last = logp[::LETTERS].astype(np.float64)
    last[::LETTERS] = 0.0  # ended already
    return last


def _best_rest(n: int, logp: np.ndarray) -> np.ndarray:
    """The best score of n wildcards at a token's end, all of them letters, after each context."""
    _floor(logp)
    if n not in _RESTS:
        rest = _ends(logp) if n == 0 else (logp.reshape(_CUBE, LETTERS)[:, 1:] + (_best_rest(n - 1, logp).reshape(_SQUARE, LETTERS)[np.arange(_CUBE) % _SQUARE, 1:] - _WILD_COST)).max(1)
        _RESTS[n] = rest
    return _RESTS[n]


def _ending(live: dict[int, tuple[float, tuple]], n: int, logp: np.ndarray) -> tuple[tuple, tuple[int, ...]]:
    """The best path up to a token's last n wildcards, and their letters."""
    all_none = n * _WILD_COST > _WILD_NONE - 4.0 * _floor(logp)
    top, path, context, letters = -math.inf, (), 0, False
    for k, (s, t) in live.items():
        if (x := s + _best_rest(0, logp).item(k) - _WILD_NONE) > top:
            top, path, context, letters = x, t, k, False
        if not all_none and (x := s + _best_rest(n, logp).item(k)) > top:
            top, path, context, letters = x, t, k, True
    if not letters:
        return path, ()
    out = []
    for left in range(n - 1, -1, -1):
        at = context % _SQUARE * LETTERS
        x = 1 + int((logp[context * LETTERS + 1 : context * LETTERS + LETTERS] + (_best_rest(left, logp)[at + 1 : at + LETTERS] - _WILD_COST)).argmax())
        out.append(x)
        context = at + x
    return path, tuple(out)


def restore(token: str, logp: np.ndarray, spaced: bool = False) -> str:
    """The likeliest words behind a token, a to z, exact over all contexts; spaced: word ends may also fall between its characters."""
    state = {0: (0.0, ())}
    at = 0
    while at < len(token):
        n = 1
        while at + n < len(token) and token[at + n] == token[at]:
            n += 1
        if token[at] in _WILD:
            if at + n == len(token) and isinstance(state, dict) and not spaced:
                path, tail = _ending(state, n, logp)
                return _written([*_letters(path), *tail])
            none, *letters = _wild_run(state, n, logp, spaced and at > 0)
            state = _either(none, letters[0]) if letters else none
            at += n
            continue
        ways = []
        for letters, cost in _options(token[at], n):
            ways.append((letters, cost))
            if spaced and at and letters and letters[0]:
                ways.append(((0, *letters), cost + _END_COST))
        if isinstance(state, _Dense) and np.count_nonzero(state.score > -np.inf) * len(ways) <= 2000:
            state = state.live()
        state = _step(state, ways, logp) if isinstance(state, dict) and len(state) * len(ways) <= 2000 else _wide_step(state, ways, logp)
        at += n
    return _written(_letters(_end([state], logp)))


def _written(letters: list[int]) -> str:
    return "".join(chr(96 + x) if x else " " for x in letters).strip()


_TRIM = re.compile(r"^[^\w@$!|+€£]+|[^\w@$|+€£*]+$")
_PLAIN = re.compile(r"[^\W\d_]+")
_TRIPLE = re.compile(r"([^\W\d_])\1\1")
_SPACED = re.compile(r"(?<![^\W_])(?:[\w@$!|*][ .\-_*]{1,2}){3,}[\w@$!|*](?![^\W_])")


def suspicious(token: str) -> bool:
    """Letters with other characters among them, or a letter three times in a row."""
    if token.isalpha():
        return _TRIPLE.search(token) is not None
    letters = sum(map(str.isalpha, token))
    return letters > 0 or len(token) >= 4 and not token.isdigit() and any(c in _LEET for c in token)


def words_of(token: str, logp: np.ndarray) -> set[str]:
    """A token's written and restored words, lower case."""
    core = _TRIM.sub("", token)
    out = set(_PLAIN.findall(core))
    if core and suspicious(core):
        out.update(restore(core, logp).split())
    return out


def features_of(word: str) -> list[int]:
    out = [zlib.crc32(word.encode("utf-8", "surrogatepass"))]
    out += [zlib.crc32(word[:n].encode("utf-8", "surrogatepass"), n) for n in (4, 5, 6) if len(word) >= n]
    return out


class Reader:
    """Texts to feature ids; with a model, only its features."""

    def __init__(self, logp: np.ndarray, known: frozenset[int] | None = None):
        self.logp, self.known, self.memo = logp, known, {}

    def _token(self, token: str) -> tuple[int, ...]:
        found = {f for w in words_of(token, self.logp) for f in features_of(w)}
        return tuple(found if self.known is None else found & self.known)

    def read(self, text: str) -> set[int]:
        low = text.lower()
        out: set[int] = set()
        memo = self.memo
        for token in set(low.split()):
            got = memo.get(token)
            if got is None:
                if len(memo) >= MEMO_TOKENS:
                    memo.clear()
                got = memo[token] = self._token(token)
            if got:
                out.update(got)
        if " " in low:
            for m in _SPACED.finditer(low):
                joined = re.sub(r"[ .\-_]", "", m.group())
                for w in restore(joined, self.logp, spaced=True).split():
                    found = features_of(w)
                    out.update(found if self.known is None else self.known.intersection(found))
        return out


# --- model -----------------------------------------------------------------------------------


def fit(rows: list[np.ndarray], labels: np.ndarray, steps: int = 300, ridge: float = 0.02) -> tuple[dict[int, float], float]:
    """(weights by feature, intercept) of a logistic model on the features that tell labels apart best."""
    y = np.asarray(labels, np.float64)
    if not len(y):
        return {}, -30.0
    base = math.log((y.sum() + 0.01) / (len(y) - y.sum() + 0.01))
    if y.min() == y.max():
        return {}, base
    flat, owner = np.concatenate(rows), np.repeat(np.arange(len(rows)), [len(r) for r in rows])
    ids, place, n = np.unique(flat, return_inverse=True, return_counts=True)
    hits = np.bincount(place, weights=y[owner], minlength=len(ids))
    share = y.mean()
    rate = np.clip(hits / n, 1e-9, 1 - 1e-9)
    gain = n * (rate * np.log(rate / share) + (1 - rate) * np.log((1 - rate) / (1 - share)))
    gain[n < LEAST_DOCS] = -1
    chosen = np.sort(np.argsort(-gain, kind="stable")[:FEATURES])
    chosen = chosen[gain[chosen] > 3]
    if not len(chosen):
        return {}, base
    to = np.full(len(ids), -1)
    to[chosen] = np.arange(len(chosen))
    col = to[place]
    keep = col >= 0
    col, row = col[keep], owner[keep]
    w, b = np.zeros(len(chosen)), base
    m1, m2 = np.zeros(len(chosen) + 1), np.zeros(len(chosen) + 1)
    for step in range(1, steps + 1):  # Adam on the whole sample
        z = np.bincount(row, weights=w[col], minlength=len(y)) + b
        err = 1 / (1 + np.exp(-np.clip(z, -30, 30))) - y
        grad = np.append(np.bincount(col, weights=err[row], minlength=len(w)) + ridge * w, err.sum())
        m1, m2 = 0.9 * m1 + 0.1 * grad, 0.999 * m2 + 0.001 * grad**2
        move = 0.1 * (m1 / (1 - 0.9**step)) / (np.sqrt(m2 / (1 - 0.999**step)) + 1e-8)
        w, b = w - move[:-1], b - move[-1]
    return {int(f): float(x) for f, x in zip(ids[chosen], w)}, float(b)


def _held_out(doc):
    return F.crc32(doc.cast("string").cast("binary")) % 5 == 0


def train(docs: DataFrame, labels: DataFrame) -> tuple[np.ndarray, dict[int, float], float]:
    """(language model, weights, intercept)."""
    logp = log_probabilities(count_grams(docs))
    known = labels.select(F.col("doc_id").cast("long").alias("_doc"), F.col("toxic").cast("int").alias("_toxic")).where("_doc IS NOT NULL AND _toxic IS NOT NULL")
    known = known.where(~_held_out(F.col("_doc"))).groupBy("_doc").agg(F.max("_toxic").alias("_toxic"))
    sample = known.orderBy(F.xxhash64("_doc"), "_doc").limit(TRAIN_DOCS)  # this many rows are sent
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(F.broadcast(sample), F.col("doc_id") == F.col("_doc"))
    sent = docs.sparkSession.sparkContext.broadcast(logp)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader = Reader(sent.value)
        for b in common.slices(batches, rows=500, size=2 << 20):
            ids = [np.array(sorted(reader.read(t)), "<u4").tobytes() for t in common.texts_of(b)]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("_toxic"), pa.array(ids, pa.binary())], ["doc_id", "toxic", "ids"])

    found = common.in_arrow(rows.select("doc_id", "_toxic", "text"), run, "doc_id long, toxic int, ids binary").toArrow().sort_by("doc_id")
    weights, intercept = fit([np.frombuffer(x, "<u4") for x in found.column("ids").to_pylist()], (found.column("toxic").to_numpy() > 0).astype(np.float64) if found.num_rows else np.zeros(0))
    return logp, weights, intercept


_READERS: dict[int, Reader] = {}


def _with_score(docs: DataFrame, model: tuple[np.ndarray, dict[int, float], float], into: str) -> DataFrame:
    names = docs.columns
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        logp, weights, intercept = sent.value
        key = zlib.crc32(logp.tobytes()) ^ hash((tuple(sorted(weights)[:50]), intercept))
        if key not in _READERS:
            _READERS.clear()
            _READERS[key] = Reader(logp, frozenset(weights))
        reader = _READERS[key]
        for b in common.slices(batches):
            z = [intercept + math.fsum(weights[f] for f in reader.read(t)) for t in common.texts_of(b)]
            score = pa.array([1 / (1 + math.exp(-max(-30.0, min(30.0, x)))) for x in z], pa.float64())
            yield pa.RecordBatch.from_arrays([*[b.column(n) for n in names], score], [*names, into])

    return common.in_arrow(docs, run, T.StructType([*docs.schema.fields]).add(into, "double"))


def score(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score, predicted."""
    out = _with_score(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), train(docs, labels), "score")
    return out.select("doc_id", _held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def reject(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The documents that score below one half, all columns."""
    into = common.fresh("_score", docs.columns)
    return _with_score(docs, train(docs, labels), into).where(F.col(into) < 0.5).drop(into)
