"""Operator 2: personal data with offset-preserving deobfuscation.

Base spans are the plain identifiers of the text.  Transducers then rewrite the text: homoglyphs
and full-width characters, invisible characters, at/dot disguises, spelled digits.  Each carries
for every written character the source range it came from, so spans found in the rewritten text
map back to the source.  Added spans touch at least one rewritten place and overlap no base span
of their kind; base spans always stay.  Disguised addresses may have parts of any length and number.

Offsets are code points, ends exclusive.  Null and empty texts give no spans.  Repeated rows are
scanned each; extra columns are ignored.  Time is linear in the text: patterns are anchored and possessive,
spelled digits are read by an automaton over tokens.
"""

from __future__ import annotations

import hashlib
import re
import unicodedata
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

from . import common

KINDS = ("email", "ip", "card", "phone")
_LOCAL = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-"
_DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)+")
# a run of digits that fails at its start fails at each later start too, so only run starts are tried
_IP = re.compile(r"(?<![0-9])([0-9]++)\.([0-9]++)\.([0-9]++)\.([0-9]++)")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_NOT_DIGIT = re.compile(r"[^0-9]+")
_DOUBLED = [sum(divmod(2 * d, 10)) for d in range(10)]


def luhn(digits: str) -> bool:
    return sum(int(c) for c in digits[-1::-2]) % 10 == -sum(_DOUBLED[int(c)] for c in digits[-2::-2]) % 10


def emails(t: str) -> list[tuple[int, int]]:
    out, at, p = [], 0, t.find("@")
    while p >= 0:
        local = t[at:p]
        n = len(local) - len(local.rstrip(_LOCAL))
        if n and (m := _DOMAIN.match(t, p + 1)):
            out.append((p - n, m.end()))
            at = m.end()
        else:
            at = p + 1
        p = t.find("@", at)
    return out


def _ip_ok(m: re.Match) -> bool:
    return all(len(g.lstrip("0")) <= 3 and int(g.lstrip("0") or "0") <= 255 for g in m.groups())


def detect(t: str) -> dict[str, list[tuple[int, int]]]:
    """Plain identifiers, leftmost and non-overlapping in each kind."""
    out: dict[str, list[tuple[int, int]]] = {k: [] for k in KINDS}
    if "@" in t:
        out["email"] = emails(t)
    if "." in t:
        out["ip"] = [m.span() for m in _IP.finditer(t) if _ip_ok(m)]
    for m in _CARD.finditer(t):
        if m.end() - m.start() >= 13 and 13 <= len(d := _NOT_DIGIT.sub("", m.group())) <= 19 and luhn(d):
            out["card"].append(m.span())
    if "+" in t:
        out["phone"] = [m.span() for m in _PHONE.finditer(t) if 9 <= len(_NOT_DIGIT.sub("", m.group())) <= 15]
    return out


# --- transducers -----------------------------------------------------------------------------

_LATIN = dict(zip("аеорсхуіјѕһԁԛԝАВЕКМНОРСТХІЈЅυοαεικνρτΑΒΕΖΗΙΚΜΝΟΡΤΥΧ", "aeopcxyijshdqwABEKMHOPCTXIJSuoaeikvptABEZHIKMNOPTYX"))
_LATIN |= {"＠": "@", "﹫": "@", "．": ".", "。": ".", "․": ".", "｡": ".", "＋": "+", "﹢": "+", "‐": "-", "‑": "-", "‒": "-", "–": "-", "−": "-", "－": "-", "﹣": "-", "＿": "_", "（": "(", "）": ")", " ": " ", " ": " ", " ": " ", " ": " ", "　": " "}
_SILENT = "​‌‍‎‏⁠﻿­⁡⁢⁣"
_ODD = re.compile("[" + "".join(map(re.escape, _LATIN)) + _SILENT + "٠-٩۰-۹०-९０-９Ａ-Ｚａ-ｚ①-⑨⓪⁰¹²³⁴-⁹₀-₉\U0001d400-\U0001d7ff]")

_DIGITS = {
    "zero": "0", "oh": "0", "null": "0", "zéro": "0", "cero": "0", "one": "1", "eins": "1", "un": "1", "uno": "1", "two": "2", "zwei": "2", "zwo": "2", "deux": "2", "dos": "2", "three": "3", "drei": "3", "trois": "3", "tres": "3",
    "four": "4", "vier": "4", "quatre": "4", "cuatro": "4", "five": "5", "fünf": "5", "cinq": "5", "cinco": "5", "six": "6", "sechs": "6", "seis": "6", "seven": "7", "sieben": "7", "sept": "7", "siete": "7", "eight": "8", "acht": "8", "huit": "8", "ocho": "8", "nine": "9", "neun": "9", "neuf": "9", "nueve": "9",
}
_DOT = "dot|punkt|point|punto"
_JOINERS = dict.fromkeys(_DOT.split("|"), ".") | dict.fromkeys(("dash", "hyphen", "minus"), "")
_TIMES = {"double": 2, "triple": 3}
_TOKEN = re.compile(r"([^\W_]+)|([ ,-]+)|(.)", re.S)
#: Over the kinds of tokens: at least four digits in a row (o), with plus (p) before and gaps (g), a joiner
#: between gaps (j) and brackets between them.  Possessive throughout, so a run is read once.
_RUN = re.compile(r"(?:pg?+\(?+g?+)?+o(?:(?>g?\)?g?(?:jg)?\(?g?)(?<=[g()])o){3,}+")
#: Words that count as a sign of spelled digits; the articles among them don't.
_SIGNS = _DIGITS.keys() - {"un", "uno", "oh", "null"}
_BREAKS = str.maketrans("-,()+", "     ")
_DOTS = tuple(f" {x} " for x in _DOT.split("|"))

_BRACKET_AT = re.compile(r"(?i)[\[({<]\s*+(?:at|arroba|@)\s*+[\])}>]|_at_")
_BRACKET_DOT = re.compile(rf"(?i)[\[({{<]\s*+(?:{_DOT}|\.)\s*+[\])}}>]|_dot_")
_WORDY = re.compile(rf"(?i)(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]++( ?@ ?| (?:at|arroba) )[A-Za-z0-9-]++(?:(?: (?:{_DOT}) | ?\. ?)[A-Za-z0-9-]++)++")
#: After a bare "at" these begin no host's name.
_PLAIN_WORD = re.compile(r"(?i)(?:the|a|an|this|that|my|our|your|his|her|its|their) ")
_WORDY_DOT = re.compile(rf"(?i) (?:{_DOT}) | ?\. ?")


class Rewritten:
    """A text and, for each of its characters, the source range; `changed` marks rewritten ones."""

    __slots__ = ("text", "start", "end", "changed")

    def __init__(self, text: str):
        self.text = text
        self.start: list[int] | range = range(len(text))
        self.end: list[int] | range = range(1, len(text) + 1)
        self.changed = bytearray(len(text))

    def apply(self, edits: list[tuple[int, int, str]]) -> None:
        """Replaces ranges (ascending, disjoint) by strings."""
        if not edits:
            return
        text, start, end, changed, at = [], [], [], bytearray(), 0
        for a, b, new in edits:
            text.append(self.text[at:a])
            start += self.start[at:a]
            end += self.end[at:a]
            changed += self.changed[at:a]
            if new:
                text.append(new)
                start += [self.start[a]] * len(new)
                end += [self.end[b - 1]] * len(new)
                changed += b"\x01" * len(new)
            elif changed:
                changed[-1] = 1
            at = b
        self.text = "".join(text) + self.text[at:]
        self.start, self.end, self.changed = start + list(self.start[at:]), end + list(self.end[at:]), changed + self.changed[at:]


def _glyph(m: re.Match) -> str:
    c = m.group()
    if c in _SILENT:
        return ""
    if c in _LATIN:
        return _LATIN[c]
    d = unicodedata.digit(c, -1)
    return str(d) if d >= 0 else x if len(x := unicodedata.normalize("NFKC", c)) == 1 else c


def _spelled(s: str) -> list[tuple[int, int, str]]:
    """Edits that write runs of at least four spelled or figure digits as figures; figures alone are left alone."""
    kinds, starts, ends, values = [], [], [], []
    for m in _TOKEN.finditer(s):
        a, b = m.span()
        word, gap, other = m.groups()
        if word:
            low = word.lower()
            figures = word.isascii() and word.isdigit()
            value = word if figures else _DIGITS.get(low)
            if value is not None:
                if len(value) == 1 and kinds[-2:] == ["d", "g"] and s[starts[-1] : a] == " ":
                    value *= values[-2]  # "double five"
                    a = starts[-2]
                    for x in (kinds, starts, ends, values):
                        del x[-2:]
                    figures = False
                kind = "f" if figures else "o"
            elif low in _JOINERS:
                kind, value = "j", _JOINERS[low]
            elif low in _TIMES:
                kind, value = "d", _TIMES[low]
            else:
                kind, value = ("p", "+") if low == "plus" else ("x", "")
        elif gap:
            kind, value = "g", ""
        else:
            kind, value = ("p", other) if other == "+" else (other, other) if other in "()" else ("x", "")
        kinds.append(kind)
        starts.append(a)
        ends.append(b)
        values.append(value)
    flat = "".join(kinds)
    out = []
    for m in _RUN.finditer(flat.replace("f", "o")):
        i, j = m.span()
        new = "".join(values[i:j])
        if "o" in flat[i:j] and sum(map(str.isdigit, new)) >= 4:
            out.append((starts[i], ends[j - 1], new))
    return out


def _widened(pattern: re.Pattern, s: str, new: str) -> list[tuple[int, int, str]]:
    """Edits of a pattern's matches with the white space around them, which is read once."""
    out, low = [], 0
    for m in pattern.finditer(s):
        a, b = m.span()
        while a > low and s[a - 1].isspace():
            a -= 1
        while b < len(s) and s[b].isspace():
            b += 1
        out.append((a, b, new))
        low = b
    return out


def _at_dot(m: re.Match) -> list[tuple[int, int, str]]:
    at, end = m.span(1), m.end()
    edits = [(*at, "@")] if m.group(1) != "@" else []
    for x in _WORDY_DOT.finditer(m.string, at[1], end):
        if x.group() != ".":
            edits.append((*x.span(), "."))
    return edits


def _wordy_ok(m: re.Match) -> bool:
    """Bare "at" needs a spelled dot; a bare @ or dot with spaces needs the other one spelled or tight."""
    s, at = m.group(), m.group(1)
    if "@" not in at and _PLAIN_WORD.match(s, m.end(1) - m.start()):
        return False
    spelled = re.search(rf"(?i) (?:{_DOT}) ", s[m.end(1) - m.start() :])
    return bool(spelled) or (at != "@" and "@" in at and not re.search(r" \.|\. ", s[m.end(1) - m.start() :]))


def rewrite(t: str) -> Rewritten | None:
    """The text after all transducers; None if none of them has anything to do."""
    r = None
    if not t.isascii() and _ODD.search(t):
        r = Rewritten(t)
        r.apply([(*m.span(), x) for m in _ODD.finditer(t) if (x := _glyph(m)) != m.group()])
    s = r.text if r else t
    if any(x in s for x in ("[", "(", "{", "<", "_")):
        for pattern, new in ((_BRACKET_AT, "@"), (_BRACKET_DOT, ".")):
            if edits := _widened(pattern, s, new):
                r = r or Rewritten(t)
                r.apply(edits)
                s = r.text
    low = s.lower()
    if sum(map(_SIGNS.__contains__, low.translate(_BREAKS).split() if low.isascii() else low.replace("-", " ").replace(",", " ").replace("(", " ").replace(")", " ").split())) >= 2 and (edits := _spelled(s)):
        r = r or Rewritten(t)
        r.apply(edits)
        s = r.text
    if "@" in s or any(x in low for x in _DOTS):
        edits = [e for m in _WORDY.finditer(s) if _wordy_ok(m) for e in _at_dot(m)]
        if edits:
            r = r or Rewritten(t)
            r.apply(edits)
    return r


def find(t: str) -> tuple[dict[str, list[tuple[int, int]]], dict[str, list[tuple[int, int]]]]:
    """(base spans, base and added spans), by kind, in source offsets."""
    base = detect(t)
    r = rewrite(t)
    if r is None:
        return base, base
    full = {}
    for kind, spans in detect(r.text).items():
        have = list(base[kind])
        for a, b in spans:
            if 1 not in r.changed[a:b]:
                continue
            s, e = r.start[a], r.end[b - 1]
            if all(e <= x or y <= s for x, y in base[kind]):
                have.append((s, e))
        full[kind] = sorted(have)
    return base, full


def spans_text(spans: dict[str, list[tuple[int, int]]]) -> str:
    return ",".join(f"{k}:{a}:{b}" for k in KINDS for a, b in spans[k])


def mask(t: str, spans: dict[str, list[tuple[int, int]]]) -> str:
    """The text with each span replaced by its kind in brackets; overlapping spans become one, of the first's kind."""
    out, at = [], 0
    for a, b, k in sorted((a, b, k) for k in KINDS for a, b in spans[k]):
        if a >= at:
            out += [t[at:a], f"[{k.upper()}]"]
        at = max(at, b)
    return "".join(out) + t[at:]


def scan(docs: DataFrame, masked: bool = False) -> DataFrame:
    """doc_id, n_<kind>, base_sha256, spans; masked: all columns of docs instead, with text masked."""
    names = docs.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in common.slices(batches):
            texts = b.column("text").to_pylist()
            found = [find(t or "") for t in texts]
            if masked:
                new = [t if t is None else mask(t, full) if any(full.values()) else t for t, (_, full) in zip(texts, found)]
                yield pa.RecordBatch.from_arrays([pa.array(new, pa.string()) if n == "text" else b.column(n) for n in names], names)
            else:
                cols = {"doc_id": b.column("doc_id")} | {f"n_{k}": pa.array([len(f[k]) for _, f in found], pa.int64()) for k in KINDS}
                cols |= {"base_sha256": pa.array([hashlib.sha256(spans_text(x).encode()).hexdigest() for x, _ in found]), "spans": pa.array([spans_text(f) for _, f in found], pa.string())}
                yield pa.RecordBatch.from_pydict(cols)

    if masked:
        return common.in_arrow(docs, run, docs.schema)
    rows = docs.selectExpr("cast(doc_id AS long) AS doc_id", "text")
    return common.in_arrow(rows, run, "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string")
