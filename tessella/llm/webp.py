"""Operator 10: lossless WebP, written and read without any imaging library.

The decoder takes the whole lossless format: simple and extended containers, prefix codes (simple and
normal, with meta codes by tile), back-references with the 120 near distances, the colour cache, and
the predictor, cross-colour, subtract-green and palette transforms.  Where one prefix-code group
serves a longer image, codes are decoded for all bit positions at once with numpy and then chained;
short images and those with several groups are decoded pixel by pixel.  Texts come in batches, and
`webp_many` writes and reads the short and plain ones together.

`media` stores texts: UTF-8 padded with zero bytes to a positive multiple of 64, four bytes to a
pixel (alpha, red, green, blue), 16 pixels to a row, wider for very long texts.  The encoder uses all
that the decoder reads, each where it makes an image shorter: transforms chosen by entropy, copies
from earlier places, a colour cache of the best of three sizes, and prefix codes fitted to each channel, by
groups of tiles in longer images.
`features` decodes the stored bytes and computes the digests from what it has read.

Null texts are empty (one row of zero pixels).  Equal texts give equal values in all columns but
doc_id; repeated rows are stored each; extra columns are ignored.  A payload above 1 GiB (the
format's largest image) raises ValueError.
"""

from __future__ import annotations

import hashlib
import math
import re
import struct
import zlib
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

_CODE_ORDER = (17, 18, 0, 1, 2, 3, 4, 5, 16, 6, 7, 8, 9, 10, 11, 12, 13, 14, 15)
#: (x, y) offsets of the 120 near distances: the pixel x to the left and y above.
_NEAR_TEXT = """0,1 1,0 1,1 -1,1 0,2 2,0 1,2 -1,2 2,1 -2,1 2,2 -2,2 0,3 3,0 1,3 -1,3 3,1 -3,1 2,3 -2,3 3,2 -3,2 0,4 4,0 1,4 -1,4 4,1 -4,1 3,3 -3,3 2,4 -2,4 4,2 -4,2 0,5
3,4 -3,4 4,3 -4,3 5,0 1,5 -1,5 5,1 -5,1 2,5 -2,5 5,2 -5,2 4,4 -4,4 3,5 -3,5 5,3 -5,3 0,6 6,0 1,6 -1,6 6,1 -6,1 2,6 -2,6 6,2 -6,2 4,5 -4,5 5,4 -5,4 3,6 -3,6 6,3 -6,3
0,7 7,0 1,7 -1,7 5,5 -5,5 7,1 -7,1 4,6 -4,6 6,4 -6,4 2,7 -2,7 7,2 -7,2 3,7 -3,7 7,3 -7,3 5,6 -5,6 6,5 -6,5 8,0 4,7 -4,7 7,4 -7,4 8,1 8,2 6,6 -6,6 8,3 5,7 -5,7 7,5 -7,5
8,4 6,7 -6,7 7,6 -7,6 8,5 7,7 -7,7 8,6 8,7"""
_NEAR = [tuple(map(int, x.split(","))) for x in _NEAR_TEXT.split()]
_CACHE_MUL = 0x1E35A7BD


class Broken(ValueError):
    """The bytes aren't a lossless WebP image."""


# --- bits ------------------------------------------------------------------------------------


class Bits:
    """Reads numbers from the low bits of bytes on."""

    def __init__(self, data: bytes):
        self.data, self.at, self.size = data + b"\0" * 16, 0, 8 * len(data)

    def read(self, n: int) -> int:
        k = self.at >> 3
        value = int.from_bytes(self.data[k : k + 8], "little") >> (self.at & 7) & ((1 << n) - 1)
        self.at += n
        if self.at > self.size:
            raise Broken("the data end early")
        return value

    def peek(self, n: int) -> int:
        k = self.at >> 3
        return int.from_bytes(self.data[k : k + 8], "little") >> (self.at & 7) & ((1 << n) - 1)


class BitWriter:
    """Writes numbers from the low bits on."""

    def __init__(self):
        self.values: list[int] = []
        self.sizes: list[int] = []

    def put(self, value: int, n: int) -> None:
        self.values.append(value)
        self.sizes.append(n)

    def bytes(self, then: tuple[np.ndarray, np.ndarray] | None = None) -> bytes:
        """All that was put, then arrays of (values, sizes of at most 32 bits)."""
        v, n = np.array(self.values, np.uint64), np.array(self.sizes, np.int64)
        if then is not None:
            v, n = np.concatenate([v, then[0].astype(np.uint64)]), np.concatenate([n, then[1].astype(np.int64)])
        at = np.cumsum(n) - n
        total = int(at[-1] + n[-1]) if len(n) else 0
        words = np.zeros(total // 32 + 3, np.uint64)
        low = v << (at % 32).astype(np.uint64)
        np.add.at(words, at // 32, low & np.uint64(0xFFFFFFFF))  # fields never overlap, so adding is joining
        np.add.at(words, at // 32 + 1, low >> np.uint64(32))
        return words.astype("<u4").tobytes()[: (total + 7) // 8]


# --- prefix codes ----------------------------------------------------------------------------


_REVERSED = np.array([int(format(k, "016b")[::-1], 2) for k in range(1 << 16)], np.uint32)


def canonical(lengths: np.ndarray) -> np.ndarray:
    """Codes of these lengths, bits reversed as the stream has them."""
    codes = np.zeros(len(lengths), np.uint32)
    used = np.flatnonzero(lengths)
    used = used[np.argsort(lengths[used], kind="stable")]
    n = lengths[used].astype(np.int64)
    ends = np.cumsum(1 << (16 - n))  # codes as fractions of 2 ** 16, in order
    codes[used] = _REVERSED[ends - (1 << (16 - n))]
    return codes


class Prefix:
    """A table over the next `width` bits: symbol and length.  A lone symbol takes no bits."""

    def __init__(self, lengths: np.ndarray):
        used = np.flatnonzero(lengths)
        if len(used) == 0:
            used = np.array([0])
        if len(used) == 1:
            self.width, self.symbol, self.length = 0, np.array([used[0]], np.uint16), np.zeros(1, np.uint8)
        else:
            self.width = int(lengths.max())
            if int((1 << (self.width - lengths[used].astype(np.int64))).sum()) != 1 << self.width:
                raise Broken("a prefix code is not complete")
            used = used[np.argsort(lengths[used], kind="stable")]
            row = np.repeat(used, 1 << (self.width - lengths[used].astype(np.int64)))
            row = row[_REVERSED[np.arange(1 << self.width) << (16 - self.width)]]
            self.symbol, self.length = row.astype(np.uint16), lengths[row]
        self.slow = None
        self.last_run = 0

    def read(self, bits: Bits) -> int:
        table, mask = self.both()
        e = table[bits.peek(self.width) & mask]
        bits.at += e & 15
        if bits.at > bits.size:
            raise Broken("the data end early")
        return e >> 4

    def both(self) -> tuple[list[int], int]:
        """symbol * 16 + length by the next bits, and their mask."""
        if self.slow is None:
            self.slow = ((self.symbol.astype(np.int32) << 4 | self.length).tolist(), (1 << self.width) - 1)
        return self.slow


def read_prefix(bits: Bits, alphabet: int) -> Prefix:
    lengths = np.zeros(alphabet, np.uint8)
    if bits.read(1):  # simple
        n = bits.read(1) + 1
        for k in range(n):
            s = bits.read(8 if k or bits.read(1) else 1)
            if s >= alphabet:
                raise Broken("a symbol is outside its alphabet")
            lengths[s] = 1
        return Prefix(lengths)
    own = np.zeros(19, np.uint8)
    for k in range(4 + bits.read(4)):
        own[_CODE_ORDER[k]] = bits.read(3)
    code, left, before, s = Prefix(own), alphabet, 8, 0
    if bits.read(1):
        left = 2 + bits.read(2 + 2 * bits.read(3))
    code_symbol, code_length, mask = code.symbol.tolist(), code.length.tolist(), (1 << code.width) - 1
    at, k = bits.at, bits.at >> 3
    acc, first, row = int.from_bytes(bits.data[k : k + 600], "little") >> (at & 7), at, []  # 280 symbols of 14 bits at most
    add = row.append
    while s < alphabet and left > 0:
        left -= 1
        x, n = code_symbol[acc & mask], code_length[acc & mask]
        acc >>= n
        at += n
        if x < 16:
            add(x)
            s += 1
            before = x or before
        else:
            n = (2, 3, 7)[x - 16]
            run, value = (11 if x == 18 else 3) + (acc & ((1 << n) - 1)), before if x == 16 else 0
            acc >>= n
            at += n
            row += [value] * run
            s += run
        if at - first > 4600:  # with a colour cache an alphabet may be longer
            k, first = at >> 3, at
            acc = int.from_bytes(bits.data[k : k + 600], "little") >> (at & 7)
    if s > alphabet:
        raise Broken("a run of code lengths is too long")
    bits.at = at
    if at > bits.size:
        raise Broken("the data end early")
    lengths[:s] = row
    out = Prefix(lengths)
    out.last_run = run if s == alphabet and x == 18 else 0
    return out


def fitted_lengths(counts: np.ndarray, most: int = 12) -> np.ndarray:
    """Huffman code lengths of at most `most` bits for symbols with counts."""
    used = np.flatnonzero(counts)
    lengths = np.zeros(len(counts), np.uint8)
    if len(used) < 2:
        lengths[used] = 1
        return lengths
    own, floor = counts[used], 0
    while True:
        weight = np.maximum(own, floor) if floor else own
        order = np.argsort(weight, kind="stable")
        sums, n = weight[order].tolist(), len(used)
        up, leaf, node = [0] * (2 * n - 1), 0, n  # two queues: leaves and joined nodes, both ascending
        for k in range(n, 2 * n - 1):
            if leaf < n and (node >= k or sums[leaf] <= sums[node]):
                total = sums[leaf]
                up[leaf] = k
                leaf += 1
            else:
                total = sums[node]
                up[node] = k
                node += 1
            if leaf < n and (node >= k or sums[leaf] <= sums[node]):
                total += sums[leaf]
                up[leaf] = k
                leaf += 1
            else:
                total += sums[node]
                up[node] = k
                node += 1
            sums.append(total)
        deep = [0] * (2 * n - 1)
        for k in range(2 * n - 3, -1, -1):
            deep[k] = deep[up[k]] + 1
        if max(deep[:n]) <= most:
            lengths[used[order]] = deep[:n]
            return lengths
        floor = max(2 * floor, int(own.sum()) >> most, 1)


_RUNS = re.compile(rb"\0{3,138}|.", re.S)
#: Code lengths and runs of zeros: symbol, extra value, its bits.
_TOKENS = {bytes([k]): (k, 0, 0) for k in range(16)} | {b"\0" * n: (17, n - 3, 3) if n <= 10 else (18, n - 11, 7) for n in range(3, 139)}


def write_prefix(out: BitWriter, lengths: np.ndarray) -> None:
    used = np.flatnonzero(lengths).tolist()
    if len(used) <= 2 and all(s < 256 for s in used):
        used = used or [0]
        out.put(1, 1)
        out.put(len(used) - 1, 1)
        out.put(1, 1)
        for s in used:
            out.put(s, 8)
        return
    tokens = [_TOKENS[m] for m in _RUNS.findall(lengths.tobytes())]
    counts = [0] * 19
    for symbol, _, _ in tokens:
        counts[symbol] += 1
    own = fitted_lengths(np.array(counts), 7)
    codes, bits = canonical(own).tolist(), own.tolist()
    n = max(4, max(i for i, s in enumerate(_CODE_ORDER) if bits[s]) + 1)
    out.values += [0, n - 4, *[bits[s] for s in _CODE_ORDER[:n]], 0]
    out.sizes += [1, 4, *[3] * n, 1]
    if sum(k > 0 for k in bits) == 1:
        codes = bits = [0] * 19
    out.values += [codes[s] | extra << bits[s] for s, extra, _ in tokens]
    out.sizes += [bits[s] + size for s, _, size in tokens]


# --- entropy-coded images --------------------------------------------------------------------


def _extra(symbol: int, bits: Bits) -> int:
    if symbol < 4:
        return symbol + 1
    n = (symbol - 2) >> 1
    return ((2 + (symbol & 1)) << n) + bits.read(n) + 1


def _distance(code: int, width: int) -> int:
    if code > 120:
        return code - 120
    x, y = _NEAR[code - 1]
    return max(1, x + y * width)


class _Group:
    def __init__(self, bits: Bits, cache_size: int):
        start = bits.at
        green = read_prefix(bits, 280 + cache_size)
        at, n = bits.at, bits.at - start
        # when the green code ends in a run of zeros over its further symbols, the same bits with that run shorter make the same code
        run, more = green.last_run, 24 + cache_size
        if run and run - 11 >= more and 2 * n < 1 << 14 and bits.at + n <= bits.size:
            whole = int.from_bytes(bits.data[start >> 3 : (at + n >> 3) + 1], "little") >> (start & 7)
            same = (whole - (more << n - 7)) & ((1 << n) - 1) == whole >> n & ((1 << n) - 1)
        else:
            same = False
        if same:
            self.codes = [green, green]
            bits.at += n
        else:
            self.codes = [green, read_prefix(bits, 256)]
            n = bits.at - at
        cut = lambda a: int.from_bytes(bits.data[a >> 3 : (a + n >> 3) + 1], "little") >> (a & 7) & ((1 << n) - 1)
        want = cut(at)
        for _ in range(2):  # the same bits make the same code
            if bits.at + n <= bits.size and cut(bits.at) == want:
                self.codes.append(self.codes[1])
                bits.at += n
            else:
                self.codes.append(read_prefix(bits, 256))
        self.codes.append(read_prefix(bits, 40))


def read_image(bits: Bits, width: int, height: int, main: bool) -> np.ndarray:
    """Pixels as unsigned 32-bit ARGB, row by row."""
    cache_bits = bits.read(4) if bits.read(1) else 0
    if cache_bits > 11:
        raise Broken("the colour cache is too large")
    tile, which, n = 0, None, 1
    if main and bits.read(1):
        tile = bits.read(3) + 2
        which = read_image(bits, (width + (1 << tile) - 1) >> tile, (height + (1 << tile) - 1) >> tile, False)
        which = (which >> 8 & 0xFFFF).astype(np.int64)
        n = int(which.max()) + 1
    groups = [_Group(bits, 1 << cache_bits if cache_bits else 0) for _ in range(n)]
    if n == 1 and width * height < 2048:  # less than what the steps for all bit positions take
        return _read_tiled(bits, width, height, groups, np.zeros(1, np.int64), 14, cache_bits)
    if n == 1:
        return _read_uniform(bits, width, height, groups[0], cache_bits)
    return _read_tiled(bits, width, height, groups, which, tile, cache_bits)


def _copy(out: np.ndarray, at: int, n: int, d: int) -> None:
    if d > at or at + n > len(out):
        raise Broken("a back-reference leaves the image")
    if d >= n:
        out[at : at + n] = out[at - d : at - d + n]
    else:
        out[at : at + n] = np.resize(out[at - d : at], n)


def _hashes(pixels: np.ndarray, cache_bits: int) -> np.ndarray:
    return (pixels * np.uint32(_CACHE_MUL)) >> np.uint32(32 - cache_bits)


def _again(row: list[int], d: int, n: int, total: int, cache: list[int] | None, cache_bits: int) -> None:
    """Appends n pixels from d places before."""
    at = len(row)
    if d > at or at + n > total:
        raise Broken("a back-reference leaves the image")
    more = row[at - d : at - d + n]
    if d < n:
        more = (more * (n // d + 1))[:n]
    row += more
    if cache is not None:
        for x in more:
            cache[(x * _CACHE_MUL & 0xFFFFFFFF) >> 32 - cache_bits] = x


def _read_on(bits: Bits, codes: list[tuple[list[int], int]], row: list[int], stop: int, total: int, width: int, cache: list[int] | None, cache_bits: int) -> None:
    """Appends pixels one by one until there are `stop`; codes: symbol * 16 + length over the next bits, and the mask of these."""
    (green, in_green), (red, in_red), (blue, in_blue), (alpha, in_alpha), (far, in_far) = codes
    data, number, sub = bits.data, int.from_bytes, Bits(b"")
    sub.data, sub.size = data, bits.size
    k, at, add, shift = bits.at >> 3, len(row), row.append, 32 - cache_bits
    acc, n = number(data[k : k + 32], "little") >> (bits.at & 7), 256 - (bits.at & 7)
    k += 32
    while at < stop:
        if n < 64:  # a pixel has at most 60 bits
            if 8 * k - n > bits.size:
                raise Broken("the data end early")
            acc |= number(data[k : k + 32], "little") << n
            k += 32
            n += 256
        e = green[acc & in_green]
        x, size = e >> 4, e & 15
        acc >>= size
        n -= size
        if x < 256:
            e = red[acc & in_red]
            size = e & 15
            acc >>= size
            n -= size
            f = blue[acc & in_blue]
            size = f & 15
            acc >>= size
            n -= size
            g = alpha[acc & in_alpha]
            size = g & 15
            acc >>= size
            n -= size
            x = g >> 4 << 24 | e >> 4 << 16 | x << 8 | f >> 4
            add(x)
            at += 1
            if cache is not None:
                cache[(x * _CACHE_MUL & 0xFFFFFFFF) >> shift] = x
        elif x >= 280:
            x = cache[x - 280]
            add(x)
            at += 1
            cache[(x * _CACHE_MUL & 0xFFFFFFFF) >> shift] = x
        else:
            sub.at = 8 * k - n
            run = _extra(x - 256, sub)
            e = far[sub.peek(15) & in_far]
            sub.at += e & 15
            d = _distance(_extra(e >> 4, sub), width)
            _again(row, d, run, total, cache, cache_bits)
            at += run
            k, n = sub.at >> 3, -(sub.at & 7)
            acc = number(data[k : k + 32], "little") >> -n
            k += 32
            n += 256
    bits.at = 8 * k - n
    if bits.at > bits.size:
        raise Broken("the data end early")


def _read_tiled(bits: Bits, width: int, height: int, groups: list[_Group], which: np.ndarray, tile: int, cache_bits: int) -> np.ndarray:
    total, at = width * height, 0
    out, row = np.zeros(total, np.uint32), []
    cache = [0] * (1 << cache_bits) if cache_bits else None
    across = (width + (1 << tile) - 1) >> tile
    codes = [[c.both() for c in g.codes] for g in groups]
    wide = across == 1  # then a tile's pixels are one run
    keep = 1 << 22  # pixels held as numbers: at most so many, and a copy's distance more
    while at + len(row) < total:
        y, x = divmod(at + len(row), width)
        stop = min(total, (((y >> tile) + 1) << tile) * width if wide else y * width + min(width, ((x >> tile) + 1) << tile))
        _read_on(bits, codes[int(which[(y >> tile) * across + (x >> tile)])], row, stop - at, total - at, width, cache, cache_bits)
        if len(row) > keep:  # no distance is over 2 ** 20
            n = len(row) - (1 << 20)
            out[at : at + n] = row[:n]
            del row[:n]
            at += n
    out[at:] = row
    return out


_SPAN = 1 << 19


def _read_uniform(bits: Bits, width: int, height: int, group: _Group, cache_bits: int) -> np.ndarray:
    """One group for all pixels: what a pixel starting at each bit would be, for a span of bits at once, then the chain of real starts."""
    green, red, blue, alpha, far = group.codes
    total, at = width * height, 0
    out = np.zeros(total, np.uint32)
    cache = [0] * (1 << cache_bits) if cache_bits else None
    sub = Bits(b"")
    sub.data, sub.size = bits.data, bits.size
    if not any(c.width for c in (green, red, blue, alpha)) and green.symbol[0] < 256:  # no pixel takes a bit
        out[:] = int(alpha.symbol[0]) << 24 | int(red.symbol[0]) << 16 | int(green.symbol[0]) << 8 | int(blue.symbol[0])
        return out
    plain = not (green.symbol >= 256).any()
    alike = plain and red.width and red is blue and red is alpha and (green is red or green.width == red.width and (green.length == red.length).all())
    data = np.frombuffer(bits.data, np.uint8)
    if len(data) < 4096:
        data = np.concatenate([data, np.zeros(64, np.uint8)])
    while at < total:
        base = bits.at
        size = min(_SPAN, bits.size - base + 1, 64 * (total - at) + 64)
        if size <= 0:
            raise Broken("the data end early")
        first = base >> 3
        raw = data[first : first + (size + 200 >> 3) + 16]
        if len(raw) < (size + 200 >> 3) + 16:
            raw = np.concatenate([raw, np.zeros((size + 200 >> 3) + 16 - len(raw), np.uint8)])
        wide = raw[:-3].astype(np.uint32)
        wide |= raw[1:-2].astype(np.uint32) << np.uint32(8)
        wide |= raw[2:-1].astype(np.uint32) << np.uint32(16)
        wide |= raw[3:].astype(np.uint32) << np.uint32(24)
        # the next 16 bits or more at each bit of the span and of what a pixel may reach beyond it
        v = (wide[:, None] >> np.arange(8, dtype=np.uint32)).reshape(-1)
        off = base & 7
        here = np.arange(off, off + size)

        def look(code: Prefix, where: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
            k = v[where] & np.uint32((1 << code.width) - 1)
            return code.symbol[k], where + code.length[k]

        if alike:  # one code for all: a pixel is four steps
            step = (np.arange(len(v), dtype=np.int32) + red.length[v & np.uint32((1 << red.width) - 1)]).astype(np.int32)
            np.minimum(step, len(v) - 1, out=step)
            two = step[step]
            hops = [two[two]]  # one pixel, then 2, 4, 8
            for _ in range(3):
                hops.append(hops[-1][hops[-1]])
        elif plain:
            g, p = look(green, here)
            if red.width:
                p = p + red.length[v[p] & np.uint32((1 << red.width) - 1)]
            if blue.width:
                p = p + blue.length[v[p] & np.uint32((1 << blue.width) - 1)]
            if alpha.width:
                p = p + alpha.length[v[p] & np.uint32((1 << alpha.width) - 1)]
            jump = p.tolist()
        else:
            g, p = look(green, here)
            literal = p
            for code in (red, blue, alpha):
                if code.width:
                    literal = literal + code.length[v[literal] & np.uint32((1 << code.width) - 1)]
            jump_a = np.where(g < 256, literal, p)
            back = np.flatnonzero((g >= 256) & (g < 280))
            if len(back):
                q, _ = p[back], None
                s = g[back].astype(np.int64) - 256
                q = q + np.where(s < 4, 0, (s - 2) >> 1)
                d, q = look(far, q)
                d = d.astype(np.int64)
                jump_a[back] = q + np.where(d < 4, 0, (d - 2) >> 1)
            jump = jump_a.tolist()
        chain, p, end, left = [], off, off + size, total - at
        add = chain.append
        if alike:
            eight, one = hops[3].item, hops[0].item
            stop = end - 480  # a pixel has at most 60 bits
            while p < stop and left >= 8:
                add(p)
                p = eight(p)
                left -= 8
            starts = np.array(chain, np.int64)
            for hop in hops[2::-1]:
                starts = np.stack([starts, hop[starts]], 1).reshape(-1)
            chain = []
            add = chain.append
            while p < end and left:
                add(p)
                p = one(p)
                left -= 1
            starts = np.concatenate([starts, np.array(chain, np.int64)])
        elif plain:
            while p < end and left:
                add(p)
                p = jump[p - off]
                left -= 1
        else:
            kinds = g.tolist()
            while p < end and left > 0:  # how far back-references reach is seen below; a few starts too many do no harm
                add(p)
                s = kinds[p - off]
                if 256 <= s < 280:
                    s -= 256
                    if s < 4:
                        left -= s + 1
                    else:
                        n = (s - 2) >> 1
                        q = p + int(green.length[int(v[p]) & ((1 << green.width) - 1)]) if green.width else p
                        left -= ((2 + (s & 1)) << n) + (int(v[q]) & ((1 << n) - 1)) + 1
                else:
                    left -= 1
                p = jump[p - off]
        if not alike:
            starts = np.array(chain, np.int64)
        bits.at = base - off + p
        if bits.at > bits.size:
            raise Broken("the data end early")
        g, q = look(green, starts)
        r, q2 = look(red, q)
        b, q2 = look(blue, q2)
        a, _ = look(alpha, q2)
        pixels = a.astype(np.uint32) << np.uint32(24) | r.astype(np.uint32) << np.uint32(16) | g.astype(np.uint32) << np.uint32(8) | b.astype(np.uint32)
        if plain:
            out[at : at + len(starts)] = pixels
            at += len(starts)
            continue
        if cache is not None:
            row = []  # the span's pixels, from `at` on
            add = row.append
            for x, h, s, k in zip(pixels.tolist(), _hashes(pixels, cache_bits).tolist(), g.tolist(), q.tolist()):
                if s < 256:
                    add(x)
                    cache[h] = x
                elif s >= 280:
                    x = cache[s - 280]
                    add(x)
                    if not x:  # of a place that nothing was put in yet
                        cache[0] = 0
                else:
                    sub.at = base - off + k
                    n = _extra(s - 256, sub)
                    d = _distance(_extra(far.read(sub), sub), width)
                    first = len(row) - d
                    if at + first < 0 or at + len(row) + n > total:
                        raise Broken("a back-reference leaves the image")
                    more = row[first : first + n] if first >= 0 else out[at + first : min(at, at + first + n)].tolist()
                    if first < 0:
                        more += row[: max(0, min(n, d) - len(more))]
                    if d < n:
                        more = (more * (n // d + 1))[:n]
                    row += more
                    for x in more:
                        cache[(x * _CACHE_MUL & 0xFFFFFFFF) >> 32 - cache_bits] = x
            out[at : at + len(row)] = row
            at += len(row)
            continue
        special, done = np.flatnonzero(g >= 256), 0
        for k in special.tolist():
            n = k - done
            out[at : at + n] = pixels[done:k]
            at += n
            sub.at = base - off + int(q[k])
            n = _extra(int(g[k]) - 256, sub)
            _copy(out, at, n, _distance(_extra(far.read(sub), sub), width))
            at += n
            done = k + 1
        n = len(starts) - done
        out[at : at + n] = pixels[done:]
        at += n
    return out


# --- transforms ------------------------------------------------------------------------------


def _channels(p: np.ndarray) -> np.ndarray:
    return p.astype("<u4").view(np.uint8).reshape(*p.shape, 4)  # blue, green, red, alpha


def _pixels(c: np.ndarray) -> np.ndarray:
    return np.ascontiguousarray(c).view("<u4").reshape(c.shape[:-1])


def _average(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return ((a.astype(np.int16) + b) >> 1).astype(np.int16)


def _predict(mode: int, left, top, tl, tr):
    """All of int16, last axis the channels."""
    if mode == 0 or mode > 13:
        return np.array([0, 0, 0, 255], np.int16)
    if mode <= 4:
        return (left, top, tr, tl)[mode - 1]
    if mode == 5:
        return _average(_average(left, tr), top)
    if mode in (6, 7, 8, 9):
        return _average(*((left, tl), (left, top), (tl, top), (top, tr))[mode - 6])
    if mode == 10:
        return _average(_average(left, tl), _average(top, tr))
    if mode == 11:
        # nearness of the estimate left + top - tl to either side, summed over channels
        to_left, to_top = np.abs(top - tl).sum(-1, keepdims=True), np.abs(left - tl).sum(-1, keepdims=True)
        return np.where(to_left < to_top, left, top)
    if mode == 12:
        return np.clip(left + top - tl, 0, 255)
    mean = _average(left, top)
    half = mean - tl
    return np.clip(mean + ((half + (half < 0)) >> 1), 0, 255)


def inverse_predictor(res: np.ndarray, modes: np.ndarray, tile: int) -> np.ndarray:
    """res: pixels by row; modes: one for each tile."""
    height, width = res.shape
    c = _channels(res).astype(np.int16)
    out = np.zeros((height, width, 4), np.int16)
    out[0, 0] = (c[0, 0] + [0, 0, 0, 255]) & 255
    if width > 1:
        out[0, 1:] = (np.cumsum(np.concatenate([out[0, :1], c[0, 1:]]).astype(np.int64), 0)[1:]) & 255
    for y in range(1, height):
        top = out[y - 1]
        out[y, 0] = (c[y, 0] + top[0]) & 255
        flat = np.concatenate([top, out[y, :1]])  # the right neighbour above of the last column is this row's first pixel
        row = modes[y >> tile]
        x = 1
        while x < width:
            mode = int(row[x >> tile])
            stop = min(width, ((x >> tile) + 1) << tile)
            while stop < width and int(row[stop >> tile]) == mode:
                stop = min(width, stop + (1 << tile))
            if mode in (0, 2, 3, 4, 8, 9) or mode > 13:  # needs no pixel of this row
                out[y, x:stop] = (c[y, x:stop] + _predict(mode, None, top[x:stop], top[x - 1 : stop - 1], flat[x + 1 : stop + 1])) & 255
            elif mode == 1:
                out[y, x:stop] = (out[y, x - 1] + np.cumsum(c[y, x:stop].astype(np.int64), 0)) & 255
            else:
                for k in range(x, stop):
                    out[y, k] = (c[y, k] + _predict(mode, out[y, k - 1], top[k], top[k - 1], flat[k + 1])) & 255
            x = stop
    return _pixels(out.astype(np.uint8))


def inverse_colour(p: np.ndarray, tiles: np.ndarray, tile: int) -> np.ndarray:
    height, width = p.shape
    c = _channels(p).copy()
    t = _channels(tiles)[np.arange(height)[:, None] >> tile, np.arange(width)[None] >> tile].view(np.int8).astype(np.int32)
    to_red, to_blue, red_to_blue = t[..., 0], t[..., 1], t[..., 2]
    green = c[..., 1].view(np.int8).astype(np.int32)
    red = (c[..., 2] + ((to_red * green) >> 5)) & 255
    blue = c[..., 0] + ((to_blue * green) >> 5) + ((red_to_blue * red.astype(np.uint8).view(np.int8).astype(np.int32)) >> 5)
    c[..., 2], c[..., 0] = red, blue & 255
    return _pixels(c)


def add_green(p: np.ndarray) -> np.ndarray:
    c = _channels(p).copy()
    c[..., 0] += c[..., 1]
    c[..., 2] += c[..., 1]
    return _pixels(c)


def inverse_palette(p: np.ndarray, palette: np.ndarray, width: int, packed: int) -> np.ndarray:
    """packed: log2 of the pixels in one."""
    index = (p >> 8 & 255).astype(np.int64)
    if packed:
        size = 8 >> packed
        index = (index[:, :, None] >> (np.arange(1 << packed) * size) & ((1 << size) - 1)).reshape(p.shape[0], -1)[:, :width]
    full = np.zeros(256, np.uint32)
    full[: len(palette)] = palette
    return full[index]


def decode_vp8l(data: bytes) -> np.ndarray:
    """Pixels as unsigned 32-bit ARGB by row."""
    bits = Bits(data)
    if bits.read(8) != 0x2F:
        raise Broken("not a lossless image")
    width, height = bits.read(14) + 1, bits.read(14) + 1
    bits.read(1)
    if bits.read(3):
        raise Broken("an unknown version")
    todo, now, seen = [], width, set()
    while bits.read(1):
        kind = bits.read(2)
        if kind in seen:
            raise Broken("a transform comes twice")
        seen.add(kind)
        if kind in (0, 1):
            tile = bits.read(3) + 2
            w, h = (now + (1 << tile) - 1) >> tile, (height + (1 << tile) - 1) >> tile
            todo.append((kind, read_image(bits, w, h, False).reshape(h, w), tile))
        elif kind == 2:
            todo.append((2, None, 0))
        else:
            n = bits.read(8) + 1
            steps = _channels(read_image(bits, n, 1, False).reshape(1, n))[0]
            palette = _pixels(np.cumsum(steps.astype(np.int64), 0).astype(np.uint8)[None])[0]
            packed = 3 if n <= 2 else 2 if n <= 4 else 1 if n <= 16 else 0
            todo.append((3, palette, (now, packed)))
            now = (now + (1 << packed) - 1) >> packed
    p = read_image(bits, now, height, True).reshape(height, now)
    for kind, what, how in reversed(todo):
        if kind == 0:
            p = inverse_predictor(p, (what >> 8 & 255).astype(np.int64), how)
        elif kind == 1:
            p = inverse_colour(p, what, how)
        elif kind == 2:
            p = add_green(p)
        else:
            p = inverse_palette(p, what, *how)
    return p


def decode(data: bytes) -> np.ndarray:
    """A WebP file's pixels (height, width, 4): alpha, red, green, blue."""
    if data[:4] != b"RIFF" or data[8:12] != b"WEBP":
        raise Broken("not a WebP file")
    at, end = 12, min(len(data), 8 + struct.unpack("<I", data[4:8])[0])
    while at + 8 <= end:
        name, size = data[at : at + 4], struct.unpack("<I", data[at + 4 : at + 8])[0]
        if name == b"VP8L":
            if at + 8 + size > len(data):
                raise Broken("the data end early")
            return _channels(decode_vp8l(data[at + 8 : at + 8 + size]))[..., ::-1]
        at += 8 + size + (size & 1)
    raise Broken("no lossless image in the file")


# --- encoder ---------------------------------------------------------------------------------


def _prefix_of(value: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(symbol, extra value, its bits) of lengths or distance codes from 1 on."""
    v = value.astype(np.int64) - 1
    high = np.frexp(np.maximum(v, 1).astype(np.float64))[1] - 1
    n = np.maximum(high - 1, 0)
    symbol = np.where(v < 4, v, 2 * high + (v >> n & 1))
    return symbol, np.where(v < 4, 0, v & ((1 << n) - 1)), np.where(v < 4, 0, n)


_PLACES = np.arange(4) * 256
#: Bits that a used symbol takes in a code's own description, about.
_USED_BITS = 3


def _histogram(c: np.ndarray) -> np.ndarray:
    """Counts of the four channels of pixels (n, 4)."""
    return np.bincount((c + _PLACES).reshape(-1), minlength=1024).reshape(4, 256)


def _price(counts: np.ndarray, used_bits: int = _USED_BITS) -> np.ndarray:
    """Bits of what the last axis counts, by entropy, and of the code's description."""
    x = counts.astype(np.float64)
    total = x.sum(-1)
    return total * np.log2(np.maximum(total, 1)) - (x * np.log2(np.maximum(x, 1))).sum(-1) + used_bits * np.count_nonzero(counts, -1)


def _distinct(p: np.ndarray) -> np.ndarray:
    s = np.sort(p, axis=None)
    return s[np.flatnonzero(np.diff(s, prepend=s[0] ^ np.uint32(1)))]


def _estimate(p: np.ndarray, new: np.ndarray | None = None) -> float:
    """Bits of pixels: new ones (if given: these) by channel, the others by a cache of all."""
    new = _distinct(p) if new is None else new
    return float(_price(_histogram(_channels(new))).sum()) + (p.size - len(new)) * (1 + np.log2(len(new) + 1))


def subtract_green(p: np.ndarray) -> np.ndarray:
    c = _channels(p).copy()
    c[..., 0] -= c[..., 1]
    c[..., 2] -= c[..., 1]
    return _pixels(c)


def _tile_bits(height: int, width: int, least: int, tiles: int) -> int:
    """The smallest tile of at least 2 ** least pixels a side of which an image has at most so many."""
    tile = least
    while tile < 9 and ((height - 1 >> tile) + 1) * ((width - 1 >> tile) + 1) > tiles:
        tile += 1
    return tile


def forward_predictor(p: np.ndarray, tile: int) -> tuple[np.ndarray, np.ndarray]:
    """(what is left of the pixels, modes by tile): in each tile the mode of the 14 that leaves the lowest entropy."""
    height, width = p.shape
    c = _channels(p)
    left = c.copy()
    left[:, 1:] -= c[:, :-1]
    left[1:, 0] -= c[:-1, 0]
    left[0, 0, 3:] -= 255
    across = (width - 1 >> tile) + 1
    modes = np.zeros(((height - 1 >> tile) + 1, across), np.int64)
    strip = max(1, (1 << 17 >> tile) // width) << tile
    for y in range(0, height, strip):
        a, b = max(1, y), min(height, y + strip)
        if a >= b or width < 2:
            continue
        here, over = c[a:b].astype(np.int16), c[a - 1 : b - 1].astype(np.int16)
        where = ((np.arange(a, b) >> tile) - (y >> tile))[:, None] * across + (np.arange(1, width) >> tile)
        spread = where[..., None] * 1024 + _PLACES
        sides = here[:, :-1], over[:, 1:], over[:, :-1], np.concatenate([over[:, 2:], here[:, :1]], 1)  # right above the last column is this row's first pixel
        tiles = int(where.max()) + 1
        best, chosen, rest = np.full(tiles, np.inf), np.zeros(tiles, np.int64), left[a:b, 1:]
        for mode in range(14):
            r = ((here[:, 1:] - _predict(mode, *sides)) & 255).astype(np.uint8)
            bits = _price(np.bincount((spread + r).reshape(-1), minlength=1024 * tiles).reshape(tiles, 4, 256)).sum(-1)
            better = bits < best
            best[better], chosen[better] = bits[better], mode
            mask = better[where]
            rest[mask] = r[mask]
        modes[y >> tile : (b - 1 >> tile) + 1].reshape(-1)[:] = chosen
    return _pixels(left), modes


def _take_colour(c: np.ndarray, t: np.ndarray) -> np.ndarray:
    """Channels less what the multipliers of each pixel's tile tell."""
    out, green, red = c.copy(), c[..., 1].astype(np.int8).astype(np.int32), c[..., 2].astype(np.int8).astype(np.int32)
    out[..., 2] = (c[..., 2] - ((t[..., 0] * green) >> 5)) & 255
    out[..., 0] = (c[..., 0] - ((t[..., 1] * green) >> 5) - ((t[..., 2] * red) >> 5)) & 255
    return out


def forward_colour(p: np.ndarray, tile: int) -> tuple[np.ndarray, np.ndarray] | None:
    """(pixels, multipliers by tile as pixels) with least-squares slopes where they lower a tile's entropy; None where none do."""
    height, width = p.shape
    c = _channels(p)
    if p.size <= 4096:  # in small images first whether correlation over all tiles could save more than the tiles take
        x = c.reshape(-1, 4)[:, :3].astype(np.int8).astype(np.float32)
        x -= x.mean(0)
        m = (x.T @ x).tolist()
        alike = (m[i][j] ** 2 / (m[i][i] * m[j][j]) if m[i][i] and m[j][j] else 0.0 for i, j in ((1, 2), (1, 0), (2, 0)))
        if sum(-0.5 * p.size * np.log2(max(1 - r, 1e-6)) for r in alike) < 60:
            return None
    across = (width - 1 >> tile) + 1
    where = (np.arange(height) >> tile)[:, None] * across + (np.arange(width) >> tile)
    at = where.reshape(-1)
    n = np.bincount(at)
    signed = lambda x: x.reshape(-1).astype(np.int8).astype(np.float64)
    blue, green, red = signed(c[..., 0]), signed(c[..., 1]), signed(c[..., 2])

    def slope(x: np.ndarray, y: np.ndarray) -> np.ndarray:
        sx, sy = np.bincount(at, x), np.bincount(at, y)
        both, var = np.bincount(at, x * y) - sx * sy / n, np.bincount(at, x * x) - sx * sx / n
        m = np.clip(np.rint(32 * both / np.maximum(var, 1)), -128, 127).astype(np.int32)
        return np.where(np.abs(m) < 6, 0, m)  # such a slope takes under 0.03 bits off a pixel

    to_red, to_blue = slope(green, red), slope(green, blue)
    red_to_blue = slope(red, blue - to_blue[at] * green / 32)
    t = np.stack([to_red, to_blue, red_to_blue], 1)
    if not t.any():
        return None
    bits = lambda c, k: _price(np.bincount(at * 256 + c[..., k].reshape(-1), minlength=256 * len(n)).reshape(-1, 256))
    new = _take_colour(c, t[where])
    t[bits(new, 2) >= bits(c, 2), 0] = 0
    t[bits(new, 0) >= bits(c, 0), 1:] = 0
    if not t.any():
        return None
    tiles = np.zeros((len(n), 4), np.uint8)
    tiles[:, :3], tiles[:, 3] = t.astype(np.int8).view(np.uint8), 255
    return _pixels(_take_colour(c, t[where])), _pixels(tiles).reshape(-1, across)


#: Earlier places of the same two pixels that are tried for a copy.
_CHAIN = 8


@cache
def _near_codes(width: int) -> dict[int, int]:
    """Distance: code of the near distances, the first of those that are alike."""
    return {max(1, x + y * width): k + 1 for k, (x, y) in reversed(list(enumerate(_NEAR)))}


def _copies(p: np.ndarray, width: int, price: float) -> list[tuple[int, int, int]]:
    """(place, length, distance code) of copies that are shorter than their pixels at this price each."""
    total = len(p)
    if total < 2:
        return []
    key = p[:-1].astype(np.uint64) << np.uint64(32) | p[1:]
    order = np.argsort(key, kind="stable")
    key = key[order]
    same = np.flatnonzero(key[1:] == key[:-1])
    if not len(same):
        return []
    before = np.full(total, -1, np.int64)
    before[order[same + 1]] = order[same]
    del key, order, same
    return _chosen(before, p, width, price)


def _chosen(before: np.ndarray, p: np.ndarray, width: int, price: float) -> list[tuple[int, int, int]]:
    """The copies of `_copies`; before: the last place of the same two pixels, or -1."""
    total = len(p)
    places, near, out, end = np.flatnonzero(before >= 0), _near_codes(width), [], 0
    # lists are faster, and take ten times the memory
    places, earlier, pixel = (x.tolist() if total < 1 << 16 else memoryview(np.ascontiguousarray(x)) for x in (places, before, p))
    for i in places:
        if i < end:
            continue
        j, tries, gain, most = earlier[i], _CHAIN, 0.0, min(4096, total - i)
        while j >= 0 and tries and i - j <= (1 << 20) - 120:
            n, soon = 2, min(most, 24)
            while n < soon and pixel[j + n] == pixel[i + n]:
                n += 1
            if n == soon < most:
                differ = p[j + n : j + most] != p[i + n : i + most]
                n += int(differ.argmax()) if differ.any() else most - n
            code = near.get(i - j) or i - j + 120
            g = n * price - 8 - code.bit_length() - n.bit_length()
            if g > gain:
                gain, found = g, (i, n, code)
            if n == most:
                break
            j, tries = earlier[j], tries - 1
        if gain > 0:
            out.append(found)
            end = i + found[1]
    return out


def _cached(p: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """(places in a colour cache of so many bits, whether the pixel is there)."""
    h = _hashes(p, bits).astype(np.int64)
    order = np.argsort(h, kind="stable")
    hit, place, q = np.zeros(len(p), bool), h[order], p[order]
    hit[order[1:]] = (place[1:] == place[:-1]) & (q[1:] == q[:-1])
    return h, hit


def _best_cache(p: np.ndarray, c: np.ndarray, alone: np.ndarray, lengths: np.ndarray) -> int:
    """Bits of the colour cache with the lowest price, of three sizes and none (0)."""
    own = c[alone]
    if not len(own) or len(_distinct(p)) == len(p):
        return 0

    def price(bits: int) -> float:
        green = np.zeros(280 + (1 << bits if bits else 0), np.int64)
        green[256:280] = lengths
        literal, more = own, 0.0
        if bits:
            h, hit = _cached(p, bits)
            h, hit = h[alone], hit[alone]
            if not hit.any():
                return np.inf
            green[280:] = np.bincount(h[hit], minlength=1 << bits)
            literal, more = own[~hit], 6.0 * np.count_nonzero(green[280:])  # places are far between, and zeros are told too
        each = _histogram(literal)
        green[:256] = each[1]
        return float(_price(green) + _price(each[[0, 2, 3]]).sum()) + more

    tried = {k: price(k) for k in (0, 4, 7, 10) if not k or 1 << k <= 4 * len(p)}
    return min(tried, key=tried.get)


def _groups(counts: np.ndarray) -> np.ndarray:
    """A group for each tile of which the symbols are counted: a group more as long as that is shorter in all."""
    group, best = np.zeros(len(counts), np.int64), float(_price(counts.sum(0)[None]).sum())
    x = counts.astype(np.float32)
    while group.max() < 255:
        n = int(group.max()) + 1
        sums = np.stack([x[group == k].sum(0) for k in range(n)])
        cost = lambda sums: x @ np.log2((sums.sum(1, keepdims=True) + 1) / (sums + 0.02)).T.astype(np.float32)
        excess = cost(sums)[np.arange(len(x)), group] - (x * np.log2(np.maximum(x.sum(1, keepdims=True), 1) / np.maximum(x, 1))).sum(1)
        sums = np.concatenate([sums, x[int(excess.argmax())][None]])
        for _ in range(4):
            new = cost(sums).argmin(1)
            sums = np.stack([x[new == k].sum(0) for k in range(n + 1)])
        _, new = np.unique(new, return_inverse=True)
        price = sum(float(_price(counts[new == k].sum(0))) + 100 for k in range(int(new.max()) + 1)) + 2 * len(new)
        if new.max() < n or price >= best:
            return group
        group, best = new, price
    return group


#: Images of fewer pixels have one group of codes: a second one's description is longer than what it could save.
_GROUPED_PIXELS = 1024


def _put_image(out: BitWriter, image: np.ndarray, main: bool) -> tuple[np.ndarray, np.ndarray]:
    """Writes all but the pixels themselves; returns (values, sizes) of these."""
    height, width = image.shape
    p = image.reshape(-1)
    c = _channels(p)
    found = np.array(_copies(p, width, float(_price(_histogram(c)).sum()) / len(p)), np.int64).reshape(-1, 3)
    edge = np.zeros(len(p) + 1, np.int64)
    edge[found[:, 0]] += 1
    np.subtract.at(edge, found[:, 0] + found[:, 1], 1)
    alone = np.cumsum(edge[:-1]) == 0
    n_symbol, n_extra, n_size = _prefix_of(found[:, 1])
    d_symbol, d_extra, d_size = _prefix_of(found[:, 2])
    cache_bits = _best_cache(p, c, alone, np.bincount(n_symbol, minlength=24))
    symbol = c[:, 1].astype(np.int64)
    plain = alone.copy()
    if cache_bits:
        h, hit = _cached(p, cache_bits)
        hit &= alone
        symbol[hit], plain = 280 + h[hit], alone & ~hit
    symbol[found[:, 0]] = 256 + n_symbol
    starts = alone
    starts[found[:, 0]] = True
    at = np.flatnonzero(starts)
    symbol, kept = symbol[at], c[at]
    literal, copy = np.flatnonzero(plain[at]), np.searchsorted(at, found[:, 0])
    greens = 280 + (1 << cache_bits if cache_bits else 0)

    def counted(key: np.ndarray | int, n: int) -> np.ndarray:
        """Counts of green, red, blue, alpha and distance symbols by key, side by side."""
        key = np.broadcast_to(key, symbol.shape)
        one = lambda key, s, size: np.bincount(key * size + s, minlength=n * size).reshape(n, size)
        return np.concatenate([one(key, symbol, greens), *(one(key[literal], kept[literal, k].astype(np.int64), 256) for k in (2, 0, 3)), one(key[copy], d_symbol, 40)], 1)

    out.put(1 if cache_bits else 0, 1)
    if cache_bits:
        out.put(cache_bits, 4)
    group, n_groups = np.zeros(len(at), np.int64), 1
    if main:
        tile = _tile_bits(height, width, 4, 256)
        across = (width - 1 >> tile) + 1
        of_tile = np.zeros(1, np.int64)
        if len(p) >= _GROUPED_PIXELS:
            where = (at // width >> tile) * across + (at % width >> tile)
            of_tile = _groups(counted(where, ((height - 1 >> tile) + 1) * across))
        n_groups = int(of_tile.max()) + 1
        out.put(int(n_groups > 1), 1)
        if n_groups > 1:
            out.put(tile - 2, 3)
            _put_whole(out, (of_tile << 8).astype(np.uint32).reshape(-1, across))
            group = of_tile[where]
    counts = counted(group, n_groups)
    codes, bits = np.zeros(counts.shape, np.int64), np.zeros(counts.shape, np.int64)
    ends = np.cumsum([0, greens, 256, 256, 256, 40])
    for g in range(n_groups):
        for a, b in zip(ends[:-1], ends[1:]):
            lengths = fitted_lengths(counts[g, a:b])
            write_prefix(out, lengths)
            if np.count_nonzero(lengths) > 1:
                codes[g, a:b], bits[g, a:b] = canonical(lengths), lengths
    value, size = np.zeros((len(at), 2), np.int64), np.zeros((len(at), 2), np.int64)
    value[:, 0], size[:, 0] = codes[group, symbol], bits[group, symbol]
    g, (red, blue, alpha) = group[literal], (kept[literal, k] + e for k, e in zip((2, 0, 3), ends[1:4]))
    value[literal, 0] |= codes[g, red] << size[literal, 0]
    size[literal, 0] += bits[g, red]
    value[literal, 1] = codes[g, blue] | codes[g, alpha] << bits[g, blue]
    size[literal, 1] = bits[g, blue] + bits[g, alpha]
    g, far = group[copy], d_symbol + ends[4]
    value[copy, 0] |= n_extra << size[copy, 0]
    size[copy, 0] += n_size
    value[copy, 1] = codes[g, far] | d_extra << bits[g, far]
    size[copy, 1] = bits[g, far] + d_size
    return value.reshape(-1), size.reshape(-1)


def _put_whole(out: BitWriter, image: np.ndarray) -> None:
    """An image of a transform or of groups."""
    value, size = _put_image(out, image, False)
    out.values += value.tolist()
    out.sizes += size.tolist()


def _transform(out: BitWriter, p: np.ndarray) -> np.ndarray:
    """Writes the transforms that make the image shortest by estimate; returns what is left of it."""
    height, width = p.shape
    colours = _distinct(p)
    plain = _estimate(p, colours)
    if len(colours) <= 256:
        index = np.searchsorted(colours, p)
        steps = _pixels(np.diff(_channels(colours), axis=0, prepend=np.zeros((1, 4), np.uint8)))
        packed = 3 if len(colours) <= 2 else 2 if len(colours) <= 4 else 1 if len(colours) <= 16 else 0
        wide = np.pad(index, ((0, 0), (0, -width % (1 << packed)))).reshape(height, -1, 1 << packed)
        index = (wide << (np.arange(1 << packed) * (8 >> packed))).sum(-1)
        by_palette = float(_price(np.bincount(index.reshape(-1), minlength=256)) + _price(_histogram(_channels(steps))).sum())
    else:
        by_palette = np.inf
    best, now, todo = plain, p, []
    green = subtract_green(p)
    bits = _estimate(green)
    if bits < best:
        best, now, todo = bits, green, [(2, None, 0)]
    # all modes by tile only where a single one is near: to the left, or above
    above = _channels(now).copy()
    above[1:] -= _channels(now)[:-1]
    beside = np.diff(_channels(now.reshape(-1)), axis=0, prepend=np.zeros((1, 4), np.uint8))
    tile = _tile_bits(height, width, 4, 2048)
    if min(_estimate(_pixels(above)), _estimate(_pixels(beside))) < 1.05 * best:
        rest, modes = forward_predictor(now, tile)
        bits = _estimate(rest) + float(_price(np.bincount(modes.reshape(-1)))) + 30
        if bits < best:
            best, now = bits, rest
            todo.append((0, (modes << 8).astype(np.uint32), tile))
    coloured = forward_colour(now, tile)
    if coloured:
        bits = _estimate(coloured[0]) + _estimate(coloured[1]) + 60
        if bits < best:
            best, now = bits, coloured[0]
            todo.append((1, coloured[1], tile))
    if by_palette < best:
        now, todo = (index << 8).astype(np.uint32), [(3, steps[None], len(colours))]
    for kind, image, how in todo:
        out.put(1 | kind << 1, 3)
        if kind == 3:
            out.put(how - 1, 8)
        elif kind < 2:
            out.put(how - 2, 3)
        if image is not None:
            _put_whole(out, image)
    out.put(0, 1)
    return now


def encode_vp8l(p: np.ndarray) -> bytes:
    """p: unsigned 32-bit ARGB (height, width).  Transforms, copies, colour cache and groups of fitted codes, each where it makes the image shorter by estimate."""
    height, width = p.shape
    out = BitWriter()
    for value, n in ((0x2F, 8), (width - 1, 14), (height - 1, 14), (1, 1), (0, 3)):
        out.put(value, n)
    return out.bytes(_put_image(out, _transform(out, p), True))


def riff(body: bytes) -> bytes:
    """The file of an image's own bytes."""
    pad = b"\0" * (len(body) & 1)
    return b"RIFF" + struct.pack("<I", 12 + len(body) + len(pad)) + b"WEBPVP8L" + struct.pack("<I", len(body)) + body + pad


def encode(p: np.ndarray) -> bytes:
    """A WebP file of pixels (height, width, 4): alpha, red, green, blue."""
    return riff(encode_vp8l(_pixels(p[..., ::-1].astype(np.uint8))))


# --- texts -----------------------------------------------------------------------------------


def payload_of(text: str | None) -> tuple[bytes, int]:
    raw = (text or "").encode("utf-8", "surrogatepass")
    return raw + b"\0" * (-len(raw) % 64 if raw else 64), len(raw)


def store(payload: bytes) -> bytes:
    pixels = len(payload) // 4
    width = 16 * -(-pixels // (16 * 16384))
    if width > 16384:
        raise ValueError("a payload of over 1 GiB needs more than one image")
    height = -(-pixels // width)
    return encode(np.frombuffer(payload.ljust(4 * width * height, b"\0"), np.uint8).reshape(height, width, 4))


def load(media: bytes, payload_bytes: int) -> bytes:
    return decode(media).tobytes()[:payload_bytes]


_POWERS = np.stack([np.arange(256), np.arange(256) ** 2])


def _feature(b: np.ndarray, shape: str) -> str:
    """Size, mean, deviation, byte entropy, and a 64-bit hash of which 64th parts are above the mean."""
    counts, n = np.bincount(b, minlength=256), len(b)
    total, squares = (int(x) for x in _POWERS @ counts)
    share = counts[counts > 0] / n
    parts = b.reshape(64, -1).sum(1, dtype=np.int64) * 64 > total
    return f"{shape};{total / n:.4f};{math.sqrt(n * squares - total * total) / n:.4f};{-(share * np.log2(share)).sum():.4f};{np.packbits(parts).tobytes().hex()}"


def media(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes, payload_bytes, media."""
    from . import webp_many

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in common.slices(batches, size=4 << 20):
            found = [payload_of(t) for t in common.texts_of(b)]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array([n for _, n in found], pa.int64()), pa.array([len(p) for p, _ in found], pa.int64()), pa.array(webp_many.store([p for p, _ in found]), pa.binary())], ["doc_id", "n_bytes", "payload_bytes", "media"])

    return common.in_arrow(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), run, "doc_id long, n_bytes long, payload_bytes long, media binary")


def features(stored: DataFrame) -> DataFrame:
    """What op10 returns, from media as read back."""
    from . import webp_many

    names = ["doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in common.slices(batches, "media", rows=4000, size=4 << 20):
            cols: list[list] = [[] for _ in range(6)]
            files = b.column("media").to_pylist()
            for m, n, p in zip(files, b.column("payload_bytes").to_pylist(), webp_many.load(files)):
                raw = p.tobytes()[:n]
                for c, x in zip(cols, (len(raw), hashlib.sha256(raw).hexdigest(), zlib.crc32(raw[-64:]), len(m), hashlib.sha256(m).hexdigest(), _feature(np.frombuffer(raw, np.uint8), f"{p.shape[1]}x{p.shape[0]}"))):
                    c.append(x)
            kinds = [pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("n_bytes"), *[pa.array(c, k) for c, k in zip(cols, kinds)]], names)

    return common.in_arrow(stored, run, "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string")
