"""Operator 10 for many short texts at once: the same files and pixels as `webp.store` and `webp.decode`.

A text of 2 KB is an image of 500 pixels, and most of the time goes into calls for each image.  Here the images of a
batch share these calls: estimates, cache and codes are computed from arrays over all their pixels, and codes and pixels
are read in step, one symbol of every image at a time.

Plain images (no transform, one group of codes) of up to 16,384 pixels are written here.  Where an estimate speaks for
a transform or for several groups, and for longer payloads, `webp.store` writes the image alone; files that aren't of
the plain form, are broken, or have over 2 ** 18 pixels go to `webp.decode`.  A test compares both byte by byte.
"""

from __future__ import annotations

import struct

import numpy as np

from . import webp

#: Pixels of an image that is written with others, and of a block of such images (one batch of texts); images of a block.
_MOST, _BLOCK, _IMAGES = 1 << 14, 9 << 17, 2048
_N_LOG = np.arange(4 * _MOST + 1) * np.log2(np.maximum(np.arange(4 * _MOST + 1), 1))
_LESS = _N_LOG - webp._USED_BITS * (_N_LOG + np.arange(len(_N_LOG)) > 0)


def _price(counts: np.ndarray) -> np.ndarray:
    """webp._price, from a table."""
    return _N_LOG[counts.sum(-1)] - _LESS[counts].sum(-1)


def _histogram(owner: np.ndarray, c: np.ndarray, n: int) -> np.ndarray:
    """Counts (n, 4, 256) of the channels of each owner's pixels."""
    at, out = owner << 8, np.empty((n, 4, 256), np.int64)
    for k in range(4):
        out[:, k] = np.bincount(at | c[:, k], minlength=n << 8).reshape(n, 256)
    return out


def _starts(sizes: np.ndarray) -> np.ndarray:
    return np.cumsum(sizes) - sizes


def _within(sizes: np.ndarray) -> np.ndarray:
    """0, 1, ... for each of the runs."""
    return np.arange(int(sizes.sum())) - np.repeat(_starts(sizes), sizes)


# --- codes -----------------------------------------------------------------------------------


def _joined(code: np.ndarray, weight: np.ndarray, n: np.ndarray) -> np.ndarray:
    """Huffman depths of weights; code: 0, 1, ... in ascending order, each with n >= 2 weights."""
    key = np.sort((code << 40) | (weight << 12) | _within(n))
    by_size = np.argsort(-n, kind="stable")  # codes that still join are the first ones
    size, base = n[by_size], (_starts(n + 1))[by_size]
    total, far = int((n + 1).sum()), np.int64(1) << 50
    sums = np.full(2 * total, far)
    sums[:total] = 2 * far
    leaves = np.arange(len(key)) + code  # one place more after each code's leaves
    sums[leaves] = key >> 12 & ((1 << 28) - 1)
    up = np.zeros(2 * total, np.int64)
    leaf, node, new = base.copy(), base + total, base + total
    active = np.searchsorted(-size, -np.arange(1, int(size[0]) + 1), side="right")  # [k]: codes of more than k leaves
    for k in range(int(size[0]) - 1):
        a = int(active[k + 1])
        parent, both = new[:a] + k, None
        for _ in range(2):
            x, y = leaf[:a], node[:a]
            sx, sy = sums[x], sums[y]
            take = sx <= sy
            up[np.where(take, x, y)] = parent
            both = np.where(take, sx, sy) if both is None else both + np.where(take, sx, sy)
            leaf[:a] += take
            node[:a] += ~take
        sums[parent] = both
    deep = np.zeros(2 * total, np.int64)
    for k in range(1, int(size[0]) - 1):  # from each root down
        a = int(active[k + 1])
        at = new[:a] + size[:a] - 2 - k
        deep[at] = deep[up[at]] + 1
    depth = np.zeros(len(key), np.int64)
    depth[np.repeat(_starts(n), n) + (key & 0xFFF)] = deep[up[leaves]] + 1
    return depth


def _fitted(code: np.ndarray, count: np.ndarray, most: int) -> np.ndarray:
    """webp.fitted_lengths for the used symbols of many codes, in ascending order of code and symbol."""
    lengths = np.ones(len(code), np.int64)
    ids, of, n = np.unique(code, return_inverse=True, return_counts=True)
    total = np.bincount(of, count, minlength=len(ids)).astype(np.int64)
    todo, floor = n > 1, np.zeros(len(ids), np.int64)
    while todo.any():
        mine = todo[of]
        rank = np.cumsum(todo) - 1
        depth = _joined(rank[of[mine]], np.maximum(count[mine], floor[of[mine]]), n[todo])
        lengths[mine] = depth
        deepest = np.maximum.reduceat(depth, _starts(n[todo]))
        todo[np.flatnonzero(todo)[deepest <= most]] = False
        floor = np.maximum(np.maximum(2 * floor, total >> most), 1)
    return lengths


def _canonical(code: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """webp.canonical for the used symbols of many codes, in ascending order of code and symbol."""
    order = np.sort((code << 40) | (lengths << 32) | np.arange(len(code))) & 0xFFFFFFFF
    part = np.int64(1) << (16 - lengths[order])
    before = np.cumsum(part) - part
    owner = code[order]
    first = np.flatnonzero(np.diff(owner, prepend=-1))
    before -= np.repeat(before[first], np.diff(np.append(first, len(owner))))
    out = np.zeros(len(code), np.int64)
    out[order] = webp._REVERSED[before]
    return out


def _described(lengths: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """What webp.write_prefix writes for each code: (code, value, size) of fields in order; ends: where each code's lengths end."""
    n_codes, begin = len(ends), np.concatenate([[0], ends[:-1]])
    used = np.flatnonzero(lengths)
    code_of = np.searchsorted(ends, used, side="right")
    n_used = np.bincount(code_of, minlength=n_codes)
    low, high = np.zeros(n_codes, np.int64), np.zeros(n_codes, np.int64)
    np.maximum.at(high, code_of, used - begin[code_of])
    low[code_of[::-1]] = (used - begin[code_of])[::-1]  # the first one stays
    simple = (n_used <= 2) & (high < 256)
    two = n_used == 2
    # units: a used symbol, or a run of zeros
    zero = lengths == 0
    start = ~zero
    start[1:] |= zero[1:] & ~zero[:-1]
    start[begin] = True
    unit = np.flatnonzero(start)
    run = np.diff(np.append(unit, len(lengths)))
    owner = np.searchsorted(ends, unit, side="right")
    keep = ~simple[owner]
    unit, run, owner = unit[keep], run[keep], owner[keep]
    empty = zero[unit]
    whole, rest = np.where(empty, run // 138, 0), np.where(empty, run % 138, 0)
    n = np.where(empty, whole + np.where(rest >= 3, 1, rest), 1)
    each = np.repeat(np.arange(len(unit)), n)
    k, rest = _within(n), rest[each]
    full, literal = k < whole[each], ~empty[each]
    symbol = np.where(literal, lengths[unit[each]], np.where(full | (rest >= 11), 18, np.where(rest >= 3, 17, 0))).astype(np.int64)
    extra = np.where(symbol == 18, np.where(full, 127, rest - 11), np.where(symbol == 17, rest - 3, 0))
    more = np.where(symbol == 18, 7, np.where(symbol == 17, 3, 0))
    owner = owner[each]
    counts = np.bincount(owner * 19 + symbol, minlength=19 * n_codes)
    at = np.flatnonzero(counts)
    own = np.zeros(19 * n_codes, np.int64)
    own[at] = _fitted(at // 19, counts[at], 7)
    codes = np.zeros(19 * n_codes, np.int64)
    codes[at] = _canonical(at // 19, own[at])
    told = own.reshape(-1, 19)[:, webp._CODE_ORDER]
    n = np.maximum(4, 19 - (told[:, ::-1] > 0).argmax(1))
    lone = np.repeat(np.count_nonzero(counts.reshape(-1, 19), 1) == 1, 19)
    codes[lone], own[lone] = 0, 0
    place = owner * 19 + symbol
    value, size = codes[place] | extra << own[place], own[place] + more
    # two fields before the tokens
    shift = 3 * np.arange(10)
    first = np.where(simple, 5 | two << 1 | low << 3 | np.where(two, high << 11, 0), (n - 4) << 1)
    first_size = np.where(simple, np.where(two, 19, 11), 5)
    second, second_size = (told[:, :10] << shift).sum(1), np.where(simple, 0, 3 * np.minimum(n, 10))
    third, third_size = (told[:, 10:] << shift[:9]).sum(1), np.where(simple, 0, 3 * np.maximum(n - 10, 0) + 1)
    second[simple], third[simple] = 0, 0
    heads = np.stack([first, second, third], 1), np.stack([first_size, second_size, third_size], 1)
    at = np.repeat(np.searchsorted(owner, np.arange(n_codes)), 3)
    ids = np.arange(n_codes)
    return np.insert(owner, at, np.repeat(ids, 3)), np.insert(value, at, heads[0].reshape(-1)), np.insert(size, at, heads[1].reshape(-1))


# --- writing ---------------------------------------------------------------------------------


class _Images:
    """Images of 16 pixels to a row, side by side; `alone` marks those that webp.store must write."""

    def __init__(self, payloads: list[bytes]):
        self.p = np.frombuffer(b"".join(payloads), ">u4").astype(np.uint32)
        self.c = webp._channels(self.p)
        self.size = np.array([len(x) // 4 for x in payloads])
        self.n = len(payloads)
        self.first = _starts(self.size)
        self.image = np.repeat(np.arange(self.n), self.size)
        self.place = _within(self.size)
        self.alone = np.zeros(self.n, bool)

    def estimates(self, p: np.ndarray) -> np.ndarray:
        """webp._estimate of each image with these pixels."""
        key = np.sort(self.image << 32 | p)
        key = key[np.diff(key, prepend=-1) != 0]
        owner, new = key >> 32, (key & 0xFFFFFFFF).astype(np.uint32)
        colours = np.bincount(owner, minlength=self.n)
        return _price(_histogram(owner, webp._channels(new), self.n)).sum(-1) + (self.size - colours) * (1 + np.log2(colours + 1))

    def ranks(self) -> None:
        """Each pixel's rank among its image's distinct ones, and how many these are."""
        key = np.sort(self.image << 46 | self.p.astype(np.int64) << 14 | self.place)
        new = np.diff(key >> 14, prepend=-1) != 0
        owner = key >> 46
        self.colours = np.bincount(owner[new], minlength=self.n)
        self.rank = np.zeros(len(key), np.int64)
        self.rank[self.first[owner] + (key & _MOST - 1)] = np.cumsum(new) - 1 - _starts(self.colours)[owner]
        self.palette, self.palette_of = (key[new] >> 14 & 0xFFFFFFFF).astype(np.uint32), owner[new]

    def transformed(self) -> None:
        """Seeks transforms as webp._transform does, and applies those after which a row still has 16 pixels; the other images are marked."""
        self.fields = [(np.arange(self.n), np.zeros(self.n, np.int64), np.ones(self.n, np.int64))]  # image, value, size
        self.seek()
        sought, self.alone = self.alone & (self.colours > 16), self.alone & (self.colours <= 16)
        for i in np.flatnonzero(sought).tolist():
            a, b = int(self.first[i]), int(self.first[i] + self.size[i])
            out = webp.BitWriter()
            self.p[a:b] = webp._transform(out, self.p[a:b].reshape(-1, 16)).reshape(-1)
            self.fields.append((np.full(len(out.values), i), np.array(out.values, np.int64), np.array(out.sizes, np.int64)))
        if sought.any():
            self.fields[0] = tuple(x[~sought] for x in self.fields[0])
            self.c = webp._channels(self.p)
            self.ranks()

    def seek(self) -> None:
        """Marks the images for which webp._transform finds, or goes on to seek, a transform."""
        self.ranks()
        best = self.estimates(self.p)
        self.alone |= self.estimates(webp.subtract_green(self.p)) < best
        c = self.c
        above, beside = c.copy(), c.copy()
        above[16:] -= c[:-16]
        above[self.place < 16] = c[self.place < 16]
        beside[1:] -= c[:-1]
        beside[self.first] = c[self.first]
        self.alone |= np.minimum(self.estimates(webp._pixels(above)), self.estimates(webp._pixels(beside))) < 1.05 * best
        self.alone |= self.colours <= 4  # four pixels in one, or eight
        few = self.colours <= 256
        if few.any():
            mine, steps = few[self.image], webp._channels(self.palette).copy()
            steps[1:] -= webp._channels(self.palette)[:-1]
            steps[_starts(self.colours)] = webp._channels(self.palette)[_starts(self.colours)]
            told = few[self.palette_of]
            pairs = self.colours <= 16  # two pixels in one
            one, two = mine & ~pairs[self.image], pairs[self.image[::2]]
            value = np.concatenate([self.image[one] * 256 + self.rank[one], (self.image[::2] * 256 + self.rank[::2] + (self.rank[1::2] % 16 << 4))[two]])
            index = np.bincount(value, minlength=256 * self.n).reshape(-1, 256)
            by_palette = _price(index) + _price(_histogram(self.palette_of[told], steps[told], self.n)).sum(-1)
            self.alone |= few & (by_palette < best)
        self.colour()

    def colour(self) -> None:
        """Marks the images that webp.forward_colour finds multipliers for."""
        blue, green, red = (self.c[:, k].astype(np.int8).astype(np.int64) for k in range(3))
        over = lambda x: np.add.reduceat(x, self.first).astype(np.float64)
        sums = [over(x) for x in (blue, green, red)]
        var = lambda i, j, x, y: over(x * y) - sums[i] * sums[j] / self.size
        each = [var(0, 0, blue, blue), var(1, 1, green, green), var(2, 2, red, red)]
        saved = 0.0
        for i, j, x, y in ((1, 2, green, red), (1, 0, green, blue), (2, 0, red, blue)):
            alike = var(i, j, x, y) ** 2 / np.where((each[i] > 0) & (each[j] > 0), each[i] * each[j], np.inf)
            saved = saved - 0.5 * self.size * np.log2(np.maximum(1 - alike, 1e-6))
        seek = ~self.alone & ((self.size > 4096) | (saved >= 60))
        if not seek.any():
            return
        mine = seek[self.image]
        c, tiles = self.c[mine], np.where(seek, -(-self.size // 256), 0)
        at = (_starts(tiles)[self.image] + (self.place >> 8))[mine]
        blue, green, red = (c[:, k].astype(np.int8).astype(np.float64) for k in range(3))
        n = np.bincount(at)

        def slope(x: np.ndarray, y: np.ndarray) -> np.ndarray:
            sx, sy = np.bincount(at, x), np.bincount(at, y)
            both, var = np.bincount(at, x * y) - sx * sy / n, np.bincount(at, x * x) - sx * sx / n
            m = np.clip(np.rint(32 * both / np.maximum(var, 1)), -128, 127).astype(np.int32)
            return np.where(np.abs(m) < 6, 0, m)

        to_red, to_blue = slope(green, red), slope(green, blue)
        t = np.stack([to_red, to_blue, slope(red, blue - to_blue[at] * green / 32)], 1)
        bits = lambda c, k: _price(np.bincount(at * 256 + c[:, k], minlength=256 * len(n)).reshape(-1, 256))
        new = webp._take_colour(c, t[at])
        t[bits(new, 2) >= bits(c, 2), 0] = 0
        t[bits(new, 0) >= bits(c, 0), 1:] = 0
        self.alone[np.repeat(np.arange(self.n), tiles)[t.any(1)]] = True

    def without(self) -> tuple[_Images, np.ndarray]:
        """The images that are written here, and their numbers."""
        stay = ~self.alone
        out = _Images.__new__(_Images)
        mine = stay[self.image]
        out.p, out.size, out.n = self.p[mine], self.size[stay], int(stay.sum())
        out.c, out.first = webp._channels(out.p), _starts(out.size)
        out.image, out.place = np.repeat(np.arange(out.n), out.size), self.place[mine]
        out.rank, out.colours, out.alone = self.rank[mine], self.colours[stay], np.zeros(out.n, bool)
        owner, value, size = (np.concatenate(x) for x in zip(*self.fields))
        kept = stay[owner]
        out.fields = [((np.cumsum(stay) - 1)[owner[kept]], value[kept], size[kept])]
        return out, np.flatnonzero(stay)

    def copies(self) -> np.ndarray:
        """webp._copies of each image: (image, place among all pixels, length, distance code)."""
        pair = np.flatnonzero(self.place[1:])  # all but each image's last pixel
        key = np.sort(self.image[pair] << 42 | self.rank[pair] << 28 | self.rank[pair + 1] << 14 | self.place[pair])
        same = np.flatnonzero(key[1:] >> 14 == key[:-1] >> 14)
        before = np.full(len(self.p), -1)
        owner = key[same] >> 42
        before[self.first[owner] + (key[same + 1] & _MOST - 1)] = key[same] & _MOST - 1
        price = _price(_histogram(self.image, self.c, self.n)).sum(-1) / self.size
        out = []
        for i in np.unique(owner).tolist():
            a, b = int(self.first[i]), int(self.first[i] + self.size[i])
            out += [(i, a + k, n, code) for k, n, code in webp._chosen(before[a:b], self.p[a:b], 16, float(price[i]))]
        return np.array(out, np.int64).reshape(-1, 4)

    def caches(self, free: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """webp._best_cache of each image; and for each pixel its place in that cache, -1 where it is not there.  free: no part of a copy."""
        best, place = np.zeros(self.n, np.int64), np.full(len(self.p), -1)
        seek = (np.bincount(self.image[free], minlength=self.n) > 0) & (self.colours < self.size)
        ids = np.flatnonzero(seek)
        if not len(ids):
            return best, place
        mine = np.flatnonzero(seek[self.image])
        p, c, free, size, n = self.p[mine], self.c[mine], free[mine], self.size[ids], len(ids)
        image = np.repeat(np.arange(n), size)
        first, at = _starts(size), self.place[mine]

        def price(each: np.ndarray, rest: np.ndarray) -> np.ndarray:
            return _price(np.concatenate([each[:, 1], lengths[ids], rest], 1)) + _price(each[:, [0, 2, 3]]).sum(-1)

        literal = _histogram(image[free], c[free], n)
        lowest, chosen = price(literal, np.zeros((n, 0), np.int64)), np.zeros(n, np.int64)
        told = np.full(len(p), -1)
        for bits in (4, 7, 10):
            h = webp._hashes(p, bits).astype(np.int64)
            key = np.sort(image << 28 | h << 14 | at)
            order = first[key >> 28] + (key & _MOST - 1)
            hit = np.zeros(len(p), bool)
            hit[order[1:]] = (key[1:] >> 14 == key[:-1] >> 14) & (p[order[1:]] == p[order[:-1]])
            hit &= free
            kept = np.bincount(image[hit] << bits | h[hit], minlength=n << bits).reshape(n, -1)
            cost = price(literal - _histogram(image[hit], c[hit], n), kept) + 6.0 * np.count_nonzero(kept, 1)
            better = (cost < lowest) & (kept.any(1)) & (1 << bits <= 4 * size)
            lowest[better], chosen[better] = cost[better], bits
            better = better[image]
            told[better] = np.where(hit, h, -1)[better]
        best[ids], place[mine] = chosen, told
        return best, place

    def bodies(self) -> list[bytes | None]:
        """The images' own bytes as webp.encode_vp8l writes them; None where several groups are shorter."""
        found = self.copies()
        edge = np.zeros(len(self.p) + 1, np.int8)
        edge[found[:, 1]] += 1
        edge[found[:, 1] + found[:, 2]] -= 1
        free = np.cumsum(edge[:-1], dtype=np.int8) == 0
        n_symbol, n_extra, n_size = webp._prefix_of(found[:, 2])
        d_symbol, d_extra, d_size = webp._prefix_of(found[:, 3])
        cache_bits, cached = self.caches(free, np.bincount(found[:, 0] * 24 + n_symbol, minlength=24 * self.n).reshape(-1, 24))
        greens = 280 + np.where(cache_bits > 0, 1 << cache_bits, 0)
        symbol = np.where(cached >= 0, 280 + cached, self.c[:, 1])
        symbol[found[:, 1]] = 256 + n_symbol
        starts = free.copy()
        starts[found[:, 1]] = True
        at = np.flatnonzero(starts)
        image, literal, copy = self.image[at], np.flatnonzero((free & (cached < 0))[at]), np.searchsorted(at, found[:, 1])
        # all codes' symbols side by side
        widths = np.stack([greens, *[np.full(self.n, k) for k in (256, 256, 256, 40)]], 1)
        ends = np.cumsum(widths.reshape(-1))
        begin = (ends - widths.reshape(-1)).reshape(-1, 5)
        green = begin[image, 0] + symbol[at]
        kept, owner = self.c[at[literal]], image[literal]
        red, blue, alpha = (begin[owner, k] + kept[:, j] for k, j in ((1, 2), (2, 0), (3, 3)))
        far = begin[found[:, 0], 4] + d_symbol
        events = np.concatenate([green, red, blue, alpha, far])
        counts = np.bincount(events, minlength=int(ends[-1]))
        several = self.several(begin, widths.sum(1), [(at, green), *((at[literal], x) for x in (red, blue, alpha)), (found[:, 1], far)])
        used = np.flatnonzero(counts)
        code = np.searchsorted(ends, used, side="right")
        lengths = np.zeros(len(counts), np.int64)
        lengths[used] = _fitted(code, counts[used], 12)
        codes, bits = np.zeros(len(counts), np.int64), np.zeros(len(counts), np.int64)
        many = np.bincount(code, minlength=len(ends))[code] > 1
        codes[used[many]], bits[used[many]] = _canonical(code, lengths[used])[many], lengths[used[many]]
        value, size = np.zeros((len(at), 2), np.int64), np.zeros((len(at), 2), np.int64)
        value[:, 0], size[:, 0] = codes[green], bits[green]
        value[literal, 0] |= codes[red] << size[literal, 0]
        size[literal, 0] += bits[red]
        value[literal, 1] = codes[blue] | codes[alpha] << bits[blue]
        size[literal, 1] = bits[blue] + bits[alpha]
        value[copy, 0] |= n_extra << size[copy, 0]
        size[copy, 0] += n_size
        value[copy, 1] = codes[far] | d_extra << bits[far]
        size[copy, 1] = bits[far] + d_size
        # fields in the order of the file: size and flags, codes, pixels
        ids, one = np.arange(self.n), np.ones(self.n, np.int64)
        told, told_value, told_size = _described(lengths, ends)
        fields = [
            (ids, 0x2F * one, 8 * one),
            (ids, 15 | (self.size // 16 - 1) << 14 | 1 << 28, 32 * one),
            *self.fields,
            (ids, np.where(cache_bits > 0, 1 | cache_bits << 1, 0), np.where(cache_bits > 0, 6, 2)),
            (told // 5, told_value, told_size),
            (np.repeat(image, 2), value.reshape(-1), size.reshape(-1)),
        ]
        owners, value, size = (np.concatenate(x) for x in zip(*fields))
        order = np.argsort(owners, kind="stable")
        value, size = value[order].astype(np.uint64), size[order]
        upto = np.concatenate([[0], np.cumsum(size)])
        field = np.concatenate([[0], np.cumsum(np.bincount(owners, minlength=self.n))])
        total = upto[field[1:]] - upto[field[:-1]]
        words = (total >> 5) + 1
        where = upto[:-1] + np.repeat(32 * _starts(words) - upto[field[:-1]], np.diff(field))
        out = np.zeros(int(words.sum()) + 1, np.uint64)
        low = value << (where & 31).astype(np.uint64)
        np.add.at(out, where >> 5, low & np.uint64(0xFFFFFFFF))
        np.add.at(out, (where >> 5) + 1, low >> np.uint64(32))
        raw = out.astype("<u4").tobytes()
        return [None if s else raw[4 * a : 4 * a + (b + 7 >> 3)] for a, b, s in zip(_starts(words).tolist(), total.tolist(), several.tolist())]

    def several(self, begin: np.ndarray, width: np.ndarray, events: list[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
        """Whether webp._groups makes several groups of an image; events: (pixel, symbol) by channel, in ascending order of pixel."""
        out = np.zeros(self.n, bool)
        for i in np.flatnonzero(self.size >= webp._GROUPED_PIXELS).tolist():
            a, n, w = int(self.first[i]), int(self.size[i]), int(width[i])
            keys = []
            for pixel, symbol in events:
                x, y = np.searchsorted(pixel, (a, a + n))
                keys.append((pixel[x:y] - a >> 8) * w + symbol[x:y] - begin[i, 0])
            tiles = -(-n // 256)
            counts = np.bincount(np.concatenate(keys), minlength=tiles * w).reshape(tiles, w)
            out[i] = webp._groups(counts[:, counts.any(0)]).any()
        return out


def store(payloads: list[bytes]) -> list[bytes]:
    """webp.store of each."""
    out: list[bytes | None] = [None] * len(payloads)
    block, pixels = [], 0
    short = [k for k, x in enumerate(payloads) if 0 < len(x) <= 4 * _MOST and len(x) % 64 == 0]
    for at, k in enumerate(short):
        block.append(k)
        pixels += len(payloads[k]) // 4
        if pixels >= _BLOCK or len(block) == _IMAGES or at == len(short) - 1:
            images = _Images([payloads[k] for k in block])
            images.transformed()
            plain, ids = images.without()
            if plain.n:
                for i, body in zip(ids.tolist(), plain.bodies()):
                    out[block[i]] = webp.riff(body) if body is not None else None
            block, pixels = [], 0
    return [webp.store(x) if done is None else done for x, done in zip(payloads, out)]


# --- reading ---------------------------------------------------------------------------------


def _tables(lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """webp.Prefix for codes (n, alphabet): entries (symbol * 16 + length) over the next bits, where each code's begin, masks of its width, and whether it is broken."""
    n = len(lengths)
    code, symbol = np.nonzero(lengths)
    own = lengths[code, symbol].astype(np.int64)
    used = np.bincount(code, minlength=n)
    width = np.where(used > 1, lengths.max(1), 0).astype(np.int64)
    # of no symbol, or of one: that takes no bits
    bare = np.flatnonzero(used == 0)
    own[used[code] == 1] = 0
    code, symbol, own = np.concatenate([code, bare]), np.concatenate([symbol, 0 * bare]), np.concatenate([own, 0 * bare])
    share = np.int64(1) << (width[code] - own)
    broken = np.bincount(code, share, minlength=n) != 1 << width
    if broken.any():
        keep = ~broken[code]
        code, symbol, own, share = code[keep], symbol[keep], own[keep], share[keep]
    by = np.argsort((width[code] << 40) | (code << 20) | (own << 12) | symbol, kind="stable")
    row = np.repeat((symbol[by] << 4 | own[by]).astype(np.uint16), share[by])
    begin, at = np.zeros(n, np.int64), 0
    for w in np.unique(width[~broken]).tolist():
        mine = np.flatnonzero((width == w) & ~broken)
        end = at + (len(mine) << w)
        row[at:end] = row[at:end].reshape(-1, 1 << w)[:, webp._REVERSED[np.arange(1 << w) << (16 - w)]].reshape(-1)
        begin[mine] = at + (np.arange(len(mine)) << w)
        at = end
    return row, begin, (1 << width) - 1, broken


class _Stream:
    """Files' bits side by side: the next 57 and more of each place as a signed number."""

    def __init__(self, bodies: list[bytes], steps: int):
        raw = b"".join(x + b"\0" * 8 for x in bodies) + b"\0" * (8 * steps + (1 << 16))  # broken files may be read beyond their end
        self.words = np.ascontiguousarray(np.ndarray((len(raw) - 8,), "<i8", raw, strides=(1,)))
        sizes = np.array([len(x) for x in bodies])
        self.first = 8 * _starts(sizes + 8)
        self.end = self.first + 8 * sizes

    def at(self, place: np.ndarray) -> np.ndarray:
        return self.words[place >> 3] >> (place & 7)


def _read_lengths(stream: _Stream, place: np.ndarray, alphabet: np.ndarray, broken: np.ndarray) -> np.ndarray:
    """webp.read_prefix in all files: the lengths (n, longest alphabet); place is moved on; `broken`: files left to webp.decode."""
    n = len(place)
    out = np.zeros((n, int(alphabet.max()) + 144), np.uint8)
    v = stream.at(place)
    simple = (v & 1) > 0
    k = np.flatnonzero(simple)
    two, eight = v[k] >> 1 & 1, v[k] >> 2 & 1
    a = v[k] >> 3 & np.where(eight, 255, 1)
    b = v[k] >> np.where(eight, 11, 4) & 255
    broken[k] |= np.maximum(a, two * b) >= alphabet[k]
    a, b = (np.minimum(x, alphabet[k] - 1) for x in (a, b))
    out[k, a] = 1
    out[k[two > 0], b[two > 0]] = 1
    place[k] += np.where(eight, 11, 4) + 8 * two
    k = np.flatnonzero(~simple)
    if not len(k):
        return out[:, :-144]
    told = 4 + (v[k] >> 1 & 15)
    broken[k] |= told > 19
    told = np.minimum(told, 19)
    own = np.zeros((len(k), 19), np.uint8)
    own[:, webp._CODE_ORDER] = (stream.at(place[k] + 5)[:, None] >> 3 * np.arange(19) & 7) * (np.arange(19) < told[:, None])
    place[k] += 5 + 3 * told
    broken[k] |= (stream.at(place[k]) & 1) > 0  # a limit on the symbols told: not of these files
    place[k] += 1
    row, begin, mask, bad = _tables(own)
    broken[k] |= bad
    keep = ~broken[k]
    k, begin, mask = k[keep], begin[keep], mask[keep]
    at, end, most = place[k], np.zeros(len(k), np.int64), alphabet[k]
    before, done, k0 = np.full(len(k), 8), np.zeros(len(k), np.int64), k
    live = np.arange(len(k))
    while len(live):
        v = stream.at(at)
        e = row[begin + (v & mask)].astype(np.int64)
        x, size = e >> 4, e & 15
        v >>= size
        out[k, done] = np.where(x < 16, x, 0)
        before = np.where((x < 16) & (x > 0), x, before)
        long = np.flatnonzero(x >= 16)
        step = np.ones(len(k), np.int64)
        if len(long):
            y = x[long]
            bits = np.where(y == 18, 7, y - 14)
            run = np.where(y == 18, 11, 3) + (v[long] & (1 << bits) - 1)
            step[long] = run
            size[long] += bits
            for j in np.flatnonzero(y == 16).tolist():
                i = long[j]
                out[k[i], done[i] : done[i] + run[j]] = before[i]
        at = at + size
        done = done + step
        left = done < most
        if not left.all():
            gone = ~left
            end[live[gone]] = at[gone]
            broken[k[gone]] |= done[gone] > most[gone]
            k, at, begin, mask, before, done, most, live = (z[left] for z in (k, at, begin, mask, before, done, most, live))
    place[k0] = end
    return out[:, :-144]


def _plain(m: bytes) -> tuple[int, int, int, int, int] | None:
    """(bytes of the image, width, height, cache bits, bits before the codes) of a plain file, else None."""
    if len(m) < 26 or m[:4] != b"RIFF" or m[8:16] != b"WEBPVP8L":
        return None
    whole, size = struct.unpack("<I", m[4:8])[0], struct.unpack("<I", m[16:20])[0]
    head = int.from_bytes(m[20:28], "little")
    if size < 6 or 20 + size > len(m) or whole < 12 or head & 255 != 0x2F or head >> 37 & 15:  # a version, a transform
        return None
    cached = head >> 41 & 1
    bits, at = (head >> 42 & 15, 46) if cached else (0, 42)
    if bits > 11 or cached > bits or head >> at & 1:  # groups
        return None
    return size, (head >> 8 & 0x3FFF) + 1, (head >> 22 & 0x3FFF) + 1, bits, at + 1


#: Files that are read in step; with fewer left, or of more pixels than this, each is read on alone.
_IN_STEP, _LONGEST = 70, 1 << 18


def _finish(words: memoryview, place: int, end: int, codes: list[tuple[list[int], int]], row: list[int], total: int, width: int, cache: list[int] | None, cache_bits: int) -> None:
    """Appends a file's further pixels one by one; codes: entries as `_read` adds them up, and the masks."""
    (green, in_green), (red, in_red), (blue, in_blue), (alpha, in_alpha), (far, in_far) = codes
    add, literal, times, shift, at = row.append, 256 << 16, webp._CACHE_MUL, 32 - cache_bits, len(row)
    while at < total and place <= end:
        v = words[place >> 3] >> (place & 7)
        e = green[v & in_green]
        v >>= e & 15
        if e < literal:
            f = red[v & in_red]
            v >>= f & 15
            g = blue[v & in_blue]
            e += f + g + alpha[v >> (g & 15) & in_alpha]
            place += e & 255
            x = e >> 8
        else:
            place += e & 15
            s = (e >> 16) - 256
            if s < 24:
                n = 0 if s < 4 else (s - 2) >> 1
                run = (s if s < 4 else ((2 + (s & 1)) << n) + (v & (1 << n) - 1)) + 1
                v >>= n
                e = far[v & in_far]
                v >>= e & 15
                s, place = e >> 4, place + n + (e & 15)
                n = 0 if s < 4 else (s - 2) >> 1
                place += n
                webp._again(row, webp._distance((s if s < 4 else ((2 + (s & 1)) << n) + (v & (1 << n) - 1)) + 1, width), run, total, cache, cache_bits)
                at += run
                continue
            x = cache[s - 24]
        add(x)
        at += 1
        if cache:
            cache[(x * times & 0xFFFFFFFF) >> shift] = x
    if place > end:
        raise webp.Broken("the data end early")


def _read(bodies: list[bytes], width: np.ndarray, total: np.ndarray, cache_bits: np.ndarray, at: np.ndarray) -> list[np.ndarray | None]:
    """Pixels of plain files, those with most pixels first; None: left to webp.decode."""
    n = len(bodies)
    steps = int(total[_IN_STEP]) if n > _IN_STEP else 0
    stream, broken = _Stream(bodies, steps), np.zeros(n, bool)
    place = stream.first + at
    greens = 280 + np.where(cache_bits > 0, 1 << cache_bits, 0)
    tables = []
    for alphabet in (greens, *(np.full(n, k) for k in (256, 256, 256, 40))):
        row, begin, mask, bad = _tables(_read_lengths(stream, place, alphabet, broken))
        broken |= bad
        broken |= mask >= 1 << 14  # a pixel of over 57 bits
        begin[broken], mask[broken] = 0, 0
        tables.append((row if len(row) else np.zeros(1, np.uint16), begin, mask))
    (green, g0, gm), (red, r0, rm), (blue, b0, bm), (alpha, a0, am), (far, f0, fm) = tables
    broken |= place > stream.end
    # a pixel's entries add up: its channels from bit 8 on, its length below
    green, red, blue, alpha = ((row.astype(np.int64) >> 4 << k | row & 15) for row, k in ((green, 16), (red, 24), (blue, 8), (alpha, 32)))
    words, literal, busy = stream.words, (256 << 16) - 1, False
    out = np.zeros((steps, n), np.uint32)
    flat = out.reshape(-1)
    left = left_at = np.zeros(n, np.int64)  # of copies that are being made
    back = back_at = np.zeros(n, np.int64)
    caches, cache0, shift = np.zeros(int((1 << cache_bits).sum()), np.uint32), _starts(1 << cache_bits), (32 - cache_bits).astype(np.uint32)
    caching = np.flatnonzero(cache_bits)
    ids = np.arange(n)
    active = np.searchsorted(-total, -np.arange(steps), side="left")  # files of more than t pixels
    begins, masks, a = (g0, r0, b0, a0, f0), (gm, rm, bm, am, fm), n + 1
    for t in range(steps):
        if active[t] != a:
            a = int(active[t])
            p, g0, gm, r0, rm, b0, bm, a0, am, left, back, ids = (x[:a] for x in (place, g0, gm, r0, rm, b0, bm, a0, am, left, back, ids))
            caching = caching[caching < a]
        start = words[p >> 3] >> (p & 7)
        first = green[g0 + (start & gm)]
        e = first & 15
        v = start >> e
        e = red[r0 + (v & rm)]
        told = first + e
        e &= 15
        v >>= e
        e = blue[b0 + (v & bm)]
        told += e
        e &= 15
        v >>= e
        told += alpha[a0 + (v & am)]
        now = out[t, :a]
        now[:] = told >> 8
        told &= 255
        special = first > literal
        if busy:
            special |= left > 0
        special = special.nonzero()[0]
        if len(special):
            symbol, bits, size = first >> 16, first & 15, told
            fresh = special[left[special] == 0]
            size[special] = 0
            s = symbol[fresh]
            hit = s >= 280
            k = fresh[hit]
            now[k] = caches[cache0[k] + s[hit] - 280]
            size[k] = bits[k]
            k, s = fresh[~hit], s[~hit] - 256
            if len(k):
                v = start[k] >> bits[k]
                more = np.where(s < 4, 0, (s - 2) >> 1)
                run = np.where(s < 4, s, ((2 + (s & 1)) << more) + (v & (1 << more) - 1)) + 1
                v >>= more
                e = far[f0[k] + (v & fm[k])].astype(np.int64)
                s, v = e >> 4, v >> (e & 15)
                bit = np.where(s < 4, 0, (s - 2) >> 1)
                code = np.where(s < 4, s, ((2 + (s & 1)) << bit) + (v & (1 << bit) - 1)) + 1
                size[k] = bits[k] + more + (e & 15) + bit
                near = np.minimum(code, 120) - 1
                distance = np.where(code > 120, code - 120, np.maximum(1, _NEAR_X[near] + _NEAR_Y[near] * width[k]))
                wrong = (distance > t) | (t + run > total[k])
                broken[k[wrong]] = True
                left[k], back[k] = np.where(wrong, 1, run), np.where(wrong, 0, distance)
            k = special[left[special] > 0]
            now[k] = flat[(t - back[k]) * n + k]
            left[k] -= 1
            busy = left[k].any()
        p += told
        if len(caching):
            x = now[caching]
            caches[cache0[caching] + (x * np.uint32(webp._CACHE_MUL) >> shift[caching])] = x
    broken |= place > stream.end
    whole, got = np.ascontiguousarray(out.T), []
    for k, (m, bad) in enumerate(zip(total.tolist(), broken.tolist())):
        if bad or m <= steps:
            got.append(None if bad else whole[k, :m])
            continue
        codes = [(row[b[k] : b[k] + int(w[k]) + 1].tolist(), int(w[k])) for row, b, w in zip((green, red, blue, alpha, far), begins, masks)]
        cache = caches[cache0[k] : cache0[k] + (1 << cache_bits[k])].tolist() if cache_bits[k] else None
        row = whole[k].tolist()
        try:
            if left_at[k]:  # a copy is being made
                webp._again(row, int(back_at[k]), int(left_at[k]), m, cache, int(cache_bits[k]))
            _finish(memoryview(words), int(place[k]), int(stream.end[k]), codes, row, m, int(width[k]), cache, int(cache_bits[k]))
            got.append(np.array(row, np.uint32))
        except webp.Broken:
            got.append(None)
    return got


_NEAR_X, _NEAR_Y = np.array(webp._NEAR).T


def load(files: list[bytes]) -> list[np.ndarray]:
    """webp.decode of each."""
    out: list[np.ndarray | None] = [None] * len(files)
    plain = [(k, x) for k, x in enumerate(_plain(m) for m in files) if x]
    plain.sort(key=lambda kx: -kx[1][1] * kx[1][2])
    plain = [(k, x) for k, x in plain if x[1] * x[2] <= _LONGEST]
    while plain:
        block, plain = plain[: 2 * _IMAGES], plain[2 * _IMAGES :]
        number = lambda f: np.array([f(x) for _, x in block], np.int64)
        found = _read([files[k][20 : 20 + x[0]] for k, x in block], number(lambda x: x[1]), number(lambda x: x[1] * x[2]), number(lambda x: x[3]), number(lambda x: x[4]))
        for (k, x), p in zip(block, found):
            if p is not None:
                out[k] = webp._channels(p.reshape(x[2], x[1]))[..., ::-1]
    return [webp.decode(m) if p is None else p for m, p in zip(files, out)]
