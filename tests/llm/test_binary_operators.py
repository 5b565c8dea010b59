"""Operators 5, 6, 7 and 10: exact round trips."""

import gzip
import hashlib
import random
import zlib
from functools import cache

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from tessella.llm import common, packing, pfor, tokens, warc, webp

TEXTS = [None, "", "a", "Hello, world!\nIt's  fine.", "ünï cödé 日本 😀", "x" * 5000, "one two\n\nthree ", " lead", "<|endoftext|>", "see <|endoftext|> here<|startoftext|>", "Hello, world!\nIt's  fine."]


def frame(spark, texts):
    return spark.createDataFrame([(i, t, "ids", 7) for i, t in enumerate(texts)], "doc_id long, text string, ids string, start int").repartition(3)


@cache
def library(name):
    """A tokenizer of the test's own."""
    return Tokenizer.from_file(tokens.tokenizer_path(name))


def whole(name, text):
    return library(name).encode(text or "", add_special_tokens=False).ids


@settings(max_examples=400, deadline=None)
@given(st.lists(st.sampled_from(["a", "B", "don't", "'s", "I'LL", " ", "\n", ".", "1", "23", "\t", " ", "Σ", "ς", "İ", "ß", "é", "é", "́", "%%%", "'.", "日本", "<|endoftext|>", "<|startoftext|>", "<|", "\r", "\x1c", "ª", "_", "-", "😀", " "]), max_size=14).map("".join))
def test_memo_gives_the_librarys_ids(text):
    for name in ("byte_bpe_50k.json", "word_bpe_49k.json"):
        assert np.frombuffer(tokens.encoder(tokens.tokenizer_path(name)).encode([text])[0], "<u4").tolist() == whole(name, text)


def test_memo_forgets(monkeypatch):
    monkeypatch.setattr(tokens, "MEMO_CHUNKS", 8)
    e = tokens.Encoder(tokens.tokenizer_path("byte_bpe_50k.json"))
    text = " ".join(f"word{chr(97 + k % 26)}{'x' * (k % 7)}," for k in range(200))
    assert np.frombuffer(e.encode([text])[0], "<u4").tolist() == whole("byte_bpe_50k.json", text)


@settings(max_examples=200, deadline=None)
@given(st.lists(st.one_of(st.integers(0, 300), st.integers(0, 2**32 - 1)), max_size=900), st.sampled_from([0, 5, 2**31]))
def test_blocks_round_trip(ids, base):
    x = np.array([(v + base) % 2**32 for v in ids], np.uint32)
    packed = pfor.pack_blocks(x)
    starts = np.cumsum([0, *map(len, packed)])[:-1]
    assert (pfor.unpack_blocks(b"".join(packed), starts.astype(np.int64)) == x).all()


def test_low_bits_against_bit_strings():
    """Words of eight numbers hold, for each width, what writing bit after bit gives; blocks with outliers come back."""
    rng = np.random.default_rng(8)
    for w in range(1, 17):
        x = rng.integers(0, 1 << 32, (3, pfor.BLOCK), dtype=np.uint64).astype(np.uint32)  # higher bits are left out
        slow = [int("".join(format(v & (1 << w) - 1, f"0{w}b") for v in reversed(row)), 2).to_bytes(pfor.BLOCK * w // 8, "little") for row in x.tolist()]
        packed = pfor._pack_low(x, w)
        assert [row.tobytes() for row in packed] == slow
        assert (pfor._unpack_low(packed, w) == x & np.uint32((1 << w) - 1)).all()
    for w in range(33):
        x = rng.integers(0, 1 << w, 1000, dtype=np.uint64).astype(np.uint32)
        x[::90] = 2**32 - 1
        blocks = pfor.pack_blocks(x)
        assert (pfor.unpack_blocks(b"".join(blocks), np.cumsum([0, *map(len, blocks)])[:-1]) == x).all()


def test_outliers_are_exceptions():
    x = np.arange(256, dtype=np.uint32) % 8
    x[5] = 2**30
    assert len(pfor.pack_blocks(x)[0]) == 9 + 256 * 3 // 8 + 5


def test_token_files(spark):
    out = pfor.read_tokens(pfor.write_tokens(frame(spark, TEXTS), tokens.tokenizer_path("word_bpe_49k.json"), 2)).orderBy("doc_id").collect()
    at = 0
    for r, t in zip(out, TEXTS, strict=True):
        ids = np.array([*whole("word_bpe_49k.json", t), 2], "<u4")
        assert (r.start, r.n_tokens, r.ids_crc32) == (at, len(ids), zlib.crc32(ids.tobytes()))
        at += len(ids)
    assert pfor.read_tokens(pfor.write_tokens(frame(spark, []), tokens.tokenizer_path("word_bpe_49k.json"), 2)).collect() == []


def test_packing_covers_every_id(spark):
    texts = [*TEXTS, *[" ".join(["word"] * n) for n in (3000, 2047, 2048, 511, 5000, 17, 900)]]
    rows = packing.pack_documents(frame(spark, texts).coalesce(1), tokens.tokenizer_path("byte_bpe_50k.json"), 1).collect()
    got = {}
    for r in sorted(rows, key=lambda r: (r.doc_id, r.start)):
        have = got.setdefault(r.doc_id, b"")
        assert r.start * 4 == len(have) and r.length * 4 == len(r.ids)
        got[r.doc_id] = have + bytes(r.ids)
    for i, t in enumerate(texts):
        assert np.frombuffer(got[i], "<u4").tolist() == [*whole("byte_bpe_50k.json", t), 1]
    sequences = {}
    for r in sorted(rows, key=lambda r: (r.sequence_id, r.offset)):
        assert r.offset == sequences.get(r.sequence_id, 0)
        sequences[r.sequence_id] = r.offset + r.length
    short = [n for n in sequences.values() if n & (n - 1)]
    assert max(sequences.values()) <= 2048 and len(short) <= 1


@settings(max_examples=100, deadline=None)
@given(st.lists(st.integers(1, 400), max_size=60), st.integers(50, 2000))
def test_packer(lengths, waiting):
    p = packing.Packer(0, (16, 32, 64), 128, waiting)
    for i, n in enumerate(lengths):
        p.add(i, np.arange(n, dtype="<u4").tobytes())
    p.finish()
    back = {}
    for doc, start, n, ids, total, *_ in sorted(p.out, key=lambda x: (x[0], x[1])):
        assert start == len(back.get(doc, b"")) // 4 and len(ids) == 4 * n and total == lengths[doc]
        back[doc] = back.get(doc, b"") + ids
    assert {i: len(b) // 4 for i, b in back.items()} == dict(enumerate(lengths))
    full = {}
    for _, _, n, _, _, seq, _, tier, _ in p.out:
        full[seq] = (full.get(seq, (0, 0))[0] + n, tier)
    assert sum(n < tier for n, tier in full.values()) <= 1
    groups = {}
    for _, _, n, *_, group in p.out:
        groups[group] = groups.get(group, 0) + n
    assert all(n <= 128 for n in groups.values())


# --- WARC ------------------------------------------------------------------------------------


def test_archives(spark, monkeypatch):
    monkeypatch.setattr(warc, "CHUNK", 500)
    big = "é" * 900
    pages = [(1, "u", big, 0), (2, "u", big, 0), (3, "u", "x" * 999, 0), (4, "u", "x" * 999, 0), (5, None, None, 0), (6, "u\r\nX: y", "", 0), (7, "u", "\r\n\r\nWARC/1.1\r\n" * 400, 0), (None, "u", "gone", 0), (9, "u", big, 0)]
    df = spark.createDataFrame(pages, "page_id long, url string, html string, record int").repartition(3)
    table = warc.chunk_table(df)
    for r in table.collect():  # running digests, first chunks with urls
        whole_ = next((h or "").encode() for p, _, h, _ in pages if p == r.record and len((h or "").encode()) == r.total)
        assert bytes(r.sha1) == hashlib.sha1(whole_[: 500 * (r.chunk_no + 1)]).digest() and len(r.data) <= 500 and (r.url is None) == (r.chunk_no > 0)
    files = warc.write(warc.ordered(table))
    got = {r.page_id: tuple(r)[1:] for r in warc.read_records(files).collect()}
    for page, _, html, _ in pages:
        if page is None:
            continue
        raw = (html or "").encode()
        target = 9 if raw == big.encode() and page != 9 else None
        assert got[page] == (len(raw), hashlib.sha1(raw).hexdigest(), "revisit" if target else "response", target)
    assert None not in got and len(got) == 8
    back = {}
    for r in warc.read_chunks(files).orderBy("record", "chunk_no").collect():
        back[r.record] = back.get(r.record, b"") + bytes(r.data)
    assert all(back[p] == (h or "").encode() for p, _, h, _ in pages if p not in (None, 1, 2))
    uri = files.first().uri
    assert all(len(r[8]) <= warc.CHUNK for f in files.collect() for r in warc.read_file(f.uri))
    raw = gzip.decompress(open(uri.removeprefix("file://"), "rb").read())
    assert raw.startswith(b"WARC/1.1\r\nWARC-Type: ")
    empty = warc.write(warc.ordered(warc.chunk_table(df.limit(0))))
    assert warc.read_records(empty).collect() == []


def test_damage_is_seen(spark, tmp_path):
    a = warc.Archive(f"file://{tmp_path}/a")
    with pytest.raises(ValueError):
        a.chunk(1, 0, True, "u", 3, hashlib.sha1(b"abc").digest(), None, b"abd")


# --- WebP ------------------------------------------------------------------------------------


@settings(max_examples=150, deadline=None)
@given(st.one_of(st.text(max_size=400), st.text(alphabet="ab \n", max_size=3000), st.binary(max_size=600).map(lambda b: b.decode("latin-1")), st.integers(0, 200).map(lambda n: "0123456789abcdef" * 4 * n)))
def test_payloads_round_trip(text):
    payload, n = webp.payload_of(text)
    assert len(payload) % 64 == 0 and len(payload) >= 64 and n == len(text.encode())
    assert webp.load(webp.store(payload), len(payload)) == payload


def test_wide_payload():
    payload = random.Random(1).randbytes(64 * 20_000)
    assert webp.load(webp.store(payload), len(payload)) == payload


class Coder(webp.BitWriter):
    """Writes images with any of the format's features, for the decoder's sake."""

    def flat(self, symbols, width=8):
        """A code in which 2 ** k symbols have k bits; returns symbol to code."""
        alphabet, n = symbols
        lengths = np.zeros(alphabet, np.uint8)
        lengths[:n] = n.bit_length() - 1
        webp.write_prefix(self, lengths)
        codes = webp.canonical(lengths)
        return {s: (int(codes[s]), n.bit_length() - 1) for s in range(n)}


def put_plain_image(out, pixels, main, cache_bits=0, groups=None):
    """Literals only, one flat 8-bit group (or two by tile), as the decoder's slow or fast path wants."""
    out.put(1 if cache_bits else 0, 1)
    if cache_bits:
        out.put(cache_bits, 4)
    if main:
        out.put(1 if groups else 0, 1)
        if groups:
            bits, which = groups
            out.put(bits - 2, 3)
            put_plain_image(out, which.astype(np.uint32) << 8, False)
    n = int(groups[1].max()) + 1 if groups else 1
    tables = []
    for k in range(n):
        tables.append([out.flat((280 + ((1 << cache_bits) if cache_bits else 0), 256)), out.flat((256, 256)), out.flat((256, 256)), out.flat((256, 256))])
        webp.write_prefix(out, np.zeros(40, np.uint8))
    h, w = pixels.shape
    for y in range(h):
        for x in range(w):
            p = int(pixels[y, x])
            g, r, b, a = tables[int(groups[1][y >> groups[0], x >> groups[0]]) if groups else 0]
            for table, v in ((g, p >> 8 & 255), (r, p >> 16 & 255), (b, p & 255), (a, p >> 24)):
                out.put(*table[v])


def riff(out):
    body = out.bytes()
    return b"RIFF" + (12 + len(body) + (len(body) & 1)).to_bytes(4, "little") + b"WEBPVP8L" + len(body).to_bytes(4, "little") + body + b"\0" * (len(body) & 1)


def head(out, w, h):
    for v, n in ((0x2F, 8), (w - 1, 14), (h - 1, 14), (1, 1), (0, 3)):
        out.put(v, n)


def argb(image):
    return (image[..., 0].astype(np.uint32) << 24) | (image[..., 1].astype(np.uint32) << 16) | (image[..., 2].astype(np.uint32) << 8) | image[..., 3]


@pytest.fixture
def picture():
    return np.random.default_rng(0).integers(0, 1 << 32, (9, 13), dtype=np.uint64).astype(np.uint32)


def test_meta_codes(picture):
    out = Coder()
    head(out, 13, 9)
    out.put(0, 1)
    put_plain_image(out, picture, True, groups=(2, np.array([[0, 1, 0, 1], [1, 0, 1, 0], [0, 0, 1, 1]])))
    assert (argb(webp.decode(riff(out))) == picture).all()


def test_subtract_green(picture):
    c = webp._channels(picture).copy()
    c[..., 0] -= c[..., 1]
    c[..., 2] -= c[..., 1]
    out = Coder()
    head(out, 13, 9)
    out.put(1, 1)
    out.put(2, 2)
    out.put(0, 1)
    put_plain_image(out, webp._pixels(c), True)
    assert (argb(webp.decode(riff(out))) == picture).all()


def scalar_predict(mode, l, t, tl, tr):
    avg = lambda a, b: [(x + y) // 2 for x, y in zip(a, b)]
    clamp = lambda v: max(0, min(255, v))
    if mode == 0:
        return [0, 0, 0, 255]
    if mode == 11:
        p = [a + b - c for a, b, c in zip(l, t, tl)]
        pl, pt = sum(abs(a - b) for a, b in zip(p, l)), sum(abs(a - b) for a, b in zip(p, t))
        return l if pl < pt else t
    if mode == 12:
        return [clamp(a + b - c) for a, b, c in zip(l, t, tl)]
    if mode == 13:
        return [clamp(a + int((a - b) / 2)) for a, b in zip(avg(l, t), tl)]
    return {1: l, 2: t, 3: tr, 4: tl, 5: avg(avg(l, tr), t), 6: avg(l, tl), 7: avg(l, t), 8: avg(tl, t), 9: avg(t, tr), 10: avg(avg(l, tl), avg(t, tr))}[mode]


@pytest.mark.parametrize("mode", range(14))
def test_predictors(picture, mode):
    h, w = picture.shape
    c = webp._channels(picture).astype(int)
    res = np.zeros_like(c)
    for y in range(h):
        for x in range(w):
            if y == 0:
                p = [0, 0, 0, 255] if x == 0 else c[0, x - 1].tolist()
            elif x == 0:
                p = c[y - 1, 0].tolist()
            else:
                tr = c[y - 1, x + 1] if x + 1 < w else c[y, 0]
                p = scalar_predict(mode, *[v.tolist() for v in (c[y, x - 1], c[y - 1, x], c[y - 1, x - 1], tr)])
            res[y, x] = (c[y, x] - p) & 255
    tiles = np.full((3, 4), mode)
    out = Coder()
    head(out, w, h)
    out.put(1, 1)
    out.put(0, 2)
    out.put(0, 3)
    put_plain_image(out, tiles.astype(np.uint32) << 8, False)
    out.put(0, 1)
    put_plain_image(out, webp._pixels(res.astype(np.uint8)), True)
    assert (argb(webp.decode(riff(out))) == picture).all()


def test_cross_colour(picture):
    tiles = np.random.default_rng(2).integers(0, 1 << 24, (3, 4)).astype(np.uint32)
    s8 = lambda v: (v & 127) - (v & 128)
    c = webp._channels(picture).astype(int)
    new = c.copy()
    for y in range(9):
        for x in range(13):
            t = int(tiles[y >> 2, x >> 2])
            b, g, r, _ = c[y, x]
            new[y, x, 2] = (r - (s8(t & 255) * s8(g) >> 5)) & 255
            new[y, x, 0] = (b - (s8(t >> 8 & 255) * s8(g) >> 5) - (s8(t >> 16 & 255) * s8(r) >> 5)) & 255
    out = Coder()
    head(out, 13, 9)
    out.put(1, 1)
    out.put(1, 2)
    out.put(0, 3)
    put_plain_image(out, tiles, False)
    out.put(0, 1)
    put_plain_image(out, webp._pixels(new.astype(np.uint8)), True)
    assert (argb(webp.decode(riff(out))) == picture).all()


@pytest.mark.parametrize(("colours", "packed"), [(2, 3), (4, 2), (13, 1), (40, 0)])
def test_palettes(colours, packed):
    rng = np.random.default_rng(colours)
    palette = rng.integers(0, 1 << 32, colours, dtype=np.uint64).astype(np.uint32)
    index = rng.integers(0, colours, (5, 11))
    steps = np.diff(webp._channels(palette[None])[0].astype(int), axis=0, prepend=0) & 255
    wide = np.zeros((5, (11 + (1 << packed) - 1) >> packed), np.uint32)
    for y in range(5):
        for x in range(11):
            wide[y, x >> packed] |= int(index[y, x]) << ((x & ((1 << packed) - 1)) * (8 >> packed))
    out = Coder()
    head(out, 11, 5)
    out.put(1, 1)
    out.put(3, 2)
    out.put(colours - 1, 8)
    put_plain_image(out, webp._pixels(steps.astype(np.uint8)[None]), False)
    out.put(0, 1)
    put_plain_image(out, wide << 8, True)
    assert (argb(webp.decode(riff(out))) == palette[index]).all()


@pytest.mark.parametrize("tiled", [False, True])
def test_back_references_and_cache(tiled):
    """Copies near and far, overlapping ones, and cache hits, on the fast and on the slow path."""
    rng, bits = np.random.default_rng(4), 4
    out = Coder()
    head(out, 16, 8)
    out.put(0, 1)
    out.put(1, 1)
    out.put(bits, 4)
    out.put(1 if tiled else 0, 1)
    if tiled:
        out.put(0, 3)
        put_plain_image(out, (np.arange(8).reshape(2, 4) % 2).astype(np.uint32) << 8, False)
    tables = []
    for _ in range(2 if tiled else 1):
        lengths = np.zeros(280 + (1 << bits), np.uint8)
        lengths[:216], lengths[256:] = 8, 8  # 216 + 24 + 16 = 256
        webp.write_prefix(out, lengths)
        green = webp.canonical(lengths)
        rest = [out.flat((256, 256)) for _ in range(3)]
        far = out.flat((40, 32))
        tables.append((green, rest, far))
    want, cache = [], [0] * (1 << bits)

    def pixel(p):
        cache[(p * 0x1E35A7BD & 0xFFFFFFFF) >> 32 - bits] = p
        want.append(p)

    while len(want) < 128:
        y, x = divmod(len(want), 16)
        green, rest, far = tables[((y >> 2) * 4 + (x >> 2)) % 2 if tiled else 0]
        kind = rng.random()
        if kind < 0.3 and len(want) > 2:
            n = int(min(rng.integers(1, 20), 128 - len(want)))
            d = int(rng.integers(1, min(len(want), 40) + 1))
            code = d + 120
            near = [k + 1 for k, (a, b) in enumerate(webp._NEAR) if max(1, a + b * 16) == d]
            if near and rng.random() < 0.7:
                code = int(rng.choice(near))
            s, e, m = (int(v[0]) for v in webp._prefix_of(np.array([n])))
            out.put(int(green[256 + s]), 8)
            if m:
                out.put(e, m)
            s, e, m = (int(v[0]) for v in webp._prefix_of(np.array([code])))
            out.put(*far[s])
            if m:
                out.put(e, m)
            for _ in range(n):
                pixel(want[-d])
        elif kind < 0.5 and want:
            k = int(rng.integers(0, 1 << bits))
            out.put(int(green[280 + k]), 8)
            pixel(cache[k])
        else:
            p = (int(rng.integers(0, 1 << 24)) << 8) & 0xFFFF0000 | int(rng.integers(0, 216)) << 8 | int(rng.integers(0, 256))
            out.put(int(green[p >> 8 & 255]), 8)
            for table, v in zip(rest, (p >> 16 & 255, p & 255, p >> 24)):
                out.put(*table[v])
            pixel(p)
    assert argb(webp.decode(riff(out))).reshape(-1).tolist() == want


def test_broken_files():
    good = webp.store(webp.payload_of("hello " * 50)[0])
    for bad in (b"", good[:20], good[:40], b"RIFX" + good[4:], good[:20] + b"\0" + good[21:]):
        with pytest.raises(webp.Broken):
            webp.decode(bad)


def test_media_frames(spark):
    stored = common.written(webp.media(frame(spark, TEXTS)), "media")
    got = {r.doc_id: r for r in webp.features(stored).collect()}
    for i, t in enumerate(TEXTS):
        payload, n = webp.payload_of(t)
        assert (got[i].n_bytes, got[i].payload_bytes, got[i].payload_sha256, got[i].tail_crc32) == (n, len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]))
    assert tuple(got[3])[1:] == tuple(got[9])[1:] and tuple(got[0])[1:] == tuple(got[1])[1:]


# --- op10: what the encoder uses -------------------------------------------------------------


def steps_of(monkeypatch, media):
    """Names of the decoder's steps that a file needs, and its pixels."""
    used = set()
    with monkeypatch.context() as patch:
        for name in ("inverse_predictor", "inverse_colour", "add_green", "inverse_palette", "_read_tiled", "_distance"):
            patch.setattr(webp, name, lambda *a, name=name, inner=getattr(webp, name): (used.add(name), inner(*a))[1])
        init = webp._Group.__init__
        patch.setattr(webp._Group, "__init__", lambda self, bits, cache_size: (used.add("cache") if cache_size else None, init(self, bits, cache_size))[1])
        pixels = webp.decode(media)
    return used, pixels


def test_encoder_uses_every_step(monkeypatch):
    """Pictures made for each step of the format: the encoder takes it, and the pixels come back."""
    rng = np.random.default_rng(5)
    y, x = np.mgrid[:64, :64]
    noise = rng.integers(0, 256, (64, 64))
    signed = (noise ^ 128) - 128
    full = np.full((64, 64), 255)
    words = rng.integers(0, 256, (300, 4))
    zones = np.where((y < 32)[..., None], rng.integers(0, 16, (64, 64, 4)), rng.integers(200, 216, (64, 64, 4)))
    pictures = {
        "inverse_predictor": np.stack([full, 3 * x + 2 * y, x + 5 * y + rng.integers(0, 2, (64, 64)), 2 * x + 3 * y], -1),
        "inverse_colour": np.stack([full, (signed * 12 >> 5) + rng.integers(0, 2, (64, 64)), noise, (signed * -20 >> 5) + rng.integers(0, 2, (64, 64))], -1),
        "add_green": np.stack([full, noise + rng.integers(0, 2, (64, 64)), noise, noise + rng.integers(0, 3, (64, 64))], -1),
        "inverse_palette": rng.integers(0, 256, (5, 4))[rng.integers(0, 5, (64, 61))],
        "cache": np.where(rng.random((64, 64, 1)) < 0.5, words[rng.integers(0, 40, (64, 64))], rng.integers(0, 256, (64, 64, 4))),
        "_read_tiled": zones,
        "_distance": np.concatenate([words[:150], words[20:90], words[:130], words[3:53]]).reshape(25, 16, 4),
    }
    for name, picture in pictures.items():
        picture = (picture & 255).astype(np.uint8)
        used, pixels = steps_of(monkeypatch, webp.encode(picture))
        assert (pixels == picture).all() and name in used, (name, used)


def test_small_payloads_have_fitted_codes():
    """Codes are those of the payload's own bytes, channel by channel; copies need no whole row."""
    size = lambda t: len(webp.store(webp.payload_of(t)[0]))
    assert size("qzqjqxqw" * 8) < 60
    rng = np.random.default_rng(6)
    once = "".join(map(chr, rng.integers(97, 123, 4 * 150)))
    assert size(once * 6) < size(once) + 60


@settings(max_examples=150, deadline=None)
@given(st.integers(1, 40), st.integers(1, 40), st.integers(1, 256), st.integers(0, 2**32 - 1), st.integers(0, 3))
def test_any_picture_comes_back(height, width, colours, seed, kind):
    rng = np.random.default_rng(seed)
    picture = rng.integers(0, colours, (height, width, 4)).astype(np.uint8)
    if kind == 1:
        picture = np.cumsum(np.cumsum(picture % 3, 0), 1).astype(np.uint8)
    elif kind == 2:
        picture = picture.reshape(-1, 4)[rng.integers(0, min(colours, height * width), (height, width))]
    elif kind == 3:
        picture[..., (1, 3)] = picture[..., 2:3] + rng.integers(0, 3, (height, width, 1))
    assert (webp.decode(webp.encode(picture)) == picture).all()


def test_copies_and_cache_over_spans(monkeypatch):
    """Long images are read span by span: copies reach into spans before, overlap themselves, and fill the cache."""
    rng = np.random.default_rng(7)
    words = rng.integers(0, 256, (400, 4)).astype(np.uint8)
    p = np.where(rng.random((3000, 1)) < 0.5, words[rng.integers(0, 40, 3000)], rng.integers(0, 256, (3000, 4))).astype(np.uint8)
    picture = np.concatenate([p[:1500], p[100:700], np.tile(p[3:5], (60, 1)), p[1500:], p[1400:1680], np.tile(p[:3], (40, 1))]).reshape(-1, 20, 4)
    media = webp.encode(picture)
    assert {"cache", "_distance"} <= steps_of(monkeypatch, media)[0]
    for span in (700, 5000, 1 << 19):
        monkeypatch.setattr(webp, "_SPAN", span)
        assert (webp.decode(media) == picture).all()
