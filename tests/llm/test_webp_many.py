"""op10 in batches: the same files and pixels as one by one, in far fewer calls."""

import cProfile
import pstats
import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tessella.llm import webp, webp_many

WORDS = "the of and model data with from token which have their under every sharp lines mountain quick water über наука 日本 x1 42 . , \n".split(" ")


def texts(n, seed):
    """Prose of 0 to 2,500 words, repeated passages, columns that are alike, and junk."""
    rng, out = random.Random(seed), []
    for k in range(n):
        words = rng.choices(WORDS, k=int(rng.paretovariate(0.7) * 20) % 2500)
        if k % 3 == 0:
            words += words[: len(words) // 2] + words[-5:] * 9
        if k % 7 == 0:
            words = [x[0] * 4 for x in words if x]
        if k % 11 == 0:
            words = ["".join(map(chr, rng.choices(range(32, 300), k=rng.randrange(900))))]
        if k % 13 == 0:
            words = ["%03d " % (j * k % 256) for j in range(rng.randrange(400))]
        out.append(webp.payload_of(" ".join(words))[0])
    return out


def pixels(files):
    return [p.tobytes() for p in webp_many.load(files)]


def test_same_files_as_one_by_one():
    payloads = texts(400, 1) + [bytes(64), webp.payload_of("x" * 9000)[0], random.Random(2).randbytes(64 * 1100)]
    want = [webp.store(p) for p in payloads]
    assert webp_many.store(payloads) == want
    assert pixels(want) == [p.ljust(webp.decode(m).size, b"\0") for p, m in zip(payloads, want)]


@settings(max_examples=60, deadline=None)
@given(st.lists(st.one_of(st.text(max_size=300), st.text(alphabet="ab \n", max_size=3000), st.binary(max_size=600).map(lambda b: b.decode("latin-1"))), max_size=9))
def test_any_payloads(some):
    payloads = [webp.payload_of(t)[0] for t in some]
    files = webp_many.store(payloads)
    assert files == [webp.store(p) for p in payloads] and pixels(files) == payloads


@pytest.mark.parametrize("in_step", [0, 5, 1000])
def test_copies_and_cache_in_step(monkeypatch, in_step):
    """Files of many lengths, read in step until few are left, in the middle of copies too."""
    monkeypatch.setattr(webp_many, "_IN_STEP", in_step)
    rng, payloads = np.random.default_rng(3), []
    for k in range(60):
        words = rng.integers(0, 256, (40, 4)).astype(np.uint8)
        p = np.where(rng.random((400, 1)) < 0.5, words[rng.integers(0, 40, 400)], rng.integers(0, 256, (400, 4))).astype(np.uint8)
        payloads.append(np.concatenate([p, np.tile(p[5:8], (20 * (k % 5), 1)), p[: 16 * k]]).tobytes())
        payloads[-1] += bytes(-len(payloads[-1]) % 64)
    files = webp_many.store(payloads)
    assert files == [webp.store(p) for p in payloads] and pixels(files) == payloads


def test_broken_files_among_good_ones():
    files = webp_many.store(texts(80, 4))
    for bad in (b"", files[3][:-9], files[3][:22], b"RIFX" + files[3][4:], files[3][:20] + b"\0" + files[3][21:]):
        with pytest.raises(webp.Broken):
            webp_many.load([*files, bad])
    rng = random.Random(5)
    for _ in range(150):  # a changed bit: the same pixels or the same error as read alone
        k = rng.randrange(len(files))
        bad = bytearray(files[k])
        bad[rng.randrange(20, min(len(bad), 90))] ^= 1 << rng.randrange(8)
        try:
            want = webp.decode(bytes(bad)).tobytes()
        except webp.Broken:
            with pytest.raises(webp.Broken):
                webp_many.load([*files[:3], bytes(bad)])
        else:
            assert pixels([*files[:3], bytes(bad)])[3] == want


def test_calls_for_each_text():
    """The time of short texts goes into calls: one by one a text takes over 2,000 to write and as many to read."""
    payloads = texts(600, 6)
    files = webp_many.store(payloads)

    def calls(run, *args):
        profile = cProfile.Profile()
        profile.runcall(run, *args)
        return pstats.Stats(profile).total_calls / len(payloads)

    assert calls(webp_many.store, payloads) < 1000
    assert calls(webp_many.load, files) < 1000
