"""Operators 8 and 9, and the pipeline."""

import random

import numpy as np
import pytest

from tessella.llm import bagminhash, blocks

SCHEMA = "doc_id long, text string, a long, rep string"


def frame(spark, rows):
    return spark.createDataFrame([(i, t, 0, "x") for i, t in rows], SCHEMA)


def brute_classes(rows):
    bags = {i: bagminhash.shingles(bagminhash.word_hashes(t or "")) for i, t in rows}
    root = {i: i for i in bags}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    ids = sorted(bags)
    for n, i in enumerate(ids):
        for j in ids[n + 1 :]:
            if bagminhash.similarity(bags[i], bags[j]) >= bagminhash.SIMILAR:
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    return {i: find(i) for i in ids}


@pytest.fixture(scope="module")
def copies():
    rng = random.Random(2)
    vocabulary = ["".join(rng.choices("abcdefghij", k=5)) for _ in range(400)]
    rows, k = [], 0

    def put(t):
        nonlocal k
        rows.append((k, t))
        k += 1

    for base in range(8):
        text = [rng.choice(vocabulary) for _ in range(150)]
        put(" ".join(text))
        for _ in range(rng.randint(0, 12)):
            new = list(text)
            for _ in range(rng.randint(0, 5)):
                new[rng.randrange(150)] = rng.choice(vocabulary)
            put(" ".join(new))
            if rng.random() < 0.4:
                text = new  # a chain: the next copies drift on
    for _ in range(40):
        put(" ".join(rng.choice(vocabulary) for _ in range(rng.randint(1, 80))))
    for t in (None, "", "  ", "One two", "one TWO", "one two three", rows[0][1], rows[0][1].upper().replace(" ", "\n "), "na " * 50, "na " * 60, "na " * 20):
        put(t)
    return rows


def test_classes_against_brute_force(spark, copies):
    got = {r.doc_id: r.class_id for r in bagminhash.report(frame(spark, copies)).collect()}
    assert got == brute_classes(copies)
    kept = bagminhash.keep_one(frame(spark, copies))
    assert kept.columns == SCHEMA.replace(",", "").split()[::2] and sorted(r.doc_id for r in kept.collect()) == sorted(set(got.values()))


def test_blocks_of_a_bucket(spark, copies, monkeypatch):
    """Buckets dealt into lots of three documents give the same classes."""
    monkeypatch.setattr(bagminhash, "LOT", 3)
    got = {r.doc_id: r.class_id for r in bagminhash.report(frame(spark, copies)).collect()}
    assert got == brute_classes(copies)


def test_similarities_of_a_block():
    rng = random.Random(4)
    bags = [bagminhash.shingles(bagminhash.word_hashes(" ".join(rng.choices("abc", k=rng.randint(1, 60))))) for _ in range(30)]
    wanted = np.triu(np.ones((30, 30), bool), 1)
    want = [[bagminhash.similarity(a, b) if i < j else 0.0 for j, b in enumerate(bags)] for i, a in enumerate(bags)]
    assert bagminhash.similarities(bags, wanted, 7).tolist() == want
    few = np.zeros((30, 30), bool)
    few[2, 5] = True
    assert bagminhash.similarities(bags, few)[2, 5] == want[2][5]


def test_recall_on_the_given_documents(spark):
    """All pairs of the smallest real table by counts of shared shingles, against the classes."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text")
    bags = {r.doc_id: bagminhash.shingles(bagminhash.word_hashes(r.text or "")) for r in docs.collect()}
    holders, shared = {}, {}
    for i, (h, w) in bags.items():
        for x, n in zip(h.tolist(), w.tolist()):
            for j, m in holders.get(x, ()):
                shared[i, j] = shared.get((i, j), 0) + min(n, m)
            holders.setdefault(x, []).append((i, n))
    total = {i: int(w.sum()) for i, (_, w) in bags.items()}
    links = [p for p, n in shared.items() if n / (total[p[0]] + total[p[1]] - n) >= bagminhash.SIMILAR]
    root = {i: i for i in bags}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in links:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    got = {r.doc_id: r.class_id for r in bagminhash.report(docs).collect()}
    assert len(links) > 50 and sum(got[a] == got[b] for a, b in links) >= 0.9 * len(links)
    assert all(find(i) == find(c) for i, c in got.items())  # and nothing else is joined


def test_corner_cases(spark):
    two = [(1, "a b c d e f g h"), (1, "p q r s t u v w"), (2, "p q r s t u v w x"), (3, "one"), (3, "two")]
    assert {r.doc_id for r in bagminhash.report(frame(spark, two)).collect()} == {1, 2, 3}
    assert bagminhash.report(frame(spark, [])).collect() == []
    again = [(1, "a b c d e f g"), (1, "a b c d e f g"), (2, "a b c d e f g"), (None, "a b"), (3, None)]
    assert sorted(tuple(r) for r in bagminhash.report(frame(spark, again)).collect()) == [(1, 1), (1, 1), (2, 1), (3, 3)]
    assert sorted((r.doc_id is None, r.doc_id) for r in bagminhash.keep_one(frame(spark, again)).collect()) == [(False, 1), (False, 3), (True, None)]


def test_signatures_estimate_without_bias():
    rng, errors = np.random.default_rng(0), []
    for _ in range(150):
        h = rng.integers(0, 1 << 63, 60).astype(np.uint64)
        w = rng.integers(1, 40, 60)
        v = np.maximum(1, w + rng.integers(-6, 7, 60))
        cut = rng.integers(30, 60)
        a, b = (h, w), (h[:cut], v[:cut])
        order = [np.argsort(x[0]) for x in (a, b)]
        a, b = (a[0][order[0]], a[1][order[0]]), (b[0][order[1]], b[1][order[1]])
        errors.append((bagminhash.signature(*a) == bagminhash.signature(*b)).mean() - bagminhash.similarity(a, b))
    assert abs(np.mean(errors)) < 0.012 and np.std(errors) < 0.06


def test_components(spark):
    rng, edges = random.Random(1), []
    edges += [(i, i + 1) for i in range(0, 60)]
    edges += [(1000, 1000 + i) for i in range(1, 50)]
    edges += [(rng.randrange(2000, 2100), rng.randrange(2000, 2100)) for _ in range(60)]
    root = {}
    for a, b in edges:
        root.setdefault(a, a), root.setdefault(b, b)

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in edges:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    got = {r.doc: r.comp for r in bagminhash.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {x: find(x) for x in {y for a, b in edges if a != b for y in (a, b)}}


# --- pages -----------------------------------------------------------------------------------


def test_leaf_blocks():
    page = '<body><nav><a href=x>Home</a></nav><!-- <p>no</p> --><script>var t="</p><p>no";</script><div class="post"><p>A &amp; B<br>c <b>d</b>e<p>x &lt; y 1 < 2</div><p hidden>no</p><textarea>no</textarea><p>end &copy'
    found = blocks.leaf_blocks(page)
    assert [b.text for b in found] == ["Home", "A & B c de", "x < y 1 < 2", "end ©"]
    assert found[1].path[-2:] == ("n:post", "t:p") and found[0].linked == 4


@pytest.mark.parametrize(
    "page, shown",
    [
        ('<article data-title="The hidden cost"><p>a</p></article><p class="hidden md:block">b</p><p>c <a title="a hidden gem">d</a></p>', ["a", "b", "c d"]),
        ("<p title='x display:none'>a</p><p style='color:red; DISPLAY : none'>no</p><p hidden=''>no</p><p id=x hidden>no</p><p>b", ["a", "b"]),
        ("<p hidden>no <b>no</b><p>a<ul><li style='display:none'>no<li>b</ul>c", ["a", "b", "c"]),
        ("<div hidden><div>no</div><p>no<svg></svg>no 1 < 2</div>a<p>b <span hidden>no<br>no</span> c</p><p>d<i hidden>no</p>e", ["a", "b c", "d", "e"]),
        ('<p>a<svg class="i"/> b<p>c<svg><svg/><path/>no</svg> d<math /> e', ["a", "b", "c", "d", "e"]),
    ],
)
def test_only_what_is_hidden_goes(page, shown):
    assert [b.text for b in blocks.leaf_blocks(page)] == shown


def test_model_reads_layouts():
    """Held-out sample pages: blocks labelled as they were written."""
    w, rng, hits, total = blocks.trained(), random.Random(12345), 0, 0
    for _ in range(150):
        _, found, y = blocks.labelled_page(rng)
        p = blocks.labels_of([blocks.page_vectors(found)], w)[0]
        hits, total = hits + int((p == y).sum()), total + len(y)
    assert hits / total > 0.97


def test_every_word_of_a_block_counts():
    """Words in the middle of long blocks change their hashed words."""
    plain = ["wa"] * 200
    vector = lambda w: blocks.page_vectors([blocks.Block(("t:p",), " ".join(w), 0)])[0, blocks.PATH : blocks.PATH + blocks.WORDS]
    for at in (0, 15, 100, 199):
        for word in ("subscribe", "cookies", "12"):
            assert not np.array_equal(vector(plain), vector(plain[:at] + [word] + plain[at + 1 :])), (at, word)
    assert np.isclose(vector(plain).max(), 2)


def test_gradients():
    rng = np.random.default_rng(0)
    w = {k: v.astype(np.float64) for k, v in blocks.new_weights(1).items()}
    x = rng.normal(0, 1, (4, 2, blocks.PATH + blocks.WORDS + blocks.COUNTS))
    mask, y = np.array([[1, 1], [1, 1], [1, 0], [1, 0]], bool), rng.integers(0, 2, (4, 2)).astype(float)
    _, g = blocks._gradients(x, mask, y, w)
    for name in ("hf", "xb", "bf", "out", "hb"):
        at = tuple(rng.integers(0, n) for n in w[name].shape)
        step = 1e-3
        w[name][at] += step
        up = blocks._gradients(x, mask, y, w)[0]
        w[name][at] -= 2 * step
        down = blocks._gradients(x, mask, y, w)[0]
        w[name][at] += step
        assert abs((up - down) / (2 * step) - g[name][at]) < 2e-4 + 0.03 * abs(g[name][at]), name


def test_long_pages_run_in_windows():
    w = blocks.trained()
    x = np.random.default_rng(1).random((700, blocks.PATH + blocks.WORDS + blocks.COUNTS)).astype(np.float32)
    assert len(blocks.labels_of([x], w, longest=64)[0]) == 700 and blocks.labels_of([x[:0]], w)[0].shape == (0,)


def test_long_pages_are_read_as_a_whole():
    """Parts of any size give the labels of one run; with weights that remember, the first and last block reach all others."""
    rng = np.random.default_rng(2)
    w = {k: v * 2 for k, v in blocks.new_weights(5).items()}
    for d in "fb":
        w[f"b{d}"][blocks.HIDDEN : 2 * blocks.HIDDEN] = 9
    for k in range(6):
        x = (rng.random((700, blocks.PATH + blocks.WORDS + blocks.COUNTS)) < 0.1).astype(np.float32)
        x[0 if k % 2 else -1] *= 9
        want = blocks.labels_of([x], w, longest=700)[0]
        assert 0 < want.sum() < 700
        for longest in (32, 64, 99, 699):
            assert np.array_equal(blocks.labels_of([x], w, longest=longest)[0], want), longest


def test_page_frames(spark):
    page = "<html><body><nav><ul><li><a href=/a>Home</a><li><a href=/b>News</a></ul></nav><article><h1>A title here</h1><p>Some longer text that stands in the article. And more of it.</p></article><footer>&copy; x</footer></body></html>"
    df = spark.createDataFrame([(1, "u", page, "t"), (2, None, None, "t"), (3, "u", "", "t"), (4, "u", page, "t"), (5, "u", "<p", "t")], "page_id long, url string, html string, text string")
    got = {r.page_id: r for r in blocks.extract(df).collect()}
    want = "A title here Some longer text that stands in the article. And more of it."
    assert got[1].text == got[4].text == want and got[1].n_chars == len(want)
    assert [got[k].text for k in (2, 3, 5)] == ["", "", ""] and blocks.extract(df.limit(0)).count() == 0


# --- pipeline --------------------------------------------------------------------------------


def test_pipeline(spark, tmp_path):
    import corpus_pipeline

    rng = random.Random(8)
    vocabulary = ["".join(rng.choices("abcdefghij", k=rng.randint(3, 7))) for _ in range(300)]
    text = lambda n: " ".join(rng.choice(vocabulary) for _ in range(n))
    item = text(40)
    docs = [text(rng.randint(5, 120)) for _ in range(120)]
    labels = []
    for i in range(120):
        bad = i % 5 == 0
        labels.append((i, 1, int(bad)))
        if bad:
            docs[i] += " you idiot"
    docs += [docs[1], docs[2] + " x", text(30) + " " + item.upper() + " " + text(30), text(20) + " mail a@b.cd now", "", None]
    spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in enumerate(docs)], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(0, item)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    at = spark.read.parquet(f"{tmp_path}/documents.parquet")
    names, kept = at.columns, []
    for name, stage in corpus_pipeline.STAGES[:-1]:
        at = stage(spark, at, str(tmp_path))
        assert at.columns == names
        kept.append({r.doc_id: r.text for r in at.collect()})
    toxic = {i for i, t in enumerate(docs) if t and "idiot" in t}
    assert set(kept[0]) == set(range(len(docs))) - toxic
    classes = brute_classes([(i, docs[i]) for i in kept[0]])
    assert set(kept[1]) == set(classes.values())
    assert set(kept[1]) - set(kept[2]) == {122}
    assert kept[3][123].endswith("mail [EMAIL] now") and all(kept[3][i] == docs[i] for i in kept[3] if i != 123)
    pieces = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert {r.doc_id for r in pieces} == set(kept[3])
