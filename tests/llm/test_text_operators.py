"""Operators 1, 2, 3 and 4 against brute-force versions and defined corner cases."""

import random
import re
import time
import unicodedata
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tessella.llm import decontam, pii, substring, toxicity

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, spans string"


def frame(spark, texts):
    return spark.createDataFrame([(i, t, "en", "s", len(t or ""), "x") for i, t in enumerate(texts)], SCHEMA)


def words(n, seed):
    r = random.Random(seed)
    return " ".join("".join(r.choices("abcdefghijklmnop", k=r.randint(3, 8))) for _ in range(n))


def prose(n, seed):
    r, out = random.Random(seed), []
    w = words(n, seed).split()
    while w:
        k = r.randint(4, 9)
        out.append(" ".join(w[:k]).capitalize() + ".")
        w = w[k:]
    return " ".join(out)


# --- substring -------------------------------------------------------------------------------


def slow_pieces(t):
    """(end, normalised piece, words), word by word."""
    w = [(m.start(), m.end()) for m in re.finditer(r"\S+", t)]
    keys = (substring.Batch([t]).hash >> np.uint64(33)).tolist()
    gaps = [t[b : w[k + 1][0] if k + 1 < len(w) else len(t)] for k, (_, b) in enumerate(w)]
    last = [bool(re.fullmatch(r"(?s).*[.!?…][\"')\]»”]*", t[a:b])) or "\n" in gap for (a, b), gap in zip(w, gaps)]
    last[-1:] = [True] * bool(last)
    cut = list(last)
    for k in range(len(w) - substring.WINDOW + 1):
        if not any(last[k : k + substring.WINDOW - 1]):
            cut[min(range(k, k + substring.WINDOW), key=lambda i: (keys[i], -i))] = True
    out, at = [], 0
    for k, c in enumerate(cut):
        if c:
            out.append((w[k + 1][0] if k + 1 < len(w) else len(t), " ".join(t[a:b].lower() for a, b in w[at : k + 1]), k + 1 - at))
            at = k + 1
    return out


def slow_runs(parts):
    for i in range(len(parts)):
        for j in range(i + substring.RUN, len(parts) + 1):
            if sum(p[2] for p in parts[i:j]) >= substring.MIN_WORDS:
                yield i, j
                break


def brute_spans(texts):
    seen, out = {}, []
    parts = [slow_pieces(t or "") for t in texts]
    key = lambda p, i, j: " ".join(x[1] for x in p[i:j])
    for d, p in enumerate(parts):
        for i, j in slow_runs(p):
            k = key(p, i, j)
            seen[k] = min(seen.get(k, (d, i)), (d, i))
    for d, p in enumerate(parts):
        gone = set()
        for i, j in slow_runs(p):
            if seen[key(p, i, j)] != (d, i):
                gone |= set(range(i, j))
        out.append("".join((texts[d] or "")[p[k - 1][0] if k else 0 : p[k][0]] for k in range(len(p)) if k not in gone) + (texts[d] or "")[p[-1][0] if p else 0 :])
    return out


def test_substring_against_brute_force(spark):
    shared = prose(60, 1)
    texts = [prose(80, 2) + "\n" + shared + "\n" + prose(40, 3), shared + " " + prose(30, 4), prose(50, 5), None, "", "One.", prose(30, 6) + " " + shared + " " + shared, words(400, 7), words(30, 8) + " " + words(400, 7), "İ " + shared, words(150_000, 9) + ". " + shared]
    got = {r.doc_id: r for r in substring.dedup(frame(spark, texts)).collect()}
    want = brute_spans(texts)
    for d, t in enumerate(texts):
        assert (got[d].text or "") == want[d], d
    assert shared in got[0].text and got[2].text == texts[2] and got[3].text is None
    assert shared not in got[1].text and got[1]._sources == [0]
    assert shared not in got[6].text and len(got[8].text) < len(texts[8]) and got[0].spans == "x"
    assert substring.report(frame(spark, [])).collect() == []


def test_every_repeated_passage_of_51_words_is_found(spark):
    """Passages of 51 words behind many beginnings: each 51-word window seen before, by words, loses words; half of them at least."""
    rng, texts, lost = random.Random(3), [], []
    for n in range(150):
        w = words(51, 1000 + n).split()
        for cut in ([17, 34], [24], [], [9, 21, 40], [25])[n % 5]:
            w[cut - 1] += "."
        passage = " ".join(w)
        texts += [words(rng.randint(0, 30), 5000 + n) + rng.choice([". ", " ", "\n"]) + passage + rng.choice([" ", ". "]) + words(9, 7000 + n), rng.choice(["As stated, ", "Note: ", "", "And so "]) + passage + rng.choice(["", " " + words(7, 9000 + n)])]
    seen, repeated = set(), []
    for t in texts:
        w = t.lower().replace(".", "").split()
        grams = {tuple(w[k : k + 51]) for k in range(len(w) - 50)}
        repeated.append(bool(grams & seen))
        seen |= grams
    assert repeated == [False, True] * 150
    for r in substring.dedup(frame(spark, texts)).collect():
        gone = len(texts[r.doc_id].split()) - len(r.text.split())
        assert (gone > 0) == repeated[r.doc_id], texts[r.doc_id]
        lost += [gone] if gone else []
    assert min(lost) >= substring.MIN_WORDS and sum(lost) / len(lost) > 30


@settings(max_examples=300, deadline=None)
@given(st.lists(st.text(alphabet="ab .!\n?é”)İß\u2003\x1c", max_size=120), max_size=4))
def test_pieces_and_runs_of_a_batch(texts):
    batch = substring.Batch(texts)
    of, first, end = batch.runs()
    for d, t in enumerate(texts):
        parts = slow_pieces(t)
        a, b = batch.first_piece[d : d + 2]
        assert b - a == len(parts) and batch.places(d, t).tolist() == [p[0] for p in parts]
        assert [(i - a, j - a) for k, i, j in zip(of, first, end) if k == d] == list(slow_runs(parts))
    h = [x.tolist() for x in batch.hashes(first, end)]
    flat = [p[1] for t in texts for p in slow_pieces(t)]
    keys = [" ".join(flat[i:j]) for i, j in zip(first, end)]
    for n in range(len(keys)):
        assert keys.index(keys[n]) == list(zip(*h)).index((h[0][n], h[1][n]))


# --- PII -------------------------------------------------------------------------------------

PLAIN = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(?:\.[0-9]+)(?:\.[0-9]+)(?:\.[0-9]+)", "card": r"[0-9](?:[\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def brute_pii(t):
    def ok(k, s):
        d = re.sub(r"\D", "", s) if k != "ip" else ""
        if k == "ip":
            return all(int(x) <= 255 for x in s.split("."))
        if k == "phone":
            return 9 <= len(d) <= 15
        if k == "card":
            total = sum(int(c) if i % 2 == 0 else sum(divmod(2 * int(c), 10)) for i, c in enumerate(reversed(d)))
            return 13 <= len(d) <= 19 and total % 10 == 0
        return True

    return {k: [m.span() for m in re.finditer(p, t) if ok(k, m.group())] for k, p in PLAIN.items()}


@settings(max_examples=1000, deadline=None)
@given(st.one_of(st.text(alphabet="ab@.-_%+ 0123456789()x\n", max_size=60), st.lists(st.sampled_from(["a@b.c", "1.2.3.4", "256.1.1.1", "4111 1111 1111 1111", "+1 (555) 123-4567", "_x@", ".", "-", " ", "@", "0001.2.3.4"]), max_size=8).map("".join)))
def test_base_spans_are_the_plain_ones(t):
    assert pii.detect(t) == brute_pii(t)
    base, full = pii.find(t)
    assert all(set(base[k]) <= set(full[k]) for k in base)


@pytest.mark.parametrize(
    ("text", "kind", "found"),
    [
        ("write john.doe [at] example [dot] com now", "email", "john.doe [at] example [dot] com"), ("to jane at mail dot example dot org ok", "email", "jane at mail dot example dot org"), ("x jоhn@exаmple.com y", "email", "jоhn@exаmple.com"), ("x " + "long" * 40 + " at mail dot a dot b dot c dot d dot e dot f dot g dot org y", "email", "long" * 40 + " at mail dot a dot b dot c dot d dot e dot f dot g dot org"), ("call plus one (four one five) double five five two six seven one", "phone", "plus one (four one five) double five five two six seven one"), ("j@​example.com", "email", "j@​example.com"),
        ("call plus one four one five five five five two six seven one", "phone", "plus one four one five five five five two six seven one"), ("ip one nine two dot one six eight dot one dot one", "ip", "one nine two dot one six eight dot one dot one"), ("４１１１ １１１１ １１１１ １１１１", "card", "４１１１ １１１１ １１１１ １１１１"),
        ("card four one one one one one one one one one one one one one one one", "card", "four one one one one one one one one one one one one one one one"),
    ],
)
def test_disguises(text, kind, found):
    base, full = pii.find(text)
    assert not base[kind] and [text[a:b] for a, b in full[kind]] == [found]


def slow_rewrite(t):
    """The transducers told character by character: a list of (written, start, end, rewritten)."""
    cells = [(c, i, i + 1, False) for i, c in enumerate(t)]

    def swap(pattern, new):
        nonlocal cells
        s, out, at = "".join(c[0] for c in cells), [], 0
        for m in re.finditer(pattern, s):
            x = new(m)
            if x is None:
                continue
            out += cells[at : m.start()] + [(y, cells[m.start()][1], cells[m.end() - 1][2], True) for y in x]
            at = m.end()
        cells = out + cells[at:]

    swap(".", lambda m: (x if len(x := unicodedata.normalize("NFKC", m.group())) == 1 and x != m.group() and (m.group() in "４１５＠．" or x.isdigit()) else pii._LATIN.get(m.group())))
    swap(r"\s*(?:[\[({<]\s*(?:at|arroba|@)\s*[\])}>]|_at_)\s*", lambda m: "@")
    swap(r"\s*(?:[\[({<]\s*(?:dot|\.)\s*[\])}>]|_dot_)\s*", lambda m: ".")
    one = "(?:" + "|".join(sorted(pii._DIGITS, key=len, reverse=True)) + "|[0-9]+)"
    run = rf"(?<![^\W_])(?:plus[ -]+)?{one}(?:[ ,-]+(?:(?:dot|dash)[ ,-]+)?{one}(?![^\W_])){{3,}}"

    def figures(m):
        x = "".join("+" if w == "plus" else "." if w == "dot" else "" if w == "dash" else pii._DIGITS.get(w, w) for w in re.findall(r"[^\W_]+", m.group()))
        return x if re.search("[a-z]", m.group()) else None

    if sum(w in pii._SIGNS for w in re.findall(r"[^\W_]+", "".join(c[0] for c in cells))) >= 2:
        swap(run, figures)
    return cells


@settings(max_examples=600, deadline=None)
@given(st.lists(st.sampled_from(["joe", "mail", "org", "[at]", "( at )", "[dot]", "_at_", "４", "１", "ｅ", "one", "two", "nine", "eight", "plus", "dot", "dash", "12", "192", "@", ".", " ", " ", " ", " ", "-", "a@b.co", "о", "x"]), max_size=14).map("".join))
def test_added_spans_against_slow_transducers(t):
    """Texts without bare at and dot between words: what the slow version finds in rewritten places, and no more."""
    if pii._WORDY.search("".join(c[0] for c in slow_rewrite(t))) or " at " in t:
        return
    cells = slow_rewrite(t)
    base, full = pii.find(t)
    want = {}
    for kind, spans in brute_pii("".join(c[0] for c in cells)).items():
        own = [(cells[a][1], cells[b - 1][2]) for a, b in spans if any(c[3] for c in cells[a:b])]
        want[kind] = sorted(base[kind] + [(a, b) for a, b in own if all(b <= x or y <= a for x, y in base[kind])])
    assert full == want


@pytest.mark.parametrize("text", ["", "meet at noon. then go", "john @ example . com", "one two three", "look at the dot com", "(555) one", "un un un un un"])
def test_clean_texts_stay_clean(text):
    assert not any(pii.find(text)[1].values())


def test_pii_frames(spark):
    got = pii.scan(frame(spark, [None, "", "a@b.cd", "a@b.cd"])).collect()
    assert [(r.n_email, r.spans) for r in got] == [(0, ""), (0, ""), (1, "email:0:6"), (1, "email:0:6")]
    masked = pii.scan(frame(spark, [None, "hi a@b.cd"]), masked=True)
    assert masked.columns == SCHEMA.replace(",", "").split()[::2] and [r.text for r in masked.collect()] == [None, "hi [EMAIL]"]


def test_long_runs_are_linear():
    for t in ("a" * 300_000, "1" * 300_000, "a@" * 100_000, "1." * 150_000, "one " * 50_000, "(one) " * 50_000, " " * 300_000 + "_", "[" + " " * 300_000 + "at", "[ " * 150_000, "a at " * 60_000, "a at b dot " * 30_000, "one (" * 60_000, "double " * 50_000 + "one two three four", "plus - " * 50_000 + "one two", "a.b " * 80_000 + "@"):
        began = time.process_time()
        pii.find(t)
        assert time.process_time() - began < 4, t[:20]


# --- decontamination -------------------------------------------------------------------------


def edits(t, n, rng):
    s = list(t)
    for _ in range(n):
        k, o = rng.randrange(len(s)), rng.random()
        if o < 0.34:
            s[k] = rng.choice("qxyz")
        elif o < 0.67:
            del s[k]
        else:
            s.insert(k, rng.choice("qxyz"))
    return "".join(s)


def brute_distance(item, doc):
    row = [0] * (len(doc) + 1)
    for a in item:
        new = [row[0] + 1]
        for j, b in enumerate(doc, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (a != b)))
        row = new
    return min(row)


def test_decontamination_against_brute_force():
    rng = random.Random(3)
    items = [(k, words(n, 100 + k)) for k, n in enumerate((12, 20, 40, 6, 3))]
    bench = decontam.Benchmark([*items, (9, "ab c"), (10, ""), (11, None)])
    for trial in range(60):
        k, item = items[trial % len(items)]
        n = len(item)
        text = words(40, trial) + " " + edits(item, rng.randint(0, int(0.1 * n)), rng) + " " + words(30, trial + 500)
        flat = "".join(map(chr, decontam.normal(text)[0]))
        for j, other in items:
            e = decontam.budget(len(other))[0]
            best = brute_distance(other, flat)
            assert (j in {m[0] for m in bench.matches(text)}) == (best <= e)
            if best <= e:
                assert {m[0]: m[1] for m in bench.matches(text)}[j] == best
    assert [m[0] for m in bench.matches("so AB, c!")] == [9] and bench.matches("grab c") == [] and bench.matches("") == []


def test_decontamination_frames(spark, monkeypatch):
    item = words(30, 1)
    docs = frame(spark, [None, "", words(50, 2), words(20, 3) + " " + item.upper().replace(" ", ", ") + "! " + words(20, 4), item])
    bench = spark.createDataFrame([(0, item), (1, item), (2, None), (None, "x"), (3, words(25, 9))], "item_id long, text string")
    for limit in (decontam.BLOCK_CHARS, 10):  # one block, and a block for each item
        monkeypatch.setattr(decontam, "BLOCK_CHARS", limit)
        got = {r.doc_id: r for r in decontam.report(docs, bench).collect()}
        assert [got[k].item_ids for k in range(5)] == [[], [], [], [0, 1], [0, 1]]
    assert sorted(r.doc_id for r in decontam.clean(docs, bench).collect()) == [0, 1, 2]
    assert decontam.clean(docs, bench).columns == docs.columns
    assert decontam.clean(docs, bench.limit(0)).count() == 5 and decontam.report(docs.limit(0), bench).count() == 0
    # rows with one id are each found, and columns of any name pass through
    twice = spark.createDataFrame([(7, item), (7, words(20, 3)), (7, words(25, 9)), (8, "ab c"), (8, "ab d")], "item_id long, text string")
    named = docs.selectExpr("*", "1 AS _matches", "2 AS _row", "3 AS _matches_")
    for limit in (10, 8_000_000):
        monkeypatch.setattr(decontam, "BLOCK_CHARS", limit)
        assert {r.doc_id: r.item_ids for r in decontam.report(docs, twice).collect()} == {0: [], 1: [], 2: [], 3: [7, 7], 4: [7]}
        assert decontam.clean(named, twice).columns == named.columns and decontam.clean(named, twice).count() == 3
    long = words(200_000, 77) + " " + item
    assert [r.item_ids for r in decontam.report(frame(spark, [long]), twice).collect()] == [[7]]


# --- toxicity --------------------------------------------------------------------------------


@pytest.fixture(scope="module")
def tox(spark):
    rng, texts, labels = random.Random(5), [], []
    vocabulary = words(300, 11).split()
    for i in range(400):
        w = [rng.choice(vocabulary) for _ in range(40)]
        bad = i % 4 == 0
        if bad:
            w[rng.randrange(40)] = rng.choice(["idiot", "stupid", "moron"])
        texts.append(" ".join(w))
        labels.append((i, int(bad)))
    texts += [None, "", "you 1d10t here", "you st**id one", "an i d i o t here", "what a mmmoooron", texts[1]]
    return frame(spark, texts), spark.createDataFrame(labels, "doc_id long, toxic int"), texts


def test_toxicity(spark, tox):
    docs, labels, texts = tox
    got = {r.doc_id: r for r in toxicity.score(docs, labels).collect()}
    assert len(got) == len(texts)
    for i in range(400):
        assert got[i].predicted == (i % 4 == 0) == (got[i].score >= 0.5) and got[i].held_out == (zlib.crc32(str(i).encode()) % 5 == 0)
    assert got[400].score == got[401].score < 0.5 and got[406].score == got[1].score
    for i in (402, 403, 404, 405):
        assert got[i].predicted == 1, texts[i]
    named = toxicity.reject(docs.selectExpr("*", "1 AS _score", "2 AS _toxic"), labels)
    assert named.columns == [*docs.columns, "_score", "_toxic"]
    kept = toxicity.reject(docs, labels)
    assert kept.columns == docs.columns and {r.doc_id for r in kept.collect()} == {i for i in got if got[i].predicted == 0}


def token_ways(token, spaced):
    """For each run of a token: all (letters, cost) that it may stand for; runs of wildcards as lists of such choices."""
    for run in re.finditer(r"(.)\1*", token):
        c, n, inner = run.group(1), len(run.group()), spaced and run.start() > 0
        if c in "*#%?":
            yield [[((), 2.0)]], [[(w, p) for k in range(1, 27) for w, p in [((k,), 1.5)] + ([((0, k), 1.5 + toxicity._END_COST)] if inner else [])]] * n
        else:
            options = toxicity._options(c, n)
            yield ([[*options, *[((0, *w), p + toxicity._END_COST) for w, p in options if inner and w and w[0]]]],)


def extended(text, score, way, price, logp):
    score -= price
    for x in way:
        if x or text[-1:] not in ("", " "):
            a, b, c = (max(0, ord(y) - 96) for y in text[-3:].rjust(3))
            score += float(logp[((a * 27 + b) * 27 + c) * 27 + x])
            text += chr(96 + x) if x else " "
    return text, score


def ended(text, score, logp):
    return score + (float(logp[27 * sum(max(0, ord(y) - 96) * 27**n for n, y in enumerate(reversed(text[-3:])))]) if text and text[-1] != " " else 0.0)


def exact_restore(token, logp, spaced, merge=True):
    """The best path through the lattice; merge: of those into one context only the best is kept, else all paths are tried."""
    live = [("", 0.0)]
    for choices in token_ways(token, spaced):
        after = []
        for steps in choices:
            here = live
            for options in steps:
                here = [extended(t, s, way, price, logp) for t, s in here for way, price in options]
                if merge:
                    best = {}
                    for t, s in here:
                        key = t[-3:].rjust(3)
                        if key not in best or best[key][1] < s:
                            best[key] = (t, s)
                    here = list(best.values())
            after += here
        live = after
    return max((ended(t, s, logp), t) for t, s in live)[1].strip()


def test_restoring_is_exact_at_any_length():
    rng = random.Random(8)
    vocabulary = words(400, 12).split() + ["idiot", "stupid"]
    logp = toxicity.log_probabilities(toxicity.gram_counts([" ".join(rng.choices(vocabulary, k=60)) for _ in range(200)]))
    for n in (2, 5, 15, 15, 40, 40):
        stars = n < 15
        joined = "".join(rng.choices(vocabulary, k=n))
        joined = "".join(rng.choice(({"i": "1!*", "o": "0*", "e": "3*"} if stars else {"i": "1!", "o": "0", "e": "3", "s": "$5"}).get(c, c)) if rng.random() < 0.5 else c for c in joined)
        assert toxicity.restore(joined, logp, spaced=True) == exact_restore(joined, logp, True), joined
    for token in ("st*p#d", "*#%", "a.b-c_d", "i*d#i%ot", "1d10t..st", "mmmoorroonn", "st**id", "id**", "**a"):
        for spaced in (False, True) if "**" not in token else (False,):
            assert toxicity.restore(token, logp, spaced) == exact_restore(token, logp, spaced), token
    assert toxicity.restore("x" + "*" * 200_000 + "y", logp) == "xy"
    for token in ("1d*0t", "m0.r#n", "st**d", "**", "a1", "oo0", "$t-u", "i**"):  # every path of the lattice
        for spaced in (False, True) if token.count("*") < 2 else (False,):
            assert toxicity.restore(token, logp, spaced) == exact_restore(token, logp, spaced, merge=False), token


def test_toxicity_without_labels(spark, tox):
    docs, labels, _ = tox
    assert {r.predicted for r in toxicity.score(docs.limit(3), labels.limit(0)).collect()} == {0}
    assert {r.predicted for r in toxicity.score(docs.limit(3), labels.where("toxic = 1")).collect()} <= {0, 1}
    assert toxicity.score(docs.limit(0), labels).count() == 0


def test_labels_never_reach_held_out_rows(spark, tox):
    """Turning the labels of held-out rows round changes no score."""
    docs, labels, _ = tox
    turned = labels.selectExpr("doc_id", "CASE WHEN crc32(cast(cast(doc_id AS string) AS binary)) % 5 = 0 THEN 1 - toxic ELSE toxic END AS toxic")
    a, b = ({r.doc_id: r.score for r in toxicity.score(docs, x).collect()} for x in (labels, turned))
    assert a == b
