"""Operator 8: main text of web pages by a recurrent block labeller.

A tolerant scan cuts a page into leaf blocks, each with its tag path, the classes and ids on it, and
its text.  A bidirectional LSTM in numpy reads the page's blocks in order, each as a tag-path vector,
a hashed-word vector and a few counts, so every block is judged with all of the page before and
after it; blocks above one half are the main text.

No labels exist for pages, so the model is trained here on pages that `sample_page` writes, with
known roles (article, menu, header, footer, sidebar, notice, advert, form, comments) under many
layouts and names.  Training is seeded, takes some seconds on the driver once a process, and its
result, some 100 kB, is broadcast.

Null and empty pages, and pages of which no block is main text, give empty text.  Scripts, styles
and other content that is never shown form no blocks.  Repeated rows are read each; extra columns are ignored.
"""

from __future__ import annotations

import html
import random
import re
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

_TAG = re.compile(
    r"<(?:!--(?:>|->|.*?(?:--!?>|\Z))|(/?)([a-zA-Z][^\s/>]*+)((?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)>|(/?)([a-zA-Z][^\s/>]*+)([^>]*+)(?:>|\Z)|[!?/][^>]*+(?:>|\Z))", re.S
)
_NAMES = re.compile(r"(?:^|[\s\"'/])(class|id|role|aria-label)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))", re.I)
_ATTRIBUTE = re.compile(r"([^\s/>=]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+)))?")
_NO_DISPLAY = re.compile(r"(?:^|;)\s*display\s*:\s*none(?![\w-])", re.I)
_SPLIT_NAME = re.compile(r"[^a-z0-9]+")
_RAW = frozenset("script style template noscript title textarea iframe noframes xmp svg math select object head".split())
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr img input".split())
_CLOSES_P = frozenset("address article aside blockquote details div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr main menu nav ol p pre section table ul".split())
_CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
_SCOPE = frozenset("ul ol dl table body html article section div nav aside footer header main td th blockquote form".split())

PATH, WORDS, COUNTS, HIDDEN = 160, 32, 10, 24
DEEP = 60


class Block:
    __slots__ = ("path", "text", "linked")

    def __init__(self, path: tuple[str, ...], text: str, linked: int):
        self.path, self.text, self.linked = path, text, linked


@cache
def _tokens(tag: str, attributes: str) -> tuple[str, ...]:
    out = ["t:" + tag]
    for _, a, b, c in _NAMES.findall(attributes):
        out += ["n:" + x for x in _SPLIT_NAME.split(html.unescape(a or b or c).lower()) if x and not x.isdigit()]
    return tuple(out)


def _hidden(attributes: str) -> bool:
    """Whether there is an attribute named hidden, or a style without display."""
    low = attributes.lower()
    if "hidden" not in low and "style" not in low:
        return False
    for name, a, b, c in _ATTRIBUTE.findall(attributes):
        if name.lower() == "hidden" or name.lower() == "style" and _NO_DISPLAY.search(html.unescape(a or b or c)):
            return True
    return False


def leaf_blocks(page: str) -> list[Block]:
    """The page's shown leaf blocks in order."""
    out: list[Block] = []
    stack: list[tuple[str, tuple[str, ...]]] = []
    unseen: list[int] = []  # places in the stack of elements that aren't shown
    parts: list[str] = []
    linked = links = 0
    at = 0

    def flush() -> None:
        nonlocal linked
        if parts:
            text = " ".join(html.unescape("".join(parts)).split())
            if text:
                out.append(Block(tuple(t for _, tokens in stack[-DEEP:] for t in tokens), text, min(linked, len(text))))
            parts.clear()
        linked = 0

    n = len(page)
    while at < n:
        k = page.find("<", at)
        if k < 0:
            k = n
        if k > at and not unseen:
            parts.append(page[at:k])
            if links:
                linked += k - at
        if k == n:
            break
        m = _TAG.match(page, k)
        if m is None:
            if not unseen:
                parts.append("<")  # a bare sign
            at = k + 1
            continue
        at = m.end()
        tag = (m.group(2) or m.group(5) or "").lower()
        if not tag:
            continue
        closing = bool(m.group(1) or m.group(4))
        if closing:
            if tag == "br":
                parts.append(" ")
                continue
            for d in range(len(stack) - 1, -1, -1):
                if stack[d][0] == tag:
                    if tag not in _INLINE:
                        flush()
                    links -= sum(1 for x, _ in stack[d:] if x == "a")
                    del stack[d:]
                    while unseen and unseen[-1] >= d:
                        unseen.pop()
                    break
                if tag in _INLINE and stack[d][0] not in _INLINE:
                    break
            continue
        attributes = m.group(3) if m.group(3) is not None else m.group(6) or ""
        if tag in _RAW:
            end = at if tag in ("svg", "math") and page[at - 2 : at] == "/>" else _skip(page, at, tag)
            if tag not in _INLINE:
                flush()
            at = end
            continue
        if tag == "br" or tag == "hr":
            parts.append(" ")
        if tag in _VOID:
            continue
        if tag not in _INLINE:
            flush()
            close = {"p"} if tag in _CLOSES_P else _CLOSES.get(tag, ())
            for d in range(len(stack) - 1, -1, -1):
                if stack[d][0] in close:
                    links -= sum(1 for x, _ in stack[d:] if x == "a")
                    del stack[d:]
                    while unseen and unseen[-1] >= d:
                        unseen.pop()
                    break
                if stack[d][0] in _SCOPE:
                    break
        hidden = len(attributes) > 5 and _hidden(attributes)
        if hidden:
            unseen.append(len(stack))
        if hidden or len(stack) < 4 * DEEP:
            stack.append((tag, _tokens(tag, attributes) if len(attributes) < 2000 else ("t:" + tag,)))
            links += tag == "a"
    flush()
    return out


@cache
def _edges(tag: str) -> re.Pattern:
    return re.compile(rf"<(/?){re.escape(tag)}(?=[\s/>])[^>]*>", re.I)


def _skip(page: str, at: int, tag: str) -> int:
    """The end of an element that is never shown; nested ones of its name count, but in raw text."""
    depth = 1
    for m in _edges(tag).finditer(page, at):
        if m.group(1):
            depth -= 1
        elif tag not in ("script", "style", "textarea", "title") and not (tag in ("svg", "math") and m.group().endswith("/>")):
            depth += 1
        if not depth:
            return m.end()
    return at if tag == "head" else len(page)


# --- features --------------------------------------------------------------------------------


@cache
def _slot(token: str) -> int:
    return xxhash.xxh32_intdigest(token) % PATH


_TABLE = 1 << 16


def page_vectors(blocks: list[Block]) -> np.ndarray:
    """A row for each block: tag path, all its words hashed (shares, from 16 words on), counts."""
    n = len(blocks)
    out = np.zeros((n, PATH + WORDS + COUNTS), np.float32)
    for k, b in enumerate(blocks):
        out[k, [_slot(t) for t in b.path]] = 1
        if b.path:
            out[k, _slot("last:" + next(t for t in reversed(b.path) if t[0] == "t"))] = 1
        words = b.text.lower().split()
        slots = np.bincount([xxhash.xxh32_intdigest(w) % WORDS for w in words], minlength=WORDS)
        out[k, PATH : PATH + WORDS] = slots * (4 / max(len(words), 16))
        size = len(b.text)
        ends = b.text.count(". ") + b.text.count("? ") + b.text.count("! ") + (b.text[-1] in ".!?")
        out[k, PATH + WORDS :] = (
            min(len(words), 60) / 30, np.log1p(size) / 6, b.linked / size, min(ends, 5) / 2, b.text[-1] in ".!?…", len(words) < 4, (k + 1) / n, "©" in b.text or "(c)" in b.text.lower(), sum(map(str.isdigit, b.text)) / size, b.text[:1].isupper(),
        )
    np.minimum(out, 2, out=out)
    return out


# --- network ---------------------------------------------------------------------------------


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


def new_weights(seed: int) -> dict[str, np.ndarray]:
    rng = np.random.default_rng(seed)
    size = PATH + WORDS + COUNTS
    out = {"out": rng.normal(0, 0.1, (2 * HIDDEN + size, 1)), "bias": np.zeros(1)}
    for d in "fb":
        out |= {f"x{d}": rng.normal(0, 0.1, (size, 4 * HIDDEN)), f"h{d}": rng.normal(0, 0.2, (HIDDEN, 4 * HIDDEN)), f"b{d}": np.repeat([0.0, 1.0, 0.0, 0.0], HIDDEN)}
    return {k: v.astype(np.float32) for k, v in out.items()}


def _run(x: np.ndarray, mask: np.ndarray, w: dict, d: str, keep: list | None = None, state: list | None = None) -> np.ndarray:
    """Hidden states (time, batch, HIDDEN) in one direction; padded steps pass the state through.
    `state` holds h and c before the first step, and after the last one when done."""
    steps, batch = x.shape[:2]
    h, c = state or (np.zeros((batch, HIDDEN), np.float32), np.zeros((batch, HIDDEN), np.float32))
    out = np.zeros((steps, batch, HIDDEN), np.float32)
    z_all = (x.reshape(steps * batch, -1) @ w[f"x{d}"] + w[f"b{d}"]).reshape(steps, batch, -1)
    for t in range(steps) if d == "f" else range(steps - 1, -1, -1):
        z = z_all[t] + h @ w[f"h{d}"]
        s = _sigmoid(z[:, : 3 * HIDDEN])
        i, f, o, g = s[:, :HIDDEN], s[:, HIDDEN : 2 * HIDDEN], s[:, 2 * HIDDEN :], np.tanh(z[:, 3 * HIDDEN :])
        m = mask[t][:, None]
        c2 = f * c + i * g
        tc = np.tanh(c2)
        if keep is not None:
            keep.append((t, i, f, o, g, c, tc, h))
        h, c = np.where(m, o * tc, h), np.where(m, c2, c)
        out[t] = h
    if state is not None:
        state[:] = h, c
    return out


def probabilities(x: np.ndarray, mask: np.ndarray, w: dict) -> np.ndarray:
    both = np.concatenate([_run(x, mask, w, "f"), _run(x, mask, w, "b"), x], 2)
    return _sigmoid(both @ w["out"] + w["bias"])[..., 0]


def _gradients(x: np.ndarray, mask: np.ndarray, y: np.ndarray, w: dict) -> tuple[float, dict]:
    kept: dict[str, list] = {"f": [], "b": []}
    hs = {d: _run(x, mask, w, d, kept[d]) for d in "fb"}
    both = np.concatenate([hs["f"], hs["b"], x], 2)
    p = _sigmoid(both @ w["out"] + w["bias"])[..., 0]
    n = mask.sum()
    err = ((p - y) * mask / n).astype(np.float32)[..., None]
    loss = -float((mask * (y * np.log(p + 1e-9) + (1 - y) * np.log(1 - p + 1e-9))).sum() / n)
    g = {k: np.zeros_like(v) for k, v in w.items()}
    g["out"], g["bias"] = np.einsum("tbi,tbo->io", both, err), err.sum((0, 1))
    d_both = err @ w["out"].T
    for d, first in (("f", 0), ("b", HIDDEN)):
        dh, dc = np.zeros(x.shape[1:2] + (HIDDEN,), np.float32), np.zeros(x.shape[1:2] + (HIDDEN,), np.float32)
        dz_all = np.zeros(x.shape[:2] + (4 * HIDDEN,), np.float32)
        for t, i, f, o, gg, c, tc, h in reversed(kept[d]):
            m = mask[t][:, None]
            dh = dh + d_both[t][:, first : first + HIDDEN]
            live = np.where(m, dh, 0)
            dc2 = np.where(m, dc, 0) + live * o * (1 - tc * tc)
            dz = np.concatenate([dc2 * gg * i * (1 - i), dc2 * c * f * (1 - f), live * tc * o * (1 - o), dc2 * i * (1 - gg * gg)], 1)
            dz_all[t] = dz
            g[f"h{d}"] += h.T @ dz
            dh = np.where(m, dz @ w[f"h{d}"].T, dh)
            dc = np.where(m, dc2 * f, dc)
        flat = dz_all.reshape(-1, 4 * HIDDEN)
        g[f"x{d}"] = x.reshape(len(flat), -1).T @ flat
        g[f"b{d}"] = flat.sum(0)
    return loss, g


def _padded(pages: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    steps = max(map(len, pages))
    x = np.zeros((steps, len(pages), PATH + WORDS + COUNTS), np.float32)
    mask = np.zeros((steps, len(pages)), bool)
    for k, p in enumerate(pages):
        x[: len(p), k], mask[: len(p), k] = p, True
    return x, mask


def _long_page(x: np.ndarray, w: dict, longest: int) -> np.ndarray:
    """Probabilities of a page's blocks, `longest` at a time; each direction carries its state on, and leaves one term a block."""
    z = x @ w["out"][2 * HIDDEN :, 0] + w["bias"]
    starts = range(0, len(x), longest)
    for d, first in (("f", 0), ("b", HIDDEN)):
        state: list = []
        for a in starts if d == "f" else reversed(starts):
            part = x[a : a + longest, None]
            z[a : a + longest] += _run(part, np.ones(part.shape[:2], bool), w, d, state=state)[:, 0] @ w["out"][first : first + HIDDEN, 0]
    return _sigmoid(z)


def labels_of(pages: list[np.ndarray], w: dict, cells: int = 16_384, longest: int = 2048) -> list[np.ndarray]:
    """For each page, which blocks are main text.  Pages of similar length run together; one of more
    than `longest` blocks runs alone in parts, with the state carried from part to part."""
    out: list[np.ndarray] = [np.zeros(0, bool)] * len(pages)
    jobs = []
    for k, p in enumerate(pages):
        if len(p) > longest:
            out[k] = _long_page(p, w, longest) >= 0.5
        elif len(p):
            jobs.append((len(p), k))
    jobs.sort()
    while jobs:
        n = max(1, min(len(jobs), cells // jobs[-1][0]))
        part, jobs = jobs[-n:], jobs[:-n]
        p = probabilities(*_padded([pages[k] for _, k in part]), w)
        for c, (size, k) in enumerate(part):
            out[k] = p[:size, c] >= 0.5
    return out


# --- training pages --------------------------------------------------------------------------

_MENU = "nav menu navbar navigation topnav mainmenu breadcrumb breadcrumbs pagination pager tabs toolbar skip links toc".split()
_SIDE = "sidebar side rail widget related recommended popular trending archive tagcloud tags share social author bio promo teaser".split()
_NOTICE = "cookie consent notice banner alert gdpr popup modal overlay newsletter subscribe paywall announcement disclaimer".split()
_ADVERT = "ad ads advert advertisement sponsor sponsored adsense dfp promoted adbox banner".split()
_COMMENT = "comment comments commentlist discussion replies reply respond disqus responses feedback reviews".split()
_FOOT = "footer foot colophon copyright legal bottom siteinfo imprint".split()
_HEAD = "header masthead top logo site brand topbar branding hero".split()
_MAIN = "content main article post entry story body text articlebody single page hentry prose primary maincontent blog".split()


def sample_page(rng: random.Random) -> list[tuple[str, int]]:
    """A page as (html, role) pieces; role 1 is main text, 0 is not, -1 is markup alone."""
    syllables = [a + b for a in rng.sample("b c d f g h j k l m n p r s t v w z th sh ch st".split(), 12) for b in rng.sample("a e i o u é ä ñ".split(), 4)]
    common_words = ["".join(rng.choices(syllables, k=rng.choice((1, 1, 2)))) for _ in range(30)]
    word = lambda: rng.choice(common_words) if rng.random() < 0.5 else "".join(rng.choices(syllables, k=rng.choice((1, 2, 2, 3))))

    junk = rng.random() < 0.08

    def words(n: int) -> str:
        return " ".join(word() + (rng.choice(("%%%", "***", "&amp;&amp;", "$$$", "###")) if junk else "") for _ in range(n))

    def sentence(n: int) -> str:
        return words(n).capitalize() + rng.choice("....!?") if n else ""

    def text(lo: int, hi: int) -> str:
        left, out = rng.randint(lo, hi), []
        while left > 0:
            n = min(left, rng.randint(1, 18))
            out.append(sentence(n))
            left -= n
        return " ".join(out)

    def name(options: list[str]) -> str:
        x = rng.choice(options)
        x = rng.choice((x, x, x + "-" + rng.choice(("box", "area", "wrap", "list", "inner", "1")), rng.choice(("site", "page", "the", "c")) + "-" + x))
        return rng.choice((f' class="{x}"', f' id="{x}"', f" class='{x} {word()}'"))

    def link(n: int = 2) -> str:
        return f'<a href="/{word()}">{words(rng.randint(1, n))}</a>'

    out: list[tuple[str, int]] = []
    add = lambda s, role=-1: out.append((s, role))

    def links_list(k: int) -> None:
        kind = rng.random()
        if kind < 0.6:
            add("<ul>")
            for _ in range(k):
                add(f"<li>{link(3)}</li>", 0)
            add("</ul>")
        elif kind < 0.8:
            add(f"<p>{' | '.join(link() for _ in range(k))}</p>", 0)
        else:
            for _ in range(k):
                add(f"<div>{link(4)}</div>", 0)

    def menu() -> None:
        tag = rng.choice(("nav", "nav", "div", "header"))
        add(f"<{tag}{name(_MENU) if tag != 'nav' or rng.random() < 0.5 else ''}>")
        links_list(rng.randint(3, 9))
        add(f"</{tag}>")

    def header() -> None:
        tag = rng.choice(("header", "header", "div"))
        add(f"<{tag}{name(_HEAD) if tag == 'div' or rng.random() < 0.5 else ''}>")
        add(f"<{rng.choice(('h1', 'h2', 'div', 'p'))}>{words(rng.randint(1, 4))}", 0)
        if rng.random() < 0.5:
            add(f"<p>{text(3, 12)}</p>", 0)
        if rng.random() < 0.4:
            menu()
        add(f"</{tag}>")

    def footer() -> None:
        tag = rng.choice(("footer", "footer", "footer", "div"))
        add(f"<{tag}{name(_FOOT) if tag == 'div' or rng.random() < 0.4 else ''}>")
        if rng.random() < 0.3:
            links_list(rng.randint(2, 6))
        s = rng.choice(("&copy; ", "© 2024 ", "")) + rng.choice((f"{word()}.example.com &middot; ", "")) + text(2, 25)
        add(s if rng.random() < 0.6 else f"<p>{s}</p>", 0)
        if rng.random() < 0.3:
            add(f"<p>{text(5, 40)}</p>", 0)
        add(f"</{tag}>")

    def side() -> None:
        tag = rng.choice(("aside", "aside", "div", "section"))
        add(f"<{tag}{name(_SIDE) if tag != 'aside' or rng.random() < 0.5 else ''}>")
        if rng.random() < 0.7:
            add(f"<h{rng.randint(2, 4)}>{words(rng.randint(1, 3))}", 0)
        if rng.random() < 0.6:
            links_list(rng.randint(2, 7))
        if rng.random() < 0.5:
            add(f"<p>{text(5, 50)}</p>", 0)
        add(f"</{tag}>")

    def notice() -> None:
        tag = rng.choice(("div", "div", "section", "aside"))
        add(f"<{tag}{name(_NOTICE)}>")
        add(rng.choice((f"<p>{text(4, 40)}</p>", text(4, 30), f"<p>{text(5, 20)} {link()}</p>")), 0)
        if rng.random() < 0.4:
            add(f"<button>{words(2)}</button>", 0)
        add(f"</{tag}>")

    def advert() -> None:
        add("<!-- ad -->")
        tag = rng.choice(("div", "div", "aside", "section", "p"))
        add(f"<{tag}{name(_ADVERT)}>{text(1, 30)}</{tag}>", 0)

    def form() -> None:
        add(f"<form{name(['search', 'login', 'signup', 'contact', 'subscribe']) if rng.random() < 0.6 else ''}>")
        add(f"<label>{words(2)}</label> <input type='text'> <button>{words(1)}</button>", 0)
        if rng.random() < 0.4:
            add(f"<p>{text(3, 20)}</p>", 0)
        add("</form>")

    def comments() -> None:
        tag = rng.choice(("div", "section", "section", "ol"))
        add(f"<{tag}{name(_COMMENT)}>")
        add(f"<h3>{words(rng.randint(1, 3))}</h3>" if tag != "ol" else "", 0)
        inner = rng.choice(("div", "li", "article", "p"))
        for _ in range(rng.randint(1, 5)):
            add(f"<{inner}{name(_COMMENT) if rng.random() < 0.6 else ''}>")
            if inner != "p":
                if rng.random() < 0.6:
                    add(f"<{rng.choice(('b', 'span', 'cite'))}>{words(1)}</b></span></cite> ", 0)
                add(f"<p>{text(3, 60)}</p>", 0)
            else:
                add(text(3, 40), 0)
            add(f"</{inner}>")
        add(f"</{tag}>")

    inside = [advert, side, notice] if rng.random() < 0.35 else []

    def body() -> None:
        heading = words(rng.randint(2, 12)).capitalize()
        if rng.random() < 0.85:
            add(f"<h1>{heading}</h1>", 1)
        style = rng.random()
        for _ in range(rng.choice((1, 1, 2, 3, 5, 8, 12, 20, 30))):
            r = rng.random()
            t = text(1, rng.choice((3, 20, 60, 120, 300)))
            if r < 0.72 or style < 0.3:
                broken = rng.random() < 0.12
                add(f"<p><b>{t}<br>" if broken else f"<p>{t}</p>" if rng.random() < 0.9 else f"<p>{t} <a href='#'>{words(2)}</a> <em>{text(1, 20)}</em></p>", 1)
            elif r < 0.8:
                add(f"<h{rng.randint(2, 4)}>{words(rng.randint(1, 7))}</h2>", 1)
            elif r < 0.88:
                add("<ul>" if rng.random() < 0.6 else "<ol>")
                for _ in range(rng.randint(2, 5)):
                    add(f"<li>{text(1, 25)}</li>", 1)
                add("</ul></ol>")
            elif r < 0.93:
                add(f"<blockquote><p>{t}</p></blockquote>" if rng.random() < 0.5 else f"<blockquote>{t}</blockquote>", 1)
            elif r < 0.96:
                add(f"<table><tr><td>{words(2)}", 1)
                add(f"<td>{words(1)}</tr></table>", 1)
            else:
                add(f"<pre>{words(6)}</pre>" if rng.random() < 0.5 else f"<div>{t}</div>", 1)
            if inside and rng.random() < 0.12:
                rng.choice(inside)()

    add("<!DOCTYPE html><html><body>")
    wrap = rng.random() < 0.4
    if wrap:
        add(f"<div{name(['wrapper', 'container', 'page', 'layout', 'row', 'outer'])}>")
    for part, odds in ((header, 0.5), (menu, 0.8), (notice, 0.25), (form, 0.15), (advert, 0.45), (side, 0.2)):
        if rng.random() < odds:
            part()
    kind = rng.random()
    opening, closing = ("<article>", "</article>") if kind < 0.45 else ("<main>", "</main>") if kind < 0.55 else ("<main><article>", "</article></main>") if kind < 0.7 else (f"<div{name(_MAIN)}>", "</div>") if kind < 0.92 else (f"<article{name(_MAIN)}>", "</article>") if kind < 0.97 else ("", "")
    add(opening)
    body()
    if "article" in opening and rng.random() < 0.15:
        comments()
    add(closing)
    for part, odds in ((comments, 0.35), (side, 0.35), (advert, 0.25), (form, 0.15), (notice, 0.12), (menu, 0.12), (footer, 0.85)):
        if rng.random() < odds:
            part()
    if wrap:
        add("</div>")
    add("</body></html>")
    return out


def labelled_page(rng: random.Random) -> tuple[str, list[Block], np.ndarray]:
    """A sample page, its blocks, and which are main text; roles travel as a mark before each text."""
    pieces = sample_page(rng)
    marked = "".join(re.sub(r"(?<=>)(?=[^<\s])|^(?=[^<\s])", chr(0xE000 + role), s) if role >= 0 else s for s, role in pieces)
    blocks = leaf_blocks(marked)
    y = np.array([chr(0xE001) in b.text for b in blocks], bool)
    for b in blocks:
        b.text = " ".join(re.sub("[]", "", b.text).split()) or "x"
        b.linked = min(b.linked, len(b.text))
    return "".join(s for s, _ in pieces), blocks, y


@cache
def trained(pages: int = 900, passes: int = 8, batch: int = 32, seed: int = 7) -> dict[str, np.ndarray]:
    rng = random.Random(seed)
    data = []
    while len(data) < pages:
        _, blocks, y = labelled_page(rng)
        if blocks:
            data.append((page_vectors(blocks), y.astype(np.float32)))
    w = new_weights(seed)
    m1, m2 = ({k: np.zeros_like(v) for k, v in w.items()} for _ in range(2))
    step, every = 0, passes * -(-pages // batch)
    for _ in range(passes):
        rng.shuffle(data)
        order = sorted(range(pages), key=lambda k: len(data[k][0]) + rng.random() * 8)
        groups = [order[a : a + batch] for a in range(0, pages, batch)]
        rng.shuffle(groups)
        for group in groups:
            x, mask = _padded([data[k][0] for k in group])
            y = np.zeros(mask.shape, np.float32)
            for c, k in enumerate(group):
                y[: len(data[k][1]), c] = data[k][1]
            # names are dropped now and then, so that the network also learns to read the layout and the texts
            x[:, :, :PATH] *= np.random.default_rng(step).random((1, len(group), PATH)) > 0.08
            _, g = _gradients(x, mask, y, w)
            step += 1
            norm = np.sqrt(sum(float((v * v).sum()) for v in g.values()))
            rate = 0.012 * (1 - 0.9 * step / every)
            for k in w:
                d = g[k] * min(1.0, 2.0 / (norm + 1e-9))
                m1[k] = 0.9 * m1[k] + 0.1 * d
                m2[k] = 0.99 * m2[k] + 0.01 * d * d
                w[k] = (w[k] - rate * (m1[k] / (1 - 0.9**step)) / (np.sqrt(m2[k] / (1 - 0.99**step)) + 1e-6)).astype(np.float32)
    return w


def main_texts(pages: list[str], w: dict) -> list[str]:
    found = [leaf_blocks(p) for p in pages]
    keep = labels_of([page_vectors(b) if b else np.zeros((0, PATH + WORDS + COUNTS), np.float32) for b in found], w)
    return [" ".join(b.text for b, k in zip(blocks, kept) if k) for blocks, kept in zip(found, keep)]


def extract(pages: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars."""
    sent = pages.sparkSession.sparkContext.broadcast(trained())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        w = sent.value
        for b in common.slices(batches, "html", rows=400, size=2 << 20):
            found = main_texts(common.texts_of(b, "html"), w)
            yield pa.RecordBatch.from_arrays([b.column("page_id"), b.column("url"), pa.array(found, pa.string()), pa.array([len(t) for t in found], pa.int64())], ["page_id", "url", "text", "n_chars"])

    return common.in_arrow(pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), "html"), run, "page_id long, url string, text string, n_chars long")
