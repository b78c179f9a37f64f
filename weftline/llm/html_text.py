"""Main text of web pages: a bidirectional LSTM labels every block with the whole page in view.

A tolerant tokenizer turns a page into its blocks: runs of text between
block-level tags, each with the path of tags (and words of their class, id and
role) above it. A block's vector joins learned vectors of all its path's parts
and of all its words (both by hashing) with some measures of its whole text. A word
met c times among n counts sqrt(c / n); a name met c times among n different ones
(1 + ln c) / sqrt(n), where names that no training page has don't count. One LSTM reads a page's blocks forward, one backward; a logistic layer over
both and the block itself says whether it is main text.

The network is trained here, with numpy, on a bounded sample of pages: the
``SAMPLE_PAGES`` of the smallest hashes of page_id among those of up to ``SAMPLE_CHARS`` characters. Those that mark their article
in the tags label their own blocks; further pages are laid out anew from the same
texts by ``_templates``, with menus, headers, sidebars, notices, adverts, forms,
comments and footers in many notations. Seeds are fixed.

Blocks keep their whole text. Character references are decoded, white space
becomes one space, main blocks are joined by a line feed.

Defined cases: null and empty pages, and pages without main text, give an empty
text; elements more than ``DEEPEST`` deep are not nested, but their text stays; unclosed and crossed tags are closed as browsers do for paragraphs and list
items, and ignored otherwise; svg and math are part of the text around them, and
an open svg, math or object ends at the next block tag or with its parent; what
browsers read as one raw text (script and the like) is left out, to the end of
the page if it isn't closed; repeated rows each get a row; an empty table gives
an empty result; other columns are ignored.
"""

from __future__ import annotations

import html as _html
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import worker
from .common import materialise

SAMPLE_PAGES, SAMPLE_CHARS = 200, 100_000
EPOCHS = 14
HIDDEN = 16
PATH_BUCKETS, PATH_SIZE = 512, 16
WORD_BUCKETS, WORD_SIZE = 512, 8
MEASURES = 8

_ASIDE = re.compile(r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)", re.S)
_NAME = re.compile(r"<(/?)[a-zA-Z]")
_NAME_END = re.compile(r"[\s/>]")
_MARK = re.compile("[\"'>]")
#: Elements that are open at most; as in browsers, more of them stand side by side.
DEEPEST = 512
_ATTR = re.compile(r"""\b(class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)
_PART = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_RAW = frozenset("script style noscript template iframe textarea title".split())
_INLINE = frozenset(
    "a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split()
)
#: Elements that hold others' markup, and what browsers don't show of it (if it is closed).
_FOREIGN = frozenset("svg math".split())
_UNSHOWN = frozenset("title desc metadata annotation annotation-xml script style".split())
#: Tags in svg and math that are of the page, and so end them.
_ENDS_FOREIGN = frozenset(
    "address article aside blockquote body button caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header "
    "hgroup hr html legend li listing main menu nav ol optgroup option p pre search section select summary table tbody td tfoot th thead tr ul".split()
)
#: An opening tag closes an open one of these, up to the nearest tag that holds it.
_CLOSES = {
    "li": ("li", {"ul", "ol", "menu"}),
    "dt": ("dt dd", {"dl"}),
    "dd": ("dt dd", {"dl"}),
    "tr": ("tr td th", {"table"}),
    "td": ("td th", {"table", "tr"}),
    "th": ("td th", {"table", "tr"}),
    "option": ("option", {"select"}),
}
_P_ENDS = frozenset(
    "address article aside blockquote div dl fieldset footer form h1 h2 h3 h4 h5 h6 header hr main nav ol p pre section table ul".split()
)


class _Tags:
    """Ends of a page's tags, in time that grows with the page: what one search has passed in vain no other passes again."""

    def __init__(self, page: str):
        self.page, self.last, self.name_end = page, page.rfind(">"), -1
        self.failed: set[int] = set()
        self.missing: set[str] = set()

    def name(self, at: int) -> int:
        """Where a tag's name ends that has begun before ``at``; tags are asked for in order."""
        if at > self.name_end:
            m = _NAME_END.search(self.page, at)
            self.name_end = m.start() if m else len(self.page)
        return self.name_end

    def end(self, at: int) -> int:
        """Where the > stands that ends a tag from ``at`` on, quoted parts aside; -1 if there is none."""
        passed = []
        while at <= self.last:
            k = _MARK.search(self.page, at).start()
            if self.page[k] == ">":
                return k
            if k in self.failed:
                break
            passed.append(k)
            close = self.page.find(self.page[k], k + 1)
            if close < 0:
                break
            at = close + 1
        self.failed.update(passed)
        return -1

    def closed(self, tag: str, at: int) -> int:
        """What follows the end tag of an element that begins before ``at``; -1 if it has none."""
        if tag in self.missing:
            return -1
        m = re.compile(rf"</{re.escape(tag)}\s*>", re.I).search(self.page, at)
        if m is None:
            self.missing.add(tag)
            return -1
        return m.end()


class Block:
    __slots__ = ("path", "text", "linked")

    def __init__(self, path: tuple[str, ...], text: str, linked: int):
        self.path, self.text, self.linked = path, text, linked


def _names(tag: str, attrs: str) -> tuple[str, ...]:
    out = [tag]
    if attrs and "=" in attrs:
        for m in _ATTR.finditer(attrs):
            for p in _PART.findall(m[2] or m[3] or m[4] or ""):
                out.append("." + p.lower())
    return tuple(out)


def blocks(page: str) -> list[Block]:
    """The blocks of a page in order, each with the names on its path from the top."""
    out: list[Block] = []
    stack: list[tuple[str, tuple[str, ...]]] = []  # tags, and the names on the path to them
    text: list[str] = []
    path: tuple[str, ...] = ()
    linked = in_link = foreign = embedded = 0
    names: dict[tuple[str, str], tuple[str, ...]] = {}

    def flush():
        nonlocal linked
        if text:
            whole = " ".join(_html.unescape("".join(text)).split())
            if whole:
                out.append(Block(path, whole, min(linked, len(whole))))
            text.clear()
        linked = 0

    def close(k: int):
        nonlocal in_link, foreign, embedded
        for tag, _ in stack[k:]:
            opened[tag] -= 1
            if tag == "a":
                in_link -= 1
            elif tag in _FOREIGN:
                foreign -= 1
            if tag in _FOREIGN or tag == "object":
                embedded -= 1
        del stack[k:]

    def add(raw: str):
        nonlocal path, linked
        if raw:
            if not text:
                if raw.isspace():
                    return
                path = stack[-1][1] if stack else ()
            text.append(raw)
            if in_link:
                linked += len(raw.strip())

    at, n, tags = 0, len(page), _Tags(page)
    opened: Counter[str] = Counter()
    while at < n:
        lt = page.find("<", at)
        if lt < 0:
            add(page[at:])
            break
        m = _ASIDE.match(page, lt)
        if m:
            add(page[at:lt])
            at = m.end()
            if m[0].startswith("<![CDATA["):
                add(_html.escape(m[0][9:].removesuffix("]]>")))
            continue
        m = _NAME.match(page, lt)
        name = tags.name(m.end()) if m else lt
        end = tags.end(name) if m else -1
        if end < 0:  # a sign, not a tag
            add(page[at : lt + 1])
            at = lt + 1
            continue
        add(page[at:lt])
        at = end + 1
        tag, closing, attrs = page[m.end() - 1 : name].lower(), m[1], page[name:end]
        if foreign and tag in _UNSHOWN:  # where it isn't closed, its text stays
            end = -1 if closing or attrs.endswith("/") else tags.closed(tag, at)
            at = end if end >= 0 else at
            continue
        if tag in _RAW:
            if not closing and not attrs.endswith("/"):
                end = tags.closed(tag, at)
                at = end if end >= 0 else n
                add(" ")
            continue
        if embedded and not closing and tag in _ENDS_FOREIGN:
            close(next(k for k, (t, _) in enumerate(stack) if t in _FOREIGN or t == "object"))
        inline = tag in _INLINE or tag in _FOREIGN or tag == "object" or foreign and tag not in _ENDS_FOREIGN
        if not inline:
            flush()
        elif tag in ("br", "img", "wbr"):
            if tag == "br":
                add(" ")
            continue
        if closing:
            if opened[tag] > 0:
                close(max(k for k in range(len(stack)) if stack[k][0] == tag))
            continue
        if tag in _VOID:
            continue
        ends, holders = _CLOSES.get(tag, ("p", {"button", "td", "th", "li", "table"}) if tag in _P_ENDS else ("", ()))
        if any(opened[x] for x in ends.split()):
            for k in range(len(stack) - 1, -1, -1):
                if stack[k][0] in ends.split():
                    close(k)
                    break
                if stack[k][0] in holders:
                    break
        if (not attrs.endswith("/") or tag == "a") and len(stack) < DEEPEST:
            key = (tag, attrs)
            if key not in names:
                names[key] = _names(tag, attrs)
            stack.append((tag, (stack[-1][1] if stack else ()) + names[key]))
            opened[tag] += 1
            if tag == "a":
                in_link += 1
            foreign += tag in _FOREIGN
            embedded += tag in _FOREIGN or tag == "object"
    flush()
    return out


_hashes: dict[str, int] = {}
worker.keeps("html", _hashes.clear)


def _crc(s: str) -> int:
    h = _hashes.get(s)
    if h is None:
        if len(_hashes) > 500_000:
            _hashes.clear()
        h = _hashes[s] = zlib.crc32(s.encode("utf-8", "surrogatepass"))
    return h


_WORD = re.compile(r"\w+")


class Bags:
    """Buckets (or hashes) of each block, on end: how many, which, and their weights."""

    def __init__(self, sizes: np.ndarray, buckets: np.ndarray, weights: np.ndarray):
        self.sizes, self.buckets, self.weights = sizes, buckets, weights

    @staticmethod
    def of(bags: list[tuple[list[int], list[float]]]) -> Bags:
        sizes = np.fromiter((len(b) for b, _ in bags), np.int64, len(bags))
        return Bags(sizes, np.array([x for b, _ in bags for x in b], np.int64), np.array([x for _, w in bags for x in w], np.float32))

    @staticmethod
    def joined(bags: list[Bags]) -> Bags:
        return Bags(*(np.concatenate([getattr(b, k) for b in bags]) for k in ("sizes", "buckets", "weights")))

    def owners(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.sizes)), self.sizes)

    def sums(self, vectors: np.ndarray) -> np.ndarray:
        """The weighted sum of each block's vectors."""
        out, some = np.zeros((len(self.sizes), vectors.shape[1]), vectors.dtype), self.sizes > 0
        if some.any():
            first = (np.cumsum(self.sizes) - self.sizes)[some]
            out[some] = np.add.reduceat(vectors[self.buckets] * self.weights[:, None], first, axis=0)
        return out


def _path_bag(path) -> tuple[list[int], list[float]]:
    counts = Counter(path)
    return [_crc(x) for x in counts], [1 + math.log(c) for c in counts.values()]


def _word_bag(words) -> tuple[list[int], list[float]]:
    counts: dict[int, int] = {}
    for name, c in Counter(words).items():
        at = _crc(name) % WORD_BUCKETS
        counts[at] = counts.get(at, 0) + c
    total = sum(counts.values())
    return list(counts), [(c / total) ** 0.5 for c in counts.values()]


def features(page: list[Block]) -> tuple[Bags, Bags, np.ndarray]:
    """Hashes of whole paths, buckets of all words, and measures [block, measure]."""
    n = len(page)
    known: dict[tuple[str, ...], tuple[list[int], list[float]]] = {}
    paths, words = [], []
    measures = np.zeros((n, MEASURES), np.float32)
    for i, b in enumerate(page):
        if b.path not in known:
            known[b.path] = _path_bag(b.path)
        paths.append(known[b.path])
        t = b.text
        words.append(_word_bag(_WORD.findall(t.lower())))
        size = len(t)
        stops = t.count(".") + t.count(",") + t.count("!") + t.count("?")
        measures[i] = (
            math.log1p(size) / 4, min(1.0, size / 40), b.linked / size, min(1.0, 20 * stops / size),
            t[-1] in ".!?\"'”»:", i / n, 1.0 / n, 1.0,
        )
    return Bags.of(paths), Bags.of(words), measures


def _sigmoid(x):
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


class Labeller:
    """The network; ``train`` fits it, ``scores`` gives each block's probability of being main text."""

    def __init__(self, hidden: int = HIDDEN, seed: int = 7):
        r = np.random.default_rng(seed)
        d, h = PATH_SIZE + WORD_SIZE + MEASURES, hidden
        f = lambda *s: (r.standard_normal(s) / np.sqrt(s[0])).astype(np.float32)
        self.h = h
        #: Hashes of the names that training met, in order; None before it, when all count.
        self.known: np.ndarray | None = None
        self.w = {
            "path": f(PATH_BUCKETS, PATH_SIZE) * 4, "word": f(WORD_BUCKETS, WORD_SIZE) * 2,
            "wf": f(d, 4 * h), "uf": f(h, 4 * h), "bf": np.zeros(4 * h, np.float32),
            "wb": f(d, 4 * h), "ub": f(h, 4 * h), "bb": np.zeros(4 * h, np.float32),
            "out": f(2 * h + d, 1), "bo": np.zeros(1, np.float32),
        }
        for b in ("bf", "bb"):
            self.w[b][h : 2 * h] = 1  # of the gates that keep

    def _weighted(self, paths: Bags) -> Bags:
        """Paths' hashes as buckets, weighed among the names of each path that training met."""
        ok = np.ones(len(paths.buckets), bool) if self.known is None else np.isin(paths.buckets, self.known)
        n = np.bincount(paths.owners()[ok], minlength=len(paths.sizes))
        weights = paths.weights * ok / np.sqrt(np.maximum(n, 1))[paths.owners()]
        return Bags(paths.sizes, paths.buckets % PATH_BUCKETS, weights.astype(np.float32))

    def _inputs(self, paths, words, measures):
        w = self.w
        return np.concatenate((paths.sums(w["path"]), words.sums(w["word"]), measures), axis=1).astype(np.float32)

    def _pass(self, x, mask, d, keep=False):
        """x [t, page, in] to hidden states [t, page, h]; padded steps keep the state."""
        h, (wx, u) = self.h, (x @ self.w["w" + d] + self.w["b" + d], self.w["u" + d])
        out, state, cell, kept = np.zeros((*x.shape[:2], h), np.float32), *np.zeros((2, x.shape[1], h), np.float32), []
        for t in range(len(x)) if d == "f" else range(len(x) - 1, -1, -1):
            z = wx[t] + state @ u
            i, f, o, g = _sigmoid(z[:, :h]), _sigmoid(z[:, h : 2 * h]), _sigmoid(z[:, 2 * h : 3 * h]), np.tanh(z[:, 3 * h :])
            c = f * cell + i * g
            tc, m = np.tanh(c), mask[t][:, None]
            if keep:
                kept.append((t, state, cell, i, f, o, g, tc))
            state, cell = m * (o * tc) + (1 - m) * state, m * c + (1 - m) * cell
            out[t] = state
        return out, kept

    def _padded(self, pages):
        """Pages' inputs as [t, page, in], the mask, and the flat block of each place."""
        n = [len(p[2]) for p in pages]
        paths, words = (Bags.joined([p[k] for p in pages]) for k in (0, 1))
        paths, measures = self._weighted(paths), np.concatenate([p[2] for p in pages])
        x = self._inputs(paths, words, measures)
        page = np.repeat(np.arange(len(n)), n)
        t = np.arange(len(x)) - np.repeat(np.cumsum(n) - n, n)
        whole, mask = np.zeros((max(n), len(n), x.shape[1]), np.float32), np.zeros((max(n), len(n)), np.float32)
        whole[t, page], mask[t, page] = x, 1
        return whole, mask, t, page, paths, words

    def scores(self, pages) -> list[np.ndarray]:
        out = [np.zeros(0, np.float32)] * len(pages)
        size = [len(p[2]) for p in pages]
        order = sorted((i for i in range(len(pages)) if size[i]), key=lambda i: size[i])
        lo = 0
        while lo < len(order):
            hi = lo + 1  # pages of like length, some ten thousand places at once
            while hi < len(order) and (hi - lo + 1) * size[order[hi]] <= 20_000 and size[order[hi]] <= 1.3 * size[order[lo]] + 4:
                hi += 1
            own = order[lo:hi]
            x, mask, t, page, _, _ = self._padded([pages[i] for i in own])
            both = np.concatenate((self._pass(x, mask, "f")[0], self._pass(x, mask, "b")[0], x), axis=2)
            p = _sigmoid(both @ self.w["out"] + self.w["bo"])[:, :, 0]
            for k, i in enumerate(own):
                out[i] = p[: size[i], k]
            lo = hi
        return out

    def _gradients(self, pages, labels):
        h, w = self.h, self.w
        x, mask, t, page, paths, words = self._padded(pages)
        y = np.zeros(mask.shape, np.float32)
        y[t, page] = np.concatenate(labels)
        g = {k: np.zeros_like(v) for k, v in w.items()}
        (hf, kf), (hb, kb) = self._pass(x, mask, "f", True), self._pass(x, mask, "b", True)
        both = np.concatenate((hf, hb, x), axis=2)
        p = _sigmoid(both @ w["out"] + w["bo"])[:, :, 0]
        e = (p - y) * mask / mask.sum()
        g["out"], g["bo"] = np.einsum("tpi,tp->i", both, e)[:, None], np.array([e.sum()], np.float32)
        back = e[:, :, None] * w["out"][:, 0]
        dx = back[:, :, 2 * h :].copy()
        for d, kept, dh_all in (("f", kf, back[:, :, :h]), ("b", kb, back[:, :, h : 2 * h])):
            ds, dc = np.zeros((2, x.shape[1], h), np.float32)
            for step, state, cell, i, f, o, gg, tc in reversed(kept):
                m = mask[step][:, None]
                dh = ds + dh_all[step]
                dcell = dc * m + dh * m * o * (1 - tc * tc)
                dz = np.concatenate(
                    (dcell * gg * i * (1 - i), dcell * cell * f * (1 - f), dh * m * tc * o * (1 - o), dcell * i * (1 - gg * gg)), axis=1
                )
                g["w" + d] += x[step].T @ dz
                g["u" + d] += state.T @ dz
                g["b" + d] += dz.sum(0)
                dx[step] += dz @ w["w" + d].T
                ds = dz @ w["u" + d].T + dh * (1 - m)
                dc = dcell * f + dc * (1 - m)
        flat = dx[t, page]
        for name, bags, part in (("path", paths, flat[:, :PATH_SIZE]), ("word", words, flat[:, PATH_SIZE : PATH_SIZE + WORD_SIZE])):
            np.add.at(g[name], bags.buckets, part[bags.owners()] * bags.weights[:, None])
        return g

    def train(self, pages, labels, epochs: int = EPOCHS, rate: float = 0.01, seed: int = 11) -> None:
        r = np.random.default_rng(seed)
        some = [i for i in range(len(pages)) if len(pages[i][2])]
        self.known = np.unique(np.concatenate([np.zeros(0, np.int64), *[pages[i][0].buckets for i in some]]))
        m = {k: np.zeros_like(v) for k, v in self.w.items()}
        v = {k: np.zeros_like(x) for k, x in self.w.items()}
        step = 0
        for epoch in range(epochs):
            order = r.permutation(some)
            for lo in range(0, len(order), 16):
                own = order[lo : lo + 16]
                g = self._gradients([pages[i] for i in own], [labels[i] for i in own])
                norm = np.sqrt(sum(float((x * x).sum()) for x in g.values()))
                step += 1
                lr = rate * (1 - epoch / (epochs + 1))
                for k, x in g.items():
                    x = x * min(1.0, 1.0 / max(norm, 1e-9))
                    m[k] = 0.9 * m[k] + 0.1 * x
                    v[k] = 0.999 * v[k] + 0.001 * x * x
                    self.w[k] -= (lr * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.999**step)) + 1e-8)).astype(np.float32)


#: Names in class, id and role that mark other parts of a page.
_OTHER = frozenset(
    "ad ads advert adverts advertisement sponsor sponsored promo promotion banner cookie cookies consent notice alert popup modal subscribe newsletter "
    "nav navigation navbar menu breadcrumb breadcrumbs sidebar widget related share social footer header masthead comment comments respond reply login search form".split()
)


def own_labels(page: list[Block]) -> np.ndarray | None:
    """Labels of a page that marks its article or main part by tags; None for others."""
    y = np.zeros(len(page), np.float32)
    for i, b in enumerate(page):
        tops = [k for k, x in enumerate(b.path) if x in ("article", "main")]
        if not tops:
            continue
        inside = b.path[tops[0] + 1 :]
        if not any(x in ("nav", "aside", "footer", "form", "button", "select") or x[1:] in _OTHER for x in inside):
            y[i] = 1
    return y if y.any() else None


def _templates(r: random.Random, main: list[str], other: list[str]) -> list[tuple[str, int]]:
    """A page laid out anew: pieces of markup, each with the label of the text in it."""
    some = lambda: " ".join(r.choice(other).split()[: r.randint(1, 9)])
    long = lambda: r.choice(main + other)
    esc = _html.escape
    out: list[tuple[str, int]] = []
    add = lambda markup, label=0: out.append((markup, label))

    def links(k, item="li"):
        for _ in range(k):
            add(f'<{item}><a href="/{r.randint(1, 99)}">{esc(some())}</a></{item}>')

    # on every other page the parts are deep in elements that mean nothing
    deep = r.choice([0, r.randint(1, 16)])

    def nested(body):
        n = r.randint(0, deep)
        for _ in range(n):
            add("<div>")
        body()
        for _ in range(n):
            add("</div>")

    def wrapped(opening, tag, body):
        add(opening)
        nested(body)
        add(f"</{tag}>")

    def menu():
        kind = r.choice(['<nav>', '<nav class="main-nav">', '<div class="menu">', '<div id="navigation">', '<div class="navbar">', '<div role="navigation">', '<ul class="breadcrumb">'])
        wrapped(kind, kind[1:4].strip(" >") if kind.startswith("<ul") is False else "ul", lambda: (add("<ul>"), links(r.randint(2, 8)), add("</ul>")))

    def header():
        kind = r.choice(["<header>", '<div class="header">', '<div id="masthead">', '<header class="site-header">'])
        tag = "header" if kind.startswith("<header") else "div"
        wrapped(kind, tag, lambda: (add(f"<{(t := r.choice(['h1', 'div', 'p', 'span']))}>{esc(some())}</{t}>"), menu() if r.random() < 0.5 else None))

    def footer():
        kind = r.choice(["<footer>", '<div class="footer">', '<div id="footer">', '<footer class="site-footer">'])
        tag = "footer" if kind.startswith("<footer") else "div"
        wrapped(kind, tag, lambda: (add(f"<p>&copy; {esc(some())} &middot; {esc(long())}</p>"), links(r.randint(0, 4))))

    def sidebar():
        kind = r.choice(["<aside>", '<div class="sidebar">', '<div id="sidebar">', '<aside class="widget-area">', '<div class="related-posts">', '<div class="widget">'])
        tag = "aside" if kind.startswith("<aside") else "div"
        wrapped(kind, tag, lambda: (add(f"<h3>{esc(some())}</h3>"), links(r.randint(1, 6)), add(f"<p>{esc(long())}</p>") if r.random() < 0.5 else None))

    def advert():
        kind = r.choice(["ad", "ads", "advert", "advertisement", "sponsored", "promo", "banner", "ad-slot", "promotion"])
        add(f'<div class="{kind}">{r.choice(["", "<p>"])}{esc(r.choice([some(), long()]))}</div>')

    def notice():
        kind = r.choice(["cookie-notice", "cookie-banner", "notice", "alert", "consent", "popup", "newsletter", "subscribe", "share", "social-share"])
        add(f'<div {r.choice(["class", "id"])}="{kind}"><p>{esc(r.choice([some(), long()]))}</p><button>{esc(some())}</button></div>')

    def form():
        add(f'<form class="{r.choice(["search", "login", "signup", "contact"])}"><label>{esc(some())}</label><input name="q"><p>{esc(r.choice([some(), long()]))}</p><button>{esc(some())}</button></form>')

    def comments():
        kind = r.choice(['<section class="comments">', '<div id="comments">', '<ol class="comment-list">', '<div class="reader-comments">', '<section id="respond">', '<div class="replies comments">'])
        tag = kind[1:].split()[0]
        item = "li" if tag == "ol" else "div"

        def body():
            for _ in range(r.randint(1, 5)):
                add(f'<{item} class="comment"><{(t := r.choice(["b", "span", "h4"]))}>{esc(some())}</{t}><p>{esc(long())}</p></{item}>')

        wrapped(kind, tag, body)

    def article():
        kind = r.choice(
            ["<article>", "<main>", '<div class="content">', '<div id="content">', '<div class="post">', '<div class="entry-content">', '<section class="article-body">', '<div class="story">', '<div role="main">', '<article class="post">', '<main id="main"><article>', '<div class="text">', '<div id="main">']
        )
        tag = kind[1:].split()[0].strip(">").split(">")[0]

        def body():
            if r.random() < 0.8:
                add(f"<{(t := r.choice(['h1', 'h1', 'h2']))}>{esc(' '.join(r.choice(main).split()[:8]))}</{t}>", 1)
            for _ in range(r.randint(1, 9)):
                x = r.random()
                t = r.choice(main)
                if x < 0.75:
                    add(f"<p>{esc(t)}{r.choice(['</p>', '', '</p>'])}", 1)
                elif x < 0.82:
                    add(f"<ul><li>{esc(t)}</li></ul>", 1)
                elif x < 0.88:
                    add(f"<blockquote>{esc(t)}</blockquote>", 1)
                elif x < 0.93:
                    add(f"<h2>{esc(' '.join(t.split()[:6]))}</h2>", 1)
                elif x < 0.97:
                    add(f"<p>{esc(' '.join(t.split()[: r.randint(1, 4)]))}</p>", 1)
                else:
                    r.choice([advert, notice])()
            if r.random() < 0.15:
                comments()

        wrapped(kind, tag, body)
        if kind.count("<") == 2:
            add("</article>")

    before = [f for f in (header, menu, advert, notice, form, sidebar) if r.random() < 0.45]
    after = [f for f in (sidebar, comments, advert, form, notice, footer) if r.random() < 0.5]
    if r.random() < 0.6:
        r.shuffle(before)
    nested(lambda: [f() for f in (*before, article, *after)])
    return out


def training_set(pages: list[str], seed: int = 5) -> tuple[list, list]:
    """Inputs and labels: the pages that label themselves, and as many again laid out anew, twice."""
    r = random.Random(seed)
    inputs, labels, main, other = [], [], [], []
    for p in pages:
        own = blocks(p)
        y = own_labels(own)
        if y is None or not own:
            continue
        inputs.append(features(own))
        labels.append(y)
        for b, k in zip(own, y, strict=True):
            (main if k else other).append(b.text)
    # texts for pages laid out anew, if the sample has none
    main = main or ["The main text of a page has sentences, and they are long enough to read.", "It goes on for a while, as texts do."]
    other = other or ["Home", "About us", "Read more", "Subscribe to our letter"]
    for _ in range(max(40, 2 * len(inputs))):
        pieces = _templates(r, main, other)
        # the label goes with the text: each block is found again by a mark before its text
        marked = "".join(re.sub(r">(?=[^<>\s])", f">\x02{label}", m) for m, label in pieces)
        own, y, kept = blocks(f"<html><body>{marked}</body></html>"), [], []
        for b in own:
            found = re.findall("\x02([01])", b.text)
            text = re.sub("\x02[01]", "", b.text).strip()
            if found and text:
                y.append(float(found[0]))
                kept.append(Block(b.path, text, min(b.linked, len(text))))
        if kept:
            inputs.append(features(kept))
            labels.append(np.array(y, np.float32))
    return inputs, labels


def train(pages: DataFrame, id_col: str = "page_id", html_col: str = "html", sample: int = SAMPLE_PAGES) -> Labeller:
    h = F.xxhash64(F.col(id_col))
    some = pages.select(F.col(html_col).alias("html"), h.alias("h"), F.col(id_col).alias("id")).filter(F.length("html").between(1, SAMPLE_CHARS))
    # the hashes first: tasks send these, not pages
    first = some.select("h").orderBy("h").limit(sample).collect()
    last = max((r["h"] for r in first), default=0)
    rows = some.filter(F.col("h") <= last).orderBy("h", "id", "html").limit(sample).collect()
    net = Labeller()
    net.train(*training_set([r["html"] for r in rows]))
    return net


def main_texts(htmls: list[str], net: Labeller) -> list[str]:
    pages = [blocks(h) for h in htmls]
    found = net.scores([features(p) for p in pages])
    return ["\n".join(b.text for b, s in zip(p, y, strict=True) if s >= 0.5) for p, y in zip(pages, found, strict=True)]


def extract(pages: DataFrame, net: Labeller, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """Per row of pages: page_id, url and the main text."""
    shared = pages.sparkSession.sparkContext.broadcast(net)
    d = pages.select(F.col(id_col).alias("page_id"), F.col(url_col).alias("url"), F.col(html_col).alias("html"))

    def run(batches):
        worker.owned_by("html")
        for b in batches:
            for lo in range(0, b.num_rows, 500):
                own = b.slice(lo, 500)
                texts = main_texts([x.as_py() or "" for x in own.column(2)], shared.value)
                yield pa.RecordBatch.from_arrays([own.column(0), own.column(1), pa.array(texts, pa.string())], names=["page_id", "url", "text"])

    kinds = dict(d.dtypes)
    return d.mapInArrow(run, f"page_id {kinds['page_id']}, url {kinds['url']}, text string")


def op9_query(pages: DataFrame) -> DataFrame:
    found = materialise(extract(pages, train(pages)), "main-text")
    return found.select("page_id", "url", "text", F.char_length("text").cast("long").alias("n_chars"))
