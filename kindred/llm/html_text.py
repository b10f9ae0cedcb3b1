"""Main text of web pages by a recurrent block labeller.

A page becomes the sequence of its leaf blocks. Each block is described by its tag path (names, classes, ids of
all its open elements, hashed; inline ones count if all of the block is inside), its hashed words, and a few
numbers; a bidirectional LSTM in numpy reads the
whole sequence both ways and labels every block as main text or not. It is trained on pages that a generator
lays out with known labels, so it needs no labelled corpus. Labels are computed on a grid of numbers whose sums
are exact, so they depend on the page alone and not on those that are labelled with it.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from functools import lru_cache
from html import unescape

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kindred.llm.common import pick, table
from kindred.llm.jaccard_join import BASE, SPACE, by_size, mix
from kindred.llm.toxicity import Adam, sigmoid, to_grid

PATHS, PATH_WIDTH, WORDS, WORD_WIDTH, NUMBERS, HIDDEN = 1 << 12, 12, 1 << 12, 6, 5, 12
WIDTH = PATH_WIDTH + WORD_WIDTH + NUMBERS
SCHEMA = "page_id long, url string, text string, n_chars long"
PAGES = 256  # pages that go through the parser and the network together, at most, and bytes of them
BYTES = 4 << 20
CELLS = 1 << 15  # blocks, those that pad pages to one length included, that go through the network together; a longer page goes alone
STEPS = 1 << 12  # blocks of a page whose gates are held at a time

INLINE = frozenset("a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd label mark q s samp small span strike strong sub sup time tt u var wbr".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: An opening tag of the second kind ends an open element of the first.
CLOSES = {"p": frozenset("address article aside blockquote details div dl fieldset figure footer form h1 h2 h3 h4 h5 h6 header hr main nav ol p pre section table ul".split()), "li": frozenset(["li"]), "dt": frozenset(["dt", "dd"]), "dd": frozenset(["dt", "dd"]), "td": frozenset(["td", "th", "tr"]), "th": frozenset(["td", "th", "tr"]), "tr": frozenset(["tr"]), "option": frozenset(["option", "optgroup"])}
TOKEN = re.compile(r"""<!--.*?(?:-->|\Z)|<(script|style|noscript|template|iframe)\b(?:[^>"']|"[^"]*"|'[^']*')*>.*?(?:</\1\s*>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>"']|"[^"]*"|'[^']*')*)>|<[!?/][^>]*>|([^<]+|<)""", re.S | re.I)
ATTRIBUTE = re.compile(r"""\b(class|id|role|hidden|aria-hidden)\b(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""", re.I)
PIECES = re.compile(r"[a-z]+")


@lru_cache(maxsize=1 << 14)
def element(tag: str, attributes: str) -> tuple[str, tuple[str, ...]]:
    """An element's name and the features it gives to the paths through it."""
    found = [tag]
    for m in ATTRIBUTE.finditer(attributes):
        name, value = m[1].lower(), (m[2] or m[3] or m[4] or "").lower()
        found += [f"{name}:{w}" for w in PIECES.findall(value)] or [name]
    return tag, tuple(found)


@lru_cache(maxsize=1 << 14)
def path_features(stack: tuple, leaf: str) -> np.ndarray:
    """The distinct hashed features of a path: what its elements are, and which is the innermost."""
    outer = [e for e in stack if e[0] not in INLINE]
    names = {w for tag, found in stack for w in (found[1:] if tag in INLINE else found)} | {f"leaf {leaf}"} | {f"in {w} > {leaf}" for w in (outer[-2][1] if len(outer) > 1 else ())}
    return np.array(sorted({zlib.crc32(n.encode()) % PATHS for n in names}), np.int64)


def blocks(html: str) -> list[tuple[str, tuple, str, float]]:
    """(text, open elements, innermost block element, share of linked characters) of each non-empty leaf block."""
    out, text, stack, linked, links, around = [], [], [], 0, 0, None

    def close() -> None:
        nonlocal linked, around
        if text:
            words = " ".join("".join(text).split())
            if words:
                path = tuple(e for e in stack if e[0] not in INLINE)
                out.append((words, path + (around or ()), path[-1][0] if path else "", min(1.0, linked / len(words))))
            text.clear()
        linked, around = 0, None

    def leave(tag: str) -> None:
        nonlocal links
        for k in range(len(stack) - 1, -1, -1):
            if stack[k][0] == tag:
                links -= sum(e[0] == "a" for e in stack[k:])
                del stack[k:]
                return

    for m in TOKEN.finditer(html):
        plain = m[5]
        if plain is not None:
            t = unescape(plain) if "&" in plain else plain
            text.append(t)
            if t.strip():
                # inline elements with attributes that all of the block's text is in
                here = tuple(e for e in stack if e[0] in INLINE and len(e[1]) > 1)
                around = here if around is None else tuple(e for e in around if e in here)
                if links:
                    linked += len(t.strip())
            continue
        tag = m[3]
        if tag is None:
            continue
        tag = tag.lower()
        if tag in INLINE:
            if tag == "br":
                text.append(" ")
            elif tag not in VOID:
                if m[2]:
                    leave(tag)
                else:
                    stack.append(element(tag, m[4] or ""))
                    links += tag == "a"
            continue
        close()
        if m[2]:
            leave(tag)
            continue
        if tag in VOID:
            continue
        for open_, by in CLOSES.items():
            if tag in by:
                for k in range(len(stack) - 1, -1, -1):
                    if stack[k][0] == open_:
                        links -= sum(e[0] == "a" for e in stack[k:])
                        del stack[k:]
                        break
                    if stack[k][0] not in INLINE and stack[k][0] != "p":
                        break
        stack.append(element(tag, m[4] or ""))
    close()
    return out


class Pages:
    """The blocks of some pages as arrays: path features and word buckets block by block, numbers, and pages' lengths."""

    def __init__(self, pages: list[list[tuple]]):
        flat = [b for p in pages for b in p]
        self.length = np.array([len(p) for p in pages], np.int64)
        paths = [path_features(b[1], b[2]) for b in flat]
        self.path_count = np.array([len(p) for p in paths], np.int64)
        self.path = np.concatenate(paths) if paths else np.zeros(0, np.int64)
        raw = [b[0].lower().encode("utf-8", "replace") for b in flat]
        self.word, self.word_count = self.hashed(raw)
        size = np.array([len(b[0]) for b in flat], np.float32)
        link = np.array([b[3] for b in flat], np.float32)
        stops = np.array([sum(b[0].count(c) for c in ".!?") for b in flat], np.float32)
        where = np.concatenate([np.linspace(0, 1, n) for n in self.length]) if flat else np.zeros(0)
        self.number = np.stack([np.log1p(size) / 6, link, np.log1p(stops), where.astype(np.float32), np.ones(len(flat), np.float32)], 1) if flat else np.zeros((0, NUMBERS), np.float32)

    @staticmethod
    def hashed(raw: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """A bucket for each word of each text, and how many words each has."""
        buf = np.frombuffer(b" " + b" ".join(raw) + b" ", np.uint8)
        ends = np.cumsum([len(r) + 1 for r in raw])
        word = ~SPACE[buf]
        edge = np.flatnonzero(word[1:] != word[:-1]) + 1
        start, end = edge[0::2], edge[1::2]
        with np.errstate(over="ignore"):
            power = np.full(len(buf) + 1, BASE, np.uint64)
            power[0] = 1
            power = np.cumprod(power, dtype=np.uint64)
            prefix = np.zeros(len(buf) + 1, np.uint64)
            np.cumsum((buf.astype(np.uint64) + np.uint64(1)) * power[:-1], out=prefix[1:])
            inverse = np.full(len(buf) + 1, pow(int(BASE), -1, 1 << 64), np.uint64)
            inverse[0] = 1
            inverse = np.cumprod(inverse, dtype=np.uint64)
            hashes = mix((prefix[end] - prefix[start]) * inverse[start])
        return (hashes % np.uint64(WORDS)).astype(np.int64), np.bincount(np.searchsorted(ends, start, side="right"), minlength=len(raw))


def summed(rows: np.ndarray, count: np.ndarray, kind: type = np.float32) -> np.ndarray:
    out = np.zeros((len(count), rows.shape[1]), kind)
    some = count > 0
    if some.any():
        out[some] = np.add.reduceat(rows, (np.cumsum(count) - count)[some], 0, dtype=kind)
    return out


class Labeller:
    """Two LSTMs over block vectors and a logistic label for each block."""

    def __init__(self, seed: int = 2):
        r = np.random.default_rng(seed)
        mat = lambda scale, *s: (scale * r.standard_normal(s)).astype(np.float32)
        self.p = {"path": mat(0.2, PATHS, PATH_WIDTH), "word": mat(0.1, WORDS, WORD_WIDTH), "out": mat(0.3, 2 * HIDDEN), "bias": np.zeros(1, np.float32)}
        for d in "fb":
            self.p |= {f"w{d}": mat(WIDTH**-0.5, WIDTH, 4 * HIDDEN), f"u{d}": mat(HIDDEN**-0.5, HIDDEN, 4 * HIDDEN)}

    def inputs(self, x: Pages) -> np.ndarray:
        word = summed(self.p["word"][x.word], x.word_count) / np.maximum(1, x.word_count)[:, None].astype(np.float32)
        return np.concatenate([summed(self.p["path"][x.path], x.path_count), word, x.number], 1)

    @staticmethod
    def places(length: np.ndarray) -> np.ndarray:
        """Block numbers by page and position, -1 where a page has no more."""
        at = np.arange(length.max(initial=0))
        return np.where(at < length[:, None], (np.cumsum(length) - length)[:, None] + at, -1)

    def run(self, d: str, gates: np.ndarray, place: np.ndarray, keep: list | None = None) -> np.ndarray:
        u, n = self.p[f"u{d}"], len(place)
        h, c = np.zeros((n, HIDDEN), np.float32), np.zeros((n, HIDDEN), np.float32)
        out = np.zeros((*place.shape, HIDDEN), np.float32)
        for t in range(place.shape[1]) if d == "f" else reversed(range(place.shape[1])):
            on = (place[:, t] >= 0).astype(np.float32)[:, None]
            a = gates[place[:, t]] + h @ u
            ifo, g = sigmoid(a[:, : 3 * HIDDEN]), np.tanh(a[:, 3 * HIDDEN :])
            i, f, o = ifo[:, :HIDDEN], ifo[:, HIDDEN : 2 * HIDDEN], ifo[:, 2 * HIDDEN :]
            new = (f * c + i * g) * on
            tc = np.tanh(new)
            if keep is not None:
                keep.append((t, h, c, ifo, g, tc, on))
            h, c = o * tc * on, new
            out[:, t] = h
        return out

    def forward(self, x: Pages, keep: dict | None = None) -> np.ndarray:
        """The chance of being main text, block by block."""
        v, place = self.inputs(x), self.places(x.length)
        states = []
        for d in "fb":
            states.append(self.run(d, v @ self.p[f"w{d}"], place, None if keep is None else keep.setdefault(d, [])))
        h = np.concatenate(states, 2)[place >= 0]
        if keep is not None:
            keep |= {"v": v, "place": place, "h": h}
        return sigmoid(h @ self.p["out"] + self.p["bias"])

    def gradients(self, x: Pages, y: np.ndarray) -> dict:
        keep: dict = {}
        p = self.forward(x, keep)
        dlogit = ((p - y) / len(y)).astype(np.float32)
        g = {"out": keep["h"].T @ dlogit, "bias": dlogit.sum(keepdims=True)}
        place, v = keep["place"], keep["v"]
        dh_all = np.zeros((*place.shape, 2 * HIDDEN), np.float32)
        dh_all[place >= 0] = dlogit[:, None] * self.p["out"]
        dv = np.zeros_like(v)
        for k, d in enumerate("fb"):
            u, gu = self.p[f"u{d}"], np.zeros_like(self.p[f"u{d}"])
            da_all = np.zeros((len(v), 4 * HIDDEN), np.float32)
            dh, dc = np.zeros((len(place), HIDDEN), np.float32), np.zeros((len(place), HIDDEN), np.float32)
            for t, h, c, ifo, gg, tc, on in reversed(keep[d]):
                i, f, o = ifo[:, :HIDDEN], ifo[:, HIDDEN : 2 * HIDDEN], ifo[:, 2 * HIDDEN :]
                dn = (dh + dh_all[:, t, k * HIDDEN : (k + 1) * HIDDEN]) * on
                dcell = (dc + dn * o * (1 - tc * tc)) * on
                da = np.concatenate([dcell * gg * i * (1 - i), dcell * c * f * (1 - f), dn * tc * o * (1 - o), dcell * i * (1 - gg * gg)], 1)
                gu += h.T @ da
                here = place[:, t] >= 0
                da_all[place[here, t]] = da[here]
                dh, dc = da @ u.T, dcell * f
            g |= {f"u{d}": gu, f"w{d}": v.T @ da_all}
            dv += da_all @ self.p[f"w{d}"].T
        g["path"] = (x.path, np.repeat(dv[:, :PATH_WIDTH], x.path_count, 0))
        per_word = dv[:, PATH_WIDTH : PATH_WIDTH + WORD_WIDTH] / np.maximum(1, x.word_count)[:, None]
        g["word"] = (x.word, np.repeat(per_word, x.word_count, 0))
        return g

    def on_grid(self) -> "Labeller":
        """A copy for labelling, with all weights on the grid; the tables stay single, which holds their grid."""
        net = object.__new__(Labeller)
        net.p = {k: to_grid(x).astype(np.float32 if k in ("path", "word") else np.float64) for k, x in self.p.items()}
        return net

    def exactly(self, x: Pages) -> np.ndarray:
        """Whether each block is main text: ``forward`` in double precision and on the grid, with the gates of some blocks at a time."""
        word = summed(self.p["word"][x.word], x.word_count, np.float64) / np.maximum(1, x.word_count)[:, None]
        v = to_grid(np.concatenate([summed(self.p["path"][x.path], x.path_count, np.float64), word, x.number.astype(np.float64)], 1))
        place = self.places(x.length)
        logit = np.full(len(v), self.p["bias"][0])
        for k, d in enumerate("fb"):
            w, u, out = self.p[f"w{d}"], self.p[f"u{d}"], self.p["out"][k * HIDDEN : (k + 1) * HIDDEN]
            h, c = np.zeros((len(place), HIDDEN)), np.zeros((len(place), HIDDEN))
            parts = range(0, place.shape[1], STEPS)
            for low in parts if d == "f" else reversed(parts):
                here = place[:, low : low + STEPS]
                gates = v[here] @ w
                steps = range(here.shape[1])
                for t in steps if d == "f" else reversed(steps):
                    on = here[:, t] >= 0
                    a = gates[:, t] + h @ u
                    ifo, g = sigmoid(a[:, : 3 * HIDDEN]), np.tanh(a[:, 3 * HIDDEN :])
                    c = to_grid(ifo[:, HIDDEN : 2 * HIDDEN] * c + ifo[:, :HIDDEN] * g) * on[:, None]
                    h = to_grid(ifo[:, 2 * HIDDEN :] * np.tanh(c)) * on[:, None]
                    logit[here[on, t]] += h[on] @ out
        return logit >= 0

    def label(self, pages: list[list[tuple]]) -> list[np.ndarray]:
        """Pages of like length go together, so that one long page doesn't pad the others."""
        net = self.on_grid()
        out: list = [np.zeros(0, bool)] * len(pages)
        order = sorted((k for k in range(len(pages)) if pages[k]), key=lambda k: len(pages[k]))
        low = 0
        while low < len(order):
            high = low + 1
            while high < len(order) and high - low < 64 and (high + 1 - low) * len(pages[order[high]]) <= CELLS:
                high += 1
            some, low = order[low:high], high
            x = Pages([pages[k] for k in some])
            for k, y in zip(some, np.split(net.exactly(x), np.cumsum(x.length)[:-1])):
                out[k] = y
        return out


MAIN = "[[main]]"


class Layouts:
    """Pages with known main text, laid out in many ways. Main blocks carry a mark that training takes off again."""

    def __init__(self, seed: int = 3):
        self.r = np.random.default_rng(seed)
        syllables = "an ba ce do er fi go ha in ju ka le mo nu or pa qui re so ti un ve wa xi yo zu sch ment tion".split()
        self.words = ["".join(self.r.choice(syllables, self.r.integers(1, 5))) for _ in range(600)]
        self.chrome = "home about contact login search menu share tweet privacy terms cookies copyright rights reserved newsletter subscribe reply comments comment sponsored advertisement related next previous tags accept settings sign up".split()

    def some(self, *choices: str) -> str:
        return choices[self.r.integers(len(choices))]

    def chance(self, p: float) -> bool:
        return self.r.random() < p

    def prose(self, low: int, high: int) -> str:
        n = int(self.r.integers(low, high + 1))
        w = [self.words[k] for k in (600 * self.r.random(n) ** 2).astype(int)]
        for k in range(0, n, int(self.r.integers(5, 15))):
            w[k - 1] += self.some(".", ".", ",", "!", ".")
            w[k] = w[k].capitalize()
        return " ".join(w) + self.some(".", ".", "")

    def label(self) -> str:
        return " ".join(self.some(*self.chrome) if self.chance(0.4) else self.some(*self.words) for _ in range(int(self.r.integers(1, 5))))

    def links(self) -> str:
        tag = self.some("ul", "ul", "div", "ol")
        item = "li" if tag != "div" else self.some("span", "div", "p")
        return f"<{tag}>" + "".join(f'<{item}><a href="/{k}">{self.label()}</a></{item}>' for k in range(int(self.r.integers(2, 9)))) + f"</{tag}>"

    def aside(self) -> str:
        """Something that isn't main text."""
        kind = int(self.r.integers(12))
        if kind == 0:
            return f"<nav>{self.links()}</nav>"
        if kind == 1:
            name = self.some("menu", "navbar", "nav", "breadcrumb", "topbar", "navigation", "pagination", "tags", "share", "social")
            return f'<div {self.some("class", "id")}="{name}">{self.links()}</div>'
        if kind == 2:
            return f"<header>{self.some('<h1>' + self.label() + '</h1>', '<p>' + self.label() + '</p>', '<div>' + self.label() + '</div>')}{self.links() if self.chance(0.5) else ''}</header>"
        if kind == 3:
            return f"<footer>{self.some('&copy; ', '', 'Copyright ')}{self.label()} {self.some('&middot; ', '| ', '')}{self.prose(1, 25)}{self.links() if self.chance(0.3) else ''}</footer>"
        if kind in (4, 5):
            name = self.some("ad", "ad", "ads", "advert", "advertisement", "banner", "sponsored", "promo", "ad-slot", "adbox")
            tag = self.some("div", "div", "section", "p", "aside")
            return f'<{tag} {self.some("class", "class", "id")}="{name}">{self.prose(2, 40)}</{tag}>'
        if kind == 6:
            inner = f"<h3>{self.label()}</h3>" * self.chance(0.5) + self.some(self.links(), f"<p>{self.prose(5, 50)}</p>", self.prose(5, 40))
            return self.some(f"<aside>{inner}</aside>", f'<div class="sidebar">{inner}</div>', f'<div id="sidebar">{inner}</div>', f'<aside class="related">{inner}</aside>', f'<div class="widget">{inner}</div>', f'<div class="related">{inner}</div>')
        if kind == 7:
            name = self.some("cookie", "cookie-notice", "notice", "consent", "gdpr", "alert", "banner", "cookie-banner", "popup", "modal", "message")
            return f'<div {self.some("class", "id")}="{name}">{self.some("<p>", "")}{self.prose(4, 40)}{self.some("<button>" + self.label() + "</button>", "")}</div>'
        if kind == 8:
            return f'<form action="/x"><label>{self.label()}</label><input name="q"><select><option>{self.label()}<option>{self.label()}</select><button>{self.label()}</button>{self.some("<p>" + self.prose(3, 20) + "</p>", "")}</form>'
        if kind == 9:
            return f'<div class="{self.some("newsletter", "subscribe", "signup", "author-bio", "meta", "byline")}"><p>{self.prose(3, 30)}</p></div>'
        tag, name = self.some("section", "div", "div", "ol", "ul"), self.some("comments", "comment-list", "comments", "responses", "discussion", "replies")
        item = "li" if tag in ("ol", "ul") else self.some("div", "article", "p")
        each = lambda: f'<{item} class="{self.some("comment", "reply", "comment-body", "response")}">{self.some("<b>" + self.label() + "</b> ", "<cite>" + self.label() + "</cite>", "")}{self.some(self.prose(3, 60), "<p>" + self.prose(3, 60) + "</p>") if item != "p" else self.prose(3, 60)}</{item}>'
        return f'<{tag} {self.some("class", "id")}="{name}">' + f"<h3>{self.label()}</h3>" * self.chance(0.5) * (item != "li") + "".join(each() for _ in range(int(self.r.integers(1, 6)))) + f"</{tag}>"

    def main(self) -> str:
        kind = self.r.random()
        if kind < 0.1:
            return f"<p><b>{MAIN}{self.prose(1, 30)}<br><p>{MAIN}{self.prose(1, 60)}</p>"
        if kind < 0.66:
            return f"<p>{MAIN}{self.prose(1, 120)}{self.some('</p>', '</p>', '</p>', '')}"
        if kind < 0.76:
            tag = self.some("h2", "h3", "h2", "h4")
            return f"<{tag}>{MAIN}{self.prose(1, 9)}</{tag}>"
        if kind < 0.82:
            tag = self.some("ul", "ol")
            return f"<{tag}>" + "".join(f"<li>{MAIN}{self.prose(1, 20)}{self.some('</li>', '')}" for _ in range(int(self.r.integers(2, 6)))) + f"</{tag}>"
        if kind < 0.86:
            return f"<blockquote>{self.some('<p>', '')}{MAIN}{self.prose(4, 50)}</blockquote>"
        if kind < 0.9:
            return f'<figure><img src="x.png"><figcaption>{MAIN}{self.prose(2, 15)}</figcaption></figure>'
        if kind < 0.93:
            return "<table>" + "".join("<tr>" + "".join(f"<td>{MAIN}{self.prose(1, 3)}" for _ in range(2)) for _ in range(int(self.r.integers(1, 4)))) + "</table>"
        if kind < 0.96:
            return f"<div>{MAIN}{self.prose(3, 80)}</div>"
        return f'<p>{MAIN}{self.prose(3, 40)} <a href="/y">{self.prose(1, 5)}</a> {self.prose(3, 40)}</p>'

    def page(self) -> str:
        tag, name = [("article", ""), ("article", ""), ("article", ""), ("main", ""), ("div", ' class="content"'), ("div", ' id="content"'), ("div", ' class="post-body"'), ("div", ' class="article"'), ("section", ' class="entry-content"'), ("div", ' id="main"'), ("article", ' class="post"'), ("div", ' class="story"')][self.r.integers(12)]
        body = f"<h1>{MAIN}{self.prose(1, 14)}</h1>" * self.chance(0.85)
        for _ in range(0 if self.chance(0.03) else int(self.r.integers(1, 14))):
            body += self.main()
            if self.chance(0.06):
                body += self.aside()
        title = f"<title>{self.prose(1, 14)}</title>"
        before = "".join(self.aside() for _ in range(int(self.r.integers(0, 5))))
        after = "".join(self.aside() for _ in range(int(self.r.integers(0, 5))))
        wrap = self.some("", "", "", '<div class="page">', '<div id="wrapper">', '<div class="container">')
        return f"<!DOCTYPE html><html><head>{title}</head><body>{wrap}{before}<{tag}{name}>{body}</{tag}>{after}{'</div>' if wrap else ''}</body></html>"


@lru_cache(maxsize=2)
def train(pages: int = 2400, epochs: int = 4, batch: int = 48, seed: int = 2) -> Labeller:
    """Learns from ``pages`` generated pages; the same weights each time."""
    make, net, r = Layouts(seed), Labeller(seed), np.random.default_rng(seed)
    seen = []
    for _ in range(pages):
        got = blocks(make.page())
        if got:
            seen.append(([(" ".join(t.replace(MAIN, "").split()) or "x", *rest) for t, *rest in got], [MAIN in t for t, *_ in got]))
    opt = Adam(net.p, 0.01)
    for epoch in range(epochs):
        opt.rate = 0.01 if epoch < epochs - 1 else 0.003
        # like lengths together, in random order
        order = sorted(r.permutation(len(seen)), key=lambda k: len(seen[k][0]))
        for low in r.permutation(range(0, len(order), batch)):
            some = [seen[k] for k in order[low : low + batch]]
            opt.step(net.gradients(Pages([s[0] for s in some]), np.array([y for s in some for y in s[1]], np.float32)))
    return net


def main_text(pages: DataFrame) -> DataFrame:
    """``page_id, url, text, n_chars`` for each input row, in a narrow pass.

    Blocks that are main text, white space inside each (as Unicode and so Python's ``split`` have it, U+00A0
    included) as one space, joined by line ends in page order. A null or
    empty html, or one without main text, gives an empty text. Repeated rows and nulls in other columns are kept
    as they are. An empty table gives an empty result. Extra columns are ignored.
    """
    params = pages.sparkSession.sparkContext.broadcast(train().p)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        net = object.__new__(Labeller)
        net.p = params.value
        for whole in batches:
            for b in (part.slice(low, PAGES) for part in by_size(whole, "html", BYTES) for low in range(0, part.num_rows, PAGES)):
                parsed = [blocks(h or "") for h in b.column("html").to_pylist()]
                texts = ["\n".join(x[0] for x, y in zip(page, keep) if y) for page, keep in zip(parsed, net.label(parsed))]
                yield pa.RecordBatch.from_arrays([b.column("page_id"), b.column("url"), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], ["page_id", "url", "text", "n_chars"])

    return pick(pages, "page_id", "url", "html").mapInArrow(run, SCHEMA)


def op4_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return main_text(table(spark, sf_dir, "pages"))
