"""Main-text extraction from raw HTML: a bidirectional LSTM labels the blocks of a page.

A page is read in one pass of a tolerant tokenizer into blocks: the text between two block-level tags, with
character references decoded and white space runs made one space.  Every block is seen as its path of open
tags (with class, id and role words), its hashed words, and a few figures (length, share of link text,
place).  A bidirectional LSTM in numpy reads a page's blocks from both ends and gives each the probability
of being main text, so that a block is judged by the whole page.

The network is trained here, on pages made from a bounded sample of the corpus (``FIT_PAGES`` pages by a hash
of page_id): each page as it is, its blocks labelled by the page's own semantic tags where it has them
(article or main, less what HTML names as something else), and the same texts set again into made layouts
that name their parts in other ways (divs with classes or ids, tables, cookie notices, adverts, forms,
sidebars, comment threads), labelled by the part they were put in.  Of the path, a word that no training page
had is left out when scoring (its bucket has no training), so unknown class names don't mislead.

Scale: one scan of the pages and no shuffle; the sample (bounded in rows and in the length of a page) is
all that reaches the driver, and the weights (some 200 KB) travel with the tasks.  A page is processed
whole; pages are batched by their number of blocks.

Defined cases: null html is empty (text empty, n_chars 0); markup without a block gives an empty text;
unclosed, crossed or cut-off tags are tolerated, in time linear in the page; a tag, comment, script or style
without an end is dropped with what follows it; texts of mathematics, drawings, noscript and the like are blocks
as any other; repeated rows get a row each; with an empty table (nothing to train on) the made layouts alone train
the network; extra columns are kept by ``extract``, but for those named as its own (text, n_chars), which it
replaces.
"""

from __future__ import annotations

import html as html_lib
import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import hash_fraction, spread, table, text_slices, without

FIT_PAGES = 120
FIT_CHARS = 60_000
PATH_BUCKETS = 1024
WORD_BUCKETS = 512
EMBED = 16
FIGURES = 6
HIDDEN = 12
EPOCHS = 10
SEED = 11

#: HTML's own element names, by what they mean to this reader (fixed values).
RAW = {"script", "style", "iframe", "textarea", "title"}
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
INLINE = {
    "a", "abbr", "acronym", "b", "bdi", "bdo", "big", "cite", "code", "data", "del", "dfn", "em", "font", "i", "ins", "kbd", "label", "mark",
    "q", "rp", "rt", "ruby", "s", "samp", "small", "span", "strike", "strong", "sub", "sup", "time", "tt", "u", "var", "wbr",
    "math", "semantics", "annotation", "mi", "mn", "mo", "ms", "mtext", "mspace", "mrow", "mfrac", "msqrt", "mroot", "msup", "msub", "msubsup", "munder", "mover",
    "munderover", "mtable", "mtr", "mtd", "svg", "g", "defs", "use", "path", "rect", "circle", "line", "polygon", "text", "tspan",
}
CLOSES_P = {
    "address", "article", "aside", "blockquote", "details", "div", "dl", "fieldset", "figcaption", "figure", "footer", "form", "h1", "h2", "h3", "h4", "h5",
    "h6", "header", "hr", "main", "menu", "nav", "ol", "p", "pre", "section", "table", "ul",
}
MAIN = {"article", "main"}
ASIDE = {"nav", "header", "footer", "aside", "form", "button", "select", "dialog", "menu"}

_TAG = re.compile(r"</?([a-zA-Z][^\s/>]*+)")
_TAG_END = re.compile(r"(?>[^>\"']++|\"[^\"]*+\"|'[^']*+')*+>")
_RAW_END = {t: re.compile(rf"</{t}\b", re.I) for t in RAW}
_ATTR = re.compile(r"\b(class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))", re.I)
_NAME = re.compile(r"[A-Za-z]+")
_SPACE = re.compile(r"\s+")
DEPTH = 256  # elements nested deeper are read, but not named in paths
_QUOTE_FAULTS = 100  # tags of a page whose quotes don't pair up; after so many, quotes are no longer heeded


def _bucket(name: str) -> int:
    return zlib.crc32(name.encode()) % PATH_BUCKETS


@dataclass
class Block:
    text: str
    path: tuple[str, ...]
    link: float = 0.0


@dataclass
class _Open:
    tag: str
    names: tuple[str, ...] = field(default_factory=tuple)


def _names(tag: str, attrs: str) -> tuple[str, ...]:
    out = [tag]
    if attrs and "=" in attrs:
        for _, a, b, c in _ATTR.findall(attrs):
            out += [f".{w.lower()}" for w in _NAME.findall(a or b or c)]
    return tuple(out)


def _markup(page: str) -> Iterator[tuple[str, str, bool, str]]:
    """(text before, tag, closing, attributes) for each tag, and what is left with tag "": in time linear in the page.

    A tag ends at the first ``>`` outside quotes, or at the first of all if its quotes don't pair up.  A tag
    without an end is dropped with all after it, as comments, scripts and styles without one are.
    """
    at = begun = 0
    faults, without_end = 0, set()
    while (at := page.find("<", at)) >= 0:
        if page.startswith("<!--", at):
            stop = page.find("-->", at + 4)
            end = stop + 3
        elif page.startswith(("<!", "<?"), at):
            stop = page.find(">", at)
            end = stop + 1
        elif (m := _TAG.match(page, at)) is None:
            at += 1
            continue
        else:
            found = _TAG_END.match(page, m.end()) if faults < _QUOTE_FAULTS else None
            faults += found is None
            stop = page.find(">", m.end()) if found is None else found.end() - 1
            end = stop + 1
        if stop < 0:
            yield page[begun:at], "", False, ""
            return
        if page[at + 1] in "!?":
            yield page[begun:at], "!", False, ""
            at = begun = end
            continue
        tag, closing = m.group(1).lower(), page[at + 1] == "/"
        before, begun = page[begun:at], end
        at = end
        if tag in RAW and not closing and tag not in without_end:
            close = _RAW_END[tag].search(page, end)
            if close is not None:
                at = begun = close.start()
            elif tag in ("script", "style"):
                yield before, tag, False, ""
                return
            else:
                without_end.add(tag)
        yield before, tag, closing, page[m.end() : stop]
    yield page[begun:], "", False, ""


def blocks(page: str) -> list[Block]:
    """The page's blocks in order; what stands in scripts, styles and other unread elements is left out."""
    out: list[Block] = []
    stack: list[_Open] = []
    parts: list[str] = []
    linked, in_link, path = 0, 0, None

    def flush() -> None:
        nonlocal linked, path
        if parts:
            text = _SPACE.sub(" ", html_lib.unescape("".join(parts))).strip()
            if text:
                if path is None:
                    path = tuple(x for o in stack for x in o.names)
                out.append(Block(text, path, min(1.0, linked / len(text))))
            parts.clear()
        linked = 0

    for text, tag, closing, attrs in _markup(page):
        if text:
            parts.append(text)
            if in_link:
                linked += len(text)
        if tag in ("", "!"):
            continue
        if tag == "a":
            in_link = 0 if closing else 1
        if tag == "br":
            parts.append(" ")
            continue
        if tag in INLINE:
            continue
        flush()
        if tag in VOID or tag in RAW:
            continue
        path = None
        if closing:
            for k in range(len(stack) - 1, -1, -1):
                if stack[k].tag == tag:
                    del stack[k:]
                    in_link = 0
                    break
                # A paragraph's or item's end doesn't reach out of what encloses it.
                if tag in ("p", "li") and stack[k].tag not in ("p", "li", "b"):
                    break
            continue
        if tag in CLOSES_P and stack and stack[-1].tag == "p":
            stack.pop()
        if tag in ("li", "dt", "dd", "tr", "td", "th", "option") and stack and stack[-1].tag == tag:
            stack.pop()
        if len(stack) < DEPTH and (tag in CLOSES_P or not attrs.endswith("/")):
            stack.append(_Open(tag, _names(tag, attrs)))
    flush()
    return out


def _figures(b: Block, k: int, n: int) -> list[float]:
    words = b.text.count(" ") + 1
    return [min(1.0, words / 50), min(1.0, len(b.text) / 400), b.link, k / max(1, n - 1), float(b.text[-1] in ".!?…:;\"'”"), min(1.0, n / 40)]


def features(page: list[Block]) -> tuple[list[list[int]], list[list[int]], np.ndarray]:
    """For each block: buckets of its path's names, buckets of its words, and figures."""
    cache: dict[tuple[str, ...], list[int]] = {}
    paths, words = [], []
    for b in page:
        p = cache.get(b.path)
        if p is None:
            own = {_bucket(x) for x in b.path if x not in ("html", "body")}
            p = cache[b.path] = sorted(own) or [_bucket("body")]
        paths.append(p)
        words.append([zlib.crc32(w) % WORD_BUCKETS for w in b.text.lower().encode().split()])
    return paths, words, np.array([_figures(b, k, len(page)) for k, b in enumerate(page)]).reshape(len(page), FIGURES)


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


class BiLSTM:
    """A bidirectional LSTM over blocks with a logistic output; float32, trained by Adam."""

    def __init__(self, seed: int = SEED) -> None:
        rng = np.random.default_rng(seed)
        width = 2 * EMBED + FIGURES
        self.p: dict[str, np.ndarray] = {
            "path": rng.normal(0, 0.3, (PATH_BUCKETS, EMBED)),
            "word": rng.normal(0, 0.1, (WORD_BUCKETS, EMBED)),
            "out": rng.normal(0, 0.3, (2 * HIDDEN + width,)),
            "bias": np.zeros(1),
        }
        for d in ("f", "b"):
            self.p["wx" + d] = rng.normal(0, 1 / np.sqrt(width), (width, 4 * HIDDEN))
            self.p["wh" + d] = rng.normal(0, 1 / np.sqrt(HIDDEN), (HIDDEN, 4 * HIDDEN))
            self.p["bh" + d] = np.concatenate((np.zeros(HIDDEN), np.ones(HIDDEN), np.zeros(2 * HIDDEN)))
        self.p = {k: v.astype(np.float32) for k, v in self.p.items()}
        self.trained = np.zeros(PATH_BUCKETS, bool)

    @staticmethod
    def _mean(lists: list[list[int]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        flat = np.fromiter((x for own in lists for x in own), np.int64)
        row = np.repeat(np.arange(len(lists)), [len(own) for own in lists])
        return flat, row, np.maximum(1, np.bincount(row, minlength=len(lists))).astype(np.float32)

    @staticmethod
    def _pool(table_: np.ndarray, flat: np.ndarray, row: np.ndarray, n: int) -> np.ndarray:
        out = np.zeros((n, table_.shape[1]), np.float32)
        if len(flat):
            cuts = np.flatnonzero(np.r_[True, row[1:] != row[:-1]])
            out[row[cuts]] = np.add.reduceat(table_[flat], cuts, axis=0)
        return out

    def _inputs(self, paths, words, figures, seen_only: bool):
        pf, pr, _ = self._mean(paths)
        wf, wr, wn = self._mean(words)
        if seen_only:
            keep = self.trained[pf]
            pf, pr = pf[keep], pr[keep]
        n = len(paths)
        # Names of the path add up (a name inside another means what both mean); words are averaged.
        x = np.concatenate((self._pool(self.p["path"], pf, pr, n), self._pool(self.p["word"], wf, wr, n) / wn[:, None], figures.astype(np.float32)), 1)
        return x, (pf, pr, wf, wr, wn)

    def _scan(self, x: np.ndarray, mask: np.ndarray, d: str, keep: bool):
        """x: (pages, steps, width); steps past a page's end pass the state on unchanged.

        What back-propagation needs of each step is kept only if ``keep``.
        """
        n, steps, _ = x.shape
        h = np.zeros((n, HIDDEN), np.float32)
        c = np.zeros((n, HIDDEN), np.float32)
        hs = np.zeros((n, steps, HIDDEN), np.float32)
        kept = []
        spans = [(s, min(steps, s + 2048)) for s in range(0, steps, 2048)]
        for low, high in spans if d == "f" else spans[::-1]:
            gx = x[:, low:high] @ self.p["wx" + d] + self.p["bh" + d]
            for t in range(low, high) if d == "f" else range(high - 1, low - 1, -1):
                g = gx[:, t - low] + h @ self.p["wh" + d]
                i, f, o = (_sigmoid(g[:, k * HIDDEN : (k + 1) * HIDDEN]) for k in range(3))
                u = np.tanh(g[:, 3 * HIDDEN :])
                m = mask[:, t : t + 1]
                c2 = f * c + i * u
                tc = np.tanh(c2)
                if keep:
                    kept.append((t, h, c, i, f, o, u, tc, m))
                h, c = np.where(m, o * tc, h), np.where(m, c2, c)
                hs[:, t] = h
        return hs, kept

    def _scan_back(self, x: np.ndarray, dhs: np.ndarray, kept: list, d: str, grad: dict) -> np.ndarray:
        dh = np.zeros((len(x), HIDDEN), np.float32)
        dc = np.zeros_like(dh)
        dg_all = np.zeros((*x.shape[:2], 4 * HIDDEN), np.float32)
        gwh = np.zeros_like(self.p["wh" + d])
        for t, h0, c0, i, f, o, u, tc, m in reversed(kept):
            dh = dh + dhs[:, t]
            own_h, own_c = np.where(m, dh, 0), np.where(m, dc, 0)
            dct = own_c + own_h * o * (1 - tc * tc)
            dg = np.concatenate((dct * u * i * (1 - i), dct * c0 * f * (1 - f), own_h * tc * o * (1 - o), dct * i * (1 - u * u)), 1)
            gwh += h0.T @ dg
            dg_all[:, t] = dg
            dh = np.where(m, dg @ self.p["wh" + d].T, dh)
            dc = np.where(m, dct * f, dc)
        flat = dg_all.reshape(-1, 4 * HIDDEN)
        grad["wh" + d] = gwh
        grad["wx" + d] = x.reshape(len(flat), -1).T @ flat
        grad["bh" + d] = flat.sum(0)
        return dg_all @ self.p["wx" + d].T

    def _forward(self, pages: list, training: bool):
        lens = np.array([len(p[0]) for p in pages])
        steps = int(lens.max())
        mask = np.arange(steps) < lens[:, None]
        x, parts = self._inputs([a for p in pages for a in p[0]], [a for p in pages for a in p[1]], np.concatenate([p[2] for p in pages]), not training)
        grid = np.zeros((len(pages), steps, x.shape[1]), np.float32)
        grid[mask] = x
        hf, kf = self._scan(grid, mask, "f", training)
        hb, kb = self._scan(grid, mask, "b", training)
        f, b, own = np.split(self.p["out"], [HIDDEN, 2 * HIDDEN])
        return hf @ f + hb @ b + grid @ own + self.p["bias"][0], mask, grid, (hf, hb), (kf, kb), parts

    def probabilities(self, pages: list) -> list[np.ndarray]:
        """For each page (its :func:`features`) the probability of every block being main text."""
        out: list[np.ndarray] = [np.zeros(0)] * len(pages)
        order = sorted((k for k in range(len(pages)) if len(pages[k][0])), key=lambda k: len(pages[k][0]))
        at = 0
        while at < len(order):  # pages of like length together, at most some 4,096 padded blocks
            end, longest = at, 0
            while end < len(order) and (end == at or (end - at + 1) * len(pages[order[end]][0]) <= 4096):
                end += 1
            own = order[at:end]
            z, mask, *_ = self._forward([pages[k] for k in own], False)
            for r, k in enumerate(own):
                out[k] = _sigmoid(z[r][mask[r]])
            at = end
        return out

    def train(self, pages: list, labels: list[np.ndarray], epochs: int = EPOCHS, rate: float = 0.02, batch: int = 24) -> None:
        rng = np.random.default_rng(SEED)
        for p in pages:
            for own in p[0]:
                self.trained[own] = True
        m1 = {k: np.zeros_like(v) for k, v in self.p.items()}
        m2 = {k: np.zeros_like(v) for k, v in self.p.items()}
        step = 0
        for epoch in range(epochs):
            order = rng.permutation(len(pages))
            for s in range(0, len(order), batch):
                own = order[s : s + batch]
                z, mask, grid, (hf, hb), (kf, kb), (pf, pr, wf, wr, wn) = self._forward([pages[k] for k in own], True)
                y = np.zeros(mask.shape, np.float32)
                y[mask] = np.concatenate([labels[k] for k in own])
                dz = np.where(mask, _sigmoid(z) - y, 0).astype(np.float32) / max(1, mask.sum())
                top = np.concatenate((hf, hb, grid), 2)
                grad = {"out": np.einsum("nt,ntk->k", dz, top), "bias": np.array([dz.sum()], np.float32)}
                dtop = dz[:, :, None] * self.p["out"]
                dx = dtop[:, :, 2 * HIDDEN :].copy()
                dx += self._scan_back(grid, dtop[:, :, :HIDDEN], kf, "f", grad)
                dx += self._scan_back(grid, dtop[:, :, HIDDEN : 2 * HIDDEN], kb, "b", grad)
                flat = dx[mask]
                for name, idx, row, part in (("path", pf, pr, flat[:, :EMBED]), ("word", wf, wr, flat[:, EMBED : 2 * EMBED] / wn[:, None])):
                    grad[name] = np.zeros_like(self.p[name])
                    np.add.at(grad[name], idx, part[row])
                step += 1
                for k, g in grad.items():
                    g = g + 1e-5 * self.p[k]
                    m1[k] = 0.9 * m1[k] + 0.1 * g
                    m2[k] = 0.99 * m2[k] + 0.01 * g * g
                    self.p[k] -= (rate * 0.9**epoch * (m1[k] / (1 - 0.9**step)) / (np.sqrt(m2[k] / (1 - 0.99**step)) + 1e-8)).astype(np.float32)


def own_labels(page: list[Block]) -> np.ndarray | None:
    """Labels by a page's own semantic tags; None if it has no article or main element."""
    if not any(MAIN & set(b.path) for b in page):
        return None
    out = []
    for b in page:
        inside = [k for k, x in enumerate(b.path) if x in MAIN]
        named = any(x in ASIDE for x in b.path[inside[0] :]) if inside else True
        out.append(float(bool(inside) and not named))
    return np.array(out)


#: Words that pages use for their parts in class and id (fixed values, English, by common usage).
_PARTS: dict[str, list[str]] = {
    "main": ["content", "article", "post", "entry", "story", "main", "body", "article body", "post content", "entry content", "main content", "page content", "text", "blog post", "article text", "story body"],
    "menu": ["nav", "menu", "navbar", "navigation", "main nav", "top menu", "site nav", "breadcrumb", "breadcrumbs", "pagination", "pager", "tabs", "toc", "skip link", "links", "nav links", "nav list"],
    "header": ["header", "masthead", "top bar", "site header", "banner", "logo", "page header", "topbar", "branding"],
    "footer": ["footer", "site footer", "copyright", "bottom", "page footer", "legal", "imprint", "colophon"],
    "sidebar": ["sidebar", "side bar", "aside", "widget", "related", "related posts", "recommended", "popular", "trending", "see also", "archive", "tags", "tag cloud", "share", "social", "author bio", "rail", "side", "more stories", "teaser"],
    "notice": ["cookie", "cookie notice", "cookie banner", "consent", "gdpr", "notice", "alert", "popup", "modal", "overlay", "privacy notice", "message", "warning", "toast", "paywall", "disclaimer", "cookies", "announcement"],
    "advert": ["ad", "ads", "advert", "advertisement", "sponsored", "promo", "promotion", "banner ad", "ad slot", "ad unit", "adsense", "sponsor", "adbox", "advertising", "ad container"],
    "form": ["form", "search", "search form", "login", "subscribe", "newsletter", "signup", "contact form", "search box", "subscription", "poll"],
    "comments": ["comments", "comment", "comment list", "reader comments", "discussion", "responses", "replies", "reply", "comment body", "comment thread", "user comments", "feedback", "disqus", "comments area"],
}
_TAGS = {
    "menu": ["nav", "div", "ul", "menu", "div"], "header": ["header", "div", "header"], "footer": ["footer", "div", "footer"], "sidebar": ["aside", "div", "section", "aside"],
    "notice": ["div", "section", "aside", "dialog", "p"], "advert": ["div", "aside", "section", "p", "ins", "figure"], "form": ["form", "div", "form"], "comments": ["section", "div", "ol", "ul", "article", "aside"],
}


def _mark(rng: np.random.Generator, part: str) -> str:
    name = _PARTS[part][rng.integers(len(_PARTS[part]))]
    name = name.replace(" ", ["-", "_", " ", "-"][rng.integers(4)])
    return [f' class="{name}"', f' id="{name}"', f' class="{name}" id="{name}"'][rng.integers(3)]


def made_page(texts: list[str], rng: np.random.Generator) -> tuple[str, list[float]]:
    """A page in a made layout around ``texts``, and its blocks' labels in order."""
    labels: list[float] = []
    escape = html_lib.escape

    def some(low: int, high: int) -> str:
        words = texts[rng.integers(len(texts))].split()
        n = int(rng.integers(low, high + 1))
        k = int(rng.integers(0, max(1, len(words) - n)))
        return escape(" ".join(words[k : k + n]) or "text")

    def block(tag: str, text: str, y: float, attrs: str = "") -> str:
        labels.append(y)
        return f"<{tag}{attrs}>{text}</{tag}>"

    def part(kind: str) -> str:
        tag = _TAGS[kind][rng.integers(len(_TAGS[kind]))]
        semantic = tag in ASIDE
        attrs = _mark(rng, kind) if not semantic or rng.random() < 0.5 else ""
        if tag in ("ul", "ol"):
            return f"<{tag}{attrs}>" + "".join(block("li", some(1, 8) if kind == "menu" else some(4, 40), 0.0) for _ in range(rng.integers(2, 6))) + f"</{tag}>"
        if kind == "menu":
            return f"<{tag}{attrs}><ul>" + "".join(block("li", f'<a href="#">{some(1, 3)}</a>', 0.0) for _ in range(rng.integers(2, 8))) + f"</ul></{tag}>"
        if kind == "form":
            return f"<{tag}{attrs}>" + block("label" if rng.random() < 0 else "p", some(1, 6), 0.0) + '<input type="text">' + block("button", some(1, 2), 0.0) + f"</{tag}>"
        if kind in ("comments", "sidebar", "notice") and tag != "p":
            head = block(["h2", "h3", "h4"][rng.integers(3)], some(1, 4), 0.0) if rng.random() < 0.6 else ""
            inner = ["p", "div", "li"][rng.integers(3)]
            wrap = _mark(rng, kind) if rng.random() < 0.4 else ""
            return f"<{tag}{attrs}>{head}" + "".join(f"<div{wrap}>{block(inner, some(2, 45), 0.0)}</div>" for _ in range(rng.integers(1, 5))) + f"</{tag}>"
        return block(tag, some(1, 25), 0.0, attrs)

    def article() -> str:
        main = ["article", "main", "div", "section", "div", "td", "div"][rng.integers(7)]
        attrs = _mark(rng, "main") if main not in MAIN or rng.random() < 0.4 else ""
        body = [block(["h1", "h1", "h2"][rng.integers(3)], some(2, 12), 1.0)] if rng.random() < 0.85 else []
        inner = rng.random() < 0.15
        for _ in range(int(rng.integers(1, 9))):
            kind = rng.random()
            if kind < 0.06:
                body.append(block("h2" if rng.random() < 0.5 else "h3", some(1, 6), 1.0))
            elif kind < 0.14:
                body.append("<ul>" + "".join(block("li", some(2, 15), 1.0) for _ in range(rng.integers(2, 5))) + "</ul>")
            elif kind < 0.18:
                body.append("<blockquote>" + block("p", some(4, 30), 1.0) + "</blockquote>")
            elif kind < 0.22:
                body.append("<table><tr>" + block("td", some(1, 6), 1.0) + block("td", some(1, 6), 1.0) + "</tr></table>")
            elif kind < 0.32 and inner:
                body.append(part(["advert", "sidebar", "form", "notice", "menu"][rng.integers(5)]))
            else:
                body.append(block("div" if rng.random() < 0.08 else "p", some(1, 70), 1.0))
        text = "".join(body)
        if rng.random() < 0.15:
            text += part("comments")
        if main == "td":
            return f"<table><tr><td{attrs}>{text}</td></tr></table>"
        return f"<{main}{attrs}>{text}</{main}>"

    before = [part(k) for k in ("notice", "header", "menu", "advert", "form", "sidebar") if rng.random() < 0.45]
    middle = article()
    after = [part(k) for k in ("comments", "sidebar", "advert", "form", "menu", "notice", "footer") if rng.random() < 0.4]
    wrap = rng.random()
    shell = '<div class="container"><div id="wrapper">' if wrap < 0.3 else '<div class="page">' if wrap < 0.5 else ""
    return f"<html><body>{shell}{''.join(before)}{middle}{''.join(after)}" + "</div>" * shell.count("<div") + "</body></html>", labels


_LETTERS = "aeiou", "bcdfglmnprst"


def _invented(rng: np.random.Generator, n: int) -> list[str]:
    """Sentences of invented words, for when there is no corpus to take texts from."""
    word = lambda: "".join(_LETTERS[k % 2][rng.integers(len(_LETTERS[k % 2]))] for k in range(int(rng.integers(2, 9))))
    return [" ".join(word() for _ in range(int(rng.integers(5, 80)))).capitalize() + "." for _ in range(n)]


def training_set(pages: list[str], made: int = 600) -> tuple[list, list[np.ndarray]]:
    """Features and labels of the sampled pages and of made ones."""
    rng = np.random.default_rng(SEED)
    feats, labels, texts = [], [], _invented(rng, 40)
    for page in pages:
        own = blocks(page)
        texts += [b.text for b in own if len(b.text) > 60]
        y = own_labels(own)
        if y is not None:
            feats.append(features(own))
            labels.append(y)
    for _ in range(made):
        page, y = made_page(texts, rng)
        own = blocks(page)
        if len(own) == len(y):  # a text that itself reads as nothing has no block
            feats.append(features(own))
            labels.append(np.array(y))
    return feats, labels


def fit(pages: DataFrame, fit_pages: int = FIT_PAGES) -> BiLSTM:
    """Trains on the driver, on about ``fit_pages`` whole pages (of at most ``FIT_CHARS`` letters) and made ones."""
    n = pages.count()
    share = min(1.0, fit_pages / max(1, n))
    sample = pages.where((F.length("html") <= FIT_CHARS) & (hash_fraction(F.col("page_id"), 9) < share))
    rows = sample.select("page_id", "html").orderBy("page_id", "html").limit(2 * fit_pages).collect()
    net = BiLSTM()
    feats, labels = training_set([r["html"] for r in rows])
    net.train(feats, labels)
    return net


def extract_text(pages: list[str], net: BiLSTM) -> list[str]:
    """The main text of each page: the blocks that are more likely main text than not, joined by spaces."""
    parsed = [blocks(p) for p in pages]
    kept = net.probabilities([features(p) for p in parsed])
    return [" ".join(b.text for b, k in zip(p, prob, strict=True) if k >= 0.5) for p, prob in zip(parsed, kept, strict=True)]


def extract(pages: DataFrame, net: BiLSTM) -> DataFrame:
    """``pages`` with text and n_chars."""
    pages = without(pages, "text", "n_chars")
    shared = pages.sparkSession.sparkContext.broadcast(net)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for batch in batches:
            for i, j, data, offs in text_slices(batch, "html"):
                raw = data.tobytes()
                texts = extract_text([raw[offs[r] : offs[r + 1]].decode() for r in range(j - i)], model)
                new = [pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())]
                yield pa.RecordBatch.from_arrays([*batch.slice(i, j - i).columns, *new], names=[*batch.schema.names, "text", "n_chars"])

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in pages.schema)
    return pages.mapInArrow(run, f"{fields}, text string, n_chars long")


def html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = spread(table(spark, sf_dir, "pages").select("page_id", "url", "html"))
    return extract(pages, fit(pages)).drop("html")
