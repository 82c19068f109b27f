"""HTML extraction by a recurrent block labeller.

A page is read as a sequence of blocks: runs of text between tags that break lines, each with its tag
path. A bidirectional LSTM in numpy reads, for every block in turn, the mean of learned vectors of its
path's tags and classes, the mean of learned vectors of its hashed words, and a few shapes (length,
share of link text, case, punctuation). From both directions' states, which carry the whole page, each
block is classified as main text or not. It is trained here, on pages made from a grammar of layouts
with invented words, so that labels are known by construction; the package holds the weights.
"""

from __future__ import annotations

import html
import io
import pathlib
import pkgutil
import random
import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import select_as, small_batches
from .text import slices

#: Tags within a line, tags without content, tags whose text is no text of the page, and
#: start tags that end an open paragraph or item.
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q s samp small span strike strong sub sup time tt u var wbr".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style title iframe noframes".split())
LITERAL = frozenset("textarea xmp".split())  # their content is text, tags included; the labeller judges it like any other
ENDS_P = frozenset("address article aside blockquote div dl fieldset footer form h1 h2 h3 h4 h5 h6 header hr main nav ol p pre section table ul".split())
SAME_ENDS = frozenset("li dt dd tr td th option p".split())

#: Buckets of tag and word vectors, their sizes, units of each direction, and other inputs of a block.
TAG_BUCKETS, WORD_BUCKETS, TAG_DIM, WORD_DIM, UNITS, SHAPES = 1 << 10, 1 << 12, 16, 8, 16, 8
#: Training: pages, rounds over them, pages of a step. Pages of a batch and blocks of a batch when labelling.
TRAIN_PAGES, ROUNDS, STEP_PAGES, BATCH_PAGES = 4000, 5, 40, 256

#: Quotes hold a ">" only as an attribute's value; a stray one does not.
_TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)|</?([a-zA-Z][^\s/>]*)((?:=\s*\"[^\"]*(?:\"|\Z)|=\s*'[^']*(?:'|\Z)|[^>])*)(?:>|\Z)", re.S)
_ATTR = re.compile(r"(?:\s|^)(class|id|role|hidden|style)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?", re.I)
_SPLIT = re.compile(r"[A-Za-z]+")


class Path:
    """Tokens of the open elements around a block, as a chain that blocks share: nesting costs each element once."""

    __slots__ = ("parent", "tokens", "size", "total", "of")

    def __init__(self, parent: Path | None, tokens: tuple[str, ...]):
        self.parent, self.tokens = parent, tokens
        self.size = len(tokens) + (parent.size if parent else 0)
        self.total, self.of = None, None

    def all(self) -> tuple[str, ...]:
        out, at = [], self
        while at is not None:
            out.append(at.tokens)
            at = at.parent
        return tuple(t for tokens in reversed(out) for t in tokens)

    def mean(self, table: np.ndarray) -> np.ndarray:
        """Mean of the tokens' vectors, by sums kept along the chain; vector 0 of the table if there are none."""
        chain, at = [], self
        while at is not None and at.of is not table:
            chain.append(at)
            at = at.parent
        total = at.total if at is not None else np.zeros(table.shape[1], np.float64)
        for p in reversed(chain):
            total = total + sum(table[_tags[t]].astype(np.float64) for t in p.tokens)
            p.total, p.of = total, table
        return total / self.size if self.size else table[0]


@dataclass
class Block:
    """A run of text, its tag path, and how much of it is in links."""

    path: Path
    text: str
    linked: int


@dataclass
class _Open:
    tag: str
    path: Path


@dataclass
class _Run:
    parts: list[str] = field(default_factory=list)
    linked: int = 0


def _path_tokens(tag: str, attributes: str) -> tuple[str, ...]:
    out = [tag]
    if attributes and ("=" in attributes or "hidden" in attributes):
        for m in _ATTR.finditer(attributes):
            name, value = m[1].lower(), (m[2] or m[3] or m[4] or "").lower()
            if name == "hidden" or (name == "style" and "display:none" in value.replace(" ", "")):
                out.append("#hidden")
            elif name in ("class", "id", "role"):
                out += [f".{w.lower()}" for w in _SPLIT.findall(value)]
    return tuple(out)


def blocks_of(page: str) -> Iterator[Block]:
    """The blocks of a page in order; those without text are left out. Character references are decoded."""
    stack: list[_Open] = []
    spots: dict[str, list[int]] = {}  # depths of the open elements of each tag
    outer: list[int] = []  # depths of those that are not inline
    root = Path(None, ())
    run, links, at, end = _Run(), 0, 0, len(page)

    def cut():
        nonlocal run
        text = " ".join("".join(run.parts).split())
        done, run = run, _Run()
        if text:
            yield Block(stack[-1].path if stack else root, text, min(done.linked, len(text)))

    def add(raw: str):
        text = html.unescape(raw) if "&" in raw else raw
        run.parts.append(text)
        if links:
            run.linked += len(text)

    def shut(depth: int):
        nonlocal links
        while len(stack) > depth:
            o = stack.pop()
            links -= o.tag == "a"
            spots[o.tag].pop()
            if o.tag not in INLINE:
                outer.pop()

    while at < end:
        m = _TOKEN.search(page, at)
        if m is None:
            add(page[at:])
            break
        if m.start() > at:
            add(page[at : m.start()])
        at = m.end()
        if m[1] is None:  # a comment or declaration; CDATA and the like are markup too
            continue
        tag, closing = m[1].lower(), page[m.start() + 1] == "/"
        if tag == "br":
            run.parts.append(" ")
            continue
        if closing:
            if tag not in INLINE:
                yield from cut()
            depth = spots[tag][-1] if spots.get(tag) else None
            if depth is not None and (tag not in INLINE or not outer or depth > outer[-1]):
                shut(depth)
            continue
        if tag in RAW:
            yield from cut()
            close = re.compile(rf"</{re.escape(tag)}\s*/?>|\Z", re.I).search(page, at)
            at = max(close.end(), at)
            continue
        if tag not in INLINE:
            yield from cut()
            # An open inline element reaches into the new block; an open paragraph or item may end here.
            near = stack[outer[-1]].tag if outer else ""
            if (near == "p" and tag in ENDS_P) or (near == tag and tag in SAME_ENDS):
                shut(outer[-1])
        if tag not in VOID:
            path = stack[-1].path if stack else root
            spots.setdefault(tag, []).append(len(stack))
            if tag not in INLINE:
                outer.append(len(stack))
                path = Path(path, _path_tokens(tag, m[2]))
            stack.append(_Open(tag, path))
            links += tag == "a"
        if tag in LITERAL:
            close = re.compile(rf"</{tag}\b|\Z", re.I).search(page, at)
            add(page[at : close.start()])
            at = close.start()
    yield from cut()


def _bucket(word: str, n: int) -> int:
    return zlib.crc32(word.encode("utf-8", "replace")) % n


class _Remember(dict):
    def __init__(self, n: int):
        super().__init__()
        self.n = n

    def __missing__(self, word: str) -> int:
        if len(self) > 200_000:
            self.clear()
        b = self[word] = _bucket(word, self.n)
        return b


_tags, _words = _Remember(TAG_BUCKETS), _Remember(WORD_BUCKETS)


def _inputs(blocks: list[Block], table: np.ndarray | None = None) -> tuple:
    """Tag buckets, word buckets and shapes of a page's blocks; with a table of tag vectors, their means in place of buckets."""
    if table is None:
        tags = [[_tags[t] for t in b.path.all()] or [0] for b in blocks]
    else:
        tags = np.array([b.path.mean(table) for b in blocks], np.float32)
    words, shapes = [], np.zeros((len(blocks), SHAPES), np.float32)
    for i, b in enumerate(blocks):
        ws = b.text.split(" ")
        words.append(np.fromiter(map(_words.__getitem__, map(str.lower, ws)), np.int64, len(ws)))
        n = len(b.text)
        shapes[i] = (np.log1p(len(ws)) / 5, b.linked / n, len(ws) < 4, b.text[-1] in ".!?:;\"'", b.path.size / 10, i / len(blocks), (len(blocks) - i) / len(blocks), 1)
    return tags, words, shapes


def _means(table: np.ndarray, lists) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Mean vector of each list of buckets; the buckets in a row, and lengths."""
    flat = np.concatenate([np.asarray(x, np.int64) for x in lists])
    n = np.array([len(x) for x in lists], np.int64)
    out = np.add.reduceat(table[flat], np.cumsum(n) - n, axis=0) / n[:, None]
    return out.astype(np.float32), flat, n


def _sigmoid(x):
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


class Labeller:
    """The network: parameters by name, all float32."""

    def __init__(self, seed: int = 5):
        rng = np.random.default_rng(seed)
        x = TAG_DIM + WORD_DIM + SHAPES

        def draw(*shape, scale):
            return (rng.standard_normal(shape) * scale).astype(np.float32)

        self.p = {"tags": draw(TAG_BUCKETS, TAG_DIM, scale=0.3), "words": draw(WORD_BUCKETS, WORD_DIM, scale=0.02)}
        for side in "fb":
            self.p[f"wx{side}"] = draw(x, 4 * UNITS, scale=x**-0.5)
            self.p[f"wh{side}"] = draw(UNITS, 4 * UNITS, scale=UNITS**-0.5)
            bias = np.zeros(4 * UNITS, np.float32)
            bias[UNITS : 2 * UNITS] = 1
            self.p[f"b{side}"] = bias
        self.p["out"] = draw(2 * UNITS + x, 1, scale=0.1)
        self.p["bias"] = np.zeros(1, np.float32)

    def _direction(self, x, mask, side, keep):
        """States of one direction over x (steps x pages x inputs)."""
        steps, n, _ = x.shape
        h, c = np.zeros((n, UNITS), np.float32), np.zeros((n, UNITS), np.float32)
        out, kept = np.zeros((steps, n, UNITS), np.float32), []
        wx = x @ self.p[f"wx{side}"] + self.p[f"b{side}"]
        for t in range(steps) if side == "f" else range(steps - 1, -1, -1):
            g = wx[t] + h @ self.p[f"wh{side}"]
            s = _sigmoid(g[:, : 3 * UNITS])
            i, f, o = s[:, :UNITS], s[:, UNITS : 2 * UNITS], s[:, 2 * UNITS :]
            z = np.tanh(g[:, 3 * UNITS :])
            m = mask[t][:, None]
            new_c = f * c + i * z
            tc = np.tanh(new_c)
            if keep:
                kept.append((t, i, f, o, z, c, h, tc))
            c, h = np.where(m, new_c, c), np.where(m, o * tc, h)
            out[t] = h
        return out, kept

    def forward(self, pages, keep: bool = False):
        """Chances of main text of the blocks of some pages (each given by _inputs()), in a row."""
        sizes = [len(s) for _, _, s in pages]
        if keep or not isinstance(pages[0][0], np.ndarray):
            tv, tag_flat, tag_n = _means(self.p["tags"], [t for tags, _, _ in pages for t in tags])
        else:
            tv, tag_flat, tag_n = np.concatenate([tags for tags, _, _ in pages]), None, None
        wv, word_flat, word_n = _means(self.p["words"], [w for _, words, _ in pages for w in words])
        flat = np.concatenate([tv, wv, np.concatenate([s for _, _, s in pages])], axis=1)
        steps = max(sizes)
        row, col = np.concatenate([np.arange(n) for n in sizes]), np.repeat(np.arange(len(pages)), sizes)
        x = np.zeros((steps, len(pages), flat.shape[1]), np.float32)
        x[row, col] = flat
        mask = np.zeros((steps, len(pages)), bool)
        mask[row, col] = True
        hf, kf = self._direction(x, mask, "f", keep)
        hb, kb = self._direction(x, mask, "b", keep)
        top = np.concatenate([hf[row, col], hb[row, col], flat], axis=1)
        chance = _sigmoid(top @ self.p["out"] + self.p["bias"])[:, 0]
        return chance, (x, mask, row, col, top, kf, kb, tag_flat, tag_n, word_flat, word_n) if keep else None

    def gradients(self, pages, truth):
        """Mean loss and its gradients, by back-propagation through time."""
        chance, (x, mask, row, col, top, kf, kb, tag_flat, tag_n, word_flat, word_n) = self.forward(pages, True)
        loss = -np.mean(np.log(np.where(truth, chance, 1 - chance) + 1e-7))
        d = ((chance - truth) / len(truth)).astype(np.float32)[:, None]
        g = {"out": top.T @ d, "bias": d.sum(axis=0)}
        d_top = d @ self.p["out"].T
        d_flat = d_top[:, 2 * UNITS :].copy()
        for side, kept, a in (("f", kf, 0), ("b", kb, UNITS)):
            d_h = np.zeros((*mask.shape, UNITS), np.float32)
            d_h[row, col] = d_top[:, a : a + UNITS]
            d_x, g[f"wx{side}"], g[f"wh{side}"], g[f"b{side}"] = self._back(x, mask, side, kept, d_h)
            d_flat += d_x[row, col]
        for name, part, where, n in (("tags", d_flat[:, :TAG_DIM], tag_flat, tag_n), ("words", d_flat[:, TAG_DIM : TAG_DIM + WORD_DIM], word_flat, word_n)):
            g[name] = np.zeros_like(self.p[name])
            np.add.at(g[name], where, np.repeat(part / n[:, None], n, axis=0))
        return loss, g

    def _back(self, x, mask, side, kept, d_out):
        wx, wh = self.p[f"wx{side}"], self.p[f"wh{side}"]
        d_gates = np.zeros((*mask.shape, 4 * UNITS), np.float32)
        g_wh = np.zeros_like(wh)
        dh, dc = np.zeros(d_out.shape[1:], np.float32), np.zeros(d_out.shape[1:], np.float32)
        for t, i, f, o, z, c, h, tc in reversed(kept):
            m = mask[t][:, None]
            dh = dh + d_out[t]
            live = np.where(m, dh, 0)
            d_c = np.where(m, dc, 0) + live * o * (1 - tc * tc)
            d = np.concatenate([d_c * z * i * (1 - i), d_c * c * f * (1 - f), live * tc * o * (1 - o), d_c * i * (1 - z * z)], axis=1)
            d_gates[t] = d
            g_wh += h.T @ d
            dh = np.where(m, d @ wh.T, dh)
            dc = np.where(m, d_c * f, dc)
        flat = d_gates.reshape(-1, 4 * UNITS)
        return d_gates @ wx.T, x.reshape(-1, x.shape[2]).T @ flat, g_wh, flat.sum(axis=0)


# Training pages: a grammar of layouts.

_CONTENT = "article main content post entry story body text page question thread topic recipe document message inner".split()
_OUTER = "wrap wrapper container page layout site app root row col grid outer main".split()
_OTHER = {
    "nav": ["nav", "menu", "navbar", "breadcrumb", "topnav", "links", "pager", "tabs", "toc", "sidebar"],
    "header": ["header", "masthead", "banner", "top", "topbar", "logo", "site"],
    "footer": ["footer", "bottom", "copyright", "legal", "colophon"],
    "aside": ["sidebar", "aside", "related", "widget", "rail", "more", "tags"],
    "ad": ["ad", "ads", "advert", "advertisement", "sponsor", "promo", "sponsored"],
    "notice": ["notice", "cookie", "consent", "alert", "gdpr", "popup", "newsletter", "subscribe", "modal"],
    "comments": ["comments", "comment", "replies", "disqus", "respond", "discussion", "answers", "reply"],
    "form": ["form", "search", "login", "signup", "contact"],
    "share": ["share", "social", "byline", "meta", "author", "date", "follow", "user", "votes"],
}
#: Kinds that may stand under names that mean nothing, as their shape and place tell them.
_UNNAMED = {"nav": 0.45, "header": 0.45, "footer": 0.45, "aside": 0.3, "share": 0.2, "form": 0.2, "ad": 0.1, "notice": 0.1, "comments": 0.05}
_SAID = {
    "nav": "home about contact news products help login next previous index".split(),
    "header": "welcome official site search menu".split(),
    "footer": "copyright © · | all rights reserved privacy policy terms imprint 2021 2024 contact".split(),
    "aside": "related articles popular posts read more tags archive recent".split(),
    "ad": "advertisement sponsored buy now offer sale click here".split(),
    "notice": "we use cookies accept subscribe newsletter sign up agree consent".split(),
    "comments": "reply says commented on like report posted by anonymous comment".split(),
    "form": "email name submit search password send your".split(),
    "share": "share tweet facebook posted by on follow print".split(),
}
_SYLLABLES = ["ka", "to", "le", "in", "er", "the", "st", "ou", "é", "ü", "mi", "ra", "ción", "sch", "on"]


class _Pages:
    """Makes pages as lists of (html, is main text) pieces."""

    def __init__(self, seed: int):
        self.rng = random.Random(seed)

    def pick(self, items):
        return items[int(self.rng.random() * len(items))]

    def chance(self, p: float) -> bool:
        return self.rng.random() < p

    def count(self, low: int, high: int) -> int:
        return low + int(self.rng.random() * (high + 1 - low))

    def word(self) -> str:
        w = "".join(self.pick(_SYLLABLES) for _ in range(self.count(1, 4)))
        if self.chance(0.1):
            w += self.pick(["***", "###", "!!", "%%%", ",", ";"])
        return w.upper() if self.chance(0.05) else w

    def say(self, low: int, high: int, from_: list[str] | None = None) -> str:
        n = self.count(low, high)
        out = " ".join(self.pick(from_) if from_ and self.chance(0.35) else self.word() for _ in range(n))
        return out[:1].upper() + out[1:] + (self.pick([".", ".", "", "!"]) if n > 3 else "")

    def nonsense(self) -> str:
        """A class name that says nothing: of another language, or made by a tool."""
        return "".join(self.pick("abcdefghijklmnopqrstuvwxyz") for _ in range(self.count(2, 8)))

    def boxed(self, inner: list[tuple[str, int]], names: list[str], tags: tuple[str, ...] = ("div",)) -> list[tuple[str, int]]:
        """inner in an element with a name, a meaningless one, or none."""
        tag, how = self.pick(tags), self.rng.random()
        name = self.pick(names) if how < 0.55 else self.nonsense()
        attr = f' {self.pick(["class", "id"])}="{name}"' if how < 0.85 else ""
        return [(f"<{tag}{attr}>", -1), *inner, (f"</{tag}>", -1)]

    def wrapped(self, kind: str, inner: list[tuple[str, int]]) -> list[tuple[str, int]]:
        own = {"nav": "nav", "header": "header", "footer": "footer", "aside": "aside", "form": "form"}.get(kind)
        if self.chance(_UNNAMED[kind]):
            tag = self.pick(["div", "div", "section", "table"])
            attr = f' {self.pick(["class", "id"])}="{self.nonsense()}"' if self.chance(0.8) else ""
            inner = [("<tr><td>", -1), *inner, ("</td></tr>", -1)] if tag == "table" else inner
            return [(f"<{tag}{attr}>", -1), *inner, (f"</{tag}>", -1)]
        tag = own if own and self.chance(0.6) else self.pick(["div", "section", "div", "ul" if kind == "nav" else "div"])
        names = self.pick(_OTHER[kind]) + (" " + self.pick(["box", "inner", "wrap", "block", *_OTHER[kind]]) if self.chance(0.4) else "")
        attr = f' {self.pick(["class", "id", "class"])}="{names}"' if tag != own or self.chance(0.5) else ""
        return [(f"<{tag}{attr}>", -1), *inner, (f"</{tag}>", -1)]

    def other(self, kind: str) -> list[tuple[str, int]]:
        said, out = _SAID[kind], []
        if kind in ("nav", "header", "footer") and self.chance(0.3):  # links in one run
            text = self.pick([" ", " | ", "<br>", ""]).join(f'<a href="/{self.word()}">{self.say(1, 3, said)}</a>' for _ in range(self.count(1, 6)))
            return self.wrapped(kind, [(f"<p>{text}</p>" if self.chance(0.5) else text, 0)])
        n = {"nav": (3, 8), "footer": (1, 3), "comments": (1, 5), "aside": (2, 5)}.get(kind, (1, 2))
        for _ in range(self.count(*n) + 1):
            long_ = kind == "comments" or (kind in ("aside", "notice", "ad", "footer") and self.chance(0.4))
            text = self.say(4, 40, said) if long_ else self.say(1, 5, said)
            if kind == "nav" or (kind in ("aside", "footer", "share", "header") and self.chance(0.6)):
                text = f'<a href="/{self.word()}">{text}</a>'
            tag = self.pick(["li", "li", "p", "div", "span"]) if kind in ("nav", "aside") else self.pick(["p", "div", "span", "h3", ""])
            piece = [(f"<{tag}>{text}</{tag}>" if tag else f"{text}\n", 0)]
            if tag in ("span", ""):
                piece.append(("<br/><hr>", -1))
            if kind == "comments" and self.chance(0.5):  # one box for each, perhaps with its writer
                who = self.boxed([(f'<a href="/u">{self.word()}</a>', 0)], _OTHER["share"]) if self.chance(0.4) else []
                piece = [(f'<div class="{self.pick(["comment", "reply", "answer"])}">', -1), *who, *piece, ("</div>", -1)]
            out += piece
        if kind == "comments" and self.chance(0.4):
            tag = self.pick(["ol", "ul"])
            out = [(f"<{tag}>", -1), *(x for piece in out for x in ((("<li>", -1), piece) if piece[1] == 0 else (piece,))), (f"</{tag}>", -1)]
        elif kind in ("nav", "aside", "footer", "share") and self.chance(0.5):
            out = [("<ul>", -1), *out, ("</ul>", -1)]
        return self.wrapped(kind, out)

    def piece(self, said: list[str]) -> list[tuple[str, int]]:
        """A paragraph of the article or what may stand in its place."""
        text = self.say(1, 12, said) if self.chance(0.2) else self.say(2, 12) if self.chance(0.3) else self.say(1, 70)
        if self.chance(0.15):
            text = f"<b>{text}" + ("</b>" if self.chance(0.5) else "")
        if self.chance(0.15):
            text = text.replace(" ", ' <a href="x">link</a> ', 1)
        kind = self.rng.random()
        if kind < 0.64:
            return [(f"<p>{text}" + ("</p>" if self.chance(0.8) else "<br>"), 1)]
        if kind < 0.72:
            return [(f"<h2>{self.say(1, 8)}</h2>", 1)]
        if kind < 0.76:
            return [(f"<h3>{self.say(1, 5)}</h3>", 1)]
        if kind < 0.83:
            tag = self.pick(["ul", "ol"])
            return [(f"<{tag}>" + "".join(f"<li>{self.say(1, 12)}</li>" for _ in range(self.count(2, 6))) + f"</{tag}>", 1)]
        if kind < 0.86:
            return [(f"<blockquote>{text}</blockquote>", 1)]
        if kind < 0.89:
            cell = self.pick(["td", "th"])
            attr = self.pick(["", ' class="infobox"', f' class="{self.nonsense()}"'])
            return [(f"<table{attr}>" + "".join(f"<tr><{cell}>{self.say(1, 3)}</{cell}><td>{self.say(1, 4)}</td></tr>" for _ in range(self.count(1, 5))) + "</table>", 1)]
        if kind < 0.92:
            return [("<dl>" + "".join(f"<dt>{self.say(1, 2)}</dt><dd>{self.say(2, 14)}</dd>" for _ in range(self.count(1, 5))) + "</dl>", 1)]
        if kind < 0.94:
            return [(f"<pre>{self.say(1, 12)}</pre>", 1)]
        if kind < 0.96:
            return [(f'<figure><img src="x"><figcaption>{self.say(2, 10)}</figcaption></figure>', 1)]
        if kind < 0.975:
            return [(f"<details><summary>{self.say(1, 3)}</summary><p>{text}</p></details>", 1)]
        return [(f"<div>{text}</div>", 1)] if self.chance(0.5) else [(f"{text}<br><br>", 1), ("<hr>", -1)]

    def article(self) -> list[tuple[str, int]]:
        # What other blocks say may be said in the text too: where it stands decides, not its words.
        said = [w for ws in _SAID.values() for w in ws]
        out = [(f"<{h}>{self.say(2, 12, said if self.chance(0.2) else None) if self.chance(0.85) else self.word()}</{h}>", 1) for h in ["h1" if self.chance(0.8) else self.pick(["h2", "h3"])]] if self.chance(0.85) else []
        if self.chance(0.3):
            out += self.other("share")
        body, plain = [], self.chance(0.04)
        for _ in range(self.count(1, 11)):
            body += [(f"{self.say(5, 60)}<br><br>", 1)] if plain else self.piece(said)
            if self.chance(0.06):
                body += self.other(self.pick(["ad", "aside", "notice", "form"]))
            if self.chance(0.03):
                body = [*self.boxed(body, ["section", "body", "text", "chapter"], ("section", "div"))]
        if self.chance(0.3):
            body += [(f"<p>{self.say(2, 6)}</p>", 1)]  # a short last paragraph
        out += self.boxed(body, _CONTENT) if self.chance(0.25) else body
        if self.chance(0.1):
            out += self.other("share")
        how = self.rng.random()
        if how < 0.08:
            return out  # in no element of its own
        tag = self.pick(["article", "main", "div", "article", "section", "div"])
        name = self.pick(_CONTENT) if how < 0.65 else self.nonsense()
        attr = f' {self.pick(["class", "id"])}="{name}"' if tag in ("div", "section") and how < 0.92 or self.chance(0.4) else ""
        out = [(f"<{tag}{attr}>", -1), *out, (f"</{tag}>", -1)]
        return self.boxed(out, _OUTER + _CONTENT, ("div", "div", "main")) if self.chance(0.25) else out

    def page(self) -> list[tuple[str, int]]:
        out: list[tuple[str, int]] = []
        for kind, p in (("notice", 0.2), ("header", 0.35), ("nav", 0.75), ("form", 0.15), ("ad", 0.45), ("aside", 0.2)):
            if self.chance(p):
                out += self.other(kind)
        middle = self.article() if self.chance(0.97) else []
        after = []
        for kind, p in (("share", 0.2), ("comments", 0.35), ("aside", 0.35), ("ad", 0.2), ("form", 0.15), ("notice", 0.15)):
            if self.chance(p):
                after += self.other(kind)
        out += self.boxed(middle + after, _OUTER + ["thread", "topic", "questions"]) if self.chance(0.25) else middle + after
        if self.chance(0.8):
            out += self.other("footer")
        for _ in range(self.count(0, 2) if self.chance(0.4) else 0):
            out = self.boxed(out, _OUTER)
        return [("<!DOCTYPE html><html><head><title>x</title></head><body>", -1), *out, ("</body></html>", -1)]


def training_page(maker: _Pages) -> tuple[list[Block], np.ndarray]:
    """Blocks and labels of a made page: each piece's text is marked, so that blocks tell their label."""
    marked = "".join(re.sub(r">([^<]*[^<\s][^<]*)", lambda m, k=k: f">\x01{k}{m[1]}", s if s[:1] == "<" else f"\x01{k}{s}") if k >= 0 else s for s, k in maker.page())
    blocks, labels = [], []
    for b in blocks_of(marked):
        found = re.search("\x01([01])", b.text)
        text = " ".join(re.sub("\x01[01]", "", b.text).split())
        if found and text:
            blocks.append(Block(b.path, text, min(b.linked, len(text))))
            labels.append(int(found[1]))
    return blocks, np.array(labels, np.float32)


def train(pages: int = TRAIN_PAGES, rounds: int = ROUNDS, seed: int = 9) -> Labeller:
    """A labeller trained by Adam on made pages; the same each time."""
    maker, data = _Pages(seed), []
    while len(data) < pages:
        blocks, labels = training_page(maker)
        if blocks:
            data.append((_inputs(blocks), labels))
    net, rng = Labeller(), np.random.default_rng(seed)
    m1 = {k: np.zeros_like(v) for k, v in net.p.items()}
    m2 = {k: np.zeros_like(v) for k, v in net.p.items()}
    step, total = 0, rounds * -(-pages // STEP_PAGES)
    for _ in range(rounds):
        order = rng.permutation(pages)
        for a in range(0, pages, STEP_PAGES):
            part = [data[i] for i in order[a : a + STEP_PAGES]]
            _, g = net.gradients([x for x, _ in part], np.concatenate([y for _, y in part]))
            step += 1
            rate = 0.01 * (1 - 0.9 * step / total)
            for k, v in g.items():
                v = np.clip(v, -1, 1)
                m1[k] = 0.9 * m1[k] + 0.1 * v
                m2[k] = 0.999 * m2[k] + 0.001 * v * v
                net.p[k] -= rate * (m1[k] / (1 - 0.9**step)) / (np.sqrt(m2[k] / (1 - 0.999**step)) + 1e-8)
    return net


#: The file of the package that holds the weights that train() made (`python -m skarn.llm.html_extract` makes it anew).
WEIGHTS = "html_labeller.npz"


def save(net: Labeller, path: str) -> None:
    """Writes the weights of a labeller as 16-bit floats."""
    np.savez_compressed(path, **{k: v.astype(np.float16) for k, v in net.p.items()})


_trained: list[Labeller] = []


def labeller() -> Labeller:
    """The trained network, from the package's weights, read once for each driver."""
    if not _trained:
        net = Labeller()
        with np.load(io.BytesIO(pkgutil.get_data(__package__, WEIGHTS))) as kept:
            net.p = {k: kept[k].astype(np.float32) for k in net.p}
        _trained.append(net)
    return _trained[0]


def main_texts(net: Labeller, pages: list[str | None]) -> list[str]:
    """Main text of each page: its main blocks joined by one space; '' if there is none."""
    blocks = [list(blocks_of(p)) if p else [] for p in pages]
    out = [""] * len(pages)
    order = sorted((i for i in range(len(pages)) if blocks[i]), key=lambda i: len(blocks[i]))
    a = 0
    while a < len(order):  # pages of similar length together, and fewer of long ones
        b = min(a + BATCH_PAGES, len(order))
        while b > a + 1 and (b - a) * len(blocks[order[b - 1]]) > 40_000:
            b -= max(1, (b - a) // 4)
        part = order[a:b]
        chance, _ = net.forward([_inputs(blocks[i], net.p["tags"]) for i in part])
        at = 0
        for i in part:
            own = chance[at : at + len(blocks[i])]
            out[i] = " ".join(x.text for x, c in zip(blocks[i], own) if c > 0.5)
            at += len(blocks[i])
        a = b
    return out


def extract(pages: DataFrame) -> DataFrame:
    """(page_id, url, text, n_chars) of every row of pages (page_id, url, html).

    text is the page's main text, decoded, with one space between words and blocks; '' for null or
    empty html and for pages without any. A block whose chance is a half or less isn't main text. n_chars counts its code points. Repeated rows are read one by
    one; an empty table gives an empty result.
    """
    small_batches(pages.sparkSession)
    net = pages.sparkSession.sparkContext.broadcast(labeller())

    def run(batches):
        for batch in slices(batches, 2):
            texts = main_texts(net.value, batch.column(2).to_pylist())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], ["page_id", "url", "text", "n_chars"])

    return select_as(pages, page_id="long", url="string", html="string").mapInArrow(run, "page_id long, url string, text string, n_chars long")


if __name__ == "__main__":
    save(train(), str(pathlib.Path(__file__).with_name(WEIGHTS)))
