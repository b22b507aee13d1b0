"""Main-text extraction from HTML with a tree-structured graphical model.

A page's block elements form a tree of two-valued variables: content or not. Every node has a potential from its
tag, the words of its class, id and role, the length of its text, how much of it is linked, how it is punctuated and
what stands below it; every edge has a potential for the labels of parent and child, by the kind of the parent.
Sum-product messages, once up and once down the tree, give each node's exact marginal, and the text of nodes that
are more likely content than not is kept.

Both potentials are trained piecewise from labelled pages: those of a bounded sample that mark their article
themselves (`article` or `main`). Half of the training copies have their telling tags replaced by `div`, so that the
other features learn to carry pages without them. Every word of a class, id or role that a labelled page has gets a
weight of its own. A weak pull towards stated values decides only about features that no labelled page has.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field
from html import unescape
from math import exp, log

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded_texts, map_texts

# HTML's element kinds.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title iframe noscript xmp".split())
SILENT = frozenset("template object svg math canvas audio video select datalist".split())
BLOCKS = frozenset(
    "html body div article section main nav header footer aside form fieldset ul ol li dl dt dd table thead tbody tfoot tr td th caption "
    "p h1 h2 h3 h4 h5 h6 blockquote pre figure figcaption address details summary center hgroup menu dialog button legend label".split()
)
ENDS_P = BLOCKS - {"html", "body", "button", "legend", "label", "caption", "thead", "tbody", "tfoot", "tr", "td", "th", "li", "dt", "dd"} | {"hr"}
IMPLIED = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "p": {"p"}}
SCOPES = {"li": {"ul", "ol", "menu"}, "dt": {"dl"}, "dd": {"dl"}, "tr": {"table"}, "td": {"table", "tr"}, "th": {"table", "tr"}}
# What a name of class, id or role says if all its words are among these or the neutral ones.
HINTS = {
    "menu": "nav navbar navigation menu menus breadcrumb breadcrumbs crumbs pagination pager toc",
    "header": "header masthead topbar banner",
    "footer": "footer copyright colophon contentinfo",
    "side": "sidebar aside related recommended recommendations widget widgets complementary trending",
    "notice": "cookie cookies consent notice notices popup modal newsletter subscribe paywall gdpr overlay",
    "advert": "ad ads advert adverts advertisement advertising sponsor sponsored promo promotion",
    "form": "login signup signin search register",
    "comment": "comment comments commentlist discussion disqus reply replies respond response responses thread threads",
    "share": "share sharing social",
    "main": "article story post entry main content",
}
NEUTRAL = frozenset("site page box wrap wrapper list block area section container inner outer top bottom left right global bar item unit slot group panel row col links body user reader".split())
_HINT = {w: k for k, ws in HINTS.items() for w in ws.split()}
# Stated log-odds of content; training starts from them and is weakly pulled towards them.
PRIOR = {
    "tag:nav": -4.0, "tag:footer": -4.0, "tag:aside": -4.0, "tag:form": -4.0, "tag:header": -3.0, "tag:menu": -4.0, "tag:dialog": -4.0, "tag:button": -4.0,
    "tag:fieldset": -3.0, "tag:label": -4.0, "tag:address": -1.0, "tag:legend": -3.0, "tag:article": 3.0, "tag:main": 2.0, "tag:p": 1.0, "tag:h1": 1.0, "tag:h2": 0.5, "tag:h3": 0.5,
    "tag:blockquote": 1.0, "tag:pre": 1.0, "in:header": 1.0, "in:footer": -3.0, "hint:menu": -4.0, "hint:header": -3.0, "hint:footer": -4.0, "hint:side": -4.0,
    "hint:notice": -4.0, "hint:advert": -5.0, "hint:form": -4.0, "hint:comment": -5.0, "hint:share": -4.0, "hint:main": 1.5, "hidden": -5.0,
    "links:2": -1.0, "links:3": -2.0, "len:4": 1.0, "len:3": 0.5, "linky": -1.0, "copy": -1.0, "away": -2.0, "below": -9.0,
}
TELLING = frozenset("article main nav footer aside header".split())
#: What these hold is as far from content as they are, however it looks.
AWAY_TAGS = frozenset("nav footer aside header menu dialog button legend label".split())
AWAY_HINTS = ("comment", "advert", "menu", "footer", "side", "share", "form", "notice")
#: What has less log-odds by its own features, or begins what is far from content, says nothing against the article that holds it.
APART_FROM = -2.0
#: Kinds of parents for the edge potentials.
PAGE, BOX, TEXT = range(3)
# Stated shares of a child's labels (away, content) below a parent away and below one with content, by kind.
EDGES = [[[0.5, 0.5], [0.5, 0.5]], [[0.95, 0.05], [0.12, 0.88]], [[0.97, 0.03], [0.03, 0.97]]]
_APART = [[log(0.5), log(0.5)], [log(0.5), log(0.5)]]

_NAME = re.compile(r"[a-zA-Z][^\s/>]*")
_ATTR = re.compile(r"[\s/]*(=?[^\s/>=]*)(\s*=\s*)?")
_BARE = re.compile(r"[^\s>]*")
_ENDS = {t: re.compile(rf"</{t}(?=[\s/>])[^>]*>", re.I) for t in RAW}
_WORD = re.compile(r"[A-Z]?[a-z]+|[A-Z]+|\d+")
_DISPLAY_NONE = re.compile(r"display\s*:\s*none", re.I)
_LONG_REF = re.compile(r"&#(?:[xX]([0-9a-fA-F]{9,})|([0-9]{9,}));?")


def decoded(raw: str) -> str:
    """raw with its character references decoded; numbers of any length are read."""
    if "&#" in raw:
        raw = _LONG_REF.sub(lambda m: f"&#{'x' * bool(m[1])}{(m[1] or m[2]).lstrip('0')[:8] or '0'};", raw)
    return unescape(raw) if "&" in raw else raw


@dataclass
class Tree:
    """Block elements in page order (parents first), and the text segments between their edges."""

    tag: list[str] = field(default_factory=lambda: ["html"])
    parent: list[int] = field(default_factory=lambda: [-1])
    said: list[tuple[str, ...]] = field(default_factory=lambda: [()])  # names of class, id and role
    hidden: list[bool] = field(default_factory=lambda: [False])
    chars: list[int] = field(default_factory=lambda: [0])
    linked: list[int] = field(default_factory=lambda: [0])
    stops: list[int] = field(default_factory=lambda: [0])
    copy: list[bool] = field(default_factory=lambda: [False])
    segments: list[tuple[int, str]] = field(default_factory=list)


class _Attributes:
    """Reads tags at given places. What has been found to be missing is not searched for again, so a page takes linear time."""

    def __init__(self, html: str):
        self.html, self.missing = html, set()

    def read(self, at: int) -> tuple[dict[str, str], bool, int]:
        """(attributes, whether the tag closes itself, place after the tag or -1 if it is cut off) from after the name."""
        html, out, end = self.html, {}, len(self.html)
        while at < end:
            m = _ATTR.match(html, at)
            name, at = m[1].lower(), m.end()
            value = ""
            if m[2] and at < end:
                quote = html[at]
                if quote in "\"'":
                    shut = -1 if quote in self.missing else html.find(quote, at + 1)
                    if shut < 0:  # never closed: the value ends with the tag
                        self.missing.add(quote)
                        shut = html.find(">", at + 1)
                        if shut < 0:
                            return out, False, -1
                        value, at = html[at + 1 : shut], shut
                    else:
                        value, at = html[at + 1 : shut], shut + 1
                else:
                    m = _BARE.match(html, at)
                    value, at = m[0], m.end()
            if name:
                out.setdefault(name, value)
            if at < end and html[at] == ">":
                return out, html[at - 1] == "/" and not value, at + 1
        return out, False, -1


def parse(html: str | None) -> Tree:
    """The block tree of a whole page, in linear time. Unclosed, misnested and cut-off markup is read as browsers mostly do."""
    t = Tree()
    if not html:
        return t
    names, owner = ["html"], [0]  # open elements and the block each belongs to
    at_of: dict[str, list[int]] = {}  # where each name stands open, and where blocks do
    block_at = [0]
    words: list[str] = []
    links = silent = 0
    reader = _Attributes(html)

    def flush() -> None:
        if words:
            text = " ".join("".join(words).split())
            words.clear()
            if text:
                t.segments.append((owner[-1], text))

    def say(raw: str) -> None:
        if raw and not silent:
            text = decoded(raw)
            words.append(text)
            n = len(text.strip())
            if n:
                b = owner[-1]
                t.chars[b] += n
                t.stops[b] += text.count(".") + text.count(",")
                t.copy[b] |= "©" in text
                if links:
                    t.linked[b] += n

    def close_to(i: int) -> None:
        nonlocal links, silent
        if block_at[-1] >= i:
            flush()
        while len(names) > i:
            name = names.pop()
            owner.pop()
            at_of[name].pop()
            if block_at[-1] == len(names):
                block_at.pop()
            links -= name == "a"
            silent -= name in SILENT

    def last(name: str) -> int:
        found = at_of.get(name)
        return found[-1] if found else -1

    def open_as(name: str) -> None:
        at_of.setdefault(name, []).append(len(names))
        names.append(name)

    at, end = 0, len(html)
    while at < end:
        tag = html.find("<", at)
        if tag < 0:
            say(html[at:])
            break
        say(html[at:tag])
        closing = html.startswith("</", tag)
        m = _NAME.match(html, tag + 1 + closing)
        if not m:
            mark = html[tag + 1 : tag + 2]
            if not (closing or mark in ("!", "?")) or not mark:
                say("<")
                at = tag + 1
                continue
            if html.startswith("<!--", tag):
                shut = tag + 1 if html.startswith("<!-->", tag) else html.find("-->", tag + 4)
                at = end if shut < 0 else html.find(">", shut) + 1
                continue
            if html.startswith("<![CDATA[", tag) and "]]>" not in reader.missing:
                shut = html.find("]]>", tag)
                if shut >= 0:
                    say(html[tag + 9 : shut].replace("&", "&amp;"))
                    at = shut + 3
                    continue
                reader.missing.add("]]>")
            shut = html.find(">", tag)
            at = end if shut < 0 else shut + 1
            continue
        name = m[0].lower()
        attrs, shut_itself, at = reader.read(m.end())
        if at < 0:
            break  # the page is cut off inside a tag
        if closing:
            if name == "br":
                words.append(" ")
            i = last(name)
            if i > 0 and (name in BLOCKS or block_at[-1] < i):  # an inline end tag closes nothing beyond its block
                close_to(i)
            elif name == "p":
                flush()
            continue
        if name in RAW:
            m = _ENDS[name].search(html, at) if name not in reader.missing else None
            if m:
                at = m.end()
            else:
                reader.missing.add(name)
                if name in ("script", "style"):
                    break  # the rest of the page is in it
            continue
        if name in VOID or name in SILENT and shut_itself:
            if name == "br":
                words.append(" ")
            elif name == "hr":
                flush()
            continue
        if name in ENDS_P and names[block_at[-1]] == "p":
            close_to(block_at[-1])
        if name in SCOPES:
            i, edge = max(map(last, IMPLIED[name])), max(map(last, SCOPES[name]))
            while i > edge and i > 0:
                close_to(i)
                i = max(map(last, IMPLIED[name]))
        if name in ("html", "head") or name == "body" and len(names) > 1:
            continue
        if name in BLOCKS:
            for drawing in ("svg", "math"):
                if last(drawing) > 0:  # a block ends a drawing
                    close_to(last(drawing))
            flush()
            t.tag.append(name)
            t.parent.append(owner[-1])
            t.said.append(tuple(f"{attrs.get('class', '')} {attrs.get('id', '')} {attrs.get('role', '')}".split()) if attrs else ())
            t.hidden.append(bool(attrs) and ("hidden" in attrs or bool(_DISPLAY_NONE.search(attrs.get("style", "")))))
            for x in (t.chars, t.linked, t.stops):
                x.append(0)
            t.copy.append(False)
            owner.append(len(t.tag) - 1)
            block_at.append(len(names))
        else:
            links += name == "a"
            silent += name in SILENT
            owner.append(owner[-1])
        open_as(name)
    flush()
    return t


def hints(names: tuple[str, ...]) -> set[str]:
    """What the names say as wholes: `site-footer` says footer, `promo-free` and `comment-style` say nothing."""
    found = set()
    for name in names:
        words = [w.lower() for w in _WORD.findall(name)]
        kinds = {_HINT[w] for w in words if w in _HINT}
        if kinds and all(w in _HINT or w in NEUTRAL or w.isdigit() for w in words) and kinds != {"main", "header"}:
            found |= kinds - {"main"} or kinds
    return found


def features(t: Tree, masked: bool = False) -> list[list[str]]:
    """Of every node. masked: as if the page had `div` for its telling tags."""
    n = len(t.tag)
    tags = ["div" if masked and x in TELLING else x for x in t.tag]
    chars, linked, titled, paragraphs = t.chars.copy(), t.linked.copy(), [x == "h1" for x in tags], [0] * n
    for i in range(n - 1, 0, -1):
        p = t.parent[i]
        chars[p] += chars[i]
        linked[p] += linked[i]
        titled[p] |= titled[i]
        paragraphs[p] += tags[i] == "p"
    inside = [False] * n  # of an article
    away: list[str] = [""] * n  # what a node or one above it says against all that it holds
    out = []
    for i in range(n):
        tag, own, p = tags[i], t.chars[i], t.parent[i]
        said = hints(t.said[i]) if t.said[i] else set()
        if tag in ("article", "main"):
            said &= {"comment", "main"}  # what an article is about, of whatever name, says nothing against it
        inside[i] = i > 0 and (inside[p] or tags[p] in ("article", "main"))
        away[i] = away[p] if i else ""
        listed = inside[i] and tag in ("ol", "ul", "li")  # an article's own list, whose entries may be links
        f = ["in:" + tag if inside[i] and tag in ("header", "footer") or listed else "tag:" + tag]
        if away[i] == "notice" and tag in ("article", "main"):
            away[i] = ""  # a notice laid over a page may hold all of it
        if away[i]:
            f.append("below")
        elif kind(tag) != PAGE:
            small_form = tag == "form" and 2 * chars[i] < chars[0]  # some pages are one form
            by_tag = tag in AWAY_TAGS and f[0] != "in:header" or small_form
            if inside[i] and not linked[i]:
                said -= {"side"}  # what an article relates, without a link, is its own
            away[i] = next((h for h in AWAY_HINTS if h in said), "") or tag * by_tag or "hidden" * t.hidden[i]
            if away[i]:
                f.append("away")
        if t.said[i]:
            f += ["hint:" + h for h in sorted(said)]
            f += ["word:" + w for w in sorted({w.lower() for name in t.said[i] for w in _WORD.findall(name)})]
        if t.hidden[i]:
            f.append("hidden")
        f.append(f"len:{(own > 0) + (own >= 25) + (own >= 80) + (own >= 200)}")
        if own:
            share, stops = t.linked[i] / own, t.stops[i] / own
            f.append(f"{'in-' * listed}links:{(share > 0) + (share > 0.3) + (share > 0.7)}")
            f.append(f"stops:{(stops > 0) + (stops > 0.01)}")
        if t.copy[i]:
            f.append("copy")
        if chars[i] and linked[i] > 0.5 * chars[i] and not listed:
            f.append("linky")
        if kind(tag) == BOX:
            f.append(f"paragraphs:{(paragraphs[i] > 0) + (paragraphs[i] > 2)}")
            if own:
                f.append("loose")  # text of its own beside its blocks
            if titled[i]:
                f.append("titled")
        out.append(f)
    return out


def kind(tag: str) -> int:
    if tag in ("html", "body"):
        return PAGE
    return BOX if tag in ("div", "section", "center", "form", "fieldset", "dialog", "details") or tag in TELLING else TEXT


@dataclass
class PageModel:
    weights: dict[str, float] = field(default_factory=lambda: dict(PRIOR))
    bias: float = 0.0
    #: Log potentials [kind of parent][label of parent][label of child].
    edges: list = field(default_factory=lambda: [[[log(x) for x in row] for row in k] for k in EDGES])

    def own(self, t: Tree, masked: bool = False) -> tuple[list[float], list[bool]]:
        """Of every node: log-odds by its own features, and whether its edge to its parent says nothing."""
        w, found = self.weights, features(t, masked)
        own = [self.bias + sum(w.get(x, 0.0) for x in f) for f in found]
        return own, [o < APART_FROM or "away" in f for o, f in zip(own, found)]

    def marginals(self, t: Tree, masked: bool = False) -> list[float]:
        """Of content, for every node: messages to the root, then from it."""
        n, (own, apart) = len(t.tag), self.own(t, masked)
        edge = [_APART if apart[i] else self.edges[kind(t.tag[t.parent[i]])] for i in range(n)]
        up = [0.0] * n  # log-odds that children's messages add
        sent = [0.0] * n
        for i in range(n - 1, 0, -1):
            e, odds = edge[i], own[i] + up[i]
            sent[i] = _logadd(e[1][0], e[1][1] + odds) - _logadd(e[0][0], e[0][1] + odds)
            up[t.parent[i]] += sent[i]
        down = [0.0] * n
        for i in range(1, n):
            p = t.parent[i]
            e, odds = edge[i], own[p] + up[p] + down[p] - sent[i]
            down[i] = _logadd(e[0][1], e[1][1] + odds) - _logadd(e[0][0], e[1][0] + odds)
        return [1 / (1 + exp(-max(-50.0, min(50.0, own[i] + up[i] + down[i])))) for i in range(n)]

    def extract(self, html: str | None, masked: bool = False) -> str:
        t = parse(html)
        p = self.marginals(t, masked)
        return "\n\n".join(text for i, text in t.segments if p[i] >= 0.5)


def _logadd(a: float, b: float) -> float:
    return max(a, b) + log(1 + exp(-abs(a - b)))


def labels(t: Tree) -> list[int | None] | None:
    """1 in the page's article, 0 outside it and in what it sets apart; None: what holds both. None if none is marked."""
    for name in ("article", "main"):
        roots = [i for i, tag in enumerate(t.tag) if tag == name]
        if roots:
            break
    else:
        return None
    out: list[int | None] = [0] * len(t.tag)
    for r in roots:
        out[r] = 1
        p = t.parent[r]
        while p >= 0 and out[p] is not None:
            out[p] = None
            p = t.parent[p]
    for i in range(1, len(t.tag)):
        if out[t.parent[i]] == 1:
            apart = t.tag[i] in ("nav", "footer", "aside", "form", "dialog", "button", "legend", "label", "menu") or hints(t.said[i]) - {"main", "header"}
            out[i] = 0 if apart else 1
    return out


def fit(pages: list[str], rounds: int = 300, pull: float = 0.5, strength: float = 20.0, seed: int = 3) -> PageModel:
    """Train node potentials by logistic regression, weakly pulled towards PRIOR, and edge potentials from label counts.

    strength: the stated shares of EDGES count as so many edges.
    """
    model, rng = PageModel(), np.random.default_rng(seed)
    rows, ys, seen = [], [], []
    for html in pages:
        t = parse(html)
        y = labels(t)
        if y is None:
            continue
        masked = bool(rng.random() < 0.5)
        for f, label in zip(features(t, masked), y):
            if label is not None:
                rows.append(f)
                ys.append(label)
        seen.append((t, masked, y))
    if not rows or len(set(ys)) < 2:
        return model
    names = sorted({f for r in rows for f in r} | PRIOR.keys())
    at = {f: i for i, f in enumerate(names)}
    index = np.array([at[f] for r in rows for f in r])
    owner = np.repeat(np.arange(len(rows)), [len(r) for r in rows])
    y = np.array(ys, float)
    prior = np.array([PRIOR.get(f, 0.0) for f in names])
    w, b = prior.copy(), 0.0
    gsq, gb = np.full(len(names), 1e-6), 1e-6
    for _ in range(rounds):
        z = np.bincount(owner, weights=w[index], minlength=len(rows)) + b
        g = 1 / (1 + np.exp(-np.clip(z, -30, 30))) - y
        gw = np.bincount(index, weights=g[owner], minlength=len(names)) + pull * (w - prior)
        gsq += gw * gw
        gb += g.sum() ** 2
        w -= 0.3 * gw / np.sqrt(gsq)
        b -= 0.3 * g.sum() / np.sqrt(gb)
    model.weights, model.bias = dict(zip(names, w.tolist())), float(b)
    counts = np.array(EDGES) * strength
    for t, masked, y in seen:
        _, apart = model.own(t, masked)
        for i in range(1, len(t.tag)):
            p = t.parent[i]
            if y[i] is not None and y[p] is not None and not apart[i]:
                counts[kind(t.tag[p]), y[p], y[i]] += 1
    shares = np.maximum(counts / counts.sum(2, keepdims=True), 0.02)
    shares /= shares.sum(2, keepdims=True)
    model.edges = [EDGES[PAGE], *shares[1:].tolist()]
    model.edges = [[[log(x) for x in row] for row in k] for k in model.edges]
    return model


def extract_text(pages: DataFrame, fit_pages: int = 400, fit_chars: int = 200_000, id_col: str = "page_id", html_col: str = "html") -> DataFrame:
    """pages without html and with text (empty if there is none) and n_chars: one row per row of pages.

    Whole pages are read; a null page gives an empty text. All other columns are kept (columns named text or
    n_chars are replaced); repeated rows get the same text, rows with a null id theirs; an empty table gives an empty
    result. The model learns
    from about fit_pages pages at most (a bounded sample, by the hash of their id) of at most fit_chars characters;
    pages that mark no article teach nothing, and without any that does the stated weights are used.
    """
    rows = pages.select(F.col(id_col).alias("page_id"), F.col(html_col).alias("html"))
    known = bounded_texts(rows, "page_id", "html", fit_pages, fit_chars).toPandas().sort_values("page_id", kind="stable")
    shared = pages.sparkSession.sparkContext.broadcast(fit(known["html"].tolist()))
    others = [f for f in pages.schema if f.name not in (html_col, "text", "n_chars")]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            texts = [shared.value.extract(h) for h in b[html_col]]
            yield b.drop(columns=[html_col]).assign(text=texts, n_chars=[len(x) for x in texts])

    slim = pages.select(*[F.col(f"`{f.name}`") for f in others], F.col(f"`{html_col}`"))
    schema = "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in others)
    return map_texts(slim, "html", run, f"{schema}text string, n_chars long")
