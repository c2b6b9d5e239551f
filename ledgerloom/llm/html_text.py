"""Main text of web pages by a tree-structured graphical model over their nodes."""

from __future__ import annotations

import random
import re
from collections import Counter
from html import escape
from html.parser import HTMLParser

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCKS = frozenset(
    "address article aside blockquote body dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header "
    "hgroup hr html legend li main menu nav ol optgroup option p pre section select summary table tbody td textarea tfoot th thead title tr ul".split()
)
#: Elements whose text is never shown.
HIDDEN = frozenset("script style noscript template head title meta link iframe object svg math canvas audio video".split())
#: Elements that end an open paragraph.
_ENDS_P = BLOCKS - frozenset("option optgroup td th tr tbody thead tfoot".split())
#: States of a node: boilerplate, content, or an element that holds both.
STATES = 3
#: Labelled pages that the model is trained on.
PAGES = 400
#: Nodes of pages that are handled together, about.
NODES = 8192


class Node:
    __slots__ = ("tag", "attrs", "parent", "text", "kids", "label")

    def __init__(self, tag: str, attrs: str = "", parent: int = -1, text: str = "", label: int | None = None):
        self.tag, self.attrs, self.parent, self.text, self.kids, self.label = tag, attrs, parent, text, 0, label


class _Tree(HTMLParser):
    """Nodes in page order; parents come before children. Unclosed and stray tags are tolerated."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.nodes = [Node("#root")]
        self.open = [0]

    def _label(self, attrs: list) -> int | None:
        return next((int(v) for k, v in attrs if k == "data-truth"), None)

    def handle_starttag(self, tag, attrs):
        if tag in _ENDS_P:
            self._close("p", ("table", "button"))
        if tag == "li":
            self._close("li", ("ul", "ol", "menu"))
        elif tag in ("dd", "dt"):
            self._close("dd", ("dl",))
            self._close("dt", ("dl",))
        elif tag in ("td", "th", "tr"):
            for t in ("td", "th") + (("tr",) if tag == "tr" else ()):
                self._close(t, ("table",))
        elif tag == "option":
            self._close("option", ("select",))
        words = " ".join(v for k, v in attrs if v and k in ("class", "id", "role", "itemprop", "aria-label"))
        self.nodes.append(Node(tag, words.lower(), self.open[-1], label=self._label(attrs)))
        if tag not in VOID:
            self.open.append(len(self.nodes) - 1)

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs)
        if tag not in VOID and tag in ("svg", "path", "g", "circle", "use"):
            self.open.pop()

    def handle_endtag(self, tag):
        if tag in VOID:
            return
        self._close(tag, ())

    def _close(self, tag, stop):
        for i in range(len(self.open) - 1, 0, -1):
            t = self.nodes[self.open[i]].tag
            if t == tag:
                del self.open[i:]
                return
            if t in stop:
                return

    def handle_data(self, data):
        self.nodes.append(Node("#text", parent=self.open[-1], text=data))


def parse(html: str) -> list[Node]:
    """The nodes of a page; markup declarations that cannot be read count as text."""
    for source in (html, html.replace("<!", "&lt;!")):
        tree = _Tree()
        try:
            tree.feed(source)
            tree.close()
            return tree.nodes
        except AssertionError:
            continue
    return [Node("#root"), Node("#text", parent=0, text=re.sub(r"<[^>]*>", " ", html))]


def _bucket(n: int) -> int:
    return min(9, n.bit_length())


def features(nodes: list[Node]) -> list[list[str]]:
    """Features of every node: its tag, words of its attributes, length, links and place."""
    n = len(nodes)
    size, linked, paragraphs, marks, words = [0] * n, [0] * n, [0] * n, [0] * n, [0] * n
    in_link, hidden = [False] * n, [False] * n
    for i, x in enumerate(nodes):
        if x.parent >= 0:
            in_link[i] = in_link[x.parent] or x.tag == "a"
            hidden[i] = hidden[x.parent] or x.tag in HIDDEN
        if x.tag == "#text" and not hidden[i]:
            t = x.text.strip()
            size[i] = len(t)
            linked[i] = len(t) if in_link[i] else 0
            marks[i] = sum(t.count(c) for c in ".,;!?")
            words[i] = t.count(" ") + bool(t)
        elif x.tag == "p":
            paragraphs[i] = 1
    for i in range(n - 1, 0, -1):
        p = nodes[i].parent
        for v in (size, linked, paragraphs, marks, words):
            v[p] += v[i]
    whole = max(1, size[0])
    out, before = [], 0
    for i, x in enumerate(nodes):
        f = [f"tag:{x.tag}", f"size:{_bucket(size[i])}", f"link:{round(4 * linked[i] / size[i]) if size[i] else 'none'}", f"share:{min(4, int(5 * size[i] / whole))}"]
        f += [f"at:{min(4, int(5 * before / whole))}", f"p:{min(3, paragraphs[i])}", f"marks:{min(4, int(40 * marks[i] / size[i])) if size[i] else 'none'}"]
        if words[i]:
            f.append(f"word:{_bucket(words[i])}")
        if x.tag == "#text":
            before += size[i]
            f.append(f"in:{nodes[x.parent].tag}")
        for w in set(re.findall(r"[a-z]+", x.attrs)):
            f += [f"attr:{w}", f"stem:{w[:4]}"]
        if hidden[i]:
            f.append("hidden")
        out.append(f)
    return out


def _lse(x: np.ndarray, axis: int) -> np.ndarray:
    top = x.max(axis=axis, keepdims=True)
    return (np.log(np.exp(x - top).sum(axis=axis, keepdims=True)) + top).squeeze(axis)


class Model:
    """Weights of node features and log potentials of parents with children.

    Both are fitted to the likelihood of whole labelled trees: the gradient is what exact marginals
    expect less what the labels say, so that nodes that say the same aren't counted twice.
    """

    def __init__(self, pages: list[str], steps: int = 200):
        data, y, parent, depth = [], [], [], []
        for html in pages:
            nodes, at = parse(html), len(y)
            y += truth(nodes)
            data += features(nodes)
            for x in nodes:
                parent.append(at + x.parent if x.parent >= 0 else -1)
                depth.append(depth[parent[-1]] + 1 if x.parent >= 0 else 0)
        counts = Counter(w for f in data for w in f)
        names = {w: k for k, w in enumerate(sorted(w for w, c in counts.items() if c >= 5))}
        y, parent, depth = np.array(y), np.array(parent), np.array(depth)
        row = np.array([r for r, f in enumerate(data) for w in f if w in names])
        col = np.array([names[w] for f in data for w in f if w in names])
        levels = [np.flatnonzero(depth == d) for d in range(1, depth.max() + 1)]
        kids = np.flatnonzero(parent >= 0)
        w = np.zeros((len(names) + STATES, STATES))  # the last rows are the edges
        mean, square = np.zeros_like(w), np.zeros_like(w)
        for step in range(1, steps + 1):
            unary, edge = np.stack([np.bincount(row, weights=w[col, s], minlength=len(y)) for s in range(STATES)], axis=1), w[-STATES:]
            up, message = unary.copy(), np.zeros_like(unary)
            for at in reversed(levels):
                message[at] = _lse(edge + up[at][:, None, :], 2)
                np.add.at(up, parent[at], message[at])
            belief = up - _lse(up, 1)[:, None]
            for at in levels:
                belief[at] = up[at] + _lse((belief[parent[at]] - message[at])[:, :, None] + edge, 1)
                belief[at] -= _lse(belief[at], 1)[:, None]
            both = (belief[parent[kids]] - message[kids])[:, :, None] + edge + up[kids][:, None, :]
            both = np.exp(both - _lse(both.reshape(len(kids), -1), 1)[:, None, None]).sum(axis=0)
            np.subtract.at(both, (y[parent[kids]], y[kids]), 1)
            wrong = np.exp(belief) - np.eye(STATES)[y]
            g = np.stack([np.bincount(col, weights=wrong[row, s], minlength=len(names)) for s in range(STATES)], axis=1)
            g = np.concatenate([g, both]) / len(pages) + 1e-3 * w
            mean, square = 0.9 * mean + 0.1 * g, 0.99 * square + 0.01 * g * g
            w -= 0.1 * (mean / (1 - 0.9**step)) / (np.sqrt(square / (1 - 0.99**step)) + 1e-8)
        self.names, self.matrix, self.log_edge = names, w[:-STATES], w[-STATES:]

    def marginals(self, pages: list[list[Node]]) -> list[np.ndarray]:
        """Exact marginals of the nodes of each page: messages from the leaves up, then from the root down, level by level of all pages."""
        cols, counts, parent, depth, starts = [], [], [], [], []
        for nodes in pages:
            at = len(parent)
            starts.append(at)
            for f in features(nodes):
                own = [self.names[w] for w in f if w in self.names]
                cols += own
                counts.append(len(own))
            for x in nodes:
                parent.append(at + x.parent if x.parent >= 0 else -1)
                depth.append(depth[parent[-1]] + 1 if x.parent >= 0 else 0)
        n, parent, depth = len(parent), np.array(parent), np.array(depth)
        row = np.repeat(np.arange(n), counts)
        unary = np.stack([np.bincount(row, weights=self.matrix[cols, s], minlength=n) for s in range(STATES)], axis=1) if cols else np.zeros((n, STATES))
        order = np.argsort(depth, kind="stable")
        levels = np.split(order, np.flatnonzero(np.diff(depth[order])) + 1)
        edge, up, message = self.log_edge, unary, np.zeros((n, STATES))
        for at in reversed(levels[1:]):
            message[at] = _lse(edge + up[at][:, None, :], 2)
            np.add.at(up, parent[at], message[at])
        belief = up - _lse(up, 1)[:, None]
        for at in levels[1:]:
            b = up[at] + _lse((belief[parent[at]] - message[at])[:, :, None] + edge, 1)
            belief[at] = b - _lse(b, 1)[:, None]
        return np.split(np.exp(belief), starts[1:])

    def extract(self, pages: list[str | None]) -> list[str]:
        """The main text of each page; pages are handled together in runs of about NODES nodes."""
        out = [""] * len(pages)
        held: list[tuple[int, list[Node]]] = []

        def settle():
            for (at, nodes), chance in zip(held, self.marginals([x for _, x in held]), strict=True):
                out[at] = text_of(nodes, chance[:, 1])
            held.clear()

        size = 0
        for at, html in enumerate(pages):
            if html:
                held.append((at, parse(html)))
                size += len(held[-1][1])
            if size >= NODES:
                settle()
                size = 0
        if held:
            settle()
        return out


def text_of(nodes: list[Node], chance: np.ndarray) -> str:
    """Blocks of the text nodes that are likelier content than not, one to a line."""
    hidden = [False] * len(nodes)
    blocks: list[list[str]] = [[]]
    owner = [0] * len(nodes)  # the nearest block element
    last = 0
    for i, (x, c) in enumerate(zip(nodes, chance.tolist(), strict=True)):
        if i:
            hidden[i] = hidden[x.parent] or x.tag in HIDDEN
            owner[i] = i if x.tag in BLOCKS else owner[x.parent]
        if owner[i] != last:
            blocks.append([])
            last = owner[i]
        if x.tag == "#text":
            if c >= 0.5 and not hidden[i]:
                blocks[-1].append(x.text)
        elif x.tag == "br":
            blocks[-1].append(" ")
    lines = (" ".join("".join(b).split()) for b in blocks)
    return "\n".join(x for x in lines if x)


def truth(nodes: list[Node]) -> list[int]:
    """Labels of a training page: a node has its nearest label, and an element with both kinds below is mixed."""
    own = [0] * len(nodes)
    seen: list[set[int]] = [set() for _ in nodes]
    for i, x in enumerate(nodes):
        own[i] = x.label if x.label is not None else own[x.parent] if i else 0
    for i in range(len(nodes) - 1, 0, -1):
        if nodes[i].tag == "#text" and nodes[i].text.strip():
            seen[i] = {own[i]}
        seen[nodes[i].parent] |= seen[i]
    return [2 if len(s) == 2 else next(iter(s)) if s else o for s, o in zip(seen, own, strict=True)]


def labelled_pages(n: int = PAGES, seed: int = 7) -> list[str]:
    """Pages of many layouts with the truth in data-truth attributes: 1 article, 0 the rest."""
    r = random.Random(seed)
    syllables = [a + b for a in ["", *"bcdfghklmnprstvwz", "th", "sch", "qu", "ñ", "é"] for b in ["a", "e", "i", "o", "u", "en", "er", "ie", "é", "ü", "ción"]]
    word = lambda: "".join(r.choices(syllables, k=r.randint(1, 4)))

    def sentence(lo=2, hi=18):
        return " ".join(word() for _ in range(r.randint(lo, hi))).capitalize() + r.choice(". . . ? !".split())

    def prose(lo=1, hi=7):
        out = []
        for _ in range(r.randint(lo, hi)):
            s = escape(sentence())
            if r.random() < 0.15:
                a = r.choice(["b", "i", "em", "strong", "code", "span", "a"])
                s += f" <{a}{' href=/x' if a == 'a' else ''}>{escape(sentence(1, 4))}</{a}>"
            out.append(s)
        return r.choice([" ", " ", "\n", "<br>"]).join(out)

    def links(k):
        return "".join(f'<li><a href="/{word()}">{word().capitalize()}</a></li>' for _ in range(k))

    def named(names, tags="div section"):
        c = r.choice(names.split())
        return r.choice(tags.split()), r.choice([f'class="{c}"', f'id="{c}"', f'class="{c} {word()}"', f'class="{c}-{word()}"'])

    def junk(kind):
        if kind == "nav":
            body = r.choice([f"<ul>{links(r.randint(2, 9))}</ul>", "".join(f'<a href="/{word()}">{word()}</a> ' for _ in range(r.randint(2, 8)))])
            t, a = r.choice([("nav", ""), ("nav", ""), named("nav menu navbar navigation topnav breadcrumb breadcrumbs pagination toc", "div ul nav")])
            return f"<{t} {a} data-truth=0>{links(4) if t == 'ul' else body}</{t}>"
        if kind == "header":
            t, a = r.choice([("header", ""), named("header masthead banner top site logo", "div header")])
            return f"<{t} {a} data-truth=0><a href=/>{word()}</a> <p>{sentence(1, 5)}</p>{junk('nav') if r.random() < 0.5 else ''}</{t}>"
        if kind == "footer":
            t, a = r.choice([("footer", ""), ("footer", ""), named("footer bottom copyright legal colophon", "div footer")])
            return f"<{t} {a} data-truth=0>&copy; {r.randint(1999, 2030)} {word()}.example.com &middot; {prose(1, 3)}</{t}>"
        if kind == "ad":
            t, a = named("ad ads advert advertisement sponsor sponsored promo promotion banner adsbygoogle", "div ins aside section")
            return f"<{t} {a} data-truth=0>{r.choice([prose(1, 3), '<p>' + prose(1, 2) + '</p>'])}</{t}>"
        if kind == "notice":
            t, a = named("cookie cookies consent notice notification alert warning newsletter subscribe popup modal gdpr paywall", "div section aside p")
            return f"<{t} {a} data-truth=0>{prose(1, 3)} <button>OK</button></{t}>"
        if kind == "side":
            t, a = r.choice([("aside", ""), named("sidebar side widget related recommended popular trending share social tags author recent more", "div aside section")])
            return f"<{t} {a} data-truth=0><h3>{sentence(1, 4)}</h3>{r.choice(['<ul>' + links(5) + '</ul>', '<p>' + prose(1, 2) + '</p>'])}</{t}>"
        if kind == "form":
            return f"<form {r.choice(['', 'class=search', 'class=login', 'id=contact'])} data-truth=0><label>{sentence(1, 3)}</label><input name=q><select><option>{word()}<option>{word()}</select><textarea>{sentence()}</textarea><button>{word()}</button></form>"
        if kind == "hidden":
            return r.choice([f"<script data-truth=0>var {word()} = '<p>{word()}</p>';</script>", "<style data-truth=0>p{margin:0}</style>", f"<noscript data-truth=0>{sentence()}</noscript>", f"<!-- {sentence()} -->"])
        t, a = named("comments comment replies responses discussion disqus commentlist reviews", "div section ol")
        item = "li" if t == "ol" else r.choice(["div", "article", "p"])
        return f"<{t} {a} data-truth=0><h3>{sentence(1, 3)}</h3>" + "".join(f'<{item} class="{r.choice(["comment", "reply", "response"])}"><b>{word()}</b> {prose(1, 4)}</{item}>' for _ in range(r.randint(1, 4))) + f"</{t}>"

    def article():
        out = [f"<h1>{escape(sentence(3, 10))}</h1>"] if r.random() < 0.85 else []
        for _ in range(r.choice([1, 1, 2, 3, 4, 6, 8, 12])):
            k = r.random()
            if k < 0.72:
                out.append(f"<p>{r.choice(['', '', '<b>'])}{prose()}{r.choice(['</p>', '</p>', '<br>', ''])}")
            elif k < 0.8:
                out.append(f"<h2>{sentence(2, 7)}</h2>")
            elif k < 0.86:
                out.append("<ul>" + "".join(f"<li>{prose(1, 2)}</li>" for _ in range(r.randint(2, 5))) + "</ul>")
            elif k < 0.9:
                out.append(f"<blockquote>{prose(1, 3)}</blockquote>")
            elif k < 0.93:
                out.append("<table>" + "".join(f"<tr><td>{sentence(1, 3)}</td><td>{r.randint(1, 999)}</td></tr>" for _ in range(3)) + "</table>")
            elif k < 0.96:
                out.append(f"<figure><img src=x.png><figcaption>{sentence()}</figcaption></figure>")
            else:
                out.append(f"<pre>{sentence()}\n  {sentence()}</pre>")
            if r.random() < 0.06:
                out.append(junk(r.choice(["ad", "side", "form", "hidden", "notice"])))
        inner = "".join(out)
        t, a = r.choice([("article", ""), ("article", ""), ("main", ""), ("div", ""), named("content article post entry story main body text articlebody", "div section article main")])
        wrapped = f"<{t} {a} data-truth=1>{inner}</{t}>"
        if r.random() < 0.3:
            t, a = r.choice([("main", ""), ("div", ""), named("page wrapper container main column")])
            wrapped = f"<{t} {a} data-truth=0>{wrapped}{junk(r.choice(['side', 'comments', 'ad'])) if r.random() < 0.5 else ''}</{t}>"
        return wrapped if r.random() < 0.93 else f'<span data-truth=1>{inner}</span>'

    pages = []
    for _ in range(n):
        top = [junk(k) for k in ("notice", "header", "nav", "ad", "hidden", "form") if r.random() < 0.45]
        low = [junk(k) for k in ("side", "comments", "ad", "nav", "form", "notice", "hidden") if r.random() < 0.3]
        r.shuffle(low)
        end = [junk("footer")] if r.random() < 0.85 else []
        body = r.choice(["", "\n"]).join([*top, article(), *low, *end])
        if r.random() < 0.25:
            body = f'<div {r.choice(["", "id=page", "class=wrapper", "class=container"])}>{body}</div>'
        pages.append(f"<!DOCTYPE html><html data-truth=0><head><meta charset=utf-8><title>{sentence()}</title><style>p{{}}</style></head><body data-truth=0>{body}</body></html>")
    return pages


_MODEL: list[Model] = []


def trained() -> Model:
    """The model, trained once in each process."""
    if not _MODEL:
        _MODEL.append(Model(labelled_pages()))
    return _MODEL[0]


def main_text(html: Column, model: Model) -> Column:
    @F.arrow_udf("string")
    def extract(column: pa.Array) -> pa.Array:
        return pa.array(model.extract(column.to_pylist()), pa.string())

    return extract(html.cast("string"))


def extract(pages: DataFrame, model: Model | None = None) -> DataFrame:
    """page_id, url, text and n_chars (code points) of every row of pages.

    The text is that of the whole page's content nodes: character references decoded, white space of a
    block one space, blocks joined by a line break in page order. Null, empty and content-free pages
    give an empty text; markup that is broken is read as far as it goes. Rows are handled one by one, and
    other columns are ignored.
    """
    text = main_text(F.col("html"), model or trained())
    return pages.select("page_id", "url", text.alias("text")).select("page_id", "url", "text", F.char_length("text").cast("long").alias("n_chars"))


def op10_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(table(spark, sf_dir, "pages"))
