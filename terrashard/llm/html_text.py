"""Main text of web pages by a linear-chain conditional random field over DOM leaf blocks.

A page is cut into leaf blocks: runs of text not broken by a block-level tag, with the tags, classes and ids of their
ancestors. The field labels each block as main text or not. Its features are ancestor tags, the parent, words found in
ancestors' classes and ids, and properties of the text (length, share of links, punctuation), some in combination; its
transitions tie neighbours together. It is trained on labelled pages by gradient ascent on the likelihood (forward and
backward sums), and decoded by Viterbi. The labelled pages come from labelled_pages(), which writes pages of many layouts
with known main text; train() takes any pages in that form.

Character references are decoded, white space in a block becomes one space, and main blocks are joined by one space in
page order. Nothing is capped: a page of any length and depth is cut and decoded in time and memory in proportion to it.

Defined results: null and empty html has empty text; html without tags is one block, kept as main text; broken markup
(unclosed tags, stray ends, a lone `<`) is read as browsers roughly do; repeated rows give equal rows; an empty table
gives an empty one. extract() reads only html, keeps the other columns, and adds text and n_chars in place of any
columns of these names.
"""

from __future__ import annotations

import html
import random
import re
from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: A comment, CDATA, a declaration, or the beginning of a tag.
MARK = re.compile(r"""<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?\]\]>|<[!?][^<>]*>|<(/?)([a-zA-Z][a-zA-Z0-9:-]*)""", re.S)
#: The rest of a tag as browsers read it: a quote after an equals sign runs to its twin, whatever lies between.
ATTRIBUTES = re.compile(r"""((?:[^>=]++|=\s*+(?:"[^"]*+"|'[^']*+'|(?!["'])))*+)>""", re.S)
#: Where that finds no end: the rest up to the next `>`, if no other tag begins before it.
PLAIN_REST = re.compile(r"[^<>]*>")
#: Tags of a page that may be read to its very end in vain; so broken pages take time in proportion.
VAIN = 8
NAMED = re.compile(r"""(?:^|\s)(?:class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)
WORD = re.compile(r"[a-z]+")
#: Elements whose content has no tags and is no text of the page; unclosed, they go on to its end, as in browsers.
RAW = {"script", "style", "title", "textarea", "iframe"}
#: But of these, what is never closed, or closed by `/>`, ends at once: what follows is more likely the page's than theirs.
FRAMES = {"iframe"}
#: Elements that `/>` closes, with all inside them. Tags in them break no text, and a tag of FLOW ends them.
FOREIGN = {"svg", "math"}
FLOW = {"article", "aside", "blockquote", "body", "center", "dd", "div", "dl", "dt", "figure", "footer", "form", "h1", "h2", "h3", "h4", "h5", "h6", "header", "li", "main", "menu", "nav", "ol", "p", "pre", "section", "table", "ul"}
#: Elements that close no paragraph, though they break its text.
PHRASE = {"svg", "select", "option", "optgroup", "noscript", "object", "canvas", "template"}
#: Where HTML stands inside svg and math.
ISLANDS = {"foreignobject", "annotation-xml", "desc", "mtext"}
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
INLINE = {"a", "abbr", "acronym", "b", "bdi", "bdo", "big", "cite", "code", "data", "del", "dfn", "em", "font", "i", "img", "kbd", "label", "mark", "math", "q", "rp", "rt", "ruby", "s", "samp", "small", "span", "strike", "strong", "sub", "sup", "time", "tt", "u", "var", "wbr"}
#: An opening tag that closes an open one of these first, up to the nearest of the second set.
CLOSES = {"li": ({"li"}, {"ul", "ol", "menu"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "tr": ({"tr"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}), "option": ({"option"}, {"select"})}
#: Block-level tags close an open paragraph.
P_LIMIT = {"article", "aside", "blockquote", "body", "div", "form", "footer", "header", "li", "main", "nav", "section", "td", "th", "table"}
HINTS = {
    "ad": "ad ads adv advert advertisement advertising sponsor sponsored promo promoted banner commercial teaser",
    "notice": "cookie cookies consent gdpr notice alert popup modal overlay warning disclaimer privacy message",
    "nav": "nav navigation navbar menu menus breadcrumb breadcrumbs toc pager pagination skip toolbar tabs",
    "head": "header masthead topbar logo branding head",
    "foot": "footer foot copyright legal colophon bottom",
    "side": "sidebar aside side widget widgets rail related recommended recommendations more popular trending complementary",
    "share": "share sharing social follow tags meta byline",
    "comment": "comment comments commentlist reply replies respond discussion disqus responses thread reader",
    "form": "form search login signup subscribe newsletter register contact input",
    "main": "content article post entry story main body text page single maincontent prose",
}
HINT = {w: k for k, words in HINTS.items() for w in words.split()}
SECTIONS = ("article", "main", "section", "nav", "header", "footer", "aside", "form", "ul", "ol", "table", "figure", "blockquote", "dl", "button", "fieldset", "address", "dialog", "menu", "details", "select", "noscript", "object", "canvas", "template", "svg", "math")
ROUNDS, RATE, RIDGE, PAGES, SEED = 150, 0.1, 1e-3, 700, 23
#: Ancestors that a feature asks for.
ASKED = frozenset(SECTIONS) | {"a"}


class Path(NamedTuple):
    """What a text's ancestors are: the nearest that is no INLINE element, those of ASKED among all, and their hints. Bounded at any depth."""

    inner: str = "none"
    within: frozenset = frozenset()
    hints: frozenset = frozenset()

    def below(self, name: str, hints: frozenset) -> Path:
        within = self.within if name in self.within or name not in ASKED else self.within | {name}
        return Path(self.inner if name in INLINE else name, within, self.hints if hints <= self.hints else self.hints | hints)


class Open:
    """Open elements, and where those of a name are, so that no step walks over all of them."""

    def __init__(self):
        self.names, self.paths, self.at, self.foreign = [], [Path()], defaultdict(list), []

    def push(self, name: str, hints: frozenset) -> None:
        self.at[name].append(len(self.names))
        if name in FOREIGN or name in ISLANDS:
            self.foreign.append(len(self.names))
        self.names.append(name)
        self.paths.append(self.paths[-1].below(name, hints))

    def cut(self, k: int) -> None:
        """Close the element at k and all inside it."""
        while len(self.names) > k:
            self.at[self.names.pop()].pop()
            self.paths.pop()
        while self.foreign and self.foreign[-1] >= k:
            self.foreign.pop()

    def last(self, *names: str) -> int:
        """Where the innermost of some names is; -1 if none is open."""
        return max((self.at[n][-1] for n in names if self.at.get(n)), default=-1)

    def outside(self) -> int | None:
        """Where the svg or math is that a text stands in, if no HTML stands between."""
        return self.foreign[-1] if self.foreign and self.names[self.foreign[-1]] in FOREIGN else None


def blocks(page: str) -> list[tuple[str, Path, int]]:
    """(text, ancestors, characters within links) of each leaf block, in order. Time is in proportion to the page, however deep or broken."""
    out, parts, unclosed, tree = [], [], set(), Open()
    path, links, at = None, 0, 0  # path: the ancestors where the block's text begins

    def flush():
        nonlocal parts, path, links
        if path is not None and (text := " ".join(html.unescape("".join(parts)).split())):
            out.append((text, path, links))
        parts, path, links = [], None, 0

    vain = 0

    def found(start: int) -> tuple[re.Match | None, str, int]:
        """The next mark, the attributes of a tag, and where it ends. What begins like a tag, but has no end, is text."""
        nonlocal vain
        for m in MARK.finditer(page, start):
            if not m[2]:
                return m, "", m.end()
            rest = ATTRIBUTES.match(page, m.end()) if vain < VAIN else None
            vain += rest is None
            rest = rest or PLAIN_REST.match(page, m.end())
            if rest:
                return m, rest[0][:-1], rest.end()
        return None, "", len(page)

    while at < len(page):
        m, attributes, end = found(at)
        text = page[at : m.start()] if m else page[at:]
        if text:
            if path is None and not text.isspace():
                path = tree.paths[-1]
            parts.append(text)
            if tree.at["a"]:
                links += len(text.strip())
        if not m:
            break
        at = end
        name = (m[2] or "").lower()
        if not name:
            continue
        if name == "br":
            parts.append(" ")
            continue
        foreign = tree.outside()
        if name in FLOW and not m[1] and (foreign is not None or tree.at["select"]):
            tree.cut(tree.at["select"][0] if foreign is None else foreign)
            foreign = None
        if name not in INLINE and (foreign is None or tree.names[foreign] == "svg"):
            flush()
        if m[1]:
            if (k := tree.last(name)) >= 0:
                tree.cut(k)
            continue
        closed = attributes.endswith("/") and (foreign is not None or name not in RAW or name in FRAMES)
        if name in RAW and not closed:
            close = None if name in unclosed else re.compile(rf"</{name}\b[^>]*>", re.I).search(page, at)
            if not close and name in FRAMES:
                unclosed.add(name)
            else:
                at = close.end() if close else len(page)
            continue
        if name in VOID or closed:
            continue
        if name in CLOSES:
            same, limit = CLOSES[name]
        else:
            same, limit = ({"p"}, P_LIMIT) if name not in INLINE and name not in PHRASE and foreign is None else ((), ())
        if same and (k := tree.last(*same)) > tree.last(*limit):
            tree.cut(k)
        named = " ".join(x or y or z for x, y, z in NAMED.findall(attributes)).lower() if "=" in attributes else ""
        tree.push(name, frozenset(HINT[w] for w in WORD.findall(named) if w in HINT) if named else frozenset())
    flush()
    return out


def traits(block: tuple, place: float) -> list[str]:
    """Names of a block's features."""
    text, (inner, within, hints), links = block
    n = len(text)
    size = "1" if n < 15 else "2" if n < 40 else "3" if n < 90 else "4" if n < 250 else "5"
    share = links / n
    dense = "0" if share == 0 else "1" if share < 0.3 else "2" if share < 0.8 else "3"
    bad = hints - {"main"} or within & {"nav", "footer", "aside", "form", "header", "button", "dialog", "menu", "select", "template", "svg"}
    good = "main" in hints or within & {"article", "main"}
    kind = ("good" if good else "open") + ("bad" if bad else "")
    found = [f"in {t}" for t in SECTIONS if t in within] + [f"hint {h}" for h in hints]
    found += [f"parent {inner}", f"size {size}", f"links {dense}", f"kind {kind}", f"kind {kind} links {dense}", f"kind {kind} size {size}", f"parent {inner} kind {kind}"]
    found.append("ends" if text[-1] in ".!?…:;。！？\"»”)" else "open end")
    if "©" in text or "All rights" in text:
        found.append("copyright")
    if any(c in text for c in "|·»›"):
        found.append("separators")
    found.append("early" if place < 0.15 else "late" if place > 0.85 else "middle")
    if good and inner in ("h1", "h2", "h3", "h4", "h5", "h6") and not bad:
        found.append("good heading")
    return found


@dataclass
class Field:
    """index: feature to row of weights (features x 2); turn[i, j]: from label i to j. Label 1 is main text."""

    index: dict[str, int]
    weights: np.ndarray
    turn: np.ndarray


def scores(field: Field, cut: list) -> np.ndarray:
    n = max(1, len(cut) - 1)
    out = np.zeros((len(cut), 2))
    for i, b in enumerate(cut):
        out[i] = field.weights[[field.index[f] for f in traits(b, i / n) if f in field.index]].sum(0)
    return out


def viterbi(emit: np.ndarray, turn: np.ndarray) -> list[int]:
    """The best labels of one chain."""
    if not len(emit):
        return []
    (a, b), back = emit[0].tolist(), []
    (t00, t01), (t10, t11) = turn.tolist()
    for e0, e1 in emit[1:].tolist():
        from0, from1 = (a + t00 >= b + t10), (a + t01 >= b + t11)
        back.append((0 if from0 else 1, 0 if from1 else 1))
        a, b = (a + t00 if from0 else b + t10) + e0, (a + t01 if from1 else b + t11) + e1
    labels = [int(b > a)]
    for step in reversed(back):
        labels.append(step[labels[-1]])
    return labels[::-1]


def main_text(field: Field, page: str | None) -> str:
    cut = blocks(page or "")
    if len(cut) == 1 and cut[0][1] == Path():
        return cut[0][0]
    return " ".join(b[0] for b, main in zip(cut, viterbi(scores(field, cut), field.turn), strict=True) if main)


MAIN, OTHER = "\ue000", "\ue001"


def labelled_pages(n: int = PAGES, seed: int = SEED) -> list[str]:
    """n pages of many layouts, and an eighth of them again with more elements. Each block's text begins with MAIN if it is main text and with OTHER if not."""
    rng = random.Random(seed)
    syllables = ["".join(rng.choice(x) for x in ("bcdfghklmnprstvw", "aeiouéü", "nrst l")).strip() for _ in range(90)]
    word = lambda: "".join(rng.choice(syllables) for _ in range(rng.randint(1, 4)))
    words = lambda a, b: " ".join(word() + rng.choice(["", "", "", ",", "***", "&amp;"] if rng.random() < 0.1 else [""]) for _ in range(rng.randint(a, b)))
    sentences = lambda a, b: " ".join(words(4, 16).capitalize() + rng.choice("...!?") for _ in range(rng.randint(a, b)))
    named = lambda tag, names, inside, p=0.9: f'<{tag}{f" {rng.choice(["class", "class", "id"])}={chr(34)}{rng.choice(names.split())}{rng.choice(["", "", "-wrap", " box", "-1"])}{chr(34)}" if rng.random() < p else ""}>{inside}</{tag}>'
    links = lambda a, b: "<ul>" + "".join(f'<li><a href="/{word()}">{OTHER}{words(1, 4).capitalize()}</a></li>' for _ in range(rng.randint(a, b))) + "</ul>"
    maybe = lambda p, make: make() if rng.random() < p else ""
    other = lambda a=1, b=3: OTHER + (sentences(a, b) if rng.random() < 0.7 else words(2, 12))
    ad = lambda: named(rng.choice(["div", "div", "aside", "section", "p"]), "ad ads advert advertisement sponsored promo banner", other(1, 2) if rng.random() < 0.7 else f'<a href="/x">{other(1, 1)}</a>', 1)
    form = lambda: rng.choice([
        f"<form><label>{OTHER}{words(1, 3)}</label><input><button>{OTHER}{words(1, 2)}</button></form>", f'<form class="newsletter"><p>{other(1, 2)}</p><input type="text"><button>{OTHER}{words(1, 2)}</button></form>',
        named("div", "subscribe newsletter signup search login", f"<p>{other(1, 1)}</p><form><input><button>{OTHER}{words(1, 1)}</button></form>"),
    ])
    notice = lambda: named(rng.choice(["div", "section", "aside", "p"]), "cookie cookies consent notice alert popup disclaimer gdpr", rng.choice([f"<p>{other(1, 3)}</p><button>{OTHER}{word()}</button>", other(1, 3)]), 1)
    share = lambda: named("div", "share social sharing tags byline meta", rng.choice([links(2, 4), OTHER + words(1, 5)]), 1)

    def menu() -> str:
        inside = links(3, 9) if rng.random() < 0.8 else " | ".join(f'<a href="/{word()}">{OTHER if i == 0 else ""}{words(1, 2)}</a>' for i in range(rng.randint(3, 7)))
        return rng.choice([f"<nav>{inside}</nav>", named("div", "nav menu navbar breadcrumb navigation", inside, 1), f"<nav>{inside}</nav>"])

    def comments() -> str:
        one = lambda: rng.choice([f"<p>{other(1, 4)}</p>", f"<b>{OTHER}{words(1, 2)}</b><p>{other(1, 4)}</p>", other(1, 3)])
        n = rng.randint(1, 6)
        body = rng.choice(["<ol>" + "".join(f"<li>{one()}</li>" for _ in range(n)) + "</ol>", "".join(named("div", "comment reply comment-body", one(), 0.8) for _ in range(n)), "".join(f"<article class=comment>{one()}</article>" for _ in range(n))])
        return named(rng.choice(["section", "div"]), "comments comment-list comments-area discussion respond replies", maybe(0.7, lambda: f"<h{(k := rng.randint(2, 4))}>{OTHER}{words(1, 3)}</h{k}>") + body + maybe(0.3, form), 1)

    def side() -> str:
        inside = maybe(0.7, lambda: f"<h3>{OTHER}{words(1, 3)}</h3>") + rng.choice([links(2, 8), f"<p>{other(1, 3)}</p>", f"<div>{other(1, 2)}</div>" + links(1, 4)])
        return rng.choice([f"<aside>{inside}</aside>", named("div", "sidebar widget related popular recommended rail", inside, 1), named("aside", "sidebar related", inside)])

    def top() -> str:
        title = rng.choice([f"<h1>{OTHER}{words(1, 3)}</h1>", f"<div>{OTHER}{words(1, 4)}</div>", f'<a href="/">{OTHER}{words(1, 2)}</a>', f"<p>{other(1, 1)}</p>"])
        return rng.choice([f"<header>{title}{maybe(0.5, menu)}</header>", named("div", "header masthead topbar", title + maybe(0.5, menu), 1)])

    def bottom() -> str:
        inside = rng.choice([f"&copy; {OTHER}{words(1, 3)} &middot; {sentences(1, 1)}", f"<p>{OTHER}&copy; {words(2, 6)}</p>", links(2, 6) + f"<p>{other(1, 2)}</p>", f"<p>{other(1, 3)}</p>"])
        return rng.choice([f"<footer>{inside}</footer>", named("div", "footer copyright legal bottom", inside, 1), f"<footer>{inside}</footer>"])

    def story() -> str:
        def piece() -> str:
            x = rng.random()
            body = sentences(1, 6) if rng.random() < 0.85 else words(1, 30)
            if x < 0.68:
                return rng.choice([f"<p>{MAIN}{body}</p>", f"<p>{MAIN}{body}", f"<p><b>{MAIN}{words(2, 8)}</b> {body}<br>{sentences(1, 2)}</p>", f'<p>{MAIN}{words(2, 8)} <a href="/{word()}">{words(1, 5)}</a> {body}</p>'])
            if x < 0.76:
                return f"<h{(k := rng.randint(2, 4))}>{MAIN}{words(1, 7).capitalize()}</h{k}>"
            if x < 0.83:
                return f"<{(t := rng.choice(['ul', 'ol']))}>" + "".join(f"<li>{MAIN}{words(2, 14)}</li>" for _ in range(rng.randint(2, 6))) + f"</{t}>"
            if x < 0.87:
                return f"<blockquote>{rng.choice(['', '<p>'])}{MAIN}{sentences(1, 3)}</blockquote>"
            if x < 0.90:
                return "<table>" + "".join("<tr>" + "".join(f"<td>{MAIN}{words(1, 4)}</td>" for _ in range(3)) + "</tr>" for _ in range(rng.randint(1, 4))) + "</table>"
            if x < 0.93:
                return f"<pre>{MAIN}{words(5, 30)}</pre>"
            if x < 0.95:
                return f"<figure><img src=x><figcaption>{MAIN}{words(3, 10)}</figcaption></figure>"
            return f"<div>{MAIN}{body}</div>"

        heading = f"<h1>{MAIN}{words(1, 12).capitalize()}</h1>"
        parts = [piece() for _ in range(rng.randint(0 if rng.random() < 0.1 else 1, 12))] or [f"<p>{MAIN}{sentences(1, 3)}</p>"]
        for make, p in ((ad, 0.3), (form, 0.12), (share, 0.15), (notice, 0.1), (side, 0.12)):
            if rng.random() < p:
                parts.insert(rng.randint(0, len(parts)), make())
        inside = maybe(0.85, lambda: heading) + "".join(parts) + maybe(0.12, comments)
        return rng.choice([f"<article>{inside}</article>", f"<article>{inside}</article>", f"<main>{inside}</main>", f"<main><article>{inside}</article></main>", named("div", "content article post entry story main-content text body", inside, 1), f"<div>{inside}</div>", named("section", "content article post", inside, 1), f"<div>{inside}</div>"])

    own = random.Random(seed + 1)
    few = lambda a, b: " ".join("".join(own.choice(syllables) for _ in range(own.randint(1, 4))) for _ in range(own.randint(a, b)))

    def fitted(page: str) -> str:
        """The page with elements in it that hold other text than they show, or the main text itself."""
        choice = f"<select>{''.join(f'<option>{OTHER}{few(1, 3)}</option>' for _ in range(own.randint(1, 5)))}</select>"
        label = f"<svg><title>{few(1, 2)}</title><text>{OTHER}{few(1, 2)}</text></svg>"
        hidden = f"<template><p>{OTHER}{few(3, 30)}.</p></template>"
        shown = own.choice(("noscript", "object", "canvas"))
        at = [m.end() for m in re.finditer(r"</p>|</ul>|</div>", page) if m.start() > page.find("</head>")]
        for piece, p in ((choice, 0.5), (label, 0.5), (hidden, 0.3), (f"<noscript><p>{OTHER}{few(3, 12)}.</p></noscript>", 0.1)):
            if at and own.random() < p:
                k = own.choice(at)
                page, at = page[:k] + piece + page[k:], [x if x <= k else x + len(piece) for x in at]
        if own.random() < 0.6:  # main text in an element that is often empty or a stand-in, closed or not
            page = re.sub(rf"<p>({MAIN}[^<]*)</p>", lambda m: f"<{shown}><p>{m[1]}</p></{shown}>" if own.random() < 0.5 else m[0], page)
        if own.random() < 0.4:
            page = re.sub(rf"<p>({MAIN}[^<]*)</p>", lambda m: f"<p>{m[1]} <math><mi>x</mi><mo>=</mo><mn>{own.randint(1, 99)}</mn></math> {few(1, 5)}.</p>", page, count=2)
        return page

    out = []
    for _ in range(n):
        head = f"<!DOCTYPE html><html><head><title>{words(2, 5)}</title><style>p{{margin:0}}</style><script>var t=\"</p>\";</script></head><body>" if rng.random() < 0.85 else ""
        before = [f() for f, p in ((top, 0.4), (menu, 0.7), (notice, 0.3), (ad, 0.4), (side, 0.15), (form, 0.15)) if rng.random() < p]
        after = [f() for f, p in ((share, 0.2), (comments, 0.35), (side, 0.35), (ad, 0.25), (form, 0.2), (notice, 0.15)) if rng.random() < p]
        rng.shuffle(after)
        out.append(head + "".join(before) + "<!-- x -->" + story() + "".join(after) + maybe(0.85, bottom) + rng.choice(["</body></html>", ""]))
    return out + [fitted(page) for page in out[::8]]


def expected(emit: np.ndarray, turn: np.ndarray, real: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of chains in columns (real: which positions each has): how likely each label, and each pair of neighbours' labels, is; log partition sums. By forward and backward sums."""
    longest = len(emit)
    a, b = np.zeros_like(emit), np.zeros_like(emit)
    a[0] = emit[0]
    for t in range(1, longest):
        a[t] = np.where(real[t][:, None], emit[t] + np.logaddexp.reduce(a[t - 1][:, :, None] + turn, 1), a[t - 1])
    for t in range(longest - 2, -1, -1):
        b[t] = np.where(real[t + 1][:, None], np.logaddexp.reduce(turn + (emit[t + 1] + b[t + 1])[:, None, :], 2), 0)
    z = np.logaddexp.reduce(a[-1], 1)
    node = np.exp(a + b - z[None, :, None]) * real[..., None]
    edge = np.exp(a[:-1][..., :, None] + turn + (emit + b)[1:][..., None, :] - z[None, :, None, None]) * real[1:][..., None, None]
    return node, edge, z


def train(pages: list[str], rounds: int = ROUNDS) -> Field:
    """Gradient ascent (Adam) on the mean log-likelihood per block, over all pages at once."""
    chains = []
    for page in pages:
        cut = [(t.replace(MAIN, "").replace(OTHER, "").strip(), p, links, int(MAIN in t)) for t, p, links in blocks(page)]
        cut = [b for b in cut if b[0]]
        chains.append([(traits(b[:3], i / max(1, len(cut) - 1)), b[3]) for i, b in enumerate(cut)])
    chains = [c for c in chains if c]
    seen = sorted({f for c in chains for fs, _ in c for f in fs})
    index = {f: i for i, f in enumerate(seen)}
    n, longest = len(chains), max(map(len, chains))
    x = np.zeros((longest, n, len(seen)), np.float32)
    y, real = np.zeros((longest, n), int), np.zeros((longest, n), bool)
    for j, c in enumerate(chains):
        for i, (fs, label) in enumerate(c):
            x[i, j, [index[f] for f in fs]] = 1
            y[i, j], real[i, j] = label, True
    flat = x.reshape(-1, len(seen))[real.reshape(-1)]
    w, turn = np.zeros((len(seen), 2)), np.zeros((2, 2))
    moments = [(np.zeros_like(a), np.zeros_like(a)) for a in (w, turn)]
    total, gold = real.sum(), np.eye(2)[y] * real[..., None]
    pairs = np.einsum("tbi,tbj->ij", gold[:-1], gold[1:])
    for step in range(1, rounds + 1):
        emit = np.zeros((longest, n, 2))
        emit[real] = flat @ w
        node, edge, _ = expected(emit, turn, real)
        grads = (flat.T @ (gold - node)[real] / total - RIDGE * w, (pairs - edge.sum((0, 1))) / total - RIDGE * turn)
        for value, (m, v), g in zip((w, turn), moments, grads, strict=True):
            m += 0.1 * (g - m)
            v += 0.001 * (g * g - v)
            value += RATE * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
    return Field(index, w, turn)


def extract(pages: DataFrame, field: Field) -> DataFrame:
    """pages without html, with text and n_chars."""
    kept = [f for f in pages.schema if f.name not in ("html", "text", "n_chars")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            text = [main_text(field, h.as_py()) for h in batch.column("html")]
            columns = [batch.column(f.name) for f in kept]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(text, pa.string()), pa.array(list(map(len, text)), pa.int64())], [*(f.name for f in kept), "text", "n_chars"])

    given = "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in kept)
    return pages.select(*(F.col(f"`{f.name}`") for f in kept), F.col("html").cast("string")).mapInArrow(run, f"{given}text string, n_chars long")
