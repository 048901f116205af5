"""Main text of web pages: gradient-boosted trees over DOM nodes, decoded from the root down."""

from __future__ import annotations

import html as entities
import math
import random
import re
from bisect import bisect_left
from functools import cache

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from tarnwood.llm import common
from tarnwood.llm.gbt import Boosted

# HTML's elements by how they are read.
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
RAW = set("script style noscript template textarea iframe title svg math object canvas".split())
UNSEEN = RAW | {"head"}
INLINE = set("a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split())
CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}, "thead": {"tr", "td", "th"}, "tbody": {"tr", "td", "th", "thead"}, "tfoot": {"tr", "td", "th", "tbody"}}
SCOPE = set("ul ol dl table article section div main aside nav header footer body form blockquote td th".split())
# What element names and attribute words speak for.
GROUPS = [{"article", "main"}, {"nav", "menu"}, {"header"}, {"footer"}, {"aside"}, {"form", "fieldset", "select", "button", "label", "input"}, {"p", "blockquote", "pre"}, {"h1"}, {"h2", "h3", "h4", "h5", "h6"}, {"ul", "ol", "dl", "li", "dt", "dd"}, {"table", "tr", "td", "th", "tbody"}, {"div", "section"}, {"dialog", "details", "summary"}, {"figure", "figcaption"}]
GOOD = set("article content main post entry story text body prose page blog news".split())
BAD = {
    "nav": "nav navbar navigation menu breadcrumb breadcrumbs toc pager pagination skip topbar tabs".split(),
    "frame": "header masthead footer foot copyright legal colophon site logo branding".split(),
    "side": "sidebar side aside widget related recommended recommend popular trending tags share sharing social author bio".split(),
    "ad": "ad ads advert adverts advertisement banner sponsor sponsored promo promotion promoted commercial affiliate".split(),
    "note": "notice notices cookie cookies consent gdpr popup modal alert overlay toast newsletter subscribe signup paywall".split(),
    "talk": "comment comments reply replies discussion disqus respond feedback reviews".split(),
    "form": "form search login signin register input".split(),
}
_KIND = {w: i for i, ws in enumerate(BAD.values()) for w in ws}

PLAIN = re.compile(r"""<(/?)([a-zA-Z][^\s/<>"']*)([^<>"']*(?:"[^"<>]*"[^<>"']*)*)>""")
NAME = re.compile(r"[a-zA-Z][^\s/>]*")
MARK = re.compile(r"""[>"']""")
ATTRIBUTE = re.compile(r"""(class|id|role|itemprop|hidden|aria-label)\s*(?:=\s*("[^"]*"|'[^']*'|[^\s>]+))?""", re.I)
WORD = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")
SPACE = re.compile(r"\s+")


class Node:
    """An element, or a run of text between two block boundaries (tag "#")."""

    __slots__ = ("bad", "children", "depth", "good", "label", "links", "marks", "nodes", "parent", "runs", "size", "tag", "text")

    def __init__(self, tag: str, parent: Node | None):
        self.tag, self.parent, self.children, self.text = tag, parent, [], []
        self.depth = parent.depth + 1 if parent else 0
        self.good, self.bad, self.label = 0, 0, 0
        self.size = self.links = self.marks = self.nodes = self.runs = 0
        if parent:
            parent.children.append(self)


class _Tags:
    """The tags and comments of a page, in order; time is linear in its length."""

    def __init__(self, page: str):
        self.page, self.last, self.name_end = page, page.rfind(">"), -1
        self.marks: list[int] | None = None  # where > and quotes stand, when first asked for
        self.ends: list[int] = []
        self.data = True  # whether a CDATA section may end

    def end(self, at: int) -> int:
        """Where the > stands that ends a tag's attributes from `at` on, outside quotes; -1 if none does."""
        if self.marks is None:
            self.marks = [m.start() for m in MARK.finditer(self.page, at)]
            n = len(self.marks)
            self.ends, following = [-1] * (n + 1), {}
            for i in range(n - 1, -1, -1):
                mark = self.page[self.marks[i]]
                if mark == ">":
                    self.ends[i] = self.marks[i]
                elif mark in following:
                    self.ends[i] = self.ends[following[mark] + 1]
                following[mark] = i
        return self.ends[bisect_left(self.marks, at)]

    def next(self, at: int) -> tuple[int, int, str, str, str] | None:
        """(start, end, kind, name, attributes) of the first at or after `at`; kind is "open",
        "close" or empty. A < that begins none is text."""
        page = self.page
        while (start := page.find("<", at)) >= 0:
            if plain := PLAIN.match(page, start):  # most tags; it reads no further than the next < or >
                return start, plain.end(), "close" if plain[1] else "open", plain[2].lower(), plain[3]
            two = page[start + 1 : start + 2]
            if page.startswith("<!--", start):
                end = page.find("-->", start + 4)
                return start, len(page) if end < 0 else end + 3, "", "", ""
            if start > self.last:
                comment = page.find("<!--", start)
                if comment < 0:
                    return None
                at = comment
                continue
            if two in ("!", "?"):
                if self.data and page.startswith("<![CDATA[", start):
                    end = page.find("]]>", start)
                    if end >= 0:
                        return start, end + 3, "", "", ""
                    self.data = False
                return start, page.find(">", start) + 1, "", "", ""
            if two == "/":
                if name := self.name(start + 2):
                    return start, page.find(">", start + 2 + len(name)) + 1, "close", name.lower(), ""
            elif name := self.name(start + 1):
                begin = start + 1 + len(name)
                end = page.find(">", begin)
                if not -1 < end or page.find('"', begin, end) >= 0 or page.find("'", begin, end) >= 0:
                    end = self.end(begin)
                if end >= 0:
                    return start, end + 1, "open", name.lower(), page[begin:end]
            at = start + 1
        return None

    def name(self, at: int) -> str:
        """The name that stands there, if one does. A name that ended nowhere before `at` isn't read again."""
        if not self.page[at : at + 1].isalpha() or not self.page[at].isascii():
            return ""
        if at >= self.name_end:
            self.name_end = NAME.match(self.page, at).end()
        return self.page[at : self.name_end]


def parse(page: str) -> Node:
    """The block tree of a page, however broken: inline elements dissolve into their text
    runs, raw elements and the head are skipped, missing end tags are implied. Time is linear
    in the page's length."""
    root = Node("#root", None)
    stack: list[tuple[str, Node]] = [("#root", root)]  # open elements; inline ones share their block's node
    places: dict[str, list[int]] = {}  # where in the stack each element is open
    blocks: list[int] = [0]  # and where blocks are
    scopes: list[tuple[int, str]] = []  # and those that an implied end doesn't leave
    run: Node | None = None
    tags, links, at, end, head = _Tags(page), 0, 0, len(page), True

    def push(tag: str, node: Node) -> None:
        places.setdefault(tag, []).append(len(stack))
        if tag not in INLINE:
            blocks.append(len(stack))
            if tag in SCOPE:
                scopes.append((len(stack), tag))
        stack.append((tag, node))

    def last(tag: str) -> int:
        held = places.get(tag)
        return held[-1] if held else 0

    def say(raw: str) -> None:
        nonlocal run
        if not raw:
            return
        text = entities.unescape(raw) if "&" in raw else raw
        if run is None:
            if not text.strip():
                return
            run = Node("#", stack[-1][1])
        run.text.append(text)
        if links:
            run.links += len(text)

    def pop_to(i: int) -> None:
        nonlocal run, links
        for tag, _ in stack[i:]:
            places[tag].pop()
            if tag == "a":
                links -= 1
            if tag not in INLINE:
                blocks.pop()
                if tag in SCOPE:
                    scopes.pop()
                run = None
        del stack[i:]

    while at < end:
        found = tags.next(at)
        if not found:
            say(page[at:])
            break
        start, after, kind, tag, attributes = found
        say(page[at:start])
        at = after
        if kind == "close":
            i = last(tag)
            if i and (tag not in INLINE or i > blocks[-1]):  # an inline element ends within its block
                pop_to(i)
            if tag == "p" or tag not in INLINE:
                run = None
        elif kind == "open":
            if tag in RAW and not (tag in ("svg", "math") and attributes.endswith("/")):
                close = re.compile(rf"</{re.escape(tag)}[\s/>]", re.I).search(page, at)
                at = end if not close else (page.find(">", close.start()) + 1 or end)
                continue
            if tag in RAW:
                continue
            if tag == "head":
                close = re.compile(r"</head\s*>|<body[\s>]", re.I).search(page, at) if head else None
                head = close is not None
                if close:
                    at = close.end() if close[0][1] == "/" else close.start()
                continue
            if tag in VOID:
                if tag == "br" and run is not None:
                    run.text.append(" ")
                elif tag == "hr":
                    run = None
                continue
            if tag in INLINE:
                if tag == "a":
                    links += 1
                push(tag, stack[-1][1])
                continue
            # a block ends an open paragraph, an item the item before, within its scope
            closes = CLOSES.get(tag, ())
            scope = next((i for i, t in reversed(scopes) if t not in closes), 0)
            if not closes:
                if (ended := last("p")) > scope:
                    pop_to(ended)
            else:
                while (ended := max([last("p"), *map(last, closes)])) > scope:
                    pop_to(ended)
            run = None
            node = Node(tag, stack[-1][1])
            if attributes and len(attributes) > 4:
                for name, value in ATTRIBUTE.findall(attributes):
                    if name.lower() == "hidden":
                        node.bad |= 1 << 4
                    for w in WORD.findall(value):
                        w = w.lower()
                        if w in GOOD:
                            node.good += 1
                        if w in _KIND:
                            node.bad |= 1 << _KIND[w]
            if not attributes.endswith("/"):
                push(tag, node)
    return root


def _measure(node: Node) -> list[Node]:
    """Sums over subtrees; returns all nodes, parents first."""
    order, todo = [], [node]
    while todo:
        n = todo.pop()
        order.append(n)
        todo.extend(reversed(n.children))
    for n in reversed(order):
        if n.tag == "#":
            text = SPACE.sub(" ", "".join(n.text)).strip()
            n.text = [text]
            n.size, n.runs = len(text), 1
            n.marks = text.count(".") + text.count(",") + text.count("!") + text.count("?") + text.count(";")
        n.nodes += 1
        if p := n.parent:
            p.size += n.size
            p.links += n.links
            p.marks += n.marks
            p.nodes += n.nodes
            p.runs += n.runs
    return order


_GROUP = {tag: i for i, tags in enumerate(GROUPS) for tag in tags}
WIDTH = 16 + 2 * (len(GROUPS) + 2) + 2 * len(BAD)


def features(order: list[Node]) -> np.ndarray:
    """A row a node: its own and its nearest element's kind, attribute words of its own and
    of all ancestors, depth, subtree density, links, and how it stands among its siblings."""
    out = np.zeros((len(order), WIDTH))
    total = max(1, order[0].size)
    above: dict[int, tuple[int, int, int]] = {id(order[0]): (0, 0, 0)}
    groups = len(GROUPS) + 2
    seen = 0
    for row, n in zip(out, order, strict=True):
        parent = n.parent
        bad, good, kinds = above[id(parent)] if parent else (0, 0, 0)
        bad, good = bad | n.bad, good + n.good
        group = _GROUP.get(n.tag, len(GROUPS) if n.tag == "#" else len(GROUPS) + 1)
        kinds |= 1 << group
        above[id(n)] = bad, good, kinds
        family = parent.children if parent else [n]
        siblings = len(family)
        row[:16] = (
            n.depth, math.log1p(n.size), n.size / total, n.links / max(1, n.size), n.marks / max(1, n.size), n.size / n.nodes, n.runs, n.size / max(1, n.runs),
            siblings, n.size / max(1, parent.size if parent else n.size), (parent.links / max(1, parent.size)) if parent else 0, seen / total,
            n.good > 0, good > 0, bin(bad).count("1"), (parent.size - n.size) / max(1, siblings - 1) if siblings > 1 else 0,
        )
        at = 16
        row[at + group] = 1
        at += groups
        k = kinds
        while k:
            row[at + (k & -k).bit_length() - 1] = 1
            k &= k - 1
        at += groups
        for i in range(len(BAD)):
            if n.bad >> i & 1:
                row[at + i] = 1
            if bad >> i & 1:
                row[at + len(BAD) + i] = 1
        if n.tag == "#":
            seen += n.size
    return out


def decode(order: list[Node], chance: np.ndarray) -> list[str]:
    """The kept runs in page order. A node's choice is to hold main text or not; none
    below a node that doesn't may: of all such choices the likeliest together, found by
    sums from the leaves up and read off from the root down."""
    p = np.clip(chance, 1e-4, 1 - 1e-4)
    yes, no = np.log(p).tolist(), np.log(1 - p).tolist()
    index = {id(n): i for i, n in enumerate(order)}
    for i in range(len(order) - 1, 0, -1):
        n = order[i]
        if n.tag != "#" and not any(yes[index[id(c)]] > no[index[id(c)]] for c in n.children):
            yes[i] = -1e9  # an element holds main text only through a child that does
        up = index[id(n.parent)]
        yes[up] += max(yes[i], no[i])
        no[up] += no[i]
    kept, out = [False] * len(order), []
    for i, n in enumerate(order):
        kept[i] = n.parent is None or (kept[index[id(n.parent)]] and yes[i] > no[i])
        if kept[i] and n.tag == "#" and n.text[0]:
            out.append(n.text[0])
    return out


# --- training pages -------------------------------------------------------------------------------


class _Maker:
    """Invents pages whose main text is known: every main run starts with the mark \x01."""

    def __init__(self, seed: int):
        self.r = random.Random(seed)
        self.words = ["".join(self.r.choice(("ta", "ri", "no", "the", "an", "mo", "er", "is", "lu", "ké", "ön", "st")) for _ in range(self.r.randint(1, 4))) for _ in range(600)]

    def sentence(self, low: int = 1, high: int = 16) -> str:
        words = [self.r.choice(self.words) for _ in range(self.r.randint(low, high))]
        return " ".join(words).capitalize() + self.r.choice([".", ".", ".", "", "!", "?"])

    def text(self, sentences: int) -> str:
        return " ".join(self.sentence() for _ in range(sentences))

    def named(self, tag: str, words: list[str], inner: str, plain: float = 0.25) -> str:
        r = self.r
        if r.random() < plain:
            return f"<{tag}>{inner}</{tag}>"
        word = r.choice(words)
        value = r.choice([word, f"{word}-{r.choice(['box', 'wrap', 'list', 'area', 'inner'])}", f"{r.choice(['left', 'page', 'c', 'col'])} {word}"])
        return f'<{tag} {r.choice(["class", "class", "id"])}="{value}">{inner}</{tag}>'

    def links(self, n: int) -> str:
        return "".join(f'<li><a href="/{self.r.randint(1, 999)}">{self.sentence(1, 3)}</a></li>' for _ in range(n))

    def boiler(self, kind: str) -> str:
        r = self.r
        if kind == "nav":
            inner = f"<ul>{self.links(r.randint(3, 9))}</ul>" if r.random() < 0.8 else " ".join(f'<a href="#">{self.sentence(1, 2)}</a>' for _ in range(5))
            return self.named(r.choice(["nav", "nav", "div"]), BAD["nav"], inner, 0.4) if r.random() < 0.85 else f"<nav>{inner}</nav>"
        if kind == "header":
            inner = r.choice([f"<h1>{self.sentence(1, 4)}</h1>", f"<div>{self.sentence(1, 5)}</div>", f"<p>{self.text(1)}</p>"])
            return f"<header>{inner}</header>" if r.random() < 0.6 else self.named("div", ["header", "masthead", "branding"], inner, 0)
        if kind == "footer":
            inner = r.choice([f"&copy; {self.sentence(1, 3)} &middot; {self.text(r.randint(1, 3))}", f"<p>{self.text(r.randint(1, 2))}</p>", f"<ul>{self.links(4)}</ul>"])
            return f"<footer>{inner}</footer>" if r.random() < 0.7 else self.named("div", ["footer", "copyright", "legal"], inner, 0)
        if kind == "side":
            inner = f"<h3>{self.sentence(1, 3)}</h3>" + r.choice([f"<ul>{self.links(r.randint(2, 6))}</ul>", f"<p>{self.text(r.randint(1, 4))}</p>"])
            return f"<aside>{inner}</aside>" if r.random() < 0.5 else self.named("div", BAD["side"], inner, 0)
        if kind == "ad":
            inner = r.choice([self.text(r.randint(1, 4)), f"<p>{self.text(r.randint(1, 3))}</p>", f'<a href="#">{self.sentence()}</a>'])
            return self.named(r.choice(["div", "div", "section", "p"]), BAD["ad"], inner, 0)
        if kind == "note":
            inner = r.choice([f"<p>{self.text(r.randint(1, 3))}</p>", self.text(r.randint(1, 3)), f"{self.text(1)} <button>{self.sentence(1, 2)}</button>"])
            return self.named(r.choice(["div", "section", "div", "p"]), BAD["note"], inner, 0)
        if kind == "talk":
            each = "".join(r.choice(["<div class='comment'><p>{}</p></div>", "<li><b>{}</b></li>", "<p>{}</p>", "<article class='comment'><p>{}</p></article>"]).format(self.text(r.randint(1, 5))) for _ in range(r.randint(1, 6)))
            inner = r.choice(["", f"<h2>{self.sentence(1, 2)}</h2>", f"<h3>{self.sentence(1, 2)}</h3>"]) + each
            return self.named(r.choice(["div", "section", "section", "ul", "ol"]), BAD["talk"], inner, 0)
        inner = f"<label>{self.sentence(1, 4)}</label><input name='q'><select><option>{self.sentence(1, 2)}</option></select><button>{self.sentence(1, 2)}</button>"
        return f"<form>{r.choice(['', f'<p>{self.text(1)}</p>', f'<p>{self.text(2)}</p>'])}{inner}</form>"

    def block(self) -> str:
        r, k = self.r, self.r.random()
        if k < 0.72:
            body = self.text(r.choice([1, 1, 2, 3, 5, 8]))
            if r.random() < 0.2:
                body = body.replace(" ", f' <a href="#">{self.sentence(1, 2)}</a> ', 1)
            if r.random() < 0.2:
                return f"<p><b>\x01{body}<br>"
            return f"<p>\x01{body}</p>" if r.random() < 0.85 else f"<p>\x01{body}"
        if k < 0.8:
            return f"<h{(d := r.randint(2, 4))}>\x01{self.sentence(1, 8)}</h{d}>"
        if k < 0.86:
            return "<ul>" + "".join(f"<li>\x01{self.sentence()}</li>" for _ in range(r.randint(1, 5))) + "</ul>"
        if k < 0.9:
            return f"<blockquote>\x01{self.text(r.randint(1, 3))}</blockquote>"
        if k < 0.94:
            return "<table>" + "".join(f"<tr><td>\x01{self.sentence(1, 3)}</td><td>\x01{self.sentence(1, 3)}</td></tr>" for _ in range(r.randint(1, 4))) + "</table>"
        if k < 0.97:
            return f"<div>\x01{self.text(r.randint(1, 4))}</div>"
        return f"<pre>\x01{self.sentence()}</pre>"

    def page(self) -> str:
        r = self.r
        blocks = [self.block() for _ in range(r.choice([0, 1, 1, 2, 3, 5, 9, 14]))]
        for kind in ("ad", "side", "note", "talk", "form"):  # inside the main part too
            if blocks and r.random() < 0.1:
                blocks.insert(len(blocks) if kind == "talk" else r.randint(0, len(blocks)), self.boiler(kind))
        head = f"<h1>\x01{self.sentence(1, 10)}</h1>" if r.random() < 0.85 else ""
        if head and r.random() < 0.1:
            head = f"<header>{head}</header>"
        inner = head + "".join(blocks)
        kind = r.random()
        if kind < 0.55:
            main = f"<article>{inner}</article>" if r.random() < 0.7 else self.named("article", ["post", "entry", "story", "h-entry"], inner, 0)
        elif kind < 0.7:
            main = f"<main>{inner}</main>"
        elif kind < 0.95:
            main = self.named(r.choice(["div", "div", "section"]), ["content", "article", "post", "entry", "main", "story", "article-body", "post-content"], inner, 0.05)
        else:
            main = f"<div>{inner}</div>"
        if r.random() < 0.3:
            main = f'<div class="{r.choice(["wrap", "container", "page", "layout", "row"])}">{main}{self.boiler("side") if r.random() < 0.4 else ""}</div>'
        before = "".join(self.boiler(k) for k in ("note", "header", "nav", "ad", "side", "form") if r.random() < {"nav": 0.85, "ad": 0.55}.get(k, 0.25))
        after = "".join(self.boiler(k) for k in ("ad", "talk", "side", "form", "note", "nav", "footer") if r.random() < {"footer": 0.85, "talk": 0.35}.get(k, 0.2))
        return f"<!DOCTYPE html><html><head><title>{self.sentence(1, 6)}</title><style>p{{}}</style></head><body>{before}{main}{after}" + r.choice(["</body></html>", ""])


def invented(pages: int, seed: int) -> list[str]:
    maker = _Maker(seed)
    return [maker.page() for _ in range(pages)]


@cache
def trained(pages: int = 600, seed: int = 11) -> Boosted:
    """The node model, fitted on `pages` invented pages: the bound of its sample."""
    rows, labels = [], []
    for page in invented(pages, seed):
        order = _label(page)
        rows.append(features(order)[1:])
        labels.extend(n.label for n in order[1:])
    return Boosted(trees=50, depth=4, rate=0.25, least=8).fit(np.concatenate(rows), np.array(labels, float))


def _label(page: str) -> list[Node]:
    root = parse(page)
    for n in (todo := [root]):
        todo.extend(n.children)
        if n.tag == "#" and "\x01" in "".join(n.text):
            n.label = 1
            n.text = [t.replace("\x01", "") for t in n.text]
            up = n.parent
            while up:
                up.label, up = 1, up.parent
    return _measure(root)


def main_texts(pages: list[str | None], model: Boosted) -> list[str]:
    orders = [_measure(parse(p or "")) for p in pages]
    full = [o for o in orders if len(o) > 1]
    if not full:
        return [""] * len(pages)
    chance = 1 / (1 + np.exp(-model.raw(np.concatenate([features(o)[1:] for o in full]))))
    out, at = [], 0
    for o in orders:
        if len(o) == 1:
            out.append("")
            continue
        out.append("\n".join(decode(o, np.r_[1.0, chance[at : at + len(o) - 1]])))
        at += len(o) - 1
    return out


def extract(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", model: Boosted | None = None, at_once: int = 256) -> DataFrame:
    """id, url, text and n_chars (code points) of every page, from its whole html.

    Runs of text between block boundaries, white space as one space, joined by a line feed.
    Null or empty html, and pages without main text, have the empty text. Repeated rows
    and null ids give a row each; other columns are not read. One narrow pass; a worker
    holds `at_once` parsed pages."""
    model = model or trained()
    schema = T.StructType([common.field(pages, id_col), common.field(pages, url_col), T.StructField("text", T.StringType()), T.StructField("n_chars", T.LongType())])

    def make():
        def work(columns):
            keys, urls, html = columns
            texts = [t for i in range(0, len(html), at_once) for t in main_texts(html[i : i + at_once], model)]
            return keys, urls, texts, list(map(len, texts))

        return work

    return common.map_arrow(pages, [id_col, url_col, html_col], schema, make)
