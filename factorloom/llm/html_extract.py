"""Main text of web pages by boosted trees over the nodes of the page.

A page is read into a tree of elements. Boosted trees give each element the log-odds that main text lies
in or below it, from its tag, depth, the density of text and links in its subtree, hashed tokens of
its attributes and those above it, and its siblings. Decoding chooses, bottom up, the best labels of
the whole tree under the rule that an element is kept only if its parent is: no kept descendant has a
dropped ancestor. Text directly in the page's body, run by run between its elements, is labelled like an
element. The text of kept elements and runs, block by block, is the page's main text.

The trees are trained here, on a bounded set of pages that a generator writes in many layouts with the
main text known; no page of a table is used.

Rows: a null or empty page, and one without main text, gives an empty text; repeated rows are each
extracted; an empty table gives no rows; unclosed and stray tags, comments that do not end and unknown
elements are read the way browsers do. Only page_id, url and html are read.
"""

from __future__ import annotations

import html as entities
import random
import re
import zlib
from collections import Counter
from collections.abc import Callable
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from factorloom.llm import boosting, common

#: Pages that the trees are trained on.
TRAINING_PAGES = 800

TAG = re.compile(r"<!--(?:.*?-->|.*\Z)|<(/?)([a-zA-Z][^\s/>]*+)((?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)>|<[!?/a-zA-Z][^>]*+>", re.S)
COMMENT = re.compile(r"<!--(?:.*?-->|.*\Z)", re.S)
ATTRIBUTE = re.compile(r"([a-zA-Z_:][-\w:.]*)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+)))?")
TOKEN = re.compile(r"[a-z]+")
BLANK = re.compile(r"\s+")

# Fixed values of HTML.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp iframe noembed noframes noscript template svg annotation annotation-xml".split())
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q ruby rp rt s samp small span strike strong sub sup time tt u var wbr math mi mn mo ms mspace mtext mrow mfrac msqrt mroot mstyle mpadded msub msup msubsup munder mover munderover mmultiscripts mtable mtr mtd semantics".split())
SILENT = frozenset("script style head title noscript template svg iframe object embed canvas audio video select option datalist button input textarea".split())
CLOSES_P = frozenset("address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr main menu nav ol p pre section table ul".split())
#: An opening tag ends an open element of these, up to the boundary.
IMPLIED = {"li": ({"li"}, {"ul", "ol", "menu"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "tr": ({"tr", "td", "th"}, {"table", "tbody", "thead", "tfoot"}), "td": ({"td", "th"}, {"tr"}), "th": ({"td", "th"}, {"tr"}), "option": ({"option"}, {"select"})}
TAGS = "html body main article section div p h1 h2 h3 h4 h5 h6 ul ol li dl dt dd table tr td th blockquote pre figure figcaption nav header footer aside form fieldset address details summary span a label button #text math".split()
EDGES, BODIES = frozenset("nav header footer aside form".split()), frozenset("article main".split())
TAG_NUMBER = {t: i + 1 for i, t in enumerate(TAGS)}
#: Elements that end the search for an open paragraph.
P_BOUNDS = frozenset("td th table button object".split())
#: Open elements that end tags look for, as in browsers; deeper ones keep their text and end with those.
MOST_OPEN = 512
#: Tags whose quotes never close, after which a page's quotes are read as plain signs.
BROKEN_QUOTES = 32
PLAIN_TAG = re.compile(r"<!--(?:.*?-->|.*\Z)|<(/?)([a-zA-Z][^\s/>]*+)([^>]*+)>|<[!?/a-zA-Z][^>]+>", re.S)
#: Attribute tokens are hashed to so many features.
HASHED = 48
#: Text of no letters: blanks, and the marks of training pages.
EMPTY = re.compile(r"[\s\x01-\x04]*")


class Node:
    """An element that may hold main text; inline elements without attributes count to their block, but for links and formulas."""

    __slots__ = ("attrs", "children", "depth", "index", "parent", "parts", "tag", "tokens")

    def __init__(self, tag: str, attrs: str, parent: Node | None):
        self.tag, self.attrs, self.parent = tag, attrs, parent
        self.children: list[Node] = []
        self.parts: list = []  # texts, None for a break, and children in order
        self.depth = parent.depth + 1 if parent else 0
        self.tokens = tokens_of(attrs)


@lru_cache(maxsize=20_000)
def tokens_of(attrs: str) -> tuple[int, ...]:
    """Hashed tokens of class, id and role."""
    out = set()
    for name, a, b, c in ATTRIBUTE.findall(attrs):
        if name.lower() in ("class", "id", "role", "itemprop", "aria-label"):
            out.update(zlib.crc32(t.encode()) % HASHED for t in TOKEN.findall((a or b or c).lower()))
        elif name.lower() in ("hidden", "aria-hidden"):
            out.add(zlib.crc32(b"hidden") % HASHED)
    return tuple(sorted(out))


def parse(page: str) -> Node:
    """The tree of a page's elements, and of the runs of text in none of them, under a root."""
    root = elements(page)
    parts, run = [], []

    def close() -> None:
        said = [k for k, p in enumerate(run) if p is not None and not EMPTY.fullmatch(p)]
        if said:  # breaks around the text stay with the root, whether the text is kept or not
            node = Node("#text", "", root)
            node.parts = run[said[0] : said[-1] + 1]
            parts.extend([*run[: said[0]], node, *run[said[-1] + 1 :]])
        else:
            parts.extend(run)
        run.clear()

    for p in root.parts:
        if isinstance(p, Node):
            close()
            parts.append(p)
        else:
            run.append(p)
    close()
    root.parts, root.children = parts, [p for p in parts if isinstance(p, Node)]
    return root


def elements(page: str) -> Node:
    """The tree of a page's elements under a root, in time linear in the page."""
    root = Node("html", "", None)
    stack: list[tuple[str, Node]] = [("html", root)]
    held: Counter[str] = Counter()  # open elements by name
    at, end = 0, len(page)
    last, broken, tag = page.rfind(">"), 0, TAG

    def close(k: int) -> None:
        for t, _ in stack[k:]:
            held[t] -= 1
        del stack[k:]

    def push(name: str, node: Node) -> None:
        if len(stack) > MOST_OPEN:
            close(MOST_OPEN)
        stack.append((name, node))
        held[name] += 1

    while at < end:
        m = tag.search(page, at) if at <= last else COMMENT.search(page, at)
        text = page[at : m.start() if m else end]
        if text:
            stack[-1][1].parts.append(text)
        if not m:
            break
        at = m.end()
        name = m[2] if m.re is not COMMENT else None
        if not name:
            if tag is TAG and page[m.start() + 1].isalpha():
                broken += 1
                tag = PLAIN_TAG if broken > BROKEN_QUOTES else TAG
            continue
        name = name.lower()
        if m[1]:
            k = next((i for i in range(len(stack) - 1, 0, -1) if stack[i][0] == name), 0) if held[name] else 0
            if k:
                if name not in INLINE:
                    stack[k - 1][1].parts.append(None)
                elif any(t not in INLINE for t, _ in stack[k:]):
                    continue  # an inline end tag doesn't end blocks
                close(k)
            elif name in ("br", "p"):
                stack[-1][1].parts.append(None)
            continue
        if name in ("html", "body") and stack[-1][1] is root:
            root.tokens = tuple(sorted({*root.tokens, *tokens_of(m[3])}))
            continue
        if name in RAW or name in SILENT and name not in ("head", "object", "button", "select", "option", "canvas", "audio", "video", "datalist"):
            if not m[3].endswith("/") and name not in VOID:
                over = re.compile(rf"</{re.escape(name)}\s*>", re.I).search(page, at)
                at = over.end() if over else end
            continue
        if name in VOID:
            if name in ("br", "hr"):
                stack[-1][1].parts.append(None)
            continue
        if name not in INLINE:
            if name in CLOSES_P and held["p"]:
                k = next((i for i in range(len(stack) - 1, 0, -1) if stack[i][0] == "p" or stack[i][0] in P_BOUNDS), 0)
                if k and stack[k][0] == "p":
                    close(k)
            if name in IMPLIED and any(held[t] for t in IMPLIED[name][0]):
                ends, bound = IMPLIED[name]
                k = next((i for i in range(len(stack) - 1, 0, -1) if stack[i][0] in bound or stack[i][0] in ends), 0)
                if k and stack[k][0] not in bound:
                    close(k)
            stack[-1][1].parts.append(None)
        parent = stack[-1][1]
        if name in INLINE and not tokens_of(m[3]) and name not in ("a", "math"):
            push(name, parent)
            continue
        node = Node(name, m[3], parent)
        parent.children.append(node)
        parent.parts.append(node)
        push(name, node)
    return root


def listed(root: Node) -> list[Node]:
    """All nodes, each before its descendants."""
    out, todo = [], [root]
    while todo:
        node = todo.pop()
        node.index = len(out)
        out.append(node)
        todo.extend(reversed(node.children))
    return out


PLAIN_FEATURES = 29
FEATURES = PLAIN_FEATURES + 2 * HASHED


def features(nodes: list[Node]) -> np.ndarray:
    """A row of numbers for each node, in the order of listed()."""
    n = len(nodes)
    x = np.zeros((n, FEATURES))
    own = np.array([sum(len(p) for p in v.parts if type(p) is str and not p.isspace()) for v in nodes], float)
    points = np.array([sum(p.count(".") + p.count(",") for p in v.parts if type(p) is str) for v in nodes], float)
    parent = np.array([v.parent.index if v.parent else -1 for v in nodes])
    text, stops, size, links, linked, paragraphs = own.copy(), points.copy(), np.ones(n), np.array([v.tag == "a" for v in nodes], float), np.where([v.tag == "a" for v in nodes], own, 0.0), np.where([v.tag == "p" for v in nodes], 1.0, 0.0)
    for i in range(n - 1, 0, -1):
        p = parent[i]
        for a in (text, stops, size, links, linked, paragraphs):
            a[p] += a[i]
    total = max(1.0, text[0])
    above_links = np.zeros(n)
    edged, bodied = np.zeros(n, bool), np.zeros(n, bool)  # below an element of the page's edges, of its body
    for i in range(1, n):
        p = parent[i]
        edged[i], bodied[i] = edged[p] or nodes[p].tag in EDGES, bodied[p] or nodes[p].tag in BODIES
    place, alike, largest = np.zeros(n, int), np.ones(n), text.copy()  # among all siblings; the root has none
    for v in nodes:
        if v.children:
            count = Counter(k.tag for k in v.children)
            most = max(text[k.index] for k in v.children)
            for j, k in enumerate(v.children):
                place[k.index], alike[k.index], largest[k.index] = j, count[k.tag] / len(v.children), most
    for i, v in enumerate(nodes):
        p = parent[i]
        kin = v.parent.children if v.parent else [v]
        pos = int(place[i])
        tags = [TAG_NUMBER.get(v.tag, 0), TAG_NUMBER.get(v.parent.tag, 0) if v.parent else 0, TAG_NUMBER.get(v.parent.parent.tag, 0) if v.parent and v.parent.parent else 0]
        above_links[i] = linked[p] / max(1.0, text[p]) if p >= 0 else 0
        before, after = kin[pos - 1] if pos else None, kin[pos + 1] if pos + 1 < len(kin) else None
        x[i, :PLAIN_FEATURES] = (
            *tags, v.depth, np.log1p(text[i]), np.log1p(own[i]), text[i] / size[i], text[i] / total, linked[i] / max(1.0, text[i]), links[i] / size[i], np.log1p(size[i]), np.log1p(paragraphs[i]),
            stops[i] / max(1.0, text[i]) * 100, len(v.children), len(kin), pos, pos / len(kin), alike[i], TAG_NUMBER.get(before.tag, 0) if before else -1, TAG_NUMBER.get(after.tag, 0) if after else -1,
            text[p] / total if p >= 0 else 1, text[i] / max(1.0, text[p]) if p >= 0 else 1, above_links[i], np.log1p(largest[i]), i / n, v.tag in EDGES, v.tag in BODIES, edged[i], bodied[i],
        )
        for t in v.tokens:
            x[i, PLAIN_FEATURES + t] = 1
        if p >= 0:
            x[i, PLAIN_FEATURES + HASHED :] = x[p, PLAIN_FEATURES + HASHED :]
            for t in v.parent.tokens:
                x[i, PLAIN_FEATURES + HASHED + t] = 1
    return x


def decode(nodes: list[Node], odds: np.ndarray) -> np.ndarray:
    """Labels of greatest total log-odds under which a kept node's parent is kept; the root is kept."""
    gain = odds.copy()
    for i in range(len(nodes) - 1, 0, -1):
        if gain[i] > 0:
            gain[nodes[i].parent.index] += gain[i]
    keep = np.zeros(len(nodes), bool)
    keep[0] = True
    for i in range(1, len(nodes)):
        keep[i] = gain[i] > 0 and keep[nodes[i].parent.index]
    return keep


def joined(nodes: list[Node], keep: np.ndarray) -> str:
    """Text of the kept nodes: blocks with single blanks inside, joined by one blank.

    Where no node is kept, all text in no element counts.
    """
    root = nodes[0]
    if not keep[1:].any():
        keep = np.array([v.tag == "#text" for v in nodes])
    out: list[str] = []

    def walk(v: Node) -> None:
        todo: list = [iter(v.parts)]
        while todo:
            for p in todo[-1]:
                if p is None:
                    out.append("\n")
                elif type(p) is str:
                    out.append(entities.unescape(p))
                elif keep[p.index]:
                    todo.append(iter(p.parts))
                    break
            else:
                todo.pop()

    walk(root)
    return BLANK.sub(" ", "".join(out)).strip()


def main_text(model: boosting.Boosted, pages: list[str]) -> list[str]:
    """The main text of each page."""
    trees = [listed(parse(p)) if p else [] for p in pages]
    x = [features(t) for t in trees if t]
    odds = model.log_odds(np.concatenate(x)) if x else np.zeros(0)
    out, at = [], 0
    for t in trees:
        own = odds[at : at + len(t)]
        at += len(t)
        own[[v.tag in SILENT for v in t]] = -np.inf
        out.append(joined(t, decode(t, own)) if t else "")
    return out


# ---- training pages


class Writer:
    """Writes pages in many layouts; keeps which pieces are main text."""

    BOILER = {
        "nav": "nav menu navbar navigation topnav breadcrumb breadcrumbs main-menu site-nav".split(),
        "header": "header site-header masthead top banner page-header logo".split(),
        "footer": "footer site-footer bottom copyright colophon page-footer legal".split(),
        "aside": "sidebar aside widget related rail recommended popular secondary".split(),
        "notice": "cookie notice consent gdpr banner alert popup modal newsletter subscribe".split(),
        "ad": "ad ads advert advertisement sponsored promo sponsor".split(),
        "comments": "comments comment-list discussion responses disqus replies".split(),
        "share": "share social sharing follow tools".split(),
        "form": "search search-form login signup contact subscribe form".split(),
    }
    CONTENT = "content article post entry story main body text post-content entry-content article-body main-content".split()

    def __init__(self, seed: int):
        self.r = random.Random(seed)
        letters = "abcdefghijklmnopqrstuvwxyzéüßñ"
        self.signs, self.end, self.shout = [".", ",", *[""] * 8], ".", False
        self.words = ["".join(self.r.choices(letters, k=self.r.randint(2, 9))) for _ in range(400)]

    def text(self, low: int, high: int) -> str:
        w = self.r.choices(self.words if self.r.random() < 0.9 else self.words[:3], k=self.r.randint(low, high))
        said = " ".join(x + self.r.choice(self.signs) for x in w)
        return (said.upper() if self.shout else said.capitalize()) + self.end

    def attr(self, names: list[str]) -> str:
        kind = self.r.random()
        name = self.r.choice(names)
        return "" if kind < 0.15 else f' class="{name}"' if kind < 0.6 else f' id="{name}"' if kind < 0.8 else f' class="{name} {self.r.choice(names)}-{self.r.choice(["box", "wrap", "inner", "1"])}"'

    def links(self, low: int, high: int) -> str:
        return "".join(f'<li><a href="/{w}">{w}{self.r.choice(self.signs)}</a></li>' for w in self.r.choices(self.words, k=self.r.randint(low, high)))

    def boiler(self, kind: str) -> str:
        r, a = self.r, self.attr(self.BOILER[kind])
        own = {"nav": "nav", "header": "header", "footer": "footer", "aside": "aside", "form": "form"}.get(kind, "div")
        tag = own if r.random() < 0.6 else r.choice(["div", "section"])
        if tag in ("div", "section") and not a:
            a = f' class="{self.BOILER[kind][0]}"'
        if kind == "nav":
            inner = f"<ul>{self.links(2, 9)}</ul>"
        elif kind == "header":
            inner = f"<a href='/'>{self.text(1, 3)}</a>" + (f"<h2>{self.text(1, 5)}</h2>" if r.random() < 0.4 else "") + (f"<p>{self.text(2, 9)}</p>" if r.random() < 0.5 else "") + (f"<nav><ul>{self.links(2, 6)}</ul></nav>" if r.random() < 0.4 else "")
        elif kind == "footer":
            inner = r.choice(["&copy; ", ""]) + self.text(1, 30) + (f"<ul>{self.links(2, 6)}</ul>" if r.random() < 0.4 else "") + (f"<p>{self.text(3, 25)}</p>" if r.random() < 0.4 else "")
        elif kind == "aside":
            inner = f"<h3>{self.text(1, 4)}</h3>" + r.choice([f"<ul>{self.links(2, 8)}</ul>", f"<p>{self.text(5, 40)}</p>", "".join(f"<p>{self.text(4, 15)}</p>" for _ in range(r.randint(1, 3)))])
        elif kind == "comments":
            inner = f"<h3>{self.text(1, 3)}</h3>" + "".join(f'<div class="comment"><b>{self.text(1, 2)}</b><p>{self.text(3, 60)}</p></div>' for _ in range(r.randint(1, 5)))
        elif kind == "share":
            inner = f"<ul>{self.links(2, 5)}</ul>"
        elif kind == "form":
            inner = f'<label>{self.text(1, 3)}</label><input type="text" name="q"><button>{self.text(1, 2)}</button>' + (f"<p>{self.text(3, 15)}</p>" if r.random() < 0.4 else "")
        else:
            inner = r.choice([self.text(3, 40), f"<p>{self.text(3, 40)}</p>", f"<p>{self.text(3, 20)}</p><button>{self.text(1, 2)}</button>", f'<a href="/{self.words[0]}">{self.text(3, 20)}</a>'])
        return f"<{tag}{a}>{inner}</{tag}>"

    def block(self) -> str:
        r = self.r
        kind = r.random()
        text = self.text(*r.choice([(1, 6), (3, 25), (3, 25), (3, 150), (3, 150), (100, 800)]))
        if r.random() < 0.2:
            w = text.split(" ")
            k = r.randrange(len(w))
            w[k] = r.choice([f"<b>{w[k]}</b>", f"<em>{w[k]}</em>", f'<a href="/x">{w[k]}</a>', f"{w[k]}<br>"])
            text = " ".join(w)
        if r.random() < 0.22:
            return self.rarer()
        if kind < 0.72:
            return f"<p>{r.choice(['', '', '', '<b>'])}{text}" + r.choice(["</p>", "</p>", "</p>", "<br>"])
        if kind < 0.8:
            return f"<h{r.randint(2, 4)}>{self.text(1, 8)}</h{0}>".replace("</h0>", "") + ""
        if kind < 0.88:
            return "<ul>" + "".join(f"<li>{self.text(3, 20)}</li>" for _ in range(r.randint(2, 6))) + "</ul>"
        if kind < 0.92:
            return f"<blockquote><p>{text}</p></blockquote>"
        if kind < 0.96:
            return "<table>" + "".join("<tr>" + "".join(f"<td>{self.text(1, 5)}</td>" for _ in range(3)) + "</tr>" for _ in range(r.randint(2, 4))) + "</table>"
        return f"<div>{text}</div>"

    def formula(self) -> str:
        r = self.r
        a, b, c = r.choices("abcknxyz", k=3)
        return r.choice([f"<math><mi>{a}</mi><mo>=</mo><mi>{b}</mi><mo>+</mo><mn>{r.randint(1, 99)}</mn></math>", f"<i>{a}</i> = <i>{b}</i><sup>{r.randint(2, 9)}</sup> + {c}", f"<code>{a}({b}) = {c}</code>", f"<math display='block'><mrow><msup><mi>{a}</mi><mn>2</mn></msup><mo>=</mo><mi>{c}</mi></mrow></math>"])

    def link(self, low: int, high: int) -> str:
        return f'<a href="{self.r.choice(["/", "https://www.", "#"])}{self.r.choice(self.words)}">{self.text(low, high)}</a>'

    def rarer(self) -> str:
        """Blocks of an article that resemble boilerplate: linked paragraphs, lists of sources, definitions, folds, formulas, captions."""
        r = self.r
        kind = r.randrange(8)
        if kind == 0:
            return f"<p>{self.link(*r.choice([(1, 6), (3, 25), (10, 60)]))}</p>"
        if kind == 1:
            tag = r.choice(["ul", "ol"])
            head = r.choice(["", f"<h{r.randint(2, 4)}>{self.text(1, 4)}</h2>"])
            return f"{head}<{tag}>" + "".join(f"<li>{r.choice(['', self.text(1, 6) + ' '])}{self.link(*r.choice([(1, 5), (3, 14)]))}</li>" for _ in range(r.randint(1, 7))) + f"</{tag}>"
        if kind == 2:
            return "<dl>" + "".join(f"<dt>{self.text(1, 4)}</dt><dd>{self.text(2, 30)}</dd>" for _ in range(r.randint(1, 5))) + "</dl>"
        if kind == 3:
            inner = r.choice([f"<p>{self.text(3, 60)}</p>", self.text(3, 60), f"<ul><li>{self.text(2, 12)}</li><li>{self.text(2, 12)}</li></ul>"])
            return f"<details{r.choice(['', ' open'])}><summary>{self.text(1, 8)}</summary>{inner}</details>"
        if kind == 4:
            return r.choice([f"<p>{self.formula()}</p>", f"<div>{self.formula()}</div>", f"<p>{self.text(2, 20)} {self.formula()} {self.text(1, 20)}</p>"])
        if kind == 5:
            return f"<figure><img src='{self.words[0]}.png'><figcaption>{self.text(2, 25)}</figcaption></figure>"
        if kind == 6:
            return f"<pre>{self.text(3, 40)}</pre>"
        return f"<p>{self.text(1, 4)}</p>"

    def page(self) -> str:
        """A page; main text lies between the marks <!--[--> and <!--]-->, boilerplate in it between <!--{--> and <!--}-->."""
        r = self.r
        self.signs, self.end = r.choice([([".", ",", *[""] * 8], "."), ([""], ""), ([",", ".", *[""] * 30], "."), (["!!", "&amp;&amp;", ""], ".")])
        self.shout = r.random() < 0.1
        body = []
        for _ in range(1 if r.random() < 0.3 else r.choice([1, 1, 2, 3, 4, 6]) if r.random() < 0.85 else r.randint(7, 25)):
            body.append(self.block())
            if r.random() < 0.12:
                body.append("<!--{-->" + self.boiler(r.choice(["ad", "share", "notice", "aside", "form"])) + "<!--}-->")
        title = f"<h1>{self.text(1, 10)}</h1>" if r.random() < 0.8 else ""
        if title and r.random() < 0.25:
            title = f"<header>{title}</header>"
        if r.random() < 0.25:  # blocks in elements of their own, one or a few together
            wrap = r.choice(["section", "section", "div"])
            parts = [body[k : k + n] for n in (r.randint(1, 3),) for k in range(0, len(body), n)]
            body = [f"<{wrap}{self.attr(self.CONTENT) if r.random() < 0.3 else ''}>{''.join(p)}</{wrap}>" for p in parts]
        inner = title + "".join(body)
        if r.random() < 0.15:
            inner += "<!--{-->" + self.boiler("comments") + "<!--}-->"
        kind = r.random()
        if kind < 0.45:
            main = f"<article{self.attr(self.CONTENT) if r.random() < 0.4 else ''}>{inner}</article>"
        elif kind < 0.6:
            main = f"<main>{inner}</main>"
        elif kind < 0.7:
            main = f"<main><article>{inner}</article></main>"
        elif kind < 0.95:
            main = f'<div class="{r.choice(self.CONTENT)}">{inner}</div>'
        else:
            main = f'<div id="{r.choice(self.CONTENT)}"><div>{inner}</div></div>'
        if r.random() < 0.18:  # an article in no element of its own
            main = title + "".join(r.choice([b, b, f"{self.text(*r.choice([(1, 6), (3, 25), (3, 150), (100, 300)]))}<br><br>", self.formula(), f"{self.text(2, 20)} {self.formula()} {self.text(1, 20)}"]) for b in body)
        main = f"<!--[-->{main}<!--]-->"
        before = "".join(self.boiler(r.choice(["nav", "nav", "header", "ad", "notice", "form", "share", "aside"])) for _ in range(r.randint(0, 4)))
        after = "".join(self.boiler(r.choice(["footer", "footer", "aside", "comments", "ad", "share", "notice", "form", "nav"])) for _ in range(r.randint(0, 4)))
        whole = before + main + after
        if r.random() < 0.1:  # boilerplate in no element of its own
            whole = r.choice([f"{self.text(1, 6)}{whole}", f"{whole}{r.choice(['&copy; ', ''])}{self.text(1, 12)}", f'<a href="/">{self.text(1, 2)}</a> | {self.text(1, 3)}{whole}'])
        if r.random() < 0.35:
            whole = f"<div{self.attr(['wrapper', 'container', 'page', 'site', 'layout'])}>{whole}</div>"
        return f"<!DOCTYPE html><html><head><meta charset='utf-8'><title>{self.text(1, 8)}</title><style>p{{margin:0}}</style><script>var t='<p>';</script></head><body>{whole}" + r.choice(["</body></html>", "</body></html>", ""])


def labelled(page: str) -> tuple[list[Node], np.ndarray]:
    """Nodes of a training page and whether main text lies in or below each."""
    marks = {"<!--[-->": "\x01", "<!--]-->": "\x02", "<!--{-->": "\x03", "<!--}-->": "\x04"}
    for a, b in marks.items():
        page = page.replace(a, b)
    nodes = listed(parse(page))
    good = np.zeros(len(nodes), bool)
    inside = out = 0
    todo: list[tuple[Node, object]] = [(nodes[0], iter(nodes[0].parts))]
    while todo:
        node, rest = todo[-1]
        for p in rest:
            if type(p) is str:
                text = False
                for c in p:
                    if c in "\x01\x02\x03\x04":
                        inside += (c == "\x01") - (c == "\x02")
                        out += (c == "\x03") - (c == "\x04")
                    elif inside > 0 and not out and not c.isspace():
                        text = True
                good[node.index] |= text
            elif p is not None:
                todo.append((p, iter(p.parts)))
                break
        else:
            todo.pop()
    for v in nodes:
        v.parts = [p.translate({1: None, 2: None, 3: None, 4: None}) if type(p) is str else p for p in v.parts]
    for i in range(len(nodes) - 1, 0, -1):
        good[nodes[i].parent.index] |= good[i]
    return nodes, good


def train(pages: int = TRAINING_PAGES, seed: int = 11) -> boosting.Boosted:
    """Fit the trees to `pages` written pages."""
    writer = Writer(seed)
    got = [labelled(writer.page()) for _ in range(pages)]
    return boosting.fit(np.concatenate([features(n) for n, _ in got]), np.concatenate([g for _, g in got]).astype(float))


def extract(pages: DataFrame, model: boosting.Boosted) -> DataFrame:
    """page_id, url, text and n_chars (code points) of every page."""
    held = pages.sparkSession.sparkContext.broadcast(model)

    def make() -> Callable[[pa.RecordBatch], pa.RecordBatch]:
        def kernel(part: pa.RecordBatch) -> pa.RecordBatch:
            texts = main_text(held.value, common.as_text(part.column("html")).to_pylist())
            return pa.record_batch([part.column("page_id").cast(pa.int64()), part.column("url").cast(pa.string()), pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())], ["page_id", "url", "text", "n_chars"])

        return kernel

    return common.map_text(pages.select("page_id", "url", "html"), "html", make, "page_id long, url string, text string, n_chars long", 2_000_000)
