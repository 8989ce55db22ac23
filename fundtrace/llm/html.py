"""Operator 4: main text of web pages by tree scoring.

Every block with text passes points to its ancestors: one, one for each comma, and up to three for its length; the full
sum to its parent, a half to the grandparent, a quarter above and so on. A container's sum is discounted by the share of
its text that stands in links; of equal ones the deepest is best, then the first. If the best container lies in an article or main, that is kept; else it grows to ancestors
that add next to no links, and is kept with those siblings that score at least a fifth of it or are text, headings,
paragraphs, lists, tables or quotes with few links. Menus, headers, footers, sidebars, notices, adverts, forms, comments and code are
taken out of the tree first, by tag, role, class or id. A part that only its class, id or role speaks against stays if it holds
most of the page's text and no article or main stands beside it; a header inside an article stays.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from html import unescape

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fundtrace.llm.common import spread

TOKEN = re.compile(r"""<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([A-Za-z][^\s/>]*)((?:[^>"']++|"[^"]*+"|'[^']*+')*+)(?:>|\Z)|<(/?)([A-Za-z][^\s/>]*)([^>]*)(?:>|\Z)""", re.S)
#: A name, and its value if it has one; values are taken whole, so names inside them are none.
ATTRIBUTE = re.compile(r"""([^\s"'>/=]+)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s>]+))?""")
RAW = {"script", "style", "textarea", "title", "noscript", "iframe", "template", "xmp", "noembed", "noframes"}
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
DROPPED = RAW | {"head", "nav", "header", "footer", "aside", "form", "button", "select", "option", "svg", "math", "canvas", "object", "dialog", "menu", "audio", "video", "map"}
INLINE = {"a", "abbr", "acronym", "b", "bdi", "bdo", "big", "cite", "code", "data", "del", "dfn", "em", "font", "i", "ins", "kbd", "mark", "q", "ruby", "s", "samp", "small", "span", "strike", "strong", "sub", "sup", "time", "tt", "u", "var", "wbr"}
#: Tags that end an open paragraph when they start.
CLOSES_P = {"address", "article", "aside", "blockquote", "center", "details", "div", "dl", "fieldset", "figcaption", "figure", "footer", "form", "h1", "h2", "h3", "h4", "h5", "h6", "header", "hr", "main", "menu", "nav", "ol", "p", "pre", "section", "table", "ul"}
#: Tags beyond which an open paragraph is not ended.
AROUND_P = {"article", "main", "div", "td", "th", "li", "section", "blockquote", "table"}
#: Tags that end an open element of the second set, looked for no further up than one of the third.
SIBLINGS = {
    "li": ({"li"}, {"ul", "ol", "menu"}),
    "dt": ({"dt", "dd"}, {"dl"}),
    "dd": ({"dt", "dd"}, {"dl"}),
    "tr": ({"tr", "td", "th"}, {"table"}),
    "td": ({"td", "th"}, {"tr", "table"}),
    "th": ({"td", "th"}, {"tr", "table"}),
    "option": ({"option"}, {"select"}),
}
#: Words of a class, id or role that mark what is not the article.
UNLIKELY = frozenset(
    "ad ads adbox adslot advert adverts advertisement advertising banner breadcrumb breadcrumbs byline comment comments commentlist "
    "contentinfo cookie cookies consent dialog discussion disqus footer footnav gdpr header login masthead menu menubar menuitem modal nav "
    "navbar navigation newsletter notice notices notification outbrain pager pagination popup promo promoted promotion related "
    "remark replies reply respond search share sharing shoutbox sidebar sidebox signup skip social sponsor sponsored subscribe "
    "taboola toolbar tooltip trending widget widgets".split()
)
#: Of these, words of parts that are never the article, however long they are; and words that make a class speak of the page around it.
NEVER = frozenset("ad ads advert adverts advertisement advertising comment comments commentlist cookie cookies discussion disqus footer footnav menu menubar nav navbar navigation remark replies reply respond shoutbox sponsor sponsored".split())
AROUND = frozenset("has have with without no not hide show".split())
WEIGHT = {"article": 25.0, "main": 15.0, "section": 3.0, "div": 5.0, "pre": 3.0, "td": 3.0, "blockquote": 3.0, "ul": -3.0, "ol": -3.0, "li": -3.0, "dl": -3.0, "th": -5.0}
KEPT = {"html", "body", "article", "main"}
#: Siblings of the best container that are kept whatever they score; and the share of links up to which an ancestor is taken.
BESIDE = INLINE | {"h1", "h2", "h3", "h4", "h5", "h6", "hgroup", "p", "ul", "ol", "dl", "table", "blockquote", "pre", "figure", "details", "address"}
FEW_LINKS = 0.1
#: A doubtful part of an article goes if it has fewer characters or a larger share of links.
SHORT, SOME_LINKS = 80, 0.25
WORDS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+|\d+")


class Node:
    """An element: its parent, its depth, and its children, which are elements and pieces of text in page order."""

    __slots__ = ("tag", "parent", "depth", "parts", "score", "doubtful")

    def __init__(self, tag: str, parent: Node | None, doubtful: bool = False):
        self.tag, self.parent, self.parts, self.score, self.doubtful = tag, parent, [], 0.0, doubtful
        self.depth = parent.depth + 1 if parent else 0


class Path:
    """The open elements from the root to the innermost, and where each tag is among them."""

    def __init__(self, root: Node):
        self.nodes, self.places = [root], {}

    def last(self, tags: set[str]) -> int:
        """Place of the innermost open element of one of the tags; 0 if none is open."""
        return max((self.places[t][-1] for t in tags if self.places.get(t)), default=0)

    def open(self, node: Node) -> None:
        self.places.setdefault(node.tag, []).append(len(self.nodes))
        self.nodes.append(node)

    def close(self, place: int) -> None:
        """Close the element at a place and all inside it; each element is closed once, so this is linear in all."""
        while len(self.nodes) > place:
            self.places[self.nodes.pop().tag].pop()

    def end(self, tags: set[str], limits: set[str]) -> None:
        """Close the innermost open element of one of ``tags``, if none of the limits is open inside it."""
        place = self.last(tags)
        if place > self.last(limits):
            self.close(place)


def _unlikely(tag: str, attributes: str, path: Path) -> str:
    """Whether an element is no part of the article: "yes", "maybe" or empty. ``path``: the elements around it."""
    if tag in DROPPED and not (tag == "header" and path.last({"article"})):
        return "yes"
    if not attributes or tag in KEPT:
        return ""
    found = ""
    for name, value in ATTRIBUTE.findall(attributes):
        name = name.lower()
        if name == "hidden" or name == "aria-hidden" and "true" in value.lower() or name == "style" and re.search(r"display\s*:\s*none", value, re.I):
            return "yes"
        if name in ("class", "id", "role"):
            for token in value.strip("\"'").split():
                words = [w.lower() for w in WORDS.findall(token)]
                if AROUND.isdisjoint(words) and not UNLIKELY.isdisjoint(words):
                    if not NEVER.isdisjoint(words):
                        return "yes"
                    found = "maybe"
    return found


def parse(html: str) -> Node:
    """The tree of a page without what is never part of an article. Works for unclosed and cut pages alike."""
    root = Node("html", None)
    path = Path(root)
    skipped: list[str] = []  # open elements from the one that is left out
    counts: dict[str, int] = {}  # of their tags
    position = 0
    find, size = TOKEN.search, len(html)
    while position < size:
        m = find(html, position)
        end = m.start() if m else size
        if end > position and not skipped:
            path.nodes[-1].parts.append(html[position:end])
        if not m:
            break
        position = m.end()
        close, tag, attributes = (m[1], m[2], m[3]) if m[2] else (m[4], m[5], m[6])
        if not tag:
            continue
        tag = tag.lower()
        if skipped:
            if close:
                if counts.get(tag):
                    while (left := skipped.pop()) != tag:
                        counts[left] -= 1
                    counts[tag] -= 1
            elif tag in RAW:
                position = _after_raw(html, tag, position)
            elif tag not in VOID and not attributes.endswith("/"):
                skipped.append(tag)
                counts[tag] = counts.get(tag, 0) + 1
            if not close or skipped or tag not in ("article", "main", "body", "html"):
                continue
        if close:
            if place := path.last({tag}):
                path.close(place)
            continue
        if tag in ("html", "body"):
            continue
        if tag in CLOSES_P:
            path.end({"p"}, AROUND_P)
        if tag in SIBLINGS:
            path.end(*SIBLINGS[tag])
        at = path.nodes[-1]
        if tag in VOID:
            if tag in ("br", "hr"):
                at.parts.append(" ")
            continue
        unlikely = _unlikely(tag, attributes, path)
        if unlikely == "yes":
            if tag not in INLINE:
                at.parts.append(" ")
            if tag in RAW:
                position = _after_raw(html, tag, position)
            else:
                skipped.append(tag)
                counts = {tag: 1}
            continue
        node = Node(tag, at, unlikely == "maybe")
        at.parts.append(node)
        path.open(node)
    return _without_doubtful(root)


def _without_doubtful(root: Node) -> Node:
    """The tree without its doubtful parts, but for those with most of its text and no article or main beside them.

    In an article or main, words of a class are not enough: a part goes if it is short or a good part of it stands in links.
    """
    nodes = _walk(root)
    if not any(n.doubtful for n in nodes):
        return root
    size = {n: sum(len(x.strip()) for x in n.parts if type(x) is str) for n in nodes}
    bodies = {n: int(n.tag in ("article", "main")) for n in nodes}
    links = dict.fromkeys(nodes, 0)
    for n in reversed(nodes):
        if n.tag == "a":
            links[n] = size[n]
        if n.parent is not None:
            size[n.parent] += size[n]
            links[n.parent] += links[n]
            bodies[n.parent] += bodies[n]
    todo, inside = [root], set()  # inside: what stands in an article or main
    while todo:
        n = todo.pop()
        for i, x in enumerate(n.parts):
            if type(x) is Node:
                within = n in inside or n.tag in ("article", "main")
                if within:
                    inside.add(x)
                outside = 2 * size[x] <= size[root] or bodies[x] < bodies[root]
                if x.doubtful and (size[x] < SHORT or links[x] > SOME_LINKS * size[x] if within else outside):
                    n.parts[i] = "" if x.tag in INLINE else " "
                else:
                    todo.append(x)
    return root


def _after_raw(html: str, tag: str, position: int) -> int:
    m = re.compile(rf"</{tag}\s*[^>]*(?:>|\Z)", re.I).search(html, position)
    return m.end() if m else len(html)


def _walk(root: Node) -> list[Node]:
    found, todo = [], [root]
    while todo:
        n = todo.pop()
        found.append(n)
        todo.extend(x for x in n.parts if type(x) is Node)
    return found


def text_of(root: Node) -> str:
    """Text of an element: references decoded, white space as one space, blocks joined by one space."""
    out: list[str] = []
    todo: list = [root]
    while todo:
        x = todo.pop()
        if type(x) is str:
            out.append(unescape(x) if "&" in x else x)
        elif x.tag in INLINE:
            todo.extend(reversed(x.parts))
        else:
            todo.extend([" ", *reversed(x.parts), " "])
    return " ".join("".join(out).split())


def extract(html: str | None) -> str:
    """Main text of a page; empty if there is none."""
    if not html:
        return ""
    root = parse(html)
    nodes = _walk(root)
    sizes: dict[Node, list[int]] = {n: [0, 0, 0] for n in nodes}  # of all text, in links, own commas
    own: dict[Node, int] = {}
    for n in reversed(nodes):  # children come after their parents
        total, link, commas = sizes[n]
        direct = sum(len(" ".join(x.split())) for x in n.parts if type(x) is str)
        own[n] = direct
        commas += sum(x.count(",") for x in n.parts if type(x) is str)
        total += direct
        if n.tag == "a":
            link = total
        sizes[n] = [total, link, commas]
        if n.parent is not None:
            up = sizes[n.parent]
            up[0] += total
            up[1] += link
            if n.tag in INLINE:
                up[2] += commas
                own[n.parent] = own.get(n.parent, 0)
    density = {n: sizes[n][1] / sizes[n][0] if sizes[n][0] else 0.0 for n in nodes}
    for n in nodes:
        if n.tag in INLINE or not (own[n] or any(type(x) is Node and x.tag in INLINE and sizes[x][0] for x in n.parts)):
            continue
        length = own[n] + sum(sizes[x][0] for x in n.parts if type(x) is Node and x.tag in INLINE)
        points = 1 + sizes[n][2] + min(length / 100, 3)
        up = n.parent if n.tag in ("p", "pre", "td", "th", "li", "dt", "dd", "blockquote", "figcaption") or n.tag[0] == "h" else n
        while up is not None and up.tag in INLINE:
            up = up.parent
        if up is not None:
            up.score += points
    for n in reversed(nodes):  # half of what an element has goes on to the one around it
        if n.parent is not None:
            n.parent.score += n.score if n.tag in INLINE else n.score / 2
    scored = {n for n in nodes if n.score and n.tag not in INLINE}
    if not scored:
        return text_of(root)
    for n in scored:
        n.score = (n.score + WEIGHT.get(n.tag, 0.0)) * (1 - density[n])
    best = max((n for n in nodes if n in scored), key=lambda n: (n.score, n.depth))
    around = [n for n in _up(best) if n.tag in ("article", "main")]
    if around:  # the outermost article, or main if there is none
        return text_of(next((n for n in reversed(around) if n.tag == "article"), around[-1]))
    top = best
    for n in _up(best):
        if n.parent is None or sizes[n][1] - sizes[top][1] > FEW_LINKS * (sizes[n][0] - sizes[top][0]):
            break
        top = n
    if top.parent is None:
        return text_of(top)
    least, kept = best.score / 5, Node("div", None)
    for x in top.parent.parts:
        if type(x) is str or x is top or x in scored and x.score >= max(least, 1) and density[x] < 0.5:
            kept.parts.append(x)
        else:
            kept.parts.append(x if x.tag in BESIDE and density[x] < 0.25 else " ")
    return text_of(kept)


def _up(node: Node) -> Iterator[Node]:
    """The element and those it is in, from the inside."""
    at: Node | None = node
    while at is not None:
        yield at
        at = at.parent


def main_text(pages: DataFrame, html_col: str = "html", text_col: str = "text") -> DataFrame:
    """Add the main text of each page as ``text_col``, which replaces a column of that name.

    Null, empty or unreadable html gives the empty string. Rows are handled on their own; repeats stay. Long and deep pages
    are taken whole, in time linear in their size.
    """
    name = "main_text_of_page"
    kept = [c for c in pages.columns if c not in (html_col, text_col)]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            b[name] = [extract(h) for h in b[html_col]]
            yield b.drop(columns=[html_col])

    schema = ", ".join([*(f"`{c}` {pages.schema[c].dataType.simpleString()}" for c in kept), f"{name} string"])
    return pages.select(*[F.col(f"`{c}`") for c in kept], html_col).mapInPandas(run, schema).withColumnRenamed(name, text_col)


def op4_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Main text of every page."""
    pages = spread(spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url", "html"))
    return main_text(pages).select("page_id", "url", "text", F.char_length("text").cast("long").alias("n_chars"))
