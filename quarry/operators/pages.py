"""Structured content of HTML pages: one pass per page inside ``mapInPandas``.

A small tag-soup tree stands in for a full HTML library: unknown nesting is accepted, an end tag closes the nearest
open element of its name, void elements never nest. Lookups are by predicate over the tree in document order.
"""

from __future__ import annotations

import json
import re
from collections.abc import Callable, Iterator
from html.parser import HTMLParser
from urllib.parse import urlsplit

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.functions import scores

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Elements that cleaning removes.
REMOVED = ["script", "style", "nav", "header", "footer", "aside", "advertisement"]
#: Where an article keeps its parts, in the order of trial; a dot means a class.
ARTICLE_TITLE = ["h1", ".post-title", ".article-title", "og:title", "title"]
ARTICLE_CONTENT = ["article", ".post-content", ".article-content", ".entry-content", ".content", "main"]
ARTICLE_AUTHOR = [".author", ".byline", "rel=author", "article:author", ".post-author"]
ARTICLE_DATE = ["time[datetime]", ".published", ".post-date", "article:published_time"]
ARTICLE_TAGS = [".tags", ".post-tags", ".categories"]
FORUM_POST = [".post-content", ".message-content", ".thread-content"]
FORUM_AUTHOR = [".post-author", ".username", ".author"]
STEP_WORDS = ["step", "étape", "phase"]
#: Page types by parts of the url, and by class names.
URL_TYPES = [("article", ["blog", "article", "post"]), ("documentation", ["docs", "documentation", "manual"]), ("forum", ["forum", "discussion", "thread"]), ("tutorial", ["tutorial", "guide", "howto"])]
CLASS_TYPES = [("article", "article|post"), ("documentation", "documentation|docs"), ("forum", "forum|thread")]
#: The separator that stands before appended blocks, as literal characters.
BREAK = "\\n"


class Node:
    """An element. ``walk`` keeps what it found, as a page is searched for many places; all nodes of a tree share ``edits``, a number that whoever changes
    children has to raise (``changed``)."""

    __slots__ = ("tag", "attributes", "children", "edits", "known")

    def __init__(self, tag: str, attributes: dict[str, str | None], edits: list[int] | None = None):
        self.tag, self.attributes = tag, attributes
        self.children: list[Node | str] = []
        self.edits = [0] if edits is None else edits
        self.known: tuple[int, list[Node]] | None = None

    def changed(self) -> None:
        self.edits[0] += 1

    def walk(self) -> Iterator[Node]:
        """Descendants in document order."""
        if self.known is None or self.known[0] != self.edits[0]:
            found, todo = [], [c for c in reversed(self.children) if not isinstance(c, str)]
            while todo:
                n = todo.pop()
                found.append(n)
                todo += [c for c in reversed(n.children) if not isinstance(c, str)]
            self.known = self.edits[0], found
        return iter(self.known[1])

    def find_all(self, *tags: str) -> list[Node]:
        return [n for n in self.walk() if n.tag in tags]

    def first(self, *tags: str) -> Node | None:
        return next((n for n in self.walk() if n.tag in tags), None)

    def classes(self) -> list[str]:
        return (self.attributes.get("class") or "").split()

    def strings(self) -> Iterator[str]:
        todo: list[Node | str] = list(reversed(self.children))
        while todo:
            x = todo.pop()
            if isinstance(x, str):
                yield x
            else:
                todo.extend(reversed(x.children))

    def text(self, joint: str = "") -> str:
        """Stripped pieces of text, the empty ones dropped."""
        return joint.join(s for s in (x.strip() for x in self.strings()) if s)

    def clean(self) -> None:
        """Drop what is no content, and all attributes below."""
        for n in [self, *self.walk()]:
            n.children = [c for c in n.children if isinstance(c, str) or c.tag not in REMOVED]
        self.changed()
        for n in self.walk():
            n.attributes = {}


class _Builder(HTMLParser):
    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.root = Node("[document]", {})
        self.open = [self.root]

    def handle_starttag(self, tag, attrs):
        node = Node(tag, dict(reversed(attrs)), self.root.edits)
        self.open[-1].children.append(node)
        if tag not in VOID:
            self.open.append(node)

    def handle_startendtag(self, tag, attrs):
        self.open[-1].children.append(Node(tag, dict(attrs), self.root.edits))

    def handle_endtag(self, tag):
        for k in range(len(self.open) - 1, 0, -1):
            if self.open[k].tag == tag:
                del self.open[k:]
                return

    def handle_data(self, data):
        self.open[-1].children.append(data)


def parse(html: str) -> Node:
    builder = _Builder()
    builder.feed(html)
    builder.close()
    return builder.root


def _matches(where: str) -> Callable[[Node], bool]:
    if where.startswith("."):
        return lambda n: "class" in n.attributes and where[1:] in n.classes()
    if where == "time[datetime]":
        return lambda n: n.tag == "time" and "datetime" in n.attributes
    if where.startswith("rel="):
        return lambda n: where[4:] in (n.attributes.get("rel") or "").split()
    if ":" in where:
        return lambda n: n.attributes.get("property") == where
    return lambda n: n.tag == where


def _find(root: Node, where: str) -> Node | None:
    return next(filter(_matches(where), root.walk()), None)


def _value(node: Node, where: str) -> str:
    return (node.attributes.get("content") or "") if ":" in where else node.text()


def _first_value(root: Node, places: list[str]) -> str:
    for where in places:
        node = _find(root, where)
        value = _value(node, where) if node else ""
        if value:
            return value
    return ""


def _cleaned(node: Node | None) -> str:
    if node is None:
        return ""
    node.clean()
    return node.text(" ")


def _heading(root: Node) -> str:
    node = root.first("h1")
    return node.text() if node else ""


def page_type(root: Node, url: str) -> str:
    og = next((n for n in root.find_all("meta") if n.attributes.get("property") == "og:type"), None)
    if og is not None and og.attributes.get("content") == "article":
        return "article"
    for script in root.find_all("script"):
        if script.attributes.get("type") == "application/ld+json":
            try:
                kind = json.loads("".join(script.strings())).get("@type", "").lower()
            except (ValueError, AttributeError):
                continue
            for name in ("article", "documentation"):
                if name in kind:
                    return name
    low = url.lower()
    for name, parts in URL_TYPES:
        if any(p in low for p in parts):
            return name
    if root.first("article"):
        return "article"
    for name, pattern in CLASS_TYPES:
        if any(re.search(pattern, c) for n in root.walk() for c in n.classes()):
            return name
    return "general"


def extract_article(root: Node) -> dict:
    out = {"title": _first_value(root, ARTICLE_TITLE), "content": "", "category": ""}
    for where in ARTICLE_CONTENT:
        node = _find(root, where)
        if node is not None:
            out["content"] = _cleaned(node)
            if len(out["content"]) > 200:
                break
    out["author"] = _first_value(root, ARTICLE_AUTHOR)
    dates = []
    for where in ARTICLE_DATE:
        node = _find(root, where)
        if node is not None:
            dates.append(node.attributes.get("datetime") or _value(node, where))
    out["dates"] = dates
    for where in ARTICLE_TAGS:
        links = [a.text() for box in root.walk() if _matches(where)(box) for a in box.find_all("a")]
        if links:
            out["tags"] = links
            break
    return out


def extract_documentation(root: Node) -> dict:
    out = {"title": _heading(root), "category": "documentation"}
    out["content"] = _cleaned(root.first("main") or root.first("article"))
    code = [t for t in (n.text() for n in root.find_all("code", "pre")) if len(t) > 10]
    if code:
        out["content"] += BREAK * 2 + "Code Examples:" + BREAK + BREAK.join(code)
    return out


def extract_forum(root: Node) -> dict:
    post = next((n for n in (_find(root, w) for w in FORUM_POST) if n), None)
    out = {"title": _heading(root), "content": _cleaned(post), "category": "forum"}
    author = next((n for n in root.walk() if any(_matches(w)(n) for w in FORUM_AUTHOR)), None)
    out["author"] = author.text() if author else ""
    return out


def extract_tutorial(root: Node) -> dict:
    out = {"title": _heading(root), "category": "tutorial"}
    out["content"] = _cleaned(root.first("article") or root.first("main"))
    steps = [t for t in (n.text() for n in root.find_all("h2", "h3", "h4")) if any(w in t.lower() for w in STEP_WORDS)]
    if steps:
        out["content"] += BREAK * 2 + "Tutorial Steps:" + BREAK + BREAK.join(steps)
    return out


def extract_general(root: Node) -> dict:
    title = root.first("title")
    node = root.first("main") or root.first("article") or root.first("body")
    return {"title": title.text() if title else "", "content": _cleaned(node), "category": "general"}


#: Extractors by page type; a caller may add its own.
EXTRACTORS: dict[str, Callable[[Node], dict]] = {"article": extract_article, "documentation": extract_documentation, "forum": extract_forum, "tutorial": extract_tutorial, "general": extract_general}

#: Pages, and characters of html, that are worked off at a time: what a worker holds then does not grow with the batches that Spark sends.
PAGES, HTML = 200, 2 << 20

SCHEMA = "page_id long, url string, domain string, content_type string, title string, content string, author string, dates array<string>, tags array<string>, category string"


def by_page(f: Callable[..., list[tuple]], schema: str) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """A function for ``mapInArrow``: the rows that ``f`` makes of each row; html is the last column. Rows are taken one by one, and what is made of
    PAGES of them or of HTML characters goes out at once."""
    names = [c.split()[0] for c in schema.split(", ")]
    kinds = {"long": pa.int64(), "int": pa.int32(), "string": pa.string(), "array<string>": pa.list_(pa.string())}
    types = [kinds[c.split()[1]] for c in schema.split(", ")]

    def packed(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate(types)], names=names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, pages, size = [], 0, 0
            for k in range(batch.num_rows):
                row = [c[k].as_py() for c in batch.columns]
                rows += f(*row)
                pages, size = pages + 1, size + len(row[-1] or "")
                if pages >= PAGES or size >= HTML:
                    yield packed(rows)
                    rows, pages, size = [], 0, 0
            if rows:
                yield packed(rows)

    return run


def extract_pages(pages: DataFrame, extractors: dict[str, Callable[[Node], dict]] | None = None, kind: str | None = None) -> DataFrame:
    """Structured content of (page_id, url, html), with ``published_at`` and ``quality_score``; ``kind`` takes every page for
    one of that type."""
    table = extractors or EXTRACTORS

    def read(page_id: int, url: str, html: str) -> tuple:
        root = parse(html or "")
        found = kind or page_type(root, url or "")
        e = table.get(found, table["general"])(root)
        return page_id, url, urlsplit(url or "").netloc, found, e["title"], e["content"], e.get("author", ""), e.get("dates", []), e.get("tags", []), e["category"]

    out = pages.select("page_id", "url", "html").mapInArrow(by_page(lambda *row: [read(*row)], SCHEMA), SCHEMA)
    parsed = F.transform("dates", scores.parse_date)
    out = out.withColumn("published_at", F.get(F.filter(parsed, lambda d: d.isNotNull()), 0)).drop("dates")
    return out.withColumn("quality_score", scores.extraction_quality(F.col("content"), F.col("title"), F.col("author"), F.col("published_at"), F.col("tags")))


def clean_elements(pages: DataFrame, tag: str = "body") -> DataFrame:
    """(page_id, text): the text of an element once scripts, styles, menus, headers, footers and asides are gone."""
    read = by_page(lambda page_id, html: [(page_id, _cleaned(parse(html or "").first(tag)))], "page_id long, text string")
    return pages.select("page_id", "html").mapInArrow(read, "page_id long, text string")
