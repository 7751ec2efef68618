"""Title, author, date and body of web articles, by a short list of places to look."""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from narrata.operators.batches import in_slices
from narrata.functions import text as X
from narrata.functions import web as V

# Fixed values.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
UNREAD = frozenset(["script", "style", "noscript", "svg", "canvas", "iframe"])
TITLES = ["h1.article-title", "h1.entry-title", "h1.post-title", "article h1", "main h1", "h1"]
AUTHORS = ["[name=author]", "[property=article:author]", ".author", ".byline", "[rel=author]"]
DATES = ["[property=article:published_time]", "[property=og:published_time]", "[name=date]", "[name=datePublished]", "time"]
BODIES = ["article", "main", "[role=main]", ".article-content", ".entry-content", ".post-content", ".markdown-body", "#content", ".content"]
BODY_WORDS, PARAGRAPHS = 80, 3


class Node:
    def __init__(self, name: str, attributes: dict[str, str], parent: Node | None):
        self.name, self.attributes, self.parent, self.parts = name, attributes, parent, []

    def _inside(self, enters: Callable[[Node], bool]) -> Iterator[Node | str]:
        """Everything inside in document order, however deep; elements that `enters` refuses are left out whole."""
        ahead = [iter(self.parts)]
        while ahead:
            p = next(ahead[-1], None)
            if p is None:
                ahead.pop()
            elif isinstance(p, str):
                yield p
            elif enters(p):
                yield p
                ahead.append(iter(p.parts))

    def walk(self) -> Iterator[Node]:
        return (p for p in self._inside(lambda _: True) if isinstance(p, Node))

    def texts(self) -> Iterator[str]:
        return (p.strip() for p in self._inside(lambda n: n.name not in UNREAD) if isinstance(p, str) and p.strip())

    def text(self, joint: str) -> str:
        return joint.join(self.texts())

    def fits(self, test: str) -> bool:
        """A test is a name with a class (h1.x), a class, an id (#x), an attribute ([k=v]), or a name."""
        if test.startswith("["):
            key, _, value = test[1:-1].partition("=")
            return self.attributes.get(key) == value or key == "rel" and value in self.attributes.get(key, "").split()
        if test.startswith("#"):
            return self.attributes.get("id") == test[1:]
        name, _, kind = test.partition(".")
        return (not name or self.name == name) and (not kind or kind in self.attributes.get("class", "").split())


class _Tree(HTMLParser):
    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.root = self.at = Node("", {}, None)
        self.open: dict[str, int] = {}  # how many elements of each name are open

    def handle_starttag(self, tag: str, attrs: list) -> None:
        node = Node(tag, {k: v or "" for k, v in attrs}, self.at)
        self.at.parts.append(node)
        if tag not in VOID:
            self.at = node
            self.open[tag] = self.open.get(tag, 0) + 1

    def handle_endtag(self, tag: str) -> None:
        if self.open.get(tag):  # each element that is left here is left once
            closed = False
            while not closed:
                closed = self.at.name == tag
                self.open[self.at.name] -= 1
                self.at = self.at.parent

    def handle_data(self, data: str) -> None:
        self.at.parts.append(data)


def tree_of(html: str) -> Node:
    parser = _Tree()
    parser.feed(html)
    parser.close()
    return parser.root


def select(root: Node, tests: str) -> Node | None:
    """The first element, in document order, that fits the last of the tests inside ones that fit the others."""
    *outer, last = tests.split(" ")
    ahead = [(iter(root.parts), 0)]  # of each open element: what is left of it, and how many of the others fit so far
    while ahead:
        parts, met = ahead[-1]
        node = next(parts, None)
        if node is None:
            ahead.pop()
        elif isinstance(node, Node):
            if met == len(outer) and node.fits(last):
                return node
            ahead.append((iter(node.parts), met + (met < len(outer) and node.fits(outer[met]))))
    return None


def first(root: Node, selectors: list[str], read: Callable[[Node], str | None]) -> str | None:
    for s in selectors:
        node = select(root, s)
        if node is not None and (found := read(node)):
            return found
    return None


def title_of(root: Node) -> str:
    for s in ("[property=og:title]", "[name=twitter:title]"):
        node = select(root, s)
        if node is not None and node.name == "meta":
            if content := node.attributes.get("content", "").strip():
                return content
            break
    return first(root, [*TITLES, "title"], lambda n: n.text(" ")) or "Untitled"


def author_of(root: Node) -> str | None:
    found = first(root, AUTHORS, lambda n: n.attributes.get("content") if n.name == "meta" else n.text(" "))
    return found.strip() if found else None


def date_of(root: Node) -> str | None:
    for s in DATES:
        node = select(root, s)
        if node is not None:
            return (node.attributes.get("datetime") or node.text(" ") or None) if node.name == "time" else node.attributes.get("content")
    return None


def body_of(root: Node) -> str:
    for s in BODIES:
        node = select(root, s)
        text = node.text("\n") if node is not None else ""
        if len(text.split()) >= BODY_WORDS:
            return text
    paragraphs = [t for n in root.walk() if n.name == "p" and (t := n.text(" "))]
    if len(paragraphs) >= PARAGRAPHS:
        return "\n\n".join(paragraphs)
    body = select(root, "body")
    return body.text("\n") if body is not None else ""


def article_bodies(value: object) -> Iterator[str]:
    """All articleBody texts of a JSON value, in its order."""
    ahead = [value]
    while ahead:
        x = ahead.pop()
        if isinstance(x, dict):
            found = x.get("articleBody")
            if isinstance(found, str) and found.strip():
                yield found.strip()
            x = list(x.values())
        if isinstance(x, list):
            ahead += reversed(x)


def linked_data_body(scripts: list[str]) -> str:
    out: list[str] = []
    for s in scripts:
        try:
            out += article_bodies(json.loads(s))
        except (ValueError, RecursionError):  # no JSON, or nested beyond what its reader follows
            continue
    return "\n\n".join(out)


def extract_articles(pages: DataFrame, id_col: str = "page_id", html_col: str = "html") -> DataFrame:
    """(id, title, author, published, body) of each page; a page without a body gives that of its linked data."""
    id_type = pages.schema[id_col].dataType.simpleString()
    names = ["title", "author", "published", "body"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for html, scripts in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                root = tree_of(html or "")
                rows.append((title_of(root), author_of(root), date_of(root), body_of(root) or linked_data_body(scripts or [])))
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array([r[i] for r in rows], pa.string()) for i in range(4))], names=[id_col, *names])

    asked = pages.select(id_col, html_col, V.json_ld_scripts(F.col(html_col)).alias("scripts"))
    return asked.mapInArrow(in_slices(run, 1), f"{id_col} {id_type}, " + ", ".join(f"{n} string" for n in names))


def linked_data(pages: DataFrame, id_col: str = "page_id", html_col: str = "html") -> DataFrame:
    """(id, body) of each page: the article texts of its linked data, empty if there are none."""
    id_type = pages.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            bodies = [linked_data_body(scripts or []) for scripts in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(bodies, pa.string())], names=[id_col, "body"])

    return pages.select(id_col, V.json_ld_scripts(F.col(html_col)).alias("scripts")).mapInArrow(run, f"{id_col} {id_type}, body string")


def article_table(pages: DataFrame, id_col: str = "page_id") -> DataFrame:
    """Articles with their bodies cleaned of navigation, and the words that are left."""
    a = extract_articles(pages, id_col).withColumn("content", V.clean_web_text(F.col("body")))
    return a.select(id_col, "title", "author", "published", "content", word_count("content").alias("word_count"))


def word_count(column: str) -> Column:
    return X.word_count(F.col(column))
