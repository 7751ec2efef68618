"""The text of pages by their elements, with all character references decoded."""

from __future__ import annotations

import re
from collections.abc import Iterator
from html.entities import html5 as entities
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from narrata.operators.batches import in_slices

#: Elements whose text isn't read.
UNREAD = frozenset(["script", "style", "head"])
#: A reference, the longest that can be read.
REFERENCE = re.compile(r"&(#[0-9]+;?|#[xX][0-9a-fA-F]+;?|[A-Za-z][A-Za-z0-9]*;?)")


class _Texts(HTMLParser):
    """The pieces of text between tags, outside unread elements; the parser's table decodes every reference there is."""

    def __init__(self, unread: frozenset[str]):
        super().__init__(convert_charrefs=True)
        self.unread, self.open = unread, {}
        self.pieces: list[list[str]] = []  # of each stretch without a tag the data that come
        self.apart = True

    def handle_starttag(self, tag: str, attrs: list) -> None:
        self.apart = True
        if tag == "body":  # a head that isn't ended ends here
            self.open.pop("head", None)
        if tag in self.unread:
            self.open[tag] = self.open.get(tag, 0) + 1

    def handle_endtag(self, tag: str) -> None:
        self.apart = True
        if self.open.get(tag, 0) > 1:
            self.open[tag] -= 1
        else:
            self.open.pop(tag, None)

    def handle_data(self, data: str) -> None:
        if not self.open:
            if self.apart:
                self.pieces.append([])
            self.pieces[-1].append(data)
            self.apart = False


def _closed_only(html: str) -> str:
    """The page with the signs escaped that begin references without a semicolon, so these are read as they stand."""
    closed = lambda name: name.endswith(";") and (name[0] == "#" or name in entities)
    return REFERENCE.sub(lambda m: m[0] if closed(m[1]) else f"&amp;{m[1]}", html)


def page_text(html: str, separator: str = " ", unread: frozenset[str] = UNREAD, unclosed: bool = True) -> str:
    """The page's text with the separator between elements and white space as single blanks. Without `unclosed` only
    references with their semicolon are decoded."""
    if not unclosed:
        html = _closed_only(html)
    parser = _Texts(unread)
    parser.feed(html)
    parser.close()
    return " ".join(separator.join(map("".join, parser.pieces)).split())


def page_texts(pages: DataFrame, separator: str = " ", head: bool = False, id_col: str = "page_id", html_col: str = "html", unclosed: bool = True) -> DataFrame:
    """(id, text) of each page; with `head` its head is read too, with an empty separator elements aren't told apart.

    A null page has an empty text; an element that is never ended goes on to the end of the page, but for a head, which
    the body ends; references without a semicolon are decoded if `unclosed`; repeated rows each get a row; an empty table gives none; other columns are ignored.
    """
    id_type = pages.schema[id_col].dataType.simpleString()
    unread = UNREAD - {"head"} if head else UNREAD

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [page_text(h or "", separator, unread, unclosed) for h in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], names=[id_col, "text"])

    return pages.select(id_col, F.col(html_col).cast("string")).mapInArrow(in_slices(run, 1), f"{id_col} {id_type}, text string")
