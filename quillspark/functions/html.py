"""Readable text, title and links of HTML pages."""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillspark.functions.batches import pieces
from quillspark.functions.url import resolved

# Elements left out with all they hold, and elements that part paragraphs.
SKIPPED = frozenset("script style noscript nav header footer aside svg iframe template form select button".split())
BLOCKS = frozenset("p div section article h1 h2 h3 h4 h5 h6 li tr br blockquote dt dd pre figcaption".split())
# Left-out elements that end with an element around them, too, and elements that end all that is open inside.
LOOSE = frozenset("nav header footer aside form button".split())
CLOSING = LOOSE | frozenset("address article blockquote center details dialog dir div dl fieldset figcaption figure hgroup main menu ol pre section summary table ul".split())
VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())


class _Reader(HTMLParser):
    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.parts: list[str] = []
        self.title: str | None = None
        self.in_title = False
        self.links: list[str] = []
        self.skipping: list[str] = []
        self.open: list[str] = []
        self.held: Counter[str] = Counter()
        self.left_out: int | None = None  # place of the element in ``open`` with which all is left out

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        if self.skipping:
            if tag == self.skipping[-1]:
                self.skipping.append(tag)
            return
        if tag in SKIPPED - LOOSE:
            self.skipping.append(tag)
            return
        if tag in CLOSING:
            self.open.append(tag)
            self.held[tag] += 1
            if tag in LOOSE and self.left_out is None:
                self.left_out = len(self.open) - 1
        if self.left_out is not None:
            return
        given = dict(reversed(attrs))
        if tag == "title" and not (self.title or "").strip():
            self.in_title, self.title = True, ""
        elif tag == "a" and given.get("href"):
            self.links.append(given["href"])
        elif tag == "img" and (given.get("alt") or "").strip():
            self.parts.append(given["alt"].strip() + "\n\n")
        if tag in BLOCKS:
            self.parts.append("\n\n")

    def handle_startendtag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        self.handle_starttag(tag, attrs)
        if tag not in VOID:
            self.handle_endtag(tag)

    def handle_endtag(self, tag: str) -> None:
        if self.skipping:
            if tag == self.skipping[-1]:
                self.skipping.pop()
            return
        if tag in CLOSING:
            if not self.held[tag]:
                return
            ended = ""
            while ended != tag:
                ended = self.open.pop()
                self.held[ended] -= 1
            if self.left_out is not None and len(self.open) <= self.left_out:
                self.left_out = None
        if self.left_out is not None:
            return
        if tag == "title":
            self.in_title = False
        if tag in BLOCKS:
            self.parts.append("\n\n")

    def handle_data(self, data: str) -> None:
        if self.skipping or self.left_out is not None:
            return
        if self.in_title:
            self.title += data
        elif data.strip():
            self.parts.append(data.strip() + " ")


@F.arrow_udf(T.StructType([T.StructField("title", T.StringType()), T.StructField("raw", T.StringType()), T.StructField("links", T.ArrayType(T.StringType()))]))
def read_html(batches: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
    """Title, untidied text and links of a page (null: empty); ``text.tidy`` finishes the text.

    Links are absolute, in order and each once; those that don't resolve go.  A few
    pages are read at a time and leave at once, however many a batch holds.
    """

    def one(page: str | None, url: str | None) -> tuple[str, str, list[str]]:
        reader = _Reader()
        reader.feed(page or "")
        reader.close()
        links = dict.fromkeys(resolved(url, href) for href in reader.links)
        links.pop("", None)
        return (reader.title or "").strip(), "".join(reader.parts), list(links)

    for pages, urls in batches:
        for part in pieces(pages):
            read = [one(page.as_py(), url.as_py()) for page, url in zip(pages[part], urls[part], strict=True)]
            columns = [pa.array(c, t) for c, t in zip(zip(*read, strict=True), (pa.string(), pa.string(), pa.list_(pa.string())), strict=True)]
            yield pa.StructArray.from_arrays(columns, ["title", "raw", "links"])
