"""Text of raw web pages."""

from __future__ import annotations

import io
import posixpath
import zipfile
from collections.abc import Iterator
from html.parser import HTMLParser
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Elements whose text is no prose, and elements that end a line.
SKIPPED = frozenset(("script", "style", "nav", "noscript", "template", "svg", "head"))
BLOCKS = frozenset(("p", "div", "br", "li", "ul", "ol", "h1", "h2", "h3", "h4", "h5", "h6", "tr", "table", "section", "article", "header", "footer", "blockquote", "pre"))


class _Text(HTMLParser):
    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.lines, self.title, self.depth, self.in_title, self.lang = [[]], [], 0, False, ""

    def handle_starttag(self, tag, attrs):
        if tag == "html":
            self.lang = dict(attrs).get("lang") or ""
        self.depth += tag in SKIPPED
        self.in_title = self.in_title or tag == "title"
        if tag in BLOCKS:
            self.lines.append([])

    def handle_endtag(self, tag):
        self.depth = max(0, self.depth - (tag in SKIPPED))
        if tag == "title":
            self.in_title = False
        if tag in BLOCKS:
            self.lines.append([])

    def handle_data(self, data):
        if self.in_title:
            self.title.append(data)
        elif not self.depth:
            self.lines[-1].append(data)


def page_text(html: str) -> tuple[str, str, str]:
    """(language, title, text) of a page; text in lines, one for each block, white space collapsed."""
    p = _Text()
    p.feed(html)
    p.close()
    lines = (" ".join("".join(x).split()) for x in p.lines)
    return p.lang, " ".join("".join(p.title).split()), "\n".join(x for x in lines if x)


def html_text(pages: DataFrame) -> DataFrame:
    """(page_id, lang, title, text) of pages (page_id, html); a null page has empty parts."""

    def run(batch: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batch:
            got = [page_text(h or "") for h in pdf["html"]]
            yield pd.DataFrame({"page_id": pdf["page_id"], "lang": [g[0] for g in got], "title": [g[1] for g in got], "text": [g[2] for g in got]})

    return pages.select("page_id", "html").mapInPandas(run, "page_id long, lang string, title string, text string")


def epub_pages(data: bytes) -> list[str]:
    """The texts of an EPUB's pages in reading order: the spine of its package, each file as page_text reads it."""
    book = zipfile.ZipFile(io.BytesIO(data))
    tag = lambda e: e.tag.rpartition("}")[2]
    container = ElementTree.fromstring(book.read("META-INF/container.xml"))
    root = next(e.get("full-path") for e in container.iter() if tag(e) == "rootfile")
    package = ElementTree.fromstring(book.read(root))
    files = {e.get("id"): e.get("href") for e in package.iter() if tag(e) == "item"}
    order = [files[e.get("idref")] for e in package.iter() if tag(e) == "itemref" and e.get("idref") in files]
    return [page_text(book.read(posixpath.join(posixpath.dirname(root), f)).decode("utf-8", "replace"))[2] for f in order]


def norm_title(title: Column) -> Column:
    """The key of a title: letters and digits in lower case, without a leading English article."""
    return F.regexp_replace(F.regexp_replace(F.lower(title), r"^(the|a|an)\s+", ""), r"[^\p{L}\p{N}]", "")


def twin_candidates(stories: DataFrame, english: DataFrame) -> DataFrame:
    """(id, twin): stories (id, original) with the English ones (id, title) of the same title as their original's."""
    a = stories.select("id", norm_title(F.col("original")).alias("k"))
    b = english.select(F.col("id").alias("twin"), norm_title(F.col("title")).alias("k"))
    return a.filter("k <> ''").join(b, "k").select("id", "twin")
