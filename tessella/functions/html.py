"""Text of HTML pages as Markdown, with title, links and what was left out."""

from __future__ import annotations

import re
from collections.abc import Iterator
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import DataFrame

# Elements whose text is no content; those that are a site's frame unless they lie in its content; content; elements without an end; those that end a block.
HIDDEN = {"script", "style", "noscript", "template", "svg", "iframe"}
FRAME = {"nav", "header", "footer", "aside"}
CONTENT = {"main", "article", "section"}
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
BLOCKS = {"p", "div", "section", "article", "ul", "ol", "table", "tr", "blockquote", "pre", "main", "br", "hr"}


class _Reader(HTMLParser):
    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.blocks: list[str] = []
        self.held: list[str] = []
        self.links: list[str] = []
        self.title = ""
        self.open: list[str] = []
        self.outside: int | None = None  # how many elements are open around the one that is left out
        self.in_title, self.prefix, self.dropped = False, "", 0

    def close_block(self) -> None:
        text = re.sub(r"\s+", " ", "".join(self.held)).strip()
        if text:
            self.blocks.append(self.prefix + text)
        self.held, self.prefix = [], ""

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        if tag not in VOID:
            framed = tag == "nav" or (tag in FRAME and not CONTENT & set(self.open))
            if self.outside is None and (tag in HIDDEN or framed):
                self.close_block()
                self.outside = len(self.open)
            self.open.append(tag)
        if tag in HIDDEN or tag in FRAME:
            self.close_block()
        elif tag == "title":
            self.in_title = True
        elif tag == "a":
            self.links += [v for k, v in attrs if k == "href" and v]
        elif re.fullmatch("h[1-6]", tag):
            self.close_block()
            self.prefix = "#" * int(tag[1]) + " "
        elif tag == "li":
            self.close_block()
            self.prefix = "- "
        elif tag in BLOCKS:
            self.close_block()

    def handle_endtag(self, tag: str) -> None:
        if tag in self.open:
            # An element ends with what is open in it; one that is left out ends at the latest with the one around it.
            while self.open.pop() != tag:
                pass
            if self.outside is not None and len(self.open) <= self.outside:
                self.outside = None
        if tag in HIDDEN or tag in FRAME:
            self.close_block()
        elif tag == "title":
            self.in_title = False
        elif tag in BLOCKS or tag == "li" or re.fullmatch("h[1-6]", tag):
            self.close_block()

    def handle_data(self, data: str) -> None:
        if self.in_title:
            self.title += data
        elif self.outside is not None:
            self.dropped += len(data)
        else:
            self.held.append(data)


def read(html: str | None) -> tuple[str, str, list[str], int]:
    """Title, Markdown, distinct links in order, and characters left out; a block of 80 characters or more is kept once."""
    reader = _Reader()
    reader.feed(html or "")
    reader.close()
    reader.close_block()
    seen: set[str] = set()
    kept = []
    for block in reader.blocks:
        if len(block) >= 80 and block in seen or kept and kept[-1] == block:
            continue
        seen.add(block)
        kept.append(block)
    return re.sub(r"\s+", " ", reader.title).strip(), "\n\n".join(kept), list(dict.fromkeys(reader.links)), reader.dropped


def extracted(pages: DataFrame, key: str = "page_id", html: str = "html") -> DataFrame:
    """key, title, markdown, links and dropped of each page."""
    kind = pages.schema[key].dataType.simpleString()

    def of(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = [(k, *read(h)) for k, h in zip(pdf[key], pdf[html], strict=True)]
            yield pd.DataFrame(rows, columns=[key, "title", "markdown", "links", "dropped"])

    return pages.select(key, html).mapInPandas(of, f"`{key}` {kind}, title string, markdown string, links array<string>, dropped long")
