"""HTML to blocks, links and headings: a parser per row, in Arrow batches."""

from __future__ import annotations

from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import DataFrame

BLOCKS = {"h1", "h2", "h3", "h4", "h5", "h6", "p", "li", "blockquote", "td", "th", "pre", "title", "div", "article", "section"}
SKIP = {"script", "style", "noscript", "template"}
ASIDE = {"nav", "footer", "aside", "header"}


class BlockParser(HTMLParser):
    """Text blocks in order: (tag, text, aside), and links (href, text). Unclosed tags end at the next block."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.blocks: list[tuple[str, str, bool]] = []
        self.links: list[tuple[str, str]] = []
        self.tag, self.text = "body", []
        self.skip, self.aside, self.ads = 0, 0, 0
        self.href: str | None = None
        self.anchor: list[str] = []

    def flush(self) -> None:
        text = " ".join("".join(self.text).split())
        if text:
            self.blocks.append((self.tag, text, bool(self.aside or self.ads)))
        self.text = []

    def handle_starttag(self, tag, attrs):
        attr = dict(attrs)
        if tag in SKIP:
            self.skip += 1
        if tag in ASIDE:
            self.flush()
            self.aside += 1
        if tag in BLOCKS:
            self.flush()
            self.tag = tag
            self.ads = int(tag == "div" and "ad" in (attr.get("class") or "").split())
        if tag == "br":
            self.text.append(" ")
        if tag == "a":
            self.href, self.anchor = attr.get("href"), []

    def handle_endtag(self, tag):
        if tag in SKIP:
            self.skip = max(0, self.skip - 1)
        if tag in BLOCKS or tag in ASIDE:
            self.flush()
            self.tag = "body"
            self.ads = 0 if tag == "div" else self.ads
        if tag in ASIDE:
            self.aside = max(0, self.aside - 1)
        if tag == "a" and self.href is not None:
            self.links.append((self.href, " ".join("".join(self.anchor).split())))
            self.href = None

    def handle_data(self, data):
        if not self.skip:
            self.text.append(data)
            if self.href is not None:
                self.anchor.append(data)


def parse(html: str | None) -> BlockParser:
    p = BlockParser()
    p.feed(html or "")
    p.close()
    p.flush()
    return p


def html_blocks(pages: DataFrame, key: str = "page_id", html: str = "html") -> DataFrame:
    """key, block_no, tag, text, aside: the text blocks of each page. Null pages have none."""

    def run(batches):
        for b in batches:
            rows = [(k, i, *x) for k, h in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True) for i, x in enumerate(parse(h).blocks)]
            cols = list(zip(*rows, strict=True)) or [[]] * 5
            kinds = [b.schema.field(0).type, pa.int64(), pa.string(), pa.string(), pa.bool_()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds, strict=True)], names=[key, "block_no", "tag", "text", "aside"])

    return pages.select(key, html).mapInArrow(run, f"{key} {pages.schema[key].dataType.simpleString()}, block_no long, tag string, text string, aside boolean")


def html_links(pages: DataFrame, key: str = "page_id", html: str = "html") -> DataFrame:
    """key, link_no, href, text."""

    def run(batches):
        for b in batches:
            rows = [(k, i, *x) for k, h in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True) for i, x in enumerate(parse(h).links)]
            cols = list(zip(*rows, strict=True)) or [[]] * 4
            kinds = [b.schema.field(0).type, pa.int64(), pa.string(), pa.string()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds, strict=True)], names=[key, "link_no", "href", "text"])

    return pages.select(key, html).mapInArrow(run, f"{key} {pages.schema[key].dataType.simpleString()}, link_no long, href string, text string")
