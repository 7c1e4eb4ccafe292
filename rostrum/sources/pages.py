"""Block text of HTML pages: blocks as paragraphs, table cells by tabs, images by their alternative text."""

from __future__ import annotations

from collections.abc import Iterator
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rostrum.functions import text

BLOCKS = {"p", "li", "dt", "dd", "tr", "h1", "h2", "h3", "h4", "h5", "h6", "div", "title", "section", "article", "table", "ul", "ol", "dl", "body", "pre", "blockquote"}


class _Blocks(HTMLParser):
    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.done, self.now, self.hidden, self.images = [], [], 0, 0

    def end(self) -> None:
        cells = "".join(self.now).split("\t")
        if block := "\t".join(" ".join(c.split()) for c in cells).strip():
            self.done.append(block)
        self.now = []

    def handle_starttag(self, tag: str, attrs: list) -> None:
        if tag in BLOCKS:
            self.end()
        elif tag in ("script", "style"):
            self.hidden += 1
        elif tag in ("td", "th") and self.now:
            self.now.append("\t")
        elif tag == "img":
            self.images += 1
            self.now.append(dict(attrs).get("alt") or "[IMAGE]")

    def handle_endtag(self, tag: str) -> None:
        if tag in BLOCKS:
            self.end()
        elif tag in ("script", "style") and self.hidden:
            self.hidden -= 1

    def handle_data(self, data: str) -> None:
        if not self.hidden:
            self.now.append(data.replace("\t", " "))


def blocks(html: str | None) -> tuple[list[str], int]:
    parser = _Blocks()
    parser.feed(html or "")
    parser.close()
    parser.end()
    return parser.done, parser.images


def block_text(pages: DataFrame) -> DataFrame:
    """page_id, n_blocks, n_images, n_words, text_sha256 of each page."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [blocks(h) for h in batch.column("html").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("page_id"), pa.array([len(b) for b, _ in found], pa.int64()), pa.array([n for _, n in found], pa.int64()), pa.array(["\n\n".join(b) for b, _ in found], pa.string())], ["page_id", "n_blocks", "n_images", "text"])

    rows = pages.select("page_id", "html").mapInArrow(run, "page_id bigint, n_blocks bigint, n_images bigint, text string")
    return rows.select("page_id", "n_blocks", "n_images", text.words(F.col("text")).cast("long").alias("n_words"), F.sha2("text", 256).alias("text_sha256"))
