"""HTML operators: tag-free text and main text by the standard library's parser, as Arrow functions over whole columns."""

from __future__ import annotations

from collections.abc import Iterator
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..shared import small_batches

_MUTE = frozenset(("script", "style", "noscript", "template", "svg"))
_MAIN = ("article", "main")


class _Text(HTMLParser):
    """Text by line; what stands in article or main, and the title, are also kept apart."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.all: list[str] = []
        self.main: list[str] = []
        self.title: list[str] = []
        self.mute = self.inside = self.titled = 0

    def handle_starttag(self, tag: str, attrs: list) -> None:
        self.mute += tag in _MUTE
        self.inside += tag in _MAIN
        self.titled += tag == "title"

    def handle_endtag(self, tag: str) -> None:
        self.mute = max(0, self.mute - (tag in _MUTE))
        self.inside = max(0, self.inside - (tag in _MAIN))
        self.titled = max(0, self.titled - (tag == "title"))

    def handle_data(self, data: str) -> None:
        data = data.strip()
        if data and not self.mute:
            (self.title if self.titled else self.all).append(data)
            if self.inside:
                self.main.append(data)


def parse(html: str | None) -> tuple[str, str, str, str]:
    """(title, all text, main text, extractor): main text is the article's where it has over 50 words, else the body's."""
    p = _Text()
    p.feed(html or "")
    p.close()
    full, main = "\n".join(p.all), "\n".join(p.main)
    found = len(main.split()) > 50
    return " ".join(p.title), full, main if found else full, "article" if found else "body"


def extract(pages: DataFrame, key: str = "page_id") -> DataFrame:
    """(key, title, full_text, text, extractor) a page; null html gives empty texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in small_batches(batches, "html"):
            cols = [list(c) for c in zip(*map(parse, b.column("html").to_pylist()), strict=True)] or [[], [], [], []]
            yield pa.RecordBatch.from_arrays([b.column(key), *[pa.array(c, pa.string()) for c in cols]], [key, "title", "full_text", "text", "extractor"])

    return pages.select(F.col(key).cast("long").alias(key), "html").mapInArrow(run, f"{key} long, title string, full_text string, text string, extractor string")
