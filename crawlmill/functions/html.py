"""One pass over HTML that emits facts; what they mean is decided by Spark expressions."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Attributes that hold links, by tag.
LINK_ATTRIBUTES = {"a": "href", "img": "src", "form": "action", "script": "src", "iframe": "src", "div": "src", "frame": "src", "embed": "src", "link": "href"}
_VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr"}
_ENDS = {"p": {"p"}, "li": {"li"}, "td": {"td", "th"}, "th": {"td", "th"}, "tr": {"tr", "td", "th"}}
_HEAD = {"head", "title", "meta", "base"}


class _Facts(HTMLParser):
    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.open: list[str] = []
        self.links: list[dict] = []
        self.words: list[str] = []
        self.titles: list[str] = []
        self.anchors: list[dict] = []
        self.headers: list[str] = []
        self.cells: list[str] = []
        self.rows_of_table: list[int] = []
        self.took: list[tuple[str, list]] = []

    def handle_starttag(self, tag, attrs):
        while self.open and self.open[-1] in _ENDS.get(tag, ()):
            self._close(self.open[-1])
        values = dict(attrs)
        if (name := LINK_ATTRIBUTES.get(tag)) and values.get(name) is not None:
            self.links.append({"tag": tag, "value": values[name]})
        if tag in _VOID:
            return
        self.open.append(tag)
        if tag == "table":
            self.rows_of_table.append(0)
        elif tag == "tr" and self.rows_of_table:
            self.rows_of_table[-1] += 1
        first = not self.rows_of_table or self.rows_of_table[-1] <= 1
        if tag in ("title", "th") or (tag == "td" and first) or tag == "a":
            self.took.append((tag, [values.get("href")]))

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs)
        if tag not in _VOID:
            self.handle_endtag(tag)

    def handle_endtag(self, tag):
        if tag in self.open:
            while self.open[-1] != tag:
                self._close(self.open[-1])
            self._close(tag)

    def _close(self, tag: str) -> None:
        self.open.pop()
        if tag == "table" and self.rows_of_table:
            self.rows_of_table.pop()
        if self.took and self.took[-1][0] == tag:
            kind, parts = self.took.pop()
            text = "".join(parts[1:]).strip()
            if kind == "a":
                self.anchors.append({"href": parts[0], "text": text})
            else:
                {"title": self.titles, "th": self.headers, "td": self.cells}[kind].append(text)

    def _text(self, data: str) -> None:
        parent = self.open[-1] if self.open else "body"
        if data.strip() and parent not in ("script", "style") and not _HEAD & set(self.open):
            self.words.append(data.strip())

    def handle_data(self, data):
        for _, parts in self.took:
            parts.append(data)
        self._text(data)

    def handle_comment(self, data):
        self._text(data)

    def facts(self) -> dict:
        while self.open:
            self._close(self.open[-1])
        return {"links": self.links, "visible_text": " ".join(self.words), "titles": self.titles, "anchors": self.anchors, "headers": self.headers, "cells": self.cells}


_FACTS = pa.schema([
    ("links", pa.list_(pa.struct([("tag", pa.string()), ("value", pa.string())]))), ("visible_text", pa.string()), ("titles", pa.list_(pa.string())),
    ("anchors", pa.list_(pa.struct([("href", pa.string()), ("text", pa.string())]))), ("headers", pa.list_(pa.string())), ("cells", pa.list_(pa.string())),
])
_DDL = {
    "links": "links array<struct<tag:string,value:string>>", "visible_text": "visible_text string", "titles": "titles array<string>",
    "anchors": "anchors array<struct<href:string,text:string>>", "headers": "headers array<string>", "cells": "cells array<string>",
}


def facts_of(html: str | None) -> dict:
    parser = _Facts()
    parser.feed(html or "")
    parser.close()
    return parser.facts()


#: Bytes of an Arrow batch of pages, and pages that are taken apart together: a worker holds the facts of no more.
BATCH_BYTES, TOGETHER = 2 << 20, 64


def html_facts(pages: DataFrame, key: str, html: str = "text", names: Sequence[str] = tuple(_FACTS.names)) -> DataFrame:
    """key, links, visible_text, titles, anchors, headers (th) and cells (td of first rows) of each page, or those named."""
    kind, held = dict(pages.dtypes)[key], pa.schema([_FACTS.field(n) for n in names])
    pages.sparkSession.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, b.num_rows, TOGETHER):
                some = b.slice(at, TOGETHER)
                found = [facts_of(t.as_py()) for t in some.column(1)]
                found = pa.RecordBatch.from_pylist([{n: f[n] for n in names} for f in found], held)
                yield pa.RecordBatch.from_arrays([some.column(0), *found.columns], [key, *names])

    return pages.select(key, F.col(html)).mapInArrow(run, f"{key} {kind}, {', '.join(_DDL[n] for n in names)}")
