"""The outline of web pages: each run of text with the elements that stand open around it, by a fold over the tags.

A start tag opens an element, but for void ones; an end tag closes the nearest open one of its name and what is open in it, or
nothing; a block closes an open paragraph, a list item an open item of its list. Comments and declarations are no text, what
stands in scripts and styles is skipped up to their own end tag. A null or empty page has no text; a page is one row, read once.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Elements without content, those whose content is no markup, and those that end a paragraph.
VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
RAW = ("script", "style")
BLOCKS = frozenset("address article aside blockquote div dl fieldset figure footer form h1 h2 h3 h4 h5 h6 header hr main nav ol p pre section table ul".split())
TAG = re.compile(r"<!--.*?(?:-->|$)|<[!?][^>]*>|<(/?)([a-zA-Z][^\s/>]*)(?:[^>\"']|\"[^\"]*\"|'[^']*')*>", re.S)


def opened(stack: list[str], name: str) -> None:
    """The stack after a start tag of that name."""
    if name in BLOCKS and "p" in stack:
        del stack[_last(stack, "p") :]
    if name == "li" and "li" in stack and _last(stack, "li") > max(_last(stack, "ul"), _last(stack, "ol")):
        del stack[_last(stack, "li") :]
    if name not in VOID:
        stack.append(name)


def closed(stack: list[str], name: str) -> None:
    if name in stack:
        del stack[_last(stack, name) :]


def _last(stack: list[str], name: str) -> int:
    return len(stack) - 1 - stack[::-1].index(name) if name in stack else -1


def texts(page: str) -> Iterator[tuple[str, str]]:
    """(path, text) of each run of text between two tags, white space squeezed, without empty ones."""
    stack: list[str] = []
    at = 0
    while at < len(page):
        m = TAG.search(page, at)
        end = m.start() if m else len(page)
        text = " ".join(html.unescape(page[at:end]).split())
        if text:
            yield "/".join(stack), text
        if not m:
            return
        at = m.end()
        if m[2]:
            name = m[2].lower()
            (closed if m[1] else opened)(stack, name)
            if name in RAW and not m[1]:
                stop = re.compile(rf"</{name}\s*>", re.I).search(page, at)
                at = stop.start() if stop else len(page)


def outline(pages: DataFrame, key: str = "page_id", page: str = "html") -> DataFrame:
    """(key, place, path, text), places from 0."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [(k, i, *x) for k, p in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True) for i, x in enumerate(texts(p or ""))]
            if rows:
                kinds = [batch.schema.field(0).type, pa.int32(), pa.string(), pa.string()]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], [key, "place", "path", "text"])

    return pages.select(F.col(key), F.col(page)).mapInArrow(run, f"{key} {pages.schema[key].dataType.simpleString()}, place int, path string, text string")
