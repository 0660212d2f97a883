"""Stored html as data: a page is read once, into its text and an array of its elements.

One linear walk over the tags gives every element its tag, classes and attributes, its place in
page order, the place where it ends, and the part of the page's text that it covers. From
there on selectors are filters of that array, "inside" is a slice of it, and the text of an
element is a substring, all of them Spark's own functions.

An element ends at its own closing tag: tags of other names between the two don't matter, and an
element that is never closed reaches to the end of the page. A link or button also ends where
the next one begins. Comments, scripts and styles are no content. A tag that the page ends
in, or whose quote is never closed, ends the page. Entities are decoded in texts and attributes: an
unknown name, and a name without its semicolon, stays as it is, and a number that names no
character gives U+FFFD. Names are compared in lower case, classes as they are; of two attributes
with one name the first counts.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from html.entities import html5

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..functions.text import trim_all
from ..session import ship_package

PAGE = (
    "struct<text: string, elements: array<struct<tag: string, classes: array<string>, "
    "attrs: map<string, string>, at: int, end: int, t0: int, t1: int, closed: boolean>>>"
)

_ATTRIBUTE = r"""[\s/]*+([^\s/>][^\s/>=]*+)(?:\s*+=\s*+(?:"([^"]*+)"|'([^']*+)'|([^\s>]*+)))?+"""
_ATTRIBUTES = re.compile(_ATTRIBUTE)
_TAG = re.compile(rf"<(/?)([a-zA-Z][^\s/>]*+)((?:{_ATTRIBUTE})*+)[\s/]*+>")
_OTHER = re.compile(r"<!--.*?(?:-->|\Z)|<[!?/][^>]*+(?:>|\Z)", re.DOTALL)
_BARE_TAG = re.compile(r"<(/?)([a-zA-Z][^\s/>]*+)>")
_OPENS = re.compile(r"<(?=[a-zA-Z!?/])")
_ENTITY = re.compile(r"&(#[xX][0-9a-fA-F]+|#[0-9]+|[a-zA-Z][a-zA-Z0-9]*);")
_HIDDEN = {"script", "style"}
_ALONE = {"a", "button"}  # never inside one another
_NOTHING: dict[str, str] = {}

PIECE = 1 << 19  # bytes of html whose elements a worker holds at once; a longer page is held alone


def _character(match: re.Match) -> str:
    name = match[1]
    if name[0] != "#":
        return html5.get(f"{name};", match[0])
    digits = (name[2:] if name[1] in "xX" else name[1:]).lstrip("0") or "0"
    if len(digits) > 8:
        return "�"
    code = int(digits, 16 if name[1] in "xX" else 10)
    good = 0 < code <= 0x10FFFF and not 0xD800 <= code <= 0xDFFF
    return chr(code) if good else "�"


def decoded(text: str) -> str:
    return _ENTITY.sub(_character, text) if "&" in text else text


def _attributes(text: str) -> dict[str, str]:
    found: dict[str, str] = {}
    for m in _ATTRIBUTES.finditer(text):
        found.setdefault(m[1].lower(), decoded(m[2] or m[3] or m[4] or ""))
    return found


def read(html: str) -> tuple[str, list[list]]:
    """Text and elements of a page, in time linear in its length."""
    elements: list[list] = []
    pieces: list[str] = []
    size = at = 0
    open_by_tag: dict[str, list[int]] = {}
    for start in iter(lambda: _OPENS.search(html, at), None):
        start = start.start()
        if start > at:
            text = decoded(html[at:start])
            pieces.append(text)
            size += len(text)
        m = _BARE_TAG.match(html, start) or _TAG.match(html, start)
        if m is None:
            other = _OTHER.match(html, start)
            at = other.end() if other else len(html)  # a tag that never ends
            continue
        at, tag = m.end(), m[2].lower()
        if m[1] or tag in _ALONE:
            names = open_by_tag.get(tag)
            if names:
                element = elements[names.pop()]
                element[4], element[6], element[7] = len(elements), size, True
            if m[1]:
                continue
        attributes = _attributes(m[3]) if m.re is _TAG and m[3] else _NOTHING
        if tag in open_by_tag:
            open_by_tag[tag].append(len(elements))
        else:
            open_by_tag[tag] = [len(elements)]
        classes = attributes["class"].split() if "class" in attributes else []
        elements.append([tag, classes, attributes, len(elements), None, size, None, False])
        if tag in _HIDDEN:
            end = re.compile(rf"</{tag}(?=[\s/>])", re.IGNORECASE).search(html, at)
            at = end.start() if end else len(html)
    if at < len(html):
        text = decoded(html[at:])
        pieces.append(text)
        size += len(text)
    for element in elements:
        if element[4] is None:
            element[4], element[6] = len(elements), size
    return "".join(pieces), elements


def _lists(rows: list[list], kind: pa.DataType) -> pa.ListArray:
    sizes = np.fromiter((len(r) for r in rows), dtype=np.int32, count=len(rows))
    offsets = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array([v for r in rows for v in r], kind))


def _pieces(pages: pa.Array) -> Iterator[tuple[int, int]]:
    """First row and number of rows of parts that hold PIECE bytes of html each, or one page."""
    ends = np.cumsum(pc.fill_null(pc.binary_length(pages), 0).to_numpy(zero_copy_only=False), dtype=np.int64)
    at = done = 0
    while at < len(ends):
        end = max(int(np.searchsorted(ends, done + PIECE, side="right")), at + 1)
        yield at, end - at
        at, done = end, int(ends[end - 1])


def _column(pages: pa.Array) -> pa.StructArray:
    """Arrow column of pages from one of html texts; a null text is a page without elements."""
    texts, rows = [], []
    for html in pages.to_pylist():
        text, elements = read(html or "")
        texts.append(text)
        rows.append(elements)
    flat = [e for r in rows for e in r]
    keys = _lists([list(e[2]) for e in flat], pa.string())
    attributes = pa.MapArray.from_arrays(keys.offsets, keys.values, pa.array([v for e in flat for v in e[2].values()], pa.string()))
    names = ["tag", "classes", "attrs", "at", "end", "t0", "t1", "closed"]
    columns = [
        pa.array([e[0] for e in flat], pa.string()), _lists([e[1] for e in flat], pa.string()), attributes,
        *(pa.array([e[k] for e in flat], pa.int32()) for k in (3, 4, 5, 6)),
        pa.array([e[7] for e in flat], pa.bool_()),
    ]
    offsets = np.concatenate([[0], np.cumsum([len(r) for r in rows])]).astype(np.int32)
    listed = pa.ListArray.from_arrays(pa.array(offsets), pa.StructArray.from_arrays(columns, names))
    return pa.StructArray.from_arrays([pa.array(texts, pa.string()), listed], ["text", "elements"])


def _read_batches(batches: Iterator[pa.RecordBatch], names: list[str]) -> Iterator[pa.RecordBatch]:
    """The columns ``names`` and ``page``; a batch comes back in as many pieces as its html has."""
    for batch in batches:
        html = batch.column(batch.schema.get_field_index("html"))
        same = [batch.column(batch.schema.get_field_index(n)) for n in names]
        for at, count in _pieces(html):
            kept = [c.slice(at, count) for c in same]
            yield pa.RecordBatch.from_arrays([*kept, _column(html.slice(at, count))], names=[*names, "page"])


def with_page(pages: DataFrame, keep_html: bool = False) -> DataFrame:
    """``pages`` with a column ``page`` instead of ``html`` (or beside it).

    A step of its own, so that nothing later reads a page again. The elements of a page take many
    times its bytes, so a batch is read piece by piece.
    """
    ship_package(pages.sparkSession)  # workers need not have this package installed
    kept = [f for f in pages.schema.fields if keep_html or f.name != "html"]
    names = [f.name for f in kept]

    schema = StructType([*kept, *StructType.fromDDL(f"page {PAGE}").fields])
    return pages.mapInArrow(lambda batches: _read_batches(batches, names), schema)


def _matches(e: Column, tag: str | None, classes: tuple[str, ...], attr: str | None) -> Column:
    tests = [F.array_contains(e["classes"], c) for c in classes]
    if tag:
        tests.append(e["tag"] == tag)
    if attr:
        tests.append(F.map_contains_key(e["attrs"], F.lit(attr)))
    found = F.lit(True)
    for test in tests:
        found = found & test
    return found


def select(elements: Column, tag: str | None = None, *classes: str, attr: str | None = None) -> Column:
    """The elements with a tag, all ``classes`` and an attribute, as far as they are given."""
    return F.filter(elements, lambda e: _matches(e, tag, classes, attr))


def first(elements: Column, tag: str | None = None, *classes: str, attr: str | None = None) -> Column:
    """The first such element, null if there is none."""
    return F.get(select(elements, tag, *classes, attr=attr), F.lit(0))


def inside(page: Column, element: Column) -> Column:
    """All elements inside an element; none if that is null."""
    found = F.slice(page["elements"], element["at"] + 2, element["end"] - element["at"] - 1)
    return F.coalesce(found, F.slice(page["elements"], 1, 0))


def text_between(page: Column, start: Column, end: Column) -> Column:
    return F.substring(page["text"], start + 1, F.greatest(end - start, F.lit(0)))


def text_of(page: Column, element: Column) -> Column:
    """Text of an element and all inside it, spaces at the ends cut; empty if it is null."""
    return F.coalesce(trim_all(text_between(page, element["t0"], element["t1"])), F.lit(""))


def text_without(page: Column, element: Column, tag: str) -> Column:
    """Text of an element without that of the ``tag`` elements inside it."""
    start = F.struct(element["t0"].alias("at"), F.lit("").alias("text"))

    def step(done: Column, gap: Column) -> Column:
        return F.struct(
            F.greatest(done["at"], gap["t1"]).alias("at"),
            F.concat(done["text"], text_between(page, done["at"], gap["t0"])).alias("text"),
        )

    before = F.aggregate(select(inside(page, element), tag), start, step)
    rest = text_between(page, before["at"], element["t1"])
    return F.coalesce(trim_all(F.concat(before["text"], rest)), F.lit(""))


def attribute(element: Column, name: str) -> Column:
    """Value of an attribute, empty if it (or the element) is absent."""
    return F.coalesce(F.try_element_at(element["attrs"], F.lit(name)), F.lit(""))


def has_attribute(element: Column, name: str) -> Column:
    return F.coalesce(F.map_contains_key(element["attrs"], F.lit(name)), F.lit(False))
