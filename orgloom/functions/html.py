"""HTML pages read once by the standard parser, as one Arrow-batched function that gives a struct."""

from __future__ import annotations

import bisect
import json
import re
from collections import Counter
from collections.abc import Iterator
from html.parser import HTMLParser

import pandas as pd
import pyarrow as pa
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from orgloom.functions.dates import DEADLINE_HINT

_S = T.StringType()


def _struct(*fields: tuple[str, T.DataType]) -> T.StructType:
    return T.StructType([T.StructField(n, t) for n, t in fields])


#: ``row`` is the place in ``rows`` of the link's nearest row, or of the link itself where it stands in none.
LINK = _struct(("pos", T.IntegerType()), ("href", _S), ("text", _S), ("alt", _S), ("row", T.IntegerType()))
#: ``deadline`` says that a deadline's cue stands in the time or in the element around it.
TIME = _struct(("datetime", _S), ("deadline", T.BooleanType()))
ROW = _struct(("text", _S), ("times", T.ArrayType(TIME)))
POSTING = T.ArrayType(_struct(("title", _S), ("url", _S), ("location", _S), ("posted", _S), ("deadline", _S)))
PAGE = _struct(
    ("title", _S), ("text", _S), ("links", T.ArrayType(LINK)), ("rows", T.ArrayType(ROW)), ("metas", T.ArrayType(_struct(("key", _S), ("content", _S)))),
    ("scripts", T.ArrayType(_S)), ("postings", POSTING), ("listed", POSTING),
)
_VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
_ROWS = frozenset(("li", "article", "tr", "div"))
_DEADLINE = re.compile(DEADLINE_HINT)
CHROME_TAGS = frozenset(("script", "style", "nav", "footer", "header", "noscript"))


class _Element:
    """An element that is or was open: where its text begins and ends, and its place in the order of tags."""

    def __init__(self, tag: str, start: int, number: int):
        self.tag, self.start, self.number = tag, start, number
        self.end = self.last = None

    def close(self, end: int, last: int) -> None:
        if self.end is None:
            self.end, self.last = end, last


class Page(HTMLParser):
    """Collects title, text outside chrome, anchors with their nearest rows, times, metas and JSON scripts."""

    def __init__(self, drop: frozenset[str]):
        super().__init__(convert_charrefs=True)
        self.drop = drop
        self.title: list[str] = []
        self.text: list[str] = []
        self.anchors: list[tuple[dict, _Element, _Element]] = []
        self.metas: list[dict] = []
        self.scripts: list[list[str]] = []
        self.open: list[_Element] = []
        self.open_rows: list[_Element] = []
        self.opened: Counter[str] = Counter()
        self.times: list[tuple[str, _Element, _Element | None]] = []
        self.hidden = self.tags = self.given = 0
        self.anchor: dict | None = None
        self.json = False

    def updatepos(self, i: int, j: int) -> int:
        """Lines and columns are not asked for."""
        return j

    def handle_starttag(self, tag: str, attrs: list) -> None:
        a = {k: v or "" for k, v in attrs}
        if tag == "meta":
            key = a.get("property") or a.get("name") or a.get("itemprop")
            if key and a.get("content"):
                self.metas.append({"key": key, "content": a["content"]})
        if tag == "img" and self.anchor is not None and not self.anchor["alt"]:
            self.anchor["alt"] = a.get("alt", "")
        if tag in _VOID:
            return
        self.tags += 1
        own = _Element(tag, len(self.text), self.tags)
        if tag == "time" and a.get("datetime"):
            self.times.append((a["datetime"], own, self.open[-1] if self.open else None))
        self.open.append(own)
        self.opened[tag] += 1
        if tag in _ROWS:
            self.open_rows.append(own)
        self.hidden += tag in self.drop
        if tag == "script":
            self.json = "ld+json" in a.get("type", "")
            self.scripts.append([])
        if tag == "a" and "href" in a and not self.hidden:
            row = self.open_rows[-1] if self.open_rows else own
            self.anchor = {"pos": self.given + len(self.anchors), "href": a["href"], "text": "", "alt": ""}
            self.anchors.append((self.anchor, own, row))

    def handle_endtag(self, tag: str) -> None:
        if tag == "a":
            self.anchor = None
        while self.opened[tag]:  # what is open inside ends as well
            e = self.open.pop()
            self.opened[e.tag] -= 1
            if e.tag in _ROWS:
                self.open_rows.pop()
            self.hidden -= e.tag in self.drop
            e.close(len(self.text), self.tags)
            if e.tag == tag:
                break

    def handle_data(self, data: str) -> None:
        if self.open and self.open[-1].tag == "script":
            if self.json or "JobPosting" in data:
                self.scripts[-1].append(data)
        elif self.open and self.open[-1].tag == "title":
            self.title.append(data)
            self.text.append(data)
        elif not self.hidden:
            self.text.append(data)

    def text_of(self, e: _Element) -> str:
        return " ".join(" ".join(self.text[e.start : e.end]).split())

    def finish(self) -> None:
        """The page is over, and so is what is still open."""
        self.close()
        for e in self.open:
            e.close(len(self.text), self.tags)

    def result(self) -> dict:
        self.finish()
        parents = {id(p): p for _, _, p in self.times if p is not None}
        around = {k: bool(_DEADLINE.search(self.text_of(p))) for k, p in parents.items()}
        times = [(e.number, {"datetime": at, "deadline": around.get(id(p), False) or bool(_DEADLINE.search(self.text_of(e)))}) for at, e, p in self.times]
        numbers = [n for n, _ in times]
        rows: dict[int, int] = {}
        found, links = [], []
        for link, own, row in self.anchors:
            if id(row) not in rows:
                rows[id(row)] = len(found)
                inside = times[bisect.bisect_left(numbers, row.number) : bisect.bisect_right(numbers, row.last)]
                found.append({"text": self.text_of(row), "times": [t for _, t in inside]})
            links.append(link | {"text": self.text_of(own), "row": rows[id(row)]})
        scripts = [x for x in map("".join, self.scripts) if x]
        return {
            "title": " ".join("".join(self.title).split()), "text": " ".join(" ".join(self.text).split()), "links": links, "rows": found, "metas": self.metas, "scripts": scripts,
            "postings": [p for x in scripts for p in find_postings(x)], "listed": [p for x in scripts for p in find_postings(x, nested=False)],
        }


def read_page(html: str | None, drop: frozenset[str] = CHROME_TAGS) -> dict:
    """What a page holds; an empty page for null."""
    page = Page(drop)
    page.feed(html or "")
    return page.result()


@F.arrow_udf(PAGE)
def parse_page(pages: Iterator[pa.Array]) -> Iterator[pa.Array]:
    """Title, text, links in order and their rows, metas, JSON-LD scripts and their postings: all of HTML, read once."""
    kind = to_arrow_type(PAGE)
    for part in pages:
        yield pa.array([read_page(x.as_py()) for x in part], type=kind)


parse_page = parse_page.asNondeterministic()  # or a filter on its links is moved below it, with a second reading of its own


_TYPE = re.compile(r'"@type"\s*:\s*"JobPosting"')
_TITLE = re.compile(r'"title"\s*:\s*"([^"]{5,120})"')


def _text(x: object) -> str:
    return " ".join(x.split()) if isinstance(x, str) else ""


def _posting(item: dict) -> dict:
    place = item.get("jobLocation") or {}
    place = (place[0] if place else {}) if isinstance(place, list) else place
    address = place.get("address") or {} if isinstance(place, dict) else {}
    city = address if isinstance(address, str) else address.get("addressLocality") or address.get("addressRegion") or ""
    return {
        "title": _text(item.get("title") or item.get("name")), "url": _text(item.get("url") or item.get("sameAs")), "location": _text(city),
        "posted": str(item.get("datePosted") or "")[:10], "deadline": str(item.get("validThrough") or "")[:10],
    }


def find_postings(script: str | None, nested: bool = True) -> list[dict]:
    """The postings of a JSON-LD script: at any depth, the last met first, or only in its usual wrappers, in order.

    A script that isn't valid gives, at any depth, the titles that stand near the type's name.
    """
    try:
        data = json.loads((script or "null").strip())
    except ValueError:
        near = [m for part in _TYPE.split(script or "")[1:] if (m := _TITLE.search(part[:400]))] if nested else []
        return [_posting({"title": m[1]}) for m in near]
    found: list[dict] = []
    if nested:
        todo = [data]
        while todo:
            node = todo.pop()
            if isinstance(node, dict):
                if node.get("@type") == "JobPosting":
                    found.append(_posting(node))
                todo += list(node.values())
            elif isinstance(node, list):
                todo += node
        return found
    items = list(data) if isinstance(data, list) else [data]
    for item in list(items):
        if isinstance(item, dict):
            graph = item.get("@graph", [])
            items += graph if isinstance(graph, list) else [graph]
            items += [e.get("item", e) for e in item.get("itemListElement") or [] if isinstance(e, dict)]
    return [_posting(x) for x in items if isinstance(x, dict) and x.get("@type") == "JobPosting" and _text(x.get("title"))]


@F.pandas_udf(POSTING)
def postings(scripts: Iterator[pd.Series]) -> Iterator[pd.Series]:
    """Postings at any depth of each script."""
    for part in scripts:
        yield pd.Series([find_postings(x) for x in part])


@F.pandas_udf(POSTING)
def listed_postings(scripts: Iterator[pd.Series]) -> Iterator[pd.Series]:
    """Postings in the usual wrappers of each script."""
    for part in scripts:
        yield pd.Series([find_postings(x, nested=False) for x in part])
