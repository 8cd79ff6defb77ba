"""The links of a page as a table function, for SQL."""

from __future__ import annotations

from collections import deque
from collections.abc import Iterator

from pyspark.sql import SparkSession
from pyspark.sql.functions import udtf

from orgloom.functions.html import CHROME_TAGS, Page

CHUNK = 1 << 16


class _Links(Page):
    """Hands out links as soon as they are over, in order."""

    def __init__(self) -> None:
        super().__init__(CHROME_TAGS)
        self.waiting: deque = deque()

    def handle_starttag(self, tag: str, attrs: list) -> None:
        super().handle_starttag(tag, attrs)
        if self.anchors:
            self.waiting.append(self.anchors.pop())
            self.given += 1

    def over(self) -> Iterator[tuple[int, str, str]]:
        while self.waiting and self.waiting[0][1].end is not None:
            link, own, _ = self.waiting.popleft()
            yield link["pos"], link["href"], self.text_of(own)


@udtf(returnType="pos int, href string, text string")
class ExtractLinks:
    """``pos, href, text`` of each link of a page outside its chrome, a row a link, as the page is read; a page never
    becomes an array of links. Null gives none."""

    def eval(self, html: str) -> Iterator[tuple[int, str, str]]:
        page = _Links()
        at, html = 0, html or ""
        while at < len(html):
            to = html.rfind("<", at + 1, at + CHUNK)  # text stays whole, as parts of it count as words
            to = to if to > 0 else html.find("<", at + CHUNK)
            to = to if to > 0 else len(html)
            page.feed(html[at:to])
            yield from page.over()
            at = to
        page.finish()
        yield from page.over()


def register(spark: SparkSession) -> None:
    """Makes ``extract_links(html)`` known to SQL: ``SELECT l.* FROM pages, LATERAL extract_links(html) l``."""
    spark.udtf.register("extract_links", ExtractLinks)
