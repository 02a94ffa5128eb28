"""Links of a page as a table function: rows as they are met, no array of them.

    SELECT p.url, a.* FROM pages p, LATERAL page_links(p.html) a
"""

from __future__ import annotations

from collections.abc import Iterator
from html.parser import HTMLParser

from pyspark.sql import SparkSession
from pyspark.sql.functions import udtf

from .jsonld import clean

_SILENT = frozenset(("script", "style", "template"))
#: Characters given to the parser at a time.
_CHUNK = 1 << 16


class _Reader(HTMLParser):
    """Keeps the links that are open and those that are done, nothing else of the page."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.open: list[list] = []
        self.done: list[tuple[int, str, str]] = []
        self.count = self.silent = 0

    def handle_starttag(self, tag, attrs):
        if tag in _SILENT:
            self.silent += 1
        href = dict(attrs).get("href", self)
        if tag == "a":
            # A link within a link is both, as far as its text goes; one without an address only nests.
            self.open.append([self.count if href is not self else None, clean(href) if href is not self else "", []])
            self.count += href is not self

    def handle_endtag(self, tag):
        if tag in _SILENT:
            self.silent = max(0, self.silent - 1)
        if tag == "a" and self.open:
            self._finish(self.open.pop())

    def handle_data(self, data):
        if not self.silent and (s := data.strip()):
            for link in self.open:
                link[2].append(s)

    def _finish(self, link):
        if link[0] is not None:
            self.done.append((link[0], link[1], clean(" ".join(link[2]))))

    def end(self):
        while self.open:
            self._finish(self.open.pop())


@udtf(returnType="ordinal: int, href: string, link_text: string")
class PageLinks:
    def eval(self, page: str) -> Iterator[tuple[int, str, str]]:
        reader = _Reader()
        for at in range(0, len(page or ""), _CHUNK):
            reader.feed(page[at : at + _CHUNK])
            yield from reader.done
            reader.done.clear()
        reader.close()
        reader.end()
        yield from reader.done


def register(spark: SparkSession, name: str = "page_links") -> None:
    """Make the function known to SQL."""
    spark.udtf.register(name, PageLinks)
