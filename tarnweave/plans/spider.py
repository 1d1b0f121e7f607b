"""Spiders: user code that turns pages into items and links to follow."""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from typing import Protocol
from urllib.parse import urljoin

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.htmldom import Document, Node
from ..operators import crawl, items
from ..operators.pages import page_rows


@dataclass
class Element:
    """A matched element with its page."""

    node: Node
    page: Response

    def text(self) -> str:
        return self.node.text().strip()

    def attr(self, name: str) -> str:
        return self.node.attrs.get(name, "")

    def html(self) -> str:
        return self.node.inner_html()

    def select(self, css: str) -> list[Element]:
        return [Element(n, self.page) for n in self.page.doc.select(css, self.node)]

    def follow(self) -> str | None:
        """The absolute address the element links to."""
        href = self.attr("href")
        return urljoin(self.page.url, href) if href else None


@dataclass
class Response:
    url: str
    body: str
    doc: Document

    def select(self, css: str) -> list[Element]:
        return [Element(n, self) for n in self.doc.select(css)]


class Spider(Protocol):
    name: str
    start_urls: list[str]

    def parse(self, response: Response) -> Iterator[dict | str]:
        """Yields items (dicts) and addresses to follow (strings)."""


def run_spider(spider: Spider, pages: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(items, follows): items are (_url, _spider, fields map) with trimmed values, empty ones left out; follows are (url, parent_url)."""

    def one(url: str, raw: str, doc: Document) -> Iterator[tuple]:
        for x in spider.parse(Response(url, raw, doc)):
            if isinstance(x, str):
                yield "follow", urljoin(url, x), {}
            elif x:
                yield "item", url, {k: v if isinstance(v, str) else json.dumps(v, ensure_ascii=False) for k, v in x.items() if v is not None}

    rows = page_rows(pages.withColumn("_src", F.col("url")), "kind string, url string, fields map<string,string>", one, ("_src",))
    got = rows.where("kind = 'item' AND size(fields) > 0").select(F.col("_src").alias("_url"), F.lit(spider.name).alias("_spider"), F.transform_values("fields", lambda k, v: F.regexp_replace(v, r"(?U)^\s+|\s+$", "")).alias("fields"))
    return got, rows.where("kind = 'follow'").select("url", F.col("_src").alias("parent_url"))


class Crawler:
    """Callbacks by selector: each match gives one item, unless the callback leaves it empty."""

    def __init__(self, depth: int = 3, allow: tuple[str, ...] = (), name: str = "crawler", pipeline: items.Pipeline | None = None):
        self.depth, self.allow, self.name, self.pipeline = depth, allow, name, pipeline
        self.rules: list[tuple[str, Callable[[Element, dict], None]]] = []
        self.start_urls: list[str] = []

    def on_html(self, css: str, fn: Callable[[Element, dict], None]) -> Crawler:
        self.rules.append((css, fn))
        return self

    def parse(self, response: Response) -> Iterator[dict | str]:
        for css, fn in self.rules:
            for e in response.select(css):
                item: dict = {}
                fn(e, item)
                if item:
                    yield item

    def run(self, pages: DataFrame, *seeds: str) -> DataFrame:
        """Items of the pages reached from the seeds."""
        reached = crawl.crawl(pages, list(seeds), self.depth, self.allow)
        stored = crawl.canonical_column(pages).join(reached.select(F.col("url").alias("canonical")), "canonical", "left_semi")
        return run_spider(self, stored)[0].transform(self.pipeline or (lambda df: df))
