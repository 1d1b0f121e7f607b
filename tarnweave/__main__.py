"""Command line: python -m tarnweave {index,extract,audit,links,crawl} PAGES OUT, over Parquet tables of (url, html)."""

from __future__ import annotations

import argparse

from pyspark.sql import functions as F

from .operators import crawl, pages
from .session import session
from .sources import sinks


def main(argv: list[str] | None = None) -> None:
    p = argparse.ArgumentParser(prog="tarnweave", description=__doc__)
    p.add_argument("command", choices=("index", "extract", "audit", "links", "crawl"))
    p.add_argument("pages")
    p.add_argument("out")
    p.add_argument("--format", default="jsonl", choices=("json", "jsonl", "csv"))
    p.add_argument("--seed", action="append", default=[], help="where a crawl begins")
    p.add_argument("--depth", type=int, default=3)
    p.add_argument("--allow", action="append", default=[], help="a host that may be visited")
    a = p.parse_args(argv)
    spark = session(f"tarnweave-{a.command}")
    stored = spark.read.parquet(a.pages)
    jobs = {
        "index": lambda: pages.search_index(stored, ("url",)),
        "extract": lambda: pages.auto_extract(stored, ("url",)),
        "audit": lambda: pages.seo_audit(stored, ("url",)),
        "links": lambda: pages.link_graph(stored),
        "crawl": lambda: crawl.crawl(stored, a.seed, a.depth, tuple(a.allow)),
    }
    sinks.write_items(jobs[a.command]().withColumn("_timestamp", F.current_timestamp()), a.format, a.out)


if __name__ == "__main__":
    main()
