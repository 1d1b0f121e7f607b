"""Queries over pages of odd content give the rows of their SQL."""

import duckdb
import pytest

import __spark_entry__ as entry
from tests.test_queries import norm

PAGE = '<!DOCTYPE html><html><head><title>{0}</title></head><body><nav><ul><li><a href="/a">A</a></li><li><a href="/b">B</a></li></ul></nav><article><h1>{0}</h1><p>Some words of {0}</p></article><footer>&copy; h &middot; {0}</footer></body></html>'
TITLES = ("Plain title one", "Cut reference &amp;&amp", "Cut &copy", "No name &ampx; &nosuch; &", "Whole &amp;amp; &quot;two&quot;")
QUERIES = [
    "auto_extract",
    "composite_items",
    "content_rows",
    "extract_rules",
    "page_index",
    "relocate",
    "search_index",
    "seo_audit",
    "structured_data",
]


@pytest.fixture(scope="module")
def odd(spark, tmp_path_factory):
    folder = str(tmp_path_factory.mktemp("odd"))
    rows = [(i, f"https://h.example/p{min(i, 3)}", PAGE.format(t)) for i, t in enumerate(TITLES)]  # two pages share an address
    spark.createDataFrame(rows, "page_id long, url string, html string").write.parquet(f"{folder}/pages.parquet")
    return folder


@pytest.mark.parametrize("name", QUERIES)
def test_odd_pages(spark, odd, name):
    df = entry.queries()[name](spark, odd)
    c = duckdb.connect()
    c.execute(f"CREATE VIEW pages AS SELECT * FROM read_parquet('{odd}/pages.parquet/*.parquet')")
    cur = c.execute(entry.oracle_sql()[name])
    assert norm(df.collect(), df.columns) == norm(cur.fetchall(), [d[0] for d in cur.description])
