"""What shows with size: work on a page grows with the page, not with its square, and large numbers keep their digits."""

import time

import duckdb
from pyspark.sql import functions as F

from tarnweave.functions import extract, htmldom, text
from tarnweave.functions.htmldom import parse
from tarnweave.plans.recipes import RECIPES


def growth(page, work, n):
    """How much longer eight times the entries take, processor time: 8 in proportion, 64 by the square."""

    def spent(k):
        doc = parse(page(k))
        start = time.process_time()
        assert work(doc) == k
        return time.process_time() - start

    return min(spent(8 * n) for _ in range(2)) / min(spent(n) for _ in range(3))


def test_recipe_reads_a_long_page_in_proportion():
    box = '<div class="quote"><span class="text">a</span><small class="author">b</small><a class="tag">t</a><a class="tag">x</a></div>'

    def work(doc):
        return sum(all(doc.select(css, q) for css, _ in RECIPES["quotes"].fields.values()) for q in doc.select(".quote"))

    assert growth(lambda k: box * k, work, 600) < 24


def test_products_of_a_long_page_in_proportion():
    card = '<div class="product-card"><h2>n</h2><a href="/p">more</a><i>only $1.00 now</i></div>'
    assert growth(lambda k: card * k, lambda doc: len(extract.products(doc)), 300) < 24


def test_sizes_of_large_numbers_round_as_printf_does(spark):
    n = [0, 1023, 1024, 1126, 1075, 1177, 1280, 1331, 1048575, 1048576, 1 << 30, (1 << 30) + (1 << 28), (1 << 30) + 3 * (1 << 28), (1 << 63) - 1, (1 << 63) - 1500]
    n += [k**3 for k in range(100_003, 2_000_000, 997)]
    df = spark.createDataFrame([(v,) for v in n], "n long")
    got = [r.s for r in df.select("n", text.human_bytes(F.col("n")).alias("s")).orderBy("n").collect()]
    sql = "SELECT CASE WHEN n < 1024 THEN printf('%d B', n) WHEN n < 1048576 THEN printf('%.1f KB', n / 1024.0) WHEN n < 1073741824 THEN printf('%.1f MB', n / 1048576.0) ELSE printf('%.1f GB', n / 1073741824.0) END FROM (SELECT unnest(?::BIGINT[]) AS n) ORDER BY n"
    assert got == [r[0] for r in duckdb.execute(sql, [n]).fetchall()]
    assert spark.range(1).select(text.human_bytes(F.lit(None).cast("long"))).first()[0] is None


def tree(doc):
    return [(n.tag, n.attrs, n.pos, n.end, n.index, n.own_text()) for n in doc.nodes]


def test_plain_pages_dont_need_the_library_tokenizer(monkeypatch):
    pages = [
        '<html><head></head><body><article><h1>T</h1><time datetime="2024-01-02">x</time><p>one<p class="a b" hidden>two</article></body></html>',
        "<table><tr><td>1<td>2<tr><TD ID=\"k\">3</table>after<br><ul><li>a<li>b</ul>",
        "text only",
        "",
    ]
    odd = ["<p a=b>x", "<p>a &amp; b", "<p>a < b", "<script>a<b</script>", "<!-- c --><p>x", "<p", "<title>a<b>c</title>"]
    fast = htmldom._parse_plain
    monkeypatch.setattr(htmldom, "_parse_plain", lambda html: None)
    want = [tree(parse(p)) for p in pages + odd]
    monkeypatch.setattr(htmldom, "_parse_plain", fast)
    assert all(fast(p) is None for p in odd)
    assert [tree(parse(p)) for p in pages + odd] == want

    def feed(*_):
        raise RuntimeError("the library's tokenizer")

    monkeypatch.setattr(htmldom._Builder, "feed", feed)
    assert [tree(parse(p)) for p in pages] == want[: len(pages)]
