"""Literal cases of the row-level functions."""

import html
from urllib.parse import parse_qsl, urlsplit

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tarnweave.functions import extract, normalize, text, urls
from tarnweave.functions.htmldom import compile_css, parse, xpath


def col(spark, values, fn, kind="string"):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, v {kind}")
    return [r.o for r in df.select("i", fn(F.col("v")).alias("o")).orderBy("i").collect()]


def test_trim(spark):
    assert col(spark, ["  Hello World  ", "\n\t spaces \n", " x ", "", None], text.trim) == ["Hello World", "spaces", "x", "", None]


def test_sanitize(spark):
    got = col(spark, ["<p>Good <i>Day</i></p>", "<script>run('it')</script><p>Kept</p>", "Text &amp; More", '<a href="x">Link</a> text', "a &lt;b&gt;\n c", None], text.sanitize)
    assert got == ["Good Day", "run('it')Kept", "Text & More", "Link text", "a <b> c", None]


def test_dates(spark):
    same = ["January 15, 2024", "2024-01-15", "Jan 15, 2024", "15/01/2024", "15 January 2024", "15 Jan 2024", "15-Jan-2024", "2024/01/15", "01-15-2024", "Mon, 15 Jan 2024", "2024-01-15T10:00:00Z", "Mon, 15 Jan 2024 10:00:00 GMT", "Mon Jan 15 10:00:00 2024", "2024-01-15 10:00:00"]
    assert col(spark, same, lambda c: normalize.date_normalize(c, "yyyy-MM-dd")) == ["2024-01-15"] * len(same)
    assert col(spark, ["03/04/2024", "soon", "2024-01-15 extra", None], lambda c: normalize.date_normalize(c, "yyyy-MM-dd")) == ["2024-03-04", "soon", "2024-01-15 extra", None]


def test_currency(spark):
    cases = {"$1,234.56": "1234.56", "€1.234,56": "1234.56", "£99.99": "99.99", "¥10000": "10000", "$0.99": "0.99", "1,234": "1.234", "1,234,567": "1.234,567", "": "", "free": ""}
    assert col(spark, list(cases), normalize.currency_normalize) == list(cases.values())


def test_coercion(spark):
    assert col(spark, ["42", " -7x", "x", ""], normalize.to_int) == [42, -7, 0, 0]
    assert col(spark, ["19.99", "1e3z", ".5", "no"], normalize.to_float) == [19.99, 1000.0, 0.5, 0.0]
    assert col(spark, ["true", "YES", "1", "on", " true"], normalize.to_bool) == [True, True, True, False, False]


def test_redact(spark):
    got = col(spark, ["Write to ann@example.org or ring 555-987-6543; SSN 987-65-4321", "+44 20 7946 0958 10.0.0.1 4111 1111 1111 1111", "é123-45-6789"], text.redact)
    assert got[0] == "Write to [REDACTED_EMAIL] or ring [REDACTED_PHONE_US]; SSN [REDACTED_SSN]"
    assert "[REDACTED_IP_V4]" in got[1] and "[REDACTED_CREDIT_CARD]" in got[1] and "+44" not in got[1]
    assert got[2] == "é[REDACTED_SSN]"
    assert col(spark, got, text.redact) == got


def test_words_and_cuts(spark):
    assert col(spark, ["the quick brown fox jumps over the lazy dog", " a b ", ""], text.word_count) == [9, 2, 0]
    assert col(spark, ["éééé", "abcd", "ab"], lambda c: text.truncate(c, 3)) == ["é...", "abc...", "ab"]
    assert col(spark, ["abcdefghij", "éééééé"], lambda c: text.truncate(c, 8, inside=True)) == ["abcde...", "éé..."]
    assert col(spark, ["a<x>b", "a<b", None], lambda c: text.between(c, "<", ">")) == ["x", "", ""]
    assert col(spark, ["a:b.c d"], text.css_escape) == [r"a\:b\.c\ d"]
    assert col(spark, [5, 1536, 3 << 20, 5 << 30], text.human_bytes, "long") == ["5 B", "1.5 KB", "3.0 MB", "5.0 GB"]


@settings(max_examples=60, deadline=None)
@given(st.text(max_size=40), st.integers(3, 20))
def test_clip_keeps_characters_whole(s, n):
    got = extract.clip(s, n)
    assert got == s if len(s.encode()) <= n else got.endswith("...") and s.startswith(got[:-3]) and len(got[:-3].encode()) <= n


def test_overlaps(spark):
    df = spark.sql("SELECT array('a','b') a, array('b','c') b, array() e, map('x','1') m, map('x','1','y','2') n, map() z")
    e = F.col("e").cast("array<string>")
    z = F.col("z").cast("map<string,string>")
    r = df.select(text.list_overlap(F.col("a"), F.col("b")), text.list_overlap(e, e), text.map_overlap(F.col("m"), F.col("n")), text.map_overlap(z, z)).first()
    assert list(r) == [pytest.approx(1 / 3), 1.0, 0.5, 1.0]


def test_canonical(spark):
    cases = {
        "https://site.example/way?b=2&a=1#frag": "https://site.example/way?a=1&b=2",
        "https://site.example/path/": "https://site.example/path",
        "HTTPS://EXAMPLE.COM/Path": "https://example.com/Path",
        "http://example.com:80": "http://example.com/",
        "https://example.com:443/x//": "https://example.com/x",
        "http://example.com:8080/?a": "http://example.com:8080/?a=",
        "not a url": "not a url",
        "http://[bad": "http://[bad",
    }
    got = col(spark, list(cases), urls.canonical)
    assert got == list(cases.values())
    assert col(spark, got, urls.canonical) == got


def test_canonical_query_is_kept(spark):
    us = ["http://h/p?z=%20a&y=b+c&y=a", "http://h/?q=%C3%A9&x=1%262"]
    for u, c in zip(us, col(spark, us, urls.canonical)):
        assert sorted(parse_qsl(urlsplit(u).query)) == parse_qsl(urlsplit(c).query)


def test_robots():
    table = [("/private/", "/private/x", True), ("/private/", "/public", False), ("/*.pdf", "/a/b.pdf", True), ("/*.pdf$", "/a.pdf", True), ("/*.pdf$", "/a.pdf.pdf", False), ("/x$", "/x", True), ("/x$", "/xy", False), ("", "/", False), ("*", "/any", True), ("/a*b*c", "/a1b2c3", True), ("a*", "/a", False)]
    for pattern, path, want in table:
        assert urls.robots_match(pattern, path) is want, (pattern, path)
    allow, deny, delay, maps = urls.parse_robots("User-agent: x\nDisallow: /no\nUser-agent: *\nDisallow: /private/ # c\nAllow: /private/public\nCrawl-delay: 3\nSitemap: https://e/s.xml\nnonsense", "bot")
    assert (allow, deny, delay, maps) == (["/private/public"], ["/private/"], 3.0, ["https://e/s.xml"])


def test_robots_allowed(spark):
    df = spark.createDataFrame([("/private/x",), ("/private/public/y",), ("/a.pdf",), ("/ok",)], "p string")
    r = df.select(urls.robots_allowed(F.col("p"), F.array(F.lit("/private/public")), F.array(F.lit("/private/"), F.lit("/*.pdf$")))).collect()
    assert [x[0] for x in r] == [False, True, False, True]
    none = F.lit(None).cast("array<string>")
    assert [x[0] for x in df.select(urls.robots_allowed(F.col("p"), none, none)).collect()] == [True] * 4


def test_retry_after(spark):
    now = F.lit("2024-01-01 00:00:00").cast("timestamp")
    got = col(spark, [None, "", "7", "900", "Mon, 01 Jan 2024 00:00:30 GMT", "Sun, 31 Dec 2023 00:00:00 GMT", "Tue, 02 Jan 2024 00:00:00 GMT", "junk"], lambda c: normalize.retry_after_seconds(c, now))
    assert got == [5, 5, 7, 120, 30, 1, 120, 5]


PAGE = """<!doctype html>
<html lang=en><head><title>A Page</title><meta content="A test" name=description>
<meta property="og:title" content="Social"><meta property="og:image" content=""><meta name="twitter:card" content="large"><meta property="twitter:title" content="TW">
<link rel="canonical" href="https://example.com/c"><link rel="alternate" hreflang="de" href="/de"><script id=j type=application/ld+json>{"@type":"Article","name":"A piece","author":"Ann"}</script>
<script type=application/ld+json>[{"@type":"Product"}, 3]</script><script type=application/ld+json>{broken</script></head>
<body id=b><h1 title=t class="title">Hello World</h1><p class="intro">One paragraph.</p><a href="/page2">Two</a> <a rel="nofollow" href="https://example.com/page3#x">Three</a><a href="mailto:a@b">m</a>
<ul class="things"><li>One<li>Two<li>Three</ul>
<table border=1 id="data"><tr><th>Side</th><th>Count</th></tr><tr><td>Left</td><td>10</td></tr><tr><td>Right<td>20</table>
<div itemscope itemtype="https://schema.org/Product"><span itemprop="name">W</span><a itemprop="url" href="/w">w</a><div itemscope><b itemprop="inner">i</b></div></div></body></html>"""


def test_rules():
    d = parse(PAGE)
    R = extract.Rule
    got = extract.apply_rules(PAGE, d, [R("h", "h1.title"), R("p", "p.intro"), R("x", "//ul[@class='things']/li", "xpath"), R("t", type="regex", pattern="<title>(?P<t>[^<]*)</title>"), R("bad", "p[", "css"), R("none", ".nope"), R("href", "a", attribute="href"), R("two", "//ul/li[2]", "xpath")])
    assert got == {"h": ["Hello World"], "p": ["One paragraph."], "x": ["One", "Two", "Three"], "t": ["A Page"], "href": ["/page2", "https://example.com/page3#x", "mailto:a@b", "/w"], "two": ["Two"]}


def test_structured():
    found = extract.structured(parse(PAGE))
    kinds = [k for k, _, _ in found]
    assert kinds == ["json-ld", "opengraph", "twitter-card", "microdata", "meta"]
    f = extract.structured_fields(found)
    assert f["json_ld"]["name"] == "A piece" and f["opengraph"] == {"title": "Social"} and f["twitter_card"] == {"card": "large", "title": "TW"}
    assert f["microdata"] == {"@type": "https://schema.org/Product", "name": "W", "url": "/w", "inner": "i"}
    assert f["meta_title"] == "A Page" and f["meta_canonical"] == "https://example.com/c" and f["meta_hreflang"] == [{"lang": "de", "href": "/de"}]


def test_links_and_tables():
    d = parse(PAGE)
    assert extract.links(d, "https://example.com") == ["https://example.com/page2", "https://example.com/page3", "https://example.com/w"]
    b = extract.backlinks(d, "https://example.com")
    assert [x[2] for x in b] == [False, True, False, False] and b[2][0] == "mailto:a@b" and b[2][3]
    assert extract.tables(d) == [(["Side", "Count"], [{"Side": "Left", "Count": "10"}, {"Side": "Right", "Count": "20"}])]
    assert extract.table_cells(d, "#data")[1] == ["Left", "10"] and extract.list_items(d, "ul.things") == ["One", "Two", "Three"]


def test_traversal():
    d = parse(PAGE)
    li = d.first("li:nth-child(2)")
    assert [n.tag for n in extract.traverse(li, "parent", 2)] == ["body"]
    assert [n.text() for n in extract.traverse(li, "next")] == ["Three"] and [n.text() for n in extract.traverse(li, "prev_all")] == ["One"]
    assert len(extract.traverse(li, "siblings")) == 2 and len(extract.traverse(d.first("ul"), "children")) == 3
    assert extract.traverse(d.first("b"), "closest", css="[itemtype]")[0].tag == "div"


def test_selectors_and_relocation():
    d = parse(PAGE)
    best = extract.selectors_for_text(d, "Hello World")[0]
    assert best[1] >= 0.5 and d.first(best[0]).text() == "Hello World"
    snap = extract.snapshot(d, "h1.title")
    assert extract.relocate(d, snap) == ("selector", "h1.title")
    assert extract.relocate(parse("<div><h1 id=q class=other>Hello World</h1><h1>x</h1></div>"), snap) == ("text", "#q")
    assert extract.relocate(parse("<p>nothing"), snap) is None
    snap = extract.snapshot(parse('<i class="k" data-id="7">a</i>'), ".k")
    assert extract.relocate(parse('<p><i data-id="7">b</i></p>'), snap) == ("attribute", 'i[data-id="7"]')
    near = extract.similar_elements(parse("<p class=a>one two</p><p class=a>one two</p><p class=b>zzz</p>"), "p")
    assert near[0][2] == pytest.approx(0.8) and len(near) == 1


def test_auto_extract_types():
    card = '<article class="product-card"><h2 class="product-title">W{0}</h2><span class="price">$5.0{0}</span><img src="/i" alt="x"><div class="rating">4</div><p>A very good thing</p></article>'
    p = extract.auto_extract("u", parse("".join(card.format(i) for i in range(3))))
    assert p.type == "listing" and [d for d in p.data if d.get("_type") == "product"][0] == {"_type": "product", "name": "W0", "price": "$5.00", "image": "/i", "image_alt": "x", "rating": "4", "description": "A very good thing"}
    art = extract.auto_extract("u", parse('<article><h1>T</h1><span class=author>B</span><time datetime="2024-01-01">x</time><p>Twenty one characters!</p></article>'))
    assert art.type == "article" and art.data[0] == {"_type": "article", "title": "T", "author": "B", "date": "2024-01-01", "content_preview": "Twenty one characters!"}
    assert extract.auto_extract("u", parse("<table><tr><th>a<tr><td>1</table>")).type == "data"
    assert extract.auto_extract("u", parse("")).type == "generic"
    price = extract.auto_extract("u", parse("<div class=product>only €1,234.50 now</div>"))
    assert price.data[0]["price"] == "€1,234.50" and price.type == "product"


def test_malformed():
    assert parse(None).nodes and parse("<a" * 50).nodes is not None
    deep = parse("<div>" * 10_000 + "end")
    assert deep.select("div")[-1].text() == "end"
    d = parse("<p>one<p>two<b>three<div>four")
    assert [n.text() for n in d.select("p")] == ["one", "twothree"] or len(d.select("p")) == 2
    assert parse("\x00<p>\x00x").first("p") is not None
    assert parse("<title>a<b>c</title><p>x").first("title").text().startswith("a")


@settings(max_examples=80, deadline=None)
@given(st.text(alphabet="<>/ab='\" &;!-", max_size=60))
def test_parse_never_fails(s):
    d = parse(s)
    assert all(n.parent is not None for n in d.nodes)


def test_css_and_xpath_forms():
    d = parse("<div id=a><p class='x y' data-k='v1'>1</p><p lang=en-GB>2</p><span>3</span></div><p>4</p>")
    for css, want in {"#a > p": ["1", "2"], "p.x.y": ["1"], "[data-k^=v]": ["1"], "[data-k$='1']": ["1"], "[data-k*='v']": ["1"], "[lang|=en]": ["2"], "p ~ span": ["3"], "p + p": ["2"], "p:not(.x)": ["2", "4"], "div p:first-child, span": ["1", "3"], "p:nth-child(2)": ["2", "4"], "p:nth-child(odd)": ["1"], "p:last-child": ["4"]}.items():
        assert [n.text() for n in d.select(css)] == want, css
    assert xpath(d, "//p/@data-k") == ["v1"] and [n.text() for n in xpath(d, "//div/p[last()]")] == ["2"] and xpath(d, "//span/text()") == ["3"]
    for bad in ("p[", ":hover", "", ">"):
        with pytest.raises(ValueError):
            compile_css(bad)


def test_json_helpers():
    assert extract.balanced_json('say {"a": {"b": 1}} ok') == '{"a": {"b": 1}}' and extract.balanced_json("none") == "{}"
    assert extract.regex_values("a1 b2", r"(\w)(\d)") == ["a", "b"] and extract.regex_values("a1 b2", r"\d") == ["1", "2"]
    assert extract.regex_values("k=v", r"(?<k>\w)=(?<v>\w)") == ["k", "v"]
    assert html.unescape("&amp;") == "&"
