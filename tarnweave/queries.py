"""The core queries over the test tables, each with the SQL that gives the same rows where SQL can."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .functions import normalize, text, urls
from .functions.extract import Rule
from .operators import bloom, crawl, frontier, items, monitor, pages, stats
from .plans import recipes
from .sources import files, sinks
from .streaming import changes

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE: dict[str, str] = {}


def t(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def add(fn: Query) -> Query:
        QUERIES[fn.__name__] = fn
        if sql:
            ORACLE[fn.__name__] = sql
        return fn

    return add


def queries() -> dict[str, Query]:
    from . import queries_built  # noqa: F401  registers its own

    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    from . import queries_built  # noqa: F401

    return dict(ORACLE)


def _json_list(c: Column) -> Column:
    return F.array_join(c, "|")


# SQL fragments for the regular markup of the pages table
CANON = "regexp_replace(regexp_replace(url, '#.*$', ''), '/+([?]|$)', '\\1')"
PLAIN = "replace(replace(replace(replace({0}, '&quot;', '\"'), '&copy;', '©'), '&middot;', '·'), '&amp;', '&')"
TITLE = "trim(" + PLAIN.format("regexp_extract(html, '<title>(.*?)</title>', 1)") + ")"
H1 = "trim(" + PLAIN.format("regexp_replace(regexp_extract(html, '(?s)<h1>(.*?)</h1>', 1), '<[^>]*>', '', 'g')") + ")"
BODY = "trim(regexp_replace(" + PLAIN.format("regexp_replace(regexp_replace(regexp_replace(html, '(?s)^.*?<body>', ''), '(?s)<nav>.*?</nav>|<footer>.*?</footer>|<script>.*?</script>|<style>.*?</style>|<!--.*?-->', '', 'g'), '<[^>]*>', '', 'g')") + ", '[\\s\\p{Z}]+', ' ', 'g'))"
CUT = "(CASE WHEN strlen({0}) > {1} THEN left({0}, CAST(list_max(list_filter(range(CAST({1} / 4 AS BIGINT), {1} + 1), lambda k: strlen(left({0}, k)) <= {1})) AS BIGINT)) || '{2}' ELSE {0} END)"


# -- pages


@query(f"""
    WITH p AS (SELECT page_id, {CANON} AS url, {TITLE} AS title, {H1} AS h1, {BODY} AS body, CAST(len(regexp_extract_all(html, '<a href="')) AS INTEGER) AS links FROM pages)
    SELECT page_id, url, regexp_extract(url, '//([^/]*)', 1) AS host, substr(sha256(url), 1, 32) AS url_hash, title, h1,
           CAST(CASE WHEN body = '' THEN 0 ELSE len(string_split(body, ' ')) END AS INTEGER) AS word_count, links, sha256(body) AS body_hash
    FROM p WHERE title <> '' OR len(string_split(body, ' ')) > 10
    QUALIFY row_number() OVER (PARTITION BY sha256(body) ORDER BY page_id) = 1""")
def page_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The flagship: canonical address, title, heading, counts and hash of each page; one page per body."""
    f = pages.features(t(spark, sf_dir, "pages"))
    f = f.withColumn("url", urls.canonical(F.col("url"))).withColumn("word_count", F.when(F.col("body") == "", 0).otherwise(F.size(F.split("body", " "))))
    f = f.where("title <> '' OR word_count > 10").select("page_id", "url", urls.host(F.col("url")).alias("host"), urls.url_hash(F.col("url")).alias("url_hash"), "title", _json_list(F.col("h1")).alias("h1"), "word_count", "links", F.sha2("body", 256).alias("body_hash"))
    return items.dedup("body_hash", "url", ("page_id",))(f)


@query(f"""
    WITH p AS (SELECT page_id, url, {TITLE} AS title, {H1} AS h1, {BODY} AS body, CAST(len(regexp_extract_all(html, '<a href="')) AS INTEGER) AS outbound_links FROM pages),
         c AS (SELECT *, {CUT.format("body", 5000, "...")} AS body_text FROM p)
    SELECT page_id, url, title, h1, body_text, CAST(CASE WHEN body = '' THEN 0 ELSE len(string_split(body, ' ')) END AS INTEGER) AS word_count, outbound_links, substr(sha256(body_text), 1, 16) AS content_hash
    FROM c""")
def search_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pages.search_index(t(spark, sf_dir, "pages")).select("page_id", "url", "title", _json_list(F.col("h1")).alias("h1"), "body_text", "word_count", "outbound_links", "content_hash")


@query(f"""
    WITH p AS (SELECT page_id, url, {TITLE} AS title, {H1} AS h1, {BODY} AS body FROM pages)
    SELECT page_id, url, title, CASE WHEN strlen(h1) < 200 THEN h1 ELSE '' END AS headings, {CUT.format("body", 3000, "")} AS content
    FROM p""")
def content_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pages.content_rows(t(spark, sf_dir, "pages")).select("page_id", "url", "title", _json_list(F.col("headings")).alias("headings"), "content")


@query("SELECT regexp_extract(url, '//([^/]*)', 1) AS host, count(*) AS pages, count(DISTINCT url) AS urls FROM pages GROUP BY 1")
def pages_per_host(spark: SparkSession, sf_dir: str) -> DataFrame:
    return frontier.keyed(t(spark, sf_dir, "pages").select("url")).groupBy("host").agg(F.count("*").alias("pages"), F.count_distinct("url").alias("urls"))


@query(f"""
    WITH l AS (SELECT page_id, regexp_extract(url, '^https?://[^/]*') || x AS link, i
               FROM (SELECT page_id, url, unnest(h) AS x, unnest(range(len(h))) AS i FROM (SELECT page_id, url, regexp_extract_all(html, '<a href="([^"]*)"', 1) AS h FROM pages)))
    SELECT page_id, CAST(row_number() OVER (PARTITION BY page_id ORDER BY min(i)) - 1 AS INTEGER) AS position, link FROM l GROUP BY page_id, link""")
def page_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pages.page_links(t(spark, sf_dir, "pages"))


@query("""
    WITH l AS (SELECT url AS source, unnest(regexp_extract_all(html, '<a href="([^"]*)"', 1)) AS h, unnest(regexp_extract_all(html, '<a href="[^"]*">([^<]*)</a>', 1)) AS anchor FROM pages)
    SELECT source, regexp_extract(source, '^https?://[^/]*') || h AS target, anchor, false AS nofollow, false AS external, count(*) AS n FROM l GROUP BY ALL""")
def link_graph(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pages.link_graph(t(spark, sf_dir, "pages")).groupBy("source", "target", "anchor", "nofollow", "external").agg(F.count("*").alias("n"))


@query("""
    SELECT regexp_extract(url, '//([^/]*)', 1) AS host, CAST(sum(len(regexp_extract_all(html, '<a href="'))) AS BIGINT) AS internal, CAST(0 AS BIGINT) AS external, CAST(0 AS BIGINT) AS nofollow
    FROM pages GROUP BY 1 HAVING sum(len(regexp_extract_all(html, '<a href="'))) > 0""")
def link_census(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = pages.link_graph(t(spark, sf_dir, "pages"))
    return g.groupBy(urls.host(F.col("source")).alias("host")).agg(F.count_if(~F.col("external")).alias("internal"), F.count_if("external").alias("external"), F.count_if("nofollow").alias("nofollow"))


@query(f"""
    WITH p AS (SELECT page_id, {TITLE} AS title, len(regexp_extract_all(html, '<h1>')) AS h1 FROM pages)
    SELECT page_id, CAST(100 - CASE WHEN title = '' THEN 20 WHEN strlen(title) > 60 OR strlen(title) < 10 THEN 5 ELSE 0 END - 15 - 5 - CASE WHEN h1 = 0 THEN 10 WHEN h1 > 1 THEN 5 ELSE 0 END - 3 - 3 - 5 AS INTEGER) AS score,
           CASE WHEN title = '' THEN 'title|' WHEN strlen(title) > 60 OR strlen(title) < 10 THEN 'title|' ELSE '' END || 'description|canonical|' || CASE WHEN h1 <> 1 THEN 'headings|' ELSE '' END || 'opengraph|opengraph|mobile' AS issues,
           title
    FROM p""")
def seo_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = pages.seo_audit(t(spark, sf_dir, "pages"))
    return a.select("page_id", "score", _json_list(F.transform("issues", lambda x: x["category"])).alias("issues"), "title")


@query(f"""
    SELECT page_id, 'meta' AS kind, {TITLE} AS title FROM pages WHERE {TITLE} <> ''""")
def structured_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pages.structured_data(t(spark, sf_dir, "pages")).select("page_id", "kind", F.get_json_object("data", "$.title").alias("title"))


RULES = (
    Rule("heading", "article h1"),
    Rule("nav", "nav ul > li:nth-child(2) a", attribute="href"),
    Rule("foot", "//footer", "xpath"),
    Rule("title", type="regex", pattern="<title>(?P<t>[^<]*)</title>"),
)


@query(f"""
    SELECT page_id, {H1} AS heading, coalesce(regexp_extract_all(html, '<a href="([^"]*)"', 1)[2], '') AS nav,
           trim({PLAIN.format("regexp_replace(regexp_extract(html, '(?s)<footer>(.*?)</footer>', 1), '<[^>]*>', '', 'g')")}) AS foot,
           regexp_extract(html, '<title>([^<]+)</title>', 1) AS title
    FROM pages""")
def extract_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = pages.extract_rules(t(spark, sf_dir, "pages"), RULES)
    return f.select("page_id", *[F.coalesce(_json_list(F.element_at("fields", r.name)), F.lit("")).alias(r.name) for r in RULES])


@query(f"""
    SELECT page_id, {TITLE} AS title, 'article' AS type, CAST(len(list_filter(regexp_extract_all(html, '<a href="([^"]*)"', 1), lambda x: x <> '#' AND x <> '')) AS INTEGER) AS links,
           CAST(0 AS INTEGER) AS images, CAST(0 AS INTEGER) AS tables, {H1} AS article
    FROM pages""")
def auto_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = pages.auto_extract(t(spark, sf_dir, "pages"))
    art = F.element_at(F.filter("data", lambda d: F.element_at(d, "_type") == "article"), 1)
    return a.select("page_id", "title", "type", F.size("links").alias("links"), F.size("images").alias("images"), F.size("tables").alias("tables"), F.element_at(art, "title").alias("article"))


@query(f"""
    SELECT page_id, {TITLE} AS title, {H1} AS heading, CAST(len(list_distinct(regexp_extract_all(html, '<a href="([^"]*)"', 1))) AS INTEGER) AS links FROM pages""")
def composite_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = pages.composite(t(spark, sf_dir, "pages"), RULES)
    return c.select("page_id", F.get_json_object("item", "$.meta_title").alias("title"), F.get_json_object("item", "$.heading").alias("heading"), F.size("links").alias("links"))


@query("""
    SELECT page_id, tag, CAST(n AS BIGINT) AS n FROM (
        SELECT page_id, unnest(['a', 'li', 'h1', 'article', 'footer', 'nav', 'b', 'title']) AS tag,
               unnest([len(regexp_extract_all(html, '<a href')), len(regexp_extract_all(html, '<li>')), len(regexp_extract_all(html, '<h1>')), len(regexp_extract_all(html, '<article>')),
                       len(regexp_extract_all(html, '<footer>')), len(regexp_extract_all(html, '<nav>')), len(regexp_extract_all(html, '<b>')), len(regexp_extract_all(html, '<title>'))]) AS n FROM pages)
    WHERE n > 0""")
def dom_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = pages.dom_nodes(t(spark, sf_dir, "pages"))
    return n.where(F.col("tag").isin("a", "li", "h1", "article", "footer", "nav", "b", "title")).groupBy("page_id", "tag").agg(F.count("*").alias("n"))


@query("""
    WITH l AS (SELECT page_id, regexp_extract_all(html, '<li><a href="[^"]*">([^<]*)</a>', 1) AS x FROM pages)
    SELECT page_id, CAST(unnest(range(len(x))) AS INTEGER) AS place, unnest(x) AS label FROM l""")
def dom_children(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Children of the navigation list and their links, as joins over the node table."""
    n = pages.dom_nodes(t(spark, sf_dir, "pages"))
    li = n.where("tag = 'li'").select("page_id", F.col("node").alias("parent"), F.col("place").alias("li_place"))
    return n.where("tag = 'a'").join(li, ["page_id", "parent"]).select("page_id", F.col("li_place").alias("place"), F.col("own_text").alias("label"))


@query()
def selector_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pages.selector_candidates(t(spark, sf_dir, "pages"), F.regexp_extract("html", "<h1>([^<]{1,30})", 1))


@query()
def similar_elements(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pages.similar_elements(t(spark, sf_dir, "pages"), "li")


@query("SELECT url, 'selector' AS strategy, 'article > h1' AS selector FROM pages WHERE contains(html, '<h1>')")
def relocate(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = t(spark, sf_dir, "pages")
    r = pages.relocate(p, p.withColumn("html", F.regexp_replace("html", "<nav>.*?</nav>", "")), "article > h1", ("page_id", "url"))
    return r.where("strategy IS NOT NULL").select("url", "strategy", "selector")


# -- URLs


@query("""
    SELECT page_id, regexp_replace(regexp_replace(lower(regexp_extract(url, '^https?://[^/]*')), '$', '') || '/A%20b/' || page_id, '/+$', '') || '?a+b=' || page_id || '&b=1&b=2' AS canonical FROM pages""")
def canonical_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Messy variants of every address and their canonical form."""
    u = F.col("url")
    messy = F.concat(F.upper(urls.part(u, "PROTOCOL")), F.lit("://"), F.upper(urls.host(u)), F.when(u.startswith("https"), ":443").otherwise(":80"), F.lit("/A%20b/"), F.col("page_id"), F.lit("//?b=2&a%20b="), F.col("page_id"), F.lit("&b=1#top"))
    return t(spark, sf_dir, "pages").select("page_id", urls.canonical(messy).alias("canonical"))


@query(f"SELECT page_id, {CANON} AS canonical, substr(sha256({CANON}), 1, 32) AS url_hash FROM pages")
def url_hashes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return frontier.keyed(t(spark, sf_dir, "pages")).select("page_id", "canonical", "url_hash")


REFS = ("/abs/path", "rel.html", "../up", "//other.example/x", "https://z.example/p#frag", "?q=1", "#frag")


@query("""
    SELECT page_id, ref, CASE ref
        WHEN '/abs/path' THEN o || ref WHEN 'rel.html' THEN o || regexp_replace(p, '[^/]*$', '') || ref
        WHEN '../up' THEN o || regexp_replace(regexp_replace(p, '[^/]*$', ''), '[^/]+/$', '') || 'up'
        WHEN '//other.example/x' THEN regexp_extract(o, '^[a-z]+:') || ref WHEN 'https://z.example/p#frag' THEN 'https://z.example/p'
        WHEN '?q=1' THEN o || p || '?q=1' ELSE o || p || q END AS resolved
    FROM (SELECT page_id, regexp_extract(url, '^https?://[^/]*') AS o, regexp_extract(url, '^https?://[^/]*([^?#]*)', 1) AS p, regexp_extract(url, '[?][^#]*') AS q,
                 unnest(['/abs/path', 'rel.html', '../up', '//other.example/x', 'https://z.example/p#frag', '?q=1', '#frag']) AS ref FROM pages)""")
def resolve_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = t(spark, sf_dir, "pages").select("page_id", "url", F.explode(F.array(*[F.lit(r) for r in REFS])).alias("ref"))
    return p.select("page_id", "ref", urls.resolve(F.col("url"), F.col("ref")).alias("resolved"))


@query("SELECT page_id, regexp_extract(url, '//([^/]*)', 1) AS host, coalesce(nullif(regexp_extract(url, '([^/?#]*)([?#].*)?$', 1), ''), substr(sha256(url), 1, 16)) AS file, true AS web FROM pages")
def url_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    u = F.col("url")
    return t(spark, sf_dir, "pages").select("page_id", urls.host(u).alias("host"), urls.file_name(u).alias("file"), urls.is_web_url(u).alias("web"))


@query("""
    SELECT page_id, ref, NOT (ref = '' OR starts_with(ref, '#') OR starts_with(ref, 'javascript:') OR starts_with(ref, 'mailto:') OR starts_with(ref, 'tel:') OR starts_with(ref, 'data:')) AS follow
    FROM (SELECT page_id, unnest(['', '#a', 'javascript:x', 'mailto:a@b', 'tel:1', 'data:,', '/ok', 'http://ok']) AS ref FROM pages)""")
def link_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = t(spark, sf_dir, "pages").select("page_id", F.explode(F.array(*[F.lit(r) for r in ("", "#a", "javascript:x", "mailto:a@b", "tel:1", "data:,", "/ok", "http://ok")])).alias("ref"))
    return p.select("page_id", "ref", urls.followable(F.col("ref")).alias("follow"))


ROBOTS = "User-agent: other\nDisallow: /\nUser-agent: *\nDisallow: /fr\nDisallow: /*9$ # nines\nAllow: /fr/8\nCrawl-delay: 2.5\nSitemap: https://x.example/s.xml"


@query("""
    SELECT page_id, path, (starts_with(path, '/fr/8') OR NOT (starts_with(path, '/fr') OR (contains(path, '9') AND position('9' IN path) = length(path)))) AS allowed
    FROM (SELECT page_id, regexp_extract(url, '^https?://[^/]*([^?#]*)', 1) AS path FROM pages)""")
def robots_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = t(spark, sf_dir, "pages").select("page_id", pages.origin_path(F.col("url")).alias("path"))
    r = spark.createDataFrame([(ROBOTS,)], "content string").select(urls.robots_rules(F.col("content"), "tarnweave").alias("r"))
    return p.crossJoin(F.broadcast(r)).select("page_id", "path", urls.robots_allowed(F.col("path"), F.col("r.allow"), F.col("r.disallow")).alias("allowed"))


@query("SELECT CAST(2.5 AS DOUBLE) AS crawl_delay, '/fr/8' AS allow, '/fr|/*9$' AS disallow, 'https://x.example/s.xml' AS sitemaps")
def robots_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = spark.createDataFrame([(ROBOTS,)], "content string").select(urls.robots_rules(F.col("content"), "tarnweave").alias("r"))
    return r.select("r.crawl_delay", *[_json_list(F.col(f"r.{c}")).alias(c) for c in ("allow", "disallow", "sitemaps")])


@query(f"""
    WITH h AS (SELECT regexp_extract(url, '//([^/]*)', 1) AS host FROM pages), deny AS (SELECT DISTINCT host FROM h WHERE host LIKE '%.net'),
         r AS (SELECT page_id, {CANON} AS canonical, regexp_extract(url, '//([^/]*)', 1) AS host, regexp_extract({CANON}, '^https?://[^/]*([^?#]*)', 1) AS path, CAST(page_id % 5 AS INTEGER) AS depth FROM pages),
         s AS (SELECT DISTINCT {CANON} AS canonical FROM pages WHERE page_id % 7 = 0)
    SELECT page_id, CASE WHEN depth > 3 THEN 'depth' WHEN s.canonical IS NOT NULL THEN 'seen'
                         WHEN NOT (starts_with(path, '/fr/8') OR NOT (starts_with(path, '/fr') OR (contains(path, '9') AND position('9' IN path) = length(path)))) THEN 'robots'
                         WHEN host IN (SELECT host FROM deny) THEN 'domain' END AS rejected
    FROM r LEFT JOIN s USING (canonical)""")
def admission(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Requests for every page at depths 0 to 4, a seventh of the pages already seen, robots rules and a deny list."""
    p = t(spark, sf_dir, "pages").select("page_id", "url", (F.col("page_id") % 5).cast("int").alias("depth"))
    k = frontier.keyed(p)
    seen = k.where("page_id % 7 = 0").select("url_hash")
    rules = k.select("host").distinct().withColumn("r", urls.robots_rules(F.lit(ROBOTS), "tarnweave")).select("host", "r.allow", "r.disallow")
    deny = [r.host for r in k.where("host LIKE '%.net'").select("host").distinct().collect()]
    return frontier.admit(p, seen, rules, deny=deny, most=3).select("page_id", "rejected")


@query(f"SELECT page_id, {CANON} AS canonical FROM pages WHERE {CANON} NOT IN (SELECT {CANON} FROM pages WHERE page_id % 3 = 0)")
def unseen_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = frontier.keyed(t(spark, sf_dir, "pages"))
    return frontier.unseen(k, k.where("page_id % 3 = 0")).select("page_id", "canonical")


@query("SELECT page_id FROM pages WHERE regexp_extract(url, '//([^/]*)', 1) IN (SELECT regexp_extract(url, '//([^/]*)', 1) FROM pages WHERE page_id % 10 = 0)")
def domain_allow(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = frontier.keyed(t(spark, sf_dir, "pages"))
    return frontier.allowed_hosts(k, k.where("page_id % 10 = 0").select("host")).select("page_id")


@query("SELECT page_id FROM pages WHERE regexp_extract(url, '//([^/]*)', 1) NOT IN (SELECT regexp_extract(url, '//([^/]*)', 1) FROM pages WHERE page_id % 10 = 0)")
def domain_deny(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = frontier.keyed(t(spark, sf_dir, "pages"))
    return frontier.allowed_hosts(k, deny=k.where("page_id % 10 = 0").select("host")).select("page_id")


@query("""
    SELECT o_orderkey, CAST(left(o_orderpriority, 1) AS INTEGER) - 1 AS priority FROM orders
    ORDER BY left(o_orderpriority, 1), o_orderdate, o_orderkey LIMIT 500""")
def frontier_top(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A top-k report: the 500 most urgent entries, orders standing for requests."""
    o = t(spark, sf_dir, "orders").select("o_orderkey", (F.substring("o_orderpriority", 1, 1).cast("int") - 1).alias("priority"), F.col("o_orderdate").alias("created_at"))
    return frontier.next_batch(o, 500, ("created_at", "o_orderkey")).select("o_orderkey", "priority")


@query("""
    WITH RECURSIVE r(k, depth) AS (SELECT 1::BIGINT, 0 UNION SELECT k * 2 + i, depth + 1 FROM r, (VALUES (0), (1)) v(i) WHERE depth < 6 AND k * 2 + i <= (SELECT max(c_custkey) FROM customer))
    SELECT 'https://g.example/c/' || k AS url, CAST(min(depth) AS INTEGER) AS depth FROM r JOIN customer ON c_custkey = k GROUP BY k""")
def crawl_bfs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers as pages of a binary tree, crawled six links deep from the root."""
    k = F.col("c_custkey").cast("string")
    link = lambda i: F.concat(F.lit('<a href="/c/'), (F.col("c_custkey") * 2 + i).cast("string"), F.lit('#x">x</a>'))
    p = t(spark, sf_dir, "customer").select(F.concat(F.lit("https://g.example/c/"), k).alias("url"), F.concat(F.lit("<title>"), k, F.lit("</title>"), link(0), link(1)).alias("html"))
    return crawl.crawl(p, ["HTTPS://G.example/c/1/"], depth=6).select("url", "depth")


@query(f"SELECT regexp_extract(url, '//([^/]*)', 1) AS host, {CANON} AS loc, CAST(0.5 AS DOUBLE) AS priority FROM pages")
def sitemaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sitemaps built per host from the pages, then read back."""
    k = frontier.keyed(t(spark, sf_dir, "pages").select("url"))
    entry = F.concat(F.lit("<url><loc> "), F.replace(F.col("canonical"), F.lit("&"), F.lit("&amp;")), F.lit("</loc><priority>0.5</priority></url>"))
    xml = F.concat(F.lit('<?xml version="1.0"?><urlset xmlns="http://www.sitemaps.org/schemas/sitemap/0.9">'), F.array_join(F.collect_list(entry), ""), F.lit("</urlset>"))
    return crawl.sitemap_urls(k.groupBy(F.col("host").alias("url")).agg(xml.alias("xml"))).select(F.col("url").alias("host"), "loc", "priority")


# -- item pipeline on documents and others


@query("SELECT doc_id, sha256(regexp_replace(text, '^[\\s\\p{Z}]+|[\\s\\p{Z}]+$', '', 'g')) AS trimmed FROM documents")
def trim_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = t(spark, sf_dir, "documents").select("doc_id", F.concat(F.lit("\n\t  "), "text", F.lit("  \r\n")).alias("text"))
    return items.trim(d).select("doc_id", F.sha2("text", 256).alias("trimmed"))


@query("""
    SELECT doc_id, sha256(trim(regexp_replace(replace(replace(replace(regexp_replace('x' || text || 'y & "z" ', '<[^>]*>', '', 'g'), '&quot;', '"'), '&lt;', '<'), '&amp;', '&'), '[\\s\\p{Z}]+', ' ', 'g'))) AS clean FROM documents""")
def html_sanitize(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = t(spark, sf_dir, "documents").select("doc_id", F.concat(F.lit("<p class='a'>x<b>"), "text", F.lit("</b>y &amp; &quot;z&quot;\n</p>")).alias("text"))
    return items.html_sanitize(d).select("doc_id", F.sha2("text", 256).alias("clean"))


REDACT = "text"
for _kind, _rx in (("EMAIL", r"[\w.%+-]+@[A-Za-z\d.-]+\.[^\W\d_]{2,}"), ("CREDIT_CARD", r"\b\d{4}(?:[\s-]?\d{4}){3}\b"), ("SSN", r"\b\d{3}-\d\d-\d{4}\b"), ("PHONE_INTL", r"[+]\d{1,3}[\s.-]?[(]?\d{1,4}[)]?[\s.-]?\d{1,4}[\s.-]?\d{1,9}"), ("PHONE_US", r"\b(?:\d{3}[.-]?){2}\d{4}\b"), ("IP_V4", r"\b(?:\d{1,3}[.]){3}\d{1,3}\b")):
    REDACT = f"regexp_replace({REDACT}, '{_rx}', '[REDACTED_{_kind}]', 'g')"


@query(f"SELECT doc_id, sha256({REDACT}) AS redacted, CAST(len(regexp_extract_all({REDACT}, '\\[REDACTED_')) AS INTEGER) AS n FROM documents")
def pii_redact(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = items.pii_redact(t(spark, sf_dir, "documents").select("doc_id", "text"))
    return d.select("doc_id", F.sha2("text", 256).alias("redacted"), F.size(F.expr(r"regexp_extract_all(text, '\\[REDACTED_', 0)")).alias("n"))


@query("SELECT doc_id, CASE WHEN text <> '' THEN CAST(len(list_filter(regexp_split_to_array(text, '[\\s\\p{Z}]+'), lambda w: w <> '')) AS INTEGER) END AS text_word_count FROM documents")
def word_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return items.word_count("text")(t(spark, sf_dir, "documents")).select("doc_id", "text_word_count")


@query("SELECT doc_id FROM documents WHERE coalesce(text, '') = '' OR regexp_matches(text, '[A-Z][a-z]+ the ')")
def field_validate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return items.field_validate(text="[A-Z][a-z]+ the ")(t(spark, sf_dir, "documents")).select("doc_id")


@query("""
    SELECT d.doc_id AS id, coalesce(CAST(quality AS VARCHAR), 'unknown') AS quality, 'web' AS origin, d.lang AS language
    FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id WHERE source IS NOT NULL""")
def project_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Required fields, defaults, renaming and projection as one pipeline."""
    d = t(spark, sf_dir, "documents").join(t(spark, sf_dir, "labels").select("doc_id", F.col("quality").cast("string").alias("quality")), "doc_id", "left")
    p = items.Pipeline(items.required_fields("source"), items.default_values(quality="unknown", origin="web"), items.field_rename(doc_id="id", lang="language"), items.field_filter("id", "quality", "origin", "language"))
    return p(d)


@query("SELECT doc_id, md5(text) AS hash FROM documents QUALIFY row_number() OVER (PARTITION BY coalesce(nullif(text, ''), 'doc/' || doc_id) ORDER BY doc_id) = 1")
def dedup_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = t(spark, sf_dir, "documents").select("doc_id", F.sha2("text", 256).alias("key"), F.md5("text").alias("hash"), F.concat(F.lit("doc/"), "doc_id").alias("_url"), "text")
    d = d.withColumn("key", F.when(F.col("text") != "", F.col("key"))).drop("text")
    return items.dedup("key", "_url", ("doc_id",))(d).select("doc_id", "hash")


DATES = ("yyyy-MM-dd", "yyyy-MM-dd'T'HH:mm:ss'Z'", "MM/dd/yyyy", "MMMM d, yyyy", "d MMM yyyy", "dd-MMM-yyyy", "yyyy/MM/dd", "MMM d, yyyy")


@query("SELECT o_orderkey, CASE WHEN o_orderkey % 9 = 8 THEN 'soon' ELSE strftime(o_orderdate, '%Y-%m-%d') END AS day FROM orders")
def date_normalize(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("o_orderkey") % 9
    raw = F.coalesce(*[F.when(k == i, F.date_format("o_orderdate", p)) for i, p in enumerate(DATES)], F.lit("soon"))
    d = t(spark, sf_dir, "orders").select("o_orderkey", raw.alias("day"))
    return items.date_normalize("day", out="yyyy-MM-dd")(d)


@query("SELECT p_partkey, printf('%.2f', p_retailprice) AS price FROM part")
def currency_normalize(spark: SparkSession, sf_dir: str) -> DataFrame:
    us = F.format_number("p_retailprice", 2)
    eu = F.translate(us, ",.", ".,")
    k = F.col("p_partkey") % 3
    raw = F.when(k == 0, F.concat(F.lit("$"), us)).when((k == 1), F.concat(F.lit("€ "), eu)).otherwise(F.concat(F.lit("USD "), F.format_string("%.2f", "p_retailprice")))
    return items.currency_normalize("price")(t(spark, sf_dir, "part").select("p_partkey", raw.alias("price")))


@query("""
    SELECT l_orderkey, l_linenumber, CAST(l_quantity AS BIGINT) AS quantity, l_extendedprice AS price, l_returnflag = 'R' AS returned
    FROM lineitem""")
def type_coercion(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = t(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", F.concat(F.lit(" "), F.col("l_quantity").cast("int"), F.lit(" pcs")).alias("quantity"), F.concat(F.col("l_extendedprice").cast("string"), F.lit("$")).alias("price"), F.when(F.col("l_returnflag") == "R", "YES").otherwise("no").alias("returned"))
    return items.type_coercion(quantity="int", price="float", returned="bool")(d)


@query("SELECT doc_id, " + CUT.format("text", 200, "...") + " AS short FROM documents")
def truncate_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return t(spark, sf_dir, "documents").select("doc_id", text.truncate(F.col("text"), 200).alias("short"))


@query("""
    WITH c AS (SELECT conv_id, turn, text, lead(text) OVER (PARTITION BY conv_id ORDER BY turn) AS nxt FROM conversations),
         w AS (SELECT *, list_distinct(list_filter(regexp_split_to_array(lower(text), '[\\s\\p{Z}]+'), lambda x: x <> '')) AS a, list_distinct(list_filter(regexp_split_to_array(lower(nxt), '[\\s\\p{Z}]+'), lambda x: x <> '')) AS b FROM c WHERE nxt IS NOT NULL)
    SELECT conv_id, turn, round(CASE WHEN text = nxt THEN 1.0 WHEN text = '' OR nxt = '' THEN 0.0 ELSE len(list_intersect(a, b)) / (len(a) + len(b) - len(list_intersect(a, b))) END, 6) AS similarity FROM w""")
def text_similarity(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = t(spark, sf_dir, "conversations").withColumn("nxt", F.lead("text").over(Window.partitionBy("conv_id").orderBy("turn"))).where("nxt IS NOT NULL")
    return c.select("conv_id", "turn", F.round(text.jaccard(F.col("text"), F.col("nxt")), 6).alias("similarity"))


@query("""
    WITH c AS (SELECT conv_id, turn, text, lead(text, 2) OVER (PARTITION BY conv_id ORDER BY turn) AS nxt FROM conversations),
         l AS (SELECT conv_id, turn, list_filter(list_transform(string_split(text, chr(10)), lambda x: trim(x)), lambda x: x <> '') AS a, list_filter(list_transform(string_split(nxt, chr(10)), lambda x: trim(x)), lambda x: x <> '') AS b FROM c WHERE nxt IS NOT NULL)
    SELECT conv_id, turn, array_to_string(list_filter(b, lambda x: NOT list_contains(a, x)), '|') AS added, array_to_string(list_filter(a, lambda x: NOT list_contains(b, x)), '|') AS removed FROM l""")
def diff_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = t(spark, sf_dir, "conversations").withColumn("nxt", F.lead("text", 2).over(Window.partitionBy("conv_id").orderBy("turn"))).where("nxt IS NOT NULL")
    d = c.withColumn("d", monitor.diff_lines(F.col("text"), F.col("nxt")))
    return d.select("conv_id", "turn", _json_list(F.col("d.added")).alias("added"), _json_list(F.col("d.removed")).alias("removed"))


SNAP = "CASE WHEN strlen({0}) > 200 THEN left({0}, CAST(list_max(list_filter(range(0, 198), lambda k: strlen(left({0}, k)) <= 197)) AS BIGINT)) || '...' ELSE {0} END"


@query(f"""
    WITH o AS (SELECT 'c/' || conv_id || '/' || turn AS url, role, text FROM conversations), n AS (SELECT 'c/' || conv_id || '/' || (turn - 2) AS url, CASE WHEN conv_id % 5 = 0 THEN NULL ELSE role END AS role, text FROM conversations),
         f AS (SELECT url, 'role' AS field, o.role AS a, n.role AS b FROM o JOIN n USING (url) UNION ALL SELECT url, 'text', o.text, n.text FROM o JOIN n USING (url))
    SELECT url, 'added' AS type, NULL AS field, NULL AS old_value, NULL AS new_value FROM n WHERE url NOT IN (SELECT url FROM o)
    UNION ALL SELECT url, CASE WHEN b IS NULL THEN 'removed' ELSE 'modified' END, field, {SNAP.format("a")}, {SNAP.format("b")} FROM f WHERE (b IS NULL AND a IS NOT NULL) OR coalesce(a, '') <> b""")
def detect_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every turn of a conversation as the old version of a page, the one two turns on as the new one."""
    c = t(spark, sf_dir, "conversations")
    at = lambda back: F.concat(F.lit("c/"), "conv_id", F.lit("/"), F.col("turn") - back)
    new = c.withColumn("url", at(2)).withColumn("role", F.when(F.col("conv_id") % 5 != 0, F.col("role")))
    return monitor.detect_changes(c.withColumn("url", at(0)), new, ("role", "text"))


@query("SELECT doc_id, substr(sha256(text), 1, 16) AS content_hash, md5(text) AS body FROM documents")
def content_hashes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return t(spark, sf_dir, "documents").select("doc_id", text.content_hash(F.col("text")).alias("content_hash"), F.md5("text").alias("body"))


@query("SELECT doc_id, CASE WHEN count(*) OVER (PARTITION BY sha256(text)) > 1 THEN min(doc_id) OVER (PARTITION BY sha256(text)) ELSE -1 END AS first_copy FROM documents")
def content_copies(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = t(spark, sf_dir, "documents").select("doc_id", F.sha2("text", 256).alias("h"))
    g = d.groupBy("h").agg(F.count("*").alias("n"), F.min("doc_id").alias("m"))
    return d.join(g, "h").select("doc_id", F.when(F.col("n") > 1, F.col("m")).otherwise(-1).alias("first_copy"))


@query("""
    SELECT page_id, trim(regexp_extract(html, '(?s)<title>(.*?)</title>', 1)) AS title, 'https://***@' || regexp_extract(url, '//([^/]*)', 1) AS dsn,
           replace('p.' || page_id || ':x', '.', '\\.') AS half FROM (SELECT * FROM pages)""".replace("replace('p.' || page_id || ':x', '.', '\\.')", "replace(replace('p.' || page_id || ':x', '.', '\\.'), ':', '\\:')"))
def text_helpers(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = t(spark, sf_dir, "pages")
    dsn = F.concat(F.lit("https://me:secret@"), urls.host(F.col("url")))
    return p.select("page_id", text.trim(text.between(F.col("html"), "<title>", "</title>")).alias("title"), text.mask_dsn(dsn).alias("dsn"), text.css_escape(F.concat(F.lit("p."), "page_id", F.lit(":x"))).alias("half"))


@query("""
    SELECT p_partkey, CASE WHEN n < 1024 THEN printf('%d B', n) WHEN n < 1048576 THEN printf('%.1f KB', n / 1024.0) WHEN n < 1073741824 THEN printf('%.1f MB', n / 1048576.0) ELSE printf('%.1f GB', n / 1073741824.0) END AS size,
           '$' || printf('%.2f', p_retailprice) AS price
    FROM (SELECT *, CAST(p_partkey * p_partkey * p_partkey AS BIGINT) AS n FROM part)""")
def human_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = (F.col("p_partkey") * F.col("p_partkey") * F.col("p_partkey")).cast("bigint")
    price = normalize.find_price(F.concat(F.lit("only $"), F.format_string("%.2f", "p_retailprice"), F.lit(" today")))
    return t(spark, sf_dir, "part").select("p_partkey", text.human_bytes(n).alias("size"), price.alias("price"))


@query("""
    SELECT c_custkey, CASE c_custkey % 4 WHEN 0 THEN 5 WHEN 1 THEN CAST(least(c_custkey, 120) AS INTEGER) WHEN 2 THEN CAST(least(c_custkey, 120) AS INTEGER) ELSE 1 END AS wait,
           CASE WHEN c_custkey % 50 < 30 AND c_custkey % 90 > w AND w < 64 THEN least(64, w + s) WHEN c_custkey % 50 > 45 AND w > 2 THEN greatest(2, w - s) ELSE w END AS workers
    FROM (SELECT *, CAST(c_custkey % 64 + 1 AS INTEGER) AS w, CASE WHEN c_custkey % 64 + 1 < 5 THEN 1 WHEN c_custkey % 64 + 1 < 20 THEN 2 WHEN c_custkey % 64 + 1 < 50 THEN 5 ELSE 10 END AS s FROM customer)""")
def backoff_and_scale(spark: SparkSession, sf_dir: str) -> DataFrame:
    k, now = F.col("c_custkey"), F.lit("2024-01-01 00:00:00").cast("timestamp")
    head = F.when(k % 4 == 0, F.lit(None).cast("string")).when(k % 4 == 1, k.cast("string")).when(k % 4 == 2, F.date_format(F.timestamp_add("SECOND", k.cast("int"), now), "EEE, dd MMM yyyy HH:mm:ss 'GMT'")).otherwise("Sun, 31 Dec 2023 00:00:00 GMT")
    load = (k % 50) / 49.0
    util = F.when(k % 50 < 30, 0.5).when(k % 50 > 45, 0.9).otherwise(0.7)
    workers = (k % 64 + 1).cast("int")
    return t(spark, sf_dir, "customer").withColumn("_l", load).select("c_custkey", normalize.retry_after_seconds(head, now).alias("wait"), normalize.scale_decision(util, util, workers, (k % 90).cast("int")).alias("workers"))


# -- responses: classifiers

EVENT_STATUS = "CASE event_type WHEN 'view' THEN 200 WHEN 'click' THEN 301 WHEN 'signup' THEN 404 WHEN 'purchase' THEN 429 ELSE 503 END"


def _responses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as responses: a status per type, the value as size, errors as failures."""
    e = t(spark, sf_dir, "events")
    return e.select("event_id", "ts", "user_id", "event_type", F.expr(EVENT_STATUS).alias("status"), F.floor("value").cast("bigint").alias("bytes"), (F.col("event_id") % 3).cast("int").alias("retries"), F.when(F.col("event_type") == "error", F.when(F.col("event_id") % 2 == 0, "timeout").otherwise("canceled")).alias("error"), "value", "props")


@query("""
    SELECT event_id, status = 429 OR (status = 403 AND (k = 0 OR k = 1)) AS limited, status IN (403, 503) AND k < 60 AS challenge, status IN (403, 503) AND k < 30 AS strict, k % 2 = 0 AND event_type = 'error' AS retryable
    FROM (SELECT event_id, event_type, CASE event_type WHEN 'view' THEN 200 WHEN 'click' THEN 403 WHEN 'signup' THEN 404 WHEN 'purchase' THEN 429 ELSE 503 END AS status, CAST(json_extract(props, '$.k') AS INTEGER) AS k FROM events)""")
def response_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rate limits, challenges and retryable errors over synthesised headers and bodies."""
    k = F.get_json_object("props", "$.k").cast("int")
    status = F.expr("CASE event_type WHEN 'view' THEN 200 WHEN 'click' THEN 403 WHEN 'signup' THEN 404 WHEN 'purchase' THEN 429 ELSE 503 END")
    headers = F.map_from_arrays(F.array(F.lit("X-RateLimit-Remaining"), F.lit("Retry-After"), F.lit("Server")), F.array(F.when(k == 0, "0").otherwise("9"), F.when(k == 1, "30").otherwise(""), F.when(k < 50, "cloudflare").otherwise("nginx")))
    body = F.when((k < 30) | ((k >= 50) & (k < 60)), "<p>CF-Browser-Verification").otherwise("<p>hello")
    error = F.when(F.col("event_type") == "error", F.when(k % 2 == 0, "timeout").otherwise("canceled"))
    return t(spark, sf_dir, "events").select("event_id", pages.is_rate_limited(status, headers).alias("limited"), pages.is_challenge(status, headers, body).alias("challenge"), pages.is_challenge(status, headers, body, strict=True).alias("strict"), pages.is_retryable(error).alias("retryable"))


BODIES = ("<div class='G-ReCaptcha' data-sitekey=\"k1\">", "<script src='recaptcha/api.js?render=z'></script><i data-sitekey=\"k2\">", "<div class='h-captcha' data-sitekey=\"k3\">", "<div class='cf-turnstile' data-sitekey=\"k4\">", "<p>solve the captcha</p>", "<p>fine</p>")


@query("""
    SELECT page_id, CASE page_id % 6 WHEN 0 THEN 'g-recaptcha' WHEN 1 THEN 'captcha' WHEN 2 THEN 'h-captcha' WHEN 3 THEN 'cf-turnstile' WHEN 4 THEN 'captcha' END AS marker,
           CASE page_id % 6 WHEN 0 THEN 'recaptcha_v2:k1' WHEN 1 THEN 'recaptcha_v3:k2' WHEN 2 THEN 'hcaptcha:k3' WHEN 3 THEN 'turnstile:k4' END AS kind FROM pages""")
def captcha_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    body = F.concat(F.element_at(F.array(*[F.lit(b) for b in BODIES]), (F.col("page_id") % 6 + 1).cast("int")), "html")
    kind = pages.captcha_kind(body)
    return t(spark, sf_dir, "pages").select("page_id", pages.captcha_marker(body).alias("marker"), F.concat(kind["kind"], F.lit(":"), kind["site_key"]).alias("kind"))


@query("SELECT page_id, ['image', 'video', 'audio', 'document', 'document', 'other'][page_id % 6 + 1] AS class FROM pages")
def media_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    mime = F.element_at(F.array(*[F.lit(m) for m in ("Image/png", "video/mp4", "audio/mpeg", "application/pdf", "application/vnd.ms-excel", "text/html")]), (F.col("page_id") % 6 + 1).cast("int"))
    return t(spark, sf_dir, "pages").select("page_id", normalize.media_class(mime).alias("class"))


# -- aggregates

RESP = f"(SELECT event_id, ts, user_id, event_type, {EVENT_STATUS} AS status, CAST(floor(value) AS BIGINT) AS bytes, event_id % 3 AS retries, CASE WHEN event_type = 'error' THEN 'x' END AS error, value FROM events)"


@query(f"""
    SELECT user_id, count(*) AS requests, count(status) AS responses, count(*) FILTER (WHERE status BETWEEN 200 AND 299) AS success, count(*) FILTER (WHERE status BETWEEN 300 AND 399) AS redirects,
           count(*) FILTER (WHERE status BETWEEN 400 AND 499) AS client_errors, count(*) FILTER (WHERE status BETWEEN 500 AND 599) AS server_errors, count(error) AS failed, CAST(sum(retries) AS BIGINT) AS retries, CAST(sum(bytes) AS BIGINT) AS bytes
    FROM {RESP} GROUP BY user_id""")
def crawl_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stats.crawl_stats(_responses(spark, sf_dir), ("user_id",))


@query(f"SELECT user_id, count(*) AS requests, count(error) AS errors, max(ts) AS last_fetch FROM {RESP} GROUP BY user_id")
def host_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stats.host_stats(_responses(spark, sf_dir), "user_id")


@query(f"""
    WITH s AS (SELECT count(*) AS requests, count(status) AS responses, count(*) FILTER (WHERE status BETWEEN 200 AND 299) AS success, count(*) FILTER (WHERE status BETWEEN 300 AND 399) AS redirects,
           count(*) FILTER (WHERE status BETWEEN 400 AND 499) AS client_errors, count(*) FILTER (WHERE status BETWEEN 500 AND 599) AS server_errors, count(error) AS failed, CAST(sum(retries) AS BIGINT) AS retries, CAST(sum(bytes) AS BIGINT) AS bytes FROM {RESP})
    SELECT '# HELP crawl_' || name || ' Total ' || name || chr(10) || '# TYPE crawl_' || name || ' counter' || chr(10) || 'crawl_' || name || ' ' || value AS line FROM (UNPIVOT s ON COLUMNS(*) INTO NAME name VALUE value)""")
def prometheus_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = stats.long_metrics(stats.crawl_stats(_responses(spark, sf_dir)))
    return stats.prometheus(m.withColumn("help", F.concat(F.lit("Total "), "name")))


def _pct(p: str, n: str = "len(v)") -> str:
    return f"v[least(CAST(floor({n} * {p} / 100) AS BIGINT) + 1, {n})]"


@query(f"SELECT event_type, len(v) AS n, {_pct('50')} AS p50, {_pct('95')} AS p95, {_pct('99')} AS p99, {_pct('99.9')} AS p99_9 FROM (SELECT event_type, list_sort(list(value)) AS v FROM events GROUP BY event_type)")
def value_percentiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stats.floor_percentiles(t(spark, sf_dir, "events"), "value", (50, 95, 99, 99.9), ("event_type",))


@query(f"""
    SELECT event_type, len(v) AS total, ok, len(v) - ok AS failed, round(len(v) / 60.0, 6) AS per_second, round((len(v) - ok) * 100.0 / len(v), 6) AS error_percent, round(a, 6) AS avg_ms, v[1] AS min_ms, v[-1] AS max_ms, {_pct('50')} AS p50, {_pct('99')} AS p99
    FROM (SELECT event_type, list_sort(list(value)) AS v, count(*) FILTER (WHERE user_id % 4 <> 0) AS ok, avg(value) AS a FROM events GROUP BY event_type)""")
def latency_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = t(spark, sf_dir, "events").select("event_type", F.col("value").alias("ms"), (F.col("user_id") % 4 != 0).alias("ok"), F.lit(1).alias("bytes"))
    r = stats.latency_report(s, 60.0, ("event_type",))
    return r.select("event_type", "total", "ok", "failed", *[F.round(c, 6).alias(c) for c in ("per_second", "error_percent", "avg_ms")], "min_ms", "max_ms", "p50", "p99")


@query("""
    WITH tasks AS (SELECT CASE o_orderstatus WHEN 'O' THEN 'pending' WHEN 'P' THEN 'running' ELSE 'done' END AS status FROM orders)
    SELECT (SELECT count(*) FROM supplier) AS nodes, count(*) FILTER (WHERE status = 'pending') AS pending, count(*) FILTER (WHERE status = 'running') AS running, count(*) FILTER (WHERE status = 'done') AS done FROM tasks""")
def cluster_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = t(spark, sf_dir, "orders").select(F.expr("CASE o_orderstatus WHEN 'O' THEN 'pending' WHEN 'P' THEN 'running' ELSE 'done' END").alias("status"))
    return stats.cluster_status(o, t(spark, sf_dir, "supplier"))


@query("""
    WITH free AS (SELECT s_suppkey AS node_id, unnest(range(CAST(s_suppkey % 5 AS BIGINT), 0, -1)) AS slots FROM supplier WHERE s_suppkey % 7 <> 0),
         s AS (SELECT node_id, row_number() OVER (ORDER BY slots DESC, node_id) AS turn FROM free),
         q AS (SELECT o_orderkey AS task_id, row_number() OVER (ORDER BY CAST(left(o_orderpriority, 1) AS INTEGER), o_orderkey) AS turn FROM orders WHERE o_orderstatus = 'O')
    SELECT task_id, node_id FROM q JOIN s USING (turn)""")
def assign_tasks(spark: SparkSession, sf_dir: str) -> DataFrame:
    nodes = t(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("id"), (F.col("s_suppkey") % 5).cast("int").alias("capacity"), F.lit(0).alias("active_jobs"), F.when(F.col("s_suppkey") % 7 != 0, "active").otherwise("offline").alias("status"))
    tasks = t(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), F.substring("o_orderpriority", 1, 1).cast("int").alias("priority"), F.when(F.col("o_orderstatus") == "O", "pending").otherwise("done").alias("status"))
    return frontier.assign_tasks(tasks, nodes)


@query("SELECT user_id, arg_max(event_type, (ts, event_id)) AS status, max(ts) AS last_seen FROM events GROUP BY user_id")
def task_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stats.latest_status(t(spark, sf_dir, "events"), "user_id", "ts", "event_type", "event_id")


@query("SELECT user_id AS node, max(ts) AS last_seen, epoch_us((SELECT max(ts) FROM events)) - epoch_us(max(ts)) > 3600 * 1000000::BIGINT AS offline FROM events GROUP BY user_id")
def node_liveness(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stats.offline_nodes(t(spark, sf_dir, "events").withColumnRenamed("user_id", "node"), 3600)


@query("SELECT count(*) AS spans, count(*) FILTER (WHERE event_type = 'error') AS errors, CAST(sum(CAST(floor(value * 1000000) AS BIGINT)) // count(*) // 1000000 AS BIGINT) AS mean_ms FROM events")
def trace_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = t(spark, sf_dir, "events").select(F.floor(F.col("value") * 1000000).cast("bigint").alias("duration_ns"), F.when(F.col("event_type") == "error", "error").otherwise("ok").alias("status"))
    return stats.trace_stats(s)


@query("""
    SELECT user_id, CAST(count(*) AS INTEGER) AS tries, CASE WHEN s < 400 AND e IS NULL THEN 'done' WHEN (s = 429 OR s >= 500 OR coalesce(e = 'timeout', false)) AND count(*) <= 70 THEN 'retry' ELSE 'failed' END AS outcome
    FROM (SELECT user_id, arg_max(status, (ts, status)) OVER w AS s, CASE WHEN arg_max(event_type, (ts, status)) OVER w = 'error' THEN CASE WHEN arg_max(event_id, (ts, status)) OVER w % 2 = 0 THEN 'timeout' ELSE 'canceled' END END AS e
          FROM """ + RESP + """ WINDOW w AS (PARTITION BY user_id)) GROUP BY user_id, s, e""")
def retry_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return crawl.retry_plan(_responses(spark, sf_dir), 70, "user_id").select("user_id", "tries", "outcome")


# -- order-dependent operators


@query("""
    WITH e AS (SELECT event_id, user_id, epoch_us(ts) / 1000000.0 AS a, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS i FROM events)
    SELECT event_id, round(max(a - i * 3600) OVER (PARTITION BY user_id ORDER BY i ROWS UNBOUNDED PRECEDING) + i * 3600, 3) AS start FROM e""")
def throttle(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = t(spark, sf_dir, "events").select("event_id", "user_id", (F.unix_micros(F.col("ts").cast("timestamp")) / 1000000.0).alias("arrival"))
    return frontier.throttle(e, 3600.0, "arrival", ("user_id",), ("event_id",)).select("event_id", F.round("start", 3).alias("start"))


@query("""
    WITH e AS (SELECT event_id, user_id, ts, value < 20 AS idle, sum(CASE WHEN value < 20 THEN 0 ELSE 1 END) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS run FROM events)
    SELECT event_id, CAST(sum(CAST(idle AS INTEGER)) OVER (PARTITION BY user_id, run ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS INTEGER) AS streak FROM e""")
def idle_streaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return frontier.idle_streaks(t(spark, sf_dir, "events"), F.col("value") < 20, ("ts", "event_id"), ("user_id",)).select("event_id", "streak")


@query("SELECT event_id, ['a', 'b', 'c'][row_number() OVER (PARTITION BY user_id ORDER BY event_id) % 3 + 1] AS choice FROM events")
def round_robin(spark: SparkSession, sf_dir: str) -> DataFrame:
    return frontier.round_robin(t(spark, sf_dir, "events"), ("a", "b", "c"), ("event_id",), ("user_id",)).select("event_id", "choice")


@query("SELECT o_custkey, o_orderkey, CAST((row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) - 1) // 4 AS INTEGER) AS batch FROM orders")
def task_batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    return frontier.chunk(t(spark, sf_dir, "orders"), 4, ("o_orderdate", "o_orderkey"), ("o_custkey",)).select("o_custkey", "o_orderkey", "batch")


# -- sets


@query("SELECT name, count(*) AS n FROM (SELECT n_name AS name FROM nation UNION ALL SELECT r_name FROM region UNION ALL SELECT c_mktsegment FROM customer) GROUP BY name")
def union_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    a, b, c = (t(spark, sf_dir, x).select(F.col(y).alias("name")) for x, y in (("nation", "n_name"), ("region", "r_name"), ("customer", "c_mktsegment")))
    return a.unionByName(b, allowMissingColumns=True).unionByName(c, allowMissingColumns=True).groupBy("name").agg(F.count("*").alias("n"))


@query("SELECT o_custkey AS k FROM orders UNION SELECT c_custkey FROM customer")
def merge_seen(spark: SparkSession, sf_dir: str) -> DataFrame:
    return t(spark, sf_dir, "orders").select(F.col("o_custkey").alias("k")).union(t(spark, sf_dir, "customer").select("c_custkey")).distinct()


@query("SELECT count(DISTINCT url) AS exact, CAST(9586 AS BIGINT) AS bits, CAST(7 AS INTEGER) AS hashes FROM pages")
def distinct_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    m, k = stats.bloom_shape(1000, 0.01)
    return t(spark, sf_dir, "pages").agg(F.count_distinct("url").alias("exact")).select("exact", F.lit(m).cast("bigint").alias("bits"), F.lit(k).alias("hashes"))


# -- sinks: the projections they write


@query("""
    SELECT 'https://c.example/' || c_custkey AS key, '{"url":"https://c.example/' || c_custkey || '","spider":"s","fields":{"name":"' || c_name || '","nation":' || c_nationkey || '},"scraped_at":"2024-01-01T00:00:00Z"}' AS value FROM customer""")
def message_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = t(spark, sf_dir, "customer").select(F.concat(F.lit("https://c.example/"), "c_custkey").alias("_url"), F.lit("s").alias("_spider"), F.lit("2024-01-01").cast("timestamp").alias("_timestamp"), F.col("c_name").alias("name"), F.col("c_nationkey").alias("nation"))
    return sinks.message_rows(c)


@query("""SELECT '{"name":"' || c_name || '","segment":"' || c_mktsegment || '"}' AS fields, 'https://c.example/' || c_custkey AS url, 's' AS spider_name FROM customer""")
def table_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = t(spark, sf_dir, "customer").select(F.concat(F.lit("https://c.example/"), "c_custkey").alias("_url"), F.lit("s").alias("_spider"), F.lit("2024-01-01").cast("timestamp").alias("_timestamp"), F.col("c_name").alias("name"), F.col("c_mktsegment").alias("segment"))
    return sinks.table_rows(c).drop("scraped_at")


@query("""SELECT CAST(c_custkey AS VARCHAR) AS c_custkey, c_name, '["' || c_mktsegment || '","x"]' AS tags, strftime(TIMESTAMP '2024-01-01', '%Y-%m-%dT%H:%M:%SZ') AS "when" FROM customer""")
def csv_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = t(spark, sf_dir, "customer").select("c_custkey", "c_name", F.array("c_mktsegment", F.lit("x")).alias("tags"), F.lit("2024-01-01").cast("timestamp").alias("when"))
    return sinks.flat_rows(c)


@query("""SELECT s_suppkey, CASE WHEN s_suppkey % 2 = 0 THEN '"' || s_name || '"' ELSE '["' || s_name || '","b"]' END AS j FROM supplier""")
def scalar_or_array(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = F.when(F.col("s_suppkey") % 2 == 0, F.array("s_name")).otherwise(F.array("s_name", F.lit("b")))
    return t(spark, sf_dir, "supplier").select("s_suppkey", items.scalar_or_array(v).alias("j"))


@query("""SELECT s_suppkey, '{"fields":{"s_name":"' || s_name || '"},"url":"u' || s_suppkey || '"}' AS j FROM supplier""")
def item_envelope(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = t(spark, sf_dir, "supplier").withColumn("_url", F.concat(F.lit("u"), "s_suppkey"))
    return s.select("s_suppkey", items.envelope(s, ["s_name"]).alias("j"))


@query("SELECT s_suppkey, CASE WHEN s_suppkey % 2 = 0 THEN s_name ELSE 'none' END AS label, 'v1' AS version, CAST(2 AS INTEGER) AS n FROM supplier")
def map_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Open items as maps: defaults, renaming, projection."""
    m = F.when(F.col("s_suppkey") % 2 == 0, F.create_map(F.lit("name"), "s_name", F.lit("junk"), F.lit("x"))).otherwise(F.create_map(F.lit("junk"), F.lit("x")))
    m = items.map_filter_fields(items.map_rename(items.map_defaults(m, name="none", version="v1"), name="label"), "label", "version")
    return t(spark, sf_dir, "supplier").select("s_suppkey", m.alias("m")).select("s_suppkey", F.element_at("m", "label").alias("label"), F.element_at("m", "version").alias("version"), F.size("m").alias("n"))


@query("SELECT conv_id, count(*) FILTER (WHERE strlen(text) <= 500) AS small FROM conversations GROUP BY conv_id HAVING count(*) FILTER (WHERE strlen(text) <= 500) > 0")
def body_cap(spark: SparkSession, sf_dir: str) -> DataFrame:
    return files.cap_body(t(spark, sf_dir, "conversations"), 500, "text").groupBy("conv_id").agg(F.count("*").alias("small"))


# -- pages built from the star schema: what the pages table lacks


def _html(head: str, *parts: Column) -> Column:
    return F.concat(F.lit(f"<html><head>{head}</head><body>"), *parts, F.lit("</body></html>"))


@query("SELECT r_name AS page, CAST(row_number() OVER (PARTITION BY r_name ORDER BY n_nationkey) - 1 AS INTEGER) AS place, CAST(n_nationkey AS VARCHAR) AS key, n_name AS name FROM nation JOIN region ON n_regionkey = r_regionkey")
def html_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A page per region with a table of its nations, read back as rows."""
    n = t(spark, sf_dir, "nation").join(t(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    row = F.struct("n_nationkey", F.concat(F.lit("<tr><td> "), "n_nationkey", F.lit("<td>"), "n_name", F.lit("</tr>")).alias("h"))
    page = n.groupBy("r_name").agg(F.array_join(F.transform(F.sort_array(F.collect_list(row)), lambda x: x["h"]), "").alias("rows"))
    p = page.select(F.col("r_name").alias("url"), _html("", F.lit("<table><tr><th>Key<th>Name</tr>"), F.col("rows"), F.lit("</table>")).alias("html"))
    x = pages.auto_extract(p, ("url",)).where("type = 'data'").select("url", F.explode("tables").alias("t")).select("url", F.posexplode("t.rows").alias("place", "r"))
    return x.select(F.col("url").alias("page"), "place", F.element_at("r", "Key").alias("key"), F.element_at("r", "Name").alias("name"))


@query("SELECT p_brand AS page, 'listing' AS type, p_name || ' ' || p_partkey AS name, '$' || printf('%.2f', p_retailprice) AS price, '/p/' || p_partkey AS url, count(*) AS n FROM part WHERE p_brand IN (SELECT p_brand FROM part GROUP BY 1 HAVING count(*) > 2) GROUP BY ALL")
def html_products(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A catalogue page per brand, its products read back; the price is found by its own element or by pattern."""
    odd = F.col("p_partkey") % 2 == 1
    price = F.concat(F.lit("$"), F.format_string("%.2f", "p_retailprice"))
    card = F.concat(F.lit('<div class="product-card"><h2>'), "p_name", F.lit(" "), "p_partkey", F.lit('</h2><a href="/p/'), "p_partkey", F.lit('">more</a>'), F.when(odd, F.concat(F.lit('<span class="price">'), price, F.lit("</span>"))).otherwise(F.concat(F.lit("<i>only "), price, F.lit(" now</i>"))), F.lit("</div>"))
    p = t(spark, sf_dir, "part").groupBy("p_brand").agg(F.array_join(F.collect_list(card), "").alias("cards")).select(F.col("p_brand").alias("url"), _html("", F.col("cards")).alias("html"))
    x = pages.auto_extract(p, ("url",)).where("type = 'listing'").select("url", "type", F.explode("data").alias("d"))
    return x.groupBy(F.col("url").alias("page"), "type", *[F.element_at("d", k).alias(k) for k in ("name", "price", "url")]).agg(F.count("*").alias("n"))


@query("""
    SELECT 's' || s_suppkey AS page, unnest(['json-ld', 'meta', 'microdata', 'opengraph', 'twitter-card']) AS kind,
           unnest([s_name, s_name, s_name, s_name, s_name]) AS name, unnest(['Organization', NULL, 'https://schema.org/Organization', NULL, NULL]) AS type FROM supplier""")
def html_structured(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Supplier pages with every kind of structured data, read back."""
    name = F.col("s_name")
    head = F.concat(F.lit("<html><head><title>"), name, F.lit('</title><meta property="og:name" content="'), name, F.lit('"><meta name="twitter:name" content="'), name, F.lit('"><script id=j type=application/ld+json>{"@type":"Organization","name":"'), name, F.lit('"}</script></head><body><div itemscope itemtype="https://schema.org/Organization"><b itemprop="name"> '), name, F.lit(" </b></div></body></html>"))
    p = t(spark, sf_dir, "supplier").select(F.concat(F.lit("s"), "s_suppkey").alias("url"), head.alias("html"))
    j = lambda k: F.get_json_object("data", f"$['{k}']")
    return pages.structured_data(p, ("url",)).select(F.col("url").alias("page"), "kind", F.coalesce(j("name"), j("title")).alias("name"), j("@type").alias("type"))


@query("SELECT c_custkey, 'article' AS type, c_name AS title, c_mktsegment AS author, '2024-01-02' AS date FROM customer")
def html_articles(spark: SparkSession, sf_dir: str) -> DataFrame:
    body = F.concat(F.lit("<article><h1>"), "c_name", F.lit('</h1><span class="byline">'), "c_mktsegment", F.lit('</span><time datetime="2024-01-02">x</time></article>'))
    p = t(spark, sf_dir, "customer").select("c_custkey", F.col("c_name").alias("url"), _html("", body).alias("html"))
    d = F.element_at(F.filter("data", lambda x: F.element_at(x, "_type") == "article"), 1)
    return pages.auto_extract(p, ("c_custkey",)).select("c_custkey", "type", *[F.element_at(d, k).alias(k) for k in ("title", "author", "date")])


@query(f"SELECT page_id, {CANON} AS canonical FROM pages WHERE {CANON} NOT IN (SELECT {CANON} FROM pages WHERE page_id % 3 = 0)")
def bloom_unseen(spark: SparkSession, sf_dir: str) -> DataFrame:
    """As unseen_urls, through a Bloom filter and an exact check of its positives."""
    k = frontier.keyed(t(spark, sf_dir, "pages"))
    return bloom.hybrid_unseen(k.select("page_id", "canonical"), k.where("page_id % 3 = 0").select("canonical"), "canonical", 100_000)


@query("""
    WITH e AS (SELECT event_id, epoch_us(ts) / 1000000.0 AS a, row_number() OVER (ORDER BY ts, event_id) - 1 AS i FROM events)
    SELECT event_id, round(max(a - i * 120) OVER (ORDER BY i ROWS UNBOUNDED PRECEDING) + i * 120, 3) AS start FROM e""")
def rate_limit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One limit for all requests: the throttle with a single group."""
    e = t(spark, sf_dir, "events").select("event_id", (F.unix_micros(F.col("ts").cast("timestamp")) / 1000000.0).alias("arrival"))
    return frontier.throttle(e, 120.0, "arrival", (), ("event_id",)).select("event_id", F.round("start", 3).alias("start"))


@query("SELECT count(*) AS sessions, CAST(sum(n) AS BIGINT) AS requests, max(age) AS oldest_s FROM (SELECT user_id, count(*) AS n, CAST(floor(epoch_us(max(ts)) / 1000000) - floor(epoch_us(min(ts)) / 1000000) AS BIGINT) AS age FROM events GROUP BY user_id)")
def session_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    u = t(spark, sf_dir, "events").groupBy("user_id").agg(F.count("*").alias("n"), (F.unix_seconds(F.max("ts").cast("timestamp")) - F.unix_seconds(F.min("ts").cast("timestamp"))).alias("age"))
    return u.agg(F.count("*").alias("sessions"), F.sum("n").alias("requests"), F.max("age").alias("oldest_s"))


@query("SELECT p_partkey, CAST(CASE WHEN k = 1 THEN 1.0 WHEN k <= 3 THEN 0.8 WHEN k <= 10 THEN 0.5 ELSE 0.2 END AS DOUBLE) AS by_text, round(CAST(CASE WHEN k = 1 THEN 1.0 WHEN k <= 3 THEN 0.8 ELSE 1.0 / k END AS DOUBLE), 6) AS by_element FROM (SELECT p_partkey, p_partkey % 20 + 1 AS k FROM part)")
def selector_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("p_partkey") % 20 + 1
    return t(spark, sf_dir, "part").select("p_partkey", normalize.match_score(k).alias("by_text"), F.round(normalize.match_score(k, 1.0), 6).alias("by_element"))


@query("SELECT time_bucket(INTERVAL 6 HOUR, ts) AS start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1, 2")
def stream_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as a stream, counted in six-hour windows until it is drained; the final state is read back (an extension)."""
    root = crawl.work_dir(spark).rstrip("/") + f"/stream-{uuid.uuid4().hex}"
    schema = t(spark, sf_dir, "events").schema
    src = spark.readStream.schema(schema).parquet(f"{sf_dir}/events.parquet*").withColumn("ts", F.col("ts").cast("timestamp"))
    counts = changes.stream_windows(src, size="6 hours", late="40 days")
    q = counts.writeStream.outputMode("complete").foreachBatch(lambda df, k: df.write.mode("overwrite").parquet(f"{root}/out")).option("checkpointLocation", f"{root}/cp").trigger(availableNow=True).start()
    q.awaitTermination()
    return spark.read.parquet(f"{root}/out").select(F.col("window.start").cast("timestamp_ntz").alias("start"), "event_type", "n", F.round("total", 4).alias("total"))


@query("""
    SELECT event_id, CASE event_type WHEN 'signup' THEN 'not_found' WHEN 'purchase' THEN 'rate_limited' WHEN 'error' THEN CASE WHEN event_id % 2 = 0 THEN 'timeout' ELSE 'canceled' END END AS error_class,
           'fetch' AS stage, event_type = 'purchase' OR (event_type = 'error' AND event_id % 2 = 0) AS retryable
    FROM events WHERE event_type IN ('signup', 'purchase', 'error')""")
def rejects(spark: SparkSession, sf_dir: str) -> DataFrame:
    return crawl.rejects(_responses(spark, sf_dir)).select("event_id", "error_class", "stage", "retryable")


@query("SELECT 'https://' || host AS origin, 'https://' || host || unnest(['/sitemap.xml', '/sitemap_index.xml', '/sitemap/sitemap.xml']) AS candidate FROM (SELECT DISTINCT regexp_extract(url, '//([^/]*)', 1) AS host FROM pages)")
def sitemap_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = frontier.keyed(t(spark, sf_dir, "pages").select("url")).select(F.concat(F.lit("https://"), "host").alias("origin")).distinct()
    return crawl.sitemap_candidates(k)


@query("SELECT c_mktsegment AS page, CAST(row_number() OVER (PARTITION BY c_mktsegment ORDER BY c_custkey) - 1 AS INTEGER) AS position, c_name AS quote, 'by ' || c_nationkey AS \"by\", 't' || c_custkey || '|x' AS tags FROM customer")
def recipe_quotes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers as quotes on a page per segment, read back by a ready rule set."""
    box = F.concat(F.lit('<div class="quote"><span class="text">'), "c_name", F.lit('</span><small class="author">by '), "c_nationkey", F.lit('</small><a class="tag">t'), "c_custkey", F.lit('</a><a class="tag">x</a></div>'))
    row = F.sort_array(F.collect_list(F.struct("c_custkey", box.alias("h"))))
    p = t(spark, sf_dir, "customer").groupBy("c_mktsegment").agg(F.array_join(F.transform(row, lambda x: x["h"]), "").alias("h")).select(F.col("c_mktsegment").alias("url"), _html("", F.col("h")).alias("html"))
    r = recipes.run_recipe(p, recipes.RECIPES["quotes"])
    return r.select(F.col("url").alias("page"), "position", *[F.element_at("item", k).alias(k) for k in ("quote", "by", "tags")])
