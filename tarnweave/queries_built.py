"""Queries over rows, files, pages and streams that are built from the test tables: sinks read back, language-model fields, spiders, running streams."""

from __future__ import annotations

import gzip
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import extract, text
from .operators import crawl, items, pages, stats
from .plans import ai, recipes, spider
from .queries import SNAP, _html, query, t
from .sources import files, sinks
from .streaming import changes


def _folder(spark: SparkSession) -> str:
    """A new folder within the shared one; it goes when the driver ends."""
    path = f"{crawl.work_dir(spark)}/built-{uuid.uuid4().hex}"
    p, fs = crawl._files(spark, path)
    fs.deleteOnExit(p)
    return path


# -- sinks, written and read back

ITEMS = "SELECT 'https://c.example/' || c_custkey AS _url, c_name AS name, CAST(c_nationkey AS VARCHAR) AS nation, c_mktsegment || ', \"' || c_custkey || '\"' AS note FROM customer"


def _items(spark: SparkSession, sf_dir: str) -> DataFrame:
    return t(spark, sf_dir, "customer").select(F.concat(F.lit("https://c.example/"), "c_custkey").alias("_url"), F.col("c_name").alias("name"), F.col("c_nationkey").cast("string").alias("nation"), F.concat("c_mktsegment", F.lit(', "'), "c_custkey", F.lit('"')).alias("note"))


@query(ITEMS)
def sink_jsonl(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = _folder(spark)
    sinks.write_items(_items(spark, sf_dir), "jsonl", path)
    return spark.read.json(path)


@query(ITEMS)
def sink_csv(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = _folder(spark)
    sinks.write_items(_items(spark, sf_dir), "csv", path)
    return spark.read.option("header", True).option("escape", '"').csv(path)


@query(ITEMS)
def sink_json_array(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = _folder(spark)
    sinks.write_items(_items(spark, sf_dir).repartition(3), "json", f"{path}/items.json")
    return spark.read.option("multiLine", True).json(f"{path}/items.json")


@query("SELECT event_id, CAST(CAST(ts AS DATE) AS VARCHAR) AS date FROM events")
def sink_partitioned(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = _folder(spark)
    sinks.write_partitioned(t(spark, sf_dir, "events").select(F.col("ts").alias("_timestamp"), "event_id"), path)
    return spark.read.json(path).select("event_id", F.col("date").cast("string").alias("date"))


@query(f"SELECT sink, i.* FROM (VALUES ('a'), ('b')) s(sink), ({ITEMS}) i")
def sink_fan_out(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two sinks get all rows although the one between them fails."""
    path = _folder(spark)

    def broken(df: DataFrame) -> None:
        raise OSError("full")

    try:
        sinks.fan_out(_items(spark, sf_dir), [lambda df: sinks.write_jsonl(df, f"{path}/a"), broken, lambda df: sinks.write_jsonl(df, f"{path}/b")])
    except OSError:
        pass
    return spark.read.json(f"{path}/a").withColumn("sink", F.lit("a")).union(spark.read.json(f"{path}/b").withColumn("sink", F.lit("b")))


@query("SELECT 't' || o_orderkey AS id, 'crawl' AS type, 'https://o.example/' || o_orderkey AS url, CAST(left(o_orderpriority, 1) AS INTEGER) AS priority, 'pending' AS status, CAST(NULL AS VARCHAR) AS assigned_to FROM orders")
def queue_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A task queue exported as JSON and imported: whatever was running is pending again."""
    path = _folder(spark)
    tasks = t(spark, sf_dir, "orders").select(F.concat(F.lit("t"), "o_orderkey").alias("id"), F.lit("crawl").alias("type"), F.array(F.concat(F.lit("https://o.example/"), "o_orderkey")).alias("urls"), F.substring("o_orderpriority", 1, 1).cast("int").alias("priority"), F.when(F.col("o_orderstatus") == "P", "running").otherwise("pending").alias("status"), F.lit("node-1").alias("assigned_to"))
    files.export_queue(tasks).write.text(path)
    return files.import_queue(spark, path).select("id", "type", F.element_at("urls", 1).alias("url"), "priority", "status", "assigned_to")


@query("SELECT 'seen' AS part, count(*) AS n, CAST(sum(c_custkey) AS BIGINT) AS total FROM customer UNION ALL SELECT 'frontier', count(*), CAST(sum(s_suppkey) AS BIGINT) FROM supplier UNION ALL SELECT 'stats', 1, 7")
def checkpoint_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The latest of two checkpoints is what a reader gets."""
    path = _folder(spark)
    c, s = t(spark, sf_dir, "customer").select(F.col("c_custkey").alias("k")), t(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("k"))
    crawl.save_checkpoint(path, s, s, spark.range(3).toDF("k"))
    crawl.save_checkpoint(path, c, s, spark.createDataFrame([(7,)], "k long"))
    got = [df.agg(F.lit(name).alias("part"), F.count("*").alias("n"), F.sum("k").alias("total")) for name, df in zip(("seen", "frontier", "stats"), crawl.load_checkpoint(spark, path))]
    return got[0].union(got[1]).union(got[2])


@query("SELECT doc_id, md5(text) AS body FROM documents")
def packed_bodies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bodies sent with gzip by odd ids and plain by even ones."""

    @F.arrow_udf("binary")
    def packed(x: pa.Array) -> pa.Array:
        return pa.array([None if b is None else gzip.compress(b, 1) for b in x.to_pylist()], pa.binary())

    raw = F.col("text").cast("binary")
    odd = F.col("doc_id") % 2 == 1
    d = t(spark, sf_dir, "documents").select("doc_id", F.when(odd, packed(raw)).otherwise(raw).alias("b"), F.when(odd, "GZIP").otherwise("identity").alias("e"))
    return d.select("doc_id", F.md5(files.decompress(F.col("b"), F.col("e"))).alias("body"))


# -- crawl: limit, pause and resume


def _tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    link = lambda i: F.concat(F.lit('<a href="/c/'), (F.col("c_custkey") * 2 + i).cast("string"), F.lit('#x">x</a>'))
    return t(spark, sf_dir, "customer").select(F.concat(F.lit("https://g.example/c/"), "c_custkey").alias("url"), F.concat(link(0), link(1)).alias("html"))


TREE = """
    WITH RECURSIVE r(k, depth) AS (SELECT 1::BIGINT, 0 UNION SELECT k * 2 + i, depth + 1 FROM r, (VALUES (0), (1)) v(i) WHERE depth < 6 AND k * 2 + i <= (SELECT max(c_custkey) FROM customer))
    SELECT 'https://g.example/c/' || k AS url, CAST(min(depth) AS INTEGER) AS depth FROM r JOIN customer ON c_custkey = k GROUP BY k"""


@query(f"SELECT * FROM ({TREE}) ORDER BY depth, url LIMIT 40")
def crawl_limit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A request limit is exact: whole levels, then the least addresses of the next."""
    return crawl.crawl(_tree(spark, sf_dir), ["https://g.example/c/1"], depth=6, limit=40).select("url", "depth")


@query(TREE)
def crawl_resume(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Paused after two levels, and again after two more, each call going on from the checkpoint."""
    p, path = _tree(spark, sf_dir), _folder(spark)
    for _ in range(2):
        crawl.crawl(p, ["https://g.example/c/1"], depth=6, checkpoint=path, levels=2)
    return crawl.crawl(p, ["https://g.example/c/1"], depth=6, checkpoint=path).select("url", "depth")


# -- language-model fields with a model that is a plain function


@query("SELECT c_custkey, CASE WHEN c_custkey % 2 = 0 THEN left(c_name, 12) END AS summary, CASE WHEN c_custkey % 5 > 0 THEN c_name END AS person, 'mixed' AS label, CAST(0.5 AS DOUBLE) AS score FROM customer")
def model_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Summaries of texts of 100 bytes or more; entities, which fail for every fifth; sentiment."""

    def model(prompt: str) -> str:
        head, body = prompt.split("\n\n", 1)
        if "sentiment" in head:
            return 'It is {"label": "mixed", "score": 0.5}, I think.'
        if "JSON lists" in head:
            if int(body[9:18]) % 5 == 0:
                raise TimeoutError
            return 'Here: {"people": ["' + body[:18] + '"]} {"x": []}'
        return body[:12]

    c = t(spark, sf_dir, "customer").select("c_custkey", F.repeat("c_name", F.when(F.col("c_custkey") % 2 == 0, 10).otherwise(2)).alias("body"))
    out = ai.sentiment(ai.entities(ai.summarise(c, "body", model), "body", model), "body", model)
    return out.select("c_custkey", F.col("body_summary").alias("summary"), F.try_element_at(F.try_element_at("body_entities", F.lit("people")), F.lit(1)).alias("person"), "body_sentiment.label", "body_sentiment.score")


@query("SELECT c_custkey, CASE WHEN c_custkey % 7 > 0 THEN c_mktsegment = 'BUILDING' END AS relevant FROM customer WHERE c_custkey % 7 = 0 OR c_mktsegment = 'BUILDING'")
def model_relevance(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows answered with anything but yes go; those for which the model fails stay."""

    def model(prompt: str) -> str:
        if prompt.endswith("!"):
            raise ConnectionError
        return "Yes, it is." if "BUILDING" in prompt else "No."

    c = t(spark, sf_dir, "customer").select("c_custkey", F.concat("c_mktsegment", F.when(F.col("c_custkey") % 7 == 0, "!").otherwise("")).alias("body"))
    return ai.relevance(c, "body", "trade", model, drop=True).select("c_custkey", F.col("body_relevant").alias("relevant"))


@query("""SELECT p_partkey, '{"a": {"b": ' || p_partkey || '}, "c": "x"}' AS whole, '{}' AS broken, '{}' AS bare FROM part""")
def first_objects(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("p_partkey").cast("string")
    obj = F.concat(F.lit('{"a": {"b": '), k, F.lit('}, "c": "x"}'))
    return t(spark, sf_dir, "part").select("p_partkey", ai._first_object(F.concat(F.lit("so: "), obj, F.lit(" } {}"))).alias("whole"), ai._first_object(F.concat(F.lit("{{"), k)).alias("broken"), ai._first_object(k).alias("bare"))


# -- similarity of lists and maps, durations, filters' shapes


@query("""
    WITH k AS (SELECT p_partkey, ['x' || p_partkey % 3, 'y' || p_partkey % 2, 'x' || p_partkey % 3] AS a, ['x' || p_partkey % 2, 'y' || p_partkey % 2] AS b FROM part),
    c AS (SELECT p_partkey, len(a) + len(b) AS n, len(list_filter(b, lambda v: list_contains(a, v))) AS common FROM k)
    SELECT p_partkey, round(common / (n - common), 6) AS lists, CAST(((p_partkey % 2 = p_partkey % 3)::INT + 1) / 2.0 AS DOUBLE) AS maps FROM c""")
def overlaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("p_partkey")
    tag = lambda c, n: F.concat(F.lit(c), (k % n).cast("string"))
    a, b = F.array(tag("x", 3), tag("y", 2), tag("x", 3)), F.array(tag("x", 2), tag("y", 2))
    m = lambda n: F.create_map(F.lit("p"), k % n, F.lit("q"), k % 3)
    return t(spark, sf_dir, "part").select("p_partkey", F.round(text.list_overlap(a, b), 6).alias("lists"), text.map_overlap(m(2), m(3)).alias("maps"))


@query("SELECT p_partkey, CASE WHEN p_partkey * 100 < 1000 THEN p_partkey * 100 || 'ms' WHEN p_partkey * 100 < 60000 THEN printf('%.1fs', p_partkey / 10.0) ELSE printf('%.1fm', p_partkey * 100 // 6000 / 10.0) END AS took FROM part")
def durations(spark: SparkSession, sf_dir: str) -> DataFrame:
    ms = F.col("p_partkey") * 100
    return t(spark, sf_dir, "part").select("p_partkey", text.human_millis(F.when(ms < 60000, ms).otherwise(F.floor(ms / 6000) * 6000)).alias("took"))


@query("SELECT n_nationkey, CAST(ceil(-(n_nationkey + 1) * 1000 * ln(0.01) / (ln(2) * ln(2))) AS BIGINT) AS bits, 7 AS hashes, round(pow(1 - exp(-7.0 * (n_nationkey + 1) * 500 / ceil(-(n_nationkey + 1) * 1000 * ln(0.01) / (ln(2) * ln(2)))), 7), 6) AS half_full FROM nation")
def filter_shapes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bits and hashes of Bloom filters for 1,000 members a nation number, and their false rate when half full."""
    out = []
    for (k,) in t(spark, sf_dir, "nation").select("n_nationkey").collect():  # 25 rows
        bits, hashes = stats.bloom_shape((k + 1) * 1000, 0.01)
        out.append((k, bits, hashes, round(stats.bloom_false_rate(bits, hashes, (k + 1) * 500), 6)))
    return spark.createDataFrame(out, "n_nationkey int, bits long, hashes int, half_full double")


# -- pages


@query("SELECT n_nationkey, 'key,name|' || n_nationkey || ',' || n_name AS cells, n_name || '|' || n_regionkey AS entries FROM nation")
def tables_and_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first table as rows of cells, the first list as its entries."""
    k = F.col("n_nationkey").cast("string")
    body = F.concat(F.lit("<table><tr><th> key</th><th>name </th></tr><tr><td>"), k, F.lit("</td><td>"), "n_name", F.lit("</td></tr></table><ul><li> "), "n_name", F.lit("</li><li>"), "n_regionkey", F.lit("</li></ul><table><tr><td>z</td></tr></table><ol><li>z</li></ol>"))
    p = t(spark, sf_dir, "nation").select("n_nationkey", F.lit("u").alias("url"), _html("", body).alias("html"))
    return pages.page_rows(p, "cells string, entries string", lambda u, h, d: [("|".join(",".join(r) for r in extract.table_cells(d)), "|".join(extract.list_items(d)))], ("n_nationkey",))


@query("""
    SELECT p_partkey AS page_id, CAST(unnest([0, 1, 2, 3, 4, 5, 6]) AS INTEGER) AS rank,
           unnest(['#d' || p_partkey, '#d' || p_partkey, 'p.c' || p_partkey || '.z', '#d' || p_partkey || ' > p.c' || p_partkey, 'div > p:nth-child(1)', 'p.c' || p_partkey, 'p.z']) AS selector,
           CAST(1.0 AS DOUBLE) AS score, unnest([100, 30, 30, 30, 25, 20, 20]) AS specificity, 1 AS matches FROM part""")
def selector_ranks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Selectors for an element with an id above it and classes of its own, best first."""
    k = F.col("p_partkey").cast("string")
    p = t(spark, sf_dir, "part").select(F.col("p_partkey").alias("page_id"), F.lit("u").alias("url"), _html("", F.concat(F.lit('<div id="d'), k, F.lit('"><p class="c'), k, F.lit(' z">Text'), k, F.lit("</p></div>"))).alias("html"), F.concat(F.lit("Text"), k).alias("wanted"))
    return pages.selector_candidates(p, F.col("wanted"))


@query("""
    WITH s AS (SELECT p_partkey AS page_id, unnest([1, 2, 3]) AS i, 'w' || p_partkey % 4 AS w FROM part),
    v AS (SELECT page_id, i, CASE i WHEN 1 THEN 'w0 w9' WHEN 2 THEN 'w0 ' || w ELSE w END AS text FROM s),
    j AS (SELECT page_id, i, text, string_split(text, ' ') AS b FROM v),
    c AS (SELECT *, len(list_intersect(list_distinct(b), ['w0', 'w1'])) AS common, len(list_distinct(b)) AS n FROM j),
    r AS (SELECT page_id, i, text, 0.3 * (i < 3)::INT + 0.3 * CASE WHEN text = 'w0 w1' THEN 1 ELSE common / (2 + n - common) END + 0.2 * (i < 3)::INT AS s FROM c)
    SELECT page_id, CAST(row_number() OVER (PARTITION BY page_id ORDER BY round(s, 9) DESC, i) - 1 AS INTEGER) AS rank, text, round(s, 6) AS similarity FROM r WHERE s > 0.3""")
def similar_ranks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """List entries like the first one: class, words and attributes count."""
    w = F.concat(F.lit("w"), (F.col("p_partkey") % 4).cast("string"))
    body = F.concat(F.lit('<ul><li class="a">w0 w1</li><li class="a">w0 w9</li><li class="a">w0 '), w, F.lit('</li><li class="b">'), w, F.lit("</li></ul>"))
    p = t(spark, sf_dir, "part").select(F.col("p_partkey").alias("page_id"), F.lit("u").alias("url"), _html("", body).alias("html"))
    return pages.similar_elements(p, "li").select("page_id", "rank", "text", F.round("similarity", 6).alias("similarity"))


def _recipe(p: DataFrame, name: str, *fields: str) -> DataFrame:
    r = recipes.run_recipe(p, recipes.RECIPES[name])
    return r.select("url", "position", *[F.try_element_at("item", F.lit(k)).alias(k) for k in fields])


@query("SELECT 'https://shop.example/' || p_partkey AS url, 0 AS position, p_name AS name, '$' || CAST(p_size AS VARCHAR) AS price, '/p/' || p_partkey AS link, 'star-rating Three' AS rating FROM part")
def recipe_products(spark: SparkSession, sf_dir: str) -> DataFrame:
    box = F.concat(F.lit('<article class="product_pod"><p class="star-rating Three"></p><h3><a href="/p/'), "p_partkey", F.lit('">'), "p_name", F.lit('</a></h3><p class="price_color">$'), "p_size", F.lit("</p></article>"))
    return _recipe(t(spark, sf_dir, "part").select(F.concat(F.lit("https://shop.example/"), "p_partkey").alias("url"), _html("", box).alias("html")), "products", "name", "price", "link", "rating")


@query("SELECT 'https://news.example/' || s_suppkey AS url, 0 AS position, s_suppkey || '.' AS rank, s_name AS title, 'https://s.example/' || s_suppkey AS link, 's.example' AS site FROM supplier")
def recipe_stories(spark: SparkSession, sf_dir: str) -> DataFrame:
    row = F.concat(F.lit('<table><tr class="athing"><td><span class="rank">'), "s_suppkey", F.lit('.</span></td><td><span class="titleline"><a href="https://s.example/'), "s_suppkey", F.lit('">'), "s_name", F.lit('</a><span class="sitestr">s.example</span></span></td></tr></table>'))
    return _recipe(t(spark, sf_dir, "supplier").select(F.concat(F.lit("https://news.example/"), "s_suppkey").alias("url"), _html("", row).alias("html")), "stories", "rank", "title", "link", "site")


@query("SELECT 'https://code.example/' || s_suppkey AS url, 0 AS position, 'team / r' || s_suppkey AS name, '/team/r' || s_suppkey AS link, s_name AS about, CASE WHEN s_suppkey % 3 > 0 THEN 'L' || s_suppkey % 3 END AS language FROM supplier")
def recipe_repositories(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("s_suppkey").cast("string")
    lang = F.when(F.col("s_suppkey") % 3 > 0, F.concat(F.lit('<span itemprop="programmingLanguage">L'), (F.col("s_suppkey") % 3).cast("string"), F.lit("</span>"))).otherwise("")
    box = F.concat(F.lit('<article class="Box-row"><h2><a href="/team/r'), k, F.lit('">team / r'), k, F.lit("</a></h2><p>"), "s_name", F.lit("</p>"), lang, F.lit("</article>"))
    return _recipe(t(spark, sf_dir, "supplier").select(F.concat(F.lit("https://code.example/"), k).alias("url"), _html("", box).alias("html")), "repositories", "name", "link", "about", "language")


@query("SELECT 'https://blog.example/' || o_orderkey AS url, 0 AS position, 'Order ' || o_orderkey AS title, 'C' || o_custkey AS \"by\", strftime(o_orderdate, '%Y-%m-%d') AS date, o_orderpriority AS lead FROM orders")
def recipe_articles(spark: SparkSession, sf_dir: str) -> DataFrame:
    box = F.concat(F.lit("<article><h1>Order "), "o_orderkey", F.lit('</h1><span class="byline">C'), "o_custkey", F.lit('</span><time datetime="'), F.date_format("o_orderdate", "yyyy-MM-dd"), F.lit('">then</time><p>'), "o_orderpriority", F.lit("</p><p>more</p></article>"))
    return _recipe(t(spark, sf_dir, "orders").select(F.concat(F.lit("https://blog.example/"), "o_orderkey").alias("url"), _html("", box).alias("html")), "articles", "title", "by", "date", "lead")


@query("SELECT 'https://wiki.example/' || n_nationkey AS url, 0 AS position, n_name AS title, 'About ' || n_name AS lead, 'History|Region ' || n_regionkey AS sections, 'Nations|R' || n_regionkey AS categories FROM nation")
def recipe_encyclopedia(spark: SparkSession, sf_dir: str) -> DataFrame:
    body = F.concat(F.lit("<h1>"), "n_name", F.lit('</h1><p class="empty">x</p><p>About '), "n_name", F.lit("</p><h2>History</h2><h2>Region "), "n_regionkey", F.lit('</h2><div class="catlinks"><ul><li>Nations</li><li>R'), "n_regionkey", F.lit("</li></ul></div>"))
    return _recipe(t(spark, sf_dir, "nation").select(F.concat(F.lit("https://wiki.example/"), "n_nationkey").alias("url"), _html("", body).alias("html")), "encyclopedia", "title", "lead", "sections", "categories")


@query("SELECT 'https://g.example/c/' || c_custkey AS url, 'crawler' AS spider, c_name AS name, 'https://g.example/next/' || c_custkey AS next FROM customer WHERE c_custkey % 4 > 0")
def spider_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A callback for each matching element; one that leaves its item empty gives none. Follow links are absolute."""

    def take(e: spider.Element, item: dict) -> None:
        if e.attr("data-k") != "0":
            item["name"] = e.text()
            item["next"] = e.select("a")[0].follow()

    c = t(spark, sf_dir, "customer").select(F.concat(F.lit("https://g.example/c/"), "c_custkey").alias("url"), _html("", F.concat(F.lit('<div class="card" data-k="'), F.col("c_custkey") % 4, F.lit('"> '), "c_name", F.lit(' <a href="../next/'), "c_custkey", F.lit('"></a></div>'))).alias("html"))
    found, _ = spider.run_spider(spider.Crawler().on_html("div.card", take), c)
    return found.select(F.col("_url").alias("url"), F.col("_spider").alias("spider"), F.col("fields")["name"].alias("name"), F.col("fields")["next"].alias("next"))


class _Follower:
    name, start_urls = "follower", []

    def parse(self, response: spider.Response) -> Iterator[dict | str]:
        yield {"title": response.select("title")[0].text()}
        yield from (e.attr("href") for e in response.select("a"))


@query("SELECT 'https://g.example/c/' || c_custkey AS url, 'item' AS kind, 'Customer ' || c_custkey AS value FROM customer UNION ALL SELECT 'https://g.example/c/' || c_custkey, 'follow', 'https://g.example/c/' || (c_custkey + 1) FROM customer")
def spider_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A spider's parse yields an item and an address to follow for each page."""
    c = t(spark, sf_dir, "customer").select(F.concat(F.lit("https://g.example/c/"), "c_custkey").alias("url"), F.concat(F.lit("<title> Customer "), "c_custkey", F.lit('</title><a href="'), F.col("c_custkey") + 1, F.lit('">next</a>')).alias("html"))
    found, follows = spider.run_spider(_Follower(), c)
    return found.select(F.col("_url").alias("url"), F.lit("item").alias("kind"), F.col("fields")["title"].alias("value")).union(follows.select("parent_url", F.lit("follow"), "url"))


# -- running streams, drained and read back


def _drained(spark: SparkSession, df: DataFrame, mode: str = "append") -> DataFrame:
    path = _folder(spark)
    how = "overwrite" if mode == "complete" else "append"
    q = df.writeStream.outputMode(mode).foreachBatch(lambda d, k: d.write.mode(how).parquet(f"{path}/out")).option("checkpointLocation", f"{path}/cp").trigger(availableNow=True).start()
    q.awaitTermination()
    return spark.read.schema(df.schema).parquet(f"{path}/out")


def _stream(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.readStream.schema(t(spark, sf_dir, name).schema).parquet(f"{sf_dir}/{name}.parquet*")


@query(f"""
    WITH v AS (SELECT 'c/' || conv_id AS url, turn, role, text, lag(role) OVER w AS r0, lag(text) OVER w AS t0, row_number() OVER w AS i FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn))
    SELECT url, 'added' AS type, NULL AS field, NULL AS old_value, NULL AS new_value FROM v WHERE i = 1
    UNION ALL SELECT url, 'modified', 'role', r0, role FROM v WHERE i > 1 AND r0 <> role
    UNION ALL SELECT url, 'modified', 'text', {SNAP.format("t0")}, {SNAP.format("text")} FROM v WHERE i > 1 AND t0 <> text""")
def stream_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns arriving as versions of one page a conversation; state is kept by address."""
    c = _stream(spark, sf_dir, "conversations").withColumn("url", F.concat(F.lit("c/"), "conv_id"))
    return _drained(spark, changes.stream_changes(c, ("role", "text"), order="turn"))


@query("SELECT DISTINCT user_id FROM events")
def stream_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = _stream(spark, sf_dir, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    return _drained(spark, changes.stream_dedup(e, "user_id", "ts", "400 days").select("user_id"))


@query("SELECT user_id AS node, max(ts) AS last_seen FROM events GROUP BY 1")
def stream_liveness(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _drained(spark, changes.stream_liveness(_stream(spark, sf_dir, "events").withColumnRenamed("user_id", "node")), "complete")


@query("SELECT event_id, upper(event_type) AS kind FROM events WHERE event_type <> 'error'")
def stream_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Micro-batches through a sink function, each written under its number, so that a repeated one writes the same again."""
    path = _folder(spark)
    e = _stream(spark, sf_dir, "events").where("event_type <> 'error'").select("event_id", F.upper("event_type").alias("kind"))
    changes.stream_items(e, lambda df, k: df.write.mode("overwrite").parquet(f"{path}/out/batch={k}"), f"{path}/cp").awaitTermination()
    return spark.read.parquet(f"{path}/out").select("event_id", "kind")


@query("SELECT c_custkey, c_name AS name, 'x' AS kind FROM customer WHERE c_custkey % 3 > 0")
def item_middleware(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A pipeline of one's own steps: a step is a function of a table, and may drop rows."""
    steps = items.Pipeline(items.trim, lambda df: df.where("c_custkey % 3 > 0"), lambda df: df.withColumn("kind", F.lit("x")))
    return steps(t(spark, sf_dir, "customer").select("c_custkey", F.concat(F.lit("  "), "c_name", F.lit("  ")).alias("name")))
