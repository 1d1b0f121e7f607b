"""Operators on small tables."""

import gzip
import json
import zlib

import pytest
from pyspark.sql import functions as F

from tarnweave.functions import extract
from tarnweave.operators import crawl, frontier, items, monitor, pages, stats
from tarnweave.plans import ai, config, plugins, spider
from tarnweave.sources import files, sinks
from tarnweave.streaming import changes


def rows(df, *order):
    return [tuple(r) for r in (df.orderBy(*order) if order else df).collect()]


def test_full_chain(spark):
    df = spark.createDataFrame([("u1", "  <b>Product</b> Widget ", "$1,234.56", "January 15, 2024", "42", "mail me@x.org", "junk"), ("u2", None, "$1", "x", "1", "", "j")], "_url string, title string, price string, date string, count string, notes string, junk string")
    p = items.Pipeline(items.required_fields("title"), items.html_sanitize, items.trim, items.currency_normalize("price"), items.date_normalize("date", out="yyyy-MM-dd"), items.type_coercion(count="int"), items.pii_redact, items.word_count("title"), items.default_values(source="web"), items.field_rename(date="day"), items.field_filter("title", "price", "day", "count", "notes", "title_word_count", "source"))
    assert [r.asDict() for r in p(df).collect()] == [{"_url": "u1", "title": "Product Widget", "price": "1234.56", "day": "2024-01-15", "count": 42, "notes": "mail [REDACTED_EMAIL]", "title_word_count": 2, "source": "web"}]


def test_pipeline_corners(spark):
    df = spark.createDataFrame([("p1", "", 1), ("p1", "", 2), ("p2", "p1", 3), ("p3", None, 4)], "_url string, key string, n int")
    assert [r[2] for r in rows(items.dedup("key", order=("n",))(df), "n")] == [1, 4]
    assert items.field_filter()(df).columns == df.columns
    assert items.required_fields("nope")(df).count() == 0 and items.required_fields("key")(df).count() == 3
    assert items.field_rename(key="n")(df).columns == ["_url", "n"]
    bad = spark.createDataFrame([("a@b.c",), ("zzz",), ("",), (None,)], "mail string")
    assert items.field_validate(mail="@")(bad).count() == 3
    assert [r.mail for r in items.field_validate(drop=False, mail="@")(bad).collect()] == ["a@b.c", None, "", None]
    assert rows(items.default_values(source="d")(spark.createDataFrame([("custom",), ("",), (None,)], "source string"))) == [("custom",), ("",), ("d",)]


def test_frontier_order(spark):
    df = spark.createDataFrame([(f"u{i}", p, 0) for i, p in enumerate([5, 1, 4, 0, 3, 2])], "url_hash string, priority int, depth int")
    assert [r.priority for r in frontier.next_batch(df, 4).collect()] == [0, 1, 2, 3]


def test_throttle_equals_recurrence(spark):
    import random

    rnd = random.Random(1)
    data = [(h, i, rnd.random() * 30) for h in "abc" for i in range(40)]
    df = spark.createDataFrame(data, "host string, i int, at double")
    got = {(r.host, r.i): r.start for r in frontier.throttle(df, 1.0, "at", ("host",), ("i",)).collect()}
    for h in "abc":
        last = None
        for _, i, at in sorted((d for d in data if d[0] == h), key=lambda d: (d[2], d[1])):
            last = at if last is None else max(at, last + 1.0)
            assert got[h, i] == pytest.approx(last)


def test_assignment_is_greedy(spark):
    nodes = spark.createDataFrame([("a", 3, 0, "active"), ("b", 2, 0, "active"), ("c", 9, 0, "offline")], "id string, capacity int, active_jobs int, status string")
    tasks = spark.createDataFrame([(i, 1, "pending") for i in range(7)] + [(9, 0, "done")], "id int, priority int, status string")
    got = dict(rows(frontier.assign_tasks(tasks, nodes), "task_id"))
    free, want = {"a": 3, "b": 2}, {}
    for t in range(7):
        n = min((k for k in free if free[k]), key=lambda k: (-free[k], k), default=None)
        if n:
            want[t] = n
            free[n] -= 1
    assert got == want


def test_percentiles_and_bloom(spark):
    df = spark.range(10).withColumn("v", F.col("id").cast("double"))
    assert rows(stats.floor_percentiles(df, "v", (0, 50, 99, 100))) == [(10, 0.0, 5.0, 9.0, 9.0)]
    assert stats.bloom_shape(0, 2) == stats.bloom_shape(100_000, 0.01)
    m, k = stats.bloom_shape(10_000, 0.01)
    assert stats.bloom_false_rate(m, k, 10_000) < 0.011


def graph(spark, n=50):
    return spark.createDataFrame([(f"https://g.example/page/{i}", "".join(f'<a href="/page/{(i + k) % n}">x</a>' for k in range(1, 6))) for i in range(n)], "url string, html string")


def test_crawl_by_depth(spark):
    got = crawl.crawl(graph(spark), ["https://G.example/page/0/"], depth=3)
    want = {f"https://g.example/page/{i}": (i + 4) // 5 for i in range(16)}
    assert {r.url: r.depth for r in got.collect()} == want
    seen = frontier.keyed(spark.createDataFrame([("https://g.example/page/1",)], "url string")).select("url_hash")
    assert "https://g.example/page/1" not in {r.url for r in crawl.crawl(graph(spark), ["https://g.example/page/0"], depth=1, seen=seen).collect()}
    assert crawl.crawl(graph(spark), ["https://nowhere.example/"], depth=2).count() == 0
    assert crawl.crawl(graph(spark), ["https://g.example/page/0"], depth=2, allow=("other.example",)).count() == 0


def test_checkpoint_round_trip(spark, tmp_path):
    path = f"file://{tmp_path}/cp"
    assert crawl.load_checkpoint(spark, path) is None
    seen, wait, st = spark.range(3), spark.range(2), spark.range(1)
    crawl.save_checkpoint(path, seen, wait, st)
    crawl.save_checkpoint(path, seen, spark.range(5), st)
    a, b, c = crawl.load_checkpoint(spark, path)
    assert (a.count(), b.count(), c.count()) == (3, 5, 1)


def test_retry_plan(spark):
    df = spark.createDataFrame([("a", 1, 503, None), ("a", 2, 200, None), ("b", 1, 429, None), ("c", 1, 404, None), ("d", 1, None, "timeout"), ("e", 1, None, "canceled")] + [("f", i, 500, None) for i in range(5)], "url string, ts int, status int, error string")
    assert {r.url: (r.outcome, r.priority) for r in crawl.retry_plan(df).collect()} == {"a": ("done", None), "b": ("retry", 3), "c": ("failed", None), "d": ("retry", 3), "e": ("failed", None), "f": ("failed", None)}


def test_sitemaps(spark):
    ns = 'xmlns="http://www.sitemaps.org/schemas/sitemap/0.9"'
    df = spark.createDataFrame([("r", f'<?xml version="1.0"?><sitemapindex {ns}><sitemap><loc>a</loc></sitemap><sitemap><loc>b</loc></sitemap></sitemapindex>'), ("a", f"<urlset {ns}><url><loc>https://x/1?a=1&amp;b=2</loc><lastmod>2024-01-01</lastmod></url></urlset>"), ("b", f"<urlset {ns}><url><loc>https://x/2</loc></url><url><loc>https://x/3</loc></url></urlset>"), ("z", f"<urlset {ns}><url><loc>no</loc></url></urlset>"), ("c", "<urlset><url")], "url string, xml string")
    got = crawl.sitemap_urls(crawl.reachable_sitemaps(df, "r"))
    assert sorted(r.loc for r in got.collect()) == ["https://x/1?a=1&b=2", "https://x/2", "https://x/3"]


def test_seo(spark):
    df = spark.createDataFrame([(1, "u", "<title>short</title><img><img alt=' '><img alt=x><meta name=robots content=noindex>")], "page_id int, url string, html string")
    r = pages.seo_audit(df).first()
    assert r.score == 100 - 5 - 15 - 5 - 10 - 3 - 3 - 4 - 5 and "robots" in [i.category for i in r.issues]


def test_index_gate(spark):
    df = spark.createDataFrame([(1, "u", "<p>few words"), (2, "u", "<title>t</title><nav>menu</nav><p>body"), (3, "u", "<p>" + "w " * 11)], "page_id int, url string, html string")
    assert [(r.page_id, r.body_text.strip()[:6], r.word_count) for r in pages.search_index(df).orderBy("page_id").collect()] == [(2, "body", 1), (3, "w w w ", 11)]


def test_changes_batch_and_stream(spark, tmp_path):
    v = [[("a", "t1", "x"), ("b", "t", None)], [("a", "t2", None), ("b", "t", ""), ("c", "n", "n")]]
    old, new = (spark.createDataFrame(x, "url string, title string, body string") for x in v)
    want = [("a", "modified", "title", "t1", "t2"), ("a", "removed", "body", "x", None), ("c", "added", None, None, None)]
    assert sorted(rows(monitor.detect_changes(old, new, ("title", "body"))), key=str) == sorted(want, key=str)
    for k, df in enumerate((old, new)):
        df.withColumn("ts", F.lit(k)).coalesce(1).write.mode("append").json(f"{tmp_path}/in")
        src = spark.readStream.schema("url string, title string, body string, ts int").json(f"{tmp_path}/in")
        q = changes.stream_changes(src, ("title", "body")).writeStream.format("json").option("checkpointLocation", f"{tmp_path}/cp").option("path", f"{tmp_path}/out").trigger(availableNow=True).start()
        q.awaitTermination(120)
    got = spark.read.schema(changes.CHANGES).json(f"{tmp_path}/out")
    assert sorted(rows(got), key=str) == sorted([*want, ("a", "added", None, None, None), ("b", "added", None, None, None)], key=str)


def test_streams(spark, tmp_path):
    spark.createDataFrame([(1, "a", "2024-01-01 00:00:00", 1.0), (1, "a", "2024-01-01 00:10:00", 2.0), (2, "b", "2024-01-01 02:00:00", 4.0)], "k int, event_type string, ts string, value double").withColumn("ts", F.col("ts").cast("timestamp")).write.parquet(f"{tmp_path}/e")
    src = spark.readStream.schema(spark.read.parquet(f"{tmp_path}/e").schema).parquet(f"{tmp_path}/e")
    got = []
    changes.stream_items(changes.stream_dedup(src, "k", "ts"), lambda df, k: got.extend(df.collect()), f"{tmp_path}/c1").awaitTermination(120)
    assert sorted(r.k for r in got) == [1, 2]
    q = changes.stream_windows(src).writeStream.outputMode("complete").format("memory").queryName("w").option("checkpointLocation", f"{tmp_path}/c2").trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert sorted((r.event_type, r.n, r.total) for r in spark.table("w").collect()) == [("a", 2, 3.0), ("b", 1, 4.0)]


def test_sinks(spark, tmp_path):
    df = spark.createDataFrame([("u1", "2024-01-02", 'a "q"', ["x"]), ("u2", "2024-01-02", "b", None)], "_url string, _timestamp string, title string, tags array<string>").withColumn("_timestamp", F.col("_timestamp").cast("timestamp"))
    assert sinks.write_json_array(df, f"{tmp_path}/a.json") == 2
    assert json.load(open(f"{tmp_path}/a.json")) == [{"_url": "u1", "_timestamp": "2024-01-02T00:00:00Z", "title": 'a "q"', "tags": ["x"]}, {"_url": "u2", "_timestamp": "2024-01-02T00:00:00Z", "title": "b"}]
    sinks.write_items(df, "jsonl", f"{tmp_path}/l")
    assert spark.read.json(f"{tmp_path}/l").count() == 2
    sinks.write_items(df, "csv", f"{tmp_path}/c")
    assert sorted(map(tuple, spark.read.option("header", True).option("escape", '"').csv(f"{tmp_path}/c").select("title", "tags").collect()))[0] == ('a "q"', '["x"]')
    with pytest.raises(ValueError):
        sinks.write_items(df, "xml", "x")
    sinks.write_partitioned(df, f"{tmp_path}/p", 1)
    assert spark.read.json(f"{tmp_path}/p").columns == ["tags", "title", "date"]
    done = []

    def bad(d):
        raise RuntimeError("no")

    with pytest.raises(RuntimeError):
        sinks.fan_out(df, [bad, lambda d: done.append(d.count())])
    assert done == [2]
    assert json.loads(sinks.message_rows(df).first().value)["fields"] == {"title": 'a "q"', "tags": ["x"]}


def test_files(spark, tmp_path):
    for n, b in (("a.png", b"1"), ("b.PNG", b"1"), ("c.txt", b"22")):
        (tmp_path / n).write_bytes(b)
    got = {r.name: (r["class"], r.size, r.copy_of is not None) for r in files.media_files(spark, str(tmp_path)).collect()}
    assert got == {"a.png": ("image", 1, False), "b.PNG": ("image", 1, True), "c.txt": ("other", 2, False)}
    df = spark.createDataFrame([(bytearray(gzip.compress(b"x")), "gzip"), (bytearray(zlib.compress(b"y")), "deflate"), (bytearray(b"z"), None), (bytearray(b"?"), "gzip")], "b binary, e string")
    assert [None if r[0] is None else bytes(r[0]) for r in df.select(files.decompress(F.col("b"), F.col("e"))).collect()] == [b"x", b"y", b"z", None]
    (tmp_path / "q").mkdir()
    files.export_queue(spark.createDataFrame([("t", "crawl", ["u"], 1, "running", "w")], "id string, type string, urls array<string>, priority int, status string, assigned_to string")).write.text(str(tmp_path / "q/x"))
    assert [(r.id, r.status, r.assigned_to) for r in files.import_queue(spark, str(tmp_path / "q/x")).collect()] == [("t", "pending", None)]


def test_spider_and_crawler(spark):
    class Quotes:
        name, start_urls = "quotes", ["https://g.example/page/0"]

        def parse(self, response):
            for a in response.select("a"):
                yield {"to": " " + a.attr("href") + " ", "empty": None}
                yield a.follow()
            yield {}

    got, follows = spider.run_spider(Quotes(), graph(spark, 8))
    assert got.count() == 40 and got.first().fields["to"].startswith("/page") and follows.count() == 40
    c = spider.Crawler(depth=1).on_html("a", lambda e, item: item.update(text=e.text()))
    assert c.run(graph(spark, 20), "https://g.example/page/0").count() == 30


def test_models(spark):
    df = spark.createDataFrame([("x" * 120,), ("short",), (None,)], "body string")

    def model(prompt):
        if "Summarise" in prompt:
            return "sum"
        if "sentiment" in prompt:
            return 'ok {"label":"good","score":0.5} bye'
        if "Is this" in prompt:
            return "Yes" if "xxx" in prompt else "no"
        return '{"people":["Bob"]}'

    out = ai.relevance(ai.sentiment(ai.entities(ai.summarise(df, "body", model), "body", model), "body", model), "body", "x", model)
    r = out.collect()
    assert [x.body_summary for x in r] == ["sum", None, None] and r[1].body_entities == {"people": ["Bob"]} and r[0].body_sentiment.label == "good"
    assert [x.body_relevant for x in r] == [True, False, None]
    assert ai.relevance(df, "body", "x", model, drop=True).count() == 2


def test_config_and_plugins(tmp_path, monkeypatch):
    (tmp_path / "c.yaml").write_text("max_depth: 5\nconcurrency: 20\nrules:\n  - {name: t, selector: h1}\n")
    monkeypatch.setenv("TARNWEAVE_CONCURRENCY", "30")
    c = config.load(str(tmp_path / "c.yaml"), delay_s=2.0)
    assert (c.max_depth, c.concurrency, c.delay_s, c.rules) == (5, 30, 2.0, [extract.Rule("t", "h1")])
    for bad in ({"concurrency": 0}, {"storage": "x"}, {"seeds": ["ftp://x"]}, {"unknown": 1}, {"rules": [{"name": "a", "type": "foo", "selector": "x"}]}):
        with pytest.raises(ValueError):
            config.load(None, **({"concurrency": 1} | bad))
    r = plugins.Registry()
    r.register("b", "storage", object())
    r.register("a", "parser", object())
    assert r.names() == ["a", "b"] and r.by_kind("storage") == ["b"]
    with pytest.raises(ValueError):
        r.register("a", "parser", 1)
    with pytest.raises(ValueError):
        r.register("z", "nope", 1)
    hits = []
    r.on("start", hits.append)
    r.fire("start", 3)
    r.unregister("a")
    assert hits == [3] and r.names() == ["b"]
    assert plugins.in_order([(2, "b"), (1, "a"), (2, "c")]) == ["a", "b", "c"]


def test_notification_and_diff(spark):
    df = spark.createDataFrame([("a\n b\nc\nc", "b\nd\nd")], "o string, n string")
    d = df.select(monitor.diff_lines(F.col("o"), F.col("n")).alias("d")).first().d
    assert (d.added, d.removed) == (["d", "d"], ["a", "c", "c"])
    ch = spark.createDataFrame([("u", "modified", "t", "a", "b"), ("u", "added", None, None, None)], "url string, type string, field string, old_value string, new_value string")
    assert json.loads(monitor.notification(ch).first().body)["count"] == 2


def test_plans_parse_once_and_push_down(spark):
    p = spark.read.parquet("/root/testdata/sf0.001/pages.parquet")
    plan = pages.search_index(p.where("page_id > 5"))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("MapInArrow") == 1 and "PushedFilters: [IsNotNull(page_id), GreaterThan(page_id,5)]" in plan
    k = frontier.keyed(p)
    plan = frontier.allowed_hosts(k, k.select("host"))._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan
