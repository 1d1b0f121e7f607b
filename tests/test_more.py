"""Bloom filters, tracing, the command line."""

import json

import pytest

from tarnweave.__main__ import main
from tarnweave.operators import bloom, stats
from tarnweave.plans.tracing import Tracer


def test_bloom_has_no_false_negatives(spark):
    members = spark.range(2000).selectExpr("concat('https://x/', id) AS url")
    bits = bloom.build(members, "url", 2000)
    assert len(bits) == -(-stats.bloom_shape(2000, 0.01)[0] // 8)
    assert bloom.might_contain(members, "url", bits, 2000).where("NOT maybe").count() == 0
    others = spark.range(2000, 12000).selectExpr("concat('https://x/', id) AS url")
    assert bloom.might_contain(others, "url", bits, 2000).where("maybe").count() < 300
    both = members.union(others)
    assert bloom.hybrid_unseen(both, members, "url", 2000).count() == 10_000
    assert bloom.hybrid_unseen(both, members.limit(0), "url", 2000).count() == 12_000
    assert bloom.might_contain(spark.createDataFrame([(None,)], "url string"), "url", bits, 2000).count() == 1


def test_tracer(spark):
    t = Tracer()
    with t.span("outer", job="x"):
        with t.span("inner"):
            pass
        with pytest.raises(ValueError), t.span("bad"):
            raise ValueError("no")
    df = t.flush(spark)
    rows = {r.name: r for r in df.collect()}
    assert rows["inner"].parent_id == rows["outer"].span_id and rows["inner"].trace_id == rows["outer"].trace_id
    assert rows["bad"].status == "error" and rows["bad"].events == ["ValueError: no"] and t.spans == []
    got = stats.trace_stats(df).first()
    assert (got.spans, got.errors) == (3, 1)


def test_command_line(spark, tmp_path):
    spark.createDataFrame([("https://g.example/a", "<title>A</title><a href='/b'>b</a>"), ("https://g.example/b", "<title>B</title>")], "url string, html string").write.parquet(f"{tmp_path}/p")
    main(["crawl", f"{tmp_path}/p", f"{tmp_path}/out.json", "--format", "json", "--seed", "https://g.example/a", "--depth", "1"])
    assert sorted((r["url"], r["depth"]) for r in json.load(open(f"{tmp_path}/out.json"))) == [("https://g.example/a", 0), ("https://g.example/b", 1)]
    main(["index", f"{tmp_path}/p", f"{tmp_path}/idx"])
    assert {r.title for r in spark.read.json(f"{tmp_path}/idx").collect()} == {"A", "B"}
    with pytest.raises(SystemExit):
        main(["nothing", "x", "y"])
