"""The crawl over stored pages: breadth-first to a depth, with checkpoint and resume."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Sequence
from itertools import count

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import urls
from . import frontier, pages


def work_dir(spark: SparkSession) -> str:
    """The shared folder the cluster names. Where it names none, a temporary one on a single machine; on a cluster, whose executors share no such folder, an error."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    if spark.sparkContext.master.split("[")[0] != "local":
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    return tempfile.mkdtemp(prefix="tarnweave-")


def _files(spark: SparkSession, path: str) -> tuple:
    """(Hadoop path, its file system)."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p, p.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf())


def _written(spark: SparkSession, path: str) -> bool:
    p, fs = _files(spark, f"{path}/_SUCCESS")
    return fs.exists(p)


def _cut(df: DataFrame, path: str) -> DataFrame:
    """Lineage ends: written to the path and read back."""
    df.write.mode("overwrite").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def _edges(pages_df: DataFrame, rules: DataFrame | None, allow: Sequence[str], deny: Sequence[str]) -> tuple[DataFrame, DataFrame]:
    """((from_hash, url_hash, url) of admitted links to stored pages, (url_hash) of the stored pages)."""
    stored = frontier.keyed(pages_df.select("url", "html"))
    links = pages.page_links(stored.select("url", "url_hash", "html"), ("url_hash",)).select(F.col("url_hash").alias("from_hash"), F.col("link").alias("url")).distinct()
    ok = frontier.admit(links.withColumn("depth", F.lit(0)), None, rules, allow, deny).where("rejected IS NULL")
    have = stored.select("url_hash").distinct()
    return ok.select("from_hash", "url_hash", F.col("canonical").alias("url")).distinct().join(have, "url_hash", "left_semi").select("from_hash", "url_hash", "url"), have


LEVEL = "url string, url_hash string, depth int, parent string"


def crawl(
    pages_df: DataFrame,
    seeds: Sequence[str] | DataFrame,
    depth: int = 3,
    allow: Sequence[str] = (),
    deny: Sequence[str] = (),
    rules: DataFrame | None = None,
    seen: DataFrame | None = None,
    limit: int | None = None,
    checkpoint: str | None = None,
    levels: int | None = None,
) -> DataFrame:
    """(url, url_hash, depth, parent): pages reached from the seeds (depth 0) over links.

    Links are extracted, resolved and admitted once, for all pages; then each level is one join of hashes with the
    edges and one anti join with what was reached, written to the shared folder so that lineage and plans stay
    short. Of several parents of a level the least URL counts. seen: hashes of an earlier run that aren't visited again.

    limit: exactly so many pages at most; of the level that would go beyond it those of the least URLs stay, and the
    crawl ends. checkpoint: a folder that keeps edges and levels; a later call with the same folder goes on after
    the last level written there. levels: a pause after so many new levels, for a later call to go on.
    """
    spark = pages_df.sparkSession
    root = checkpoint or f"{work_dir(spark)}/crawl-{uuid.uuid4().hex}"
    if not checkpoint:
        p, fs = _files(spark, root)
        fs.deleteOnExit(p)
    if not isinstance(seeds, DataFrame):
        seeds = spark.createDataFrame([(s,) for s in seeds], "url string")
    if not _written(spark, f"{root}/edges"):
        edges, have = _edges(pages_df, rules, allow, deny)
        _cut(have, f"{root}/have")
        _cut(edges, f"{root}/edges")
    edges, have = (spark.read.parquet(f"{root}/{n}") for n in ("edges", "have"))
    done, new = 0, 0  # levels written, and in this call
    reached = spark.createDataFrame([], LEVEL)
    level, total = None, 0
    while done <= depth:
        path = f"{root}/level-{done}"
        if _written(spark, path):
            level = spark.read.schema(LEVEL).parquet(path)
        elif levels is not None and new >= levels:
            break
        else:
            if done == 0:
                found = frontier.admit(seeds.select("url", F.lit(0).alias("depth")), seen, rules, allow, deny, depth).where("rejected IS NULL").join(have, "url_hash", "left_semi")
                one = found.groupBy("url_hash").agg(F.min("canonical").alias("url"), F.lit(None).cast("string").alias("parent"))
            else:
                found = edges.join(level.select(F.col("url_hash").alias("from_hash"), F.col("url").alias("parent")), "from_hash")
                one = frontier.unseen(found.groupBy("url_hash").agg(F.min("url").alias("url"), F.min("parent").alias("parent")), reached)
                one = frontier.unseen(one, seen) if seen is not None else one
            own = one.select("url", "url_hash", F.lit(done).alias("depth"), "parent")
            if limit is not None:  # a top-k of this level
                own = own.orderBy("url").limit(max(0, limit - total))
            level = _cut(own, path)
            new += 1
        n = level.count()
        if not n:
            break
        reached, total, done = reached.unionByName(level), total + n, done + 1
        if limit is not None and total >= limit:
            break
    return reached


def save_checkpoint(path: str, seen: DataFrame, waiting: DataFrame, stats: DataFrame) -> None:
    """A new version beside the old ones, then the pointer: a reader never sees half a checkpoint."""
    spark, version = seen.sparkSession, uuid.uuid4().hex
    for name, df in (("seen", seen), ("frontier", waiting), ("stats", stats)):
        df.write.parquet(f"{path}/{version}/{name}")
    spark.createDataFrame([(version,)], "version string").withColumn("at", F.current_timestamp()).coalesce(1).write.mode("append").parquet(f"{path}/current")


def load_checkpoint(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame, DataFrame] | None:
    """(seen, frontier, stats) of the latest checkpoint, None where there is none."""
    fs = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/current")
    if not fs.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).exists(fs):
        return None
    version = spark.read.parquet(f"{path}/current").orderBy(F.desc("at")).first()["version"]
    return tuple(spark.read.parquet(f"{path}/{version}/{n}") for n in ("seen", "frontier", "stats"))


def retry_plan(attempts: DataFrame, most: int = 3, key: str = "url") -> DataFrame:
    """(url, tries, outcome, priority): what follows from a log of (url, ts, status, error).

    A final good answer is `done`; a retryable failure is `retry` at priority 3 while tries are left; anything else `failed`.
    """
    w = Window.partitionBy(key)
    last = attempts.withColumn("tries", F.count("*").over(w).cast("int")).withColumn("_at", F.row_number().over(w.orderBy(F.desc("ts"), F.desc("status")))).where("_at = 1")
    again = (F.col("status") == 429) | (F.col("status") >= 500) | pages.is_retryable(F.col("error"))
    outcome = F.when(F.col("error").isNull() & (F.col("status") < 400), "done").when(F.coalesce(again, F.lit(False)) & (F.col("tries") <= most), "retry").otherwise("failed")
    return last.select(key, "tries", outcome.alias("outcome"), F.when(outcome == "retry", 3).alias("priority"))


def sitemap_urls(sitemaps: DataFrame) -> DataFrame:
    """(url, loc, lastmod, changefreq, priority) of (url, xml) rows: the entries of url sets, those of the sitemaps that an index lists included. Broken XML gives nothing."""
    entry = "struct<loc:string,lastmod:string,changefreq:string,priority:double>"
    clean = F.regexp_replace(F.regexp_replace("xml", r"<\?xml[^>]*\?>", ""), r'\sxmlns(:\w+)?="[^"]*"', "")
    parsed = sitemaps.select("url", clean.alias("x"))
    sets = parsed.where(F.col("x").contains("<urlset")).select("url", F.explode(F.from_xml("x", F.lit(f"struct<url:array<{entry}>>"), {"mode": "PERMISSIVE"})["url"]).alias("e"))
    return sets.where("e.loc IS NOT NULL").select("url", F.btrim("e.loc").alias("loc"), "e.lastmod", "e.changefreq", "e.priority")


def sitemap_children(sitemaps: DataFrame) -> DataFrame:
    """(url, child): sitemaps that index files list."""
    clean = F.regexp_replace(F.regexp_replace("xml", r"<\?xml[^>]*\?>", ""), r'\sxmlns(:\w+)?="[^"]*"', "")
    parsed = sitemaps.select("url", clean.alias("x")).where(F.col("x").contains("<sitemapindex"))
    return parsed.select("url", F.explode(F.from_xml("x", F.lit("struct<sitemap:array<struct<loc:string>>>"), {"mode": "PERMISSIVE"})["sitemap"]).alias("e")).select("url", F.btrim("e.loc").alias("child"))


def reachable_sitemaps(sitemaps: DataFrame, root: str) -> DataFrame:
    """The root sitemap and those below it, however deeply they are nested; loops end as nothing new is found."""
    spark = sitemaps.sparkSession
    folder = f"{work_dir(spark)}/sitemaps-{uuid.uuid4().hex}"
    p, fs = _files(spark, folder)
    fs.deleteOnExit(p)
    children = _cut(sitemap_children(sitemaps).distinct(), f"{folder}/children")
    level = reached = sitemaps.where(F.col("url") == root).select("url").distinct()
    for depth in count():
        level = children.join(level, "url", "left_semi").select(F.col("child").alias("url")).distinct().join(reached, "url", "left_anti")
        level = _cut(level, f"{folder}/{depth}")
        if level.isEmpty():
            return sitemaps.join(reached, "url", "left_semi")
        reached = reached.union(level)


def canonical_column(df: DataFrame, url: str = "url") -> DataFrame:
    return df.withColumn("canonical", urls.canonical(F.col(url)))


def rejects(attempts: DataFrame) -> DataFrame:
    """What went wrong in a log of (url, status, error), with stage, class and whether another try makes sense; good answers have no row."""
    s, e = F.col("status"), F.col("error")
    kind = (
        F.when(e.isin("parse_error", "bad_selector"), "parse")
        .when(e.isin("write_error", "disk_full"), "storage")
        .when(e == "dropped", "pipeline")
        .when(e.isNotNull() | (s >= 400), "fetch")
    )
    name = F.coalesce(e, F.when(s == 429, "rate_limited").when(s >= 500, "server_error").when(s == 404, "not_found").when(s >= 400, "client_error"))
    again = (kind == "fetch") & F.coalesce(pages.is_retryable(e) | (s == 429) | (s >= 500), F.lit(False)) & F.coalesce(~e.isin("canceled", "deadline"), F.lit(True))
    return attempts.withColumns({"stage": kind, "error_class": name, "retryable": again}).where("stage IS NOT NULL")


def sitemap_candidates(origins: DataFrame, origin: str = "origin") -> DataFrame:
    """(origin, candidate): where a site's sitemap usually lies."""
    paths = F.array(*[F.lit(x) for x in ("/sitemap.xml", "/sitemap_index.xml", "/sitemap/sitemap.xml")])
    return origins.select(origin, F.explode(F.transform(paths, lambda x: F.concat(F.col(origin), x))).alias("candidate"))
