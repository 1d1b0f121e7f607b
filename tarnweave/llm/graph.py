"""Connected components by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import settle, unsettle


def components(pairs: DataFrame) -> DataFrame:
    """(id, root) for every id of the (a, b) pairs; root is the least id of its component.

    Each round hooks nodes to ever smaller ones, so chains and stars of any length take about log n rounds,
    and no node gathers more rows than it has neighbours. Lineage is cut after each round. Rows with a null and
    loops are ignored; no pairs give no rows.
    """
    edges = settle(pairs.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct())
    mark = None
    while True:
        both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = F.least(F.col("u"), F.min("v").over(Window.partitionBy("u")))
        large = both.select("u", "v", low.alias("m")).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        m = F.min("v").over(Window.partitionBy("u"))
        small = large.select("u", "v", m.alias("m"))
        small = small.select(F.explode(F.array(F.struct("u", F.col("m").alias("w")), F.struct(F.col("v").alias("u"), F.col("m").alias("w")))).alias("e"))
        new = settle(small.select("e.u", F.col("e.w").alias("v")).where("u <> v").distinct())
        now = tuple(new.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
        unsettle(edges)
        edges = new
        if now == mark:
            break
        mark = now
    return edges.groupBy("u").agg(F.min("v").alias("root")).withColumnRenamed("u", "id").union(edges.select(F.col("v").alias("id"), F.col("v").alias("root")).distinct())
