"""Change detection between snapshots and line diffs."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text


def long_fields(items: DataFrame, fields: Sequence[str], url: str = "url") -> DataFrame:
    """(url, field, value) of the fields that aren't null, as text."""
    return items.select(F.col(url).alias("url"), *[F.col(f).cast("string").alias(f) for f in fields]).unpivot(["url"], list(fields), "field", "value").where("value IS NOT NULL")


def detect_changes(old: DataFrame, new: DataFrame, fields: Sequence[str], url: str = "url", limit: int = 200) -> DataFrame:
    """(url, type, field, old_value, new_value) of the new snapshot against the old one.

    A URL seen for the first time is one `added` row. A field whose text differs is `modified` (a new field
    counts as changed from "", so a new empty field isn't reported), one that is gone `removed`. URLs absent
    from the new snapshot aren't looked at. Values are cut at `limit` bytes. Two shuffles, on (url, field) and url.
    """
    was, now = long_fields(old, fields, url).withColumnRenamed("value", "old_value"), long_fields(new, fields, url).withColumnRenamed("value", "new_value")
    urls_old, urls_new = old.select(F.col(url).alias("url")).distinct(), new.select(F.col(url).alias("url")).distinct()
    fresh = urls_new.join(urls_old, "url", "left_anti").select("url", F.lit("added").alias("type"), *[F.lit(None).cast("string").alias(c) for c in ("field", "old_value", "new_value")])
    both = was.join(now, ["url", "field"], "full_outer").join(urls_old.join(urls_new, "url"), "url", "left_semi")
    kind = F.when(F.col("new_value").isNull(), "removed").when(F.coalesce("old_value", F.lit("")) != F.col("new_value"), "modified")
    cut = [F.when(F.col(c).isNotNull(), text.truncate(F.col(c), limit, inside=True)).alias(c) for c in ("old_value", "new_value")]
    return fresh.unionByName(both.withColumn("type", kind).where("type IS NOT NULL").select("url", "type", "field", *cut))


def diff_lines(old: Column, new: Column) -> Column:
    """struct<added,removed>: trimmed lines that aren't empty and occur only on one side; repeats stay."""
    a, b = (F.filter(F.transform(F.split(F.coalesce(c, F.lit("")), "\n"), text.trim), lambda x: x != "") for c in (old, new))
    return F.struct(F.filter(b, lambda x: ~F.array_contains(a, x)).alias("added"), F.filter(a, lambda x: ~F.array_contains(b, x)).alias("removed"))


def notification(changes: DataFrame, url: str = "url") -> DataFrame:
    """The body a webhook gets per URL, with the changes and their count; nothing where nothing changed."""
    return changes.groupBy(url).agg(F.to_json(F.struct(F.sort_array(F.collect_list(F.struct("type", "field", "old_value", "new_value"))).alias("changes"), F.count("*").alias("count"))).alias("body"))
