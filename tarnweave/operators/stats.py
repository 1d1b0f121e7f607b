"""Aggregates over responses, tasks, spans and latencies."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def crawl_stats(events: DataFrame, group: Sequence[str] = ()) -> DataFrame:
    """Counters over rows of (status, bytes, retries, error): requests, responses by class, errors, retries, bytes."""
    s = F.col("status")
    return events.groupBy(*group).agg(
        F.count("*").alias("requests"),
        F.count("status").alias("responses"),
        F.count_if(s.between(200, 299)).alias("success"),
        F.count_if(s.between(300, 399)).alias("redirects"),
        F.count_if(s.between(400, 499)).alias("client_errors"),
        F.count_if(s.between(500, 599)).alias("server_errors"),
        F.count_if(F.col("error").isNotNull()).alias("failed"),
        F.coalesce(F.sum("retries"), F.lit(0)).cast("bigint").alias("retries"),
        F.coalesce(F.sum("bytes"), F.lit(0)).cast("bigint").alias("bytes"),
    )


def host_stats(responses: DataFrame, host: str = "host", at: str = "ts") -> DataFrame:
    return responses.groupBy(host).agg(F.count("*").alias("requests"), F.count_if(F.col("error").isNotNull()).alias("errors"), F.max(at).alias("last_fetch"))


def long_metrics(wide: DataFrame) -> DataFrame:
    """One row per (name, value) of a row of counters."""
    return wide.unpivot([], wide.columns, "name", "value")


def prometheus(metrics: DataFrame, prefix: str = "crawl", name: str = "name", value: str = "value", help_: str = "help") -> DataFrame:
    """Text exposition: HELP, TYPE and value lines per metric, all typed counter, gauges too."""
    full = F.concat(F.lit(f"{prefix}_"), F.col(name))
    return metrics.select(F.concat(F.lit("# HELP "), full, F.lit(" "), F.col(help_), F.lit("\n# TYPE "), full, F.lit(" counter\n"), full, F.lit(" "), F.col(value).cast("string")).alias("line"))


def floor_percentiles(df: DataFrame, value: str, percents: Sequence[float], group: Sequence[str] = ()) -> DataFrame:
    """p<percent>: the element at 0-based place floor(n * p / 100) of the sorted values, the last one at most.

    Equal values are counted before the shuffle, so what is sorted per group is its distinct values.
    """
    w = Window.partitionBy(*group)
    counted = df.where(F.col(value).isNotNull()).groupBy(*group, value).agg(F.count("*").alias("_c"))
    ranked = counted.withColumn("_to", F.sum("_c").over(w.orderBy(value).rowsBetween(Window.unboundedPreceding, 0))).withColumn("_n", F.sum("_c").over(w))

    def at(p: float) -> Column:
        place = F.least(F.floor(F.col("_n") * p / 100), F.col("_n") - 1)
        return F.max(F.when((place < F.col("_to")) & (place >= F.col("_to") - F.col("_c")), F.col(value))).alias(f"p{p:g}".replace(".", "_"))

    return ranked.groupBy(*group).agg(F.sum("_c").alias("n"), *[at(p) for p in percents])


def latency_report(samples: DataFrame, seconds: float, group: Sequence[str] = ()) -> DataFrame:
    """Over rows of (ms, ok, bytes): counts, rates per second, error share, mean, extremes and percentiles."""
    base = samples.groupBy(*group).agg(
        F.count("*").alias("total"),
        F.count_if("ok").alias("ok"),
        F.count_if(~F.col("ok")).alias("failed"),
        (F.count("*") / seconds).alias("per_second"),
        (F.sum("bytes") / 1048576 / seconds).alias("mb_per_second"),
        (F.count_if(~F.col("ok")) * 100.0 / F.count("*")).alias("error_percent"),
        F.avg("ms").alias("avg_ms"),
        F.min("ms").alias("min_ms"),
        F.max("ms").alias("max_ms"),
    )
    pct = floor_percentiles(samples, "ms", (50, 95, 99, 99.9), group)
    return base.join(pct, list(group)) if group else base.crossJoin(pct)


def cluster_status(tasks: DataFrame, nodes: DataFrame) -> DataFrame:
    """One row: nodes, and tasks pending, running, done; failed ones aren't counted."""
    t = tasks.agg(*[F.count_if(F.col("status") == s).alias(s) for s in ("pending", "running", "done")])
    return nodes.agg(F.count("*").alias("nodes")).crossJoin(t)


def latest_status(events: DataFrame, key: str, at: str, status: str, tie: str) -> DataFrame:
    """The last status of each key in an event log."""
    return events.groupBy(key).agg(F.max_by(status, F.struct(at, tie)).alias("status"), F.max(at).alias("last_seen"))


def offline_nodes(beats: DataFrame, timeout_s: float, now: Column | None = None, node: str = "node", at: str = "ts") -> DataFrame:
    """(node, last_seen, offline): silent for longer than the timeout, at `now` or at the last beat of all."""
    last = beats.groupBy(node).agg(F.max(at).alias("last_seen"))
    if now is None:  # one row, joined to all
        last = last.crossJoin(F.broadcast(beats.agg(F.max(at).alias("_end"))))
    end = now if now is not None else F.col("_end")
    return last.withColumn("offline", F.unix_micros(end.cast("timestamp")) - F.unix_micros(F.col("last_seen").cast("timestamp")) > int(timeout_s * 1e6)).drop("_end")


def trace_stats(spans: DataFrame) -> DataFrame:
    """Over (duration_ns, status): spans, errors, and the mean in whole ms by integer division."""
    return spans.agg(F.count("*").alias("spans"), F.count_if(F.col("status") == "error").alias("errors"), F.expr("coalesce(sum(duration_ns) div count(*) div 1000000, 0)").alias("mean_ms"))


def bloom_shape(n: int, p: float) -> tuple[int, int]:
    """(bits, hashes) for n members at false-positive rate p; unusable arguments mean 100000 and 0.01."""
    import math

    if n <= 0:
        n = 100_000
    if not 0 < p < 1:
        p = 0.01
    m = math.ceil(-n * math.log(p) / math.log(2) ** 2)
    return m, max(1, math.ceil(m / n * math.log(2)))


def bloom_false_rate(bits: int, hashes: int, members: int) -> float:
    """Expected share of false positives after `members` insertions."""
    import math

    return (1 - math.exp(-hashes * members / bits)) ** hashes
