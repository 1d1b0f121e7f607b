"""URL admission, the frontier, and operators that depend on an order."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import urls

#: Lists up to this many rows are sent to all executors; longer ones are shuffled on the host.
BROADCAST_ROWS = 100_000


def _maybe_broadcast(df: DataFrame) -> DataFrame:
    """A list is broadcast only after a bounded look at its size."""
    return F.broadcast(df) if df.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS else df


def keyed(df: DataFrame, url: str = "url") -> DataFrame:
    """With canonical, url_hash and host columns."""
    return df.withColumn("canonical", urls.canonical(F.col(url))).withColumns({"url_hash": urls.url_hash(F.col("canonical")), "host": urls.host(F.col("canonical"))})


def within_depth(most: int, depth: str = "depth") -> Column:
    """Seeds have depth 0; 0 or less for `most` is no limit."""
    return F.col(depth) <= most if most > 0 else F.lit(True)


def unseen(df: DataFrame, seen: DataFrame) -> DataFrame:
    """Rows whose url_hash isn't in seen(url_hash): an anti join, for which Spark builds run-time Bloom filters itself."""
    return df.join(seen.select("url_hash"), "url_hash", "left_anti")


def allowed_hosts(df: DataFrame, allow: DataFrame | None = None, deny: DataFrame | None = None, host: str = "host") -> DataFrame:
    """Exact hosts. Where there is an allow list, the deny list isn't looked at."""
    if allow is not None:
        return df.join(_maybe_broadcast(allow.select(F.col("host").alias(host)).distinct()), host, "left_semi")
    if deny is not None:
        return df.join(_maybe_broadcast(deny.select(F.col("host").alias(host)).distinct()), host, "left_anti")
    return df


def admit(requests: DataFrame, seen: DataFrame | None, rules: DataFrame | None = None, allow: Sequence[str] = (), deny: Sequence[str] = (), most: int = 0) -> DataFrame:
    """Each request (url, depth) with the first reason against it: depth, seen, robots, domain, or null.

    rules: (host, allow, disallow). The checks run in this order, the cheap ones first.
    """
    df = keyed(requests)
    df = df.withColumn("_seen", F.lit(False)) if seen is None else df.join(seen.select("url_hash").distinct().withColumn("_seen", F.lit(True)), "url_hash", "left")
    if rules is not None:
        df = df.join(_maybe_broadcast(rules.select("host", "allow", "disallow")), "host", "left")
        robots = ~urls.robots_allowed(F.coalesce(urls.part(F.col("canonical"), "PATH"), F.lit("/")), F.col("allow"), F.col("disallow"))
    else:
        robots = F.lit(False)
    foreign = ~F.col("host").isin(*allow) if allow else F.col("host").isin(*deny) if deny else F.lit(False)
    reason = F.when(~within_depth(most), "depth").when(F.col("_seen"), "seen").when(robots, "robots").when(F.coalesce(foreign, F.lit(True)), "domain")
    return df.withColumn("rejected", reason).drop("_seen", "allow", "disallow")


def next_batch(frontier: DataFrame, k: int, tie: Sequence[str] = ("depth", "created_at", "url_hash")) -> DataFrame:
    """The k most urgent requests: least priority value, then a total order. A top-k without a full sort."""
    return frontier.orderBy("priority", *[c for c in tie if c in frontier.columns]).limit(k)


def chunk(df: DataFrame, size: int, order: Sequence[str], partition: Sequence[str] = ()) -> DataFrame:
    """With a batch number for runs of `size` rows in the order given."""
    w = Window.partitionBy(*partition).orderBy(*order)
    return df.withColumn("batch", F.floor((F.row_number().over(w) - 1) / size).cast("int"))


def round_robin(df: DataFrame, choices: Sequence[str], order: Sequence[str], partition: Sequence[str] = ()) -> DataFrame:
    """With `choice`, dealt in turn; the count goes up before the pick, so the second choice comes first."""
    n = F.row_number().over(Window.partitionBy(*partition).orderBy(*order))
    return df.withColumn("choice", F.element_at(F.array(*[F.lit(c) for c in choices]), (n % len(choices) + 1).cast("int")))


def throttle(df: DataFrame, delay: float, arrival: str, partition: Sequence[str] = (), order: Sequence[str] = ()) -> DataFrame:
    """With `start`: each request of a group begins no sooner than `delay` after the one before.

    start_i = max(arrival_i, start_{i-1} + delay) unrolls to a running maximum of arrival - (i-1) * delay.
    Without partition columns all requests form one queue, which one task orders.
    """
    w = Window.partitionBy(*partition).orderBy(arrival, *order)
    i = (F.row_number().over(w) - 1) * F.lit(delay)
    df = df.withColumn("_lag", i)
    top = F.max(F.col(arrival) - F.col("_lag")).over(w.rowsBetween(Window.unboundedPreceding, 0))
    return df.withColumn("start", top + F.col("_lag")).drop("_lag")


def idle_streaks(df: DataFrame, idle: Column, order: Sequence[str], partition: Sequence[str] = ()) -> DataFrame:
    """With `streak`: how many idle ticks in a row end here, 0 on a busy one."""
    w = Window.partitionBy(*partition).orderBy(*order)
    df = df.withColumn("_idle", idle).withColumn("_run", F.sum(F.when(F.col("_idle"), 0).otherwise(1)).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    streak = F.sum(F.col("_idle").cast("int")).over(Window.partitionBy(*partition, "_run").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0))
    return df.withColumn("streak", streak.cast("int")).drop("_idle", "_run")


def assign_tasks(tasks: DataFrame, nodes: DataFrame) -> DataFrame:
    """Pending tasks (id, priority) to free slots of active nodes (id, capacity, active_jobs): (task_id, node_id).

    Each task takes the node with most capacity left, ties by node id. The k-th slot a node gives away has
    capacity - active - k left before it, so ranking slots by what is left gives the greedy order as a join.
    """
    free = nodes.where("status = 'active' AND capacity > active_jobs").select(F.col("id").alias("node_id"), F.explode(F.expr("sequence(capacity - active_jobs, 1, -1)")).alias("left"))
    slots = free.withColumn("turn", F.row_number().over(Window.orderBy(F.desc("left"), "node_id")))
    room = slots.count()  # no more tasks than slots need a rank: a top-k, not a sort of the whole queue
    first = tasks.where("status = 'pending'").orderBy("priority", "id").limit(room)
    queue = first.select(F.col("id").alias("task_id"), F.row_number().over(Window.orderBy("priority", "id")).alias("turn"))
    return queue.join(slots, "turn").select("task_id", "node_id")
