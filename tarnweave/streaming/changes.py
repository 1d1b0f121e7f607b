"""Change detection and throttling of running streams, with state per URL."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.query import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

CHANGES = "url string, type string, field string, old_value string, new_value string"


def stream_changes(items: DataFrame, fields: Sequence[str], url: str = "url", order: str = "ts", limit: int = 200) -> DataFrame:
    """Changes of each arriving item against the last one of its URL; the meaning is that of detect_changes().

    Items of a URL within a micro-batch are taken in the order of `order`. State: one row of fields per URL.
    """
    fields = list(fields)

    def cut(s: str | None) -> str | None:
        return s if s is None or len(s.encode()) <= limit else s.encode()[: limit - 3].decode("utf-8", "ignore") + "..."

    def step(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        was = dict(zip(fields, state.get)) if state.exists else None
        out = []
        for row in pd.concat(list(frames)).sort_values("_order", kind="stable")[fields].itertuples(index=False):
            now = {f: None if v is None or v != v else str(v) for f, v in zip(fields, row)}
            if was is None:
                out.append((key[0], "added", None, None, None))
            else:
                for f in fields:
                    a, b = was[f], now[f]
                    if b is None and a is not None:
                        out.append((key[0], "removed", f, cut(a), None))
                    elif b is not None and (a or "") != b:
                        out.append((key[0], "modified", f, cut(a), cut(b)))
            was = now
        state.update(tuple(was[f] for f in fields))
        yield pd.DataFrame(out, columns=["url", "type", "field", "old_value", "new_value"])

    rows = items.select(F.col(url).alias("url"), F.col(order).alias("_order"), *[F.col(f).cast("string").alias(f) for f in fields])
    return rows.groupBy("url").applyInPandasWithState(step, CHANGES, ", ".join(f"`{f}` string" for f in fields), "append", GroupStateTimeout.NoTimeout)


def stream_items(items: DataFrame, sink: Callable[[DataFrame, int], object], checkpoint: str, every: str | None = None) -> StreamingQuery:
    """Each micro-batch goes to sink(df, batch_id), which must tolerate a repeated id; every=None: what is there, then stop."""
    w = items.writeStream.foreachBatch(lambda df, k: sink(df, k)).option("checkpointLocation", checkpoint)
    return (w.trigger(processingTime=every) if every else w.trigger(availableNow=True)).start()


def stream_dedup(items: DataFrame, key: str, stamp: str, late: str = "1 hour") -> DataFrame:
    """First of each key; keys are forgotten once the watermark has passed."""
    return items.withWatermark(stamp, late).dropDuplicatesWithinWatermark([key])


def stream_windows(events: DataFrame, stamp: str = "ts", size: str = "1 hour", slide: str | None = None, late: str = "1 hour", by: Sequence[str] = ("event_type",)) -> DataFrame:
    """Counts and sums per window (an extension; the windows close with the watermark)."""
    w = F.window(stamp, size, slide) if slide else F.window(stamp, size)
    return events.withWatermark(stamp, late).groupBy(w, *by).agg(F.count("*").alias("n"), F.sum("value").alias("total"))


def stream_liveness(beats: DataFrame, node: str = "node", stamp: str = "ts") -> DataFrame:
    """Last sign of life per node, for complete or update output."""
    return beats.groupBy(node).agg(F.max(stamp).alias("last_seen"))
