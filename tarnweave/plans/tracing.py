"""Spans of driver-side work, kept in memory and turned into rows."""

from __future__ import annotations

import time
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

SPANS = "trace_id string, span_id string, parent_id string, name string, start_ns bigint, duration_ns bigint, status string, tags map<string,string>, events array<string>"


class Tracer:
    """Children inherit their parent's trace id; an exception marks its span as an error and goes on."""

    def __init__(self) -> None:
        self.spans: list[dict] = []
        self._open: list[dict] = []

    @contextmanager
    def span(self, name: str, **tags: str) -> Iterator[dict]:
        up = self._open[-1] if self._open else None
        s = {"trace_id": up["trace_id"] if up else uuid.uuid4().hex, "span_id": uuid.uuid4().hex[:16], "parent_id": up["span_id"] if up else None, "name": name, "start_ns": time.time_ns(), "duration_ns": 0, "status": "ok", "tags": dict(tags), "events": []}
        self._open.append(s)
        try:
            yield s
        except BaseException as e:
            s["status"] = "error"
            s["events"].append(f"{type(e).__name__}: {e}")
            raise
        finally:
            s["duration_ns"] = time.time_ns() - s["start_ns"]
            self._open.pop()
            self.spans.append(s)

    def flush(self, spark: SparkSession) -> DataFrame:
        """All finished spans as rows; the buffer is emptied."""
        rows, self.spans = self.spans, []
        return spark.createDataFrame(rows, SPANS)
