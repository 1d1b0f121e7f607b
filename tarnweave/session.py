"""Session settings the library relies on, and defaults for local work."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

#: UTC for all date functions; later map entries win, as assignments to a field would.
SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.mapKeyDedupPolicy": "LAST_WIN",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
}


def session(app: str = "tarnweave", master: str | None = None, **conf: str) -> SparkSession:
    """A session with SETTINGS; further settings by keyword, dots written as double underscores."""
    b = SparkSession.builder.appName(app)
    if master:
        b = b.master(master)
    for k, v in {**SETTINGS, **{k.replace("__", "."): v for k, v in conf.items()}}.items():
        b = b.config(k, v)
    return b.getOrCreate()


def spread(df: DataFrame, least: int = 16 << 20) -> DataFrame:
    """The table over all cores, if it is small and lies in fewer files than there are cores: for work that Python does row by row.

    A single row group would otherwise be one task. Tables of more than `least` bytes a core have tasks enough as they are read,
    and aren't shuffled.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return df.repartition(cores) if size <= least * cores and 0 < len(df.inputFiles()) < cores else df
