"""Item sinks. Rows carry `_url`, `_timestamp` and, where set, `_spider`, then their fields."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import text

META = ("_url", "_timestamp", "_spider")
RFC3339 = "yyyy-MM-dd'T'HH:mm:ssXXX"


def item_rows(df: DataFrame) -> DataFrame:
    """Metadata first; timestamps as RFC 3339."""
    cols = [c for c in META if c in df.columns] + [c for c in df.columns if c not in META]
    return df.select(*[F.date_format(c, RFC3339).alias(c) if isinstance(df.schema[c].dataType, T.TimestampType) else F.col(c) for c in cols])


def flat_rows(df: DataFrame) -> DataFrame:
    """All columns as text in the order of their names; anything that isn't text as JSON."""

    def flat(f: T.StructField) -> Column:
        c = F.col(f"`{f.name}`")
        if isinstance(f.dataType, T.StringType):
            return c.alias(f.name)
        if isinstance(f.dataType, (T.ArrayType, T.MapType, T.StructType, T.VariantType)):
            return F.to_json(c).alias(f.name)
        if isinstance(f.dataType, T.TimestampType):
            return F.date_format(c, RFC3339).alias(f.name)
        return c.cast("string").alias(f.name)

    return df.select(*[flat(f) for f in sorted(df.schema.fields, key=lambda f: f.name)])


def write_jsonl(df: DataFrame, path: str, mode: str = "append", per_file: int = 0) -> None:
    w = item_rows(df).write.mode(mode)
    (w.option("maxRecordsPerFile", per_file) if per_file else w).json(path)


def write_csv(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    """One header per file with all columns; quotes are doubled."""
    flat_rows(item_rows(df)).write.mode(mode).option("header", True).option("escape", '"').csv(path)


def write_json_array(df: DataFrame, path: str) -> int:
    """One file with one array; the number of items. Executors write the parts, which are then put together as bytes: rows never pass through the driver's memory."""
    spark = df.sparkSession
    jvm, conf = spark._jvm, spark._jsparkSession.sessionState().newHadoopConf()
    target = jvm.org.apache.hadoop.fs.Path(path)
    fs = target.getFileSystem(conf)
    parts = jvm.org.apache.hadoop.fs.Path(f"{path}.parts")
    item_rows(df).select(F.concat(F.lit(","), F.to_json(F.struct("*"), {"ignoreNullFields": "true"})).alias("value")).write.mode("overwrite").text(f"{path}.parts")
    n = spark.read.text(f"{path}.parts").count()
    out, first = fs.create(target, True), True
    try:
        out.writeBytes("[\n")
        for name in sorted(f.getPath().getName() for f in fs.listStatus(parts)):
            if name.startswith("part-") and fs.getFileStatus(jvm.org.apache.hadoop.fs.Path(parts, name)).getLen():
                part = fs.open(jvm.org.apache.hadoop.fs.Path(parts, name))
                if first:
                    part.read()  # no comma before the first item
                    first = False
                jvm.org.apache.hadoop.io.IOUtils.copyBytes(part, out, conf, False)
                part.close()
        out.writeBytes("]\n")
    finally:
        out.close()
    fs.delete(parts, True)
    return n


def write_items(df: DataFrame, kind: str, path: str) -> None:
    """json, jsonl or csv; anything else is an error."""
    kinds: dict[str, Callable] = {"json": write_json_array, "jsonl": write_jsonl, "csv": write_csv}
    if kind not in kinds:
        raise ValueError(f"unknown sink {kind!r}; one of {', '.join(sorted(kinds))}")
    kinds[kind](df, path)


def fan_out(df: DataFrame, sinks: Sequence[Callable[[DataFrame], object]]) -> None:
    """Every sink gets the rows, failing ones aside; the first error is raised at the end. The rows are computed once."""
    first: Exception | None = None
    df = df.persist()
    try:
        for sink in sinks:
            try:
                sink(df)
            except Exception as e:  # noqa: BLE001  all sinks are tried
                first = first or e
    finally:
        df.unpersist()
    if first:
        raise first


def write_partitioned(df: DataFrame, path: str, per_file: int = 100, stamp: str = "_timestamp") -> None:
    """Object-store layout: date=.../ with files of at most `per_file` rows of fields only."""
    fields = [c for c in df.columns if c not in META]
    df.select(F.to_date(stamp).alias("date"), *fields).write.mode("append").partitionBy("date").option("maxRecordsPerFile", per_file).json(path)


def message_rows(df: DataFrame, url: str = "_url", spider: str = "_spider", stamp: str = "_timestamp") -> DataFrame:
    """(key, value) for a message queue: the key is the URL, the value JSON of url, spider, fields and scraped_at."""
    fields = [c for c in df.columns if c not in META]
    value = F.to_json(F.struct(F.col(url).alias("url"), (F.col(spider) if spider in df.columns else F.lit("")).alias("spider"), F.struct(*fields).alias("fields"), F.date_format(stamp, RFC3339).alias("scraped_at")))
    return df.select(F.col(url).alias("key"), value.alias("value"))


def table_rows(df: DataFrame, url: str = "_url", spider: str = "_spider", stamp: str = "_timestamp") -> DataFrame:
    """(url, spider_name, fields as JSON, scraped_at) for a relational table."""
    fields = [c for c in df.columns if c not in META]
    return df.select(F.col(url).alias("url"), (F.col(spider) if spider in df.columns else F.lit("")).alias("spider_name"), F.to_json(F.struct(*fields)).alias("fields"), F.col(stamp).alias("scraped_at"))


def mask(dsn: Column) -> Column:
    return text.mask_dsn(dsn)
