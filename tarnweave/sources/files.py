"""Files and stored responses as tables."""

from __future__ import annotations

import zlib

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import normalize

MIME = {"jpg": "image/jpeg", "jpeg": "image/jpeg", "png": "image/png", "gif": "image/gif", "webp": "image/webp", "svg": "image/svg+xml", "mp4": "video/mp4", "webm": "video/webm", "mp3": "audio/mpeg", "wav": "audio/wav", "pdf": "application/pdf", "doc": "application/msword", "html": "text/html", "txt": "text/plain", "json": "application/json"}


def media_files(spark: SparkSession, path: str, most: int = 50 << 20, glob: str | None = None) -> DataFrame:
    """(path, name, ext, size, mime, class, modified, sha256, copy_of): files up to `most` bytes; copy_of is the first path with the same content."""
    r = spark.read.format("binaryFile").option("recursiveFileLookup", True)
    df = (r.option("pathGlobFilter", glob) if glob else r).load(path).where(F.col("length") <= most)
    name = F.element_at(F.split("path", "/"), -1)
    ext = F.lower(F.regexp_extract(name, r"\.([^.]+)$", 1))
    mime = F.coalesce(F.element_at(F.create_map(*[F.lit(x) for kv in MIME.items() for x in kv]), ext), F.lit("application/octet-stream"))
    meta = df.select("path", name.alias("name"), ext.alias("ext"), F.col("length").alias("size"), mime.alias("mime"), normalize.media_class(mime).alias("class"), F.col("modificationTime").alias("modified"), F.sha2("content", 256).alias("sha256"))
    first = meta.groupBy("sha256").agg(F.min("path").alias("_first"))
    return meta.join(first, "sha256").withColumn("copy_of", F.when(F.col("_first") != F.col("path"), F.col("_first"))).drop("_first")


def decompress(body: Column, encoding: Column) -> Column:
    """gzip and deflate bodies unpacked, others as they are; damaged ones null."""

    @F.arrow_udf("binary")
    def unpack(data: pa.Array, how: pa.Array) -> pa.Array:
        out = []
        for b, h in zip(data.to_pylist(), how.to_pylist()):
            try:
                if b is None or h not in ("gzip", "deflate"):
                    out.append(b)
                else:
                    out.append(zlib.decompress(b, 47 if h == "gzip" or b[:1] == b"\x78" else -15))
            except zlib.error:
                out.append(None)
        return pa.array(out, pa.binary())

    return F.when(F.lower(encoding).isin("gzip", "deflate"), unpack(body, F.lower(encoding))).otherwise(body)


def cap_body(df: DataFrame, most: int = 10 << 20, body: str = "body") -> DataFrame:
    """Only responses of at most `most` bytes, as stored."""
    return df.where(F.octet_length(body) <= most)


def import_queue(spark: SparkSession, path: str) -> DataFrame:
    """Queued tasks from JSON; all are pending again."""
    return spark.read.schema("id string, type string, urls array<string>, priority int, status string, assigned_to string").json(path).withColumns({"status": F.lit("pending"), "assigned_to": F.lit(None).cast("string")})


def export_queue(tasks: DataFrame) -> DataFrame:
    return tasks.select(F.to_json(F.struct("*")).alias("value"))
