"""Bloom filters as data: built per partition, merged, and asked in Arrow batches."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import stats


#: The largest filter that is built: 128 MB. Beyond it, and on any doubt about memory, the anti join of frontier.unseen() is the way.
MOST_BITS = 1 << 30


def _hashes(key: str) -> tuple:
    """Two hashes of the column, made by the JVM; a null counts as an empty key."""
    k = F.coalesce(F.col(key).cast("string"), F.lit(""))
    return F.xxhash64(k), F.xxhash64(k, F.lit(1))


def _places(a: np.ndarray, b: np.ndarray, bits: int, hashes: int) -> np.ndarray:
    """Bit numbers of each key by double hashing."""
    a, b = a.view(np.uint64)[:, None], (b.view(np.uint64) | np.uint64(1))[:, None]
    with np.errstate(over="ignore"):
        return ((a + np.arange(hashes, dtype=np.uint64) * b) % np.uint64(bits)).astype(np.int64)


def _merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    own = None
    for b in batches:
        for x in b.column(0):
            x = np.frombuffer(x.as_buffer(), np.uint8)
            own = x.copy() if own is None else np.bitwise_or(own, x, out=own)
    if own is not None:
        yield pa.RecordBatch.from_arrays([pa.array([own.tobytes()], pa.binary())], ["bits"])


def build(df: DataFrame, key: str, expected: int, rate: float = 0.01) -> bytes:
    """One filter over the column: partial filters per partition are merged by OR, first in sixteen tasks, then in one, and the driver gets the result.

    Its size is that of `expected` members at `rate`, whatever the table holds; above MOST_BITS it is an error.
    """
    bits, hashes = stats.bloom_shape(expected, rate)
    if bits > MOST_BITS:
        raise ValueError("the filter would be too large; use an anti join")

    def part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = np.zeros(-(-bits // 8), np.uint8)
        for b in batches:
            at = _places(np.asarray(b.column(0)), np.asarray(b.column(1)), bits, hashes).ravel()
            np.bitwise_or.at(own, at >> 3, (128 >> (at & 7)).astype(np.uint8))
        yield pa.RecordBatch.from_arrays([pa.array([own.tobytes()], pa.binary())], ["bits"])

    parts = df.select(*_hashes(key)).mapInArrow(part, "bits binary")
    got = parts.repartition(16).mapInArrow(_merge, "bits binary").repartition(1).mapInArrow(_merge, "bits binary").first()
    return got[0] if got else bytes(-(-bits // 8))


def might_contain(df: DataFrame, key: str, filter_bits: bytes, expected: int, rate: float = 0.01, out: str = "maybe") -> DataFrame:
    """With a column that is false only for keys that were never added."""
    bits, hashes = stats.bloom_shape(expected, rate)
    shared = df.sparkSession.sparkContext.broadcast(filter_bits)

    @F.arrow_udf(T.BooleanType())
    def ask(a: pa.Array, b: pa.Array) -> pa.Array:
        own, at = np.frombuffer(shared.value, np.uint8), _places(np.asarray(a), np.asarray(b), bits, hashes)
        return pa.array((own[at >> 3] & (128 >> (at & 7)).astype(np.uint8)).astype(bool).all(1))

    return df.withColumn(out, ask(*_hashes(key)))


def hybrid_unseen(df: DataFrame, seen: DataFrame, key: str, expected: int, rate: float = 0.01) -> DataFrame:
    """Rows whose key isn't in seen: a negative answer of the filter is final, a positive one is checked exactly by an anti join.

    Where the filter would be larger than MOST_BITS the anti join does all the work.
    """
    if stats.bloom_shape(expected, rate)[0] > MOST_BITS:
        return df.join(seen.select(key).distinct(), key, "left_anti").select(*df.columns)
    asked = might_contain(df, key, build(seen, key, expected, rate), expected, rate, "_maybe")
    sure = asked.where(~F.col("_maybe"))
    return sure.union(asked.where("_maybe").join(seen.select(key).distinct(), key, "left_anti").select(*sure.columns)).drop("_maybe")
