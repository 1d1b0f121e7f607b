"""What the corpus operators share: Arrow word splitting, word hashes, scratch tables."""

from __future__ import annotations

import ctypes
import tempfile
import uuid
from collections.abc import Callable, Iterator
from functools import wraps

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import spread  # noqa: F401  the operators take it from here

#: Bytes of text that one vectorised step handles; a longer document forms a step alone.
CHUNK = 4 << 20
TOKENIZERS = "/opt/tokenizers"
PUNCT = "".join(chr(c) for c in range(33, 127) if not chr(c).isalnum()) + "¡¿«»“”‘’…–—"
M64 = (1 << 64) - 1


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that spark.checkpoint.dir names. Where it is unset, one of our own on a single machine; on a cluster, whose executors share no such folder, an error."""
    d = spark.conf.get("spark.checkpoint.dir", None)
    if not d:
        if not spark.sparkContext.master.split("[")[0] == "local":
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        if not hasattr(shared_dir, "own"):
            shared_dir.own = tempfile.mkdtemp(prefix="tarnweave-")
        d = shared_dir.own
    return d.rstrip("/")


def _path(df: DataFrame, path: str) -> tuple:
    """(Hadoop path, its file system)."""
    p = df.sparkSession._jvm.org.apache.hadoop.fs.Path(path)
    return p, p.getFileSystem(df.sparkSession._jsparkSession.sessionState().newHadoopConf())


def settle(df: DataFrame) -> DataFrame:
    """Cut lineage: written to the shared folder and read back, so a lost executor costs no recomputation. What unsettle() leaves goes when the driver ends."""
    path = f"{shared_dir(df.sparkSession)}/settle-{uuid.uuid4().hex}"
    schema = df.schema
    df.write.parquet(path)
    p, files = _path(df, path)
    files.deleteOnExit(p)
    out = df.sparkSession.read.schema(schema).parquet(path)
    out._settled_at = path
    return out


def unsettle(df: DataFrame | None) -> None:
    """Delete a table of settle() of which nothing depends any more."""
    path = getattr(df, "_settled_at", None)
    if path:
        p, files = _path(df, path)
        files.delete(p, True)
        files.cancelDeleteOnExit(p)


def pick(df: DataFrame, **cols: str) -> DataFrame:
    """Only the named columns, under names of our own: other columns can't clash."""
    return df.select(*[df[f"`{c}`"].alias(k) for k, c in cols.items()])


def plain(texts: pa.Array) -> pa.Array:
    """A string array with 32-bit offsets where nulls are empty."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    return pc.fill_null(texts.cast(pa.string()), "")


def chunks(texts: pa.Array, limit: int = CHUNK) -> Iterator[tuple[int, int]]:
    """(from, to) row ranges of at most `limit` bytes, or of one longer text."""
    sizes = np.asarray(pc.fill_null(pc.binary_length(texts), 0))
    ends = np.cumsum(sizes)
    i, n = 0, len(sizes)
    while i < n:
        base = ends[i - 1] if i else 0
        j = max(i + 1, int(np.searchsorted(ends, base + limit, side="right")))
        yield i, j
        i = j


def release() -> None:
    """Give back to the system what Arrow and the allocator keep of freed memory: workers stay, and those of former stages would hold it beside the next one's."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # only glibc has it
    if trim:
        trim(0)


def lean(run: Callable) -> Callable:
    """A function for mapInArrow() that releases its memory when its partition ends."""

    @wraps(run)
    def released(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(batches)
        finally:
            release()

    return released


def string_parts(arr: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets from 0) of a string array without nulls."""
    offs = np.frombuffer(arr.buffers()[1], np.int32)[arr.offset : arr.offset + len(arr) + 1].astype(np.int64) if len(arr) else np.zeros(1, np.int64)
    data = np.frombuffer(arr.buffers()[2], np.uint8) if arr.buffers()[2] is not None and len(arr) else np.zeros(0, np.uint8)
    return data[offs[0] : offs[-1]], offs - offs[0]


_POW = np.ones(1, np.uint64)


def _powers(n: int) -> np.ndarray:
    global _POW
    if len(_POW) < n:
        with np.errstate(over="ignore"):
            p = np.empty(max(n, 2 * len(_POW), 256), np.uint64)
            p[0] = 1
            p[1:] = np.uint64(0x9E3779B97F4A7C15 | 1)
            _POW = np.multiply.accumulate(p)
    return _POW


def mix(h: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser."""
    with np.errstate(over="ignore"):
        h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return h ^ (h >> np.uint64(31))


def hash_strings(arr: pa.Array) -> np.ndarray:
    """uint64 hash of each string: a polynomial in its bytes, then mixed; the same on every machine."""
    data, offs = string_parts(arr)
    lens = np.diff(offs)
    out = np.zeros(len(lens), np.uint64)
    full = lens > 0
    if full.any():
        pos = np.arange(len(data)) - np.repeat(offs[:-1], lens)
        with np.errstate(over="ignore"):
            prod = (data.astype(np.uint64) + np.uint64(1)) * _powers(int(lens.max()))[pos]
            out[full] = np.add.reduceat(prod, offs[:-1][full])
    with np.errstate(over="ignore"):
        return mix(out + lens.astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))


def split_words(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """Words by Unicode white space, and the offsets of each text among them. No empty words."""
    lists = pc.utf8_split_whitespace(texts)
    words, offs = lists.flatten(), np.asarray(lists.offsets).astype(np.int64)
    offs = offs - offs[0]
    empty = np.asarray(pc.equal(pc.binary_length(words), 0))
    if empty.any():
        kept = np.concatenate([[0], np.cumsum(~empty)])
        words, offs = words.filter(pa.array(~empty)), kept[offs]
    return words, offs


def normal_words(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Hash of each word, lower-cased and without outer punctuation; offsets per text. Bare punctuation gives none."""
    words, offs = split_words(pc.utf8_lower(texts))
    words = pc.utf8_trim(words, characters=PUNCT)
    empty = np.asarray(pc.equal(pc.binary_length(words), 0))
    h = hash_strings(words)
    if empty.any():
        kept = np.concatenate([[0], np.cumsum(~empty)])
        h, offs = h[~empty], kept[offs]
    return h, offs


def owners(offs: np.ndarray) -> np.ndarray:
    """The row that each element belongs to."""
    return np.repeat(np.arange(len(offs) - 1), np.diff(offs))


def sample_labels(labels: DataFrame, label: str, most: int, docs: DataFrame, docs_id: str, id_col: str = "doc_id") -> DataFrame:
    """At most `most` labelled ids of those that docs has, spread by a hash of the id; of contradicting labels of an id the largest holds; nulls go."""
    one = pick(labels, id=id_col, y=label).dropna().select(F.col("id").cast("long").alias("id"), F.col("y").cast("int").alias("y")).groupBy("id").agg(F.max("y").alias("y"))
    have = pick(docs, id=docs_id).select(F.col("id").cast("long").alias("id"))
    return one.join(have, "id", "left_semi").orderBy(F.xxhash64("id"), "id").limit(most)


#: Up to so many ids (16 MB of longs) a list of ids goes to all executors; a longer one is joined by shuffling.
BROADCAST_IDS = 2_000_000


def by_ids(df: DataFrame, ids: DataFrame, id_col: str, how: str) -> DataFrame:
    """Semi or anti join with a settled table of one column of distinct ids; rows with a null id match nothing.

    The size of the list is checked first: while it is small the texts of `df` aren't shuffled.
    """
    right = ids.select(ids[0].alias("_by_id"))
    if right.limit(BROADCAST_IDS + 1).count() <= BROADCAST_IDS:
        right = F.broadcast(right)
    return df.join(right, df[f"`{id_col}`"] == right["_by_id"], how)
