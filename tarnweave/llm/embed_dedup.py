"""Embedding near-duplicates with randomised-rotation binary codes.

Every unit vector is rotated by one random orthogonal matrix; its code is the signs of the rotated
coordinates, and a stored correction factor f = <code vector, vector> makes <code vector, q> / f an unbiased
estimate of <vector, q>, with a confidence bound of E0 * sqrt((1 - f^2) / f^2 / (D - 1)). Equal vectors are one class
and take part once. Classes meet where they agree in all of several sampled code bits, in as many samplings as keep the
chance to miss a pair at the threshold below MISS. Of each such pair one side is the query, as an 8-bit rotated
vector; only pairs whose upper bound reaches the threshold are computed exactly. Crowded cells are left to a next
round, which samples more bits.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .ann import unit_codes
from .common import settle, unsettle
from .graph import components

THRESHOLD, MISS, CELL, CROWD, MORE, WIDEST, E0, SEED = 0.95, 0.001, 64, 2048, 6, 36, 4.0, 17
SCAN = 1024


def samplings(width: int, threshold: float) -> int:
    """So many samplings of `width` bits that a pair at the threshold shares none with a chance of at most MISS; a bit of theirs is equal with a chance of 1 - acos(threshold) / pi."""
    both = (1 - np.arccos(threshold) / np.pi) ** width
    return max(1, int(np.ceil(np.log(MISS) / np.log1p(-min(both, 0.999999)))))


def rotation(dim: int, seed: int = SEED) -> np.ndarray:
    q, r = np.linalg.qr(np.random.default_rng(seed).standard_normal((dim, dim)))
    return (q * np.sign(np.diag(r))).astype(np.float32)


def encode(x: np.ndarray, rot: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(sign bits, correction factors, 8-bit rotated vectors) of unit rows."""
    y = x @ rot.T
    bits = y > 0
    return bits, (np.abs(y).sum(1) / np.sqrt(y.shape[1])).astype(np.float32), np.rint(np.clip(y, -1, 1) * 127).astype(np.int8)


def estimate(bits: np.ndarray, factor: np.ndarray, query: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(estimates, bounds): codes x queries; the bound also covers the query's rounding."""
    dim = bits.shape[1]
    signs = np.where(bits, 1.0, -1.0).astype(np.float32) / np.sqrt(dim)
    est = signs @ (query.astype(np.float32) / 127).T / factor[:, None]
    bound = E0 * np.sqrt(np.maximum(0, 1 - factor**2) / factor**2 / max(1, dim - 1)) + np.sqrt(dim) / 254 / factor
    return est, bound


def _scan(dim: int, threshold: float):
    """Candidate pairs of each cell. Rows come sorted by cell; a cell's codes are held as arrays and compared in blocks of SCAN x SCAN."""

    def pairs(ids: np.ndarray, code: np.ndarray, factor: np.ndarray, query: np.ndarray) -> Iterator[pa.RecordBatch]:
        for i in range(0, len(ids), SCAN):
            bits = np.unpackbits(code[i : i + SCAN], axis=1)[:, :dim].astype(bool)
            for j in range(i, len(ids), SCAN):
                est, bound = estimate(bits, factor[i : i + SCAN], query[j : j + SCAN])
                x, y = np.nonzero(est + bound[:, None] >= threshold)
                keep = j + y > i + x  # each pair once
                a, b = ids[i + x[keep]], ids[j + y[keep]]
                if len(a):
                    yield pa.RecordBatch.from_arrays([pa.array(np.minimum(a, b)), pa.array(np.maximum(a, b))], ["a", "b"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None
        for batch in batches:
            n = batch.num_rows
            if not n:
                continue
            own = [np.asarray(batch.column(k)) for k in (0, 1, 2)]
            own += [np.frombuffer(b"".join(batch.column(3).to_pylist()), np.uint8).reshape(n, -1), np.asarray(batch.column(4)), np.frombuffer(b"".join(batch.column(5).to_pylist()), np.int8).reshape(n, dim)]
            t, cell, *rest = own if held is None else [np.concatenate(z) for z in zip(held, own)]
            ends = np.flatnonzero((t[1:] != t[:-1]) | (cell[1:] != cell[:-1])) + 1
            for lo, hi in zip(np.append(0, ends[:-1]), ends):  # the last cell may go on in the next batch
                if hi - lo > 1:
                    yield from pairs(*(z[lo:hi] for z in rest))
            at = int(ends[-1]) if len(ends) else 0
            held = [z[at:] for z in (t, cell, *rest)]
        if held is not None and len(held[0]) > 1:
            yield from pairs(*held[2:])

    return run


def _exact(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        x, y = (np.frombuffer(b"".join(c.to_pylist()), np.int16).reshape(batch.num_rows, -1).astype(np.float64) for c in (batch.column(2), batch.column(3)))
        cos = (x * y).sum(1) / np.maximum(np.linalg.norm(x, axis=1) * np.linalg.norm(y, axis=1), 1e-12)
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(cos)], ["a", "b", "cosine"])


def _spread(dim: int, width: int, chosen: list[np.ndarray]):
    """(t, cell, id, code, f, q) of each vector in each sampling."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rot = rotation(dim)
        for batch in batches:
            if not batch.num_rows:
                continue
            x = np.frombuffer(b"".join(batch.column(1).to_pylist()), np.int16).reshape(batch.num_rows, dim).astype(np.float32)
            x /= np.linalg.norm(x, axis=1, keepdims=True)
            bits, factor, query = encode(x, rot)
            codes, queries = [r.tobytes() for r in np.packbits(bits, axis=1)], [r.tobytes() for r in query]
            for t, at in enumerate(chosen):
                cell = bits[:, at].astype(np.int64) @ (1 << np.arange(width, dtype=np.int64))
                yield pa.RecordBatch.from_arrays([pa.array([t] * len(x), pa.int32()), pa.array(cell), batch.column(0), pa.array(codes), pa.array(factor), pa.array(queries)], ["t", "cell", "id", "code", "f", "q"])

    return run


def _classes(df: DataFrame, id_col: str, vec_col: str) -> DataFrame:
    """(id, class, v): the vectors that can be compared; class is the least id of those whose codes are equal. Settled."""
    coded = settle(unit_codes(df, id_col, vec_col))
    least = coded.groupBy("v").agg(F.min("id").alias("class"))
    out = settle(coded.join(least, "v").select("id", "class", "v"))
    unsettle(coded)
    return out


def _class_pairs(vecs: DataFrame, threshold: float) -> DataFrame:
    """(a, b, cosine), a < b, of distinct vectors (id, v) whose cosine reaches the threshold. Settled."""
    spark = vecs.sparkSession
    head = vecs.select("v").first()
    if head is None:
        return spark.createDataFrame([], "a long, b long, cosine double")
    n, dim = vecs.count(), len(head[0]) // 2
    width = min(dim, max(1, int(np.ceil(np.log2(max(2, n / CELL))))))
    rng = np.random.default_rng(SEED + 1)
    left, parts, done = vecs, [], []
    while left is not None:
        chosen = [np.sort(rng.permutation(dim)[:width]) for _ in range(samplings(width, threshold))]
        rows = settle(left.mapInArrow(_spread(dim, width, chosen), "t int, cell long, id long, code binary, f float, q binary"))
        wider = min(dim, WIDEST, width + MORE)
        crowded = settle(rows.groupBy("t", "cell").count().where(F.col("count") > CROWD).select("t", "cell")) if wider > width else None
        open_, rest = rows, None
        if crowded is not None and not crowded.isEmpty():
            open_ = rows.join(crowded, ["t", "cell"], "left_anti")
            rest = settle(vecs.join(rows.join(crowded, ["t", "cell"], "left_semi").select("id").distinct(), "id", "left_semi"))
        found = open_.select("t", "cell", "id", "code", "f", "q").repartition("t", "cell").sortWithinPartitions("t", "cell", "id").mapInArrow(_scan(dim, threshold), "a long, b long").distinct()
        parts.append(settle(found))
        for old in (rows, crowded, left if left is not vecs else None):
            unsettle(old)
        left, width = rest, wider
    pairs = parts[0]
    for more in parts[1:]:
        pairs = pairs.union(more)
    if len(parts) > 1:
        pairs = pairs.distinct()
    told = pairs.join(vecs.select(F.col("id").alias("a"), F.col("v").alias("x")), "a").join(vecs.select(F.col("id").alias("b"), F.col("v").alias("y")), "b")
    out = settle(told.select("a", "b", "x", "y").mapInArrow(_exact, "a long, b long, cosine double").where(F.col("cosine") >= threshold))
    for old in parts:
        unsettle(old)
    return out


def similar_pairs(df: DataFrame, threshold: float = THRESHOLD, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """(a, b, cosine) with a < b for the pairs of different vectors whose cosine reaches the threshold; of equal vectors the least id stands for all.

    Vectors that unit_codes() leaves out pair with nothing; rows that share an id count once; other columns are ignored;
    an empty table gives no pairs. The number of code bits that a sampling takes grows with the logarithm of the
    number of vectors, so cells keep their size, and the number of samplings with the bits, so a pair at the threshold is
    missed with a chance of at most MISS at any size. Cells of more than CROWD vectors aren't compared, but all their
    vectors go to a next round with MORE bits and samplings, until none is crowded or WIDEST bits are reached, when
    cells are compared whole. There is no cap on a cell or on partners.
    """
    members = _classes(df, id_col, vec_col)
    return _class_pairs(members.where("id = class").select("id", "v"), threshold)


def similar_counts(df: DataFrame, threshold: float = THRESHOLD, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """(vec_id, class_id, links) for each comparable vector: the least id of those equal to it, and with how many other classes its cosine reaches the threshold. See similar_pairs()."""
    members = _classes(df, id_col, vec_col)
    pairs = _class_pairs(members.where("id = class").select("id", "v"), threshold)
    links = pairs.select(F.explode(F.array("a", "b")).alias("class")).groupBy("class").agg(F.count("*").alias("links"))
    return members.join(links, "class", "left").select(F.col("id").alias("vec_id"), F.col("class").alias("class_id"), F.coalesce("links", F.lit(0)).cast("long").alias("links"))


def drop_similar(df: DataFrame, threshold: float = THRESHOLD, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """The rows with all their columns, one id of each group of linked or equal vectors: the least.

    Rows without a usable vector or id stay, and so do all rows of a kept id; an empty table gives none.
    """
    members = _classes(df, id_col, vec_col)
    pairs = _class_pairs(members.where("id = class").select("id", "v"), threshold)
    links = pairs.select("a", "b").union(members.where("id <> class").select("class", "id"))
    gone = components(links).where("id <> root").select(F.col("id").alias("_gone")).distinct()
    return df.join(gone, df[f"`{id_col}`"] == gone["_gone"], "left_anti")
