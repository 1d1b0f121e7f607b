"""Quality classifier: labelled documents vote by latent-semantic similarity.

Documents become tf-idf vectors over hashed words and word shapes. A randomised singular value
decomposition of a bounded labelled sample gives latent dimensions; the sample's latent vectors and labels
are broadcast (their size is bounded by the sample), and every document is compared with all of them in
blocked cosine products. Its K nearest labelled documents vote, weighted by similarity.
"""

from __future__ import annotations

import io
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import PUNCT, chunks, hash_strings, lean, mix, pick, plain, release, sample_labels, split_words, spread, string_parts

SAMPLE, FEATURES, RANK, NEAREST, ROWS = 4096, 4096, 64, 15, 256
MODEL_SCHEMA = "model binary"
_IS_PUNCT = np.zeros(256, bool)
_IS_PUNCT[[ord(c) for c in PUNCT if ord(c) < 128]] = True


def features(texts: pa.Array) -> np.ndarray:
    """float32 counts, texts x FEATURES: words in the upper half; in the lower half shapes: case, ending, length, repetition."""
    words, offs = split_words(texts)
    rows = len(texts)
    n = len(words)
    out = np.zeros((rows, FEATURES), np.float32)
    if not n:
        return out
    own = np.repeat(np.arange(rows), np.diff(offs))
    half = FEATURES // 2
    h = hash_strings(pc.utf8_trim(pc.utf8_lower(words), characters=PUNCT))
    data, at = string_parts(words)
    size = np.diff(at)
    end1, end2 = (data[k].astype(np.int64) for k in (at[1:] - 1, np.maximum(at[1:] - 2, at[:-1])))
    end = np.where(_IS_PUNCT[end1], end1 + 256 * np.where(_IS_PUNCT[end2] & (size > 1), end2, 0), 0)
    case = np.asarray(pc.utf8_is_upper(words)).astype(np.int64) * 2 + np.asarray(pc.utf8_is_title(words))
    case = np.where((case >= 2) & (size < 2), 1, case)
    same = np.zeros(n, np.int64)
    same[1:] = (h[1:] == h[:-1]) & (own[1:] == own[:-1])
    shape = mix(((end * 4 + case) * 2 + same).astype(np.uint64))
    long_ = mix((np.minimum(size, 40) // 4 + 1_000_003).astype(np.uint64))
    for half_at, f in ((half, h), (0, shape), (0, long_)):
        col = (f % np.uint64(half)).astype(np.int64) + half_at
        out += np.bincount(own * FEATURES + col, minlength=rows * FEATURES).reshape(rows, FEATURES)
    return out


def weigh(x: np.ndarray, idf: np.ndarray) -> np.ndarray:
    x = np.log1p(x) * idf
    return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-9)


def fit(x: np.ndarray, y: np.ndarray, rank: int = RANK) -> dict[str, np.ndarray]:
    """Latent model of a labelled sample. Rows come in a fixed order, so the model is the same on each run."""
    df = (x > 0).sum(0)
    idf = (np.log((1 + len(x)) / (1 + df)) + 0.3).astype(np.float32)
    w = weigh(x, idf)
    rank = max(1, min(rank, *w.shape)) if len(w) else 1
    rng = np.random.default_rng(7)
    q = rng.standard_normal((w.shape[0], min(rank + 16, len(w)))).astype(np.float32) if len(w) else np.zeros((0, 1), np.float32)
    if len(w):
        for _ in range(3):
            q, _ = np.linalg.qr(w @ (w.T @ q))
        _, _, vt = np.linalg.svd(q.T @ w, full_matrices=False)
        axes = np.ascontiguousarray(vt[:rank].T)
    else:
        axes = np.zeros((x.shape[1], 1), np.float32)
    z = w @ axes
    z /= np.maximum(np.linalg.norm(z, axis=1, keepdims=True), 1e-9)
    return {"idf": idf, "axes": axes.astype(np.float32), "z": z.astype(np.float32), "y": y.astype(np.float32)}


def vote(model: dict[str, np.ndarray], x: np.ndarray, nearest: int = NEAREST) -> np.ndarray:
    """Share of the similarity-weighted votes for label 1; 0.5 where nothing votes."""
    z = weigh(x, model["idf"]) @ model["axes"]
    z /= np.maximum(np.linalg.norm(z, axis=1, keepdims=True), 1e-9)
    sim = z @ model["z"].T
    k = min(nearest, sim.shape[1])
    if not k:
        return np.full(len(x), 0.5)
    top = np.argpartition(-sim, k - 1, axis=1)[:, :k]
    w = np.maximum(np.take_along_axis(sim, top, 1), 0).astype(np.float64) ** 2
    total = w.sum(1)
    return np.where(total > 0, (w * model["y"][top]).sum(1) / np.maximum(total, 1e-12), 0.5)


def pack_model(model: dict[str, np.ndarray]) -> bytes:
    buf = io.BytesIO()
    np.savez(buf, **model)
    return buf.getvalue()


def unpack_model(blob: bytes) -> dict[str, np.ndarray]:
    with np.load(io.BytesIO(blob)) as z:
        return {k: z[k] for k in z.files}


def train(docs: DataFrame, labels: DataFrame, label: str = "quality", most: int = SAMPLE, id_col: str = "doc_id", text_col: str = "text") -> bytes:
    """A model of at most `most` labelled ids (a bounded sample, spread by hash). Fitted in one task; the driver gets some MB."""
    ids = F.broadcast(sample_labels(labels, label, most, docs, id_col))
    src = spread(pick(docs, id=id_col, text=text_col)).withColumn("id", F.col("id").cast("long")).join(ids, "id")

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = plain(batch.column(1))
            for i, j in chunks(texts):
                for k in range(i, j, ROWS):
                    m = min(ROWS, j - k)
                    x = np.minimum(features(texts.slice(k, m)), 65535).astype(np.uint16)
                    yield pa.RecordBatch.from_arrays([batch.column(0).slice(k, m), pa.array([r.tobytes() for r in x], pa.binary()), batch.column(2).slice(k, m)], ["id", "x", "y"])

    def learn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = [r for b in batches for r in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2).to_pylist())]
        seen = sorted(seen)[:most]
        x = np.frombuffer(b"".join(r[1] for r in seen), np.uint16).reshape(len(seen), FEATURES).astype(np.float32)
        yield pa.RecordBatch.from_arrays([pa.array([pack_model(fit(x, np.array([r[2] for r in seen])))], pa.binary())], ["model"])

    got = src.mapInArrow(lean(rows), "id long, x binary, y int").repartition(1).mapInArrow(lean(learn), MODEL_SCHEMA).collect()
    return got[0][0] if got else pack_model(fit(np.zeros((0, FEATURES), np.float32), np.zeros(0)))


def scorer(model_broadcast, nearest: int = NEAREST):
    """Column function: share of votes for the text column."""

    @F.arrow_udf(T.DoubleType())
    def score(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        model = unpack_model(model_broadcast.value)
        for arr in batches:
            texts, out = plain(arr), []
            for i, j in chunks(texts):
                for k in range(i, j, ROWS):
                    out.append(vote(model, features(texts.slice(k, min(ROWS, j - k))), nearest))
            yield pa.array(np.concatenate(out) if out else np.zeros(0), pa.float64())
        release()

    return score


def score_quality(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", most: int = SAMPLE) -> DataFrame:
    """(doc_id, score, good) for every document; good where score >= 0.5.

    Null, empty and wordless texts resemble nothing: score 0.5, good. With no labels every document is such.
    Repeated rows give repeated results; null ids stay; nulls in the labels are ignored. Texts are read whole, in
    blocks of rows; a very long one is a block of its own. Of labelled neighbours of equal similarity at the edge of
    the NEAREST any may vote, always the same for a model. Other columns are ignored; an empty table gives no rows.
    """
    model = docs.sparkSession.sparkContext.broadcast(train(docs, labels, most=most, id_col=id_col, text_col=text_col))
    scored = spread(pick(docs, doc_id=id_col, text=text_col)).select("doc_id", scorer(model)("text").alias("score"))
    return scored.select("doc_id", "score", (F.col("score") >= 0.5).alias("good"))


def keep_quality(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", most: int = SAMPLE) -> DataFrame:
    """The documents with all their columns, whatever their names, that score_quality() calls good; its rules for nulls, ties and empties hold."""
    model = docs.sparkSession.sparkContext.broadcast(train(docs, labels, most=most, id_col=id_col, text_col=text_col))
    docs = spread(docs)
    return docs.where(scorer(model)(docs[f"`{text_col}`"].cast("string")) >= 0.5)
