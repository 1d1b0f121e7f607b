"""Toxicity: a factorisation machine over hashed terms.

score = sigmoid(b + sum w_i x_i + sum_{i<j} <v_i, v_j> x_i x_j), x_i being 1 where the term occurs. The
pairwise part, computed as half of (sum v x)^2 - sum (v x)^2, learns combinations that single weights miss.
Terms get weights and factors if a chi-squared test ties them to the label, alone, or if a pair of them is: in the texts
that no single term explains, it is toxic far more often than the more toxic of its two terms, or far less often
than the less toxic one. Terms that no test ties only teach a machine its training rows by heart.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import chunks, lean, normal_words, owners, pick, plain, release, sample_labels, spread
from .quality import pack_model, unpack_model

SAMPLE, BUCKETS, FACTORS, EPOCHS = 20_000, 1 << 26, 8, 15
CHI2, LEAST_DOCS, STEPS = 15.0, 5, 1500
#: Evidence that a pair needs, in nats (of some ten million pairs by chance none has as much), texts that it needs, and the rate from which a term alone explains a text.
EVIDENCE, LEAST_PAIR, STRONG, TILE = 20.0, 8, 0.5, 2048


def doc_terms(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(rows, buckets): the distinct hashed terms of each text."""
    h, offs = normal_words(texts)
    both = np.unique(owners(offs).astype(np.int64) * BUCKETS + (h % np.uint64(BUCKETS)).astype(np.int64))
    return both // BUCKETS, both % BUCKETS


def forward(model: dict[str, np.ndarray], rows: np.ndarray, slots: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """(logits, sums of factors) of n texts whose known terms are (rows, slots)."""
    v = model["v"]
    s = np.zeros((n, v.shape[1]))
    sq = np.zeros(n)
    for f in range(v.shape[1]):
        x = v[slots, f]
        s[:, f] = np.bincount(rows, x, n)
        sq += np.bincount(rows, x * x, n)
    return model["b"][0] + np.bincount(rows, model["w"][slots], n) + 0.5 * ((s * s).sum(1) - sq), s


def fit(rows: np.ndarray, terms: np.ndarray, y: np.ndarray, epochs: int = EPOCHS) -> dict[str, np.ndarray]:
    """Train on four fifths of the rows, taken at random; the cut between the classes is the best one for the last fifth.

    At least STEPS mini-batches are taken. Where no term is tied to the label, the cut is out of reach.
    """
    n = len(y)
    place = np.random.default_rng(5).permutation(n)
    order = np.argsort(place[rows], kind="stable")
    rows, terms, y = place[rows][order], terms[order], y[np.argsort(place)]
    head = n - n // 5
    at = int(np.searchsorted(rows, head))
    model = descend(rows[:at], terms[:at], y[:head], epochs)
    model["cut"] = np.array([0.5 if len(model["keys"]) else 2.0])
    z, held = logits(model, rows[at:] - head, terms[at:], n - head), y[head:]
    if len(model["keys"]) and 0 < held.sum() < len(held):
        order = np.argsort(z, kind="stable")
        z, held = z[order], held[order]
        hit = held.sum() - np.concatenate([[0], np.cumsum(held)])  # toxic ones at or above place i
        f1 = 2 * hit / (np.arange(len(z), -1, -1) + held.sum())
        edge = np.concatenate([[True], z[1:] > z[:-1], [True]])
        i = int(np.argmax(np.where(edge, f1, -1)))
        mid = 0.75 * z[i - 1] + 0.25 * z[i] if 0 < i < len(z) else (z[0] - 1 if i == 0 else z[-1] + 1)
        model["cut"] = np.array([1 / (1 + np.exp(-np.clip(mid, -30, 30)))])
    return model


def _evidence(n: np.ndarray, a: np.ndarray, rate: np.ndarray) -> np.ndarray:
    """n times the divergence of a / n from the rate."""
    p, r = a / n, np.clip(rate, 1e-6, 1 - 1e-6)
    return n * (np.where(p > 0, p * np.log(np.maximum(p, 1e-12) / r), 0) + np.where(p < 1, (1 - p) * np.log(np.maximum(1 - p, 1e-12) / (1 - r)), 0))


def _together(x: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(i, j, texts) for the pairs i < j of columns of a 0/1 matrix that share at least `least` rows; tile by tile."""
    out = []
    for i in range(0, x.shape[1], TILE):
        left = x[:, i : i + TILE].astype(np.float32)
        for j in range(i, x.shape[1], TILE):
            c = left.T @ x[:, j : j + TILE].astype(np.float32)
            p, q = np.nonzero(c >= max(least, 1))
            keep = q + j > p + i
            out.append((p[keep] + i, q[keep] + j, c[p[keep], q[keep]]))
    return tuple(np.concatenate(z) for z in zip(*out)) if out else (np.zeros(0, int), np.zeros(0, int), np.zeros(0, np.float32))


def tied_pairs(rows: np.ndarray, slots: np.ndarray, y: np.ndarray) -> list[tuple[int, int, int]]:
    """(slot, slot, 1 or -1) of pairs of terms that are toxic more, or less, often than either alone tells."""
    n, m = len(y), int(slots.max()) + 1 if len(slots) else 0
    df, hits = np.bincount(slots, minlength=m), np.bincount(slots, y[rows], m)
    if not 0 < y.sum() < n:
        return []
    rate = hits / np.maximum(df, 1)
    # rarer together than this, a pair of two terms can't be told to be harmless
    often = EVIDENCE / -np.log1p(-y.mean())
    up, down = np.flatnonzero(hits >= LEAST_PAIR), np.flatnonzero(df.astype(float) ** 2 / n >= often)
    use = np.union1d(up, down)
    at = np.full(m, -1)
    at[use] = np.arange(len(use))
    keep = at[slots] >= 0
    x = np.zeros((n, len(use)), bool)
    x[rows[keep], at[slots[keep]]] = True
    bits, toxic = np.packbits(x.T, axis=1), np.packbits(y > 0)
    rate, found = rate[use], []

    def test(i: np.ndarray, j: np.ndarray, sign: int) -> None:
        for k in range(0, len(i), 4096):
            p, q = i[k : k + 4096], j[k : k + 4096]
            both = bits[p] & bits[q]
            c, a = np.bitwise_count(both).sum(1), np.bitwise_count(both & toxic).sum(1)
            alone = np.maximum(rate[p], rate[q]) if sign > 0 else np.minimum(rate[p], rate[q])
            good = ((a / c - alone) * sign > 0) & (_evidence(c, a, alone) >= EVIDENCE)
            found.extend((int(use[u]), int(use[v]), sign) for u, v in zip(p[good], q[good]))

    mine = at[up]
    i, j, a = _together(x[y > 0][:, mine], LEAST_PAIR)
    i, j = mine[i], mine[j]
    able = a * -np.log(np.clip(np.maximum(rate[i], rate[j]), 1e-6, 1 - 1e-6)) >= EVIDENCE  # even if it were always toxic
    test(i[able], j[able], 1)
    mine = at[down]
    i, j, _ = _together(x[:, mine], int(often))
    test(mine[i], mine[j], -1)
    return found


def descend(rows: np.ndarray, terms: np.ndarray, y: np.ndarray, epochs: int) -> dict[str, np.ndarray]:
    """AdaGrad over (row, bucket) pairs in a fixed order of mini-batches."""
    n, pos = len(y), float(y.sum())
    known, inv = np.unique(terms, return_inverse=True)
    df, a = np.bincount(inv, minlength=len(known)), np.bincount(inv, y[rows], len(known))
    b = df - a
    c, d = pos - a, (n - pos) - b
    chi2 = n * (a * d - b * c) ** 2 / np.maximum((a + b) * (c + d) * (a + c) * (b + d), 1e-9)
    tied = (df >= LEAST_DOCS) & (chi2 >= CHI2)
    # pairs are looked for in what no single term explains
    plain_ = np.ones(n, bool)
    plain_[rows[(tied & (a > STRONG * df))[inv]]] = False
    new, left = np.cumsum(plain_) - 1, plain_[rows] & (df >= LEAST_DOCS)[inv]
    pairs = tied_pairs(new[rows[left]], inv[left], y[plain_])
    tied[[t for p in pairs for t in p[:2]]] = True
    good = np.flatnonzero(tied)
    slot = np.full(len(known), -1)
    slot[good] = np.arange(len(good))
    keep = slot[inv] >= 0
    rows, slots = rows[keep], slot[inv][keep]
    rng = np.random.default_rng(11)
    model = {"keys": known[good], "w": np.zeros(len(good)), "v": rng.normal(0, 0.05, (len(good), FACTORS)), "b": np.array([np.log((pos + 1) / (n - pos + 1))])}
    for k, (i, j, sign) in enumerate(pairs):  # begin with what the tests say
        model["v"][slot[i], k % FACTORS] += 0.3
        model["v"][slot[j], k % FACTORS] += 0.3 * sign
    if not n or not len(good):
        return model
    first = np.searchsorted(rows, np.arange(n + 1))
    gw, gv, gb = np.full(len(good), 1e-6), np.full((len(good), FACTORS), 1e-6), 1e-6
    weight = np.where(y > 0, max(1.0, (n - pos) / max(pos, 1) / 2), 1.0)
    for _ in range(max(epochs, -(-STEPS * 256 // n))):
        order = rng.permutation(n)
        for k in range(0, n, 256):
            batch = order[k : k + 256]
            at = np.concatenate([np.arange(first[i], first[i + 1]) for i in batch])
            r, t = np.repeat(np.arange(len(batch)), first[batch + 1] - first[batch]), slots[at]
            z, s = forward(model, r, t, len(batch))
            g = weight[batch] * (1 / (1 + np.exp(-np.clip(z, -30, 30))) - y[batch])
            m = len(batch)
            dw = np.bincount(t, g[r], len(good)) / m + 1e-4 * model["w"]
            gw += dw * dw
            model["w"] -= 0.5 * dw / np.sqrt(gw)
            for f in range(FACTORS):
                vt = model["v"][t, f]
                dv = np.bincount(t, g[r] * (s[r, f] - vt), len(good)) / m + 1e-3 * model["v"][:, f]
                gv[:, f] += dv * dv
                model["v"][:, f] -= 0.05 * dv / np.sqrt(gv[:, f])
            db = g.mean()
            gb += db * db
            model["b"] -= 0.1 * db / np.sqrt(gb)
    return model


def logits(model: dict[str, np.ndarray], rows: np.ndarray, terms: np.ndarray, n: int) -> np.ndarray:
    keys = model["keys"]
    if len(keys):
        slots = np.minimum(np.searchsorted(keys, terms), len(keys) - 1)
        hit = keys[slots] == terms
        rows, slots = rows[hit], slots[hit]
    else:
        rows = slots = np.zeros(0, np.int64)
    return forward(model, rows, slots, n)[0]


def predict(model: dict[str, np.ndarray], texts: pa.Array) -> np.ndarray:
    """Probability for each text."""
    rows, terms = doc_terms(texts)
    return 1 / (1 + np.exp(-np.clip(logits(model, rows, terms, len(texts)), -30, 30)))


def train(docs: DataFrame, labels: DataFrame, label: str = "toxic", most: int = SAMPLE, id_col: str = "doc_id", text_col: str = "text") -> bytes:
    """A model of at most `most` labelled ids (a bounded sample, spread by hash), fitted in one task."""
    ids = F.broadcast(sample_labels(labels, label, most, docs, id_col))
    src = spread(pick(docs, id=id_col, text=text_col)).withColumn("id", F.col("id").cast("long")).join(ids, "id")

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = plain(batch.column(1))
            for i, j in chunks(texts):
                r, t = doc_terms(texts.slice(i, j - i))
                at = np.searchsorted(r, np.arange(j - i + 1))
                cells = [t[a:b].astype(np.int32).tobytes() for a, b in zip(at[:-1], at[1:])]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, j - i), pa.array(cells, pa.binary()), batch.column(2).slice(i, j - i)], ["id", "x", "y"])

    def learn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = sorted(r for b in batches for r in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2).to_pylist()))[:most]
        terms = [np.frombuffer(r[1], np.int32) for r in seen]
        own = np.repeat(np.arange(len(seen)), [len(t) for t in terms])
        model = fit(own, np.concatenate(terms) if terms else np.zeros(0, np.int32), np.array([r[2] for r in seen], float))
        yield pa.RecordBatch.from_arrays([pa.array([pack_model(model)], pa.binary())], ["model"])

    got = src.mapInArrow(lean(rows), "id long, x binary, y int").repartition(1).mapInArrow(lean(learn), "model binary").collect()
    return got[0][0] if got else pack_model(fit(np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)))


def scorer(model_broadcast):
    """Column function: probability that the text column is toxic."""

    @F.arrow_udf(T.DoubleType())
    def score(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        model = unpack_model(model_broadcast.value)
        for arr in batches:
            texts = plain(arr)
            out = [predict(model, texts.slice(i, j - i)) for i, j in chunks(texts)]
            yield pa.array(np.concatenate(out) if out else np.zeros(0), pa.float64())
        release()

    return score


def score_toxicity(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", most: int = SAMPLE) -> DataFrame:
    """(doc_id, score, toxic) for every document; toxic where the score reaches the cut found in training.

    Null, empty and wordless texts have the score of a text without known terms. With no labels, or labels
    of one class, nothing is toxic. Repeated rows give repeated results, equal texts equal scores; null ids stay. Texts are
    read whole, however long; other columns are ignored; an empty table gives no rows.
    """
    blob = train(docs, labels, most=most, id_col=id_col, text_col=text_col)
    model, cut = docs.sparkSession.sparkContext.broadcast(blob), float(unpack_model(blob)["cut"][0])
    scored = spread(pick(docs, doc_id=id_col, text=text_col)).select("doc_id", scorer(model)("text").alias("score"))
    return scored.select("doc_id", "score", (F.col("score") >= cut).alias("toxic"))


def drop_toxic(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", most: int = SAMPLE) -> DataFrame:
    """The documents with all their columns, whatever their names, that score_toxicity() doesn't call toxic; its rules for nulls and empties hold."""
    blob = train(docs, labels, most=most, id_col=id_col, text_col=text_col)
    model, cut = docs.sparkSession.sparkContext.broadcast(blob), float(unpack_model(blob)["cut"][0])
    docs = spread(docs)
    return docs.where(scorer(model)(docs[f"`{text_col}`"].cast("string")) < cut)
