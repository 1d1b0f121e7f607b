"""Token ids as compressed binary blocks: an adaptive context-mixing range coder.

A block holds a fixed number of ids of a partition's stream of documents and is coded alone: its model
starts afresh, and it carries checksums. The block's ids lie in lanes, consecutive stretches that are
coded in step, so every operation is one numpy call over all lanes. Three predictors are mixed:

* order 2: counts of the ids that followed the last two ids (12 bits of the earlier one);
* order 1: counts of the ids that followed the last id;
* order 0: adaptive counts of all ids.

Orders 2 and 1 are interpolated over the ids that followed the last id; an escape leads to order 0. Weight and
escape are learned for each class of contexts (how often seen, how varied) from how well they did. Counts are kept
as sorted (context, id) keys with running sums, so that an id's interval is two binary searches. They and the weights change
after each group of steps, the groups growing with what is known, the same way in encoder and decoder; all sums are
of integers, so both get the same numbers on any machine. A carry-less 64-bit range coder codes the intervals.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from .bpe_ids import RANKS, ids_of, load_ranks
from .common import chunks, pick, plain, spread

MAGIC = b"TWB2"
HEAD = struct.Struct("<4sIIIII")  # magic, ids, vocabulary, lanes, checksum of the ids, checksum of the payload
BLOCK, LANES = 1 << 20, 1024
#: Bits of an id in a key, and of the id before the last.
ID_BITS, HASH_BITS = 20, 12
MASS, MOST = 1 << 18, 1 << 20  # units of an interval; largest sum of order-0 counts
TOP, BOT = np.uint64(1 << 48), np.uint64(1 << 40)
U16, U40, U48 = np.uint64(16), np.uint64(40), np.uint64(48)


class Counts:
    """Counts of (context, id) as sorted keys, the last one a sentinel, with running sums."""

    def __init__(self):
        self.keys, self.n = np.full(1, np.iinfo(np.int64).max), np.zeros(1, np.int32)
        self._sum()

    def _sum(self) -> None:
        self.cum = np.zeros(len(self.n) + 1, np.int32)
        np.cumsum(self.n, out=self.cum[1:])

    def add(self, keys: np.ndarray, n: np.ndarray, pos: np.ndarray | None = None, known: np.ndarray | None = None) -> None:
        """keys: sorted and distinct; pos, known: their find(), where it is known."""
        if pos is None:
            pos, known = self.find(keys)
        self.n[pos[known]] += n[known].astype(np.int32)
        fresh = np.flatnonzero(~known)
        if len(fresh):
            to = pos[fresh] + np.arange(len(fresh))
            old = np.ones(len(self.keys) + len(fresh), bool)
            old[to] = False
            both, sums = np.empty(len(old), np.int64), np.empty(len(old), np.int32)
            both[to], both[old], sums[to], sums[old] = keys[fresh], self.keys, n[fresh], self.n
            self.keys, self.n = both, sums
        self._sum()

    def find(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(place, whether it holds the key)."""
        pos = np.searchsorted(self.keys, keys)
        return pos, self.keys[pos] == keys


def _log2(n: np.ndarray) -> np.ndarray:
    """Bits of a count, 0 to 15."""
    return np.minimum(np.frexp(n.astype(np.float32))[1], 15)


def _runs(sorted_keys: np.ndarray) -> np.ndarray:
    """Where each run of equal keys begins, and the end."""
    if not len(sorted_keys):
        return np.zeros(1, np.int64)
    return np.concatenate([[0], np.flatnonzero(sorted_keys[1:] != sorted_keys[:-1]) + 1, [len(sorted_keys)]])


def grouped(keys: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(sorted distinct keys, sums of n, the place of each key among them)."""
    order = np.argsort(keys)
    sorted_ = keys[order]
    runs = _runs(sorted_)
    where = np.empty(len(keys), np.int32)
    where[order] = np.repeat(np.arange(len(runs) - 1, dtype=np.int32), np.diff(runs))
    return sorted_[runs[:-1]], np.add.reduceat(n[order], runs[:-1]) if len(keys) else n, where


def context_of(p1: np.ndarray, p2: np.ndarray) -> np.ndarray:
    """The last id and 12 bits of the one before."""
    return p1.astype(np.int64) << HASH_BITS | ((p2.astype(np.int64) * 0x9E3779B1) >> 15) & ((1 << HASH_BITS) - 1)


class Model:
    def __init__(self, vocab: int):
        if vocab > 1 << ID_BITS:
            raise ValueError("the vocabulary is too large")
        self.vocab = vocab
        self.count = np.ones(vocab, np.int64)
        self.one, self.two = Counts(), Counts()
        grade = np.arange(64) % 4
        # for each class of contexts: escapes and visits, trust in order 2 and visits; 1/65536ths
        self.escaped, self.seen = (grade + 1) * 6554.0 + 1.0, np.full(64, 65536.0) * 2
        self.trust, self.asked = (4 - grade) * 13107.0, np.full(64, 65536.0)
        self._sum()

    def _sum(self) -> None:
        while self.count.sum() > MOST - 64 and self.count.max() > 1:
            self.count = (self.count + 1) >> 1
        self.base = np.concatenate([[0], np.cumsum(self.count)])
        self.total = int(self.base[-1])
        self.at = np.concatenate([[0], np.cumsum(np.bincount(self.one.keys[:-1] >> ID_BITS, minlength=self.vocab))])
        self.esc = np.clip(self.escaped / self.seen, 1 / 4096, 0.98)
        self.mix = np.clip(self.trust / self.asked, 0.01, 0.995)

    def contexts(self, c2: np.ndarray) -> tuple:
        """What the contexts tell before the next id is known: (first place, counts before and in all, ids) of order 1, (counts before and in all) of order 2, classes, mass of the escape, of order 2 and of order 1."""
        p1 = c2 >> HASH_BITS
        s1, e1 = self.at[p1], self.at[p1 + 1]
        b1 = self.one.cum[s1]
        t1, d1 = self.one.cum[e1] - b1, e1 - s1
        t1 = np.where(d1 > MASS // 4, 0, t1)  # too many to tell apart: order 0 alone
        d1 = np.where(t1 > 0, d1, 0)
        s2, e2 = np.searchsorted(self.two.keys, c2 << ID_BITS), np.searchsorted(self.two.keys, (c2 + 1) << ID_BITS)
        b2 = self.two.cum[s2]
        t2 = self.two.cum[e2] - b2
        k1 = _log2(t1) * 4 + np.minimum(4 * d1 // np.maximum(t1, 1), 3)
        k2 = _log2(t2) * 4 + np.minimum(4 * (e2 - s2) // np.maximum(t2, 1), 3)
        esc = np.where(t1 > 0, (self.esc[k1] * (MASS - d1)).astype(np.int64) + 1, MASS)
        rest = np.maximum(MASS - esc - d1, 0)
        a2 = np.where(t2 > 0, (rest * self.mix[k2]).astype(np.int64), 0)
        return s1, b1, t1, d1, b2, t2, k1, k2, esc, a2, rest - a2

    def interval(self, seen: tuple, pos1: np.ndarray, pos2: np.ndarray, hit2: np.ndarray) -> tuple:
        """(begin, parts of orders 2 and 1, size) of the ids at places pos1 of order 1 and, where hit2, pos2 of order 2."""
        s1, b1, t1, _, b2, t2, _, _, _, a2, a1 = seen
        t1, t2 = np.maximum(t1, 1), np.maximum(t2, 1)
        l1, l2 = self.one.cum[pos1] - b1, self.two.cum[pos2] - b2
        n1, n2 = self.one.n[pos1], self.two.n[pos2] * hit2
        q2, q1 = a2 * l2 // t2, a1 * l1 // t1
        f2, f1 = a2 * (l2 + n2) // t2 - q2, a1 * (l1 + n1) // t1 - q1
        return q2 + q1 + pos1 - s1, f2, f1, f2 + f1 + 1

    def learn(self, seen: tuple, keys: np.ndarray, n: np.ndarray, known: np.ndarray, f1: np.ndarray, f2: np.ndarray, found: tuple = (), one: tuple | None = None) -> None:
        """keys: sorted distinct (context, id) of order 2 with how often each came, n; the others in their order. found and one: what find() and grouped() say, where it is known."""
        t1, t2, k1, k2 = seen[2], seen[5], seen[6], seen[7]
        told = t1 > 0
        w = n * 65536.0
        self.seen = self.seen * 0.9 + np.bincount(k1[told], w[told], 64)
        lost = told & ~known
        self.escaped = self.escaped * 0.9 + np.bincount(k1[lost], w[lost], 64)
        use = known & (t2 > 0)
        share = n[use] * ((65536 * f2[use]) // np.maximum(f2[use] + f1[use], 1))
        self.asked = self.asked * 0.9 + np.bincount(k2[use], w[use], 64)
        self.trust = self.trust * 0.9 + np.bincount(k2[use], share, 64)
        x = keys & ((1 << ID_BITS) - 1)
        self.two.add(keys, n, *found)
        self.one.add(*(one or grouped(keys >> ID_BITS + HASH_BITS << ID_BITS | x, n)[:2]))
        self.count += 24 * np.bincount(x, n, self.vocab).astype(np.int64)
        self._sum()


def _layout(n: int, lanes: int) -> tuple[int, np.ndarray, np.ndarray]:
    lanes = max(1, min(lanes, n // 256 or 1))
    lens = n // lanes + (np.arange(lanes) < n % lanes)
    return lanes, lens, np.cumsum(lens) - lens


def _groups(steps: int) -> Iterator[tuple[int, int]]:
    t = 0
    while t < steps:
        end = min(steps, t + max(1, t // 6))
        yield t, end
        t = end


def encode_block(ids: np.ndarray, vocab: int, lanes: int = LANES) -> bytes:
    ids = np.ascontiguousarray(ids, np.int32)
    n = len(ids)
    lanes, lens, first = _layout(n, lanes)
    model, steps = Model(vocab), int(lens.max()) if n else 0
    low, rng = np.zeros(lanes, np.uint64), np.full(lanes, (1 << 64) - 1, np.uint64)
    words, pos = np.zeros((4 * steps + 8, lanes), np.uint16), np.zeros(lanes, np.int64)
    lane = np.arange(lanes)
    p1, p2 = np.zeros(lanes, np.int32), np.zeros(lanes, np.int32)
    for t, end in _groups(steps):
        ks = [int((lens > t + k).sum()) for k in range(end - t)]
        xs = [ids[first[:m] + t + k] for k, m in enumerate(ks)]
        prev1 = [p1[: ks[0]], *[x[:m] for x, m in zip(xs, ks[1:])]]
        prev2 = [p2[: ks[0]], *[x[:m] for x, m in zip(prev1, ks[1:])]]
        x, q1, q2 = np.concatenate(xs), np.concatenate(prev1), np.concatenate(prev2)
        key = context_of(q1, q2) << ID_BITS | x
        order = np.argsort(key)
        key = key[order]
        runs = _runs(key)
        key, times = key[runs[:-1]], np.diff(runs)
        # all that follows is the same for equal keys
        ctx = key >> ID_BITS
        by = _runs(ctx)
        whose = np.repeat(np.arange(len(by) - 1), np.diff(by))
        seen = tuple(z.take(whose) for z in model.contexts(ctx[by[:-1]]))
        y = key & ((1 << ID_BITS) - 1)
        one = grouped(key >> ID_BITS + HASH_BITS << ID_BITS | y, times)
        at1, hit1 = model.one.find(one[0])
        pos1, known = at1[one[2]], hit1[one[2]] & (seen[2] > 0)
        pos2, hit2 = model.two.find(key)
        begin, f2, f1, size = model.interval(seen, pos1, pos2, hit2)
        esc = seen[8]
        f = np.where(known, size * model.total, model.count[y] * esc)
        c = np.where(known, begin * model.total, (MASS - esc) * model.total + model.base[y] * esc)
        own = np.empty(len(x), np.int64)
        own[order] = np.repeat(np.arange(len(key)), times)
        f, c = f.astype(np.uint64).take(own), c.astype(np.uint64).take(own)
        whole, at = np.uint64(MASS * model.total), 0
        for m in ks:
            lo, rg = low[:m], rng[:m]
            r = rg // whole
            lo += c[at : at + m] * r
            np.multiply(f[at : at + m], r, out=rg)
            at += m
            go = np.flatnonzero(((lo ^ (lo + rg)) < TOP) | (rg < BOT))
            while len(go):
                v, w = lo[go], rg[go]
                tight = np.flatnonzero((v ^ (v + w)) >= TOP)
                if len(tight):
                    w[tight] = (np.uint64(0) - v[tight]) & (BOT - np.uint64(1))
                words[pos[go], go] = v >> U48
                pos[go] += 1
                v <<= U16
                w <<= U16
                lo[go], rg[go] = v, w
                go = go[((v ^ (v + w)) < TOP) | (w < BOT)]
        model.learn(seen, key, times, known, f1, f2, (pos2, hit2), (*one[:2], at1, hit1))
        m = ks[-1]
        p2[:m] = xs[-2][:m] if len(xs) > 1 else p1[:m]
        p1[:m] = xs[-1]
    tail = ((low >> U40) + np.uint64(1)) << U40  # within the last range, which is wider than BOT
    for _ in range(2):
        words[pos, lane] = tail >> U48
        pos += 1
        tail <<= U16
    payload = pos.astype("<u4").tobytes() + b"".join(words[: pos[j], j].astype("<u2").tobytes() for j in range(lanes))
    return HEAD.pack(MAGIC, n, vocab, lanes, zlib.crc32(ids.astype("<i4").tobytes()), zlib.crc32(payload)) + payload


def decode_block(blob: bytes) -> np.ndarray:
    """The ids of a block; ValueError where a checksum doesn't hold."""
    if len(blob) < HEAD.size:
        raise ValueError("a block is cut short")
    magic, n, vocab, lanes, sum_ids, sum_payload = HEAD.unpack_from(blob)
    payload = blob[HEAD.size :]
    if magic != MAGIC or zlib.crc32(payload) != sum_payload:
        raise ValueError("a block's payload is damaged")
    _, lens, first = _layout(n, lanes)
    size = np.frombuffer(payload, "<u4", lanes).astype(np.int64)
    stream = np.frombuffer(payload, "<u2", offset=4 * lanes).astype(np.uint64)
    stream = np.concatenate([stream, np.zeros(8, np.uint64)])
    pos = np.cumsum(size) - size
    ends = pos + size
    take = lambda at, end: np.where(at < end, stream[np.minimum(at, len(stream) - 1)], np.uint64(0))
    code, low, rng = np.zeros(lanes, np.uint64), np.zeros(lanes, np.uint64), np.full(lanes, (1 << 64) - 1, np.uint64)
    for _ in range(4):
        code = (code << U16) | take(pos, ends)
        pos += 1
    ids, model = np.zeros(n, np.int32), Model(vocab)
    steps = int(lens.max()) if n else 0
    p1, p2 = np.zeros(lanes, np.int32), np.zeros(lanes, np.int32)
    for t, end in _groups(steps):
        kept = []
        total = model.total
        whole = np.uint64(MASS * total)
        for k in range(end - t):
            m = int((lens > t + k).sum())
            ctx = context_of(p1[:m], p2[:m])
            seen = model.contexts(ctx)
            s1, d1, esc = seen[0], seen[3], seen[8]
            lo, rg, cd = low[:m], rng[:m], code[:m]
            r = rg // whole
            v = np.minimum((cd - lo) // r, whole - np.uint64(1)).astype(np.int64)
            known = v < (MASS - esc) * total
            x = np.zeros(m, np.int32)
            f, c = np.zeros(m, np.int64), np.zeros(m, np.int64)
            f1, f2 = np.zeros(m, np.int64), np.zeros(m, np.int64)
            far = np.flatnonzero(~known)
            if len(far):
                x[far] = np.searchsorted(model.base, (v[far] - (MASS - esc[far]) * total) // esc[far], "right") - 1
                f[far] = model.count[x[far]] * esc[far]
                c[far] = (MASS - esc[far]) * total + model.base[x[far]] * esc[far]
            at = np.flatnonzero(known)
            if len(at):
                own = tuple(z[at] for z in seen)
                unit, a, b = v[at] // total, s1[at], s1[at] + d1[at]
                while True:  # the last place that begins at or before the unit
                    if not (b - a > 1).any():
                        break
                    mid = (a + b) >> 1
                    y = model.one.keys[mid] & ((1 << ID_BITS) - 1)
                    le = model.interval(own, mid, *model.two.find(ctx[at] << ID_BITS | y))[0] <= unit
                    a, b = np.where(le, mid, a), np.where(le, b, mid)
                y = model.one.keys[a] & ((1 << ID_BITS) - 1)
                begin, f2[at], f1[at], wide = model.interval(own, a, *model.two.find(ctx[at] << ID_BITS | y))
                x[at], c[at], f[at] = y, begin * total, wide * total
            lo += c.astype(np.uint64) * r
            np.multiply(f.astype(np.uint64), r, out=rg)
            go = np.flatnonzero(((lo ^ (lo + rg)) < TOP) | (rg < BOT))
            while len(go):
                v, w = lo[go], rg[go]
                tight = np.flatnonzero((v ^ (v + w)) >= TOP)
                if len(tight):
                    w[tight] = (np.uint64(0) - v[tight]) & (BOT - np.uint64(1))
                cd[go] = (cd[go] << U16) | take(pos[go], ends[go])
                pos[go] += 1
                v <<= U16
                w <<= U16
                lo[go], rg[go] = v, w
                go = go[((v ^ (v + w)) < TOP) | (w < BOT)]
            ids[first[:m] + t + k] = x
            p2[:m] = p1[:m]
            p1[:m] = x
            kept.append((ctx << ID_BITS | x, known, f1, f2, *seen))
        key, *rest = (np.concatenate(z) for z in zip(*kept))
        order = np.argsort(key)
        runs = _runs(key[order])
        one = order[runs[:-1]]
        known, f1, f2, *seen = (z[one] for z in rest)
        model.learn(tuple(seen), key[one], np.diff(runs), known, f1, f2)
    if zlib.crc32(ids.astype("<i4").tobytes()) != sum_ids:
        raise ValueError("a block's ids are damaged")
    return ids


SCHEMA = T.StructType(
    [
        T.StructField("shard", T.IntegerType()),
        T.StructField("block", T.IntegerType()),
        T.StructField("doc_ids", T.ArrayType(T.LongType())),
        T.StructField("doc_starts", T.ArrayType(T.LongType())),
        T.StructField("doc_lens", T.ArrayType(T.IntegerType())),
        T.StructField("n_tokens", T.IntegerType()),
        T.StructField("payload", T.BinaryType()),
    ]
)


def write_token_blocks(docs: DataFrame, ranks_path: str = RANKS, block: int = BLOCK, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per block of `block` ids (the last of a partition may have fewer).

    Each document's ids end with the end id, so a null or empty text is that id alone; a document goes on
    in the next block where one is full: doc_starts says at which of its ids a piece begins, doc_lens how
    many the block has. Repeated rows are stored again; a null id stays a null in doc_ids. An empty table
    has no blocks. No shuffle; (shard, block) depend on the input's partitions, the content doesn't.
    """
    ranks = docs.sparkSession.sparkContext.broadcast(load_ranks(ranks_path))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, shard, number = ids_of(ranks.value), TaskContext.get().partitionId(), 0
        held: list[np.ndarray] = []
        who: list[tuple] = []
        have = 0

        def emit() -> pa.RecordBatch:
            nonlocal number, have
            ids = np.concatenate(held)
            row = [shard, number, [w[0] for w in who], [w[1] for w in who], [w[2] for w in who], len(ids), encode_block(ids, enc.size)]
            number += 1
            have = 0
            held.clear()
            who.clear()
            return pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(row, (pa.int32(), pa.int32(), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.list_(pa.int32()), pa.int32(), pa.binary()))], SCHEMA.names)

        for batch in batches:
            texts, names = plain(batch.column(1)), batch.column(0).to_pylist()
            for i, j in chunks(texts, 16 << 20):
                ids, offs = enc.batch(texts.slice(i, j - i))
                for d in range(j - i):
                    own = np.append(ids[offs[d] : offs[d + 1]], np.int32(enc.end))
                    start = 0
                    while start < len(own):
                        take = min(len(own) - start, block - have)
                        held.append(own[start : start + take])
                        who.append((names[i + d], start, take))
                        start += take
                        have += take
                        if have == block:
                            yield emit()
        if have:
            yield emit()

    return spread(pick(docs, doc_id=id_col, text=text_col)).mapInArrow(run, SCHEMA)


def read_token_blocks(blocks: DataFrame) -> DataFrame:
    """(doc_id, start, ids) per piece of a document in a block; a damaged block fails the query."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for names, starts, lens, blob in zip(*[c.to_pylist() for c in batch.columns]):
                ids = decode_block(blob)
                ends = np.concatenate([[0], np.cumsum(lens)])
                yield pa.RecordBatch.from_arrays([pa.array(names, pa.int64()), pa.array(starts, pa.int64()), pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(ids))], ["doc_id", "start", "ids"])

    return blocks.select("doc_ids", "doc_starts", "doc_lens", "payload").mapInArrow(run, "doc_id long, start long, ids array<int>")
