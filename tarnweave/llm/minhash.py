"""MinHash near-duplicates: an LSH forest for what is clearly alike, an exact join for all the rest.

Each document has TREES x DEPTH minima over its word shingles. A tree is the documents in the order of its DEPTH
minima; documents that agree in the first SHALLOW minima are a region, whose pairs are candidates. A region of more
than REGION documents is split at the next minimum, and so on, until its parts are small; parts that are crowded at full
depth are compared along their order, so that those with the longest common prefix meet. One sort of all trees does this. The forest only links what
its minima leave no doubt about (SURE). It spares the join the pairs within large groups; nothing is left to it alone.

The join finds every pair of different groups that reaches the threshold. Shingles have one order, rare ones first. A set
that is similar enough to another shares one of its first shingles with it: so many that the rest are too few. Only these first
shingles meet. Where even they are common (HOT), documents of equal common shingles stand for each other, as far as the
common shingles alone link them (_runs). Candidates are settled by their whole sets.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import BROADCAST_IDS, by_ids, chunks, lean, mix, normal_words, owners, pick, plain, release, settle, spread, unsettle
from .graph import components

TREES, DEPTH, SHALLOW, REGION, BLOCK = 16, 6, 2, 64, 512
WINDOW = 6
#: Rows of an open region that wait for the next batch, at most.
HELD = 16_384
SHINGLE, THRESHOLD = 3, 0.5
PAIRS = "a long, b long, est double"
#: Estimates this far above the threshold are links (six standard errors of 96 minima); all others are left to the join.
SURE = 0.3
#: Shingles of so many texts are common.
HOT = 256
#: Shingles that one step sorts, on average, least number of such buckets, and pairs formed at a time.
POSTINGS, BUCKETS, AT_ONCE = 1_000_000, 32, 2_000_000
_RNG = np.random.default_rng(20240501)
_MUL = _RNG.integers(0, 1 << 32, TREES * DEPTH, np.uint32) | np.uint32(1)
_XOR = _RNG.integers(0, 1 << 32, TREES * DEPTH, np.uint32)


def shingles(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(uint64 hashes, offsets, fingerprints): the word triples of each text, or all its words where it has fewer; the fingerprint follows the order of words."""
    h, offs = normal_words(texts)
    n = len(h)
    lens = np.diff(offs)
    pos = np.arange(n) - np.repeat(offs[:-1], lens)
    left = np.repeat(lens, lens) - pos  # words from here to the end
    with np.errstate(over="ignore"):
        s = h * np.uint64(0x9E3779B97F4A7C15)
        for k in range(1, SHINGLE):
            nxt = np.zeros(n, np.uint64)
            nxt[: n - k] = h[k:]
            nxt[left <= k] = 0
            s = mix(s + nxt)
        prints = np.zeros(len(lens), np.uint64)
        some = lens > 0
        if some.any():
            prints[some] = np.add.reduceat(mix(h + pos.astype(np.uint64) * np.uint64(0xC2B2AE3D27D4EB4F)), offs[:-1][some])
    keep = (left >= SHINGLE) | (pos == 0)
    kept = np.concatenate([[0], np.cumsum(keep)])
    return s[keep], kept[offs], mix(prints + lens.astype(np.uint64))


def signatures(s: np.ndarray, offs: np.ndarray) -> np.ndarray:
    """uint32 minima, one row per text; the texts must have shingles."""
    x = (s >> np.uint64(32)).astype(np.uint32)
    out = np.empty((len(offs) - 1, TREES * DEPTH), np.uint32)
    buf = np.empty_like(x)
    for j in range(TREES * DEPTH):
        np.bitwise_xor(x, _XOR[j], out=buf)
        np.multiply(buf, _MUL[j], out=buf)
        out[:, j] = np.minimum.reduceat(buf, offs[:-1])
    with np.errstate(over="ignore"):
        out ^= out >> np.uint32(16)
        out *= np.uint32(0x7FEB352D)
        return out ^ (out >> np.uint32(15))


def _sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts = plain(batch.column(1))
        for i, j in chunks(texts):
            s, offs, prints = shingles(texts.slice(i, j - i))
            some = np.flatnonzero(np.diff(offs))
            if not len(some):
                continue
            sig = signatures(s, np.append(offs[:-1][some], offs[-1]))
            keys, sketch = (sig >> np.uint32(16)).astype(">u2").tobytes(), sig.astype(np.uint8).tobytes()
            w, v = TREES * DEPTH * 2, TREES * DEPTH
            n = len(some)
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0).slice(i, j - i).take(pa.array(some)),
                    pa.array(prints[some].view(np.int64)),
                    pa.array(np.diff(offs)[some]),
                    pa.Array.from_buffers(pa.binary(w), n, [None, pa.py_buffer(keys)]).cast(pa.binary()),
                    pa.Array.from_buffers(pa.binary(v), n, [None, pa.py_buffer(sketch)]).cast(pa.binary()),
                ],
                ["doc_id", "print", "n", "keys", "sketch"],
            )


def _told(out: list[tuple]) -> pa.RecordBatch:
    a, b, est = (np.concatenate(z) for z in zip(*out))
    return pa.RecordBatch.from_arrays([pa.array(np.minimum(a, b)), pa.array(np.maximum(a, b)), pa.array(est)], ["a", "b", "est"])


def _compare(cell: np.ndarray, doc: np.ndarray, sketch: np.ndarray, floor: float, reach: int) -> Iterator[pa.RecordBatch]:
    """Pairs of one cell, at most `reach` apart in the order, whose estimate reaches the floor."""
    out, held = [], 0
    for o in range(1, reach + 1):
        at = np.flatnonzero(cell[:-o] == cell[o:])
        if not len(at):
            break
        est = (sketch[at] == sketch[at + o]).mean(1)
        good = est >= floor
        out.append((doc[at[good]], doc[at[good] + o], est[good]))
        held += int(good.sum())
        if held > 500_000:
            yield _told(out)
            out, held = [], 0
    if out:
        yield _told(out)


def _scan(floor: float, reach: int):
    """Rows (cell, doc, sketch) come sorted; a batch's last cell, or its last `reach` rows, go on with the next batch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None
        for batch in batches:
            n = batch.num_rows
            if not n:
                continue
            cells = np.asarray(batch.column(0))
            number = np.cumsum(np.concatenate([[True], cells[1:] != cells[:-1]]))
            own = [number, np.asarray(batch.column(1)), np.frombuffer(b"".join(batch.column(2).to_pylist()), np.uint8).reshape(n, TREES * DEPTH)]
            if held is not None:
                own[0] = own[0] + held[0][-1] - (cells[0] == last)
                own = [np.concatenate(z) for z in zip(held, own)]
            last = cells[-1]
            total = len(own[0])
            tail = total - int(np.searchsorted(own[0], own[0][-1]))  # rows of the last cell
            if tail > reach:  # a cell that isn't compared whole
                yield from _compare(*own, floor, reach)
                # the rows kept have met each other already: only pairs with later rows are new, and repeats are harmless
                held = [z[total - reach :] for z in own]
            else:
                yield from _compare(*(z[: total - tail] for z in own), floor, reach)
                held = [z[total - tail :] for z in own]
        if held is not None:
            yield from _compare(*held, floor, reach)

    return run


def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts = plain(batch.column(1))
        for i, j in chunks(texts):
            s, offs, _ = shingles(texts.slice(i, j - i))
            yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, j - i), pa.array([np.unique(s[a:b]).tobytes() for a, b in zip(offs[:-1], offs[1:])], pa.binary())], ["id", "shingles"])


def _firsts(*cols: np.ndarray) -> np.ndarray:
    """True where a row of the sorted columns differs from the one before."""
    out = np.ones(len(cols[0]), bool)
    out[1:] = np.any([c[1:] != c[:-1] for c in cols], axis=0)
    return out


def _leaves(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, pa.RecordBatch]]:
    """From rows (key, doc, sketch) in the order of their keys, piece by piece: rows (cell, doc, sketch) of small parts, each whole, and those crowded at full depth.

    A row's part is the largest of those that share a prefix of at least SHALLOW minima with it and have at most REGION rows. What
    is held for the next batch begins with a part's first row, or is a crowd's last rows; what lies before it only shows that the parts it was
    in are large. A part whose beginning isn't seen is compared whole if what is seen is small: more pairs, never fewer.
    """
    held = None
    for batch in chain(batches, [None]):
        rows = held if batch is None else batch if held is None else pa.concat_batches([held, batch])
        if rows is None or not rows.num_rows:
            continue
        n = rows.num_rows
        key = np.frombuffer(b"".join(rows.column(0).to_pylist()), np.uint8).reshape(n, -1)
        differ = key[1:] != key[:-1]
        same = np.where(differ.any(1), differ.argmax(1), key.shape[1])  # bytes that a row shares with the one before
        cell, starts = np.zeros(n, np.int64), []
        for d in range(DEPTH, SHALLOW - 1, -1):
            new = np.concatenate([[True], same < 1 + 2 * d])
            start = np.maximum.accumulate(np.where(new, np.arange(n), 0))
            small = _ends(new) - start <= REGION
            cell = np.where(small | (d == DEPTH), start, cell)
            if d == DEPTH:
                deep = ~small
            starts.append(int(start[-1]))
        whole = n if batch is None else next((i for i in reversed(starts) if n - i <= HELD), None)
        done, keep = (n, n - WINDOW) if whole is None else (whole, whole)  # a crowd goes on
        cells = pa.RecordBatch.from_arrays([pa.array(cell), rows.column(1), rows.column(2)], ["cell", "doc", "sketch"]).slice(0, done)
        yield cells.filter(pa.array(~deep[:done])), cells.filter(pa.array(deep[:done]))
        held = rows.slice(keep)


def _descend(floor: float):
    """Pairs of sorted rows (key, doc, sketch) whose estimate reaches the floor: all of small parts, neighbours in the order of crowds."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for small, deep in _leaves(batches):
            yield from _scan(floor, REGION)(iter([small]))
            yield from _scan(floor, WINDOW)(iter([deep]))

    return run


def _forest_pairs(trees: DataFrame, floor: float) -> DataFrame:
    """(a, b, est) whose estimate reaches the floor, settled. trees: (tree, key, doc, sketch).

    All trees are sorted in one shuffle, by ranges, so that no crowd is one task; rows of equal minima by the other trees' minima, so that those
    with the longest common prefix meet. Pairs that a range's end parts are left to the join, as all that the forest doesn't find.
    """
    rest = F.expr(f"concat(substring(sketch, tree * {DEPTH} + {DEPTH} + 1), substring(sketch, 1, tree * {DEPTH}))")
    keyed = trees.select("tree", F.concat(F.unhex(F.lpad(F.hex("tree"), 2, "0")), "key").alias("key"), "doc", "sketch")
    by = [F.col("key"), rest, F.col("doc")]
    return settle(keyed.repartitionByRange(*by).sortWithinPartitions(*by).select("key", "doc", "sketch").mapInArrow(lean(_descend(floor)), PAIRS))


def _least(threshold: float, n: np.ndarray) -> np.ndarray:
    """The least whole number that is at least threshold * n; rounding errors never raise it."""
    return np.maximum(1, np.ceil(threshold * n - 1e-9)).astype(np.int64)


def _packed(c: np.ndarray) -> bytes:
    """A column as the differences of its rows, all first bytes, then all second ones, and so on, compressed: what repeats or grows slowly takes little."""
    x = np.diff(c.view(f"i{c.itemsize}"), prepend=c.dtype.type(0).view(f"i{c.itemsize}")) if c.dtype.kind == "i" else c
    return pa.Codec("zstd").compress(np.ascontiguousarray(x.view(np.uint8).reshape(-1, c.itemsize).T), asbytes=True)


def _blobs(bucket: np.ndarray, cols: dict[str, np.ndarray]) -> pa.RecordBatch:
    """A row for each bucket with its part of the columns, by document, as compressed bytes: few rows are shuffled."""
    order = np.lexsort((cols["doc"], bucket))
    bucket = bucket[order]
    edge = np.flatnonzero(np.concatenate([[True], bucket[1:] != bucket[:-1], [True]])) if len(bucket) else np.zeros(1, int)
    parts = [pa.array([_packed(c[lo:hi]) for lo, hi in zip(edge[:-1], edge[1:])], pa.binary()) for c in (z[order] for z in cols.values())]
    return pa.RecordBatch.from_arrays([pa.array(bucket[edge[:-1]].astype(np.int32)), pa.array(np.diff(edge).astype(np.int32)), *parts], ["bucket", "size", *cols])


def _unpacked(rows: pa.Table, fields: dict) -> list[np.ndarray]:
    sizes, out = rows["size"].to_pylist(), []
    for name, t in fields.items():
        t, parts = np.dtype(t), [np.zeros(0, t)]
        for n, data in zip(sizes, rows[name].to_pylist()):
            x = np.frombuffer(pa.Codec("zstd").decompress(data, n * t.itemsize), np.uint8).reshape(t.itemsize, n)
            x = np.ascontiguousarray(x.T).view(t).ravel()
            parts.append(np.cumsum(x, dtype=t) if t.kind == "i" else x)
        out.append(np.concatenate(parts))
    return out


def _rows(fields: dict) -> str:
    return "bucket int, size int, " + ", ".join(f"{name} binary" for name in fields)


#: A text's shingle: 32 of its bits (the bucket has others), document, what to add for its group, mark that tells an id's texts apart, size of the text's set.
_TOLD = {"h": np.uint32, "doc": np.int64, "up": np.int64, "mark": np.int64, "n": np.int32}
#: The same in the bucket of its document, with its own bucket and frequency.
_RATED = _TOLD | {"own": np.int32, "df": np.int32}
#: The same back in its own bucket, if it is among the text's first: its place; class.
_POSTED = {"h": np.uint32, "doc": np.int64, "up": np.int64, "n": np.int32, "pos": np.int32, "cls": np.int64}


def _tell(buckets: int):
    """Rows (doc, text, root, several) to all shingles, by their buckets."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = plain(batch.column(1))
            docs, roots, several = (np.asarray(batch.column(k)) for k in (0, 2, 3))
            for i, j in chunks(texts):
                s, offs, prints = shingles(texts.slice(i, j - i))
                own = owners(offs)
                order = np.lexsort((s, own))
                s, own = s[order], own[order]
                fresh = _firsts(own, s)
                s, own = s[fresh], own[fresh]
                n = np.bincount(own, minlength=j - i).astype(np.int32)
                mark = np.where(several[i:j], prints.view(np.int64), 0)
                yield _blobs((s % np.uint64(buckets)).astype(np.int64), {"h": (s >> np.uint64(32)).astype(np.uint32), "doc": docs[i:j][own], "up": (roots - docs)[i:j][own], "mark": mark[own], "n": n[own]})

    return run


def _rate(buckets: int):
    """The shingles of a bucket that are in texts of several groups, with their frequency, by documents."""

    def run(key: tuple, rows: pa.Table) -> pa.Table:
        h, doc, up, mark, n = _unpacked(rows, _TOLD)
        root = doc + up
        order = np.lexsort((root, h))
        h, root = h[order], root[order]
        new = _firsts(h)
        run, groups = _ends(new), _ends(_firsts(h, root))
        first = np.maximum.accumulate(np.where(new, np.arange(len(h)), 0))
        keep = groups[first] < run
        at = order[keep]
        cols = {"h": h[keep], "doc": doc[at], "up": up[at], "mark": mark[at], "n": n[at], "own": np.full(len(at), key[0].as_py(), np.int32), "df": (run - first)[keep].astype(np.int32)}
        with np.errstate(over="ignore"):
            bucket = (mix(doc[at].view(np.uint64)) % np.uint64(buckets)).astype(np.int64)
        release()  # of the group before
        return pa.Table.from_batches([_blobs(bucket, cols)])

    return run


def _post(threshold: float, hot: int):
    """The first shingles of each text, of which every similar set has one among its own first, by their buckets. Shingles that _rate() left out precede all others.

    cls is 0 for rare shingles. For common ones it is 2 for a text that common shingles alone can't link to a text of the same
    ones, else odd and the same for texts of the same common shingles.
    """

    def run(key: tuple, rows: pa.Table) -> pa.Table:
        h, doc, up, mark, n, own, df = _unpacked(rows, _RATED)
        order = np.lexsort((h, own, df, mark, doc))
        h, doc, up, mark, n, own, df = (z[order] for z in (h, doc, up, mark, n, own, df))
        fresh = _firsts(doc, mark, own, h)  # a row may be repeated
        h, doc, up, mark, n, own, df = (z[fresh] for z in (h, doc, up, mark, n, own, df))
        head = np.flatnonzero(_firsts(doc, mark))
        many = np.diff(np.append(head, len(h)))
        text = np.repeat(np.arange(len(head)), many)
        size = n[head].astype(np.int64)
        pos = np.arange(len(h)) - head[text] + (size - many)[text]
        common = df >= hot
        amount = np.bincount(text, weights=common, minlength=len(head)).astype(np.int64)
        sums = np.zeros(len(head), np.uint64)
        with np.errstate(over="ignore"):
            np.add.at(sums, text[common], mix((own[common].astype(np.uint64) << np.uint64(32)) + h[common]))
            kind = np.where((1 + threshold) * amount >= 2 * threshold * size + 1e-9, (mix(sums + amount.astype(np.uint64)) | np.uint64(1)).view(np.int64), 2)
        keep = pos < (size - _least(threshold, size) + 1)[text]
        cols = {"h": h, "doc": doc, "up": up, "n": n, "pos": pos.astype(np.int32), "cls": np.where(common, kind[text], 0)}
        return pa.Table.from_batches([_blobs(own[keep].astype(np.int64), {k: z[keep] for k, z in cols.items()})])

    return run


def _pairs_of_runs(threshold: float, doc: np.ndarray, n: np.ndarray, pos: np.ndarray, root: np.ndarray, first: np.ndarray, end: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs of each row with the rows from its `first` up to its `end`, AT_ONCE at a time, that can reach the threshold if this is their first common shingle."""
    count = np.maximum(0, end - first)
    i = 0  # row, and how many of its pairs are done
    done = 0
    while i < len(count):
        sums = np.cumsum(count[i:])
        sums -= done
        j = i + max(1, int(np.searchsorted(sums, AT_ONCE, side="right")))
        begin, some = first[i:j].copy(), count[i:j].copy()
        begin[0] += done
        some[0] = min(some[0] - done, AT_ONCE)
        if done + some[0] < count[i]:  # one row with very many
            j, done = i, done + some[0]
            begin, some = begin[:1], some[:1]
            x = np.full(some[0], i)
        else:
            done = 0
            x = np.repeat(np.arange(i, j), some)
        y = np.arange(len(x)) - np.repeat(np.cumsum(some) - some, some) + np.repeat(begin, some)
        need = _least(threshold / (1 + threshold), n[x].astype(np.int64) + n[y])
        good = (np.minimum(n[x] - pos[x], n[y] - pos[y]) >= need) & (root[x] != root[y])
        a, b = np.minimum(doc[x[good]], doc[y[good]]), np.maximum(doc[x[good]], doc[y[good]])
        order = np.lexsort((b, a))
        a, b = a[order], b[order]
        if len(a):
            fresh = _firsts(a, b)
            yield a[fresh], b[fresh]
        i = j


def _runs(threshold: float):
    """(a, b, known) of a bucket's postings: pairs of texts of different groups to be compared, and links that are known.

    Rare shingles: all pairs. Common ones: texts of the same common shingles are linked, where these alone are enough for it, and
    the smallest stands for them; texts that have more besides meet only such, since two of them aren't linked by common
    shingles alone, and where they share a rare shingle they meet there.
    """

    def run(key: tuple, rows: pa.Table) -> pa.Table:
        h, doc, up, n, pos, cls = _unpacked(rows, _POSTED)
        root = doc + up
        out, known = [], []
        rare = np.flatnonzero(cls == 0)
        rare = rare[np.lexsort((root[rare], h[rare]))]
        if len(rare):
            hh, rr = h[rare], root[rare]
            runs, groups = _ends(_firsts(hh)), _ends(_firsts(hh, rr))
            several = runs > groups
            if several.any():
                # rows of the last group of a run have nothing after them
                out += list(_pairs_of_runs(threshold, doc[rare], n[rare], pos[rare], rr, np.where(several, groups, runs), runs))
        hot = np.flatnonzero(cls != 0)
        hot = hot[np.lexsort((doc[hot], n[hot], cls[hot], cls[hot] == 2, h[hot]))]
        if len(hot):
            head = _firsts(h[hot], cls[hot]) | (cls[hot] == 2)
            lead = hot[np.maximum.accumulate(np.where(head, np.arange(len(hot)), 0))]
            tied = ~head & (root[hot] != root[lead])
            known = [(np.minimum(doc[hot[tied]], doc[lead[tied]]), np.maximum(doc[hot[tied]], doc[lead[tied]]))]
            hot = hot[head]
            runs = _ends(_firsts(h[hot]))
            out += list(_pairs_of_runs(threshold, doc[hot], n[hot], pos[hot], root[hot], np.arange(1, len(hot) + 1), np.where(cls[hot] == 2, 0, runs)))
        parts = [(a, b, np.zeros(len(a), bool)) for a, b in out] + [(a, b, np.ones(len(a), bool)) for a, b in known]
        cols = [np.concatenate(z) for z in zip(*parts)] if parts else [np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, bool)]
        release()  # of the group before
        return pa.table({"a": pa.array(cols[0]), "b": pa.array(cols[1]), "known": pa.array(cols[2])})

    return run


def _ends(first: np.ndarray) -> np.ndarray:
    """For each row the end of its run."""
    at = np.flatnonzero(first)
    return np.repeat(np.append(at[1:], len(first)), np.diff(np.append(at, len(first))))


def _rest(texts: DataFrame, total: int, threshold: float) -> DataFrame:
    """(a, b, known), settled, each pair once: every pair of (doc, text, root, several) of different roots that reaches the threshold, and others. total: shingles of all texts."""
    buckets = max(BUCKETS, -(-total // POSTINGS))
    told = texts.select("doc", "text", "root", "several").mapInArrow(lean(_tell(buckets)), _rows(_TOLD))
    rated = told.groupBy("bucket").applyInArrow(_rate(buckets), _rows(_RATED))
    posted = rated.groupBy("bucket").applyInArrow(_post(threshold, HOT), _rows(_POSTED))
    met = posted.groupBy("bucket").applyInArrow(_runs(threshold), "a long, b long, known boolean")
    return settle(met.groupBy("a", "b").agg(F.max("known").alias("known")))


def _together(pairs: DataFrame, block: int, blocks: int) -> DataFrame:
    """(blk, a, b), settled: the pairs dealt to blocks by the least partner of `a`, so that the sets of a crowd go to few blocks; where that is one of more than `block` documents they are dealt on by hash."""
    ends = pairs.select(F.col("a").alias("x"), F.col("b").alias("y")).union(pairs.select("b", "a"))
    least = ends.groupBy("x").agg(F.min("y").alias("y")).select(F.col("x").alias("a"), F.least("x", "y").alias("least"))
    parts = least.groupBy("least").agg(F.ceil(F.count("*") / block).alias("parts"))
    part = F.xxhash64("least", F.pmod(F.xxhash64("a"), F.col("parts")))
    dealt = least.join(parts, "least").select("a", F.pmod(part, F.lit(blocks)).cast("int").alias("blk"))
    return settle(pairs.join(dealt, "a").select("blk", "a", "b"))


def _close(threshold: float):
    """The pairs (blk, a, b) of a block whose sets (blk, id, shingles) reach the threshold."""

    def run(key: tuple, left: pa.Table, right: pa.Table) -> pa.Table:
        sets: dict[int, list[np.ndarray]] = {}  # an id may have several texts
        for i, x in zip(right["id"].to_pylist(), right["shingles"].to_pylist()):
            sets.setdefault(i, []).append(np.frombuffer(x, np.uint64))

        def near(x: np.ndarray, y: np.ndarray) -> bool:
            if min(len(x), len(y)) < threshold * max(len(x), len(y)):
                return False
            both = len(np.intersect1d(x, y, assume_unique=True))
            return both / max(1, len(x) + len(y) - both) >= threshold

        got = [(a, b) for a, b in zip(left["a"].to_pylist(), left["b"].to_pylist()) if any(near(x, y) for x in sets.get(a, []) for y in sets.get(b, []))]
        release()  # of the group before
        return pa.table({"a": pa.array([p[0] for p in got], pa.int64()), "b": pa.array([p[1] for p in got], pa.int64())})

    return run


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """(doc_id, group_id) for every document: group_id is the least id of its group, its own where it has no near copy.

    Documents are one group if a chain of pairs with Jaccard similarity of at least `threshold` over word
    triples (lower case, outer punctuation gone) links them. Texts of the same words in the same order are
    collapsed first. A null, empty or wordless text is in no group but its own; rows with a null id have no
    row here; an id that is repeated has one row, and its texts count as that document's. Ids of any integer type come
    out as longs; texts are read whole, however long; other columns are ignored, whatever their names. An empty table
    gives no rows. No link is left out: pairs that the forest doesn't find are found by the join. Sets are of 64-bit hashes; a pair
    under the threshold is taken for a link only where 80 % of its 96 minima agree, by a chance of about 1e-9 a pair.
    """
    src = pick(docs, doc_id=id_col, text=text_col).where("doc_id IS NOT NULL").withColumn("doc_id", F.col("doc_id").cast("long"))
    signed = settle(spread(src).mapInArrow(lean(_sign), "doc_id long, print long, n long, keys binary, sketch binary"))
    # the sketch makes the fingerprint long enough for any number of documents
    first = signed.groupBy("print", "sketch").agg(F.min("doc_id").alias("rep"), F.min("keys").alias("keys"), F.min("n").alias("n"))
    reps = settle(first)
    copies = settle(signed.join(reps.select("print", "sketch", "rep"), ["print", "sketch"]).where("doc_id <> rep").select(F.col("doc_id").alias("a"), F.col("rep").alias("b")).distinct())
    several = settle(signed.groupBy(F.col("doc_id").alias("id")).agg((F.min("print") < F.max("print")).alias("several")).where("several"))
    unsettle(signed)
    trees = reps.select(F.explode(F.sequence(F.lit(0), F.lit(TREES - 1))).alias("tree"), "keys", F.col("rep").alias("doc"), "sketch")
    trees = trees.select("tree", F.expr(f"substring(keys, tree * {2 * DEPTH} + 1, {2 * DEPTH})").alias("key"), "doc", "sketch")
    forest = _forest_pairs(trees, threshold + SURE)
    sure = settle(components(forest.select("a", "b").union(copies)).dropDuplicates(["id"]))
    unsettle(forest)
    # texts that are only copies have no part in the join; an id may have other texts besides
    idle = copies.select(F.col("a").alias("id")).distinct().join(reps.select(F.col("rep").alias("id")), "id", "left_anti").withColumn("idle", F.lit(True))
    marks = settle(sure.where("id <> root").join(idle, "id", "left").join(several, "id", "full"))
    small = marks.limit(BROADCAST_IDS // 2 + 1).count() <= BROADCAST_IDS // 2
    texts = spread(src).join((F.broadcast(marks) if small else marks).withColumnRenamed("id", "doc_id"), "doc_id", "left").where("idle IS NULL")
    texts = texts.select(F.col("doc_id").alias("doc"), "text", F.coalesce("root", "doc_id").alias("root"), F.coalesce("several", F.lit(False)).alias("several"))
    met = _rest(texts, reps.agg(F.sum("n")).first()[0] or 0, threshold)
    open_ = met.where("NOT known").select("a", "b")
    asked = settle(open_.select(F.col("a").alias("doc_id")).union(open_.select("b")).distinct())
    sets = settle(by_ids(src, asked, "doc_id", "left_semi").mapInArrow(lean(_sets), "id long, shingles binary"))
    blocks = max(1, -(-asked.count() // BLOCK))
    told = _together(open_, BLOCK, blocks)
    # by the id alone, as the join needs them: sets aren't shuffled once more for it
    need = told.select("blk", F.col("a").alias("id")).union(told.select("blk", "b")).distinct().join(sets.repartition("id").dropDuplicates(["id", "shingles"]), "id").select(F.col("blk").alias("blk"), F.col("id").alias("id"), "shingles")
    close = told.groupBy("blk").cogroup(need.groupBy("blk")).applyInArrow(_close(threshold), "a long, b long").distinct()
    links = close.union(met.where("known").select("a", "b"))
    ra, rb = sure.select(F.col("id").alias("a"), F.col("root").alias("ra")), sure.select(F.col("id").alias("b"), F.col("root").alias("rb"))
    links = links.join(ra, "a", "left").join(rb, "b", "left").select(F.coalesce("ra", "a").alias("a"), F.coalesce("rb", "b").alias("b"))
    linked = components(links).select(F.col("id").alias("root"), F.col("root").alias("top"))
    ids = src.select("doc_id").distinct()
    grouped = ids.join(sure.withColumnRenamed("id", "doc_id"), "doc_id", "left").withColumn("root", F.coalesce("root", "doc_id"))
    out = settle(grouped.join(linked.dropDuplicates(["root"]), "root", "left").select("doc_id", F.coalesce("top", "root").alias("group_id")))
    for done in (reps, copies, several, sure, marks, met, asked, sets, told):
        unsettle(done)
    return out


def drop_near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """The documents with all their columns, one per group: the one of the least id; null ids all stay.

    Of rows that share an id, one stays: the one whose columns, taken as JSON, come first.
    """
    groups = near_duplicates(docs, id_col, text_col, threshold)
    gone = settle(groups.where("group_id <> doc_id").select("doc_id"))
    kept = by_ids(docs, gone, id_col, "left_anti")
    again = settle(docs.groupBy(F.col(f"`{id_col}`").alias("_again")).count().where("count > 1 AND _again IS NOT NULL").select("_again"))
    if again.isEmpty():
        return kept
    once, more = (by_ids(kept, again, id_col, how) for how in ("left_anti", "left_semi"))
    row = F.to_json(F.struct(*[F.col(f"`{c}`") for c in docs.columns]))
    first = more.groupBy(F.col(f"`{id_col}`").alias("_id")).agg(F.min_by(F.struct(*[F.col(f"`{c}`") for c in docs.columns]), row).alias("_row"))
    return once.unionByName(first.select("_row.*"))
