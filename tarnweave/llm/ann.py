"""Approximate nearest neighbours: NN-descent builds a neighbour graph, greedy graph search answers queries.

Vectors are normalised and kept as 16-bit codes. Nodes are dealt to blocks by random hyperplanes, so that neighbours
tend to share one, and crowded cells are dealt on by hash; a block's joins need each vector once, so what is shuffled
per round is one copy of a vector per block that uses it, not one per edge. Rounds are Spark joins; each round's graph is a
table in the shared folder.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import chain, count

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import pick, settle, unsettle

GRAPH_K, BLOCK, LEAF, TREES = 20, 4096, 1024, 4
NEAREST, BEAM, EXPAND, TOGETHER = 10, 384, 384, 256
#: A node's edges, or some of them, in one row: ends, cosines, whether they are new.
LISTS = "u long, b array<long>, s array<float>, fresh array<boolean>"


def unit_codes(df: DataFrame, id_col: str, vec_col: str) -> DataFrame:
    """(id, v): 16-bit codes of the normalised vectors. Null ids, null, empty, zero and non-finite vectors are left out, and so are vectors of another length than most have (of equally frequent lengths the shortest holds); of rows that share an id the first by content stays."""
    src = pick(df, id=id_col, v=vec_col).select(F.col("id").cast("long").alias("id"), F.col("v").cast("array<float>").alias("v")).where("id IS NOT NULL AND size(v) > 0")
    top = src.groupBy(F.size("v").alias("d")).count().orderBy(F.desc("count"), "d").first()
    dim = top[0] if top else 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            col = batch.column(1)
            x = np.asarray(col.flatten().fill_null(float("nan")) if hasattr(col.flatten(), "fill_null") else col.flatten(), np.float64).reshape(len(col), dim)
            norm = np.linalg.norm(x, axis=1)
            good = np.isfinite(norm) & (norm > 0)
            q = np.rint(x[good] / norm[good, None] * 32767).astype(np.int16)
            yield pa.RecordBatch.from_arrays([batch.column(0).filter(pa.array(good)), pa.array([r.tobytes() for r in q], pa.binary())], ["id", "v"])

    coded = src.where(F.size("v") == dim).mapInArrow(run, "id long, v binary")
    return coded.groupBy("id").agg(F.min("v").alias("v"))


def _matrix(col: pa.Array) -> np.ndarray:
    col = col.combine_chunks() if isinstance(col, pa.ChunkedArray) else col
    rows = col.to_pylist()
    return np.frombuffer(b"".join(rows), np.int16).reshape(len(rows), -1).astype(np.float32) / 32767 if rows else np.zeros((0, 1), np.float32)


def _best(a: np.ndarray, b: np.ndarray, s: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The k largest s per a, each b once; ties by b."""
    order = np.lexsort((b, -s, a))
    a, b, s = a[order], b[order], s[order]
    fresh = np.ones(len(a), bool)
    fresh[1:] = (a[1:] != a[:-1]) | (b[1:] != b[:-1])  # one pair has one s, so its copies lie together
    a, b, s = a[fresh], b[fresh], s[fresh]
    first = np.flatnonzero(np.concatenate([[True], a[1:] != a[:-1]])) if len(a) else np.zeros(0, int)
    rank = np.arange(len(a)) - np.repeat(first, np.diff(np.append(first, len(a))))
    keep = rank < k
    return a[keep], b[keep], s[keep]


def _leaf_pairs(k: int, leaf: int):
    """Neighbours within leaves: runs of at most `leaf` rows of one (tree, cell), in the order of their projection."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        at = None

        def leaf_of() -> Iterator[pa.RecordBatch]:
            ids = np.array([h[0] for h in held])
            x = np.frombuffer(b"".join(h[1] for h in held), np.int16).reshape(len(ids), -1).astype(np.float32) / 32767
            s = x @ x.T
            np.fill_diagonal(s, -9)
            m = min(k, len(ids) - 1)
            if m > 0:
                top = np.argpartition(-s, m - 1, axis=1)[:, :m]
                yield _rows(np.repeat(ids, m), ids[top].ravel(), np.take_along_axis(s, top, 1).ravel(), np.ones(m * len(ids), bool))

        for batch in batches:
            for tree, cell, i, v in zip(*[c.to_pylist() for c in (batch.column(0), batch.column(1), batch.column(2), batch.column(3))]):
                if held and ((tree, cell) != at or len(held) >= leaf):
                    yield from leaf_of()
                    held.clear()
                at = (tree, cell)
                held.append((i, v))
        if held:
            yield from leaf_of()

    return run


def _seed(vecs: DataFrame, n: int, dim: int, k: int, leaf: int, trees: int) -> DataFrame:
    """First edges: random hyperplanes deal the vectors to cells, one more projection cuts cells into leaves."""
    bits = max(0, int(np.ceil(np.log2(max(1, n / leaf)))) // 2)
    planes = np.random.default_rng(5).standard_normal((trees, bits + 1, dim)).astype(np.float32)

    def project(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            x = _matrix(batch.column(1))
            for t in range(trees):
                p = x @ planes[t].T
                cell = ((p[:, :bits] > 0) << np.arange(bits)).sum(1) if bits else np.zeros(len(x), np.int64)
                yield pa.RecordBatch.from_arrays([pa.array([t] * len(x), pa.int32()), pa.array(cell.astype(np.int64)), batch.column(0), batch.column(1), pa.array(p[:, bits])], ["tree", "cell", "id", "v", "p"])

    spread = vecs.mapInArrow(project, "tree int, cell long, id long, v binary, p float").repartition("tree", "cell").sortWithinPartitions("tree", "cell", "p", "id")
    return spread.mapInArrow(_leaf_pairs(k, leaf), LISTS)


def _first(df: DataFrame, k: int, of: str, *order) -> DataFrame:
    """The first k rows of each `of`. Partial limits before the shuffle keep a hub's rows from one task, and nothing is gathered whole."""
    return df.withColumn("_k", F.row_number().over(Window.partitionBy(of).orderBy(*order))).where(F.col("_k") <= k).drop("_k")


def _rows(u: np.ndarray, b: np.ndarray, s: np.ndarray, fresh: np.ndarray) -> pa.RecordBatch:
    """Edges, those of a node side by side, as LISTS."""
    first = np.flatnonzero(np.concatenate([[True], u[1:] != u[:-1]])) if len(u) else np.zeros(0, int)
    offs = pa.array(np.append(first, len(u)).astype(np.int32))
    cols = [pa.ListArray.from_arrays(offs, pa.array(c, t)) for c, t in ((b, pa.int64()), (s.astype(np.float32), pa.float32()), (fresh.astype(bool), pa.bool_()))]
    return pa.RecordBatch.from_arrays([pa.array(u[first], pa.int64()), *cols], ["u", "b", "s", "fresh"])


def _edges(rows: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(u, b, s, fresh) of LISTS, an edge an element."""
    (b, offs), (s, _), (fresh, _) = (_lists(pa.chunked_array([rows.column(c)])) for c in (1, 2, 3))
    return np.repeat(np.asarray(rows.column(0)), np.diff(offs)), b, s, fresh.astype(bool)


def _by_node(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows in the order of their first column, cut only where it changes."""
    held = None
    for batch in chain(batches, [None]):
        rows = held if batch is None else batch if held is None else pa.concat_batches([held, batch])
        if rows is None or not rows.num_rows:
            continue
        node = np.asarray(rows.column(0))
        cut = len(node) if batch is None else int(np.searchsorted(node, node[-1]))
        held = rows.slice(cut)
        if cut:
            yield rows.slice(0, cut)


def _top(u: np.ndarray, b: np.ndarray, s: np.ndarray, k: int) -> np.ndarray:
    """Places of the k largest s per u, ties by b, in the order of u and rank."""
    order = np.lexsort((b, -s, u))
    u = u[order]
    first = np.flatnonzero(np.concatenate([[True], u[1:] != u[:-1]])) if len(u) else np.zeros(0, int)
    return order[np.arange(len(u)) - np.repeat(first, np.diff(np.append(first, len(u)))) < k]


def _merged(k: int):
    """Of sorted LISTS: the k best of each node; of copies of an edge the largest cosine, and new only if all are."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in _by_node(batches):
            u, b, s, fresh = _edges(rows)
            if len(u):
                order = np.lexsort((b, u))
                u, b, s, fresh = (z[order] for z in (u, b, s, fresh))
                first = np.flatnonzero(np.concatenate([[True], (u[1:] != u[:-1]) | (b[1:] != b[:-1])]))
                u, b, s, fresh = u[first], b[first], np.maximum.reduceat(s, first), np.logical_and.reduceat(fresh, first)
                best = _top(u, b, s, k)
                yield _rows(u[best], b[best], s[best], fresh[best])

    return run


def _merge(lists: DataFrame, k: int) -> DataFrame:
    """LISTS, a row a node: its k best neighbours, ties by id. Lists are shuffled, not edges."""
    return lists.repartition("u").sortWithinPartitions("u").mapInArrow(_merged(k), LISTS)


def _turned(k: int):
    """LISTS of the nodes that others have as neighbours; k best of each batch, so that a hub's rows stay few."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            u, b, s, fresh = _edges(batch)
            best = _top(b, u, s, k)
            yield _rows(b[best], u[best], s[best], fresh[best])

    return run


def _near(k: int):
    """Of sorted LISTS with a mark for a node's own: (u, a, fresh) of nodes with a new edge, with their neighbours and the k best of those that have them as theirs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in _by_node(batches):
            parts = []
            for own in (True, False):
                u, b, s, fresh = _edges(rows.filter(pc.equal(rows.column(4), own)))
                best = slice(None) if own else _top(u, b, s, k)
                parts.append((u[best], b[best], s[best], fresh[best]))
            u, b, s, fresh = (np.concatenate(z) for z in zip(*parts))
            order = np.argsort(u, kind="stable")
            live = np.isin(u[order], u[fresh])
            out = _rows(*(z[order][live] for z in (u, b, s, fresh)))
            yield pa.RecordBatch.from_arrays([out.column(0), out.column(1), out.column(3)], ["u", "a", "fresh"])

    return run


def _local_join(k: int):
    """Pairs among the neighbours of each node of a block that would improve a neighbour's own list."""

    def run(key: tuple, left: pa.Table, right: pa.Table) -> pa.Table:
        names = np.asarray(right["a"].combine_chunks())
        order = np.argsort(names)
        names, x, kth = names[order], _matrix(right["v"])[order], np.asarray(right["kth"].combine_chunks())[order]
        (a, offs), (fresh, _) = (_lists(left[c]) for c in ("a", "fresh"))
        u, fresh = np.repeat(np.asarray(left["u"].combine_chunks()), np.diff(offs)), fresh.astype(bool)
        order = np.argsort(u, kind="stable")
        u, fresh, at = u[order], fresh[order], np.searchsorted(names, a[order])
        edge = np.flatnonzero(np.concatenate([[True], u[1:] != u[:-1], [True]]))
        got, some = [], []
        for g, (lo, hi) in enumerate(zip(edge[:-1], edge[1:])):
            f = fresh[lo:hi]
            if f.any():
                m = np.unique(at[lo:hi])
                new = np.zeros(len(m), bool)
                new[np.searchsorted(m, at[lo:hi][f])] = True
                s = x[m] @ x[m].T
                np.fill_diagonal(s, -9)
                i, j = np.nonzero((s > kth[m][:, None]) & (new[:, None] | new[None, :]))
                some.append((m[i], m[j], s[i, j]))
            if len(some) >= 512 or g == len(edge) - 2 and some:
                got.append(_best(*(np.concatenate(z) for z in zip(*some)), k))
                some = []
                if len(got) > 8:
                    got = [_best(*(np.concatenate(z) for z in zip(*got)), k)]
        if some:
            got.append(_best(*(np.concatenate(z) for z in zip(*some)), k))
        p, q, s = _best(*(np.concatenate(z) for z in zip(*got)), k) if got else (np.zeros(0, int), np.zeros(0, int), np.zeros(0, np.float32))
        return pa.Table.from_batches([_rows(names[p], names[q], s, np.ones(len(p), bool))])

    return run


def _blocks(vecs: DataFrame, n: int, dim: int, block: int) -> DataFrame:
    """(u, blk): cells of random hyperplanes; a cell of more than `block` nodes is dealt on by hash. Settled."""
    bits = max(0, int(np.ceil(np.log2(max(1, n / block)))))
    planes = np.random.default_rng(6).standard_normal((bits, dim)).astype(np.float32)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                cell = ((_matrix(batch.column(1)) @ planes.T > 0) << np.arange(bits, dtype=np.int64)).sum(1) if bits else np.zeros(batch.num_rows)
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(cell.astype(np.int64))], ["u", "cell"])

    cells = settle(vecs.mapInArrow(run, "u long, cell long"))
    parts = cells.groupBy("cell").agg(F.ceil(F.count("*") / block).alias("parts"))
    out = settle(cells.join(parts, "cell").select("u", F.xxhash64("cell", F.pmod(F.xxhash64("u"), F.col("parts"))).alias("blk")))
    unsettle(cells)
    return out


def build_graph(vecs: DataFrame, k: int = GRAPH_K, block: int = BLOCK, leaf: int = LEAF, trees: int = TREES, settle_at: float = 0.01) -> DataFrame:
    """(u, b, s, fresh), settled: up to k neighbours of each node, for settled codes (id, v). Rounds go on, whatever their number, until at most `settle_at` of the edges are new; lists only improve, so they end."""
    head = vecs.select("v").first()
    if head is None:
        return vecs.sparkSession.createDataFrame([], "u long, b long, s float, fresh boolean")
    n, dim = vecs.count(), len(head[0]) // 2
    blk = _blocks(vecs, n, dim, block)
    graph = settle(_merge(_seed(vecs, n, dim, k, leaf, trees), k))
    while True:
        # each node also sees the k best of those that have it as a neighbour; a node without a fresh edge has nothing to find
        back = graph.mapInArrow(_turned(k), LISTS)
        both = graph.withColumn("own", F.lit(True)).union(back.withColumn("own", F.lit(False)))
        live = both.repartition("u").sortWithinPartitions("u").mapInArrow(_near(k), "u long, a array<long>, fresh array<boolean>")
        near = settle(live.join(blk, "u").select("blk", "u", "a", "fresh"))
        kth = graph.select(F.col("u").alias("a"), F.when(F.size("b") >= k, F.array_min("s")).otherwise(F.lit(-2.0)).cast("float").alias("kth"))
        ends = near.select("blk", "a").mapInArrow(_distinct_ends, "blk long, c long").distinct().withColumnRenamed("c", "a")
        need = ends.join(vecs.withColumnRenamed("id", "a").join(kth, "a", "left"), "a").select(F.col("blk").alias("blk"), F.col("a").alias("a"), "v", F.coalesce("kth", F.lit(-2.0).cast("float")).alias("kth"))
        found = near.groupBy("blk").cogroup(need.groupBy("blk")).applyInArrow(_local_join(k), LISTS)
        old = graph.withColumn("fresh", F.transform("fresh", lambda f: F.lit(False)))
        new = settle(_merge(old.union(found), k))
        unsettle(graph)
        unsettle(near)
        graph = new
        change = graph.agg(F.sum(F.size(F.filter("fresh", lambda f: f))), F.sum(F.size("b"))).first()
        if (change[0] or 0) <= settle_at * (change[1] or 0):
            unsettle(blk)
            out = settle(graph.select("u", F.explode(F.arrays_zip("b", "s", "fresh")).alias("e")).select("u", "e.b", "e.s", "e.fresh"))
            unsettle(graph)
            return out


def _lists(col: pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """(values, offsets) of a list column without nulls."""
    col = col.combine_chunks()
    if isinstance(col, pa.ChunkedArray):
        col = pa.concat_arrays(col.chunks) if col.num_chunks else pa.array([], col.type)
    offs = np.asarray(col.offsets).astype(np.int64)
    return np.asarray(col.flatten()), offs - offs[0]


def _advance(beam: int, expand: int):
    """One step of each query of a block. Right rows are nodes: with `out`, the links of one that is expanded; with `v`, the vector of a candidate."""

    def run(key: tuple, left: pa.Table, right: pa.Table) -> pa.Table:
        linked = right.filter(right["out"].is_valid())
        nodes = np.asarray(linked["c"].combine_chunks())
        order = np.argsort(nodes)
        nodes = nodes[order]
        out, at = _lists(linked["out"])
        coded = right.filter(right["v"].is_valid())
        names = np.asarray(coded["c"].combine_chunks())
        by = np.argsort(names)
        names, x = names[by], _matrix(coded["v"])[by]
        q = _matrix(left["qv"])
        (ids, io), (sims, _), (done, _), (cand, co) = (_lists(left[c]) for c in ("ids", "sims", "done", "cand"))
        done = done.astype(bool)
        new_ids, new_sims, new_done, sizes = [], [], [], []
        for r in range(left.num_rows):
            own, s, d = ids[io[r] : io[r + 1]], sims[io[r] : io[r + 1]], done[io[r] : io[r + 1]].copy()
            opened = np.flatnonzero(~d)[:expand]
            parts = [cand[co[r] : co[r + 1]]]
            if len(opened):
                d[opened] = True
                k = np.searchsorted(nodes, own[opened])
                k = k[k < len(nodes)]
                parts += [out[at[o] : at[o + 1]] for o in order[k[np.isin(nodes[k], own[opened])]]]
            new = np.unique(np.concatenate(parts))
            new = new[~np.isin(new, own)]
            k = np.minimum(np.searchsorted(names, new), max(0, len(names) - 1))
            if len(names):
                good = names[k] == new
                new, k = new[good], k[good]
            else:
                new = k = new[:0]
            s, own, d = np.concatenate([s, x[k] @ q[r] if len(k) else s[:0]]), np.concatenate([own, new]), np.concatenate([d, np.zeros(len(new), bool)])
            top = np.lexsort((own, -s))[:beam]
            new_ids.append(own[top])
            new_sims.append(s[top])
            new_done.append(d[top])
            sizes.append(len(top))
        offs = pa.array(np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32))
        flat = [np.concatenate(z) if z else np.zeros(0) for z in (new_ids, new_sims, new_done)]
        cols = [pa.ListArray.from_arrays(offs, pa.array(f.astype(t), k)) for f, t, k in zip(flat, (np.int64, np.float32, bool), (pa.int64(), pa.float32(), pa.bool_()))]
        return pa.table({"q": left["q"], "qv": left["qv"], "ids": cols[0], "sims": cols[1], "done": cols[2]})

    return run


def _distinct_ends(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(blk, c): distinct link ends per block of each batch; few rows are left for the exact distinct."""
    for batch in batches:
        if batch.num_rows:
            blk = np.asarray(batch.column(0))
            ends, offs = _lists(pa.chunked_array([batch.column(1)]))
            own = np.repeat(blk, np.diff(offs))
            order = np.lexsort((ends, own))
            own, ends = own[order], ends[order]
            fresh = np.ones(len(own), bool)
            fresh[1:] = (own[1:] != own[:-1]) | (ends[1:] != ends[:-1])
            yield pa.RecordBatch.from_arrays([pa.array(own[fresh]), pa.array(ends[fresh])], ["blk", "c"])


STATE = "q long, qv binary, ids array<long>, sims array<float>, done array<boolean>"


def links_of(graph: DataFrame, k: int = GRAPH_K) -> DataFrame:
    """(node, out): a node's neighbours, and the k best of those that have it as theirs. Settled."""
    back = _first(graph.select(F.col("b").alias("u"), F.col("u").alias("b"), "s"), k, "u", F.desc("s"), "b")
    return settle(graph.select("u", "b").union(back.select("u", "b")).distinct().groupBy(F.col("u").alias("node")).agg(F.sort_array(F.collect_list("b")).alias("out")))


def search(vecs: DataFrame, graph: DataFrame, queries: DataFrame, starts: DataFrame, beam: int = BEAM, expand: int = EXPAND, block: int = TOGETHER) -> DataFrame:
    """Greedy beam search, all queries a step at a time: (q, ids, sims) with the best `beam` found. Settled.

    queries: (q, qv); starts: (q, cand) with the nodes where each query begins. Each round expands the best
    `expand` nodes of each beam that weren't expanded yet, until no beam has one; a node that left a beam never comes back.
    Vectors and links go once to each block of `block` queries that reaches them.
    """
    blocks = max(1, -(-queries.count() // block))
    blk = F.pmod(F.xxhash64("q"), F.lit(blocks)).cast("int").alias("blk")
    state = queries.select("q", "qv", *[F.array().cast(f"array<{t}>").alias(c) for c, t in (("ids", "long"), ("sims", "float"), ("done", "boolean"))])
    cand, old = starts, None
    links = links_of(graph)
    for step in count():
        # the nodes that a block expands with their links, once each, and the vectors of everything they lead to
        opened = F.slice(F.filter(F.arrays_zip("ids", "done"), lambda e: ~e["done"]), 1, expand)
        front = state.select(blk, F.explode(F.transform(opened, lambda e: e["ids"])).alias("node")).distinct()
        reach = front.join(links, "node").select("blk", F.col("node").alias("c"), "out")
        ends = reach.select("blk", "out").mapInArrow(_distinct_ends, "blk int, c long")
        if step == 0:
            ends = ends.union(cand.select(blk, F.explode("cand").alias("c")))
        need = ends.distinct().join(vecs.withColumnRenamed("id", "c"), "c").select(F.col("blk").alias("blk"), "c", "v", F.lit(None).cast("array<long>").alias("out"))
        right = need.union(reach.select("blk", "c", F.lit(None).cast("binary").alias("v"), "out"))
        left = state.join(cand, "q", "left") if step == 0 else state.withColumn("cand", F.lit(None).cast("array<long>"))
        left = left.select(blk, "q", "qv", F.coalesce("cand", F.array().cast("array<long>")).alias("cand"), "ids", "sims", "done")
        new = settle(left.groupBy("blk").cogroup(right.groupBy("blk")).applyInArrow(_advance(beam, expand), STATE))
        unsettle(old)
        old = state = new
        if not new.where(F.exists("done", lambda d: ~d)).limit(1).count():
            unsettle(links)
            return new.select("q", "ids", "sims")


def entry_points(vecs: DataFrame, queries: DataFrame, most: int = 256) -> DataFrame:
    """(q, cand): a fixed sample of nodes (a constant number, spread by hash) where queries from outside begin."""
    nodes = vecs.select("id").orderBy(F.xxhash64("id"), "id").limit(most).agg(F.collect_list("id").alias("cand"))
    return queries.select("q").crossJoin(F.broadcast(nodes))


def nearest_neighbours(df: DataFrame, k: int = NEAREST, id_col: str = "vec_id", vec_col: str = "embedding", every: int = 1) -> DataFrame:
    """(vec_id, neighbours, cosines): the k nearest others by cosine, nearest first, ties by id, of every vector whose id is divisible by `every`, among all vectors.

    The graph holds every vector. Each query's greedy search begins at its own neighbours in the graph. Vectors that
    unit_codes() leaves out have no row; a single vector has empty arrays; an empty table gives no rows. Ids of any
    integer type come out as longs; other columns are ignored, whatever their names. Of equal vectors more than k,
    all at the same cosine, those of the least ids come first among the ones found. Approximate: measured recall is in the README.
    """
    vecs = settle(unit_codes(df, id_col, vec_col))
    graph = build_graph(vecs)
    asked = F.col("id") % every == 0
    queries = vecs.where(asked).select(F.col("id").alias("q"), F.col("v").alias("qv"))
    starts = graph.where(F.col("u") % every == 0).groupBy(F.col("u").alias("q")).agg(F.sort_array(F.collect_list("b")).alias("cand"))
    found = search(vecs, graph, queries, starts)
    unsettle(graph)
    z = F.filter(F.arrays_zip("ids", "sims"), lambda e: e["ids"] != F.col("q"))
    return found.select(F.col("q").alias("vec_id"), F.slice(z, 1, k).alias("z")).select("vec_id", F.transform("z", lambda e: e["ids"]).alias("neighbours"), F.transform("z", lambda e: F.round(e["sims"], 4)).alias("cosines"))


def search_vectors(df: DataFrame, queries: DataFrame, k: int = NEAREST, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """(query_id, neighbours, cosines) for vectors that needn't be in the table (same column names); a vector equal to its query counts.

    Queries with null ids or unusable vectors have no row; of queries that share an id the first by content is asked; an
    empty table gives queries without neighbours. See nearest_neighbours().
    """
    vecs = settle(unit_codes(df, id_col, vec_col))
    asked = settle(unit_codes(queries, id_col, vec_col)).select(F.col("id").alias("q"), F.col("v").alias("qv"))
    graph = build_graph(vecs)
    found = search(vecs, graph, asked, entry_points(vecs, asked))
    unsettle(graph)
    return found.select(F.col("q").alias("query_id"), F.slice("ids", 1, k).alias("neighbours"), F.transform(F.slice("sims", 1, k), lambda s: F.round(s, 4)).alias("cosines"))
