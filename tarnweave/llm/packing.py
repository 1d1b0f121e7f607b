"""Sum-of-squares packing of documents into training sequences.

N(h) is the number of open sequences filled to level h. A document of s tokens goes where the sum of the
N(h)² becomes smallest: into an open sequence of level h it changes the sum by 2·(N(h+s) − N(h) + 1), into
one that it fills by 1 − 2·N(h), into a new one by 1 + 2·N(s).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bpe_ids import RANKS, ids_of, load_ranks
from .common import chunks, lean, pick, plain, settle, spread

CAPACITY, GROUP = 2048, 100_000
SCHEMA = "pack_group int, bin int, doc_ids array<bigint>, starts array<bigint>, lens array<int>, used int"


def _counts(ranks):
    """Rows (doc_id, text, salt) with the number of tokens for the text; a step holds the words of CHUNK bytes, or of one longer text. ranks: a broadcast."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = plain(batch.column(1))
            for i, j in chunks(texts):
                _, offs = ids_of(ranks.value).batch(texts.slice(i, j - i), "counts")
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, j - i), pa.array(np.diff(offs), pa.int64()), batch.column(2).slice(i, j - i)], ["doc_id", "size", "salt"])

    return run


def token_counts(docs: DataFrame, ranks_path: str = RANKS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, size, salt): tokens of each text; null and empty ones have 0. salt is a hash of id and text."""
    ranks = docs.sparkSession.sparkContext.broadcast(load_ranks(ranks_path))
    src = spread(pick(docs, doc_id=id_col, text=text_col))
    return src.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.xxhash64("doc_id", "text").alias("salt")).mapInArrow(lean(_counts(ranks)), "doc_id long, size long, salt long")


def sum_of_squares(sizes: list[int], capacity: int) -> list[int]:
    """Bin of each item (0 < size <= capacity), in the order given. Ties: the fullest level first, a new bin last; of bins at a level the latest."""
    n = np.zeros(capacity + 1, np.int64)
    stacks: dict[int, list[int]] = {}
    big, out, bins = np.int64(1 << 60), [], 0
    for s in sizes:
        # level h = capacity - s is filled up and leaves; others move to h + s
        here = n[1 : capacity - s + 1]
        if len(here):
            gain = 2 * (n[1 + s : capacity + 1] - here + 1)
            gain[-1] = 1 - 2 * here[-1]
            gain[here == 0] = big
            k = len(gain) - 1 - int(np.argmin(gain[::-1]))
            best = gain[k]
        else:
            best = big
        if best <= (1 + 2 * n[s] if s < capacity else 0):
            h = k + 1
            b = stacks[h].pop()
            n[h] -= 1
        else:
            h, b = 0, bins
            bins += 1
        if h + s < capacity:
            n[h + s] += 1
            stacks.setdefault(h + s, []).append(b)
        out.append(b)
    return out


def pack_group(table: pa.Table, capacity: int) -> pa.Table:
    """Bins of one group. Items come in the order of (doc_id, size, start); null ids last."""
    docs = zip(table["doc_id"].to_pylist(), table["size"].to_pylist())
    items = [(d, start, min(capacity, size - start)) for d, size in docs for start in range(0, size, capacity)]
    bins: dict[int, list[int]] = {}
    for item, b in enumerate(sum_of_squares([n for _, _, n in items], capacity)):
        bins.setdefault(b, []).append(item)
    group = table["pack_group"][0].as_py() if table.num_rows else 0
    col = lambda k: [[items[i][k] for i in x] for x in bins.values()]
    return pa.table(
        {
            "pack_group": pa.array([group] * len(bins), pa.int32()),
            "bin": pa.array(list(bins), pa.int32()),
            "doc_ids": pa.array(col(0), pa.list_(pa.int64())),
            "starts": pa.array(col(1), pa.list_(pa.int64())),
            "lens": pa.array(col(2), pa.list_(pa.int32())),
            "used": pa.array([sum(items[i][2] for i in x) for x in bins.values()], pa.int32()),
        }
    )


def _pack(capacity: int, most: int):
    """Groups come one after another; a group is packed as soon as it ends, or at `most` documents, so that no group is held whatever its size."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.Table] = []
        at, rows = None, 0
        for batch in batches:
            group = np.asarray(batch.column(0))
            edges = np.concatenate([[0], np.flatnonzero(group[1:] != group[:-1]) + 1, [len(group)]])
            for i, j in zip(edges[:-1], edges[1:]):
                while i < j:
                    if held and (group[i] != at or rows == most):
                        yield from pack_group(pa.concat_tables(held), capacity).to_batches()
                        held, rows = [], 0
                    at, n = group[i], min(j - i, most - rows if held and group[i] == at else most)
                    held.append(pa.Table.from_batches([batch.slice(i, n)]))
                    rows += n
                    i += n
        if held:
            yield from pack_group(pa.concat_tables(held), capacity).to_batches()

    return run


def pack_sizes(sizes: DataFrame, n_docs: int, capacity: int = CAPACITY, group: int = GROUP) -> DataFrame:
    """Pack (doc_id, size, salt) rows. Documents are dealt by salt to groups of about `group`, and each group is packed
    alone, so at most a few open sequences a group are wasted; only ids and sizes are shuffled."""
    groups = max(1, -(-n_docs // group))
    dealt = sizes.where(F.col("size") > 0).select(F.pmod(F.xxhash64("salt"), F.lit(groups)).cast("int").alias("pack_group"), "doc_id", "size")
    # an explicit number of partitions: tiny as the rows are, groups should not be put together into one task
    return dealt.repartition(2 * groups, "pack_group").sortWithinPartitions("pack_group", F.col("doc_id").asc_nulls_last(), "size").mapInArrow(lean(_pack(capacity, 4 * group)), SCHEMA)


def pack_documents(docs: DataFrame, capacity: int = CAPACITY, group: int = GROUP, ranks_path: str = RANKS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per training sequence: group, bin, the documents' ids, at which token each piece starts and how
    many tokens it has, and their sum.

    A document longer than the capacity is cut into full pieces and a rest. Null and empty texts have no
    tokens and appear nowhere. Repeated rows are packed once each; a null id is packed as a null in doc_ids, and
    rows of one id or of none are spread over the groups by their texts. Equal sums of squares: see sum_of_squares().
    Ids of any integer type come out as longs; other columns are ignored, whatever their names. An empty table gives
    no sequences. Texts are tokenized whole and once; ids and sizes are kept as a table in the shared folder.
    """
    sizes = settle(token_counts(docs, ranks_path, id_col, text_col))
    return pack_sizes(sizes, sizes.where("size > 0").count(), capacity, group)
