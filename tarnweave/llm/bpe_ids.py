"""Byte-level BPE ids of whole columns: only the distinct words of a chunk go through the tokenizer."""

from __future__ import annotations

import base64
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from .common import TOKENIZERS

RANKS = f"{TOKENIZERS}/byte_bpe_50k.tiktoken"
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


def load_ranks(path: str = RANKS) -> bytes:
    with open(path, "rb") as f:
        return f.read()


class Ids:
    """end is the id after the last rank, free for the end of a document."""

    def __init__(self, ranks: bytes):
        import tiktoken

        table = {base64.b64decode(a): int(b) for a, b in map(bytes.split, ranks.splitlines())}
        self.enc = tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=table, special_tokens={})
        self.end = max(table.values()) + 1
        self.size = self.end + 1
        self.starts = np.zeros(self.size, bool)
        for piece, i in table.items():
            self.starts[i] = piece[:1] == b" "

    def batch(self, texts: pa.Array, want: str = "ids") -> tuple[np.ndarray, np.ndarray]:
        """(ids, offsets) of a string array without nulls; want="counts": (empty, offsets)."""
        # a line break or tab right before a word keeps it one unit: such words are cut at spaces only
        odd = np.asarray(pc.or_(pc.match_substring_regex(texts, r" \s|\s $|^\s|[\x{1c}-\x{1f}\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]| $"), pc.equal(texts, "")))
        lists = pc.split_pattern(texts.filter(pa.array(~odd)), " ")
        offs = np.asarray(lists.offsets).astype(np.int64)
        words = lists.flatten()
        first = np.zeros(len(words), bool)
        first[offs[:-1]] = True  # the first word of a text has no space before it
        coded = pc.dictionary_encode(words)
        codes, seen = np.asarray(coded.indices).astype(np.int64), coded.dictionary
        flat, size, begin = self._spaced(seen)
        rare, inv = np.unique(codes[first], return_inverse=True)
        own = [self.enc.encode_ordinary(seen[int(i)].as_py()) for i in rare]
        codes[first] = len(seen) + inv
        lens = np.array([len(x) for x in own], np.int64)
        begin = np.concatenate([begin, len(flat) + np.cumsum(lens) - lens]) if len(own) else begin
        size = np.concatenate([size, lens])
        flat = np.concatenate([flat, *[np.asarray(x, np.int32) for x in own]]) if own else flat
        n = size[codes]
        ends = np.concatenate([[0], np.cumsum(n)])
        counts = np.zeros(len(texts), np.int64)
        counts[~odd] = np.diff(ends[offs])
        slow = {int(r): self.enc.encode_ordinary(texts[int(r)].as_py()) for r in np.flatnonzero(odd)}
        for r, x in slow.items():
            counts[r] = len(x)
        out_offs = np.concatenate([[0], np.cumsum(counts)])
        if want == "counts":
            return flat[:0], out_offs
        # 32 bits are enough: an array's text has less than 2^31 bytes
        idx = np.arange(ends[-1], dtype=np.int32)
        idx += np.repeat((begin[codes] - ends[:-1]).astype(np.int32), n)
        if not slow:
            return flat[idx], out_offs
        out = np.empty(out_offs[-1], np.int32)
        out[np.repeat(~odd, counts)] = flat[idx]
        for r, x in slow.items():
            out[out_offs[r] : out_offs[r + 1]] = x
        return out, out_offs

    def _spaced(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(ids, count and begin per word) of " " + word for words without spaces, in one call: such units never join over a space. Arrow joins them, so that no word becomes an object."""
        if not len(words):
            return np.zeros(0, np.int32), np.zeros(0, np.int64), np.zeros(0, np.int64)
        joined = pc.binary_join(pa.ListArray.from_arrays(pa.array([0, len(words)], pa.int32()), words), " ")[0].as_py()
        flat = np.asarray(self.enc.encode_ordinary(" " + joined), np.int32)
        begin = np.flatnonzero(self.starts[flat])
        if len(begin) != len(words):
            raise AssertionError("a word starts without its space")
        return flat, np.diff(np.append(begin, len(flat))), begin


@lru_cache(2)
def ids_of(ranks: bytes) -> Ids:
    return Ids(ranks)
