"""SentencePiece encoding and decoding by a shared-prefix forward pass.

Distinct marked words ("▁word") are sorted, which lays their trie out depth-first: each word keeps the
forward states of the prefix it shares with the word before it and computes only its own rest. For a
unigram model a state is the best score of the prefix (Viterbi). For a BPE model summed scores do not
give the merges' result, so the state is the last piece of the prefix's segmentation: a piece may follow
iff the two, merged alone, stay two; exactly one piece ending at a position passes. An Aho-Corasick walk
yields the pieces that end there.
"""

from __future__ import annotations

import re
import struct
from array import array
from collections import deque
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from .common import TOKENIZERS, chunks, pick, plain, spread

MARK = "▁"
NORMAL, UNKNOWN, CONTROL, USER, UNUSED, BYTE = 1, 2, 3, 4, 5, 6
_RUN = re.compile(f"{MARK}+[^{MARK}]*|[^{MARK}]+")
MODEL = f"{TOKENIZERS}/piece_bpe_32k.model"


def _fields(buf: bytes) -> Iterator[tuple[int, object]]:
    """(number, value) of a protocol-buffer message."""
    i, n = 0, len(buf)

    def varint() -> int:
        nonlocal i
        x = s = 0
        while True:
            b = buf[i]
            i += 1
            x |= (b & 127) << s
            s += 7
            if b < 128:
                return x

    while i < n:
        key = varint()
        kind = key & 7
        if kind == 0:
            yield key >> 3, varint()
        elif kind == 2:
            size = varint()
            yield key >> 3, buf[i : i + size]
            i += size
        else:
            size = 4 if kind == 5 else 8
            yield key >> 3, buf[i : i + size]
            i += size


class Codec:
    """One model. encode(text) and decode(ids) for single texts, encode_words(...) for sorted distinct words."""

    def __init__(self, model: bytes):
        pieces, self.bpe, fallback, self.dummy, self.squeeze, charsmap = [], False, False, True, True, b""
        for num, val in _fields(model):
            if num == 1:
                p = dict(_fields(val))
                pieces.append((p[1].decode(), struct.unpack("<f", p[2])[0] if 2 in p else 0.0, p.get(3, NORMAL)))
            elif num == 2:
                spec = dict(_fields(val))
                self.bpe, fallback = spec.get(3, 1) == 2, bool(spec.get(35, 0))
            elif num == 3:
                spec = dict(_fields(val))
                charsmap, self.dummy, self.squeeze = spec.get(2, b""), bool(spec.get(3, 1)), bool(spec.get(4, 1))
        if charsmap:
            raise ValueError("models with a character map for normalisation are not supported")
        self.pieces = pieces
        self.unk = next((i for i, p in enumerate(pieces) if p[2] == UNKNOWN), 0)
        self.bytes = {int(p[0][3:5], 16): i for i, p in enumerate(pieces) if p[2] == BYTE} if fallback else {}
        self.ids = {p[0]: i for i, p in enumerate(pieces) if p[2] in (NORMAL, USER)}
        self.score = [p[1] for p in pieces]
        self.low = min((p[1] for p in pieces if p[2] == NORMAL), default=0.0) - 10.0
        #: whether words can be cut before each run of marks: no piece has a mark after another character
        self.cut = not any(MARK in p.lstrip(MARK) for p in self.ids)
        self.text = [self._out(i) for i in range(len(pieces))]
        self.plain = np.array([p[2] in (NORMAL, USER) for p in pieces])
        if self.bpe:
            self._derive()
        self._automaton()

    def _out(self, i: int) -> bytes:
        piece, _, kind = self.pieces[i]
        if kind == BYTE:
            return bytes([int(piece[3:5], 16)])
        if kind == UNKNOWN:
            return " ⁇ ".encode()
        return b"" if kind == CONTROL else piece.replace(MARK, " ").encode()

    # -- BPE: which pieces may stand side by side

    def _derive(self) -> None:
        """Rank of each piece, its last merge, and all pairs that merge into a piece."""
        order = sorted((i for p, i in self.ids.items() if len(p) > 1), key=lambda i: (-self.score[i], i))
        self.rank = {i: 0 for p, i in self.ids.items() if len(p) == 1}
        self.halves: dict[int, tuple[int, int]] = {}
        self.joins: dict[tuple[int, int], int] = {}
        self.fits: dict[int, bool] = {}
        ids, rank = self.ids, self.rank
        for r, i in enumerate(order, 1):
            p = self.pieces[i][0]
            pairs = [(ids[p[:k]], ids[p[k:]]) for k in range(1, len(p)) if p[:k] in ids and p[k:] in ids]
            pairs = [(a, b) for a, b in pairs if a in rank and b in rank]
            for a, b in pairs:
                if self._apart(a, b):
                    self.halves[i] = (a, b)
                    rank[i] = r
                    break
            if i in rank:
                for pair in pairs:
                    self.joins[pair] = r
        self.fits.clear()

    def _apart(self, a: int, b: int) -> bool:
        """Whether a followed by b, merged from characters, ends as just these two. Undoes their merges, latest first."""
        joins, halves, rank = self.joins, self.halves, self.rank
        ra, rb = rank[a], rank[b]
        limit = 1 << 60
        while True:
            r = joins.get((a, b))
            if r is not None and r < limit:
                return False
            if ra > rb:  # a's last merge came later: before it, b was whole
                limit = ra
                a = halves[a][1]
                ra = rank[a]
            elif rb > 0:  # of equal merges the left one comes first, so b's is undone first
                limit = rb + 0.5
                b = halves[b][0]
                rb = rank[b]
            elif ra > 0:
                limit = ra
                a = halves[a][1]
                ra = rank[a]
            else:
                return True

    # -- Aho-Corasick over the pieces

    def _automaton(self) -> None:
        goto: list[dict[str, int]] = [{}]
        own: dict[int, tuple[int, int]] = {}
        for p, i in self.ids.items():
            if self.bpe and i not in self.rank:
                continue
            node = 0
            for ch in p:
                nxt = goto[node].get(ch)
                if nxt is None:
                    nxt = len(goto)
                    goto[node][ch] = nxt
                    goto.append({})
                node = nxt
            own[node] = (i, len(p))
        fail = [0] * len(goto)
        ends: list[tuple] = [()] * len(goto)
        queue = deque(goto[0].values())
        for node in queue:
            ends[node] = (own[node],) if node in own else ()
        while queue:
            node = queue.popleft()
            for ch, nxt in goto[node].items():
                f = fail[node]
                while f and ch not in goto[f]:
                    f = fail[f]
                f = goto[f].get(ch, 0)
                fail[nxt] = f
                ends[nxt] = ((own[nxt],) if nxt in own else ()) + ends[f]
                queue.append(nxt)
        self.goto, self.fail, self.ends = goto, fail, ends
        self.steps: list[dict[str, int]] = [dict(g) for g in goto]

    def _step(self, node: int, ch: str) -> int:
        goto, at = self.goto, node
        while at and ch not in goto[at]:
            at = self.fail[at]
        nxt = goto[at].get(ch, 0)
        self.steps[node][ch] = nxt
        return nxt

    def encode_words(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(ids, offsets) of sorted distinct words; equal or unsorted words are right as well, only slower."""
        flat, offs = array("i"), array("q", [0])
        ends, steps, fits, bpe, score = self.ends, self.steps, getattr(self, "fits", {}), self.bpe, self.score
        node, last, best = [0], [-1], [0.0]  # by length of the prefix: automaton state, last piece (or -code point - 2), score
        back = [0]
        prev = ""
        for w in words:
            n = len(w)
            k = 0
            for x, y in zip(prev, w):
                if x != y:
                    break
                k += 1
            if len(node) <= n:
                grow = n + 1 - len(node)
                node += [0] * grow
                last += [-1] * grow
                back += [0] * grow
                best += [0.0] * grow
            at = node[k]
            for i in range(k, n):
                ch = w[i]
                nxt = steps[at].get(ch)
                at = self._step(at, ch) if nxt is None else nxt
                e = i + 1
                node[e] = at
                got = False
                if bpe:
                    for t, size in ends[at]:
                        p = last[e - size]
                        if p >= 0:
                            key = p << 20 | t
                            ok = fits.get(key)
                            if ok is None:
                                ok = fits[key] = self._apart(p, t)
                            if not ok:
                                continue
                        last[e] = t
                        back[e] = e - size
                        got = True
                        break
                else:
                    top, pick_t, pick_b = -1e300, 0, 0
                    single = False
                    for t, size in ends[at]:
                        s = best[e - size] + score[t]
                        single |= size == 1
                        if s > top:
                            top, pick_t, pick_b = s, t, e - size
                    if not single and best[i] + self.low > top:
                        top, pick_t, pick_b = best[i] + self.low, -2 - ord(ch), i
                    best[e], last[e], back[e] = top, pick_t, pick_b
                    got = True
                if not got:
                    last[e] = -2 - ord(ch)
                    back[e] = i
            if n:
                out = []
                e = n
                while e > 0:
                    t = last[e]
                    if t >= 0:
                        out.append(t)
                    elif self.bytes:
                        out.extend(self.bytes[b] for b in reversed(chr(-2 - t).encode("utf-8", "replace")))
                    elif not out or out[-1] != self.unk:
                        out.append(self.unk)
                    e = back[e]
                out.reverse()
                flat.extend(out)
            offs.append(len(flat))
            prev = w
        if len(fits) > 4_000_000:
            fits.clear()
        return np.frombuffer(flat, np.int32) if len(flat) else np.zeros(0, np.int32), np.frombuffer(offs, np.int64)

    def marked(self, text: str) -> list[str]:
        """The marked words of a text."""
        if self.squeeze:
            text = re.sub(" +", " ", text.strip(" "))
        if not text:
            return []
        text = text.replace(" ", MARK)
        if self.dummy:
            text = MARK + text
        return _RUN.findall(text) if self.cut else [text]

    def encode(self, text: str | None) -> list[int]:
        ids = [self.encode_words([w])[0] for w in self.marked(text or "")]
        return np.concatenate(ids).tolist() if ids else []

    def encode_batch(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(ids, offsets) of an Arrow string array without nulls."""
        easy = self.cut and self.dummy and not self.squeeze
        if easy:
            odd = pc.or_(pc.or_(pc.match_substring(texts, "  "), pc.starts_with(texts, " ")), pc.or_(pc.match_substring(texts, MARK), pc.equal(texts, "")))
            odd = np.asarray(odd)
        else:
            odd = np.ones(len(texts), bool)
        lists = pc.split_pattern(texts.filter(pa.array(~odd)), " ")
        words = lists.flatten()
        lens = np.diff(np.asarray(lists.offsets).astype(np.int64))
        counts = np.zeros(len(texts), np.int64)
        counts[~odd] = lens
        coded = pc.dictionary_encode(words)
        codes, seen = np.asarray(coded.indices).astype(np.int64), [MARK + w for w in coded.dictionary.to_pylist()]
        if odd.any():
            more, at = {w: i for i, w in enumerate(seen)}, []
            for row in np.flatnonzero(odd):
                own = self.marked(texts[int(row)].as_py())
                counts[row] = len(own)
                at += [more.setdefault(w, len(more)) for w in own]
            seen = list(more)
            starts = np.concatenate([[0], np.cumsum(counts)])
            is_odd = np.repeat(odd, counts)
            both = np.empty(starts[-1], np.int64)
            both[~is_odd] = codes
            both[is_odd] = at
            codes = both
        order = sorted(range(len(seen)), key=seen.__getitem__)
        flat, offs = self.encode_words([seen[i] for i in order])
        first, size = np.empty(len(seen), np.int64), np.empty(len(seen), np.int64)
        first[order], size[order] = offs[:-1], np.diff(offs)
        n = size[codes]
        ends = np.cumsum(n)
        idx = np.arange(ends[-1] if len(ends) else 0) - np.repeat(ends - n - first[codes], n)
        doc_ends = np.concatenate([[0], ends])[np.concatenate([[0], np.cumsum(counts)])]
        return flat[idx], doc_ends

    def decode(self, ids: list[int] | np.ndarray) -> str:
        """Text of ids: marks are spaces, the first one (the dummy prefix) goes; bytes that aren't UTF-8 become U+FFFD."""
        ids = list(ids)
        raw = b"".join(map(self.text.__getitem__, ids))
        if self.dummy and raw[:1] == b" " and ids and self.plain[next((i for i in ids if self.text[i]), ids[0])]:
            raw = raw[1:]
        return raw.decode("utf-8", "replace")


@lru_cache(2)
def codec(model: bytes) -> Codec:
    return Codec(model)


def load_model(path: str = MODEL) -> bytes:
    with open(path, "rb") as f:
        return f.read()


def encode_documents(docs: DataFrame, model_path: str = MODEL, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: doc_id, ids, n_tokens, round_trip (decoding the ids gives the text again).

    Null and empty texts have no ids and round_trip true. Repeated rows give repeated results; a null id
    stays null; other columns are ignored. A text with a literal U+2581 encodes like one with spaces and
    has round_trip false. No shuffle: memory follows the longest text and a few MB of words.
    """
    model = docs.sparkSession.sparkContext.broadcast(load_model(model_path))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(model.value)
        for batch in batches:
            texts = plain(batch.column(1))
            for i, j in chunks(texts):
                part = texts.slice(i, j - i)
                ids, offs = c.encode_batch(part)
                same = [t == c.decode(ids[a:b].tolist()) for t, a, b in zip(part.to_pylist(), offs[:-1], offs[1:])]
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(i, j - i), pa.ListArray.from_arrays(pa.array(offs, pa.int32()), pa.array(ids, pa.int32())), pa.array(np.diff(offs), pa.int32()), pa.array(same)],
                    ["doc_id", "ids", "n_tokens", "round_trip"],
                )

    src = spread(pick(docs, doc_id=id_col, text=text_col))
    out = T.StructType([T.StructField("doc_id", src.schema["doc_id"].dataType), T.StructField("ids", T.ArrayType(T.IntegerType())), T.StructField("n_tokens", T.IntegerType()), T.StructField("round_trip", T.BooleanType())])
    return src.mapInArrow(run, out)


def decode_documents(encoded: DataFrame, model_path: str = MODEL, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """doc_id, text of each row's ids. Null or empty ids give the empty text; ids outside the model fail."""
    model = encoded.sparkSession.sparkContext.broadcast(load_model(model_path))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(model.value)
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([c.decode(x or []) for x in batch.column(1).to_pylist()], pa.string())], ["doc_id", "text"])

    src = pick(encoded, doc_id=id_col, ids=ids_col)
    return src.mapInArrow(run, T.StructType([T.StructField("doc_id", src.schema["doc_id"].dataType), T.StructField("text", T.StringType())]))
