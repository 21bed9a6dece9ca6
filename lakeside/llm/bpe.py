"""Byte-level BPE by corpus-level merge replay.

The words (matches of the split pattern) of a block of documents form one vocabulary.
An inverted index lists, for each merge that some pair of neighbouring tokens allows,
the positions of those pairs.  Merges are applied in rank order to all their positions,
and each application updates the index entries of the two touched neighbours only.
Words are independent of each other, so replaying block by block gives the same ids as
one replay over all words; blocks run in parallel, keep no global vocabulary, and a word
already replayed in the same worker is not replayed again.

Results: a null text counts as empty and has no ids; every row keeps its own result, an empty table has
none, and other columns are not read.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator
from heapq import heapify, heappop, heappush

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from .common import keyed, spread

SHIFT = 24
BLOCK_CHARS = 1 << 20
KEPT_WORDS = 400_000


def load_ranks(path: str) -> list[bytes]:
    """The tokens of a rank file, by rank."""
    with open(path, "rb") as f:
        ranks = {int(rank): base64.b64decode(token) for token, rank in map(bytes.split, f)}
    if sorted(ranks) != list(range(len(ranks))):
        raise ValueError("ranks are not consecutive")
    return [ranks[i] for i in range(len(ranks))]


class MergeReplay:
    def __init__(self, tokens: list[bytes]):
        self.rank = rank = {t: i for i, t in enumerate(tokens)}
        self.single = np.array([rank[bytes([b])] for b in range(256)])
        #: Of each pair of tokens, the rank of the token they form.
        self.pairs = {(rank[t[:k]] << SHIFT) | rank[t[k:]]: i for t, i in rank.items() for k in range(1, len(t)) if t[:k] in rank and t[k:] in rank}
        #: The rank of each two bytes, -1 if they form no token.
        self.doubles = np.array([[rank.get(bytes([a, b]), -1) for b in range(256)] for a in range(256)])

    def _start(self, words: list[bytes]) -> tuple[list[int], np.ndarray, dict[int, list[int]]]:
        """Tokens of the words' single bytes, -1 after each word, where those stand, and the positions of each merge's pairs."""
        ends = np.cumsum(np.array([len(w) + 1 for w in words], np.int64)) - 1
        raw = np.frombuffer(b"\0".join([*words, b""]), np.uint8)
        sym = self.single[raw]
        sym[ends] = -1
        first = self.doubles[raw[:-1], raw[1:]]
        first[(sym[:-1] < 0) | (sym[1:] < 0)] = -1
        at = np.flatnonzero(first >= 0)
        at = at[np.argsort(first[at], kind="stable")]
        ranks = first[at]
        cuts = np.flatnonzero(np.diff(ranks, prepend=-1)).tolist()
        spots = at.tolist()
        index = {r: spots[i:j] for r, i, j in zip(ranks[cuts].tolist(), cuts, [*cuts[1:], len(spots)], strict=True)}
        return sym.tolist(), ends, index

    def encode(self, words: list[bytes]) -> list[list[int]]:
        """Ids of each word."""
        return [np.frombuffer(x, "<u4").tolist() for x in self.packed(words)]

    def packed(self, words: list[bytes]) -> list[bytes]:
        """Ids of each word, little-endian unsigned 32-bit."""
        if not words:
            return []
        pairs = self.pairs
        sym, ends, index = self._start(words)
        n = len(sym)
        nxt = list(range(1, n + 1))
        prv = list(range(-1, n - 1))
        heap = list(index)
        heapify(heap)
        while heap:
            r = heappop(heap)
            spots = index.pop(r, None)
            if spots is None:
                continue
            spots.sort()
            for k, p in enumerate(spots):
                a = sym[p]
                q = nxt[p]
                if a < 0 or sym[q] < 0 or pairs.get(a << SHIFT | sym[q]) != r:
                    continue  # an earlier merge took one of the two
                after = nxt[q]
                sym[p], sym[q], nxt[p], prv[after] = r, -2, after, p
                lower = False
                b = sym[after]
                if b >= 0:
                    t = pairs.get(r << SHIFT | b)
                    if t is not None:
                        lower = t < r
                        if t in index:
                            index[t].append(p)
                        else:
                            index[t] = [p]
                            heappush(heap, t)
                before = prv[p]
                if before >= 0 and sym[before] >= 0:
                    t = pairs.get(sym[before] << SHIFT | r)
                    if t is not None:
                        lower = lower or t < r
                        if t in index:
                            index[t].append(before)
                        else:
                            index[t] = [before]
                            heappush(heap, t)
                if lower and k + 1 < len(spots):
                    # a merge of lower rank has come up: it goes first, the rest of this one later
                    index[r] = spots[k + 1 :] + index.get(r, [])
                    heappush(heap, r)
                    break
        left = np.array(sym)
        kept = left >= 0
        data = left[kept].astype("<u4").tobytes()
        stops = (4 * np.cumsum(kept)[ends]).tolist()
        return [data[i:j] for i, j in zip([0, *stops], stops, strict=False)]


_loaded: dict[str, tuple] = {}


def _replay(path: str) -> tuple[MergeReplay, dict[str, bytes]]:
    """The tables of a rank file and the words replayed so far in this worker."""
    if path not in _loaded:
        _loaded[path] = (MergeReplay(load_ranks(path)), {})
    return _loaded[path]


def text_blocks(column: pa.Array, limit: int = BLOCK_CHARS) -> Iterator[tuple[int, list[str]]]:
    """(first row, texts) of runs of rows with about ``limit`` characters; nulls as empty."""
    block, first, size = [], 0, 0
    for i, x in enumerate(column):
        t = x.as_py() or ""
        block.append(t)
        size += len(t)
        if size >= limit:
            yield first, block
            block, first, size = [], i + 1, 0
    if block:
        yield first, block


def encode_documents(docs: DataFrame, ranks_path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and ids (binary: little-endian unsigned 32-bit) of every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        replay, known = _replay(ranks_path)
        find = regex.compile(pattern).findall
        for batch in batches:
            for first, texts in text_blocks(batch.column(1)):
                split = [find(t) for t in texts]
                every = set().union(*split)
                new = list(every.difference(known))
                if len(known) + len(new) > KEPT_WORDS:
                    recurring = {w: known[w] for w in every.intersection(known)}  # the rest was seen in earlier blocks only
                    known.clear()
                    known.update(recurring)
                raw = [w.encode() for w in new]
                whole = [replay.rank.get(b) for b in raw]
                todo = [i for i, r in enumerate(whole) if r is None]
                known.update(zip([new[i] for i in todo], replay.packed([raw[i] for i in todo]), strict=True))
                for w, r in zip(new, whole, strict=True):
                    if r is not None:
                        known[w] = r.to_bytes(4, "little")
                ids = [b"".join(map(known.__getitem__, s)) for s in split]
                yield pa.record_batch([batch.column(0).slice(first, len(texts)), pa.array(ids, pa.binary())], ["doc_id", "ids"])

    return spread(keyed(docs, id_col, text_col)).mapInArrow(run, "doc_id long, ids binary")


def decode_documents(encoded: DataFrame, ranks_path: str) -> DataFrame:
    """The rows of ``encoded`` (doc_id, ids) with the bytes that the ids stand for."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens = list(_replay(ranks_path)[0].rank)
        size = np.array([len(t) for t in tokens])
        begin = np.r_[0, np.cumsum(size)[:-1]]
        table = np.frombuffer(b"".join(tokens), np.uint8)
        for batch in batches:
            out = []
            for x in batch.column(1):
                ids = np.frombuffer(x.as_buffer(), "<u4") if x.is_valid else np.zeros(0, np.uint32)
                n = size[ids]
                end = np.cumsum(n)
                at = np.arange(end[-1] if len(end) else 0) + np.repeat(begin[ids] - end + n, n)
                out.append(table[at].tobytes())
            yield pa.record_batch([*batch.columns, pa.array(out, pa.binary())], ["doc_id", "ids", "decoded"])

    return encoded.select("doc_id", "ids").mapInArrow(run, "doc_id long, ids binary, decoded binary")
