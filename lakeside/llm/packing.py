"""Bounded-space online packing of token sequences into windows of a fixed size.

Each partition keeps a fixed number of open windows.  A document's full windows go out at
once; what is left of it goes to the fullest window that has room (best fit).  If none
has, a new window is opened, or, with all in use, the fullest is filled with a first piece
of the document and emitted (just emitted, if its gap is under ``least_cut``).  At the end
of a partition its open windows are merged end to end, which leaves at most one short
window; those are merged in groups, in rounds, until one is left in all.

Results: null texts have only the end id; each id lies in one piece; repeated rows are
packed each on its own, as are rows without a doc_id; an empty table gives no piece.
"""

from __future__ import annotations

import math
import zlib
from bisect import bisect_left, insort
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bpe import text_blocks
from .common import keyed, spread, trim, written
from .word_cache import encoder

PIECE = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64()), ("doc_tokens", pa.int64()), ("sequence_id", pa.int64()), ("offset", pa.int64()), ("part", pa.int64()), ("ids", pa.binary())])
PIECE_DDL = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, part long, ids binary"


class Packer:
    """Pieces are [doc_id, start, ids (u4 array), doc_tokens]; ``emit`` gets a closed window's pieces."""

    def __init__(self, size: int, n_open: int, least_cut: int, emit):
        self.size, self.n_open, self.least_cut, self.emit = size, n_open, least_cut, emit
        self.open: list[tuple[int, int]] = []  # (room, window), sorted
        self.held: dict[int, list] = {}
        self.next = 0

    def add(self, doc_id, ids: np.ndarray) -> None:
        total, at = len(ids), 0
        while total - at >= self.size:
            self.emit([[doc_id, at, ids[at : at + self.size], total]])
            at += self.size
        while at < total:
            need = total - at
            k = bisect_left(self.open, (need, -1))
            if k < len(self.open):
                room, w = self.open.pop(k)
                self.held[w].append([doc_id, at, ids[at:], total])
                if room == need:
                    self.emit(self.held.pop(w))
                else:
                    insort(self.open, (room - need, w))
                return
            if len(self.open) < self.n_open:
                w, self.next = self.next, self.next + 1
                self.held[w] = [[doc_id, at, ids[at:], total]]
                insort(self.open, (self.size - need, w))
                return
            room, w = self.open.pop(0)  # the fullest
            if room >= self.least_cut:
                self.held[w].append([doc_id, at, ids[at : at + room], total])
                at += room
            self.emit(self.held.pop(w))

    def rest(self) -> list:
        """Pieces of all open windows, the fullest window first."""
        return [p for _, w in self.open for p in self.held[w]]


def end_to_end(pieces: list, size: int, emit) -> list:
    """Pieces laid end to end and cut at every ``size`` ids; the pieces of the last, short window."""
    window, used = [], 0
    for doc, start, ids, total in pieces:
        at = 0
        while at < len(ids):
            n = min(size - used, len(ids) - at)
            window.append([doc, start + at, ids[at : at + n], total])
            used, at = used + n, at + n
            if used == size:
                emit(window)
                window, used = [], 0
    return window


class _Rows:
    """Collects windows as rows of PIECE."""

    def __init__(self, first_id: int):
        self.id, self.rows = first_id, []

    def window(self, pieces: list) -> None:
        offset = 0
        for doc, start, ids, total in pieces:
            self.rows.append((doc, start, len(ids), zlib.crc32(ids.astype("<u4").tobytes()), total, self.id, offset, None, None))
            offset += len(ids)
        self.id += 1

    def left(self, pieces: list, part: int) -> None:
        for doc, start, ids, total in pieces:
            self.rows.append((doc, start, len(ids), None, total, None, None, part, ids.astype("<u4").tobytes()))

    def take(self) -> pa.RecordBatch:
        cols = list(zip(*self.rows, strict=True)) if self.rows else [[] for _ in PIECE]
        self.rows = []
        return pa.record_batch([pa.array(c, f.type) for c, f in zip(cols, PIECE, strict=True)], schema=PIECE)


def _merger(level: int, last: bool, size: int):
    """Merges the short windows of a group of partitions; of the last group, emits the remainder too."""

    def merge(key: tuple, t: pa.Table) -> pa.Table:
        group = key[0].as_py()
        t = t.sort_by([("part", "ascending"), ("doc_id", "ascending"), ("start", "ascending")])
        pieces = [[d, s, np.frombuffer(i, "<u4"), n] for d, s, i, n in zip(*(t[c].to_pylist() for c in ("doc_id", "start", "ids", "doc_tokens")), strict=True)]
        rows = _Rows((1 << 62) + (level << 54) + (group << 22))
        short = end_to_end(pieces, size, rows.window)
        if last and short:
            rows.window(short)
        else:
            rows.left(short, group)
        return pa.Table.from_batches([rows.take()])

    return merge


def pack_documents(docs: DataFrame, tokenizer_path: str, end_id: int, size: int = 2048, n_open: int = 64, least_cut: int = 16, kept_words: int = 600_000, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset of every piece.

    sequence_id: 2**32 * partition + number in it; of merged windows, 2**62 + round * 2**54 + 2**22 * group + number.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(tokenizer_path, kept_words)
        kind = np.dtype("<u2" if enc.width == 2 else "<u4")
        end = np.array([end_id], "<u4")
        part = TaskContext.get().partitionId()
        rows = _Rows(part << 32)
        packer = Packer(size, n_open, least_cut, rows.window)
        for batch in batches:
            ids = batch.column(0).to_pylist()
            for first, texts in text_blocks(batch.column(1)):
                for doc, packed in zip(ids[first : first + len(texts)], enc.encode(texts), strict=True):
                    packer.add(doc, np.concatenate([np.frombuffer(packed, kind).astype("<u4"), end]))
                yield rows.take()
        rows.left(end_to_end(packer.rest(), size, rows.window), part)
        yield rows.take()
        trim()

    first = written(spread(keyed(docs, id_col, text_col)).mapInArrow(run, PIECE_DDL))
    done = [first.filter(F.col("sequence_id").isNotNull())]
    left = first.filter(F.col("sequence_id").isNull())
    fan, level = 64, 0
    top = left.agg(F.max("part")).first()[0]
    groups = 0 if top is None else top + 1
    while groups > 0:
        level += 1
        groups = math.ceil(groups / fan)
        last = groups == 1

        merged = written(left.withColumn("group", F.floor(F.col("part") / fan)).groupBy("group").applyInArrow(_merger(level, last, size), PIECE_DDL))
        done.append(merged.filter(F.col("sequence_id").isNotNull()))
        left = merged.filter(F.col("sequence_id").isNull())
        if last:
            break
    out = done[0]
    for d in done[1:]:
        out = out.unionByName(d)
    return out.drop("part", "ids")
