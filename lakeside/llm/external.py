"""Priority queues of records that hold a bounded share in memory and the rest on disk.

Files lie in the executor's own scratch folders (as Spark's shuffle and spill files do),
are unlinked from the start and belong to one task; if an executor is lost, the task runs
again elsewhere from its input.
"""

from __future__ import annotations

import os
import tempfile
from collections.abc import Iterator

import numpy as np


def scratch_file():
    """A new file without a name in a scratch folder that Spark gives its Python workers."""
    dirs = [d for d in os.environ.get("SPARK_LOCAL_DIRS", "").split(",") if os.path.isdir(d)]
    return tempfile.TemporaryFile(dir=dirs[os.getpid() % len(dirs)] if dirs else None)


class Store:
    """Arrays of one record type: in memory up to ``limit`` bytes together, on disk beyond."""

    def __init__(self, dtype: np.dtype, limit: int):
        self.dtype, self.limit = np.dtype(dtype), limit
        self.held = self.on_disk = 0
        self.file = None

    def put(self, records: np.ndarray):
        """A handle for ``get``."""
        if self.held + records.nbytes <= self.limit:
            self.held += records.nbytes
            return records
        if self.file is None:
            self.file = scratch_file()
        self.file.seek(0, 2)
        at = self.file.tell()
        self.file.write(np.ascontiguousarray(records).data)
        self.on_disk += records.nbytes
        return at

    def get(self, handle, start: int, stop: int) -> np.ndarray:
        if isinstance(handle, np.ndarray):
            return handle[start:stop]
        size = self.dtype.itemsize
        self.file.seek(handle + start * size)
        return np.frombuffer(self.file.read((stop - start) * size), self.dtype)

    def close(self) -> None:
        if self.file is not None:
            self.file.close()
            self.file = None


class SortedQueue:
    """Records come in any order and leave in the order of one field, in blocks.

    What exceeds ``limit`` bytes is sorted and written as a run; runs are merged block by
    block: all records up to the smallest last key of the runs' buffers go next.
    """

    def __init__(self, dtype: np.dtype, key: str, limit: int = 48 << 20):
        self.key, self.limit = key, limit
        self.store = Store(dtype, 0)
        self.fresh: list[np.ndarray] = []
        self.size = self.n = 0
        self.runs: list[tuple[int, int]] = []

    def push(self, records: np.ndarray) -> None:
        self.fresh.append(records)
        self.size += records.nbytes
        self.n += len(records)
        if self.size > self.limit:
            run = self._sorted()
            self.runs.append((self.store.put(run), len(run)))

    def _sorted(self) -> np.ndarray:
        run = np.concatenate(self.fresh) if self.fresh else np.zeros(0, self.store.dtype)
        self.fresh, self.size = [], 0
        return run[np.argsort(run[self.key], kind="stable")]

    def blocks(self, size: int = 1 << 16) -> Iterator[np.ndarray]:
        last = self._sorted()
        if not self.runs:
            for at in range(0, len(last), size):
                yield last[at : at + size]
            return
        handles = [*self.runs, (self.store.put(last), len(last))]
        each = max(256, self.limit // (self.store.dtype.itemsize * len(handles)))
        at = [0] * len(handles)
        buffers = [np.zeros(0, self.store.dtype)] * len(handles)
        while True:
            for i, (handle, n) in enumerate(handles):
                if not len(buffers[i]) and at[i] < n:
                    stop = min(at[i] + each, n)
                    buffers[i], at[i] = self.store.get(handle, at[i], stop), stop
            full = [i for i, b in enumerate(buffers) if len(b)]
            if not full:
                break
            # runs that go on bound what may leave; the last records of the others don't
            bound = min((buffers[i][self.key][-1] for i in full if at[i] < handles[i][1]), default=None)
            out = []
            for i in full:
                k = len(buffers[i]) if bound is None else int(np.searchsorted(buffers[i][self.key], bound, "right"))
                out.append(buffers[i][:k])
                buffers[i] = buffers[i][k:]
            merged = np.concatenate(out)
            merged = merged[np.argsort(merged[self.key], kind="stable")]
            for k in range(0, len(merged), size):
                yield merged[k : k + size]
        self.store.close()


def range_minima(a: np.ndarray):
    """A function that gives the minimum of a[i..j] for arrays of i <= j."""
    rows, step = [a], 1
    while 2 * step <= len(a):
        rows.append(np.minimum(rows[-1][: len(rows[-1]) - step], rows[-1][step:]))
        step *= 2

    def least(i: np.ndarray, j: np.ndarray) -> np.ndarray:
        out = np.empty(len(i), a.dtype)
        level = np.log2(j - i + 1).astype(np.int64)
        for k in np.unique(level):
            at = np.flatnonzero(level == k)
            out[at] = np.minimum(rows[k][i[at]], rows[k][j[at] - (1 << int(k)) + 1])
        return out

    return least


#: left: the bytes before a sample; low, high: bytes that its strings may start before it;
#: lcp: bytes in common with the suffix before it in the order; id: number of the tuple.
NO_DOC = np.iinfo(np.int64).max


def tuple_type(width: int) -> np.dtype:
    return np.dtype([("left", "u1", (width,)), ("low", "u1"), ("high", "u1"), ("lcp", "<i2"), ("doc", "<i8"), ("id", "<i8")])


class LevelQueue:
    """Suffixes that start ``x`` bytes before their samples, in lexicographic order.

    They come in the order of the suffixes one byte shorter, so those with the same first
    byte come in their own order: the queue is a bucket for each first byte, kept as runs
    on disk beyond ``limit`` bytes.  Common-prefix lengths are carried along: one more than
    the smallest between two suffixes of the same bucket.  Suffixes with ``length`` bytes
    in common form an interval, which may go on over many runs; its smallest doc_id is
    known once all runs are in.
    """

    def __init__(self, x: int, width: int, length: int, limit: int):
        self.x, self.width, self.length = x, width, length
        self.store = Store(tuple_type(width), limit)
        self.runs: list[tuple[object, np.ndarray]] = []
        self.stats: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        self.since = np.full(256, -1, np.int16)  # smallest lcp since the bucket's last suffix

    def push(self, records: np.ndarray, first_byte: np.ndarray, goes: np.ndarray) -> None:
        """The next suffixes in order; those that ``goes`` says enter the bucket of their first byte."""
        lcp = records["lcp"]
        if not len(lcp):
            return
        at = np.flatnonzero(goes)
        at = at[np.argsort(first_byte[at], kind="stable")]
        c = first_byte[at].astype(np.int64)
        before = np.minimum.accumulate(lcp)
        new = np.r_[True, c[1:] != c[:-1]] if len(c) else np.zeros(0, bool)
        common = np.empty(len(at), np.int16)
        common[new] = np.minimum(self.since[c[new]], before[at[new]])
        rest = np.flatnonzero(~new)
        if len(rest):
            common[rest] = range_minima(lcp)(at[rest - 1] + 1, at[rest])
        after = np.minimum.accumulate(lcp[::-1])[::-1]
        self.since = np.minimum(self.since, before[-1])
        last = np.flatnonzero(np.r_[new[1:], True]) if len(c) else np.zeros(0, np.int64)
        self.since[c[last]] = np.r_[after, np.int16(self.length)][at[last] + 1]
        if not len(at):
            return
        run = records[at]
        run["lcp"] = np.minimum(common + 1, self.length)
        starts = np.searchsorted(c, np.arange(257))
        self.runs.append((self.store.put(run), starts))
        self.stats.append(self._stats(run, c, new))

    def start(self, records: np.ndarray) -> None:
        """The next suffixes of the lowest level, with their lcp; all in one bucket."""
        if len(records):
            new = np.zeros(len(records), bool)
            new[0] = True
            self.runs.append((self.store.put(records), np.r_[0, np.full(256, len(records))]))
            self.stats.append(self._stats(records, np.zeros(len(records), np.int64), new))

    def _doc(self, run: np.ndarray) -> np.ndarray:
        return np.where((run["low"] <= self.x) & (run["high"] >= self.x), run["doc"], NO_DOC)

    def _stats(self, run: np.ndarray, c: np.ndarray, new: np.ndarray):
        """Of each bucket's part of a run: smallest doc up to the first break, from the last one, whether there is one."""
        broken = run["lcp"] < self.length
        cut = np.flatnonzero(broken | new)
        least = np.minimum.reduceat(self._doc(run), cut)
        owner = c[cut]
        first = np.r_[True, owner[1:] != owner[:-1]]
        last = np.r_[first[1:], True]
        head, tail, has = np.full(256, NO_DOC), np.full(256, NO_DOC), np.zeros(256, bool)
        goes_on = first & ~broken[cut]
        head[owner[goes_on]] = least[goes_on]
        tail[owner[last]] = least[last]
        has[c[broken]] = True
        return head, tail, has

    def pop(self, mask: np.ndarray, size: int = 1 << 16) -> Iterator[np.ndarray]:
        """All suffixes in order; sets bit x of ``mask`` where an earlier document has the string."""
        n = len(self.runs)
        before, after = np.full((n + 1, 256), NO_DOC), np.full((n + 1, 256), NO_DOC)
        for k, (head, tail, has) in enumerate(self.stats):
            before[k + 1] = np.where(has, tail, np.minimum(before[k], tail))
        for k in range(n - 1, 0, -1):
            head, tail, has = self.stats[k]
            after[k - 1] = np.where(has, head, np.minimum(head, after[k]))
        held, count = [], 0
        used = np.flatnonzero(np.sum([s[1:] > s[:-1] for _, s in self.runs], axis=0)) if n else []
        bit = np.uint64(1) << np.uint64(self.x)
        for c in used:
            for k, (handle, starts) in enumerate(self.runs):
                if starts[c] == starts[c + 1]:
                    continue
                part = self.store.get(handle, int(starts[c]), int(starts[c + 1]))
                doc = self._doc(part)
                broken = part["lcp"] < self.length
                cut = np.flatnonzero(np.r_[True, broken[1:]])
                least = np.minimum.reduceat(doc, cut)
                if not broken[0]:
                    least[0] = min(least[0], before[k, c])
                least[-1] = min(least[-1], after[k, c])
                worse = (np.repeat(least, np.diff(np.r_[cut, len(part)])) < doc) & (doc != NO_DOC)
                mask[part["id"][worse]] |= bit
                held.append(part)
                count += len(part)
                if count >= size:
                    yield np.concatenate(held)
                    held, count = [], 0
        if held:
            yield np.concatenate(held)
        self.store.close()


def induce(base: Iterator[np.ndarray], mask: np.ndarray, length: int, width: int, limit: int = 48 << 20) -> None:
    """Decides all strings of suffix tuples, from those at the samples to those ``width`` bytes before.

    ``base``: blocks of ``tuple_type`` records in the order of the bytes from the sample on.
    """
    queue = LevelQueue(0, width, length, limit)
    for block in base:
        queue.start(block)
    for x in range(width + 1):
        nxt = LevelQueue(x + 1, width, length, limit)
        for block in queue.pop(mask):
            if x == width:
                continue
            # a suffix whose neighbours differ too early meets no equal string further left
            near = block["lcp"]
            near = np.maximum(near, np.r_[near[1:], np.int16(length)])
            goes = (block["high"] > x) & (near + (width - x) >= length)
            nxt.push(block, block["left"][:, width - x - 1], goes)
        queue = nxt
