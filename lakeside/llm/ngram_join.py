"""Exact Jaccard similarity join of documents on word shingles, as a metric-space join.

Distance is 1 - Jaccard, a metric.  Unrelated texts lie at distance about 1 from each
other and from every pivot, so regions around pivots drawn from the whole corpus
would, with windows as wide as twice the threshold, hold the whole corpus each.  The
space is therefore first cut, without loss, where the metric is informative:

1. ``profile``: each document's shingle set gets a 128-bit signature; equal sets are one
   point from here on.
2. ``points_and_cells``: two sets within the threshold share at least one of the first
   ``n - ceil(t n) + 1`` shingles of each under any common order.  The order is rarest
   first, by exact counts of points (sorted runs of 48-bit keys, counted in shards), so
   that hot phrases come last and shingles of one point need not be sent at all.  A cell
   is the points that share such a shingle, its pivot its smallest point, and a region is
   the union of the cells of one pivot.  Every link lies within a region.
   A point of n that meets another first at its i-th shingle shares at most n - i + 1 with it,
   so only points that some partner in the cell allows for by size stay: near misses of
   one text, all of which differ in their rare shingles, leave here, at linear cost.
3. ``regions``: a region is split by pivots into Voronoi regions; points within twice the
   threshold of a border are copied to both sides; of the ball that a pivot links, only
   points stay that the triangle inequality lets link a point outside; each side is
   joined recursively and exactly, until it is one linked class.  Pivots come from
   outside the largest class and, their distances known, leave; where borders would copy
   most points, the region stays one without them.  Regions beyond ``region_limit``
   points take these steps spread over tasks, each with copies of the pivots, and never
   meet in one task.
4. Links are contracted to the smallest id by alternating large-star
   and small-star rounds.

Results: a null or blank text has an empty set and no link; repeated rows and equal sets
share a component; with fewer words than a shingle the whole sequence is one shingle.
"""

from __future__ import annotations

import itertools
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators.graph import connected_components
from .common import buckets_for, keyed, spread, trim, written
from .external import SortedQueue, range_minima
from .hashing import Buffer, mix, shingle_sets

BLOCK = 1 << 20


def _least_common(n: np.ndarray, num: int, den: int) -> np.ndarray:
    """Length of the prefix of a set of n that every partner within num/den must meet."""
    return np.where(n > 0, n - (n * num + den - 1) // den + 1, 0)


def _signatures(h: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two 63-bit sums over each set, in mixed form; 0 for the empty set."""
    out = []
    size = np.diff(off)
    for salt in (0x1234567, 0x9ABCDEF01):
        m = mix(h ^ np.uint64(salt)) if len(h) else h
        total = np.zeros(len(h) + 1, np.uint64)
        np.cumsum(m, out=total[1:])
        s = mix(total[off[1:]] - total[off[:-1]]) >> np.uint64(1)
        out.append(np.where(size > 0, s, np.uint64(0)).astype(np.int64))
    return out[0], out[1]


def profile(docs: DataFrame, width: int = 5) -> DataFrame:
    """doc_id, n_shingles, sig_a, sig_b of each document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            buf = Buffer.of(batch.column(1))
            for lo, hi in buf.blocks(BLOCK):
                h, off = shingle_sets(buf.part(lo, hi), width)
                a, b = _signatures(h, off)
                yield pa.record_batch([batch.column(0).slice(lo, hi - lo), pa.array(np.diff(off)), pa.array(a), pa.array(b)], ["doc_id", "n_shingles", "sig_a", "sig_b"])
        trim()

    return spread(docs).mapInArrow(run, "doc_id long, n_shingles long, sig_a long, sig_b long")


def _is_in(h: np.ndarray, sorted_values: np.ndarray) -> np.ndarray:
    if not len(sorted_values):
        return np.zeros(len(h), bool)
    at = np.searchsorted(sorted_values, h)
    at[at == len(sorted_values)] = 0
    return sorted_values[at] == h


def _distinct_rows(pairs: np.ndarray) -> np.ndarray:
    o = np.lexsort(pairs.T)
    p = pairs[o]
    new = np.ones(len(p), bool)
    new[1:] = (p[1:] != p[:-1]).any(axis=1)
    return np.ascontiguousarray(p[new])


COUNT = np.dtype([("key", "<u8"), ("bucket", "<i8"), ("n", "<i8")])
KEY_SHIFT = np.uint64(16)  # 48 bits of a shingle's hash are its key in counts


def _run_blob(keys: np.ndarray, extra: np.ndarray) -> bytes:
    """Sorted keys as differences, bytes of equal weight together, then ``extra`` (2 bytes each)."""
    step = np.diff(keys, prepend=np.uint64(0))
    planes = np.ascontiguousarray(step.view(np.uint8).reshape(-1, 8)[:, :6].T)
    return zstandard.ZstdCompressor(level=1).compress(len(keys).to_bytes(8, "little") + planes.tobytes() + extra.astype("<u2").tobytes())


def _run_of(blob: bytes) -> tuple[np.ndarray, np.ndarray]:
    raw = zstandard.ZstdDecompressor().decompress(blob)
    n = int.from_bytes(raw[:8], "little")
    step = np.zeros((n, 8), np.uint8)
    step[:, :6] = np.frombuffer(raw, np.uint8, 6 * n, 8).reshape(6, n).T
    return np.cumsum(step.view(np.uint64).ravel()), np.frombuffer(raw, "<u2", n, 8 + 6 * n)


def points_and_cells(docs: DataFrame, classes: DataFrame, num: int, den: int, width: int = 5, bucket_bytes: int = 3 << 20, queue_bytes: int = 32 << 20) -> tuple[DataFrame, DataFrame]:
    """Regions as (pivot_a, pivot_b, sig_a, sig_b), a pivot with a row of its own, and
    (sig_a, sig_b, shingles) of every point in one.

    ``classes``: sig_a, sig_b, rep of every point, rep being a doc_id with that set.
    """
    n_buckets = buckets_for(docs, bucket_bytes)
    bits = 3 + ((n_buckets - 1).bit_length() + 1) // 2  # shards grow with the square root of the buckets

    def bucket(c: str):
        return F.pmod(F.xxhash64(c), F.lit(n_buckets)).cast("long")

    by_bucket = docs.filter("doc_id is not null").withColumn("bucket", bucket("doc_id")).repartition(n_buckets, "bucket").groupBy("bucket")
    note = "bucket long, rep long, sig_a long, sig_b long, rows binary"
    none = [F.lit(None).cast(t).alias(c) for c, t in (("rep", "long"), ("sig_a", "long"), ("sig_b", "long"))]
    reps = classes.select(bucket("rep").alias("bucket"), "rep", "sig_a", "sig_b", F.lit(None).cast("binary").alias("rows"))

    def members(d: pa.Table, notes: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Shingles, offsets and signatures of the points whose text is in this bucket."""
        notes = notes.filter(notes["rep"].is_valid())
        want = set(zip(notes["sig_a"].to_pylist(), notes["sig_b"].to_pylist(), notes["rep"].to_pylist(), strict=True))
        ids = d["doc_id"].to_pylist()
        buf = Buffer.of(d["text"])
        hs, sizes, sa, sb = [np.zeros(0, np.uint64)], [], [], []
        for lo, hi in buf.blocks(BLOCK):
            h, off = shingle_sets(buf.part(lo, hi), width)
            a, b = _signatures(h, off)
            for i in range(hi - lo):
                key = (int(a[i]), int(b[i]), ids[lo + i])
                if key in want:
                    want.discard(key)  # a repeated row is no second point
                    hs.append(h[off[i] : off[i + 1]])
                    sizes.append(off[i + 1] - off[i])
                    sa.append(a[i])
                    sb.append(b[i])
        return np.concatenate(hs), np.r_[0, np.cumsum(np.array(sizes, np.int64))].astype(np.int64), np.array(sa, np.int64), np.array(sb, np.int64)

    def cut_by_shard(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        shard = (keys >> np.uint64(48 - bits)).astype(np.int64)
        at = np.flatnonzero(np.r_[True, shard[1:] != shard[:-1]]) if len(keys) else np.zeros(0, np.int64)
        return shard[at], np.r_[at, len(keys)]

    def count_runs(key: tuple, d: pa.Table, notes: pa.Table) -> pa.Table:
        trim()
        h, _, _, _ = members(d, notes)
        keys, n = np.unique(h >> KEY_SHIFT, return_counts=True)
        shard, at = cut_by_shard(keys)
        n = np.minimum(n, 65535)
        return pa.table({"shard": pa.array(shard, pa.int64()), "bucket": pa.array([key[0].as_py()] * len(shard), pa.int64()), "rows": pa.array([_run_blob(keys[i:j], n[i:j]) for i, j in zip(at[:-1], at[1:], strict=True)], pa.binary())})

    def common(key: tuple[pa.Scalar, ...], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """To each bucket, the counts over all buckets of its shingles that more than one point has."""
        trim()
        queue = SortedQueue(COUNT, "key", queue_bytes)
        for batch in batches:
            for b, blob in zip(batch["bucket"].to_pylist(), batch["rows"], strict=True):
                keys, n = _run_of(blob.as_py())
                rows = np.empty(len(keys), COUNT)
                rows["key"], rows["n"], rows["bucket"] = keys, n, b
                queue.push(rows)
        held = np.zeros(0, COUNT)  # rows of a key that may go on in the next block, one a bucket
        for block in itertools.chain(queue.blocks(1 << 18), [None]):
            rows = held if block is None else np.concatenate([held, block])
            if not len(rows):
                continue
            head = np.flatnonzero(np.r_[True, rows["key"][1:] != rows["key"][:-1]])
            stop = len(rows) if block is None else int(head[-1])
            held, rows, head = rows[stop:], rows[:stop], head[head < stop]
            total = np.repeat(np.add.reduceat(rows["n"], head), np.diff(np.r_[head, len(rows)])) if len(head) else np.zeros(0, np.int64)
            rows, total = rows[total > 1], np.minimum(total[total > 1], 65535)
            o = np.argsort(rows["bucket"], kind="stable")
            rows, total = rows[o], total[o]
            at = np.flatnonzero(np.r_[True, rows["bucket"][1:] != rows["bucket"][:-1]]) if len(rows) else np.zeros(0, np.int64)
            keys = np.ascontiguousarray(rows["key"])
            yield pa.record_batch([pa.array(rows["bucket"][at], pa.int64()), pa.array([_run_blob(keys[i:j], total[i:j]) for i, j in zip(at, [*at[1:], len(rows)], strict=False)], pa.binary())], ["bucket", "rows"])

    def counted(notes: pa.Table) -> tuple[np.ndarray, np.ndarray]:
        runs = [_run_of(x.as_py()) for x in notes["rows"] if x.is_valid]
        keys, n = (np.concatenate(x) for x in zip(*runs, strict=True)) if runs else (np.zeros(0, np.uint64), np.zeros(0, np.uint16))
        o = np.argsort(keys, kind="stable")
        return keys[o], n[o].astype(np.int64)

    def postings(key: tuple, d: pa.Table, notes: pa.Table) -> pa.Table:
        trim()
        h, off, a, b = members(d, notes)
        keys, n = counted(notes)
        size = np.diff(off)
        owner = np.repeat(np.arange(len(size)), size)
        df = np.ones(len(h), np.int64)
        if len(keys):
            at = np.searchsorted(keys, h >> KEY_SHIFT)
            at[at == len(keys)] = 0
            df = np.where(keys[at] == h >> KEY_SHIFT, n[at], 1)
        o = np.lexsort((h, df, owner))
        place = np.arange(len(h)) - off[:-1][owner]
        rank = np.empty(len(h), np.int64)
        rank[o] = place
        take = o[(place < _least_common(size, num, den)[owner]) & (df[o] > 1)]
        take = take[np.argsort(h[take], kind="stable")]
        shard, at = cut_by_shard(h[take] >> KEY_SHIFT)
        fit = ((size[owner[take]].astype(np.uint64) << np.uint64(32)) | rank[take].astype(np.uint64))
        blobs = [np.concatenate([h[take[i:j]], a[owner[take[i:j]]].view(np.uint64), b[owner[take[i:j]]].view(np.uint64), fit[i:j]]).tobytes() for i, j in zip(at[:-1], at[1:], strict=True)]
        return pa.table({"shard": pa.array(shard, pa.int64()), "rows": pa.array(blobs, pa.binary())})

    def meet(t: pa.Table) -> pa.Table:
        trim()
        parts = [np.frombuffer(x.as_py(), np.uint64).reshape(4, -1) for x in t["rows"]]
        h, a, b, fit = np.concatenate(parts, axis=1)
        order = np.lexsort((b, a, h))
        h, a, b, fit = h[order], a[order], b[order], fit[order]
        n, place = (fit >> np.uint64(32)).astype(np.int64), (fit & np.uint64(0xFFFFFFFF)).astype(np.int64)
        fits = may_link(h, n, partner_limit(n, place, num, den), num, den)
        h, a, b = h[fits], a[fits], b[fits]
        if not len(h):
            return pa.table({"shard": pa.array([], pa.int64()), "rows": pa.array([], pa.binary())})
        first = np.flatnonzero(np.r_[True, h[1:] != h[:-1]])
        count = np.diff(np.r_[first, len(h)])
        many = np.repeat(count > 1, count)
        head = np.repeat(first, count)[many]
        pairs = np.stack([a[head], b[head], a[many], b[many]], axis=1).view(np.int64)
        pairs = _distinct_rows(pairs)
        # a pair that many shards found meets itself again in the shard of its own hash
        shard = (mix(pairs[:, 0].view(np.uint64) ^ mix(pairs[:, 2].view(np.uint64).copy())) >> np.uint64(64 - bits)).astype(np.int64)
        o = np.argsort(shard, kind="stable")
        shard, pairs = shard[o], pairs[o]
        at = np.flatnonzero(np.r_[True, shard[1:] != shard[:-1]]) if len(shard) else np.zeros(0, np.int64)
        return pa.table({"shard": pa.array(shard[at], pa.int64()), "rows": pa.array([pairs[i:j].tobytes() for i, j in zip(at, np.r_[at[1:], len(shard)], strict=False)], pa.binary())})

    def merge(t: pa.Table) -> pa.Table:
        pairs = _distinct_rows(np.concatenate([np.frombuffer(x.as_py(), np.int64).reshape(-1, 4) for x in t["rows"]]))
        return pa.table({k: np.ascontiguousarray(pairs[:, i]) for i, k in enumerate(("pivot_a", "pivot_b", "sig_a", "sig_b"))})

    def shingles(d: pa.Table, notes: pa.Table) -> pa.Table:
        trim()
        h, off, a, b = members(d, notes)
        return pa.table({"sig_a": pa.array(a, pa.int64()), "sig_b": pa.array(b, pa.int64()), "shingles": pa.array([h[i:j].tobytes() for i, j in zip(off[:-1], off[1:], strict=True)], pa.binary())})

    def with_notes(rows: DataFrame) -> DataFrame:
        return reps.unionByName(rows.select("bucket", *none, "rows")).select(*[x.split()[0] for x in note.split(", ")])

    runs = by_bucket.cogroup(reps.groupBy("bucket")).applyInArrow(count_runs, "shard long, bucket long, rows binary")
    known = runs.repartition(1 << bits, "shard").groupBy("shard").applyInArrow(common, "bucket long, rows binary")
    sent = by_bucket.cogroup(with_notes(known).groupBy("bucket")).applyInArrow(postings, "shard long, rows binary")
    found = sent.repartition(1 << bits, "shard").groupBy("shard").applyInArrow(meet, "shard long, rows binary")
    pairs = found.groupBy("shard").applyInArrow(merge, "pivot_a long, pivot_b long, sig_a long, sig_b long")
    live = pairs.select("sig_a", "sig_b").distinct().join(reps, ["sig_a", "sig_b"]).select("bucket", "rep", "sig_a", "sig_b")
    sets = by_bucket.cogroup(live.groupBy("bucket")).applyInArrow(shingles, "sig_a long, sig_b long, shingles binary")
    # one table, so that the texts are dealt to buckets once for all of it
    both = written(pairs.withColumn("shingles", F.lit(None).cast("binary")).unionByName(sets.withColumns({c: F.lit(None).cast("long") for c in ("pivot_a", "pivot_b")})))
    return both.filter("shingles is null").drop("shingles"), both.filter("shingles is not null").drop("pivot_a", "pivot_b")


# --- the join within a region ------------------------------------------------------------------


def _common(sets: list[np.ndarray], pivot: np.ndarray) -> np.ndarray:
    """Size of each set's intersection with the pivot."""
    size = np.array([len(s) for s in sets])
    hit = _is_in(np.concatenate(sets), pivot)
    total = np.r_[0, np.cumsum(hit)]
    end = np.cumsum(size)
    return total[end] - total[end - size]


class Metric:
    """Distances as exact fractions: x and y link when den * common >= num * union."""

    def __init__(self, num: int, den: int):
        self.num, self.den, self.reach = num, den, (den - num) / den

    def to(self, sets: list[np.ndarray], pivot: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        common = _common(sets, pivot)
        union = np.array([len(s) for s in sets]) + len(pivot) - common
        return 1 - common / np.maximum(union, 1), self.den * common >= self.num * union


EPS = 1e-9


def partner_limit(n: np.ndarray, place: np.ndarray, num: int, den: int) -> np.ndarray:
    """Largest set that may link with one of n whose first common shingle is its ``place``-th in the common order."""
    return (num + den) * (n - place) // num - n


def may_link(cell: np.ndarray, n: np.ndarray, limit: np.ndarray, num: int, den: int) -> np.ndarray:
    """Which points of each cell (a number, in runs) have a partner in it by size: each within the other's limit."""
    out = np.zeros(len(n), bool)
    big = np.int64(1) << 32
    cut = np.flatnonzero(np.r_[True, cell[1:] != cell[:-1]]) if len(cell) else np.zeros(0, np.int64)
    steps = np.searchsorted(cut, np.arange(0, len(cell), 1 << 17))  # whole cells, about so many points at a time
    pieces = np.unique(np.r_[0, cut[steps[steps < len(cut)]], len(cell)]).astype(np.int64)
    for lo, hi in zip(pieces[:-1], pieces[1:], strict=True):
        c, m, top = cell[lo:hi].astype(np.int64), n[lo:hi].astype(np.int64), limit[lo:hi].astype(np.int64)
        c = np.cumsum(np.r_[0, c[1:] != c[:-1]]) * big
        o = np.argsort(c + m, kind="stable")
        key, m, top = (c + m)[o], m[o], top[o]
        first = np.searchsorted(key, c[o] + (m * num + den - 1) // den)
        last = np.searchsorted(key, c[o] + np.maximum(top, 0), "right") - 1
        most = _range_maxima(top)
        at = np.arange(len(m))
        ok = np.zeros(len(m), bool)
        for i, j in ((first, np.minimum(last, at - 1)), (np.maximum(first, at + 1), last)):
            has = np.flatnonzero(i <= j)
            ok[has] |= most(i[has], j[has]) >= m[has]
        out[lo + o[ok]] = True
    return out


def _range_maxima(a: np.ndarray):
    least = range_minima(-a)
    return lambda i, j: -least(i, j)


def _worth_joining(sets: list[np.ndarray], metric: Metric) -> list[int]:
    """Points of a region that share one of their rarest shingles there with one they may link with."""
    size = np.array([len(s) for s in sets])
    h, owner = np.concatenate(sets), np.repeat(np.arange(len(sets)), size)
    _, which, count = np.unique(h, return_inverse=True, return_counts=True)
    o = np.lexsort((which, count[which], owner))
    place = np.arange(len(h)) - np.r_[0, np.cumsum(size)[:-1]][owner]
    keep = (place < _least_common(size, metric.num, metric.den)[owner]) & (count[which[o]] > 1)
    cell, point, place = which[o][keep], owner[o][keep], place[keep]
    o = np.argsort(cell, kind="stable")
    cell, point, place = cell[o], point[o], place[o]
    n = size[point]
    return np.unique(point[may_link(cell, n, partner_limit(n, place, metric.num, metric.den), metric.num, metric.den)]).tolist()


def join_region(sets: list[np.ndarray], metric: Metric, n_pivots: int = 10, counts: Counter | None = None) -> list[tuple[int, int]]:
    """Links among sorted distinct arrays that connect exactly what all links connect.

    Pivots are the points farthest from one another outside the largest linked class.  Their
    distances to all points give their links, and they leave.  The others go to the
    Voronoi regions of the pivots and, within twice the threshold of a border, to both
    sides; regions that share most of their points stay one.  Each is joined in the same
    way until it is one class.  ``counts`` gathers what happened.
    """
    parent = list(range(len(sets)))
    counts = Counter() if counts is None else counts

    def root(i: int) -> int:
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    links: list[tuple[int, int]] = []

    def link(i: int, j: int) -> None:
        a, b = root(i), root(j)
        if a != b:
            parent[max(a, b)] = min(a, b)
            links.append((i, j))

    stack = [_worth_joining(sets, metric)] if len(sets) > 1 else []
    counts["points"] += len(sets)
    counts["points joined"] += len(stack[0]) if stack else 0
    while stack:
        members = stack.pop()
        cls = np.array([root(i) for i in members])
        names, size = np.unique(cls, return_counts=True)
        if len(names) < 2:
            continue
        outside = np.flatnonzero(cls != names[np.argmax(size)]) if size.max() > 1 else np.arange(len(members))
        at = [sets[i] for i in members]
        counts["regions"] += 1
        far = np.full(len(members), np.inf)
        pivots, dist, ball = [], [], []
        nxt = int(outside[0])
        for _ in range(min(n_pivots, 2 + len(outside) // 8)):
            d, near = metric.to(at, at[nxt])
            pivots.append(nxt)
            dist.append(d)
            ball.append(near)
            for j in np.flatnonzero(near):
                link(members[nxt], members[j])
            far = np.minimum(far, d)
            far[nxt] = -1
            nxt = int(outside[np.argmax(far[outside])])
            if far[nxt] <= 0:
                break
        counts["pivots"] += len(pivots)
        rest = np.ones(len(members), bool)
        rest[pivots] = False
        if not rest.any():
            continue
        d, ball = np.array(dist), np.array(ball)
        sides = (d <= d.min(axis=0) + 2 * metric.reach + EPS) & rest
        shared = sides.astype(np.int64) @ sides.T
        group = list(range(len(pivots)))
        for i in range(len(group)):
            for j in range(i):
                if 2 * shared[i, j] > min(shared[i, i], shared[j, j]):
                    old, new = group[i], group[j]
                    group = [new if g == old else g for g in group]
        merged = [np.flatnonzero(np.array(group) == g) for g in sorted(set(group))]
        wholes = [sides[m].any(axis=0) for m in merged]
        if sum(w.sum() for w in wholes) > 1.5 * rest.sum():
            merged, wholes = [np.arange(len(pivots))], [rest]
        counts["regions split"] += len(wholes) > 1
        counts["points copied"] += int(sum(w.sum() for w in wholes) - rest.sum())
        for m, side in zip(merged, wholes, strict=True):
            if len(m) == 1:
                out = side & ~ball[m[0]]
                if not out.any():
                    continue
                # triangle inequality: a point of the ball can link one outside only this near its border
                side = out | side & ball[m[0]] & (d[m[0]] >= d[m[0]][out].min() - metric.reach - EPS)
            stack.append([members[i] for i in np.flatnonzero(side)])
    return links


def _classes_from(names: int):
    def classes(t: pa.Table) -> pa.Table:
        """Of each region: class number of every pivot and every older class."""
        up: dict = {}

        def top(i):
            up.setdefault(i, i)
            while up[i] != i:
                i = up[i]
            return i

        for x, y, o in zip(t["x"].to_pylist(), t["y"].to_pylist(), t["old"].to_pylist(), strict=True):
            a, b = top(("h", x)), top(("h", y) if y is not None else ("o", o))
            up[max(a, b)] = min(a, b)
        number = {r: names + n for n, r in enumerate(sorted({top(i) for i in list(up)}))}
        got = [(i, number[top(i)]) for i in up]
        return pa.table({"pivot_a": [t["pivot_a"][0].as_py()] * len(got), "pivot_b": [t["pivot_b"][0].as_py()] * len(got), "head": [i[1] if i[0] == "h" else None for i, _ in got], "old": [i[1] if i[0] == "o" else None for i, _ in got], "new": [n for _, n in got]}, schema=pa.schema([("pivot_a", pa.int64()), ("pivot_b", pa.int64()), ("head", pa.int32()), ("old", pa.int64()), ("new", pa.int64())]))

    return classes


def regions(pairs: DataFrame, sets: DataFrame, num: int, den: int, region_limit: int = 1000) -> DataFrame:
    """Links (src_a, src_b, dst_a, dst_b) within all regions.

    ``sets``: sig_a, sig_b, shingles (binary, little-endian unsigned 64-bit, sorted).
    """
    metric = Metric(num, den)
    link_schema = "src_a long, src_b long, dst_a long, dst_b long"
    arrow_link = pa.schema([(k, pa.int64()) for k in ("src_a", "src_b", "dst_a", "dst_b")])

    def arrays(t: pa.Table, name: str = "shingles") -> list[np.ndarray]:
        return [np.frombuffer(x.as_buffer(), np.uint64) for x in t.column(name)]

    def leaf(t: pa.Table) -> pa.Table:
        s, a, b = arrays(t), t["sig_a"].to_pylist(), t["sig_b"].to_pylist()
        found = join_region(s, metric)
        return pa.table([[a[i] for i, _ in found], [b[i] for i, _ in found], [a[j] for _, j in found], [b[j] for _, j in found]], schema=arrow_link)

    def sized(p: DataFrame) -> DataFrame:
        return p.groupBy("pivot_a", "pivot_b").agg(F.count(F.lit(1)).alias("points"))

    key = ["pivot_a", "pivot_b"]
    large = written(sized(pairs).filter(F.col("points") > region_limit))
    links = pairs.join(large, key, "left_anti").join(sets, ["sig_a", "sig_b"]).groupBy(key).applyInArrow(leaf, link_schema)
    rest = pairs.join(large.drop("points"), key).withColumn("cls", F.lit(None).cast("long"))
    heads_each, names = 32, 0
    while not large.isEmpty():
        # Every point that is not in its region's largest class is a pivot in turn; with
        # its distances to all points known, it is done.  Distances are taken in tasks of
        # region_limit points, each with a copy of this round's pivots.
        parts = large.select(*key, F.floor(F.col("points") / region_limit).cast("int").alias("parts"))
        order = Window.partitionBy(*key).orderBy(F.xxhash64("sig_a", "sig_b"), "sig_a", "sig_b")
        pivots = rest.join(large.select(*key, "largest"), key) if "largest" in large.columns else rest.withColumn("largest", F.lit(None).cast("long"))
        pivots = pivots.filter(F.col("cls").isNull() | ~F.col("cls").eqNullSafe(F.col("largest"))).withColumn("head", F.row_number().over(order) - 1).filter(F.col("head") < heads_each)
        pivots = written(pivots.select(*key, "sig_a", "sig_b", "cls", "head"))
        copies = pivots.join(parts, key).join(sets, ["sig_a", "sig_b"]).withColumn("salt", F.explode(F.sequence(F.lit(0), F.col("parts"))))
        points = rest.join(pivots.select(*key, "sig_a", "sig_b"), [*key, "sig_a", "sig_b"], "left_anti").join(parts, key).join(sets, ["sig_a", "sig_b"])
        points = points.withColumn("head", F.lit(None).cast("int")).withColumn("salt", F.pmod(F.xxhash64("sig_a", "sig_b"), F.col("parts") + 1).cast("int"))
        cols = [*key, "salt", "sig_a", "sig_b", "cls", "head", "shingles"]
        tasks = copies.select(cols).unionByName(points.select(cols))

        def step(t: pa.Table) -> pa.Table:
            trim()
            head = t["head"].to_pylist()
            s = arrays(t)
            near_of: list[list[int]] = [[] for _ in s]
            which = [j for j, k in enumerate(head) if k is not None]
            dist = np.empty((len(which), len(s)))
            for row, j in enumerate(which):
                dist[row], near = metric.to(s, s[j])
                for i in np.flatnonzero(near):
                    if i != j:
                        near_of[i].append(head[j])
            sides = dist <= dist.min(axis=0) + 2 * metric.reach + EPS
            name = np.array([head[j] for j in which])
            side_of = [name[sides[:, i]].tolist() if k is None else [] for i, k in enumerate(head)]
            return t.drop(["shingles", "salt"]).append_column("near", pa.array(near_of, pa.list_(pa.int32()))).append_column("sides", pa.array(side_of, pa.list_(pa.int32())))

        measured = written(tasks.groupBy(*key, "salt").applyInArrow(step, "pivot_a long, pivot_b long, sig_a long, sig_b long, cls long, head int, near array<int>, sides array<int>"))
        hits = measured.filter(F.size("near") > 0)
        named = pivots.select(*key, "head", F.col("sig_a").alias("src_a"), F.col("sig_b").alias("src_b"))
        # one link per point, and one between any two pivots that a point or an older class ties together
        one = hits.select(*key, F.col("near")[0].alias("head"), F.col("sig_a").alias("dst_a"), F.col("sig_b").alias("dst_b"))
        links = links.unionByName(one.join(named, [*key, "head"]).select("src_a", "src_b", "dst_a", "dst_b"))
        ties = hits.select(*key, F.col("near")[0].alias("x"), F.explode("near").alias("y")).filter("x <> y").distinct()
        links = links.unionByName(ties.join(named.withColumnRenamed("head", "x"), [*key, "x"]).join(named.select(*key, F.col("head").alias("y"), F.col("src_a").alias("dst_a"), F.col("src_b").alias("dst_b")), [*key, "y"]).select("src_a", "src_b", "dst_a", "dst_b"))
        old = hits.filter("cls is not null").select(*key, F.col("cls").alias("old"), F.col("near")[0].alias("x")).distinct()

        names += 1 << 20  # class numbers of different rounds differ

        pairs_of = ties.select(*key, "x", "y", F.lit(None).cast("long").alias("old")).unionByName(old.select(*key, "x", F.lit(None).cast("int").alias("y"), "old")).unionByName(pivots.select(*key, F.col("head").alias("x"), F.col("head").alias("y"), F.lit(None).cast("long").alias("old")))
        new = written(pairs_of.groupBy(*key).applyInArrow(_classes_from(names), "pivot_a long, pivot_b long, head int, old long, new long"))
        stay = measured.filter("head is null").select(*key, "sig_a", "sig_b", "cls", "sides", F.when(F.size("near") > 0, F.col("near")[0]).alias("head"))
        stay = stay.join(new.filter("head is not null").select(*key, "head", F.col("new").alias("by_head")), [*key, "head"], "left").join(new.filter("old is not null").select(*key, F.col("old").alias("cls"), F.col("new").alias("by_old")), [*key, "cls"], "left")
        # an older class that met no pivot keeps its name
        stay = stay.select(*key, "sig_a", "sig_b", F.coalesce("by_head", "by_old", "cls").alias("cls"), "sides")
        # Voronoi regions with their borders' points on both sides, unless most points are near borders
        copies = measured.filter("head is null").groupBy(*key).agg((F.sum(F.size("sides")) <= 1.5 * F.count(F.lit(1))).alias("splits"))
        stay = stay.join(copies, key).withColumn("side", F.explode(F.when(F.col("splits"), F.col("sides")).otherwise(F.array(F.lit(-1)))))
        side_key = [F.when(F.col("splits"), F.xxhash64(*c)).otherwise(F.col(k)).alias(k) for k, c in (("pivot_a", ("pivot_a", "pivot_b", "side")), ("pivot_b", ("side", "pivot_b", "pivot_a")))]
        rest = written(stay.select(*side_key, "sig_a", "sig_b", "cls"))
        count = rest.groupBy(*key).agg(F.count(F.lit(1)).alias("points"))
        top = rest.filter("cls is not null").groupBy(*key, "cls").count().groupBy(*key).agg(F.max_by("cls", F.struct("count", "cls")).alias("largest"), F.max("count").alias("held"))
        left = written(count.join(top, key, "left").filter(F.col("points") > F.coalesce("held", F.lit(0))))
        small, large = left.filter(F.col("points") <= region_limit), left.filter(F.col("points") > region_limit)
        links = links.unionByName(rest.join(small.select(*key), key).join(sets, ["sig_a", "sig_b"]).groupBy(key).applyInArrow(leaf, link_schema))
        rest = rest.join(large.select(*key), key)
        heads_each = 400
    return links


def similar_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", num: int = 75, den: int = 100, width: int = 5, region_limit: int = 1000) -> DataFrame:
    """doc_id, n_shingles, component_id of every row of ``docs``.

    Two documents link when den * |intersection| >= num * |union| of their shingle sets;
    component_id is the smallest doc_id reachable by links, itself included.  Rows with a
    null id keep a null component.
    """
    base = keyed(docs, id_col, text_col)
    per_doc = written(profile(base, width))
    classes = written(per_doc.filter("n_shingles > 0 and doc_id is not null").groupBy("sig_a", "sig_b").agg(F.min("doc_id").alias("rep")))
    pairs, sets = points_and_cells(base, classes, num, den, width)
    links = written(regions(pairs, sets, num, den, region_limit))
    ids = links.join(classes.select(F.col("sig_a").alias("src_a"), F.col("sig_b").alias("src_b"), F.col("rep").alias("src")), ["src_a", "src_b"]).join(classes.select(F.col("sig_a").alias("dst_a"), F.col("sig_b").alias("dst_b"), F.col("rep").alias("dst")), ["dst_a", "dst_b"])
    comp = connected_components(ids.select(F.col("src").alias("src_chunk"), F.col("dst").alias("dst_chunk")))
    named = classes.join(comp, classes["rep"] == comp["node"], "left").select("sig_a", "sig_b", F.coalesce("component", "rep").alias("found"))
    return per_doc.join(named, ["sig_a", "sig_b"], "left").select("doc_id", "n_shingles", F.when(F.col("doc_id").isNotNull() & (F.col("n_shingles") > 0), F.col("found")).otherwise(F.col("doc_id")).alias("component_id"))

