"""Removal of byte strings that also start in an earlier document, by external induced sorting.

A tuple for each suffix of a corpus is at least 8 bytes for each of its bytes.  Only prefixes of
``length`` bytes matter here, and most never repeat, so the induction starts from samples:

1. *Sampled suffixes.*  The suffixes that stand at a local minimum of a hash of their
   first ``grain`` bytes are the sample (as the S* suffixes of induced sorting stand at
   local minima of the alphabet).  Every string of ``length`` bytes holds one at a place
   that its own bytes determine.
2. *Reduction.*  The sample is named by the hash of its first bytes.  A name that only one
   document has ends there; the test goes through the cluster's shuffle, each name once a
   bucket of documents, and merges in a queue on disk.
3. *Suffix tuples.*  Of other samples, (bytes before, bytes after, smallest doc_id) go to
   the shard of their name, each distinct tuple once a bucket of documents.
4. *Induction.*  A shard sorts its tuples by the bytes after the sample in a priority queue
   of runs on disk, with the common-prefix length of neighbours.  Suffixes one byte to the
   left are induced from that order: a queue with a bucket for each first byte takes them
   in the order so far, and common-prefix lengths go with them; so on, level by level, to the
   leftmost string of a sample.  Neighbours with ``length`` bytes in common form an
   interval, whose smallest doc_id decides for the tuples in it.
5. Decisions return to their bucket of documents as bit masks.

A queue holds ``queue_bytes`` in memory and the rest in scratch files, so a shard may be
far larger than memory, also where one string that a third of all documents hold fills it
(it is one tuple a bucket).  Shards grow with the square root of the number of buckets.
Shuffles between the steps are Spark's and survive lost executors.

Results: null texts count as empty; matches never cross documents; rows that share a
doc_id never cause each other's removal; rows without a doc_id keep all their bytes; an
empty table gives none; other columns are not read, but for those in ``carry``.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import buckets_for, trim
from .external import SortedQueue, induce, scratch_file, tuple_type
from .hashing import BYTE_VALUES, SHINGLE_FACTORS, Buffer, mix, prefix_sums, window_hashes

NONE = np.iinfo(np.int64).max


def _sliding(a: np.ndarray, width: int, pick) -> np.ndarray:
    """pick (minimum or maximum) over every ``width`` neighbours."""
    n, p = len(a) - width + 1, 1
    if n <= 0:
        return a[:0]
    cur = a
    while p * 2 <= width:
        cur = pick(cur[: len(cur) - p], cur[p:])
        p *= 2
    return pick(cur[:n], cur[width - p : width - p + n])


PLACE_BITS = 28


def samples(buf: Buffer, length: int, grain: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of the documents in ``buf``: place, name, and first and last start of the strings
    of ``length`` bytes that each sampled suffix stands for.

    A string belongs to the leftmost of its smallest names (compared on their upper bits),
    so equal strings belong to samples at the same distance from their start.
    """
    n, width = len(buf.data), length - grain + 1
    found = []
    for lo in range(0, max(n - length + 1, 0), 1 << (PLACE_BITS - 1)):
        data = buf.data[lo : lo + (1 << (PLACE_BITS - 1)) + length - 1]
        names = window_hashes(prefix_sums(data, BYTE_VALUES), grain)
        low_bits = np.uint64((1 << PLACE_BITS) - 1)
        low = _sliding((names & ~low_bits) | np.arange(len(names), dtype=np.uint64), width, np.minimum)
        end = np.searchsorted(buf.offsets, lo, "right")
        stay = np.ones(len(low), bool)  # strings within one document
        for o in buf.offsets[end:-1] - lo:
            if o - length + 1 >= len(low):
                break
            stay[max(0, o - length + 1) : o] = False
        start = np.flatnonzero(stay)
        at = (low[start] & low_bits).astype(np.int64)
        cut = np.flatnonzero(np.r_[True, at[1:] != at[:-1]]) if len(at) else np.zeros(0, np.int64)
        last = np.r_[cut[1:], len(at)] - 1 if len(at) else cut
        found.append((at[cut] + lo, names[at[cut]], start[cut] + lo, start[last] + lo))
    if not found:
        z = np.zeros(0, np.int64)
        return z, np.zeros(0, np.uint64), z, z
    return tuple(np.concatenate(x) for x in zip(*found, strict=True))


def _take(data: np.ndarray, start: np.ndarray, width: int) -> np.ndarray:
    """Matrix of ``width`` bytes from each start; zero beyond the end."""
    idx = start[:, None] + np.arange(width)
    bad = (idx < 0) | (idx >= len(data))
    out = data[np.where(bad, 0, idx)]
    out[bad] = 0
    return out


def _pack(*arrays: np.ndarray, level: int = 1) -> bytes:
    raw = b"".join(np.ascontiguousarray(a).tobytes() for a in arrays)
    return zstandard.ZstdCompressor(level=level).compress(len(arrays[0]).to_bytes(8, "little") + raw)


def _unpack(blob: bytes, *kinds: tuple) -> list[np.ndarray]:
    raw = zstandard.ZstdDecompressor().decompress(blob)
    n, at, out = int.from_bytes(raw[:8], "little"), 8, []
    for dtype, width in kinds:
        size = n * np.dtype(dtype).itemsize * width
        a = np.frombuffer(raw[at : at + size], dtype)
        out.append(a.reshape(n, width) if width > 1 else a)
        at += size
    return out


def _by_shard(names: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Shards that occur and where each starts, for sorted names."""
    key = (names >> np.uint64(64 - bits)).astype(np.int64)
    cut = np.flatnonzero(np.r_[True, key[1:] != key[:-1]]) if len(key) else np.zeros(0, np.int64)
    return key[cut], np.r_[cut, len(key)]


def _bucket(t: pa.Table) -> tuple[Buffer, np.ndarray]:
    """The bucket's texts and doc_ids (missing ones as NONE)."""
    ids = t["doc_id"].fill_null(NONE).to_numpy()
    return Buffer.of(t["text"]), ids


def _bucket_samples(buf: Buffer, ids: np.ndarray, length: int, grain: int, block: int = 1 << 20):
    parts = []
    for lo, hi in buf.blocks(block):
        part, base = buf.part(lo, hi), buf.offsets[lo]
        place, name, first, last = samples(part, length, grain)
        doc = lo + np.searchsorted(part.offsets, place, "right") - 1
        parts.append((place + base, name, first + base, last + base, doc))
    if not parts:
        z = np.zeros(0, np.int64)
        return z, np.zeros(0, np.uint64), z, z, z
    place, name, first, last, doc = (np.concatenate(x) for x in zip(*parts, strict=True))
    keep = ids[doc] != NONE
    return place[keep], name[keep], first[keep], last[keep], doc[keep]


def _tuples(buf: Buffer, ids: np.ndarray, length: int, grain: int, wanted: np.ndarray):
    """Distinct suffix tuples of the bucket's samples with a wanted name, sorted by name.

    Gives (name, context bytes, x_low, x_high, smallest doc_id) of each tuple and, of each
    sample, its tuple, doc and string starts.  x: bytes a string starts before its sample.
    """
    place, name, first, last, doc = _bucket_samples(buf, ids, length, grain)
    if len(wanted):
        at = np.searchsorted(wanted, name)
        at[at == len(wanted)] = 0
        keep = wanted[at] == name
    else:
        keep = np.zeros(len(name), bool)
    place, name, first, last, doc = (a[keep] for a in (place, name, first, last, doc))
    width = length - grain
    x_high, x_low = (place - first).astype(np.uint8), (place - last).astype(np.uint8)
    ctx = _take(buf.data, place - width, width + length)
    # bytes that no string of this sample covers do not belong to the tuple
    col = np.arange(width + length)
    ctx[(col < width - x_high[:, None].astype(np.int64)) | (col >= width - x_low[:, None].astype(np.int64) + length)] = 0
    key = name + x_low.astype(np.uint64) * SHINGLE_FACTORS[14] + x_high.astype(np.uint64) * SHINGLE_FACTORS[13]
    words = np.concatenate([ctx, np.zeros((len(ctx), -ctx.shape[1] % 8), np.uint8)], axis=1).view(np.uint64)
    for k in range(words.shape[1]):
        key = mix(key) + words[:, k] * SHINGLE_FACTORS[k % 12]
    _, lead, which = np.unique(mix(key), return_index=True, return_inverse=True)
    o = np.argsort(name[lead], kind="stable")
    back = np.empty(len(o), np.int64)
    back[o] = np.arange(len(o))
    lead, which = lead[o], back[which]
    least = np.full(len(lead), NONE)
    np.minimum.at(least, which, ids[doc])
    return (name[lead], ctx[lead], x_low[lead], x_high[lead], least), (which, doc, first, last)


NAME = np.dtype([("name", "<u8"), ("bucket", "<i8"), ("many", "u1")])


def _by_bucket(rows: np.ndarray) -> pa.RecordBatch:
    """Names grouped by the bucket that asks for them."""
    rows = rows[np.lexsort((rows["name"], rows["bucket"]))]
    names, bucket = np.ascontiguousarray(rows["name"]), rows["bucket"]
    cut = np.flatnonzero(np.r_[True, bucket[1:] != bucket[:-1]]) if len(rows) else np.zeros(0, np.int64)
    blobs = [_pack(names[i:j]) for i, j in zip(cut, [*cut[1:], len(rows)], strict=True)] if len(rows) else []
    return pa.record_batch([pa.array(bucket[cut], pa.int64()), pa.array(blobs, pa.binary())], ["bucket", "rows"])


def repeated_spans(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = 50, grain: int = 20, bucket_bytes: int = 3 << 20, queue_bytes: int = 32 << 20, carry: tuple[str, ...] = ()) -> DataFrame:
    """Per row of ``docs``: doc_id, n_bytes, spans (array of start, end of the maximal removed runs, in bytes), kept (binary), and with ``carry`` a struct ``row`` of those columns."""
    n_docs = buckets_for(docs, bucket_bytes)
    bits = 3 + ((n_docs - 1).bit_length() + 1) // 2  # shards grow with the square root of the buckets, blobs with the power 3/2
    width = length - grain
    base = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"), *([F.struct(*carry).alias("row")] if carry else []))
    base = base.withColumn("bucket", F.pmod(F.xxhash64("doc_id", F.when(F.col("doc_id").isNull(), F.xxhash64("text"))), F.lit(n_docs)).cast("long")).repartition(n_docs, "bucket")
    suffix = np.dtype([("right", f"S{length}"), *[(c, tuple_type(width)[c].subdtype or tuple_type(width)[c]) for c in ("left", "low", "high", "doc", "id")]])
    tuple_kinds = ((np.uint8, width + length), (np.uint8, 1), (np.uint8, 1), (np.int64, 1))

    def name_runs(t: pa.Table) -> pa.Table:
        trim()
        buf, ids = _bucket(t)
        _, name, _, _, doc = _bucket_samples(buf, ids, length, grain)
        o = np.lexsort((ids[doc], name))
        s, d = name[o], ids[doc][o]
        head = np.r_[True, s[1:] != s[:-1]] if len(s) else np.zeros(0, bool)
        cut = np.flatnonzero(head)
        end = np.r_[cut[1:], len(s)] - 1 if len(s) else cut
        names, many = s[cut], d[end] != d[cut]
        keys, at = _by_shard(names, bits)
        blobs = [_pack(names[i:j], many[i:j].astype(np.uint8)) for i, j in zip(at[:-1], at[1:], strict=True)]
        b = t["bucket"][0].as_py()
        return pa.table({"shard": pa.array(keys, pa.int64()), "bucket": pa.array([b] * len(keys), pa.int64()), "rows": pa.array(blobs, pa.binary())})

    def repeated(key: tuple[pa.Scalar, ...], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The names of a shard that several documents have, back to each bucket with one of them."""
        trim()
        queue = SortedQueue(NAME, "name", queue_bytes)
        for batch in batches:
            for b, blob in zip(batch["bucket"].to_pylist(), batch["rows"], strict=True):
                name, many = _unpack(blob.as_py(), (np.uint64, 1), (np.uint8, 1))
                rows = np.empty(len(name), NAME)
                rows["name"], rows["many"], rows["bucket"] = name, many, b
                queue.push(rows)
        open_name, pending = None, np.zeros(0, NAME)  # a name may go on in the next block
        for block in queue.blocks(1 << 20):
            name = block["name"]
            cut = np.flatnonzero(np.r_[True, name[1:] != name[:-1]])
            count = np.diff(np.r_[cut, len(block)])
            hot = (count > 1) | (np.maximum.reduceat(block["many"], cut) > 0)
            goes_on = open_name is not None and name[0] == open_name
            hot[0] |= goes_on
            keep = block[np.repeat(hot, count)]
            yield _by_bucket(np.concatenate([pending, keep]) if goes_on else keep)
            open_name, pending = name[-1], block[cut[-1] :] if not hot[-1] else block[:0]

    def wanted_of(t: pa.Table) -> np.ndarray:
        return np.sort(np.concatenate([np.zeros(0, np.uint64), *(_unpack(x.as_py(), (np.uint64, 1))[0] for x in t["rows"])]))

    def tuples(key: tuple, d: pa.Table, w: pa.Table) -> pa.Table:
        trim()
        buf, ids = _bucket(d)
        (name, ctx, lo, hi, least), _ = _tuples(buf, ids, length, grain, wanted_of(w))
        keys, at = _by_shard(name, bits)
        blobs = [_pack(ctx[i:j], lo[i:j], hi[i:j], least[i:j], level=3) for i, j in zip(at[:-1], at[1:], strict=True)]
        return pa.table({"shard": pa.array(keys, pa.int64()), "bucket": pa.array([key[0].as_py()] * len(keys), pa.int64()), "start": pa.array(at[:-1], pa.int64()), "rows": pa.array(blobs, pa.binary())})

    def decide(key: tuple[pa.Scalar, ...], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Induction over a shard's suffix tuples, in queues on disk beyond ``queue_bytes``."""
        trim()
        queue = SortedQueue(suffix, "right", queue_bytes)
        runs: list[tuple[int, int, int]] = []
        n = 0
        for batch in batches:
            for b, start, blob in zip(batch["bucket"].to_pylist(), batch["start"].to_pylist(), batch["rows"], strict=True):
                ctx, low, high, least = _unpack(blob.as_py(), *tuple_kinds)
                rows = np.empty(len(ctx), suffix)
                rows["right"] = np.ascontiguousarray(ctx[:, width:]).view(f"S{length}").ravel()
                rows["left"], rows["low"], rows["high"], rows["doc"], rows["id"] = ctx[:, :width], low, high, least, n + np.arange(len(ctx))
                queue.push(rows)
                runs.append((b, start, len(ctx)))
                n += len(ctx)

        def ordered() -> Iterator[np.ndarray]:
            """The tuples with the bytes that each has in common with the one before it."""
            last = None
            for block in queue.blocks():
                right = np.ascontiguousarray(block["right"]).view(np.uint8).reshape(-1, length)
                differs = right != np.concatenate([right[:1] if last is None else last, right[:-1]])
                out = np.empty(len(block), tuple_type(width))
                for c in ("left", "low", "high", "doc", "id"):
                    out[c] = block[c]
                out["lcp"] = np.where(differs.any(axis=1), differs.argmax(axis=1), length)
                if last is None:
                    out["lcp"][0] = 0
                last = right[-1:]
                yield out

        mask = np.zeros(n, np.uint64) if 8 * n <= queue_bytes else np.memmap(scratch_file(), np.uint64, "w+", shape=(n,))
        induce(ordered(), mask, length, width, queue_bytes)
        at = 0
        for b, start, size in runs:
            part = np.array(mask[at : at + size])
            at += size
            yield pa.record_batch([pa.array([b], pa.int64()), pa.array([start], pa.int64()), pa.array([_pack(part)], pa.binary())], ["bucket", "start", "rows"])

    names = base.groupBy("bucket").applyInArrow(name_runs, "shard long, bucket long, rows binary")
    wanted = names.repartition(1 << bits, "shard").groupBy("shard").applyInArrow(repeated, "bucket long, rows binary")
    docs_by_bucket = base.groupBy("bucket")
    sent = docs_by_bucket.cogroup(wanted.groupBy("bucket")).applyInArrow(tuples, "shard long, bucket long, start long, rows binary")
    masks = sent.repartition(1 << bits, "shard").groupBy("shard").applyInArrow(decide, "bucket long, start long, rows binary")
    # one cogroup takes two sides: names and masks of a bucket travel as one, told apart by start
    notes = wanted.withColumn("start", F.lit(-1).cast("long")).select("bucket", "start", "rows").unionByName(masks)

    def cut_out(key: tuple, d: pa.Table, notes: pa.Table) -> pa.Table:
        trim()
        buf, ids = _bucket(d)
        start = notes["start"].to_numpy()
        asked = notes.filter(pa.array(start < 0))
        got = notes.filter(pa.array(start >= 0))
        (_, _, _, hi, least), (which, doc, first, last) = _tuples(buf, ids, length, grain, wanted_of(asked))
        mask = np.zeros(len(least), np.uint64)
        for s, x in zip(got["start"].to_pylist(), got["rows"], strict=True):
            part = _unpack(x.as_py(), (np.uint64, 1))[0]
            mask[s : s + len(part)] = part
        delta = np.zeros(len(buf.data) + 1, np.int64)
        if len(which):
            own = ids[doc] == least[which]
            # a smaller doc_id in this very bucket has the whole tuple: all strings of the sample go
            np.add.at(delta, first[~own], 1)
            np.add.at(delta, last[~own] + length, -1)
            place = first + hi[which]
            bits_of = mask[which]
            for x in range(width + 1):
                hit = np.flatnonzero(own & ((bits_of >> np.uint64(x)) & np.uint64(1)).astype(bool))
                np.add.at(delta, place[hit] - x, 1)
                np.add.at(delta, place[hit] - x + length, -1)
        return _results(d, buf, np.cumsum(delta[:-1]) > 0)

    out = "doc_id long, n_bytes long, spans array<struct<start:long,end:long>>, kept binary"
    if carry:
        out += f", row {base.schema['row'].dataType.simpleString()}"
    return docs_by_bucket.cogroup(notes.groupBy("bucket")).applyInArrow(cut_out, out)


def _results(d: pa.Table, buf: Buffer, gone: np.ndarray) -> pa.Table:
    """Rows of a bucket with their spans and kept bytes, given the bytes that go."""
    n, size = len(buf.offsets) - 1, len(gone)
    cut = np.zeros(size + 1, bool)
    cut[buf.offsets] = True
    begin, stop = gone.copy(), gone.copy()
    if size:
        begin[1:] &= ~gone[:-1] | cut[1:size]
        stop[:-1] &= ~gone[1:] | cut[1:size]
    begin, stop = np.flatnonzero(begin), np.flatnonzero(stop) + 1
    doc = np.searchsorted(buf.offsets, begin, "right") - 1
    at = np.r_[0, np.cumsum(np.bincount(doc, minlength=n))]
    base = buf.offsets[doc]
    spans = pa.ListArray.from_arrays(pa.array(at, pa.int32()), pa.StructArray.from_arrays([pa.array(begin - base, pa.int64()), pa.array(stop - base, pa.int64())], ["start", "end"]))
    raw = buf.data[~gone].tobytes()
    kept_at = np.r_[0, np.cumsum(~gone)][buf.offsets]
    kept = pa.array([raw[i:j] for i, j in zip(kept_at[:-1], kept_at[1:], strict=True)], pa.binary())
    out = {"doc_id": d["doc_id"], "n_bytes": pa.array(np.diff(buf.offsets), pa.int64()), "spans": spans, "kept": kept}
    return pa.table(out | {"row": d["row"]} if "row" in d.column_names else out)
