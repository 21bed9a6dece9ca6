"""Token ids in length-delimited binary files with masked checksums and an offset index.

A file: the 8 bytes ``LSTOK1`` + width + 0, then records.  A record: payload length
(unsigned 64-bit), masked crc32 of those 8 bytes, payload, masked crc32 of the payload.
A payload: doc_id (signed 64-bit), then the ids with ``width`` bytes each.  All numbers
are little-endian.  Beside each file, ``.idx`` has the offset of every record (unsigned
64-bit), for reads in any order.

Documents are range-partitioned by doc_id and each partition writes its documents in
order, rolling to a new file at ``file_bytes``.  A task writes under names of its own
attempt; only files listed in the manifest, which Spark commits, count.

Results: null texts have only the end id; rows that share a doc_id are ordered by text; a
null doc_id comes first (stored as the smallest 64-bit number); an empty table gives no file.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .bpe import text_blocks
from .common import buckets_for, keyed, shared_dir, written
from .word_cache import encoder

MAGIC = b"LSTOK1"
NO_ID = np.iinfo(np.int64).min


def masked_crc(data: bytes) -> int:
    """crc32 rotated by 15 bits plus a constant, so that a checksum of data with checksums stays sound."""
    c = zlib.crc32(data)
    return ((c >> 15 | c << 17) + 0xA282EAD8) & 0xFFFFFFFF


def frame(payload: bytes) -> bytes:
    head = struct.pack("<Q", len(payload))
    return b"".join((head, struct.pack("<I", masked_crc(head)), payload, struct.pack("<I", masked_crc(payload))))


def open_folder(uri: str) -> tuple[pyarrow.fs.FileSystem, str]:
    return pyarrow.fs.FileSystem.from_uri(uri if "://" in uri or uri.startswith("file:") else "file://" + uri)


def read_records(data: bytes, offsets: Iterator[int] | None = None) -> Iterator[tuple[int, np.ndarray]]:
    """(doc_id, ids) of a file's records, all in order or those at ``offsets``; raises if a checksum is wrong."""
    if data[:6] != MAGIC:
        raise ValueError("not a token file")
    kind = np.dtype("<u2" if data[6] == 2 else "<u4")

    def one(at: int) -> tuple[tuple[int, np.ndarray], int]:
        n, check = struct.unpack_from("<QI", data, at)
        if masked_crc(data[at : at + 8]) != check:
            raise ValueError(f"length at {at} is damaged")
        payload = data[at + 12 : at + 12 + n]
        if masked_crc(payload) != struct.unpack_from("<I", data, at + 12 + n)[0]:
            raise ValueError(f"record at {at} is damaged")
        return (struct.unpack_from("<q", payload)[0], np.frombuffer(payload, kind, offset=8)), at + n + 16

    if offsets is not None:
        for at in offsets:
            yield one(int(at))[0]
        return
    at = 8
    while at < len(data):
        got, at = one(at)
        yield got


def write_token_files(docs: DataFrame, tokenizer_path: str, end_id: int, folder: str, id_col: str = "doc_id", text_col: str = "text", file_bytes: int = 16 << 20, partition_bytes: int = 8 << 20, kept_words: int = 900_000) -> DataFrame:
    """Writes all documents below ``folder`` and gives the manifest: file, part, piece, n_docs, n_tokens, start."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(tokenizer_path, kept_words)
        end = int(end_id).to_bytes(enc.width, "little")
        ctx = TaskContext.get()
        part, attempt = ctx.partitionId(), ctx.taskAttemptId()
        fs, base = open_folder(folder)
        fs.create_dir(base, recursive=True)
        schema = pa.schema([("file", pa.string()), ("part", pa.int64()), ("piece", pa.int64()), ("n_docs", pa.int64()), ("n_tokens", pa.int64())])
        held: list[bytes] = []
        offsets: list[int] = []
        size, tokens, piece = 8, 0, 0

        def close() -> pa.RecordBatch:
            name = f"tokens-{part:06d}-{attempt}-{piece:05d}.bin"
            with fs.open_output_stream(f"{base}/{name}") as f:
                f.write(MAGIC + bytes([enc.width, 0]))
                f.write(b"".join(held))
            with fs.open_output_stream(f"{base}/{name}.idx") as f:
                f.write(np.array(offsets, "<u8").tobytes())
            return pa.record_batch([[name], [part], [piece], [len(held)], [tokens]], schema)

        for batch in batches:
            ids = batch.column(0).fill_null(NO_ID).to_pylist()
            for first, texts in text_blocks(batch.column(1)):
                for doc, packed in zip(ids[first : first + len(texts)], enc.encode(texts), strict=True):
                    record = frame(struct.pack("<q", doc) + packed + end)
                    offsets.append(size)
                    held.append(record)
                    size += len(record)
                    tokens += len(packed) // enc.width + 1
                    if size >= file_bytes:
                        yield close()
                        held, offsets, size, tokens, piece = [], [], 8, 0, piece + 1
        if held:
            yield close()

    base = keyed(docs, id_col, text_col)
    ordered = base.repartitionByRange(buckets_for(docs, partition_bytes, 1), "doc_id").sortWithinPartitions("doc_id", "text")
    manifest = written(ordered.mapInArrow(run, "file string, part long, piece long, n_docs long, n_tokens long"))
    # a file's place among all ids: within a group of parts, then among the groups (a row each)
    manifest = manifest.withColumn("group", F.floor(F.col("part") / 1024))
    groups = manifest.groupBy("group").agg(F.sum("n_tokens").alias("tokens"))
    base = groups.select("group", F.coalesce(F.sum("tokens").over(Window.orderBy("group").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("base"))
    before = Window.partitionBy("group").orderBy("part", "piece").rowsBetween(Window.unboundedPreceding, -1)
    return manifest.withColumn("start", F.coalesce(F.sum("n_tokens").over(before), F.lit(0))).join(base, "group").withColumn("start", F.col("start") + F.col("base")).drop("group", "base")


def read_token_files(manifest: DataFrame, folder: str) -> DataFrame:
    """doc_id, start (ids of all documents before it), n_tokens, ids (binary, little-endian unsigned 32-bit), from the files."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, base = open_folder(folder)
        for batch in batches:
            for name, start, n_docs in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                with fs.open_input_stream(f"{base}/{name}") as f:
                    data = f.read()
                with fs.open_input_stream(f"{base}/{name}.idx") as f:
                    offsets = np.frombuffer(f.read(), "<u8")
                if len(offsets) != n_docs:
                    raise ValueError(f"{name}: index and manifest differ")
                for lo in range(0, len(offsets), 512):
                    got = list(read_records(data, offsets[lo : lo + 512]))
                    n = np.array([len(x) for _, x in got])
                    at = start + np.cumsum(n) - n
                    start += int(n.sum())
                    yield pa.record_batch([pa.array([None if d == NO_ID else d for d, _ in got], pa.int64()), pa.array(at), pa.array(n), pa.array([x.astype("<u4").tobytes() for _, x in got], pa.binary())], ["doc_id", "start", "n_tokens", "ids"])

    files = manifest.select("file", "start", "n_docs")
    return files.repartition(max(1, min(4096, files.count())), "file").mapInArrow(run, "doc_id long, start long, n_tokens long, ids binary")


def token_output(docs: DataFrame, tokenizer_path: str, end_id: int, **options) -> tuple[DataFrame, DataFrame]:
    """Writes and rereads: (manifest, documents as read back)."""
    folder = shared_dir(docs.sparkSession)
    manifest = written(write_token_files(docs, tokenizer_path, end_id, folder, **options))
    return manifest, read_token_files(manifest, folder)
