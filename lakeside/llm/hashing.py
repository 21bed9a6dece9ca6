"""Vectorised hashing of words, word shingles and byte windows.

All functions work on the concatenated bytes of many documents at once, so
their cost is a few numpy passes over the buffer however short the documents
are.  A prefix polynomial modulo 2**64 gives the hash of every substring in
constant time; ``mix`` then spreads the bits.  Hashes are 64 bits wide.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa

_rng = np.random.default_rng(20240817)
#: One random 64-bit value per byte value.
BYTE_VALUES = _rng.integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
#: The same with A-Z folded onto a-z.
FOLDED_VALUES = BYTE_VALUES.copy()
FOLDED_VALUES[65:91] = BYTE_VALUES[97:123]
BASE = 0x9E3779B97F4A7C15 | 5
BASE = (BASE & ~0x7) | 5
_INV = pow(BASE, -1, 2**64)
SHINGLE_FACTORS = _rng.integers(1, 2**63, 16, dtype=np.uint64) * np.uint64(2) + np.uint64(1)

_powers: dict[int, np.ndarray] = {}
KEPT_POWERS = 1 << 22


def _power_table(base: int, n: int) -> np.ndarray:
    """base**0 .. base**(n-1) modulo 2**64, kept for the next call."""
    have = _powers.get(base)
    if have is None or len(have) < n:
        size = -(-max(n, 1) // (1 << 18)) * (1 << 18)
        have = np.ones(size, np.uint64)
        done = 1
        while done < size:
            step = np.uint64(pow(base, done, 2**64))
            have[done : 2 * done] = have[: min(done, size - done)] * step
            done *= 2
        if size <= KEPT_POWERS:
            _powers[base] = have
    return have[:n]


def mix(h: np.ndarray) -> np.ndarray:
    """A bijection on 64 bits that makes every output bit depend on every input bit."""
    h = h ^ (h >> np.uint64(30))
    h *= np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(27)
    h *= np.uint64(0x94D049BB133111EB)
    h ^= h >> np.uint64(31)
    return h


class Buffer:
    """The bytes of several documents, one after the other.

    ``offsets[i] : offsets[i + 1]`` are the bytes of document ``i``.
    """

    def __init__(self, data: np.ndarray, offsets: np.ndarray):
        self.data, self.offsets = data, offsets

    @classmethod
    def of(cls, column: pa.Array) -> Buffer:
        """Of an Arrow string or binary column; null counts as empty."""
        if isinstance(column, pa.ChunkedArray):
            column = column.combine_chunks()
            if isinstance(column, pa.ChunkedArray):
                column = pa.concat_arrays(column.chunks)
        if pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type):
            kind, column = np.int64, column.cast(pa.large_binary())
        else:
            kind, column = np.int32, column.cast(pa.binary())
        if column.null_count:
            column = column.fill_null(b"")
        if not len(column):
            return cls(np.zeros(0, np.uint8), np.zeros(1, np.int64))
        _, offsets, data = column.buffers()
        offsets = np.frombuffer(offsets, kind, len(column) + 1, column.offset * np.dtype(kind).itemsize).astype(np.int64)
        data = np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]] if data is not None else np.zeros(0, np.uint8)
        return cls(data, offsets - offsets[0])

    def blocks(self, limit: int) -> list[tuple[int, int]]:
        """Runs of documents of about ``limit`` bytes each; a longer document is a run of its own."""
        out, lo, n = [], 0, len(self.offsets) - 1
        while lo < n:
            hi = max(lo + 1, int(np.searchsorted(self.offsets, self.offsets[lo] + limit, "right")) - 1)
            out.append((lo, hi))
            lo = hi
        return out

    def part(self, lo: int, hi: int) -> Buffer:
        return Buffer(self.data[self.offsets[lo] : self.offsets[hi]], self.offsets[lo : hi + 1] - self.offsets[lo])


def prefix_sums(data: np.ndarray, values: np.ndarray) -> np.ndarray:
    """S with S[j] - S[i] the polynomial of bytes i..j-1, scaled by BASE**i."""
    out = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(values[data] * _power_table(BASE, len(data)), out=out[1:])
    return out


def span_hashes(sums: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Hash of each span of bytes, the same wherever the span stands."""
    inv = _power_table(_INV, len(sums))
    return mix((sums[end] - sums[start]) * inv[start])


def window_hashes(sums: np.ndarray, width: int) -> np.ndarray:
    """Hash of the ``width`` bytes at every position that has so many."""
    n = len(sums) - width
    return mix((sums[width:] - sums[:n]) * _power_table(_INV, len(sums))[:n]) if n > 0 else np.zeros(0, np.uint64)


def words_of(buf: Buffer) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end of every maximal run of bytes other than ASCII white space
    (0x20, 0x09-0x0D) within a document, and of each document its first word's index
    (one more entry than documents)."""
    data, n = buf.data, len(buf.data)
    if not n:
        z = np.zeros(0, np.int64)
        return z, z, np.zeros(len(buf.offsets), np.int64)
    inside = ~((data == 32) | ((data >= 9) & (data <= 13)))
    cut = np.zeros(n + 1, bool)
    cut[buf.offsets] = True
    begin = inside.copy()
    begin[1:] &= ~inside[:-1] | cut[1:n]
    stop = inside.copy()
    stop[:-1] &= ~inside[1:] | cut[1:n]
    start, end = np.flatnonzero(begin), np.flatnonzero(stop) + 1
    return start, end, np.searchsorted(start, buf.offsets)


def shingle_sets(buf: Buffer, width: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """Distinct ``width``-word shingles of each document, A-Z folded to a-z.

    Fewer words than ``width``: the whole sequence is one shingle; no words: none.
    Gives (hashes sorted within each document, offsets).
    """
    start, end, first = words_of(buf)
    n_docs = len(buf.offsets) - 1
    if not len(start):
        return np.zeros(0, np.uint64), np.zeros(n_docs + 1, np.int64)
    words = span_hashes(prefix_sums(buf.data, FOLDED_VALUES), start, end)
    count = np.diff(first)
    doc = np.repeat(np.arange(n_docs), count)
    n = max(0, len(words) - width + 1)
    h = np.zeros(n, np.uint64)
    for k in range(width):
        h += words[k : k + n] * SHINGLE_FACTORS[k]
    keep = doc[:n] == doc[width - 1 :] if n else np.zeros(0, bool)
    h, owner = mix(h[keep]), doc[:n][keep]
    short = np.flatnonzero((count > 0) & (count < width))
    if len(short):
        extra = np.zeros(len(short), np.uint64)
        for k in range(width - 1):
            has = count[short] > k
            extra[has] += words[first[short][has] + k] * SHINGLE_FACTORS[k]
        extra = mix(extra + count[short].astype(np.uint64) * SHINGLE_FACTORS[15])
        h, owner = np.concatenate([h, extra]), np.concatenate([owner, short])
    order = np.lexsort((h, owner))
    h, owner = h[order], owner[order]
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (owner[1:] != owner[:-1])
    h, owner = h[new], owner[new]
    return h, np.searchsorted(owner, np.arange(n_docs + 1))
