"""Counts over the words, characters and lines of many documents at once."""

from __future__ import annotations

import numpy as np

from .hashing import BYTE_VALUES, SHINGLE_FACTORS, Buffer, mix, prefix_sums, span_hashes, words_of

SYMBOLS = b"#*$%&|<>"


def _class(chars: bytes) -> np.ndarray:
    t = np.zeros(256, bool)
    t[list(chars)] = True
    return t


_CLASSES = {
    "symbols": _class(SYMBOLS),
    "upper": _class(bytes(range(65, 91))),
    "letters": _class(bytes(range(65, 91)) + bytes(range(97, 123))),
    "digits": _class(b"0123456789"),
    "stops": _class(b".?"),
    "shouts": _class(b"!"),
    "commas": _class(b",;:"),
    "pipes": _class(b"|"),
    "newlines": _class(b"\n"),
}
_START = np.ones(256, bool)  # bytes that begin a code point
_START[0x80:0xC0] = False
_SPACE = _class(b" \t\n\r\x0b\x0c")


def _per_doc(flags: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    return np.diff(np.r_[0, np.cumsum(flags)][offsets])


def _runs(h: np.ndarray, doc: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of each item: size of its group of equal (doc, h), and whether it is the group's first."""
    o = np.lexsort((h, doc))
    hs, ds = h[o], doc[o]
    new = np.ones(len(o), bool)
    new[1:] = (hs[1:] != hs[:-1]) | (ds[1:] != ds[:-1])
    first = np.flatnonzero(new)
    size = np.diff(np.r_[first, len(o)])
    count, lead = np.empty(len(o), np.int64), np.zeros(len(o), bool)
    count[o] = np.repeat(size, size)
    lead[o[first]] = True  # lexsort is stable: the first in text order
    return count, lead


def counts(buf: Buffer, window: int = 5, more: bool = False) -> dict[str, np.ndarray]:
    """Of each document: n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_upper, n_letters; with ``more`` further counts."""
    n, off, data = len(buf.offsets) - 1, buf.offsets, buf.data
    start, end, first = words_of(buf)
    n_words = np.diff(first)
    doc = np.repeat(np.arange(n), n_words)
    sums = prefix_sums(data, BYTE_VALUES)
    words = span_hashes(sums, start, end)
    out = {"n_words": n_words, "word_chars": _per_doc(_START[data] & ~_SPACE[data], off), "n_symbols": _per_doc(_CLASSES["symbols"][data], off), "n_upper": _per_doc(_CLASSES["upper"][data], off), "n_letters": _per_doc(_CLASSES["letters"][data], off)}
    # lines with a word that equal an earlier line of the document
    edge = np.flatnonzero(data == 10)
    begin = np.unique(np.r_[off[:-1], edge + 1])
    begin = begin[begin < len(data)]
    stop = np.minimum(np.r_[begin[1:], len(data)], len(data))
    line_doc = np.searchsorted(off, begin, "right") - 1
    ends_nl = data[stop - 1] == 10 if len(stop) else np.zeros(0, bool)
    stop = stop - ends_nl
    has_word = np.searchsorted(start, stop) > np.searchsorted(start, begin)
    begin, stop, line_doc = begin[has_word], stop[has_word], line_doc[has_word]
    _, lead = _runs(span_hashes(sums, begin, stop), line_doc)
    out["n_dup_lines"] = np.bincount(line_doc[~lead], minlength=n)
    # words within windows that the document has twice or more
    m = max(0, len(words) - window + 1)
    h = np.zeros(m, np.uint64)
    for k in range(window):
        h += words[k : k + m] * SHINGLE_FACTORS[k]
    ok = np.flatnonzero(doc[:m] == doc[window - 1 :]) if m else np.zeros(0, np.int64)
    size, _ = _runs(mix(h[ok]), doc[ok])
    again = ok[size > 1]
    cover = np.zeros(len(words) + 1, np.int64)
    np.add.at(cover, again, 1)
    np.add.at(cover, again + window, -1)
    out["n_repeat_words"] = np.bincount(doc[np.cumsum(cover[:-1]) > 0], minlength=n)
    if more:
        for k in ("digits", "stops", "shouts", "commas", "pipes", "newlines"):
            out["n_" + k] = _per_doc(_CLASSES[k][data], off)
        out["n_bytes"] = np.diff(off)
        size = end - start
        out["n_short_words"] = np.bincount(doc[size <= 3], minlength=n)
        out["n_long_words"] = np.bincount(doc[size > 12], minlength=n)
        _, lead = _runs(words, doc)
        out["n_distinct_words"] = np.bincount(doc[lead], minlength=n)
        same = np.zeros(len(words), bool)
        same[1:] = (words[1:] == words[:-1]) & (doc[1:] == doc[:-1])
        out["n_same_as_last"] = np.bincount(doc[same], minlength=n)
        out["n_lines"] = np.bincount(line_doc, minlength=n)
    return out
