"""Encoding with the tokenizers library, each distinct word of a worker once.

Where a tokenizer splits texts by a pattern that never joins the two sides of a single
space, the ids of a text are those of its stretches between spaces, one after the other.
The library then gets each distinct stretch once, many in a call, and a dictionary gives
the rest.  Stretches of several runs of Latin letters, signs and line ends, which the pattern
never joins, are put together from their runs.  Texts with other runs of white space around a space, texts that hold an added token of the
tokenizer (the library gives such a token its own id), and all texts of tokenizers of
other kinds go to the library whole.
"""

from __future__ import annotations

import json
import os
import re
import sys
import unicodedata
from array import array

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from tokenizers import Tokenizer, normalizers

KEPT_WORDS = 300_000
CALL_CHARS = 20_000
MARK = "\x00"
SPACE = "\u0120"  # as byte-level vocabularies write it
#: Runs of Latin letters, of signs (no apostrophe, which contractions begin with) and a line's end; patterns of PATTERN_PARTS match each apart.
LETTERS = "A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u024f"
SIGNS = r"!-&(-/:-@\[-`{-~"
PATTERN_PARTS = {"'s", "'t", "'re", "'ve", "'m", "'ll", "'d", r"[\p{L}]+", r"[\p{N}]", r"[^\s\p{L}\p{N}]+"}
_simple = re.compile(f"[{LETTERS}{SIGNS}\n]+").fullmatch
_runs = re.compile(f"[{LETTERS}]+|[{SIGNS}]+|\n").findall


class WordEncoder:
    """Texts to packed little-endian ids of ``width`` bytes each (2 if the vocabulary allows)."""

    def __init__(self, path: str, kept: int = KEPT_WORDS):
        self.kept = kept
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        self.tokenizer = Tokenizer.from_file(path)
        self.library = Tokenizer.from_file(path)  # as it is, for texts with added tokens
        self.added = [t["content"] for t in spec.get("added_tokens") or []]
        self.folded = [a.lower() for a in self.added] if spec.get("normalizer") else []  # normalising must not make one
        lead = os.path.commonprefix([*self.added, *self.folded])
        self.lead = lead if lead.lower() == lead.upper() else ""  # no letters, so cases and normalising leave it
        self.width = 2 if self.tokenizer.get_vocab_size() <= 1 << 16 else 4
        self.by_words = self._splits_at_spaces(spec.get("pre_tokenizer") or {})
        #: Whether runs of letters and of signs are matches of their own.
        self.cuts = self.by_words and (not self.drops_space or set(spec["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"].split("|")) == PATTERN_PARTS)
        self.normalize = None
        if self.by_words and spec.get("normalizer"):
            steps = [(x["type"], x.get("pattern"), x.get("content")) for x in spec["normalizer"].get("normalizers", [])]
            library = self.tokenizer.normalizer.normalize_str
            self.tokenizer.normalizer = normalizers.Sequence([])  # words come from normalised texts
            # white space separates words either way, so this normaliser comes to NFC and lower case
            plain = steps == [("NFC", None, None), ("Replace", {"Regex": r"\s+"}, " "), ("Lowercase", None, None)] and self.drops_space
            # Python's lower case of a capital sigma depends on its place in the word, the library's does not
            self.normalize = (lambda t: t.lower() if t.isascii() or "\u03a3" not in t and unicodedata.is_normalized("NFC", t) else library(t)) if plain else library
        self.mark = self.tokenizer.encode(" " + MARK, add_special_tokens=False).ids
        self.opens, self.closes = self._edges(spec.get("model") or {})
        self.words: dict[str, bytes | None] = {}
        self.heads: dict[str, bytes] = {}

    def _splits_at_spaces(self, pre: dict) -> bool:
        self.drops_space = False
        if pre.get("type") == "ByteLevel":
            return bool(pre.get("use_regex")) and not pre.get("add_prefix_space")
        steps = pre.get("pretokenizers", [])
        self.drops_space = len(steps) == 2 and steps[0].get("type") == "Split" and steps[0].get("behavior") == "Removed" and bool(steps[0].get("invert")) and " " not in steps[0].get("pattern", {}).get("Regex", " ") and steps[1].get("type") == "ByteLevel" and not steps[1].get("use_regex") and not steps[1].get("add_prefix_space")
        return self.drops_space

    def _edges(self, model: dict) -> tuple[np.ndarray | None, np.ndarray | None]:
        """Of each id, whether it can only open a word after a space, or can only close a word of letters; None if ids do not show it.

        Where spaces are kept, the one space of such a word is its first byte. Where they are dropped, a suffix
        ends each match of the pattern, which is the whole word if that has letters only.
        """
        vocab = self.tokenizer.get_vocab()
        suffix = model.get("end_of_word_suffix")
        if not self.by_words or model.get("type") != "BPE" or model.get("dropout") or self.drops_space and not (suffix and self.cuts):
            return None, None
        edge = np.zeros(max(vocab.values()) + 1, bool)
        edge[[i for t, i in vocab.items() if (t.endswith(suffix) if self.drops_space else t.startswith(SPACE))]] = True
        return (None, edge) if self.drops_space else (edge, None)

    def _pack(self, ids: list[int]) -> bytes:
        a = array("H" if self.width == 2 else "I", ids)
        if sys.byteorder == "big":
            a.byteswap()
        return a.tobytes()

    def _direct(self, texts: list[str]) -> list[bytes]:
        return [self._pack(e.ids) for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _learn(self, new: list[str]) -> None:
        """Ids of each word after a space; None where white space beside that space may join it.

        Words of several runs of letters and signs are those of the first run and, with no space before, of the
        others. Many words go in one call; see ``_call``.
        """
        words, heads = self.words, self.heads
        plain, other, cut = [], [], []
        for w in new:
            if w.isalpha():
                plain.append(w)
            elif not w or w[0].isspace() or w[-1].isspace():
                words[w] = None
            elif self.cuts and _simple(w) and "\n\n" not in w and len(runs := _runs(w)) > 1:
                cut.append((w, runs))
            else:
                other.append(w)
        for w in {runs[0] for _, runs in cut}.difference(words, plain, other):
            (plain if w.isalpha() else other).append(w)
        for group in (plain, other):
            bare = self.opens is not None or group is plain and self.closes is not None
            call, size = [], 0
            for w in group:
                call.append(w)
                size += len(w) + 1
                if size > CALL_CHARS:
                    words.update(zip(call, self._call(call, bare), strict=True))
                    call, size = [], 0
            if call:
                words.update(zip(call, self._call(call, bare), strict=True))
        later = list({run for _, runs in cut for run in runs[1:]}.difference(heads))
        heads.update(zip(later, self._direct(later), strict=True))
        for w, runs in cut:
            words[w] = words[runs[0]] + b"".join([heads[run] for run in runs[1:]])

    def _call(self, call: list[str], bare: bool) -> list[bytes]:
        """Ids of each of distinct words, in one call; ``bare`` if their ids may show where they end."""
        if bare:
            packed = self._direct([" " + " ".join(call)])[0]
            ids = np.frombuffer(packed, "<u2" if self.width == 2 else "<u4")
            if self.opens is not None:
                begin = np.flatnonzero(self.opens[ids])
                end = np.r_[begin[1:], len(ids)]
            else:
                end = np.flatnonzero(self.closes[ids]) + 1
                begin = np.r_[0, end[:-1]]
            if len(begin) == len(call):  # at least one for each word, so exactly one
                return self._cut(packed, begin, end)
        marked = [w for w in call if MARK not in w]
        out = dict(zip(marked, self._marked(marked), strict=True))
        return [out[w] if w in out else self._direct([" " + w])[0] for w in call]

    def _marked(self, call: list[str]) -> list[bytes]:
        """A mark between the words, whose last id no word has."""
        if not call:
            return []
        packed = self._direct(["".join([f" {w} {MARK}" for w in call])])[0]
        end = np.flatnonzero(np.frombuffer(packed, "<u2" if self.width == 2 else "<u4") == self.mark[-1])
        if len(end) != len(call):
            raise ValueError("the mark between words was not kept apart")
        return self._cut(packed, np.r_[0, end[:-1] + 1], end - len(self.mark) + 1)

    def _cut(self, packed: bytes, begin: np.ndarray, end: np.ndarray) -> list[bytes]:
        return [packed[i:j] for i, j in zip((begin * self.width).tolist(), (end * self.width).tolist(), strict=True)]

    def _has_added(self, text: str) -> bool:
        if self.lead and self.lead not in text:
            return False
        return any(a in text for a in self.added) or bool(self.folded) and any(a in text.lower() for a in self.folded)

    def encode(self, texts: list[str]) -> list[bytes]:
        whole = [i for i, t in enumerate(texts) if self._has_added(t)]
        if not whole:
            return self._encode(texts)
        rest = set(whole)
        others = [i for i in range(len(texts)) if i not in rest]
        out: list[bytes] = [b""] * len(texts)
        for i, packed in zip(others, self._encode([texts[i] for i in others]), strict=True):
            out[i] = packed
        for i, e in zip(whole, self.library.encode_batch_fast([texts[i] for i in whole], add_special_tokens=False), strict=True):
            out[i] = self._pack(e.ids)
        return out

    def _encode(self, texts: list[str]) -> list[bytes]:
        if not self.by_words or not texts:
            return self._direct(texts)
        if self.normalize is not None:
            texts = [self.normalize(t) for t in texts]
        words, heads = self.words, self.heads
        split = pc.split_pattern(pa.array(texts, pa.large_string()), " ")
        bounds = split.offsets.to_numpy()
        coded = split.values.dictionary_encode()
        every = coded.dictionary.to_numpy(zero_copy_only=False).tolist()
        at = coded.indices.to_numpy().astype(np.int64)
        firsts = [every[k] for k in at[bounds[:-1]].tolist()]
        if len(heads) > self.kept // 4:
            heads.clear()
        head = [w for w in dict.fromkeys(firsts) if w not in heads]  # at a text's start, no space before
        heads.update(zip(head, self._direct(head), strict=True))
        at[bounds[:-1]] = len(every) + np.arange(len(texts))
        used = np.zeros(len(every) + len(texts), bool)
        used[at] = True
        used = used.tolist()
        packed = list(map(words.get, every))
        lacking = [k for k, x in enumerate(packed) if x is None]
        new = [w for k in lacking if used[k] and (w := every[k]) not in words]
        if len(words) + len(new) > self.kept:
            recurring = {w: x for w, x in zip(every, packed, strict=True) if x is not None or w in words}  # the rest was seen in earlier blocks only
            words.clear()
            words.update(recurring)
        self._learn(new)
        for k in lacking:
            packed[k] = words.get(every[k])
        alone = (np.diff(bounds) == 1).tolist()
        packed += [heads[w] if a or w and not w[-1].isspace() else None for w, a in zip(firsts, alone, strict=True)]
        # a text's ids: those of its first word and of the others, one after the other
        values = pa.array(packed, pa.large_binary())
        row = values.take(pa.array(at))
        ends = np.frombuffer(row.buffers()[1], np.int64)[bounds].tolist()
        data = row.buffers()[2].to_pybytes() if ends[-1] else b""
        out = [data[i:j] for i, j in zip(ends, ends[1:], strict=False)]
        whole = np.unique(np.searchsorted(bounds, np.flatnonzero(row.is_null().to_numpy(zero_copy_only=False)), "right") - 1).tolist() if row.null_count else []
        for i, x in zip(whole, self._direct([texts[i] for i in whole]), strict=True):
            out[i] = x
        return out


_encoders: dict[str, WordEncoder] = {}


def encoder(path: str, kept: int = KEPT_WORDS) -> WordEncoder:
    """The worker's encoder of a tokenizer file, which remembers at most ``kept`` words."""
    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # a task has one core; the library's threads would wait for work
    if path not in _encoders:
        _encoders.clear()
        _encoders[path] = WordEncoder(path, kept)
    _encoders[path].kept = kept
    return _encoders[path]
