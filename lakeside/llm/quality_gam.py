"""Quality classifier: a generalised additive model with pairwise interactions.

Features of the whole text are cut into quantile bins.  Boosting goes round the features
in turn; each step fits a shallow tree on one feature's bins (three leaves) and adds a
small part of it to that feature's lookup table.  With these fixed, the pairs of features
whose joint bins explain most of what is left get tables of their own in the same way.
A score is the logistic function of a sum of table entries.

The model is fitted on the driver on at most ``sample_rows`` labelled rows, those with the
smallest hash of doc_id; its tables have a fixed size.  Labels, lang, source and doc_id are
not features.  With no labels, or labels of one class, every score is the share of label 1
(0.5 without labels).  Null texts count as empty; empty texts are scored like any other, equal
texts alike; null labels and labels without a doc_id teach nothing; an empty table gives none.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import hashed_sample, spread, trim, written
from .hashing import Buffer
from .text_counts import counts

FEATURES = ("log_words", "word_length", "symbols", "upper", "digits", "stops", "shouts", "commas", "pipes", "dup_lines", "repeats", "same_as_last", "short_words", "long_words", "distinct", "line_words", "bytes_per_char")


def features_of(buf: Buffer) -> np.ndarray:
    """One row of FEATURES per document."""
    c = {k: v.astype(float) for k, v in counts(buf, more=True).items()}
    w, ch = np.maximum(c["n_words"], 1), np.maximum(c["word_chars"], 1)
    cols = [np.log1p(c["n_words"]), c["word_chars"] / w, c["n_symbols"] / ch, c["n_upper"] / np.maximum(c["n_letters"], 1), c["n_digits"] / ch, c["n_stops"] / w, c["n_shouts"] / w, c["n_commas"] / w, c["n_pipes"] / w, c["n_dup_lines"] / np.maximum(c["n_lines"], 1), c["n_repeat_words"] / w, c["n_same_as_last"] / w, c["n_short_words"] / w, c["n_long_words"] / w, c["n_distinct_words"] / w, np.log1p(c["n_words"] / np.maximum(c["n_lines"], 1)), c["n_bytes"] / np.maximum(ch, 1)]
    return np.stack(cols, axis=1)


class Gam:
    def __init__(self, bins: int = 32, rounds: int = 250, pairs: int = 6, pair_bins: int = 8, rate: float = 0.1, ridge: float = 2.0):
        self.bins, self.rounds, self.n_pairs, self.pair_bins, self.rate, self.ridge = bins, rounds, pairs, pair_bins, rate, ridge
        self.edges: list[np.ndarray] = []
        self.tables: list[np.ndarray] = []
        self.pairs: list[tuple[int, int, np.ndarray]] = []
        self.base = 0.0

    def _bin(self, x: np.ndarray) -> np.ndarray:
        return np.stack([np.searchsorted(e, x[:, j], "right") for j, e in enumerate(self.edges)], axis=1)

    def _tree(self, g: np.ndarray, h: np.ndarray) -> np.ndarray:
        """Leaf value of every bin: two best cuts, one after the other, on gradient sums by bin."""
        value = np.zeros(len(g))
        parts = [(0, len(g))]
        for _ in range(2):
            best = (1e-12, None, None)
            for k, (i, j) in enumerate(parts):
                cg, ch = np.cumsum(g[i:j]), np.cumsum(h[i:j])
                if len(cg) < 2:
                    continue
                gain = cg[:-1] ** 2 / (ch[:-1] + self.ridge) + (cg[-1] - cg[:-1]) ** 2 / (ch[-1] - ch[:-1] + self.ridge) - cg[-1] ** 2 / (ch[-1] + self.ridge)
                c = int(np.argmax(gain))
                if gain[c] > best[0]:
                    best = (gain[c], k, i + c + 1)
            if best[1] is None:
                break
            i, j = parts.pop(best[1])
            parts += [(i, best[2]), (best[2], j)]
        for i, j in parts:
            value[i:j] = g[i:j].sum() / (h[i:j].sum() + self.ridge)
        return value

    def fit(self, x: np.ndarray, y: np.ndarray) -> Gam:
        if not len(y) or y.min() == y.max():
            share = float(y.mean()) if len(y) else 0.5
            self.base = float(np.log((share + 1e-3) / (1 - share + 1e-3)))
            return self
        qs = np.linspace(0, 1, self.bins + 1)[1:-1]
        self.edges = [np.unique(np.quantile(c, qs)) for c in x.T]
        b = self._bin(x)
        n_bins = [len(e) + 1 for e in self.edges]
        self.tables = [np.zeros(n) for n in n_bins]
        self.base = float(np.log(y.mean() / (1 - y.mean())))
        f = np.full(len(y), self.base)

        def slopes() -> tuple[np.ndarray, np.ndarray]:
            p = 1 / (1 + np.exp(-f))
            return y - p, np.maximum(p * (1 - p), 1e-4)

        for _ in range(self.rounds):
            for j, n in enumerate(n_bins):
                if n < 2:
                    continue
                g, h = slopes()
                step = self.rate * self._tree(np.bincount(b[:, j], g, n), np.bincount(b[:, j], h, n))
                self.tables[j] += step
                f += step[b[:, j]]
        # interactions, on coarser bins
        fold = [np.minimum(np.arange(n) * self.pair_bins // n, self.pair_bins - 1) for n in n_bins]
        q = np.stack([fold[j][b[:, j]] for j in range(b.shape[1])], axis=1)
        g, h = slopes()
        m = self.pair_bins
        found = []
        for i in range(b.shape[1]):
            for j in range(i + 1, b.shape[1]):
                cell = q[:, i] * m + q[:, j]
                found.append(((np.bincount(cell, g, m * m) ** 2 / (np.bincount(cell, h, m * m) + 5 * self.ridge)).sum(), i, j))
        for _, i, j in sorted(found, reverse=True)[: self.n_pairs]:
            self.pairs.append((i, j, np.zeros((m, m))))
        self.fold = fold
        for _ in range(self.rounds // 5):
            for i, j, table in self.pairs:
                g, h = slopes()
                cell = q[:, i] * m + q[:, j]
                gs, hs = np.bincount(cell, g, m * m).reshape(m, m), np.bincount(cell, h, m * m).reshape(m, m)
                c = int(np.argmax(np.abs(np.cumsum(gs.sum(axis=1))[:-1]))) + 1  # one cut of rows, then a tree of columns on each side
                step = np.zeros((m, m))
                step[:c] = self._tree(gs[:c].sum(axis=0), hs[:c].sum(axis=0))
                step[c:] = self._tree(gs[c:].sum(axis=0), hs[c:].sum(axis=0))
                table += self.rate * step
                f += self.rate * step[q[:, i], q[:, j]]
        return self

    def score(self, x: np.ndarray) -> np.ndarray:
        f = np.full(len(x), self.base)
        if self.tables:
            b = self._bin(x)
            for j, t in enumerate(self.tables):
                f += t[b[:, j]]
            for i, j, t in self.pairs:
                f += t[self.fold[i][b[:, i]], self.fold[j][b[:, j]]]
        return 1 / (1 + np.exp(-np.clip(f, -30, 30)))


def text_features(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", carry: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, ``features`` (array of double) and the columns ``carry`` of every row."""
    base = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"), *carry)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            buf = Buffer.of(batch.column(1))
            for lo, hi in buf.blocks(1 << 20):
                x = features_of(buf.part(lo, hi))
                flat = pa.FixedSizeListArray.from_arrays(pa.array(x.ravel()), x.shape[1]).cast(pa.list_(pa.float64()))
                yield pa.record_batch([batch.column(0).slice(lo, hi - lo), flat, *(c.slice(lo, hi - lo) for c in batch.columns[2:])], ["doc_id", "features", *carry])
        trim()

    return spread(base).mapInArrow(run, ", ".join(["doc_id long, features array<double>", *(f"{c} {base.schema[c].dataType.simpleString()}" for c in carry)]))


def held_out(doc_id: str = "doc_id"):
    """Whether a document's label is kept from the fit: crc32 of its id as text, modulo 3, is 1."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 3 == 1, F.lit(False))


def fit(features: DataFrame, labels: DataFrame, sample_rows: int = 20_000) -> Gam:
    """A model of ``labels`` (doc_id, quality) that aren't held out; several labels of one document count by majority."""
    y = labels.filter(F.col("quality").isNotNull() & F.col("doc_id").isNotNull()).groupBy("doc_id").agg((F.avg("quality") >= 0.5).cast("int").alias("y"))
    y = written(y.filter(~held_out()))
    train = features.join(hashed_sample(y, y.count(), 2 * sample_rows, "doc_id"), "doc_id").orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample_rows)  # labels without a document leave room for others
    rows = train.select("features", "y").toPandas()
    x = np.array(rows["features"].tolist(), float).reshape(len(rows), len(FEATURES))
    return Gam().fit(x, rows["y"].to_numpy(float))


def scored(features: DataFrame, model: Gam) -> DataFrame:
    """doc_id, held_out, score, predicted and what ``features`` carries."""
    carry = features.columns[2:]
    sent = features.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                x = batch.column(1).flatten().to_numpy().reshape(batch.num_rows, len(FEATURES))
                yield pa.record_batch([batch.column(0), pa.array(sent.value.score(x)), *batch.columns[2:]], ["doc_id", "score", *carry])

    ddl = ", ".join(["doc_id long, score double", *(f"{c} {features.schema[c].dataType.simpleString()}" for c in carry)])
    return features.mapInArrow(run, ddl).select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"), *carry)


def classify(docs: DataFrame, labels: DataFrame, sample_rows: int = 20_000, carry: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, held_out, score, predicted and the columns ``carry`` of every row."""
    features = written(text_features(docs, carry=carry))
    return scored(features, fit(features, labels, sample_rows))
