"""Approximate nearest neighbours by largest inner product: IVF with product quantisation.

A bounded sample of vectors, fitted on the driver, gives coarse centroids and, on the
residuals, one codebook for each group of dimensions.  Every row is indexed: its list is
its nearest centroid, its code the nearest codeword of each group.  A query visits the
lists whose centroids have the largest inner product with it; how many is chosen from the
sample, so that they cover ``coverage`` of its true neighbours: few where vectors form
clusters, about half of all where they have no structure.  That is an average, so a query
also visits the lists of its own nearest sample vectors, and each list whose centroid and
spread leave room for a row as near as those: rows unlike most, rare groups and long vectors
are found too.  Scores come from tables of inner products between the query and all
codewords (asymmetric distances); the best ``rerank`` of a shard, with all that tie with the
last of them, are scored again exactly in double precision on the vectors as given, and so are
all that the error of their code may hide: near copies, whose codes are alike, and rows far
from every codeword.

Of equal vectors, only the k + 1 with the smallest ids can be among a query's k nearest, so
only these are indexed, and equal queries are asked once: large groups of copies cost
nothing.  Lists are dealt to shards of at most ``shard_rows`` rows, a longer list to several.
A query goes to the shards with a list that it visits, and only there; rows stay in their
shard once, in memory, while its queries stream past.  Only a shard that more than
``shard_queries`` queries visit is held by more than one task.

Results: vectors that are null, zero, of another length than most, or that hold null or
non-finite components take no part; rows equal in id and vector count once, and a row is
no neighbour of a query with its id; ties go to the smaller id; fewer candidates than k
give fewer rows, an empty table none; other columns are not read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import hashed_sample, trim, written


def kmeans(x: np.ndarray, k: int, rounds: int = 8, seed: int = 7) -> np.ndarray:
    rng = np.random.default_rng(seed)
    c = x[rng.choice(len(x), k, replace=len(x) < k)].astype(np.float32)
    for _ in range(rounds):
        near = nearest(x, c)
        n = np.bincount(near, minlength=k)
        total = np.stack([np.bincount(near, x[:, d], k) for d in range(x.shape[1])], axis=1)
        c = np.where(n[:, None] > 0, total / np.maximum(n, 1)[:, None], x[rng.choice(len(x), k)]).astype(np.float32)
    return c


def nearest(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    half = 0.5 * (c * c).sum(axis=1)
    return np.concatenate([np.argmax(x[i : i + 8192] @ c.T - half, axis=1) for i in range(0, len(x), 8192)] or [np.zeros(0, np.int64)])


def length(x: np.ndarray) -> np.ndarray:
    return np.sqrt((x * x).sum(axis=1, dtype=np.float64))


def stray(distance: np.ndarray, n: int, sigmas: float = 2.5) -> np.ndarray:
    """How much a remainder of this length may add to the product with a unit vector: as one of any direction in ``n``, all of it where it is unlike most."""
    usual = np.median(distance) if len(distance) else 0.0
    return np.where(distance > 2 * usual, distance, distance * min(1.0, sigmas / math.sqrt(n)))


@dataclass
class Index:
    coarse: np.ndarray  # lists x dimensions
    books: list[np.ndarray]  # of each group of dimensions, codewords x its dimensions
    groups: list[slice]
    n_probe: int
    sample: np.ndarray  # the vectors that it was fitted to
    k: int
    sample_lists: np.ndarray
    spread: np.ndarray | None = None  # of each list, how far a row's part along a direction strays from its centroid's

    @classmethod
    def fit(cls, x: np.ndarray, n_lists: int, n_groups: int = 16, words: int = 256, k: int = 20, coverage: float = 0.98) -> Index:
        coarse = kmeans(x, n_lists)
        rest = x - coarse[nearest(x, coarse)]
        cut = np.linspace(0, x.shape[1], min(n_groups, x.shape[1]) + 1).astype(int)
        groups = [slice(i, j) for i, j in zip(cut, cut[1:], strict=False)]
        books = [kmeans(rest[:, g], min(words, len(x))) for g in groups]
        # lists to visit: those that hold the true neighbours of some sample vectors
        q = x[np.random.default_rng(1).choice(len(x), min(300, len(x)), replace=False)]
        top = np.argsort(-(q @ x.T), axis=1)[:, 1 : k + 1]
        order = np.argsort(-(q @ coarse.T), axis=1)
        rank = np.empty_like(order)
        np.put_along_axis(rank, order, np.arange(n_lists)[None], axis=1)
        need = np.sort(np.take_along_axis(rank, nearest(x, coarse)[top], axis=1).ravel())
        n_probe = int(need[min(len(need) - 1, math.ceil(coverage * len(need)))]) + 1 if len(need) else n_lists
        return cls(coarse, books, groups, n_probe, x, k, nearest(x, coarse))

    def encode(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """List and code of each vector, its distance from the list's centroid and from what the code stands for."""
        at = nearest(x, self.coarse)
        rest = x - self.coarse[at]
        code = np.stack([nearest(rest[:, g], b) for g, b in zip(self.groups, self.books, strict=True)], axis=1)
        lost = np.concatenate([rest[:, g] - b[code[:, m]] for m, (g, b) in enumerate(zip(self.groups, self.books, strict=True))], axis=1)
        return at, code.astype(np.uint8), length(rest), length(lost)

    def probes(self, q: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Whether each query visits each list, and a score that its k nearest reach at least."""
        s = q @ self.coarse.T
        cut = -np.partition(-s, self.n_probe - 1, axis=1)[:, self.n_probe - 1]
        visit = s >= cut[:, None]
        to = q @ self.sample.T
        if len(self.sample) <= self.k:
            return np.ones_like(visit), np.full(len(q), -np.inf)
        own = np.argpartition(-to, min(2 * self.k, len(self.sample) - 1), axis=1)[:, : 2 * self.k + 1]
        visit[np.arange(len(q))[:, None], self.sample_lists[own]] = True
        least = -np.partition(-to, self.k, axis=1)[:, self.k].astype(np.float64)  # one of them may be the query itself
        least -= 1e-5 * (1 + np.abs(least))
        if self.spread is not None:
            visit |= s + length(q)[:, None] * self.spread >= least[:, None]
        return visit, least

    def search(self, q: np.ndarray, visit: list[np.ndarray], least: np.ndarray, lists: np.ndarray, codes: np.ndarray, lost: np.ndarray, ids: np.ndarray, vectors: np.ndarray, k: int, rerank: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """(query, ids, scores) of its best k among the rows of the lists that it visits; ``vectors`` as given, ``q`` alike."""
        q32 = q.astype(np.float32)
        room = stray(lost, q.shape[1])
        to_list = q32 @ self.coarse.T
        flat = codes.astype(np.int32) + np.arange(codes.shape[1], dtype=np.int32) * 256
        tables = np.zeros((len(q), 256 * len(self.books)), np.float32)
        for m, (g, b) in enumerate(zip(self.groups, self.books, strict=True)):
            tables[:, 256 * m : 256 * m + len(b)] = q32[:, g] @ b.T
        norms = length(q32)
        for i in range(len(q)):
            seen = np.zeros(len(self.coarse), bool)
            seen[visit[i]] = True
            rows = np.flatnonzero(seen[lists])
            if not len(rows):
                continue
            if len(rows) > rerank:
                s = tables[i].take(flat[rows]).sum(axis=1) + to_list[i][lists[rows]]
                last = -np.partition(-s, rerank - 1)[rerank - 1]
                rows = rows[(s >= last - 1e-5 * (1 + abs(last))) | (s + norms[i] * room[rows] >= least[i])]
            exact = (vectors[rows].astype(np.float64) * q[i].astype(np.float64)).sum(axis=1)
            best = np.lexsort((ids[rows], -exact))[:k]
            yield i, ids[rows[best]], exact[best]


def usable(df: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """vec_id, vector and the hash (two columns) of that vector, of the rows that take part, each once."""
    kind = df.schema[vector_col].dataType
    exact = "array<float>" if isinstance(kind, T.ArrayType) and isinstance(kind.elementType, T.FloatType) else "array<double>"
    v = df.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).cast(exact).alias("vector")).filter("vec_id is not null and size(vector) > 0")
    v = v.filter("forall(vector, x -> x is not null and not isnan(x) and abs(x) < float('infinity')) and exists(vector, x -> x <> 0)")
    usual = v.groupBy(F.size("vector").alias("n")).count().orderBy(F.desc("count"), "n").first()
    v = v.filter(F.size("vector") == (usual["n"] if usual else -1))
    plain = F.transform("vector", lambda x: x + F.lit(0.0).cast(exact[6:-1]))  # -0.0 equals 0.0
    return v.withColumns({"h1": F.xxhash64(plain), "h2": F.xxhash64(F.lit(20240817), plain)}).groupBy("h1", "h2", "vec_id").agg(F.first("vector").alias("vector"))


def _matrix(column: pa.Array) -> np.ndarray:
    """One row a vector, in the type given."""
    n = len(column)
    return column.flatten().to_numpy(zero_copy_only=False).reshape(n, -1) if n else np.zeros((0, 0), np.float32)


def _shards(sizes: dict[int, int], shard_rows: int) -> tuple[dict[int, int], dict[int, int]]:
    """First shard and number of shards of each list: runs of short lists share one, a long list has several."""
    first, parts, shard, room = {}, {}, 0, shard_rows
    for at, size in sorted(sizes.items()):
        if size > room and room < shard_rows:
            shard, room = shard + 1, shard_rows
        first[at], parts[at] = shard, max(1, math.ceil(size / shard_rows))
        if parts[at] > 1:
            shard, room = shard + parts[at], shard_rows
        else:
            room -= size
    return first, parts


def nearest_neighbours(df: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", queries_where: str = "vec_id % 20 = 0", k: int = 20, rerank: int = 300, sample_rows: int = 20_000, shard_rows: int = 8192, shard_queries: int = 1 << 16, coverage: float = 0.95) -> DataFrame:
    """query_id, rank, vec_id, score: the k nearest found of each query among all other rows."""
    spark = df.sparkSession
    vectors = written(usable(df, id_col, vector_col))
    exact = vectors.schema["vector"].dataType.simpleString()
    copies = Window.partitionBy("h1", "h2").orderBy("vec_id")
    rows = vectors.withColumn("rn", F.row_number().over(copies)).filter(F.col("rn") <= k + 1).select("vec_id", "vector")
    n = vectors.count()
    if not n:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    sample = hashed_sample(vectors, n, sample_rows, "vec_id", "h1").select("vector")
    x = np.array([r[0] for r in sample.toLocalIterator()], np.float32)
    index = Index.fit(x, max(1, min(4 * round(math.sqrt(n)), len(x) // 16)), k=k, coverage=coverage)
    sent = spark.sparkContext.broadcast(index)

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                at, code, away, lost = sent.value.encode(_matrix(b.column(1)).astype(np.float32))
                yield pa.record_batch([b.column(0), b.column(1), pa.array(at, pa.int64()), pa.array([c.tobytes() for c in code], pa.binary()), pa.array(away), pa.array(lost)], ["vec_id", "vector", "list", "code", "away", "lost"])

    indexed = written(rows.mapInArrow(place, f"vec_id long, vector {exact}, list long, code binary, away double, lost double"))
    found_lists = indexed.groupBy("list").agg(F.count(F.lit(1)).alias("count"), F.max("away").alias("away")).collect()  # a row a list, of which the sample bounds the number
    sizes = {r["list"]: r["count"] for r in found_lists}
    away = np.zeros(len(index.coarse))
    away[[r["list"] for r in found_lists]] = [r["away"] for r in found_lists]
    index.spread = stray(away, x.shape[1])
    asking = spark.sparkContext.broadcast(index)
    first, parts = _shards(sizes, shard_rows)
    dealt = spark.createDataFrame([(at, first[at], parts[at]) for at in sizes], "list long, first long, parts long")
    at_row = indexed.join(F.broadcast(dealt), "list").withColumn("shard", F.col("first") + F.pmod(F.xxhash64("vec_id"), F.col("parts")))

    def route(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Each query with the shards that hold a list it visits, and these lists."""
        kind = pa.list_(pa.struct([("shard", pa.int64()), ("lists", pa.list_(pa.int64()))]))
        for whole in batches:
            for lo in range(0, whole.num_rows, 512):
                b = whole.slice(lo, 512)
                visit, least = asking.value.probes(_matrix(b.column(2)).astype(np.float32))
                to = []
                for v in visit:
                    held: dict[int, list[int]] = {}
                    for at in np.flatnonzero(v).tolist():
                        for s in range(first[at], first[at] + parts[at]) if at in first else ():
                            held.setdefault(s, []).append(at)
                    to.append([{"shard": s, "lists": held[s]} for s in sorted(held)])
                yield pa.record_batch([*b.columns, pa.array(least), pa.array(to, kind)], ["h1", "h2", "vector", "least", "to"])

    queries = vectors.filter(queries_where)
    asked = queries.groupBy("h1", "h2").agg(F.first("vector").alias("vector"))
    routed = written(asked.mapInArrow(route, f"h1 long, h2 long, vector {exact}, least double, to array<struct<shard: long, lists: array<long>>>").select("h1", "h2", "vector", "least", F.explode("to").alias("to")).select("h1", "h2", "vector", "least", "to.shard", "to.lists"))
    load = routed.groupBy("shard").agg(F.ceil(F.count(F.lit(1)) / shard_queries).cast("int").alias("copies"))
    salted = routed.join(load, "shard").withColumn("copy", F.pmod(F.xxhash64("h1", "h2"), F.col("copies")).cast("int"))
    held = at_row.join(load, "shard").withColumn("copy", F.explode(F.sequence(F.lit(0), F.col("copies") - 1)))
    left = held.select("shard", "copy", F.lit(False).alias("asks"), F.lit(0).cast("long").alias("h1"), F.lit(0).cast("long").alias("h2"), "vec_id", "vector", "list", "code", "lost", F.lit(None).cast("array<long>").alias("lists"))
    right = salted.select("shard", "copy", F.lit(True).alias("asks"), "h1", "h2", F.lit(None).cast("long").alias("vec_id"), "vector", F.lit(None).cast("long").alias("list"), F.lit(None).cast("binary").alias("code"), F.col("least").alias("lost"), "lists")

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """A shard's rows are gathered, then its queries pass in batches."""
        names = ["h1", "h2", "vec_id", "score"]
        now, pieces, ready = None, [], None

        def answer(q: pa.RecordBatch) -> pa.RecordBatch:
            nonlocal ready
            if ready is None:
                t = pa.Table.from_batches(pieces).combine_chunks()
                column = {c: t[c].combine_chunks() for c in ("vec_id", "vector", "list", "code", "lost")}
                codes = np.frombuffer(b"".join(column["code"].to_pylist()), np.uint8).reshape(t.num_rows, -1)
                ready = (column["list"].to_numpy(), codes, column["lost"].to_numpy(), column["vec_id"].to_numpy(), _matrix(column["vector"]))
            h1, h2 = q["h1"].to_numpy(), q["h2"].to_numpy()
            visit = [np.array(at) for at in q["lists"].to_pylist()]
            got = [(np.full(len(ids), h1[i]), np.full(len(ids), h2[i]), ids, score) for i, ids, score in sent.value.search(_matrix(q["vector"]), visit, q["lost"].to_numpy(), *ready, k + 1, rerank)]
            cols = [np.concatenate(c) for c in zip(*got, strict=True)] if got else [np.zeros(0, np.int64)] * 3 + [np.zeros(0)]
            return pa.record_batch([pa.array(c) for c in cols], names)

        for b in batches:
            key = b["shard"].to_numpy() * (1 << 20) + b["copy"].to_numpy()
            kind = b["asks"].to_numpy(zero_copy_only=False)
            cut = np.flatnonzero(np.r_[True, (key[1:] != key[:-1]) | (kind[1:] != kind[:-1])]) if b.num_rows else []
            for lo, hi in zip(cut, [*cut[1:], b.num_rows], strict=True):
                part = b.slice(lo, hi - lo)
                if key[lo] != now:
                    now, pieces, ready = key[lo], [], None
                if not kind[lo]:
                    pieces.append(part)
                elif pieces:
                    for at in range(0, part.num_rows, 512):
                        yield answer(part.slice(at, 512))
        trim()

    tasks = left.unionByName(right).repartition("shard", "copy").sortWithinPartitions("shard", "copy", "asks")
    found = tasks.mapInArrow(meet, "h1 long, h2 long, vec_id long, score double")
    best = Window.partitionBy("h1", "h2").orderBy(F.desc("score"), "vec_id")
    top = found.withColumn("rn", F.row_number().over(best)).filter(F.col("rn") <= k + 1)
    # to every query of a vector, its k + 1 nearest: those may be many, so in 16 parts
    lists = top.groupBy("h1", "h2").agg(F.collect_list(F.struct("vec_id", "score")).alias("near")).withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(15))))
    each = queries.select("h1", "h2", F.col("vec_id").alias("query_id"), F.pmod(F.xxhash64("vec_id"), F.lit(16)).cast("int").alias("salt"))
    others = F.filter(F.array_sort("near", lambda a, b: F.when(a["score"] > b["score"], -1).when(a["score"] < b["score"], 1).when(a["vec_id"] < b["vec_id"], -1).otherwise(1)), lambda c: c["vec_id"] != F.col("query_id"))
    ranked = each.join(lists, ["h1", "h2", "salt"]).select("query_id", F.posexplode(F.slice(others, 1, k)).alias("at", "near"))
    return ranked.select("query_id", (F.col("at") + 1).alias("rank"), "near.vec_id", "near.score")
