"""Exact vector search and rank fusion."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def normalize(v: Column) -> Column:
    norm = F.sqrt(dot(v, v))
    return F.when(norm > 0, F.transform(v, lambda x: x / norm)).otherwise(v)


def semantic(vectors: DataFrame, query: DataFrame, limit: int = 20, least: float | None = 0.05) -> DataFrame:
    """vec_id, score of the nearest by inner product with a unit query (one row: vec), above ``least``; other dimensions are skipped."""
    q = F.broadcast(query.select(F.col("vec").alias("query")).limit(1))  # one row
    scored = vectors.join(q, F.expr("size(vec) = size(query)")).select("vec_id", dot(F.col("vec"), F.col("query")).alias("score"))
    if least is not None:
        scored = scored.filter(F.col("score") > least)
    return scored.orderBy(F.desc("score"), "vec_id").limit(limit)


def rrf(legs: list[tuple[DataFrame, float]], depth: int, offset: int = 60) -> DataFrame:
    """id, score: reciprocal ranks of each leg (id, score), weighted; ranks count from 1."""
    parts = []
    for leg, weight in legs:
        # a leg is at most ``depth`` rows by construction, so one window over all of it is small
        top = leg.orderBy(F.desc("score"), "id").limit(depth)
        rank = F.row_number().over(Window.orderBy(F.desc("score"), "id"))
        parts.append(top.select("id", (F.lit(weight) / (rank + offset)).alias("part")))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.groupBy("id").agg(F.sum("part").alias("score"))


def boosts(hits: DataFrame, symbol_overlap: Column, path_overlap: Column, archive_dirs: Column, is_test: Column, covered: Column, rank_share: Column, segments: Column) -> DataFrame:
    """Adds ``boosted``: score plus static signals, the sum of signals at most 0.09."""
    signal = 0.03 * symbol_overlap + 0.015 * path_overlap - 0.03 * archive_dirs - F.when(is_test, 0.02).otherwise(0.0) + F.least(0.01 * covered, F.lit(0.03)) + 0.02 * rank_share - 0.005 * (segments - 1)
    return hits.withColumn("boosted", F.col("score") + F.least(signal, F.lit(0.09)))


def ir_metrics(ranks: DataFrame) -> DataFrame:
    """recall at 1, 5, 10, mean reciprocal rank, nearest-rank median and p95 of (query, rank; null: not found)."""
    at = [F.avg(F.when(F.col("rank") <= k, 1.0).otherwise(0.0)).alias(f"recall_{k}") for k in (1, 5, 10)]
    return ranks.agg(*at, F.avg(F.coalesce(1.0 / F.col("rank"), F.lit(0.0))).alias("mrr"), *(F.expr(f"percentile_disc({p}) within group (order by rank)").alias(n) for p, n in ((0.5, "median"), (0.95, "p95"))))
