"""The append-only ledger: quotas, listings, scopes, staleness, telemetry."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

# Newest records kept of each kind.
QUOTAS = {"context_pack": 500, "ask": 300, "note": 200, "finding": 200, "decision": 200, "todo": 200, "commit": 500}
DEFAULT_QUOTA = 100


def within_quota(records: DataFrame, quotas: dict[str, int] | None = None, default: int = DEFAULT_QUOTA, per: tuple[str, ...] = ("kind",)) -> DataFrame:
    q = QUOTAS if quotas is None else quotas
    allowed = F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for kv in q.items() for x in kv]), F.col("kind")), F.lit(default)) if q else F.lit(default)
    w = Window.partitionBy(*per).orderBy(F.desc("id"))
    return records.withColumn("rn", F.row_number().over(w)).filter(F.col("rn") <= allowed).drop("rn")


def list_records(records: DataFrame, limit: int = 50, offset: int = 0, **equal) -> DataFrame:
    """A page of records, commits last, newest first."""
    for c, v in equal.items():
        if v is not None:
            records = records.filter(F.col(c) == v)
    return records.orderBy(F.col("kind") == "commit", F.desc("id")).offset(offset).limit(max(1, min(limit, 100)))


def union_scopes(local: DataFrame, shared: DataFrame) -> DataFrame:
    """Both ledgers, a record of the same kind, title and payload once; the local one wins."""
    both = local.withColumn("scope", F.lit(0)).unionByName(shared.withColumn("scope", F.lit(1)))
    w = Window.partitionBy("kind", "title", "payload").orderBy("scope", "id")
    return both.withColumn("rn", F.row_number().over(w)).filter("rn = 1").drop("rn")


def stale_anchors(records: DataFrame, files: DataFrame, names: DataFrame, head: str) -> DataFrame:
    """id and missing anchors of records whose head has moved and of which an anchor is gone; no anchors, never stale."""
    a = records.filter(F.col("head_sha").isNotNull() & (F.col("head_sha") != head)).select("id", F.explode("anchors").alias("anchor"))
    paths = a.filter(F.contains("anchor", F.lit("/"))).join(files.select(F.col("path").alias("anchor")), "anchor", "left_anti")
    syms = a.filter(~F.contains("anchor", F.lit("/"))).join(names.select(F.col("name").alias("anchor")), "anchor", "left_anti")
    return paths.unionByName(syms).groupBy("id").agg(F.array_sort(F.collect_set("anchor")).alias("missing"))


def latest_checkpoint(records: DataFrame) -> DataFrame:
    return records.filter("head_sha is not null").agg(F.max("id").alias("id"), F.max_by("head_sha", "id").alias("head_sha"))


def usage_stats(usage: DataFrame) -> DataFrame:
    """Of each tool: calls, errors, mean latency, nearest-rank p50 and p95."""
    return usage.groupBy("tool").agg(F.count(F.lit(1)).alias("calls"), F.sum((~F.col("ok")).cast("int")).alias("errors"), F.round(F.avg("latency_ms"), 6).alias("avg_latency"), *(F.expr(f"percentile_disc({p}) within group (order by latency_ms)").cast("long").alias(n) for p, n in ((0.5, "p50"), (0.95, "p95")))).orderBy(F.desc("calls"), "tool")


def zero_hits(usage: DataFrame, tool: str = "search", limit: int = 20) -> DataFrame:
    return usage.filter((F.col("tool") == tool) & (F.col("hits") == 0) & F.col("query").isNotNull()).groupBy("query").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "query").limit(limit)


# Kinds of records that may be put.
PUT_KINDS = ("note", "finding", "decision", "todo", "context_pack", "ask", "commit", "checkpoint", "miss")


def put_records(local: DataFrame, shared: DataFrame, new: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Both ledgers with the new records of an allowed kind appended."""
    ok = new.filter(F.col("kind").isin(*PUT_KINDS))
    return local.unionByName(ok), shared.unionByName(ok)


def get_records(local: DataFrame, shared: DataFrame, wanted: DataFrame) -> DataFrame:
    """The wanted ids from the local ledger, else from the shared one."""
    both = local.withColumn("scope", F.lit(0)).unionByName(shared.withColumn("scope", F.lit(1))).join(wanted, "id", "left_semi")
    w = Window.partitionBy("id").orderBy("scope")
    return both.withColumn("rn", F.row_number().over(w)).filter("rn = 1").drop("rn")


def search_records(ranked: DataFrame, folded: DataFrame, limit: int = 20, offset: int = 0) -> DataFrame:
    """A page of full-text hits (id, score) followed by folded ones (id, relevance) not among them: id, match."""
    first = ranked.select("id", "score", F.lit("fts").alias("match"), F.lit(0).alias("tier"))
    more = folded.join(ranked.select("id"), "id", "left_anti").select("id", F.col("relevance").alias("score"), F.lit("folded").alias("match"), F.lit(1).alias("tier"))
    return first.unionByName(more).orderBy("tier", F.desc("score"), F.desc("id")).offset(offset).limit(limit).select("id", "match")


def telemetry(calls: DataFrame) -> DataFrame:
    """id, ok, hits, top_paths of tool calls (id, response as JSON): an error makes it not ok, hits are the results' number, five paths stay."""
    r = F.from_json("response", "error string, results array<struct<path:string>>")
    return calls.select("id", r["error"].isNull().alias("ok"), F.when(r["results"].isNotNull(), F.size(r["results"])).alias("hits"), F.slice(F.coalesce(r["results"]["path"], F.array().cast("array<string>")), 1, 5).alias("top_paths"))


def snapshot_restored(snapshot: DataFrame, chunks: DataFrame, dim: int) -> DataFrame:
    """chunk_id, vec of chunks whose embedded text (embed_text) a snapshot (embed_text, vec) has, if of the same dimension; the smallest vec between several."""
    fits = snapshot.filter(F.size("vec") == dim).groupBy(F.sha2(F.col("embed_text").cast("binary"), 256).alias("h")).agg(F.min("vec").alias("vec"))
    return chunks.select("chunk_id", F.sha2(F.col("embed_text").cast("binary"), 256).alias("h")).join(fits, "h").select("chunk_id", "vec")


def checkpointed(records: DataFrame, head: str) -> DataFrame:
    """The ledger (id, kind, head_sha) with a checkpoint at ``head`` as its newest record."""
    newest = records.agg((F.coalesce(F.max("id"), F.lit(0)) + 1).alias("id"))
    return records.unionByName(newest.select("id", F.lit("checkpoint").alias("kind"), F.lit(head).alias("head_sha")))
