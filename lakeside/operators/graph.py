"""Graph operators on edges (src_chunk, dst_chunk or null, dst_name, kind).

Hops are joins of a frontier with the edges; a node stays visited once reached, so no
step grows with the number of paths.  Loops end at the stated number of hops or when the
frontier is empty; lineage is cut each few rounds where there may be many.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as X
from ..sources.storage import dealt, written


def _arcs(edges: DataFrame, direction: str, kinds: list[str] | None = None) -> DataFrame:
    """(a, b) for a step from a to b."""
    e = edges.filter("dst_chunk is not null")
    if kinds:
        e = e.filter(F.col("kind").isin(*kinds))
    out = e.select(F.col("src_chunk").alias("a"), F.col("dst_chunk").alias("b"))
    back = e.select(F.col("dst_chunk").alias("a"), F.col("src_chunk").alias("b"))
    return {"out": out, "in": back}.get(direction, out.unionByName(back)).distinct()


def reach(edges: DataFrame, seeds: DataFrame, hops: int, direction: str = "both", kinds: list[str] | None = None) -> DataFrame:
    """node, depth: all within ``hops`` steps of the seeds (node), each at its least depth."""
    arcs = _arcs(edges, direction, kinds)
    found = frontier = seeds.select("node").distinct().withColumn("depth", F.lit(0))
    for d in range(1, hops + 1):
        nxt = frontier.join(arcs, frontier["node"] == arcs["a"]).select(F.col("b").alias("node")).distinct()
        frontier = nxt.join(found, "node", "left_anti").withColumn("depth", F.lit(d))
        found = found.unionByName(frontier)
    return found


def neighbours(edges: DataFrame, seeds: DataFrame, depth: int = 1, direction: str = "both", kinds: list[str] | None = None, limit: int = 20) -> DataFrame:
    """Edges met by a breadth-first walk from seeds (node), with the depth they are met at; unresolved ones too."""
    e = edges.filter(F.col("kind").isin(*kinds)) if kinds else edges
    near = reach(e, seeds, max(0, min(depth, 3) - 1), direction)
    sides = []
    if direction in ("out", "both"):
        sides.append(e.join(near, e["src_chunk"] == near["node"]).select(e["*"], "depth"))
    if direction in ("in", "both"):
        sides.append(e.join(near, e["dst_chunk"] == near["node"]).select(e["*"], "depth"))
    out = sides[0].unionByName(sides[-1]) if len(sides) == 2 else sides[0]
    return out.groupBy("src_chunk", "dst_chunk", "dst_name", "kind").agg((F.min("depth") + 1).alias("depth")).orderBy("depth", "src_chunk", "dst_name", "kind", "dst_chunk").limit(min(limit, 200))


def impact(edges: DataFrame, seeds: DataFrame, hops: int = 2) -> DataFrame:
    """node, depth of all that depend on the seeds (node), themselves left out, in breadth-first order."""
    return reach(edges, seeds, min(hops, 4), "in").filter(F.col("depth") > 0)


def expand(edges: DataFrame, seeds: DataFrame, depth: int = 2, decay: float = 0.7, limit: int = 60) -> DataFrame:
    """node, depth, score: neighbours of scored seeds (node, score), least depth first, then the largest decayed score."""
    arcs = _arcs(edges, "both")
    best = seeds.groupBy("node").agg(F.max("score").alias("score")).withColumn("depth", F.lit(0))
    step = best
    for d in range(1, depth + 1):
        nxt = step.join(arcs, step["node"] == arcs["a"]).groupBy(F.col("b").alias("node")).agg((F.max("score") * decay).alias("score"))
        step = nxt.join(best, "node", "left_anti").withColumn("depth", F.lit(d))
        best = best.unionByName(step)
    return best.filter("depth > 0").select("node", "depth", F.round("score", 4).alias("score")).orderBy("depth", F.desc("score"), "node").limit(limit)


def shortest_path(edges: DataFrame, start: DataFrame, end: DataFrame, hops: int = 5, kinds: list[str] | None = None) -> DataFrame:
    """One shortest path (array of nodes), the smallest predecessors deciding between equals; no row if none."""
    arcs = _arcs(edges, "out", kinds)
    found = frontier = start.select("node", F.array("node").alias("path"))
    for _ in range(min(hops, 8)):
        step = frontier.join(arcs, frontier["node"] == arcs["a"]).groupBy(F.col("b").alias("node")).agg(F.min("path").alias("path"))
        frontier = step.join(found, "node", "left_anti").select("node", F.concat("path", F.array("node")).alias("path"))
        found = found.unionByName(frontier)
    return found.join(end, "node", "left_semi").select("path")


def simple_paths(edges: DataFrame, start: DataFrame, end: DataFrame, hops: int = 5, limit: int = 10, kinds: list[str] | None = None) -> DataFrame:
    """Paths without repeated nodes from start to end (node, one row each), shortest and smallest first, ``limit`` at most."""
    # each hop uses the rows before it several times: written tables keep plans from growing with the hops
    start, end = written(start), written(end)
    # only nodes that can still reach the end are followed
    useful = reach(edges if not kinds else edges.filter(F.col("kind").isin(*kinds)), end, hops, "in").select(F.col("node").alias("b"), F.col("depth").alias("left"))
    arcs = written(_arcs(edges, "out", kinds).join(useful, "b"))
    goal = end.select(F.col("node").alias("goal"))
    frontier = start.select("node", F.array("node").alias("path"))
    done = None
    for h in range(1, min(hops, 8) + 1):
        step = frontier.join(arcs, frontier["node"] == arcs["a"]).filter(~F.array_contains("path", F.col("b")) & (F.col("left") <= hops - h)).select(F.col("b").alias("node"), F.concat("path", F.array("b")).alias("path"))
        step = written(step.join(F.broadcast(goal), F.col("node") == F.col("goal"), "left"))  # one row
        hit = step.filter("goal is not null").select("path").orderBy("path").limit(limit)
        done = hit if done is None else done.unionByName(hit)
        frontier = step.filter("goal is null").select("node", "path")
    return done.orderBy(F.size("path"), "path").limit(limit)


def one_hop(edges: DataFrame, seeds: DataFrame, per_seed: int) -> DataFrame:
    """seed, node, via (calls, called_by): at most ``per_seed`` on each side, smallest first."""
    e = edges.filter("dst_chunk is not null")
    out = e.select(F.col("src_chunk").alias("seed"), F.col("dst_chunk").alias("node"), F.lit("calls").alias("via"))
    back = e.select(F.col("dst_chunk").alias("seed"), F.col("src_chunk").alias("node"), F.lit("called_by").alias("via"))
    # both sides go to their seed once
    both = dealt(out.unionByName(back), "seed").join(seeds.select(F.col("node").alias("seed")), "seed", "left_semi").distinct()
    w = Window.partitionBy("seed", "via").orderBy("node")
    return both.withColumn("rn", F.row_number().over(w)).filter(F.col("rn") <= per_seed).select("seed", "node", "via")


def pagerank(arcs: DataFrame, rounds: int = 20, damping: float = 0.85, tolerance: float = 1e-6) -> DataFrame:
    """node, rank of a weighted graph (src, dst, weight); self-links are dropped, dangling mass is spread evenly."""
    e = arcs.filter("src <> dst").groupBy("src", "dst").agg(F.sum("weight").alias("weight"))
    nodes = e.select(F.col("src").alias("node")).union(e.select("dst")).distinct()
    out = e.groupBy("src").agg(F.sum("weight").alias("total"))
    share = written(e.join(out, "src").select("src", "dst", (F.col("weight") / F.col("total")).alias("share")))
    n = nodes.count()
    ranks = written(nodes.join(out, nodes["node"] == out["src"], "left").select("node", F.col("total").isNull().alias("dangling"), F.lit(1.0 / max(n, 1)).alias("rank")))
    for k in range(rounds):
        loose = ranks.agg(F.coalesce(F.sum(F.when(F.col("dangling"), F.col("rank"))), F.lit(0.0)).alias("loose"))
        given = share.join(ranks, share["src"] == ranks["node"]).groupBy("dst").agg(F.sum(F.col("share") * F.col("rank")).alias("got"))
        nxt = ranks.withColumnRenamed("rank", "was").join(given, F.col("node") == F.col("dst"), "left").crossJoin(loose)  # one row
        nxt = nxt.select("node", "dangling", "was", ((1 - damping) / n + damping * (F.coalesce("got", F.lit(0.0)) + F.col("loose") / n)).alias("rank"))
        if k % 4 == 3:
            nxt = written(nxt)
            if nxt.agg(F.max(F.abs(F.col("rank") - F.col("was")))).first()[0] < tolerance:
                return nxt.select("node", "rank")
        ranks = nxt.drop("was")
    return ranks.select("node", "rank")


def normalized(ranks: DataFrame) -> DataFrame:
    """node, rank as its share of the span between the least and the greatest rank; 0 where all are equal."""
    span = ranks.agg(F.min("rank").alias("least"), F.max("rank").alias("most"))
    return ranks.crossJoin(span).select("node", F.when(F.expr("most > least"), F.expr("(rank - least) / (most - least)")).otherwise(0.0).alias("rank"))  # one row


def communities(components: DataFrame, paths: DataFrame, top: int = 8) -> DataFrame:
    """component, size, label of the largest: the commonest top folder of their distinct files (node, path), smaller name first."""
    sizes = components.groupBy("component").agg(F.count(F.lit(1)).alias("size")).orderBy(F.desc("size"), "component").limit(top)
    files = components.join(sizes, "component", "left_semi").join(paths.filter("path <> ''"), "node").select("component", "path").distinct()
    hist = files.groupBy("component", X.top_dir(F.col("path")).alias("dir")).agg(F.count(F.lit(1)).alias("n"))
    label = hist.groupBy("component").agg(F.min_by("dir", F.struct(-F.col("n"), "dir")).alias("label"))
    return sizes.join(label, "component", "left").select("component", "size", X.trunc_head(F.coalesce("label", F.lit("?")), 28).alias("label"))


def connected_components(edges: DataFrame) -> DataFrame:
    """node, component (its smallest node) over resolved edges, by large-star and small-star rounds."""
    e = edges.filter("dst_chunk is not null").select(F.greatest("src_chunk", "dst_chunk").alias("u"), F.least("src_chunk", "dst_chunk").alias("v")).filter("u <> v").distinct()
    e = written(e)
    while True:
        both = e.union(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = both.filter("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        nxt = written(small.union(least.select("u", F.col("m").alias("v"))).distinct())
        if nxt.count() == e.count() and nxt.exceptAll(e).isEmpty():
            roots = nxt.select(F.col("v").alias("node")).distinct().withColumn("component", F.col("node"))
            return nxt.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(roots)
        e = nxt
