"""Who depends on what: coverage by tests, dependents, risk, patches, traces."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as X
from ..sources.storage import dealt, written
from . import analysis, code, lookup


def test_coverage(edges: DataFrame, names: DataFrame, each: int = 50, lines: int = 25) -> DataFrame:
    """Tests that reach a symbol: name, path, kinds, lines of each test file with an edge to it.

    ``edges``: path, name (of the target), kind, line; ``names``: name.
    """
    hit = edges.join(names.distinct(), "name", "left_semi").filter(X.is_test_path(F.col("path")))
    per = hit.groupBy("name", "path").agg(F.array_sort(F.collect_set("kind")).alias("kinds"), F.slice(F.array_sort(F.collect_set("line")), 1, lines).alias("lines"))
    w = Window.partitionBy("name").orderBy("path")
    return per.withColumn("rn", F.row_number().over(w)).filter(F.col("rn") <= each).drop("rn")


def covered_by(edges: DataFrame) -> DataFrame:
    """What each test file covers: path, name, target file outside tests, kinds.  ``edges``: path, name, kind, target."""
    hit = edges.filter(X.is_test_path(F.col("path")) & F.col("target").isNotNull() & ~X.is_test_path(F.col("target")))
    return hit.groupBy("path", "name", "target").agg(F.array_sort(F.collect_set("kind")).alias("kinds"))


def callers(edges: DataFrame, names: DataFrame) -> DataFrame:
    """name, path, line, resolved of the calls of each name, each once."""
    hit = dealt(edges.select("name", "path", "line", F.col("target").isNotNull().alias("resolved")), "name")
    return hit.join(names.distinct(), "name", "left_semi").distinct()


def dependents(edges: DataFrame, names: DataFrame, each: int = 50) -> DataFrame:
    """name, path, line, resolved, rank of the callers of each name: resolved ones first, then by path and line."""
    w = Window.partitionBy("name").orderBy(F.desc("resolved"), "path", "line")
    return callers(edges, names).withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= each)


def _files(callers: DataFrame) -> DataFrame:
    """name, path, callers, resolved, test of each file that calls a name."""
    return callers.groupBy("name", "path").agg(F.count(F.lit(1)).alias("callers"), F.count_if("resolved").alias("resolved")).withColumn("test", X.is_test_path(F.col("path")))


def risk(callers: DataFrame) -> DataFrame:
    """Of each name: callers, resolved ones, files outside tests and test files (sorted)."""
    named = lambda test: F.array_sort(F.collect_list(F.when(F.col("test") == test, F.col("path"))))
    return _files(callers).groupBy("name").agg(F.sum("callers").alias("callers"), F.sum("resolved").alias("resolved"), named(False).alias("prod_files"), named(True).alias("test_files"))


def parsed_diffs(diffs: DataFrame) -> DataFrame:
    """id, path, start, count, removed, added: a row for each hunk of each diff (id, diff); lines of its file on each."""
    ddl = "id long, path string, start long, count long, removed array<string>, added array<string>"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = [(i, f.path, at, n, f.removed, f.added) for i, d in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True) for f in analysis.parse_diff(d or "") for at, n in f.hunks]
            kinds = [pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.list_(pa.string()), pa.list_(pa.string())]
            cols = list(zip(*rows, strict=True)) if rows else [[]] * 6
            yield pa.record_batch([pa.array(c, t) for c, t in zip(cols, kinds, strict=True)], ["id", "path", "start", "count", "removed", "added"])

    return diffs.select(F.col("id").cast("long"), "diff").mapInArrow(run, ddl)


def patch_changes(hunks: DataFrame, symbols: DataFrame) -> DataFrame:
    """id, path, symbol, change (signature, removed or body), arity before and after.

    A declaration among the removed lines is changed if one of its name is among the added ones, else
    removed; a hunk without declarations changes the body of the last symbol that begins at or above it.
    """
    def declared(side: str) -> DataFrame:
        text = hunks.select("id", "path", F.explode(side).alias("text")).filter(F.col("text").rlike(code.DECLARED)).distinct()
        return text.select("id", "path", F.regexp_extract("text", code.DECLARED, 3).alias("symbol"), code.arity(F.col("text")).alias("arity"))

    gone, new = declared("removed"), declared("added").withColumnRenamed("arity", "after")
    sides = gone.join(new, ["id", "path", "symbol"], "left").select("id", "path", "symbol", F.when(F.col("after").isNull(), "removed").otherwise("signature").alias("change"), F.col("arity").alias("before"), "after")
    plain = hunks.join(gone.select("id", "path").distinct(), ["id", "path"], "left_anti").select("id", "path", "start")
    inside = plain.join(symbols.select("path", "name", F.col("line").alias("at")), "path").filter("at <= start").groupBy("id", "path", "start").agg(F.max_by("name", "at").alias("symbol"))
    none = F.lit(None).cast("int")
    return sides.unionByName(inside.select("id", "path", "symbol", F.lit("body").alias("change"), none.alias("before"), none.alias("after")).distinct())


def simulate_patch(diffs: DataFrame, symbols: DataFrame, edges: DataFrame) -> DataFrame:
    """What a diff changes and who depends on it: the changes with counts of callers and their files."""
    changes = patch_changes(parsed_diffs(diffs), symbols)
    hurt = _files(callers(edges, changes.select(F.col("symbol").alias("name")))).groupBy(F.col("name").alias("symbol")).agg(F.sum("callers").alias("callers"), F.count_if(~F.col("test")).alias("prod_files"), F.count_if("test").alias("test_files"))
    zero = F.lit(0).cast("long")
    return changes.join(hurt, "symbol", "left").select("id", "path", "symbol", "change", "before", "after", *(F.coalesce(c, zero).alias(c) for c in ("callers", "prod_files", "test_files")))


def parsed_traces(traces: DataFrame, runtime: bool = True) -> DataFrame:
    """id, ord, traced (path), line, hint of every frame of every trace (id, trace); without ``runtime`` no reports of a runtime."""
    ddl = "id long, ord int, traced string, line long, hint string"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = [(i, k, *f) for i, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True) for k, f in enumerate(analysis.parse_trace(t or "", runtime))]
            kinds = [pa.int64(), pa.int32(), pa.string(), pa.int64(), pa.string()]
            cols = list(zip(*rows, strict=True)) if rows else [[]] * 5
            yield pa.record_batch([pa.array(c, t) for c, t in zip(cols, kinds, strict=True)], ["id", "ord", "traced", "line", "hint"])

    return traces.select(F.col("id").cast("long"), "trace").mapInArrow(run, ddl)


def _placed(frames: DataFrame, files: DataFrame) -> DataFrame:
    """Frames with the path that they name.  Written, as are the frames before: the steps after read them several times, and traces are parsed once."""
    frames = written(frames)
    return written(frames.join(lookup.match_suffix(frames, files), "traced", "left"))


def resolved_frames(frames: DataFrame, files: DataFrame, symbols: DataFrame) -> DataFrame:
    """Frames with the indexed path that they name and the symbol whose declaration is the last at or above the line."""
    at = _placed(frames, files)
    wanted = at.filter("path is not null").select("path", "line").distinct()
    decls = symbols.select(F.monotonically_increasing_id().alias("id"), "path", "name", F.col("line").alias("decl_line"), F.lit(None).cast("long").alias("chunk_end"))
    return at.join(lookup.nearest_declaration(wanted, decls).withColumnRenamed("name", "symbol"), ["path", "line"], "left")


def suspects(frames: DataFrame, edges: DataFrame, recent: DataFrame, each: int = 20) -> DataFrame:
    """Files that call the deepest resolved symbol of each trace: id, path, recent_commit; resolved callers first, ``each`` at most, then recent ones first."""
    deepest = frames.filter("symbol is not null").groupBy("id").agg(F.max_by("symbol", "ord").alias("name"))
    calls = dealt(edges.select("name", F.col("path").alias("caller"), F.col("target").isNotNull().alias("resolved")), "name").groupBy("name", "caller").agg(F.max("resolved").alias("resolved"))
    # a trace's files are those of its symbol, so they are ranked once a symbol
    w = Window.partitionBy("name").orderBy(F.desc("resolved"), "caller")
    top = calls.withColumn("rn", F.row_number().over(w)).filter(F.col("rn") <= each)
    marked = top.join(recent.select(F.col("path").alias("caller")).distinct().withColumn("recent_commit", F.lit(True)), "caller", "left").withColumn("recent_commit", F.coalesce("recent_commit", F.lit(False)))
    order = Window.partitionBy("name").orderBy(F.desc("recent_commit"), "caller")
    ranked = marked.select("name", F.struct(F.col("caller").alias("path"), "recent_commit", F.row_number().over(order).alias("rank")).alias("f"))
    return deepest.join(ranked.groupBy("name").agg(F.collect_list("f").alias("found")), "name").select("id", F.inline("found"))


def port_frames(frames: DataFrame, files: DataFrame, chunks: DataFrame) -> DataFrame:
    """Frames with the path that they name, the smallest chunk around the line and its name; no chunk, no name."""
    at = _placed(frames, files)
    around = lookup.chunk_at(at.filter("path is not null").select("path", "line").distinct(), chunks, "name").withColumnRenamed("name", "symbol")
    return at.join(around, ["path", "line"], "left")


def port_suspects(frames: DataFrame, edges: DataFrame, chunks: DataFrame, each: int = 20) -> DataFrame:
    """id, path, line, symbol, rank of the calls that resolve to the chunk of each trace's last matched frame, by path and line, ``each`` at most."""
    deepest = frames.filter("path is not null").groupBy("id").agg(F.max_by(F.struct("path", "symbol"), "ord").alias("last")).select("id", F.col("last.path").alias("target"), F.col("last.symbol").alias("name"))
    calls = edges.filter("target is not null").select("path", "line", F.col("name").alias("called"), "target")
    spans = chunks.select("path", "start_line", "end_line", F.struct(F.expr("end_line - start_line"), "chunk_id").alias("size"), F.col("name").alias("symbol"))
    inside = F.expr("line between start_line and end_line")
    # each call with the smallest chunk around it, under the calls' own dealing
    placed = dealt(calls, "path").distinct().join(spans, "path", "left").groupBy("path", "line", "called", "target").agg(F.min_by("symbol", F.when(inside, F.col("size"))).alias("symbol"))
    # a trace's calls are those of its chunk, so they are ranked once a chunk
    w = Window.partitionBy("target", "called").orderBy("path", "line")
    ranked = placed.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= each)
    found = ranked.groupBy("target", F.col("called").alias("name")).agg(F.collect_list(F.struct("path", "line", "symbol", "rank")).alias("found"))
    return deepest.join(found, ["target", "name"]).select("id", F.inline("found"))


def commits(logs: DataFrame, most_files: int = 50) -> DataFrame:
    """sha12, subject, files of a git log (log) whose records are parted by \\x1e and fields by \\x1f: sha, subject, files a line each; each commit once."""
    rows = logs.select(F.explode(F.split("log", "\x1e")).alias("r")).filter(F.trim("r") != "").select(F.split("r", "\x1f").alias("f"))
    files = F.filter(F.split(F.element_at("f", 3), "\n"), lambda p: F.trim(p) != "")
    return rows.select(F.left(F.trim(F.element_at("f", 1)), F.lit(12)).alias("sha12"), F.element_at("f", 2).alias("subject"), F.slice(files, 1, most_files).alias("files")).dropDuplicates(["sha12"])


def anchors(records: DataFrame, files: DataFrame, symbols: DataFrame, each: int = 10) -> DataFrame:
    """id and the names and paths of its text (id, payload) that are indexed: symbols before paths, ``each`` at most."""
    path_rx = r"((?:[\w.-]+/)+[\w.-]+\.\w+)"
    masked = F.regexp_replace("payload", path_rx, " ")
    p = records.select("id", F.explode(F.array_distinct(F.regexp_extract_all("payload", F.lit(path_rx)))).alias("anchor")).join(files.select(F.col("path").alias("anchor")).distinct(), "anchor", "left_semi").withColumn("tier", F.lit(1))
    s = records.select("id", F.explode(F.array_distinct(F.regexp_extract_all(masked, F.lit(r"([A-Za-z_]\w{2,})")))).alias("anchor")).join(symbols.select(F.col("name").alias("anchor")).distinct(), "anchor", "left_semi").withColumn("tier", F.lit(0))
    w = Window.partitionBy("id").orderBy("tier", "anchor")
    return s.unionByName(p).withColumn("rn", F.row_number().over(w)).filter(F.col("rn") <= each).select("id", "anchor", "tier")


def sibling_hints(picked: DataFrame, files: DataFrame, per_dir: int = 6) -> DataFrame:
    """Other files beside the picked (path) whose names share most words with theirs: dir, path, shared."""
    def words(c):
        return F.array_distinct(F.flatten(F.transform(X.alnum_tokens(X.stem(c), 1), X.symbol_tokens)))

    own = picked.select(X.dir_name(F.col("path")).alias("dir"), F.explode(words(F.col("path"))).alias("w")).distinct()
    others = files.join(picked.select("path"), "path", "left_anti").select("path", X.dir_name(F.col("path")).alias("dir"), words(F.col("path")).alias("mine"))
    # word by word: a folder's own words may be as many as its files
    hits = others.select("dir", "path", F.explode_outer("mine").alias("w")).join(own.withColumn("own", F.lit(True)), ["dir", "w"], "left").groupBy("dir", "path").agg(F.size(F.collect_set(F.when(F.col("own"), F.col("w")))).alias("shared"))
    j = hits.join(own.select("dir").distinct(), "dir", "left_semi")
    w = Window.partitionBy("dir").orderBy(F.desc("shared"), "path")
    return j.withColumn("rn", F.row_number().over(w)).filter(F.col("rn") <= per_dir).select("dir", "path", "shared")


def cited(citations: DataFrame, pack: DataFrame) -> DataFrame:
    """id and why a citation (id, path, line) is refused: unknown path, line outside, repeated; null if it stands.  ``pack``: path, start_line, end_line."""
    known = pack.groupBy("path").agg(F.min("start_line").alias("low"), F.max("end_line").alias("high"))
    rn = F.row_number().over(Window.partitionBy("path", "line").orderBy("id"))
    j = citations.withColumn("rn", rn).join(known, "path", "left")
    reason = F.when(F.col("low").isNull(), "path").when(~F.expr("line between low and high"), "line").when(F.col("rn") > 1, "repeated")
    return j.select("id", reason.alias("reason"))


def context_pack(seeds: DataFrame, hops: DataFrame, budget: int = 50) -> DataFrame:
    """node, via, from seeds (node, score) and their one-hop neighbours (seed, node, via): direct ones first, two thirds of the budget, then neighbours of the best."""
    direct_cap = max(3, budget * 2 // 3)
    direct = seeds.orderBy(F.desc("score"), "node").limit(direct_cap)
    per_seed = max(2, budget // max(direct_cap, 1))
    w = Window.partitionBy("seed").orderBy("via", "node")
    near = hops.join(F.broadcast(direct.select(F.col("node").alias("seed"), "score")), "seed").withColumn("rn", F.row_number().over(w)).filter(F.col("rn") <= per_seed)
    fresh = near.join(direct.select("node"), "node", "left_anti").groupBy("node").agg(F.max_by("via", F.struct("score", "via")).alias("via"), F.max("score").alias("score"))
    both = direct.select("node", F.lit("direct").alias("via"), "score", F.lit(0).alias("tier")).unionByName(fresh.select("node", "via", "score", F.lit(1).alias("tier")))
    return both.orderBy("tier", F.desc("score"), "node").limit(budget).select("node", "via", "tier")
