"""Lookups, joins and resolution over chunks, symbols, edges and records."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as X


def under_path(df: DataFrame, path: str, itself: bool = False) -> DataFrame:
    """Rows below a directory, cases aside; with ``itself`` the path too.  Wildcard characters stand for themselves."""
    inside = F.lower("path").startswith(path.lower() + "/")
    return df.filter(inside | (F.col("path") == path) if itself else inside)


def workspace_tree(files: DataFrame, chunks: DataFrame, symbols: DataFrame, root: str = "", limit: int = 200, offset: int = 0) -> DataFrame:
    """path, depth below root, chunk and symbol counts of each file, a page of them in path order."""
    nc = chunks.groupBy("file_id").agg(F.count(F.lit(1)).alias("n_chunks"))
    ns = symbols.groupBy("file_id").agg(F.count(F.lit(1)).alias("n_symbols"))
    base = under_path(files, root) if root else files
    page = base.orderBy("path").offset(offset).limit(min(limit, 1000))
    depth = F.size(F.split("path", "/")) - (len(root.split("/")) if root else 0)
    j = page.join(nc, page["id"] == nc["file_id"], "left").drop("file_id").join(ns, page["id"] == ns["file_id"], "left")
    return j.select("path", depth.alias("depth"), F.coalesce("n_chunks", F.lit(0)).alias("n_chunks"), F.coalesce("n_symbols", F.lit(0)).alias("n_symbols"))


def find_definitions(symbols: DataFrame, names: DataFrame, files: DataFrame, chunks: DataFrame, each: int = 25) -> DataFrame:
    """Symbols (id, file_id, chunk_id, name) of the wanted names (name; 20 at most) with their file's path and their chunk's lines, if any."""
    w = Window.partitionBy("name").orderBy("id")
    first = symbols.join(F.broadcast(names.limit(20)), "name", "left_semi").withColumn("rn", F.row_number().over(w)).filter(F.col("rn") <= each).drop("rn")
    return first.join(files.select(F.col("id").alias("file_id"), "path"), "file_id").join(chunks.select("chunk_id", "start_line", "end_line"), "chunk_id", "left")


def find_usages(edges: DataFrame, symbols: DataFrame, name: DataFrame, kinds: list[str], limit: int = 50) -> DataFrame:
    """Chunks with an edge to the name (one row: name) or to a chunk that defines it."""
    name = F.broadcast(name.limit(1))  # one row
    defs = symbols.join(name, "name", "left_semi").select(F.col("chunk_id").alias("dst_chunk")).distinct()
    e = edges.filter(F.col("kind").isin(*kinds))
    by_name = e.join(name, e["dst_name"] == name["name"], "left_semi").select("src_chunk")
    by_chunk = e.join(defs, "dst_chunk", "left_semi").select("src_chunk")
    return by_name.union(by_chunk).distinct().orderBy("src_chunk").limit(min(limit, 1000))


def resolve_edges(edges: DataFrame, symbols: DataFrame, scope: DataFrame, qualifiers: DataFrame | None = None) -> DataFrame:
    """edge_id and chunk_id, or null: same file first, then imported files, then the only file with the name.

    ``edges``: edge_id, file, dst_name, qualifier; ``symbols``: id, chunk_id, name, file;
    ``scope``: file, imported.  A qualifier other than self words resolves only within the
    files it stands for (``qualifiers``: file, qualifier, target), else to nothing.
    """
    own = F.coalesce(F.col("qualifier"), F.lit("")).isin("", "self", "cls", "this", "super")
    per = symbols.groupBy("name", "file").agg(F.min_by("chunk_id", "id").alias("chunk_id"), F.min("id").alias("id"))  # ranks go by name and file
    names = per.groupBy("name").agg(F.count("file").alias("n_files"), F.min_by("chunk_id", "id").alias("chunk_id"), F.min("id").alias("id"))
    # what a name stands for in a file is found once for all its edges; a name meets only the files of its rank, never all
    keys = edges.filter(own & F.col("dst_name").isNotNull()).select("file", F.col("dst_name").alias("name")).distinct()
    here = keys.join(per, ["name", "file"]).select("file", "name", "chunk_id", F.lit(1).alias("rank"), "id")
    seen = keys.join(scope.select("file", "imported").distinct(), "file").join(per.withColumnRenamed("file", "imported"), ["name", "imported"]).select("file", "name", "chunk_id", F.lit(2).alias("rank"), "id")
    sole = keys.join(names.filter("n_files = 1"), "name").select("file", "name", "chunk_id", F.lit(3).alias("rank"), "id")
    found = here.unionByName(seen).unionByName(sole).groupBy("file", "name").agg(F.min(F.struct("rank", "id")).alias("key"), F.min_by("chunk_id", F.struct("rank", "id")).alias("chunk_id"))
    best = edges.filter(own).alias("e").join(found.alias("f"), F.expr("e.dst_name = f.name and e.file <=> f.file")).select("edge_id", "f.chunk_id", "f.key")
    if qualifiers is not None:
        q = edges.alias("e").filter(~own).join(qualifiers.alias("q"), F.expr("q.file = e.file and q.qualifier = e.qualifier")).join(per.alias("s"), F.expr("s.name = e.dst_name and s.file = q.target"))
        best = best.unionByName(q.select("edge_id", "s.chunk_id", F.struct(F.lit(0).alias("rank"), F.col("s.id").alias("id")).alias("key")))
    picked = best.groupBy("edge_id").agg(F.min_by("chunk_id", "key").alias("dst_chunk"))
    return edges.select("edge_id").join(picked, "edge_id", "left")


def resolve_any(edges: DataFrame, symbols: DataFrame) -> DataFrame:
    """The looser rule: any symbol of the name, same file first, then the smallest chunk; an unknown file counts as the same."""
    per = symbols.groupBy("name", "file").agg(F.min("chunk_id").alias("own"))
    names = per.groupBy("name").agg(F.min("own").alias("least"), F.min(F.when(F.col("file").isNull(), F.col("own"))).alias("loose"))
    j = edges.select("edge_id", "file", F.col("dst_name").alias("name")).join(per, ["name", "file"], "left").join(names, "name", "left")
    same = F.when(F.col("file").isNull(), F.col("least")).otherwise(F.least("own", "loose"))
    to = j.select("edge_id", same.isNull().alias("other"), F.coalesce(same, "least").alias("c"))
    return to.groupBy("edge_id").agg(F.min_by("c", F.when(F.col("c").isNotNull(), F.struct("other", "c"))).alias("dst_chunk"))


def relabel_bases(edges: DataFrame, symbols: DataFrame) -> DataFrame:
    """implements becomes extends where the target is of a concrete kind, and back for abstract ones."""
    flags = symbols.groupBy("chunk_id", "name").agg(F.max(F.col("kind").isin("class", "struct", "enum", "union", "actor")).alias("concrete"), F.max(F.col("kind").isin("protocol", "interface", "trait")).alias("abstract"))
    j = edges.alias("e").join(flags.alias("f"), F.expr("e.dst_chunk = f.chunk_id and e.dst_name = f.name"), "left")
    kind = F.when((F.col("kind") == "implements") & F.col("concrete"), "extends").when((F.col("kind") == "extends") & F.col("abstract"), "implements").otherwise(F.col("kind"))
    return j.select(*[F.col(f"e.{c}") if c != "kind" else kind.alias("kind") for c in edges.columns])


def chunk_at(lines: DataFrame, chunks: DataFrame, *more: str) -> DataFrame:
    """path, line and the smallest chunk that spans the line, with ``more`` of its columns."""
    j = lines.join(chunks.select("path", "chunk_id", "start_line", "end_line", *more), "path").filter("line between start_line and end_line")
    return j.groupBy("path", "line").agg(F.min_by(F.struct("chunk_id", *more), F.struct(F.expr("end_line - start_line"), "chunk_id")).alias("c")).select("path", "line", "c.*")


def nearest_declaration(lines: DataFrame, decls: DataFrame) -> DataFrame:
    """path, line and the last declaration at or above it: one whose chunk reaches the line if any, then the lowest line, then the largest id.

    ``decls``: id, path, name, decl_line, chunk_end.
    """
    # of declarations that begin and end alike only the one of the largest id can be the answer
    first = decls.groupBy("path", "decl_line", "chunk_end").agg(F.max_by("name", "id").alias("name"), F.max("id").alias("id"))
    j = lines.join(first, "path").filter("decl_line <= line")
    key = F.struct(F.coalesce(F.col("chunk_end") >= F.col("line"), F.lit(False)), "decl_line", "id")
    return j.groupBy("path", "line").agg(F.max_by("name", key).alias("name"))


def declared_spans(symbols: DataFrame, src: DataFrame) -> DataFrame:
    """chunk_id, path, name, start_line, end_line of each declaration: up to the next one of its file, or the file's end."""
    last = src.select("path", F.size(F.split("content", "\n")).alias("n_lines"))
    w = Window.partitionBy("path").orderBy("line", "name")
    span = symbols.join(last, "path").withColumn("end_line", F.coalesce(F.lead("line").over(w) - 1, F.col("n_lines")))
    return span.select(F.xxhash64("path", "name", "line").alias("chunk_id"), "path", "name", F.col("line").alias("start_line"), "end_line")


def match_suffix(traced: DataFrame, files: DataFrame) -> DataFrame:
    """traced path and the longest indexed path of which one ends with the other at a slash.

    Both sides are exploded into their suffixes, so this is an equality join.
    """
    def suffixes(c):
        parts = F.split(c, "/")
        return F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, i, F.size(parts)), "/"))

    t = traced.select("traced").distinct()
    a = t.withColumn("suffix", F.explode(suffixes(F.ltrim("traced", F.lit("/"))))).join(files.select("path"), F.col("suffix") == F.col("path")).select("traced", "path")
    b = files.select("path", F.explode(suffixes(F.col("path"))).alias("suffix")).join(t, F.col("suffix") == F.col("traced")).select("traced", "path")
    return a.union(b).groupBy("traced").agg(F.max_by("path", F.struct(F.length("path"), "path")).alias("path"))


def test_coverage(edges: DataFrame, chunks: DataFrame, symbols: DataFrame, name: str, limit: int = 50) -> DataFrame:
    """Test chunks that reach a symbol: chunk, path, sorted edge kinds, first 25 lines."""
    defs = symbols.filter(F.col("name") == name).select(F.col("chunk_id").alias("d")).distinct()
    hit = edges.join(defs, edges["dst_chunk"] == F.col("d"), "left").filter(F.col("d").isNotNull() | (F.col("dst_chunk").isNull() & (F.col("dst_name") == name)))
    j = hit.join(chunks.select(F.col("chunk_id").alias("src_chunk"), "path"), "src_chunk").filter(X.is_test_path(F.col("path")))
    return j.groupBy("src_chunk", "path").agg(F.array_sort(F.collect_set("kind")).alias("kinds"), F.slice(F.array_sort(F.collect_set("line")), 1, 25).alias("lines")).orderBy("path", "src_chunk").limit(min(limit, 200))


def implicit_targets(events: DataFrame) -> DataFrame:
    """Follow-ups (id, session, tool, target) and the latest search before them in their session, where the target was among its top results."""
    w = Window.partitionBy("session").orderBy("id").rowsBetween(Window.unboundedPreceding, -1)
    last = F.last(F.when(F.col("tool") == "search", F.struct("id", "top")), ignorenulls=True).over(w)
    return events.withColumn("s", last).filter("tool <> 'search' and s is not null and array_contains(s.top, target)").select("id", "session", F.col("s.id").alias("search_id"), "target")


def fetch_chunks(chunks: DataFrame, ids: DataFrame, most: int = 100, bodies: int = 50) -> DataFrame:
    """Chunks of wanted ids (chunk_id), ``most`` at most, the first ``bodies`` with their content."""
    # an answer's ids: at most ``most`` rows, so one window over all of them is small
    wanted = ids.distinct().orderBy("chunk_id").limit(most).withColumn("rn", F.row_number().over(Window.orderBy("chunk_id")))
    return chunks.join(F.broadcast(wanted), "chunk_id").withColumn("content", F.when(F.col("rn") <= bodies, F.col("content"))).drop("rn")


def nearest_root(paths: DataFrame, roots: DataFrame, levels: int = 64) -> DataFrame:
    """path and the longest root that is one of its directories, ``levels`` up at most; paths below none are left out."""
    parts = F.split("path", "/")
    ups = F.transform(F.sequence(F.lit(1), F.least(F.size(parts) - 1, F.lit(levels))), lambda i: F.array_join(F.slice(parts, 1, i), "/"))
    j = paths.filter(F.contains("path", F.lit("/"))).select("path", F.explode(ups).alias("root")).join(roots.distinct(), "root")
    return j.groupBy("path").agg(F.max_by("root", F.length("root")).alias("root"))
