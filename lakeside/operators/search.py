"""Stages of search around the fused ranking: probes by path, expansion, rescue, budgets."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as X
from . import fts


def mode(query: Column) -> Column:
    """identifier for one word that looks like code, else hybrid."""
    return F.when(X.identifier_like(F.trim(query)), "identifier").otherwise("hybrid")


def path_terms(files: DataFrame) -> DataFrame:
    """path and each distinct token of it."""
    return files.select("path", F.explode(F.array_distinct(X.path_tokens(F.col("path")))).alias("token"))


def path_frequency(files: DataFrame, atoms: DataFrame) -> DataFrame:
    """atom and the number of files with a path token that begins with it (0 too)."""
    # the atoms of a query: at most 24 rows
    hit = path_terms(files).join(F.broadcast(atoms), F.expr("startswith(token, atom)")).groupBy("atom").agg(F.count_distinct("path").alias("df"))
    return atoms.join(hit, "atom", "left").select("atom", F.coalesce("df", F.lit(0).cast("long")).alias("df"))


def path_leg(files: DataFrame, atoms: DataFrame, n_files: DataFrame) -> DataFrame:
    """path, score: the sum of ln(1 + N / df) over atoms that begin a token of the path, without those in more than max(8, N / 5) files."""
    df = path_frequency(files, atoms.orderBy("atom").limit(24)).crossJoin(n_files).filter("df > 0 and df <= greatest(8, 0.2 * n)")  # one row
    hit = path_terms(files).join(F.broadcast(df), F.expr("startswith(token, atom)")).select("path", "atom", F.log(1 + F.col("n") / F.col("df")).alias("w")).distinct()
    return hit.groupBy("path").agg(F.sum("w").alias("score"))


def symbol_leg(symbols: DataFrame, words: DataFrame) -> DataFrame:
    """chunk_id, other: chunks with a symbol whose name is a query word (0) or has one as a part (1)."""
    long = symbols.select("chunk_id", F.lower("name").alias("low"), X.symbol_tokens(F.col("name")).alias("parts"))
    names = long.select("chunk_id", F.col("low").alias("word"), F.lit(0).alias("other")).unionByName(long.select("chunk_id", F.explode("parts").alias("word"), F.lit(1).alias("other")))
    return names.join(F.broadcast(words), "word", "left_semi").groupBy("chunk_id").agg(F.min("other").alias("other"))


def best_per_file(hits: DataFrame) -> DataFrame:
    """Of each file the chunk with the best score: file_id, id, score; the smaller id between equals."""
    return hits.groupBy("file_id").agg(F.max_by("id", F.struct("score", -F.col("id"))).alias("id"), F.max("score").alias("score"))


def cooccurring(tokens: DataFrame, rare: DataFrame, siblings: int = 6, total: int = 8, most: int = 60) -> DataFrame:
    """Tokens that stand in files with a rare atom: atom, token, n; the commonest six of each atom, eight in all, none in more than ``most`` files."""
    df = tokens.groupBy("token").agg(F.count_distinct("path").alias("df"))
    usable = tokens.join(df.filter(F.col("df") <= most), "token", "left_semi")
    with_atom = tokens.join(F.broadcast(rare), F.col("token") == F.col("atom")).select("atom", "path").distinct()
    n = with_atom.join(usable, "path").filter("token <> atom").groupBy("atom", "token").agg(F.count_distinct("path").alias("n"))
    w = Window.partitionBy("atom").orderBy(F.desc("n"), "token")
    return n.withColumn("rn", F.row_number().over(w)).filter(F.col("rn") <= siblings).drop("rn").orderBy(F.desc("n"), "token", "atom").limit(total)


def merge_hits(strong: DataFrame, champions: DataFrame, rest: DataFrame, cap: int) -> DataFrame:
    """path, tier: strong hits first (``cap`` at most), then champions, then the rest; each path once, at its best tier."""
    tiers = [strong.orderBy(F.desc("score"), "path").limit(cap), champions, rest]
    both = reduce(DataFrame.unionByName, [t.select("path", "score", F.lit(i).alias("tier")) for i, t in enumerate(tiers)])
    w = Window.partitionBy("path").orderBy("tier", F.desc("score"))
    return both.withColumn("rn", F.row_number().over(w)).filter("rn = 1").select("path", "tier", "score")


def ranked_hits(scored: DataFrame, keys: list[Column], limit: int = 10, per_dir: int = 2) -> DataFrame:
    """The hits in a stable order of many keys, at most ``per_dir`` of a directory, each base name once."""
    order = [*keys, F.col("path")]
    in_dir = Window.partitionBy(X.dir_name(F.col("path"))).orderBy(*order)
    by_name = Window.partitionBy(X.base_name(F.col("path"))).orderBy(*order)
    named = scored.withColumn("rn", F.row_number().over(by_name)).filter("rn = 1").drop("rn")
    return named.withColumn("rn", F.row_number().over(in_dir)).filter(F.col("rn") <= per_dir).drop("rn").orderBy(*order).limit(limit)


def probe_score(path: Column, covered: Column, stems: Column, sole: Column, whole: Column) -> Column:
    """Evidence of a path probe: covered atoms, density of stems, the only carrier, the whole name, less tests and archives."""
    return covered + stems + F.when(sole, 1.0).otherwise(0.0) + F.when(whole, 0.75).otherwise(0.0) - F.when(X.is_test_like(path), 0.5).otherwise(0.0) - 0.5 * X.archive_segments(path)


def substring_probe(files: DataFrame, atoms: DataFrame, each: int = 5) -> DataFrame:
    """atom, path: files of which a path token ends with an atom, the newest of each atom first, ``each`` at most."""
    ends = files.select("path", "mtime", F.explode(F.array_distinct(X.path_tokens(F.col("path")))).alias("token"))
    # the atoms of a query
    hit = ends.join(F.broadcast(atoms), F.expr("endswith(token, atom)")).select("atom", "path", "mtime").distinct()
    w = Window.partitionBy("atom").orderBy(F.desc("mtime"), "path")
    return hit.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= each).select("atom", "path", "rank")


def tail_rescue(hits: DataFrame, rescue: DataFrame, protect: int = 2, limit: int = 10) -> DataFrame:
    """path, rank of the first ``limit`` hits (path, rank), the last one giving way to the best rescued path (path, score) that is not there; the first ``protect`` never do."""
    # a list of results: at most ``limit`` rows, so one window over all of it is small
    top = hits.orderBy("rank", "path").limit(limit)
    better = rescue.join(top, "path", "left_anti").orderBy(F.desc("score"), "path").limit(1)
    size = top.agg(F.count(F.lit(1)).alias("n")).crossJoin(better.agg(F.count(F.lit(1)).alias("m")))  # one row each
    kept = top.crossJoin(size).filter(F.col("rank") <= F.greatest(F.lit(protect), F.when(F.col("n") < limit, F.col("n")).otherwise(limit - F.col("m")))).select("path", "rank")
    last = better.crossJoin(size).select("path", F.least(F.col("n") + 1, F.lit(limit)).cast("int").alias("rank"))
    return kept.unionByName(last.filter(F.col("rank") > protect))


def head_lift(hits: DataFrame) -> DataFrame:
    """Hits in a stable order: whole phrase first, then code before other kinds, then coverage, else as ranked."""
    # a list of results, so one window over all of it is small
    w = Window.orderBy(F.desc("phrase"), F.desc(X.kind_tag(F.col("path")) == "code"), F.desc("covered"), "rank", "path")
    return hits.withColumn("lifted", F.row_number().over(w))


def expand_lexicon(queries: DataFrame, lexicon: DataFrame) -> DataFrame:
    """id and the translations (pattern, terms) of patterns that stand in a query (id, query) as whole words, longest pattern first."""
    padded = F.concat(F.lit(" "), F.array_join(F.filter(F.split(X.fold_text(F.col("query")), fts.TOKEN_SPLIT), lambda t: t != ""), " "), F.lit(" "))
    # a lexicon is a fixed table of a few hundred rows
    hit = queries.select("id", padded.alias("hay")).join(F.broadcast(lexicon), F.expr("contains(hay, concat(' ', pattern, ' '))"))
    w = Window.partitionBy("id").orderBy(F.desc(F.length("pattern")), "pattern")
    return hit.withColumn("rank", F.row_number().over(w)).select("id", "pattern", "terms", "rank")


def within_budget(rows: DataFrame, budget: int, by: str, order: list[Column], content: str = "content") -> DataFrame:
    """Rows of each response (``by``) in order while their contents fit into ``budget`` characters together; adds ``used``."""
    w = Window.partitionBy(by).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return rows.withColumn("used", F.sum(F.length(content)).over(w)).filter(F.col("used") <= budget)


def shortened(c: Column, budget_left: Column) -> Column:
    """A content cut to 2048, 512 or 128 characters, the first that fits what is left, with an ellipsis."""
    cut = lambda n: X.trunc_head(c, n)
    return F.when(F.length(c) <= budget_left, c).when(budget_left >= 2048, cut(2048)).when(budget_left >= 512, cut(512)).otherwise(cut(128))


def evidence_pack(hits: DataFrame, budget: int, items: int = 12, overhead: int = 14) -> DataFrame:
    """Best chunk of each file in order of score while tokens (a quarter of the characters and ``overhead``) fit: id, file_id, tokens, used."""
    best = hits.groupBy("file_id").agg(F.max_by(F.struct("id", "content"), F.struct("score", -F.col("id"))).alias("b"), F.max("score").alias("score"))
    # a pack: at most ``items`` rows
    first = best.orderBy(F.desc("score"), "file_id").limit(items).select("file_id", "b.id", "score", (X.est_tokens(F.col("b.content")) + overhead).alias("tokens"))
    w = Window.orderBy(F.desc("score"), "file_id").rowsBetween(Window.unboundedPreceding, 0)
    return first.withColumn("used", F.sum("tokens").over(w)).filter(F.col("used") <= budget)


def port_pack(hits: DataFrame, edges: DataFrame, chunks: DataFrame, budget: int, found: int = 16, direct: int = 6, related: int = 3, overhead: int = 14) -> DataFrame:
    """id, why, tokens: the first files of the best ``found`` hits (id, file_id, score), then their neighbours (seed, node, why), the last one cut to the budget."""
    best = F.struct("score", -F.col("id"))
    top = hits.orderBy(F.desc("score"), "id").limit(found).groupBy("file_id").agg(F.max_by("id", best).alias("id"), F.max("score").alias("score"))
    # packs: a few rows, so windows over all of them are small
    seeds = top.orderBy(F.desc("score"), "id").limit(direct).withColumn("at", F.row_number().over(Window.orderBy(F.desc("score"), "id")))
    order = F.col("at") * 2 + F.when(F.col("why") == "calls", 0).otherwise(1)
    near = edges.join(F.broadcast(seeds.select(F.col("id").alias("seed"), "at")), "seed").withColumn("at", order).join(seeds.select(F.col("id").alias("node")), "node", "left_anti")
    fresh = near.join(chunks.select(F.col("id").alias("node")), "node", "left_semi").groupBy("node").agg(F.min_by("why", "at").alias("why"), F.min("at").alias("at")).orderBy("at", "node").limit(related)
    items = seeds.select("id", F.lit("direct").alias("why"), "at", F.lit(0).alias("tier")).unionByName(fresh.select(F.col("node").alias("id"), "why", "at", F.lit(1).alias("tier")))
    sized = chunks.join(F.broadcast(items), "id").select("id", "why", "tier", "at", (X.est_tokens(F.col("content")) + overhead).alias("tokens"))
    before = F.coalesce(F.sum("tokens").over(Window.orderBy("tier", "at", "id").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0).cast("long"))
    return sized.withColumn("before", before).filter(F.col("before") < budget).select("id", "why", F.least("tokens", budget - F.col("before")).alias("tokens"))
