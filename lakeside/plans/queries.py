"""The engine's queries on the given tables, by operator id, each with its SQL for DuckDB."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import text as X
from ..operators import fts, graph, ingest, ledger, lookup, vector
from ..sources import tables as T

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

# --- the engine's tables in SQL ------------------------------------------------------------------
FILES = "files as (select doc_id as id, 'src/' || source || '/' || lang || '/doc_' || doc_id || '.txt' as path, lang, text as content, sha256(text) as sha, n_chars as size, cast(doc_id * 97 % 1000 as double) as mtime from documents)"
CHUNKS = FILES + ", lined as (select *, string_split(content, chr(10)) as lines from files), cut as (select *, unnest(range(0, greatest(len(lines) - 1 - 5, 0) + 1, 15)) as at_line from lined), chunks as (select id as file_id, path, at_line // 15 as idx, at_line + 1 as start_line, least(at_line + 20, len(lines)) as end_line, array_to_string(lines[at_line + 1 : at_line + 20], chr(10)) as content, id * 1048576 + at_line // 15 as chunk_id from cut)"
SYMBOLS = "symbols as (select p_partkey as id, p_partkey as chunk_id, p_name as name, p_brand as file, p_type as kind, p_size as line from part)"


EDGES = f"{SYMBOLS}, l as (select distinct l_orderkey as o, l_linenumber as n, l_partkey as p from lineitem), arcs as (select distinct a.p as src_chunk, b.p as dst from l a join l b on a.o = b.o and a.n + 1 = b.n and a.p <> b.p), edges as (select src_chunk, case when dst % 7 <> 0 then dst end as dst_chunk, name as dst_name, case when (src_chunk + dst) % 5 = 0 then 'imports' else 'calls' end as kind, cast((src_chunk * 31 + dst) % 100 + 1 as int) as line from arcs join symbols on id = dst), both_ways as (select src_chunk as a, dst_chunk as b from edges where dst_chunk is not null union select dst_chunk, src_chunk from edges where dst_chunk is not null), backwards as (select distinct dst_chunk as a, src_chunk as b from edges where dst_chunk is not null), forwards as (select distinct src_chunk as a, dst_chunk as b from edges where dst_chunk is not null)"


RECORDS = "records as (select conv_id * 1048576 + turn as id, conv_id % 3 as ws, role as kind, 'chat' as source, case when turn % 2 = 0 then 'completed' else 'open' end as status, string_split(text, chr(10))[1] as title, text as payload, case when conv_id % 4 = 0 then 'sha' || conv_id end as head_sha from conversations)"
USAGE = "usage as (select event_id as id, event_type as tool, cast(floor(value * 100) as bigint) as latency_ms, event_type <> 'error' as ok, user_id as session, cast(json_extract_string(props, '$.k') as bigint) as hits from events)"


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def values(spark: SparkSession, cols: str, rows: list[tuple]) -> DataFrame:
    return spark.createDataFrame(rows, ", ".join(f"{c} string" for c in cols.split()))


def sql_values(cols: str, rows: list[tuple]) -> str:
    def lit(x) -> str:
        return "null" if x is None else "'" + str(x).replace("'", "''").replace("\n", "' || chr(10) || '") + "'"

    return "(values " + ", ".join("(" + ", ".join(map(lit, r)) + ")" for r in rows) + f") as t({', '.join(cols.split())})"


DIRS = ["src/app", "web", "", "docs/_archive-2020", "lib/old", "tests", "a/b", "conf", "pkg/spec", "my", "dir.v1"]
LEAVES = ["Main.swift", "client.test.ts", "Makefile", "README.md", "x.py", "test_a.py", "contest.py", ".env", "app.toml", "x.CSV", "noext", "thing_test.go", "id_rsa.pub", "Secrets.json", "api.mock.js", "file"]
#: A path for each part: folders and names of all kinds in turn.
ODD = f"(select p_partkey as id, case when {DIRS}[p_partkey % {len(DIRS)} + 1] = '' then '' else {DIRS}[p_partkey % {len(DIRS)} + 1] || '/' end || {LEAVES}[p_partkey // {len(DIRS)} % {len(LEAVES)} + 1] as path from part) as t"


def odd_paths(spark: SparkSession, d: str) -> DataFrame:
    i = F.col("p_partkey")
    at = lambda xs, k: F.element_at(F.array(*[F.lit(x) for x in xs]), (k % len(xs) + 1).cast("int"))
    folder = at(DIRS, i)
    return T.read(spark, d, "part").select(i.alias("id"), F.concat(F.when(folder == "", "").otherwise(F.concat(folder, F.lit("/"))), at(LEAVES, F.floor(i / len(DIRS)))).alias("path"))


# --- functions -----------------------------------------------------------------------------------
STRIP = "replace(replace(strip_accents(lower({})), 'đ', 'd'), 'ı', 'ı')"


@query(f"with f as (select doc_id, {STRIP.format('text')} as folded from documents) select doc_id, md5(folded) as folded_md5, length(folded) as n from f")
def t2_fold_text(spark, d):
    f = X.fold_text(F.col("text"))
    return T.read(spark, d, "documents").select("doc_id", F.md5(f.cast("binary")).alias("folded_md5"), F.length(f).cast("long").alias("n"))


@query("with t as (select doc_id, list_filter(regexp_split_to_array(text, '[^\\p{L}\\p{M}\\p{N}]+'), lambda x: length(x) >= 2) as w from documents) select doc_id, len(w) as n, md5(array_to_string(w, ' ')) as words_md5 from t")
def s3_alnum_split(spark, d):
    w = X.alnum_tokens(F.col("text"))
    return T.read(spark, d, "documents").select("doc_id", F.size(w).cast("long").alias("n"), F.md5(F.array_join(w, " ").cast("binary")).alias("words_md5"))


CASES = "case p_partkey % 4 when 0 then a || upper(b[1]) || b[2:] when 1 then a || '_' || b when 2 then upper(a) || upper(b[1]) || b[2:] else upper(a[1]) || a[2:] || upper(b) end"


@query(f"with w as (select p_partkey, string_split(p_name, ' ')[1] as a, string_split(p_name, ' ')[2] as b from part) select p_partkey as id, {CASES} as name, a || ' ' || b as parts from w")
def t3_symbol_tokens(spark, d):
    w, i = F.split("p_name", " "), F.col("p_partkey")
    a, b = F.element_at(w, 1), F.element_at(w, 2)
    name = F.when(i % 4 == 0, F.concat(a, F.initcap(b))).when(i % 4 == 1, F.concat(a, F.lit("_"), b)).when(i % 4 == 2, F.concat(F.upper(a), F.initcap(b))).otherwise(F.concat(F.initcap(a), F.upper(b)))
    return T.read(spark, d, "part").select(i.alias("id"), name.alias("name")).select("id", "name", F.array_join(X.symbol_tokens(F.col("name")), " ").alias("parts"))


@query("with w as (select p_partkey as id, string_split(p_name, ' ')[1] as a, string_split(p_name, ' ')[2] as b from part) select id, 'src/' || a || '_' || b || '/' || a || upper(b[1]) || b[2:] || '.ts' as path, concat_ws(' ', 'src', 'src', a, a, b, b, a || b, a, b, 'ts', 'ts') as tokens from w")
def t4_path_tokens(spark, d):
    w = F.split("p_name", " ")
    a, b = F.element_at(w, 1), F.element_at(w, 2)
    path = F.concat(F.lit("src/"), a, F.lit("_"), b, F.lit("/"), a, F.initcap(b), F.lit(".ts"))
    return T.read(spark, d, "part").select(F.col("p_partkey").alias("id"), path.alias("path")).select("id", "path", F.array_join(X.path_tokens(F.col("path")), " ").alias("tokens"))


@query(f"""select id, path, string_split(path, '/')[-1] as base, case when contains(path, '/') then regexp_replace(path, '/[^/]*$', '') else '' end as dir, case when contains(path, '/') then string_split(path, '/')[1] else '' end as top, lower(regexp_extract(string_split(path, '/')[-1], '[^.]\\.([^.]*)$', 1)) as ext from {ODD}""")
def s4_path_ops(spark, d):
    p = F.col("path")
    return odd_paths(spark, d).select("id", "path", X.base_name(p).alias("base"), X.dir_name(p).alias("dir"), X.top_dir(p).alias("top"), X.extension(p).alias("ext"))


@query("select doc_id, case when length(text) > 40 then left(text, 39) || '…' else text end as head, case when length(text) > 40 then '…' || right(text, 39) else text end as tail, cast(ceil(length(text) / 4.0) as bigint) as tokens from documents")
def s5_s12_strings(spark, d):
    t = F.col("text")
    return T.read(spark, d, "documents").select("doc_id", X.trunc_head(t, 40).alias("head"), X.trunc_tail(t, 40).alias("tail"), X.est_tokens(t).alias("tokens"))


@query("with n as (select doc_id, trim(regexp_replace(lower(text), '\\s+', ' ', 'g')) as norm from documents) select doc_id, md5(norm) as norm_md5, length(norm) as n from n")
def s14_normalize_text(spark, d):
    norm = X.normalize_query(F.col("text"))
    return T.read(spark, d, "documents").select("doc_id", F.md5(norm.cast("binary")).alias("norm_md5"), F.length(norm).cast("long").alias("n"))


@query("select event_id, cast(json_extract_string(props, '$.k') as bigint) as k, round(sqrt(abs(value)), 6) as root, cast(ceil(value) as bigint) as up, greatest(value, 50) as most, case event_type when 'click' then 1 else 0 end as is_click, sha256(event_type) as sha from events")
def s1_s6_s8_s9_scalars(spark, d):
    return T.read(spark, d, "events").select("event_id", F.get_json_object("props", "$.k").cast("long").alias("k"), F.round(F.sqrt(F.abs("value")), 6).alias("root"), F.ceil("value").alias("up"), F.greatest(F.col("value"), F.lit(50.0)).alias("most"), F.when(F.col("event_type") == "click", 1).otherwise(0).alias("is_click"), F.sha2(F.col("event_type").cast("binary"), 256).alias("sha"))


@query("select page_id, regexp_extract_all(url, '[a-z]+', 0) as words, url like 'http://%' as plain, url like '%\\_source=%' escape '\\' as tagged from pages")
def s2_s10_patterns(spark, d):
    return T.read(spark, d, "pages").select("page_id", F.regexp_extract_all("url", F.lit("[a-z]+"), 0).alias("words"), F.col("url").like("http://%").alias("plain"), F.col("url").like("%\\_source=%").alias("tagged"))


def _case(table: dict[str, str], key: str) -> str:
    return f"case {key} " + " ".join(f"when '{k}' then '{v}'" for k, v in table.items()) + " end"


_BASE, _EXT = "lower(string_split(path, '/')[-1])", "lower(regexp_extract(string_split(path, '/')[-1], '[^.]\\.([^.]*)$', 1))"


@query(f"select id, path, coalesce({_case(X.BASE_NAMES, _BASE)}, {_case(X.EXTENSIONS, _EXT)}) as lang, coalesce({_case({e: k for k, es in X.KIND_TAGS.items() for e in es.split()}, _EXT)}, 'other') as tag from {ODD}")
def i5_s13_language(spark, d):
    return odd_paths(spark, d).select("id", "path", X.language(F.col("path")).alias("lang"), X.kind_tag(F.col("path")).alias("tag"))


@query(f"select id, path, (" + " or ".join(f"starts_with({_BASE}, '{s}') or ends_with({_BASE}, '{s}')" for s in X.SECRET_NAMES) + f" or contains({_BASE}, 'secret')) as secret from {ODD}")
def i3_secret_names(spark, d):
    return odd_paths(spark, d).select("id", "path", X.is_secret_name(X.base_name(F.col("path"))).alias("secret"))


@query(f"select id, path, regexp_matches(path, '^(tests|test|__tests__)/|/(tests|test|__tests__)/|\\.(test|spec)\\.|_test\\.') or contains(lower(path), '.mock.') or regexp_matches({_BASE}, '^test[-_]') as ranking, regexp_matches(path, '(?i)(test|spec)') as impact from {ODD}")
def f8_f9_test_paths(spark, d):
    return odd_paths(spark, d).select("id", "path", X.is_test_like(F.col("path")).alias("ranking"), X.is_test_path(F.col("path")).alias("impact"))


@query(f"select id, path, len(list_filter(string_split(lower(path), '/')[:-2], lambda s: list_has_any(regexp_split_to_array(s, '[^\\p{{L}}\\p{{N}}]+'), {list(X.ARCHIVE_WORDS)}))) as n from {ODD}")
def f11_archive_segments(spark, d):
    return odd_paths(spark, d).select("id", "path", X.archive_segments(F.col("path")).cast("long").alias("n"))


RAW_KINDS = [r for rs in X.NORM_KINDS.values() for r in rs.split()] + ["unknown_node"]
DECLS = ["final class A", "struct B", "", "extension Y", "enum E { }", "trait T"]
_DECL = f"{DECLS}[p_partkey // 7 % {len(DECLS)} + 1]"


@query(f"with k as (select p_partkey as id, {RAW_KINDS}[p_partkey % {len(RAW_KINDS)} + 1] as raw, {_DECL} as decl from part), w as (select *, regexp_extract(decl, '\\b(struct|enum|actor|extension|protocol|interface|class)\\b', 1) as word from k) select id, raw, case when raw in ('class_declaration', 'extension_declaration') and word <> '' then word else coalesce({_case({r: k for k, rs in X.NORM_KINDS.items() for r in rs.split()}, 'raw')}, raw) end as kind from w")
def i14_norm_kind(spark, d):
    i = F.col("p_partkey")
    at = lambda xs, k: F.element_at(F.array(*[F.lit(x) for x in xs]), (k % len(xs) + 1).cast("int"))
    k = T.read(spark, d, "part").select(i.alias("id"), at(RAW_KINDS, i).alias("raw"), at(DECLS, F.floor(i / 7)).alias("decl"))
    return k.select("id", "raw", X.norm_kind(F.col("raw"), F.col("decl")).alias("kind"))


@query("""with a as (select page_id, regexp_replace(trim(url), '^https?://[^/]+', '') as p from pages), b as (select page_id, p = '' as gone, regexp_replace(p, '[?#][\\s\\S]*$', '') as p from a), c as (select page_id, gone, case when starts_with(p, '/') then p else '/' || p end as p from b), e as (select page_id, gone, case when length(p) > 1 then '/' || rtrim(substr(p, 2), '/') else p end as p from c)
select page_id, case when not gone and length(p) > 1 and not contains(p, ' ') and (regexp_matches(p, '^/[^/]*/.') or regexp_matches(p, '(?i)^/(api|graphql|auth|health|status|webhook|oauth)(/|$)') or regexp_matches(p, '^/v\\d*(/|$)')) then p end as route from e""")
def i20_norm_route(spark, d):
    return T.read(spark, d, "pages").select("page_id", X.norm_route(F.col("url")).alias("route"))


# --- sources and change detection ------------------------------------------------------------------
@query(f"with {CHUNKS} select chunk_id, idx, start_line, end_line, md5(content) as content_md5, length(content) // 4 as tokens from chunks")
def i8_window_chunks(spark, d):
    return T.chunks(spark, d).select("chunk_id", F.col("idx").cast("long"), F.col("start_line").cast("long"), F.col("end_line").cast("long"), F.md5(F.col("content").cast("binary")).alias("content_md5"), "tokens")


def _manifests(spark, d):
    """Two listings of all files: some renamed, some edited, some only touched between them."""
    f = T.files(spark, d).select("id", "path", "sha", "size", "mtime")
    named = lambda tail, rest: F.when(F.col("id") % 10 == rest, F.concat("path", F.lit(tail))).otherwise(F.col("path"))
    old = f.withColumn("path", named(".old", 1)).drop("id")
    new = f.withColumn("path", named(".new", 2)).withColumn("sha", F.when(F.col("id") % 10 == 3, F.sha2(F.concat("sha", F.lit("x")).cast("binary"), 256)).otherwise(F.col("sha"))).withColumn("mtime", F.when(F.col("id") % 10 > 2, F.col("mtime") + F.col("id") % 2).otherwise(F.col("mtime")))
    return old, new.drop("id")


MANIFESTS = FILES + ", old as (select case when id % 10 = 1 then path || '.old' else path end as path, sha, size, mtime from files), new as (select case when id % 10 = 2 then path || '.new' else path end as path, case when id % 10 = 3 then sha256(sha || 'x') else sha end as sha, size, case when id % 10 > 2 then mtime + id % 2 else mtime end as mtime from files), fresh as (select coalesce(o.path, n.path) as path, case when o.path is null then 'added' when n.path is null then 'deleted' when o.size = n.size and o.mtime = n.mtime or o.sha = n.sha then 'unchanged' else 'changed' end as status from old o full join new n on o.path = n.path)"


@query(f"with {MANIFESTS} select path, status from fresh")
def i6_i25_freshness(spark, d):
    return ingest.freshness(*_manifests(spark, d))


@query(f"with {MANIFESTS} select status, count(*) as n from fresh group by status")
def i26_dry_run(spark, d):
    return ingest.dry_run(*_manifests(spark, d))


@query(f"with {MANIFESTS} select path from old where path not in (select path from new)")
def i7_stale_files(spark, d):
    old, new = _manifests(spark, d)
    return ingest.stale(old, new).select("path")


@query(f"with {CHUNKS}, emb as (select vec_id * 1048576 as chunk_id from embeddings) select chunk_id from chunks where chunk_id not in (select chunk_id from emb)")
def j9_pending_embeddings(spark, d):
    emb = T.vectors(spark, d).select((F.col("vec_id") * 1048576).alias("chunk_id"))
    return ingest.pending_embeddings(T.chunks(spark, d), emb).select("chunk_id")


@query(f"with {CHUNKS} select chunk_id, md5(left(path || chr(10) || 'window' || chr(10) || content, 1800)) as text_md5 from chunks")
def i23_embed_text(spark, d):
    c = T.chunks(spark, d).withColumn("symbol", F.lit(None).cast("string")).withColumn("kind", F.lit("window"))
    return ingest.embed_text(c).select("chunk_id", F.md5(F.col("embed_text").cast("binary")).alias("text_md5"))


@query(f"with {CHUNKS}, q as (select id as file_id, id % 60 + 1 as line from files), j as (select q.file_id, q.line, c.idx, c.start_line, c.end_line from q left join chunks c on c.file_id = q.file_id and c.start_line <= q.line) select file_id, line, coalesce(min(idx) filter (where end_line >= line), arg_max(idx, start_line), 0) as idx from j group by 1, 2")
def i21_line_to_chunk(spark, d):
    q = T.files(spark, d).select(F.col("id").alias("file_id"), (F.col("id") % 60 + 1).alias("line"))
    return ingest.line_owner(q, T.chunks(spark, d)).select("file_id", "line", F.col("idx").cast("long"))


@query("select 'api/m' || p_partkey || '.py' as path, unnest([1, 2, 4]) as line, unnest(['/api/items/' || p_partkey, '/api/items/' || (p_partkey + 1), '/v1/ping']) as route, unnest(['route', 'api_call', 'api_call']) as kind from part")
def i19_routes(spark, d):
    s = F.col("p_partkey").cast("string")
    text = F.concat(F.lit('@app.get("/api/items/'), s, F.lit('")\nawait fetch("/api/items/'), (F.col("p_partkey") + 1).cast("string"), F.lit('?x=1")\nx = \'/etc/hosts\'\ncall("/v1/ping/")'))
    return ingest.route_edges(T.read(spark, d, "part").select(F.concat(F.lit("api/m"), s, F.lit(".py")).alias("path"), text.alias("content")))


@query("select 'doc/d' || p_partkey || '.md' as path, unnest([1, 3]) as line, unnest([p_name, 'Part ' || p_brand]) as name, 'heading' as kind, unnest(['# ' || p_name, '## Part ' || p_brand]) as signature from part")
def i13_headings(spark, d):
    s = F.col("p_partkey").cast("string")
    text = F.concat(F.lit("# "), F.col("p_name"), F.lit("\ntext\n## Part "), F.col("p_brand"), F.lit("\n not # one"))
    return ingest.heading_symbols(T.read(spark, d, "part").select(F.concat(F.lit("doc/d"), s, F.lit(".md")).alias("path"), text.alias("content")))


# --- lookups and joins -----------------------------------------------------------------------------
@query(f"with {FILES} select path from files where starts_with(lower(path), 'src/src1/')")
def f1_path_subtree(spark, d):
    return lookup.under_path(T.files(spark, d), "src/src1").select("path")


@query(f"with {CHUNKS} select chunk_id, path, start_line from chunks where starts_with(lower(path), 'src/src1/') order by path, idx limit 50 offset 10")
def f4_o2_inspect_path(spark, d):
    return lookup.under_path(T.chunks(spark, d), "src/src1", itself=True).orderBy("path", "idx").offset(10).limit(50).select("chunk_id", "path", F.col("start_line").cast("long"))


@query(f"with {CHUNKS} select f.path, len(string_split(f.path, '/')) - 1 as depth, coalesce(c.n, 0) as n_chunks, coalesce(y.n, 0) as n_symbols from files f left join (select file_id, count(*) as n from chunks group by 1) c on c.file_id = f.id left join (select p_partkey % 300 as file_id, count(*) as n from part group by 1) y on y.file_id = f.id where starts_with(f.path, 'src/') order by f.path limit 100 offset 20")
def f5_workspace_tree(spark, d):
    placed = T.symbols(spark, d).select((F.col("id") % 300).alias("file_id"))
    return lookup.workspace_tree(T.files(spark, d), T.chunks(spark, d), placed, "src", 100, 20).select("path", F.col("depth").cast("long"), F.col("n_chunks").cast("long"), F.col("n_symbols").cast("long"))


_HAS = f"len(list_filter(['thé', 'que', 'ver'], lambda t: contains(lower(content), t) or contains({STRIP.format('content')}, replace(t, 'é', 'e'))))"


@query(f"with {FILES} select id, {_HAS} as n_terms from files where {_HAS} > 0")
def f12_substring_terms(spark, d):
    s = T.sources(spark, d).withColumnRenamed("doc_id", "id")
    return fts.substring_filter(s, F.col("content"), ["thé", "que", "ver", "ab"]).select("id", F.col("n_terms").cast("long"))


@query(f"with {CHUNKS}, {SYMBOLS}, wanted as (select distinct name from symbols order by name limit 5), r as (select *, row_number() over (partition by name order by id) as rn from symbols where name in (select name from wanted)) select r.name, r.id, f.path, c.start_line, c.end_line from r join files f on f.id = r.id % 200 left join chunks c on c.chunk_id = (r.id % 200) * 1048576 + r.line % 3 where rn <= 25")
def j2_find_definitions(spark, d):
    s = T.symbols(spark, d).withColumn("file_id", F.col("id") % 200).withColumn("chunk_id", F.col("file_id") * 1048576 + F.col("line") % 3)
    names = s.select("name").distinct().orderBy("name").limit(5)
    found = lookup.find_definitions(s, names, T.files(spark, d), T.chunks(spark, d))
    return found.select("name", "id", "path", F.col("start_line").cast("long"), F.col("end_line").cast("long"))


@query(f"with {EDGES}, n as (select min(name) as name from symbols), e as (select * from edges where kind in ('calls', 'imports')) select distinct src_chunk from e where dst_name = (select name from n) or dst_chunk in (select chunk_id from symbols where name = (select name from n)) order by 1 limit 50")
def j3_find_usages(spark, d):
    s = T.symbols(spark, d)
    return lookup.find_usages(T.edges(spark, d), s, s.agg(F.min("name").alias("name")), ["calls", "imports"])


@query(f"with {EDGES} select distinct e.src_chunk, e.dst_chunk, e.kind from edges e where e.dst_chunk in (select p_partkey from part)")
def j4_usages_of_chunk(spark, d):
    s = T.symbols(spark, d).select(F.col("chunk_id").alias("dst_chunk"))
    return T.edges(spark, d).join(s, "dst_chunk", "left_semi").select("src_chunk", "dst_chunk", "kind").distinct()


RESOLVE_NAMES = f"{SYMBOLS}, e as (select a.id as edge_id, a.file, b.name as dst_name from symbols a left join symbols b on b.id = a.id + 1), scope as (select distinct a.file, b.file as imported from symbols a join symbols b on a.id + 1 = b.id and a.line = b.line), u as (select name, count(distinct file) as n from symbols group by 1), cand as (select e.edge_id, s.chunk_id, s.id, case when e.file = s.file then 1 when i.file is not null then 2 when u.n = 1 then 3 end as r from e join symbols s on s.name = e.dst_name join u on u.name = s.name left join scope i on i.file = e.file and i.imported = s.file)"


def _named_inputs(spark, d):
    """An edge of every part to the next part's name, which all parts of that name define."""
    s = T.symbols(spark, d)
    a, b = s.alias("a"), s.alias("b")
    scope = a.join(b, F.expr("a.id + 1 = b.id and a.line = b.line")).select(F.col("a.file").alias("file"), F.col("b.file").alias("imported")).distinct()
    e = s.alias("a").join(s.alias("b"), F.expr("b.id = a.id + 1"), "left").select(F.col("a.id").alias("edge_id"), F.col("a.file").alias("file"), F.col("b.name").alias("dst_name"), F.lit(None).cast("string").alias("qualifier"))
    return e, s, scope


@query(f"with {RESOLVE_NAMES} select e.edge_id, c.chunk_id as dst_chunk from e left join (select edge_id, arg_min(chunk_id, r * 1000000000000 + id) as chunk_id from cand where r is not null group by 1) c on c.edge_id = e.edge_id")
def j5_j6_resolve_names(spark, d):
    return lookup.resolve_edges(*_named_inputs(spark, d))


@query(f"with {RESOLVE_NAMES} select e.edge_id, arg_min(s.chunk_id, case when e.file <> s.file then 1000000000000 else 0 end + s.chunk_id) as dst_chunk from e left join symbols s on s.name = e.dst_name group by 1")
def y9_resolve_any_name(spark, d):
    e, s, _ = _named_inputs(spark, d)
    return lookup.resolve_any(e, s)


@query(f"with {EDGES}, s as (select chunk_id, name, id % 3 = 0 as concrete, id % 3 = 1 as abstract from symbols), e as (select *, case when kind = 'calls' then 'implements' else 'extends' end as k from edges) select e.src_chunk, e.dst_name, case when k = 'implements' and concrete then 'extends' when k = 'extends' and abstract then 'implements' else k end as kind from e left join s on s.chunk_id = e.dst_chunk and s.name = e.dst_name")
def j8_relabel_bases(spark, d):
    s = T.symbols(spark, d).withColumn("kind", F.when(F.col("id") % 3 == 0, "class").when(F.col("id") % 3 == 1, "protocol").otherwise("function"))
    e = T.edges(spark, d).withColumn("kind", F.when(F.col("kind") == "calls", "implements").otherwise("extends"))
    return lookup.relabel_bases(e, s).select("src_chunk", "dst_name", "kind")


@query(f"with {CHUNKS}, q as (select path, id % 40 + 1 as line from files) select q.path, q.line, arg_min(c.chunk_id, (c.end_line - c.start_line) * 1000000000000 + c.chunk_id) as chunk_id from q join chunks c on c.path = q.path and q.line between c.start_line and c.end_line group by 1, 2")
def j10_line_in_chunk(spark, d):
    q = T.files(spark, d).select("path", (F.col("id") % 40 + 1).alias("line"))
    return lookup.chunk_at(q, T.chunks(spark, d))


@query(f"with {SYMBOLS}, d as (select id, file as path, name, line as decl_line, line + id % 9 as chunk_end from symbols), q as (select distinct file as path, line from symbols) select q.path, q.line, arg_max(d.name, case when chunk_end >= q.line then 10000000000 else 0 end + decl_line * 10000000 + d.id) as name from q join d on d.path = q.path and d.decl_line <= q.line group by 1, 2")
def j11_nearest_declaration(spark, d):
    s = T.symbols(spark, d)
    decls = s.select("id", F.col("file").alias("path"), "name", F.col("line").alias("decl_line"), (F.col("line") + F.col("id") % 9).alias("chunk_end"))
    return lookup.nearest_declaration(s.select(F.col("file").alias("path"), "line").distinct(), decls)


TRACED = [("/app/src/src1/en/doc_1.txt",), ("en/doc_2.txt",), ("doc_21.txt",), ("x/doc_3.txt",), ("/src/src4/fr/doc_4.txt",)]


@query(f"with {FILES}, t as (select * from {sql_values('traced', TRACED)}) select traced, arg_max(path, length(path) * 1000 + 0) as path from t join files on traced = path or ends_with(traced, '/' || path) or ends_with(path, '/' || traced) group by 1")
def j12_path_suffix(spark, d):
    return lookup.match_suffix(values(spark, "traced", TRACED), T.files(spark, d))


@query(f"with {RECORDS}, u as (select *, 0 as scope from records where status = 'completed' union all select *, 1 from records), r as (select *, row_number() over (partition by kind, title, payload order by scope, id) as rn from u) select id, scope from r where rn = 1")
def j13_union_scopes(spark, d):
    r = T.records(spark, d)
    return ledger.union_scopes(r.filter("status = 'completed'"), r).select("id", "scope")


@query(f"with {RECORDS}, {FILES}, {SYMBOLS}, a as (select id, unnest(['src/src0/fr/doc_' || (id // 1048576) || '.txt', 'name_' || id]) as anchor from records where head_sha is not null and head_sha <> 'sha4') select id, list_sort(list(distinct anchor)) as missing from a where not (contains(anchor, '/') and anchor in (select path from files)) and not (not contains(anchor, '/') and anchor in (select name from symbols)) group by 1")
def j14_stale_anchors(spark, d):
    anchors = F.array(F.concat(F.lit("src/src0/fr/doc_"), F.floor(F.col("id") / 1048576).cast("string"), F.lit(".txt")), F.concat(F.lit("name_"), F.col("id").cast("string")))
    return ledger.stale_anchors(T.records(spark, d).withColumn("anchors", anchors), T.files(spark, d), T.symbols(spark, d), "sha4")


IMPLICIT = "e as (select event_id as id, user_id as session, case when event_type = 'view' then 'search' else event_type end as tool, [event_id % 7, event_id % 5 + 7, event_id % 3 + 12] as top, event_id % 15 as target from events)"


@query(f"with {IMPLICIT}, s as (select a.id, a.session, a.target, max(b.id) as search_id from e a join e b on b.session = a.session and b.tool = 'search' and b.id < a.id where a.tool <> 'search' group by all) select s.id, s.session, s.search_id, s.target from s join e on e.id = s.search_id where list_contains(e.top, s.target)")
def j15_implicit_targets(spark, d):
    e = T.read(spark, d, "events")
    i = F.col("event_id")
    return lookup.implicit_targets(e.select(i.alias("id"), F.col("user_id").alias("session"), F.when(F.col("event_type") == "view", "search").otherwise(F.col("event_type")).alias("tool"), F.array(i % 7, i % 5 + 7, i % 3 + 12).alias("top"), (i % 15).alias("target")))


@query(f"with {EDGES} select src_chunk, dst_name from edges where (src_chunk, dst_name) not in (select src_chunk, dst_name from edges where kind = 'imports')")
def j16_edge_audit(spark, d):
    e = T.edges(spark, d)
    return e.join(e.filter("kind = 'imports'"), ["src_chunk", "dst_name"], "left_anti").select("src_chunk", "dst_name")


# --- aggregates --------------------------------------------------------------------------------------
@query(f"with {CHUNKS}, {EDGES} select (select count(*) from files) as files, (select count(*) from chunks) as chunks, (select count(*) from symbols) as symbols, (select count(*) from edges) as edges, (select count(dst_chunk) from edges) as resolved, (select count(*) from embeddings) as vectors, (select string_agg(lang, ',' order by n desc, lang) from (select lang, count(*) as n from files group by 1)) as languages, (select max(mtime) from files) as last_indexed")
def a1_status(spark, d):
    one = T.files(spark, d).agg(F.count(F.lit(1)).alias("files"), F.max("mtime").alias("last_indexed"))
    for df, aggs in ((T.chunks(spark, d), {"chunks": F.count(F.lit(1))}), (T.symbols(spark, d), {"symbols": F.count(F.lit(1))}), (T.edges(spark, d), {"edges": F.count(F.lit(1)), "resolved": F.count("dst_chunk")}), (T.vectors(spark, d), {"vectors": F.count(F.lit(1))})):
        one = one.crossJoin(df.agg(*[a.alias(n) for n, a in aggs.items()]))  # one row each
    langs = T.files(spark, d).groupBy("lang").count().agg(F.array_sort(F.collect_list(F.struct((-F.col("count")).alias("less"), "lang"))).alias("l"))  # a row a language
    return one.crossJoin(langs.select(F.array_join(F.transform("l", lambda x: x["lang"]), ",").alias("languages")))


@query(f"with {FILES} select lang, count(*) as n from files group by 1 order by n desc, lang limit 8")
def a2_language_mix(spark, d):
    return T.files(spark, d).groupBy("lang").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "lang").limit(8)


@query(f"with {EDGES} select s.id, s.name, count(*) as degree from edges e join symbols s on s.chunk_id = e.dst_chunk group by 1, 2 order by degree desc, s.id limit 15")
def a3_hub_symbols(spark, d):
    e, s = T.edges(spark, d), T.symbols(spark, d)
    return e.join(s, e["dst_chunk"] == s["chunk_id"]).groupBy("id", "name").agg(F.count(F.lit(1)).alias("degree")).orderBy(F.desc("degree"), "id").limit(15)


@query(f"with {EDGES}, d as (select dst_chunk as c, count(*) as n from edges where dst_chunk is not null group by 1 union all select src_chunk, count(*) from edges group by 1) select s.id, s.name, cast(sum(d.n) as bigint) as degree from d join symbols s on s.chunk_id = d.c group by 1, 2 order by degree desc, s.id limit 8")
def a4_o5_hubs_in_out(spark, d):
    e, s = T.edges(spark, d), T.symbols(spark, d)
    deg = e.filter("dst_chunk is not null").groupBy(F.col("dst_chunk").alias("c")).count().unionAll(e.groupBy(F.col("src_chunk").alias("c")).count())
    return deg.join(s, deg["c"] == s["chunk_id"]).groupBy("id", "name").agg(F.sum("count").alias("degree")).orderBy(F.desc("degree"), "id").limit(8)


@query(f"with {EDGES}, t as (select src_chunk as c from edges where dst_chunk is not null union select dst_chunk from edges where dst_chunk is not null) select s.file, count(distinct s.chunk_id) as n from symbols s where s.chunk_id in (select c from t) group by 1 order by n desc, s.file limit 10")
def a5_o4_hot_files(spark, d):
    e = T.edges(spark, d).filter("dst_chunk is not null")
    t = e.select(F.col("src_chunk").alias("chunk_id")).union(e.select("dst_chunk")).distinct()
    return T.symbols(spark, d).join(t, "chunk_id", "left_semi").groupBy("file").agg(F.count_distinct("chunk_id").alias("n")).orderBy(F.desc("n"), "file").limit(10)


@query(f"with {FILES} select path, mtime from files order by mtime desc, path limit 10")
def a6_o1_recent_files(spark, d):
    return T.files(spark, d).select("path", "mtime").orderBy(F.desc("mtime"), "path").limit(10)


@query(f"with {USAGE} select tool, count(*) as calls, count(*) filter (where not ok) as errors, round(avg(latency_ms), 6) as avg_latency, quantile_disc(latency_ms, 0.5) as p50, quantile_disc(latency_ms, 0.95) as p95 from usage group by 1")
def a7_usage_stats(spark, d):
    return ledger.usage_stats(T.usage(spark, d))


@query(f"with {USAGE} select 'q' || session as query, count(*) as n from usage where tool = 'click' and hits = 0 group by 1 order by n desc, query limit 20")
def a8_zero_hits(spark, d):
    u = T.usage(spark, d).withColumn("query", F.concat(F.lit("q"), F.col("session").cast("string")))
    return ledger.zero_hits(u, "click")


@query(f"with {FILES}, w as (select id, unnest(list_distinct(regexp_split_to_array(lower(content), '[^\\p{{L}}\\p{{N}}]+'))) as t from files) select a.atom, count(distinct id) as df from (values ('th'), ('que'), ('ver')) a(atom) join w on starts_with(t, a.atom) group by 1")
def a10_document_frequency(spark, d):
    atoms = values(spark, "atom", [("th",), ("que",), ("ver",)])
    w = T.sources(spark, d).select("doc_id", F.explode(F.array_distinct(F.split(F.lower("content"), fts.TOKEN_SPLIT))).alias("t"))
    # three rows
    return w.join(F.broadcast(atoms), F.expr("startswith(t, atom)")).groupBy("atom").agg(F.count_distinct("doc_id").alias("df"))


@query(f"with {CHUNKS}, {EDGES} select e.src_chunk, e.kind, list_sort(list(distinct e.line)) as lines from edges e where e.dst_chunk is not null group by 1, 2")
def a13_grouped_edges(spark, d):
    return T.edges(spark, d).filter("dst_chunk is not null").groupBy("src_chunk", "kind").agg(F.array_sort(F.collect_set("line")).alias("lines"))


@query(f"with {FILES} select string_split(substr(path, 5), '/')[1] as top, count(*) as n from files group by 1")
def a19_top_dirs(spark, d):
    return T.files(spark, d).groupBy(X.top_dir(F.substring("path", 5, 10_000)).alias("top")).agg(F.count(F.lit(1)).alias("n"))


_RANKS = "b as (select b.item_id, d.doc_id, d.n_chars from benchmark b join documents d on contains(d.text, b.text)), k as (select *, row_number() over (partition by item_id order by n_chars desc, doc_id) as pos, min(doc_id) over (partition by item_id) as expected from b), r as (select i.item_id, k.pos as rank from benchmark i left join k on k.item_id = i.item_id and k.doc_id = k.expected)"


@query(f"with {_RANKS} select round(avg(case when rank <= 1 then 1.0 else 0.0 end), 6) as recall_1, round(avg(case when rank <= 5 then 1.0 else 0.0 end), 6) as recall_5, round(avg(case when rank <= 10 then 1.0 else 0.0 end), 6) as recall_10, round(avg(coalesce(1.0 / rank, 0.0)), 6) as mrr, quantile_disc(rank, 0.5) as median, quantile_disc(rank, 0.95) as p95 from r")
def a17_ir_metrics(spark, d):
    """The longest documents that hold an item's passage, ranked; the smallest doc_id is the expected one."""
    items, docs = T.read(spark, d, "benchmark"), T.read(spark, d, "documents")
    words = lambda c: F.split(c, " ")
    # an equality join on the passage's first words finds the candidates, the whole passage decides
    head = items.select("item_id", F.col("text").alias("passage"), F.array_join(F.slice(words("text"), 2, 4), " ").alias("key"), F.size(words("text")).alias("n"))
    w = words("text")
    four = F.arrays_zip(w.alias("a"), *[F.slice(w, k + 1, F.size(w)).alias(n) for k, n in ((1, "b"), (2, "c"), (3, "d"))])
    grams = docs.select("doc_id", F.explode(F.transform(four, lambda g: F.concat_ws(" ", g["a"], g["b"], g["c"], g["d"]))).alias("key"))
    candidates = grams.join(head.filter("n >= 6"), "key").select("doc_id", "item_id", "passage").distinct()
    held = candidates.join(docs, "doc_id").filter(F.contains("text", F.col("passage"))).select("item_id", "doc_id", "n_chars")
    short = docs.join(F.broadcast(head.filter("n < 6").limit(1000)), F.contains("text", F.col("passage"))).select("item_id", "doc_id", "n_chars")  # passages too short for a key: a labelled set has few
    hit = held.unionByName(short).distinct()
    w = Window.partitionBy("item_id")
    placed = hit.withColumn("rank", F.row_number().over(w.orderBy(F.desc("n_chars"), "doc_id"))).withColumn("expected", F.min("doc_id").over(w)).filter("doc_id = expected")
    ranks = items.select("item_id").join(placed.select("item_id", "rank"), "item_id", "left")
    m = vector.ir_metrics(ranks)
    return m.select(*[F.round(c, 6).alias(c) if c not in ("median", "p95") else F.col(c).cast("long") for c in m.columns])


# --- full text ---------------------------------------------------------------------------------------
CLAUSES = [("theor", None), ("queil", None), ("vere", None), ("src1", "path")]
_RUNS = "list_filter(regexp_split_to_array(lower({}), '[^\\p{{L}}\\p{{M}}\\p{{N}}]+'), lambda t: t <> '')"
_TWICE = "array_to_string(flatten(list_transform(" + _RUNS + ", lambda r: [r, r])), ' ')"
_POST = FILES + f", g as (select *, 'doc' || id || ' ' || lang as sym from files), f as (select id, 'content' as field, lower(content) as x from g union all select id, 'path', {_TWICE.format('path')} from g union all select id, 'symbol', {_TWICE.format('sym')} from g union all select id, 'folded', {STRIP.format("concat_ws(' ', content, path, sym)")} from g)" + ", tok as (select id, field, unnest(list_filter(regexp_split_to_array(x, '[^\\p{L}\\p{N}]+'), lambda t: t <> '')) as token from f), post as (select id, field, token, count(*) as tf from tok group by all), sized as (select id, sum(tf) as len from post group by 1), tot as (select count(*) as n, avg(len) as mean from sized)"


def bm25_sql(clauses: list[tuple[str, str | None]], weights: dict[str, float], post: str = _POST, exact: bool = False, tag: str = "") -> str:
    """Tables up to bm<tag> (id, score); with an empty ``post`` those of the index are there already."""
    w = "case field " + " ".join(f"when '{f}' then {x}" for f, x in weights.items()) + " end"
    rows = ", ".join(f"({i}, '{p}', {'null' if f is None else repr(f)})" for i, (p, f) in enumerate(clauses))
    match = "token = prefix" if exact else "starts_with(token, prefix)"
    index = f"{post}, " if post else ""
    return f"{index}cl{tag}(clause, prefix, only_field) as (values {rows}), tf{tag} as (select clause, id, sum(tf * {w}) as tf from post join cl{tag} on {match} and (only_field is null or only_field = field) group by 1, 2), df{tag} as (select clause, count(*) as df from tf{tag} group by 1), bm{tag} as (select t.id, sum(greatest(ln((n - df + 0.5) / (df + 0.5)), 1e-6) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * len / mean))) as score from tf{tag} t join df{tag} using (clause) join sized on sized.id = t.id cross join tot group by 1)"


def _bm25(spark, d, clauses=None, weights=None, exact=False):
    return fts.bm25f(T.postings(spark, d), clauses or CLAUSES, weights or fts.WEIGHTS, sized=T.lengths(spark, d), exact=exact)


@query(f"with {bm25_sql(CLAUSES, fts.WEIGHTS)} select id, round(score, 6) as score from bm order by bm.score desc, id limit 20")
def t8_bm25f(spark, d):
    return _bm25(spark, d).orderBy(F.desc("score"), "id").limit(20).select("id", F.round("score", 6).alias("score"))


Y1 = {"content": 5.0, "path": 2.0, "symbol": 4.0, "folded": 1.0}


@query(f"with {bm25_sql([('the', None), ('src1', None)], Y1, exact=True)} select id, round(score, 6) as score from bm order by bm.score desc, id limit 20")
def y1_bm25f_port_weights(spark, d):
    return _bm25(spark, d, [("the", None), ("src1", None)], Y1, exact=True).orderBy(F.desc("score"), "id").limit(20).select("id", F.round("score", 6).alias("score"))


ACCENTED = [("été", None), ("première", None)]
FOLDED = fts.folded_variants("été première")


@query(f"with {bm25_sql(ACCENTED, fts.WEIGHTS)}, {bm25_sql(FOLDED, fts.WEIGHTS, '', tag='2')}, first as (select id, score, 0 as tier from bm order by bm.score desc, id limit 5) select id, tier from (select * from first union all select id, score, 1 as tier from bm2 where id not in (select id from first)) order by tier, score desc, id limit 12")
def t9_tail_fill(spark, d):
    first = _bm25(spark, d, ACCENTED).orderBy(F.desc("score"), "id").limit(5)
    return fts.tail_fill(first, _bm25(spark, d, FOLDED), 12).select("id", "tier")


@query(f"""with {FILES}, h as (select id, ' ' || array_to_string(list_filter(regexp_split_to_array({STRIP.format('content')}, '[^\\p{{L}}\\p{{N}}]+'), lambda t: t <> ''), ' ') || ' ' as hay from files), n as (select id, cast(contains(hay, ' of the ') as int) + cast(contains(hay, ' the by ') as int) + cast(contains(hay, ' by la ') as int) as n_pairs from h) select id, n_pairs from n where n_pairs > 0""")
def t10_phrase_pairs(spark, d):
    return fts.phrase_hits(T.sources(spark, d).withColumnRenamed("doc_id", "id"), F.col("content"), "Of thé by la")


_HAY = "' ' || array_to_string(list_filter(regexp_split_to_array(" + STRIP + ", '[^\\p{{L}}\\p{{N}}]+'), lambda t: t <> ''), ' ') || ' '"


@query(f"with {RECORDS}, h as (select *, {_HAY.format('title')} as t, {_HAY.format('payload')} as p from records), s as (select id, ws, 2 * cast(contains(t, ' de') as int) + cast(contains(p, ' de') as int) + 2 * cast(contains(t, ' la') as int) + cast(contains(p, ' la') as int) + 2 * cast(contains(t, ' de la') as int) as relevance from h) select id, cast(relevance as double) as relevance from s where relevance > 0 order by relevance desc, id desc limit 40")
def t15_t16_record_relevance(spark, d):
    r = fts.record_relevance(T.records(spark, d), "Dé lá")
    return r.filter("relevance > 0").orderBy(F.desc("relevance"), F.desc("id")).limit(40).select("id", "relevance")


_RPOST = RECORDS.replace("records as", "recs as") + ", f as (select id, 'title' as field, lower(title) as x from recs union all select id, 'payload', lower(payload) from recs), tok as (select id, field, unnest(list_filter(regexp_split_to_array(x, '[^\\p{L}\\p{N}]+'), lambda t: t <> '')) as token from f), post as (select id, field, token, count(*) as tf from tok group by all), sized as (select id, sum(tf) as len from post group by 1), tot as (select count(*) as n, avg(len) as mean from sized)"


@query(f"with {bm25_sql([('queil', None), ('ther', None)], {'title': 1.0, 'payload': 1.0}, _RPOST)} select id, round(score, 6) as score from bm order by bm.score desc, id limit 20")
def t14_records_fts(spark, d):
    post = fts.postings(T.records(spark, d), {"title": F.col("title"), "payload": F.col("payload")})
    return fts.bm25f(post, [("queil", None), ("ther", None)], {"title": 1.0, "payload": 1.0}).orderBy(F.desc("score"), "id").limit(20).select("id", F.round("score", 6).alias("score"))


CLAUSE_ROWS = [(p, f) for p, f in fts.query_clauses("comparing the activities of google apps script")]


@query(f"select prefix, only from {sql_values('prefix only', [('comparing', None), ('activities', None), ('google', None), ('apps', None), ('script', None), ('googl', None), ('compar', None), ('activity', None), ('activ', None), ('app', None), ('cag', 'path'), ('aga', 'path'), ('gas', 'path'), ('caga', 'path'), ('agas', 'path')])}".replace("only from", "\"only\" from").replace("(prefix, only)", "(prefix, \"only\")"))
def t6_t7_query_clauses(spark, d):
    return fts.clause_table(spark, "comparing the activities of google apps script")


# --- vectors and fusion --------------------------------------------------------------------------------
_V = "q as (select embedding as v from embeddings where vec_id = 0), sem as (select vec_id as id, list_dot_product(cast(embedding as double[]), cast(q.v as double[])) as score from embeddings, q)"


def _first_vector(spark, d):
    return T.vectors(spark, d).filter("vec_id = 0").select("vec")


@query(f"with {_V} select id as vec_id, round(score, 6) as score from sem where score > 0.05 order by sem.score desc, id limit 20")
def v1_semantic(spark, d):
    return vector.semantic(T.vectors(spark, d), _first_vector(spark, d)).select("vec_id", F.round("score", 6).alias("score"))


@query(f"with {_V} select s.id as vec_id, round(s.score, 6) as score from sem s join embeddings e on e.vec_id = s.id where e.label = 3 and s.score > 0.05 order by s.score desc, s.id limit 20")
def v2_semantic_filtered(spark, d):
    return vector.semantic(T.vectors(spark, d).filter("label = 3"), _first_vector(spark, d)).select("vec_id", F.round("score", 6).alias("score"))


@query("select vec_id, round(sqrt(list_dot_product(cast(embedding as double[]), cast(embedding as double[]))), 5) as norm, len(embedding) as dim from embeddings")
def v3_v4_norms(spark, d):
    v = T.vectors(spark, d).withColumn("u", vector.normalize(F.col("vec")))
    return v.select("vec_id", F.round(F.sqrt(vector.dot(F.col("u"), F.col("u"))), 5).alias("norm"), F.size("vec").cast("long").alias("dim"))


@query(f"with {_V} select id as vec_id, round(score, 6) as score from sem order by sem.score desc, id limit 20")
def v5_semantic_all(spark, d):
    return vector.semantic(T.vectors(spark, d), _first_vector(spark, d), least=None).select("vec_id", F.round("score", 6).alias("score"))


HYBRID = f"{bm25_sql(CLAUSES, fts.WEIGHTS)}, {_V}, l1 as (select id, row_number() over (order by score desc, id) as r from bm qualify r <= 60), l2 as (select id, row_number() over (order by score desc, id) as r from sem where score > 0.05 qualify r <= 60), fused as (select id, sum(p) as score from (select id, 1.0 / (60 + r) as p from l1 union all select id, 1.0 / (60 + r) from l2) group by 1)"


def _fused(spark, d):
    sem = vector.semantic(T.vectors(spark, d), _first_vector(spark, d), 60).withColumnRenamed("vec_id", "id")
    return vector.rrf([(_bm25(spark, d), 1.0), (sem, 1.0)], 60)


@query(f"with {HYBRID} select id, round(score, 6) as score from fused order by fused.score desc, id limit 20")
def r1_rrf(spark, d):
    return _fused(spark, d).orderBy(F.desc("score"), "id").limit(20).select("id", F.round("score", 6).alias("score"))


@query(f"with {HYBRID}, b as (select f.id, f.score + least(0.015 * cast(x.source = 'src1' as int) - 0.02 * cast(x.doc_id % 10 = 0 as int) + 0.02 * (x.n_chars / m.most) - 0.005 * 3, 0.09) as score from fused f join documents x on x.doc_id = f.id cross join (select max(n_chars) as most from documents) m) select id, round(score, 6) as score from b order by b.score desc, id limit 20")
def r2_r4_hybrid(spark, d):
    src = T.read(spark, d, "documents")
    most = src.agg(F.max("n_chars").alias("most"))
    j = _fused(spark, d).join(src.select(F.col("doc_id").alias("id"), "source", "n_chars"), "id").crossJoin(most)  # one row
    zero = F.lit(0)
    out = vector.boosts(j, zero, (F.col("source") == "src1").cast("int"), zero, F.col("id") % 10 == 0, zero, F.col("n_chars") / F.col("most"), F.lit(4))
    return out.orderBy(F.desc("boosted"), "id").limit(20).select("id", F.round("boosted", 6).alias("score"))


@query(f"with {SYMBOLS}, w as (select distinct lower(name) as n from symbols order by 1 limit 3) select chunk_id, min(case when id = chunk_id then 0 else 1 end) as other from symbols where lower(name) in (select n from w) group by 1")
def r3_a12_symbol_leg(spark, d):
    s = T.symbols(spark, d).withColumn("low", F.lower("name"))
    w = s.select("low").distinct().orderBy("low").limit(3)
    return s.join(w, "low", "left_semi").groupBy("chunk_id").agg(F.min(F.when(F.col("id") == F.col("chunk_id"), 0).otherwise(1)).alias("other"))


# --- graph -------------------------------------------------------------------------------------------
def _seed(spark, d):
    return T.edges(spark, d).filter("dst_chunk is not null").agg(F.min("src_chunk").alias("node"))


_SEED = "s as (select min(src_chunk) as x from edges where dst_chunk is not null)"


def _bfs_sql(arcs: str, hops: int) -> str:
    return f"walk as (select x as node, 0 as depth from s union select {arcs}.b, depth + 1 from walk join {arcs} on {arcs}.a = walk.node where depth < {hops}), best as (select node, min(depth) as depth from walk group by 1)"


@query(f"with recursive {EDGES}, {_SEED}, {_bfs_sql('both_ways', 1)}, m as (select e.*, b.depth from edges e join best b on e.src_chunk = b.node union all select e.*, b.depth from edges e join best b on e.dst_chunk = b.node) select src_chunk, dst_chunk, dst_name, kind, min(depth) + 1 as depth from m group by 1, 2, 3, 4 order by depth, src_chunk, dst_name, kind, dst_chunk limit 60")
def g1_neighbours(spark, d):
    return graph.neighbours(T.edges(spark, d), _seed(spark, d), depth=2, limit=60)


@query(f"with recursive {EDGES}, s as (select max(dst_chunk) as x from edges), {_bfs_sql('backwards', 3)} select node, depth from best where depth > 0")
def g5_impact(spark, d):
    e = T.edges(spark, d)
    return graph.impact(e, e.agg(F.max("dst_chunk").alias("node")), 3)


@query(f"with {EDGES}, seeds as (select distinct src_chunk as node, 1.0 / (src_chunk + 1) as score from edges where dst_chunk is not null order by 1 limit 3), s0 as (select node, max(score) as score from seeds group by 1), s1 as (select b as node, max(score) * 0.7 as score from s0 join both_ways on a = node where b not in (select node from s0) group by 1), s2 as (select b as node, max(score) * 0.7 as score from s1 join both_ways on a = node where b not in (select node from s0 union select node from s1) group by 1), u as (select node, 1 as depth, round(score, 4) as score from s1 union all select node, 2, round(score, 4) from s2) select node, depth, score from u order by depth, score desc, node limit 60")
def g2_expand(spark, d):
    e = T.edges(spark, d)
    seeds = e.filter("dst_chunk is not null").select(F.col("src_chunk").alias("node")).distinct().orderBy("node").limit(3).withColumn("score", 1.0 / (F.col("node") + 1))
    return graph.expand(e, seeds)


def _pair(spark, d):
    e = T.edges(spark, d)
    start = _seed(spark, d)
    far = graph.reach(e, start, 3, "out").orderBy(F.desc("depth"), "node").limit(1)
    return start, far.select("node")


_TARGET = f"{_bfs_sql('forwards', 3)}, t as (select node as y from best order by depth desc, node limit 1)"


@query(f"with recursive {EDGES}, {_SEED}, {_TARGET}, p as (select x as node, [x] as path from s union all select f.b, list_append(path, f.b) from p join forwards f on f.a = p.node where len(path) <= 4 and not list_contains(path, f.b)) select path from p where node = (select y from t) order by len(path), path limit 1")
def g3_shortest_path(spark, d):
    return graph.shortest_path(T.edges(spark, d), *_pair(spark, d), hops=4)


@query(f"with recursive {EDGES}, {_SEED}, {_TARGET}, p as (select x as node, [x] as path from s union all select f.b, list_append(path, f.b) from p join forwards f on f.a = p.node where len(path) <= 4 and not list_contains(path, f.b)) select path from p where node = (select y from t) order by len(path), path limit 10")
def g4_simple_paths(spark, d):
    return graph.simple_paths(T.edges(spark, d), *_pair(spark, d), hops=4)


@query(f"with {EDGES}, seeds as (select distinct src_chunk as seed from edges), o as (select seed, dst_chunk as node, 'calls' as via from seeds join (select distinct src_chunk, dst_chunk from edges where dst_chunk is not null) on src_chunk = seed union all select seed, src_chunk, 'called_by' from seeds join (select distinct src_chunk, dst_chunk from edges where dst_chunk is not null) on dst_chunk = seed) select seed, node, via from o qualify row_number() over (partition by seed, via order by node) <= 2")
def g6_o3_one_hop(spark, d):
    e = T.edges(spark, d)
    return graph.one_hop(e, e.select(F.col("src_chunk").alias("node")).distinct(), 2)


NATIONS = "arcs as (select c_nationkey as src, s_nationkey as dst, count(*) as weight from customer join orders on o_custkey = c_custkey join lineitem on l_orderkey = o_orderkey join supplier on s_suppkey = l_suppkey where c_nationkey <> s_nationkey group by 1, 2)"


def _pagerank_sql(rounds: int) -> str:
    steps = ", ".join(f"r{k} as (select n.node, 0.15 / t.c + 0.85 * (coalesce(g.got, 0) + (select coalesce(sum(rank), 0) from r{k - 1} where node not in (select src from o)) / t.c) as rank from nodes n cross join t left join (select dst, sum(share * rank) as got from sh join r{k - 1} on node = src group by 1) g on g.dst = n.node)" for k in range(1, rounds + 1))
    return f"{NATIONS}, nodes as (select src as node from arcs union select dst from arcs), t as (select cast(count(*) as double) as c from nodes), o as (select src, sum(weight) as total from arcs group by 1), sh as (select a.src, a.dst, a.weight / o.total as share from arcs a join o on o.src = a.src), r0 as (select node, 1 / t.c as rank from nodes cross join t), {steps}"


def _nation_ranks(spark, d):
    c, o, l, s = (T.read(spark, d, n) for n in ("customer", "orders", "lineitem", "supplier"))
    arcs = l.join(o, l["l_orderkey"] == o["o_orderkey"]).join(c, o["o_custkey"] == c["c_custkey"]).join(s, l["l_suppkey"] == s["s_suppkey"]).groupBy(F.col("c_nationkey").alias("src"), F.col("s_nationkey").alias("dst")).agg(F.count(F.lit(1)).alias("weight"))
    return graph.pagerank(arcs, 20)


@query(f"with {_pagerank_sql(12)} select node, round(rank, 5) as rank from r12")
def g7_a16_pagerank(spark, d):
    return _nation_ranks(spark, d).select("node", F.round("rank", 5).alias("rank"))


@query(f"with {_pagerank_sql(12)} select node, round(case when max(rank) over () > min(rank) over () then (rank - min(rank) over ()) / (max(rank) over () - min(rank) over ()) else 0 end, 4) as rank from r12")
def a16_normalized_pagerank(spark, d):
    return graph.normalized(_nation_ranks(spark, d)).select("node", F.round("rank", 4).alias("rank"))


def _components_sql(rounds: int) -> str:
    """Least label of each node and its neighbours, ``rounds`` times: more than the width of the graph."""
    steps = ", ".join(f"c{k} as materialized (select x.node, least(x.root, min(y.root)) as root from c{k - 1} x join both_ways on a = x.node join c{k - 1} y on y.node = b group by x.node, x.root)" for k in range(1, rounds + 1))
    return f"c0 as (select distinct a as node, a as root from both_ways), {steps}"


@query(f"with {EDGES}, {_components_sql(24)} select node, root as component from c24")
def g8_components(spark, d):
    return graph.connected_components(T.edges(spark, d))


@query(f"with {EDGES}, {_components_sql(24)}, paths as (select chunk_id, replace(kind, ' ', '/') || '/' || file as path from symbols), sizes as (select root, count(*) as size from c24 group by 1 order by size desc, root limit 8), f as (select distinct root, path from c24 join paths on chunk_id = node where root in (select root from sizes)), h as (select root, string_split(path, '/')[1] as dir, count(*) as n from f group by 1, 2), labels as (select root, dir from h qualify row_number() over (partition by root order by n desc, dir) = 1) select s.root as component, size, dir as label from sizes s join labels on labels.root = s.root")
def g8_communities(spark, d):
    paths = T.symbols(spark, d).select(F.col("chunk_id").alias("node"), F.concat(F.replace("kind", F.lit(" "), F.lit("/")), F.lit("/"), "file").alias("path"))
    return graph.communities(graph.connected_components(T.edges(spark, d)), paths)


# --- ledger ------------------------------------------------------------------------------------------
@query(f"with {RECORDS} select id, kind from records qualify row_number() over (partition by kind order by id desc) <= case kind when 'user' then 200 when 'assistant' then 100 else 20 end")
def l1_quota(spark, d):
    return ledger.within_quota(T.records(spark, d), {"user": 200, "assistant": 100}, 20).select("id", "kind")


@query(f"with {RECORDS} select id, ws from records qualify row_number() over (partition by ws, kind order by id desc) <= 15")
def l2_quota_per_workspace(spark, d):
    return ledger.within_quota(T.records(spark, d), {}, 15, ("ws", "kind")).select("id", "ws")


@query(f"with {RECORDS} select id, kind, status from records where status = 'open' order by kind = 'commit', id desc limit 50 offset 20")
def l5_f7_list_records(spark, d):
    return ledger.list_records(T.records(spark, d), 50, 20, status="open").select("id", "kind", "status")


@query(f"with {RECORDS} select max(id) as id, arg_max(head_sha, id) as head_sha from records where head_sha is not null")
def l8_latest_checkpoint(spark, d):
    return ledger.latest_checkpoint(T.records(spark, d))
