"""Queries on search stages, records, budgets and reports over whole tables."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import text as X
from ..operators import fts, graph, ingest, ledger, lookup, reports, search, vector
from ..sources import tables as T
from ..streaming import debounce, watch
from .queries import ACCENTED, CHUNKS, CLAUSES, EDGES, FILES, RECORDS, STRIP, SYMBOLS, Y1, _HAY, _POST, _RPOST, _TWICE, _bm25, bm25_sql, query, values


def _docs(spark, d):
    return T.sources(spark, d).withColumnRenamed("doc_id", "id")


# --- full text -----------------------------------------------------------------------------------
@query(f"with {FILES}, g as (select *, 'doc' || id || ' ' || lang as sym from files) select id, {_TWICE.format('path')} as path_tokens, {_TWICE.format('sym')} as symbol_tokens, md5({STRIP.format(chr(39).join(['concat_ws(', ' ', ', content, path, sym)']))}) as folded_md5 from g")
def t1_t5_fields(spark, d):
    f = fts.index_fields(F.col("content"), F.col("path"), F.concat_ws(" ", F.concat(F.lit("doc"), F.col("id").cast("string")), "lang"))
    return _docs(spark, d).select("id", f["path"].alias("path_tokens"), f["symbol"].alias("symbol_tokens"), F.md5(f["folded"].cast("binary")).alias("folded_md5"))


_HIT = "starts_with(lower(w), 'the') or starts_with(lower(w), 'que')"


@query(f"with a as (select doc_id, list_filter(regexp_split_to_array(text, '\\s+'), lambda w: w <> '') as words from documents), b as (select *, len(words) as n, coalesce(list_position(list_transform(words, lambda w: {_HIT}), true), 0) as first from a), c as (select *, greatest(1, least(first - 12, n - 23)) as start from b) select doc_id, case when n = 0 then '' else case when start > 1 then '… ' else '' end || array_to_string(list_transform(words[start : start + 23], lambda w: case when {_HIT} then '«' || w || '»' else w end), ' ') || case when start + 24 <= n then ' …' else '' end end as snippet from c")
def t12_snippet(spark, d):
    return T.read(spark, d, "documents").select("doc_id", fts.snippet(F.col("text"), ["the", "que"]).alias("snippet"))


@query(f"with {bm25_sql(CLAUSES[:1], fts.WEIGHTS)}, first as (select id, score, 0 as tier from bm order by bm.score desc, id limit 5), s as (select id, len(list_filter(['the', 'que', 'ver'], lambda t: contains(lower(content), t) or contains({STRIP.format('content')}, t))) as score, 1 as tier from files) select id, tier from (select * from first union all select * from s where score > 0 and id not in (select id from first)) order by tier, score desc, id limit 30")
def t13_substring_topup(spark, d):
    first = _bm25(spark, d, CLAUSES[:1]).orderBy(F.desc("score"), "id").limit(5)
    second = fts.substring_filter(_docs(spark, d), F.col("content"), ["the", "que", "ver"]).select("id", F.col("n_terms").cast("double").alias("score"))
    return fts.tail_fill(first, second, 30).select("id", "tier")


@query(f"with {RECORDS}, h as (select *, {_HAY.format('title')} as t, {_HAY.format('payload')} as p from records where kind = 'user' and status = 'open') select id, cast(2 * cast(contains(t, ' de') as int) + cast(contains(p, ' de') as int) + 2 * cast(contains(t, ' la') as int) + cast(contains(p, ' la') as int) + 2 * cast(contains(t, ' de la') as int) as double) as relevance from h where contains(t || p, ' de') or contains(t || p, ' la') order by relevance desc, id desc limit 20 offset 5")
def t16_search_ranked(spark, d):
    r = fts.record_relevance(T.records(spark, d).filter("kind = 'user' and status = 'open'"), "Dé lá")
    return r.filter("relevance > 0").orderBy(F.desc("relevance"), F.desc("id")).offset(5).limit(20).select("id", "relevance")


ATOMS = [("src1",), ("e",), ("7",), ("zz",), ("src4",), ("fr",)]
_TERMS = FILES + ", terms as (select distinct path, unnest(list_filter(regexp_split_to_array(lower(path), '[^\\p{L}\\p{M}\\p{N}]+'), lambda t: t <> '')) as token from files), atoms(atom) as (values " + ", ".join(f"('{a[0]}')" for a in ATOMS) + ")"
_FREQ = _TERMS + ", freq as (select atom, count(distinct path) as df from atoms left join terms on starts_with(token, atom) group by 1)"


@query(f"with {_FREQ} select atom, df from freq")
def a9_path_frequency(spark, d):
    return search.path_frequency(T.files(spark, d), values(spark, "atom", ATOMS))


@query(f"with {_FREQ}, t as (select count(*) as n from files), w as (select distinct path, atom, ln(1 + n / df) as w from freq cross join t join terms on starts_with(token, atom) where df > 0 and df <= greatest(8, 0.2 * n)) select path, round(sum(w), 6) as score from w group by 1")
def y4_path_leg(spark, d):
    f = T.files(spark, d)
    n = f.agg(F.count(F.lit(1)).alias("n"))
    return search.path_leg(f, values(spark, "atom", ATOMS), n).select("path", F.round("score", 6).alias("score"))


@query(f"with {SYMBOLS}, word as (select distinct lower(name) as w from symbols order by 1 limit 2), words as (select w from word union select string_split(w, ' ')[1] from word), n as (select chunk_id, lower(name) as w, 0 as other from symbols union all select chunk_id, unnest(string_split(lower(name), ' ')), 1 from symbols) select chunk_id, min(other) as other from n where w in (select w from words) group by 1")
def y5_symbol_leg(spark, d):
    s = T.symbols(spark, d)
    low = s.select(F.lower("name").alias("word")).distinct().orderBy("word").limit(2)
    return search.symbol_leg(s, low.union(low.select(F.element_at(F.split("word", " "), 1))).distinct())


_LEG2 = [("et", "folded"), ("premi", "folded")]


@query(f"with {bm25_sql([('the', None), ('src1', None)], Y1, exact=True)}, {bm25_sql(_LEG2, {'folded': 1.0}, '', tag='2')}, l1 as (select id, row_number() over (order by score desc, id) as r from bm qualify r <= 160), l2 as (select id, row_number() over (order by score desc, id) as r from bm2 qualify r <= 160), both_legs as (select id, sum(p) as score from (select id, 1.0 / (59 + r) as p from l1 union all select id, 0.5 / (59 + r) from l2) group by 1) select id, round(score, 6) as score from both_legs order by both_legs.score desc, id limit 20")
def y2_y3_port_fusion(spark, d):
    a = _bm25(spark, d, [("the", None), ("src1", None)], Y1, exact=True)
    b = _bm25(spark, d, _LEG2, {"folded": 1.0})
    return vector.rrf([(a, 1.0), (b, 0.5)], 160, 59).orderBy(F.desc("score"), "id").limit(20).select("id", F.round("score", 6).alias("score"))


@query(f"with {CHUNKS.replace('- 1 - 5, 0) + 1, 15)', '- 1 - 15, 0) + 1, 45)').replace('at_line // 15', 'at_line // 45').replace('at_line + 20', 'at_line + 60')} select chunk_id, start_line, end_line from chunks")
def y7_port_chunks(spark, d):
    return T.chunks(spark, d, 60, 15).select("chunk_id", F.col("start_line").cast("long"), F.col("end_line").cast("long"))


@query(f"with {RECORDS} select id from records where contains(lower(payload), 'the') order by id desc limit 20")
def y12_y20_records_like(spark, d):
    return T.records(spark, d).filter(F.lower("payload").contains("the")).orderBy(F.desc("id")).limit(20).select("id")


@query("with n as (select count(*) as n from embeddings), t as (select item_id, unnest(list_filter(regexp_split_to_array(lower(text), '[^\\p{L}\\p{N}]+'), lambda t: t <> '')) as token from benchmark), v as (select item_id, cast(('0x' || left(md5(token), 6)) as bigint) % n as vec_id from t, n), e as (select item_id, unnest(cast(embedding as double[])) as x, generate_subscripts(embedding, 1) as i from v join embeddings using (vec_id)), m as (select item_id, i, avg(x) as x from e group by 1, 2), s as (select item_id, sqrt(sum(x * x)) as norm from m group by 1) select item_id, i, round(x / norm, 5) as x from m join s using (item_id)")
def y14_static_embedding(spark, d):
    v = T.vectors(spark, d)
    n = v.agg(F.count(F.lit(1)).alias("n"))
    t = T.read(spark, d, "benchmark").select("item_id", F.explode(F.filter(F.split(F.lower("text"), fts.TOKEN_SPLIT), lambda t: t != "")).alias("token")).crossJoin(n)  # one row
    at = F.conv(F.left(F.md5(F.col("token").cast("binary")), F.lit(6)), 16, 10).cast("long") % F.col("n")
    e = t.select("item_id", at.alias("vec_id")).join(v, "vec_id").select("item_id", F.posexplode("vec").alias("i", "x"))
    m = e.groupBy("item_id", "i").agg(F.avg("x").alias("x"))
    norm = F.sqrt(F.sum(F.col("x") * F.col("x")).over(Window.partitionBy("item_id")))
    return m.select("item_id", (F.col("i") + 1).cast("long").alias("i"), F.round(F.col("x") / norm, 5).alias("x"))


TRANSLATED = [("theor", None), ("queil", None), ("src1", None)]
_SCOPED = [(t, "path") for t, _ in TRANSLATED]


@query(f"with {bm25_sql(_SCOPED, fts.WEIGHTS)}, {bm25_sql(TRANSLATED, fts.WEIGHTS, '', tag='2')}, a as (select id, score, 0 as tier from bm order by bm.score desc, id limit 10), b as (select id, score, 1 as tier from bm2 order by bm2.score desc, id limit 20) select id, tier from (select * from a union all select * from b where id not in (select id from a)) order by tier, score desc, id limit 15")
def t11_translated_leg(spark, d):
    scoped = _bm25(spark, d, _SCOPED).orderBy(F.desc("score"), "id").limit(10)
    everywhere = _bm25(spark, d, TRANSLATED).orderBy(F.desc("score"), "id").limit(20)
    return fts.tail_fill(scoped, everywhere, 15).select("id", "tier")


@query(f"with {bm25_sql(CLAUSES, fts.WEIGHTS)} select f.path, round(bm.score, 6) as score from bm join files f on f.id = bm.id where starts_with(f.path, 'src/src1/') order by bm.score desc, f.path limit 20 offset 2")
def f4_inspect_path_query(spark, d):
    inside = lookup.under_path(T.files(spark, d), "src/src1", itself=True).select("id", "path")
    hits = _bm25(spark, d).join(inside, "id").orderBy(F.desc("score"), "path").offset(2).limit(20)
    return hits.select("path", F.round("score", 6).alias("score"))


_SIGNALS = "sig as (select f.id, len(list_filter(['en', 'src1', 'theor'], lambda t: t = lang or t = 'doc' || f.id)) as symbol_overlap, len(list_filter(['en', 'src1', 'theor'], lambda t: list_contains(string_split(path, '/'), t))) as path_overlap, len(list_filter(['en', 'src1', 'theor'], lambda t: contains(lower(content), t))) as covered, size / max(size) over () as share from files f)"


@query(f"with {bm25_sql(CLAUSES, fts.WEIGHTS)}, {_SIGNALS} select bm.id, round(bm.score + least(0.03 * symbol_overlap + 0.015 * path_overlap + least(0.01 * covered, 0.03) + 0.02 * share - 0.015, 0.09), 6) as boosted from bm join sig on sig.id = bm.id order by bm.score + least(0.03 * symbol_overlap + 0.015 * path_overlap + least(0.01 * covered, 0.03) + 0.02 * share - 0.015, 0.09) desc, bm.id limit 20")
def r2_boosts(spark, d):
    terms = F.array(*[F.lit(t) for t in ("en", "src1", "theor")])
    s = _docs(spark, d)
    most = s.agg(F.max("n_chars").alias("most"))
    j = _bm25(spark, d).join(s, "id").crossJoin(most)  # one row
    names = F.flatten(F.transform(F.array(F.concat(F.lit("doc"), F.col("id").cast("string")), F.col("lang")), X.symbol_tokens))
    path = X.path_tokens(F.col("path"))
    covered = F.size(F.filter(terms, lambda t: F.contains(F.lower("content"), t)))
    out = vector.boosts(j, F.size(F.array_intersect(terms, names)), F.size(F.array_intersect(terms, path)), X.archive_segments(F.col("path")), X.is_test_like(F.col("path")), covered, F.col("n_chars") / F.col("most"), F.size(F.split("path", "/")))
    return out.orderBy(F.desc("boosted"), "id").limit(20).select("id", F.round("boosted", 6).alias("boosted"))


# --- stages of search ----------------------------------------------------------------------------
@query(f"with {SYMBOLS}, q as (select id, name as q from symbols union all select id + 1000000000, 'Type' || id from symbols union all select id + 2000000000, 'get_' || id from symbols) select id, case when regexp_matches(q, '^\\S{{2,}}$') and (regexp_matches(q, '[_:./\\\\-]') or regexp_matches(q, '[a-z][A-Z]') or regexp_matches(q, '^[A-Z][A-Za-z0-9]+$')) then 'identifier' else 'hybrid' end as mode from q")
def r5_f10_mode(spark, d):
    s = T.symbols(spark, d)
    i = F.col("id")
    q = s.select("id", F.col("name").alias("q")).unionByName(s.select((i + 1000000000).alias("id"), F.concat(F.lit("Type"), i.cast("string")).alias("q"))).unionByName(s.select((i + 2000000000).alias("id"), F.concat(F.lit("get_"), i.cast("string")).alias("q")))
    return q.select("id", search.mode(F.col("q")).alias("mode"))


_SCORED = "(id % 4) + (id % 3) / 10.0 + case when id % 50 = 0 then 1 else 0 end + case when id % 33 = 0 then 0.75 else 0 end"


@query(f"with {FILES}, s as (select path, {_SCORED} as score, id % 4 as covered from files) select path, round(score, 4) as score from s qualify row_number() over (partition by regexp_replace(path, '/[^/]*$', '') order by s.score desc, covered desc, length(path), path) <= 2 order by s.score desc, covered desc, length(path), path limit 10")
def r8_r9_probe_ranking(spark, d):
    i = F.col("id")
    score = search.probe_score(F.col("path"), i % 4, (i % 3) / 10.0, i % 50 == 0, i % 33 == 0)
    hits = search.ranked_hits(T.files(spark, d).select("path", score.alias("score"), (i % 4).alias("covered")), [F.desc("score"), F.desc("covered"), F.length("path")])
    return hits.select("path", F.round("score", 4).alias("score"))


_WORDS = "words as (select distinct doc_id, unnest(list_filter(regexp_split_to_array(lower(text), '[^\\p{L}\\p{N}]+'), lambda t: length(t) >= 3)) as token from documents), df as (select token, count(*) as df from words group by 1), rare as (select token as atom from df where df between 3 and 30 order by token limit 5)"


@query(f"with {_WORDS}, ok as (select * from words where token in (select token from df where df <= 60)), n as (select atom, b.token, count(*) as n from rare join words a on a.token = atom join ok b on b.doc_id = a.doc_id where b.token <> atom group by 1, 2), top as (select * from n qualify row_number() over (partition by atom order by n desc, token) <= 6) select atom, token, n from top order by n desc, token, atom limit 8")
def r10_cooccurrence(spark, d):
    w = F.array_distinct(F.filter(F.split(F.lower("text"), fts.TOKEN_SPLIT), lambda t: F.length(t) >= 3))
    tokens = T.read(spark, d, "documents").select(F.col("doc_id").alias("path"), F.explode(w).alias("token"))
    rare = tokens.groupBy("token").count().filter("count between 3 and 30").orderBy("token").limit(5).select(F.col("token").alias("atom"))
    return search.cooccurring(tokens, rare)


@query(f"with {FILES}, a as (select path, size as score from files where lang = 'en' order by size desc, path limit 5), b as (select path, mtime as score from files where id % 90 = 0), c as (select path, size as score from files where size > 500), u as (select path, 0 as tier, score from a union all select path, 1, score from b union all select path, 2, score from c) select path, tier from u qualify row_number() over (partition by path order by tier, score desc) = 1")
def r11_merge_hits(spark, d):
    f = T.files(spark, d)
    size = F.col("size").cast("double").alias("score")
    return search.merge_hits(f.filter("lang = 'en'").select("path", size), f.filter("id % 90 = 0").select("path", F.col("mtime").alias("score")), f.filter("size > 500").select("path", size), 5).select("path", "tier")


@query(f"with {_TERMS}, probes(atom) as (values ('1'), ('xt'), ('r'), ('qq')) select atom, path, row_number() over (partition by atom order by mtime desc, path) as rank from (select distinct atom, path, mtime from terms join files using (path) join probes on ends_with(token, atom)) qualify rank <= 5")
def r12_substring_probe(spark, d):
    return search.substring_probe(T.files(spark, d), values(spark, "atom", [("1",), ("xt",), ("r",), ("qq",)]))


@query(f"with {FILES}, top as (select path, row_number() over (order by size desc, path) as rank from files qualify rank <= 10), best as (select path from files where path not in (select path from top) order by mtime desc, path limit 1) select path, rank from top where rank <= 9 union all select path, 10 from best")
def r13_tail_rescue(spark, d):
    f = T.files(spark, d)
    top = f.orderBy(F.desc("size"), "path").limit(10)
    hits = top.select("path", F.row_number().over(Window.orderBy(F.desc("size"), "path")).alias("rank"))  # ten rows
    return search.tail_rescue(hits, f.select("path", F.col("mtime").alias("score")))


@query(f"with {FILES}, top as (select *, row_number() over (order by size desc, path) as rank from files qualify rank <= 30) select path, row_number() over (order by contains(content, 'the') desc, id % 5 desc, rank, path) as lifted from top")
def r14_head_lift(spark, d):
    top = _docs(spark, d).orderBy(F.desc("n_chars"), "path").limit(30)
    hits = top.select("path", F.row_number().over(Window.orderBy(F.desc("n_chars"), "path")).alias("rank"), F.col("content").contains("the").alias("phrase"), (F.col("id") % 5).alias("covered"))  # thirty rows
    return search.head_lift(hits).select("path", "lifted")


LEXICON = [("the", "der die das"), ("of the", "des"), ("que la", "that the"), ("und", "and"), ("de la", "of the")]


@query(f"with lex(pattern, terms) as (values {', '.join(repr(x) for x in LEXICON)}), h as (select doc_id as id, {_HAY.format('text')} as hay from documents) select id, pattern, terms, row_number() over (partition by id order by length(pattern) desc, pattern) as rank from h join lex on contains(hay, ' ' || pattern || ' ')")
def r17_lexicon(spark, d):
    return search.expand_lexicon(T.read(spark, d, "documents").select(F.col("doc_id").alias("id"), F.col("text").alias("query")), values(spark, "pattern terms", LEXICON))


# --- sinks and budgets ---------------------------------------------------------------------------
@query(f"with {FILES} select id, cast(json_object('id', id, 'lang', lang, 'path', path) as varchar) as body from files")
def k1_json_rows(spark, d):
    return T.files(spark, d).select("id", F.to_json(F.struct("id", "lang", "path")).alias("body"))


@query("with w as (select conv_id, turn, sum(length(text)) over (partition by conv_id order by turn) as used, length(text) as n, text from conversations) select conv_id, turn, used, case when n <= 300 then n else 128 end as shown from w where used <= 900")
def k2_response_budget(spark, d):
    fits = search.within_budget(T.read(spark, d, "conversations").withColumnRenamed("text", "content"), 900, "conv_id", [F.col("turn")])
    return fits.select("conv_id", "turn", "used", F.length(search.shortened(F.col("content"), F.lit(300))).cast("long").alias("shown"))


@query(f"with {FILES}, n as (select string_split(path, '/')[2] as source, lang, count(*) as n from files group by 1, 2) select source, '# ' || source || chr(10) || string_agg('- ' || lang || ': ' || n, chr(10) order by n desc, lang) as card from n group by 1")
def k4_context_card(spark, d):
    n = T.files(spark, d).groupBy(F.element_at(F.split("path", "/"), 2).alias("source"), "lang").agg(F.count(F.lit(1)).alias("n"))
    rows = F.transform(F.array_sort(F.collect_list(F.struct((-F.col("n")).alias("less"), "lang", "n"))), lambda r: F.concat(F.lit("- "), r["lang"], F.lit(": "), r["n"].cast("string")))
    return n.groupBy("source").agg(F.concat(F.lit("# "), F.first("source"), F.lit("\n"), F.array_join(rows, "\n")).alias("card"))


# --- ledger --------------------------------------------------------------------------------------
@query(f"with {RECORDS}, new as (select ['note', 'bogus', 'miss', 'todo'][event_id % 4 + 1] as kind from events), ok as (select * from new where kind <> 'bogus') select 'local' as ledger, kind, count(*) as n from (select kind from records where ws = 0 union all select kind from ok) group by 2 union all select 'shared', kind, count(*) from (select kind from records union all select kind from ok) group by 2")
def l3_l11_put_records(spark, d):
    r = T.records(spark, d)
    kinds = F.array(*[F.lit(k) for k in ("note", "bogus", "miss", "todo")])
    new = T.read(spark, d, "events").select(F.col("event_id").alias("id"), F.element_at(kinds, (F.col("event_id") % 4 + 1).cast("int")).alias("kind"))
    local, shared = ledger.put_records(r.filter("ws = 0").select("id", "kind"), r.select("id", "kind"), new)
    both = local.withColumn("ledger", F.lit("local")).unionByName(shared.withColumn("ledger", F.lit("shared")))
    return both.groupBy("ledger", "kind").agg(F.count(F.lit(1)).alias("n"))


@query(f"with {RECORDS} select id, case when ws = 0 then 0 else 1 end as scope from records where id % 7 = 0")
def l6_get_records(spark, d):
    r = T.records(spark, d)
    return ledger.get_records(r.filter("ws = 0"), r, r.filter("id % 7 = 0").select("id")).select("id", "scope")


@query(f"with {bm25_sql([('queil', None), ('ther', None)], {'title': 1.0, 'payload': 1.0}, _RPOST)}, {RECORDS.replace('cast(', 'cast(')}, h as (select *, {_HAY.format('title')} as t, {_HAY.format('payload')} as p from records), s as (select id, 2 * cast(contains(t, ' de') as int) + cast(contains(p, ' de') as int) as relevance from h), u as (select id, score, 'fts' as match, 0 as tier from bm union all select id, relevance, 'folded', 1 from s where relevance > 0 and id not in (select id from bm)) select id, match from u order by tier, u.score desc, id desc limit 60 offset 5")
def l7_search_records(spark, d):
    r = T.records(spark, d)
    post = fts.postings(r, {"title": F.col("title"), "payload": F.col("payload")})
    ranked = fts.bm25f(post, [("queil", None), ("ther", None)], {"title": 1.0, "payload": 1.0})
    folded = fts.record_relevance(r, "dé").filter("relevance > 0").select("id", "relevance")
    return ledger.search_records(ranked, folded, 60, 5)


@query("with e as (select event_id as id, event_type, cast(json_extract_string(props, '$.k') as bigint) % 8 as k from events) select id, event_type <> 'error' as ok, case when event_type <> 'error' then k end as hits, case when event_type = 'error' then [] else list_transform(range(0, least(k, 5)), lambda i: 'a/' || i || '.py') end as top_paths from e")
def l10_telemetry(spark, d):
    k = (F.get_json_object("props", "$.k").cast("long") % 8).cast("int")
    paths = F.when(k > 0, F.transform(F.sequence(F.lit(0), k - 1), lambda i: F.struct(F.concat(F.lit("a/"), i.cast("string"), F.lit(".py")).alias("path")))).otherwise(F.array().cast("array<struct<path:string>>"))
    response = F.when(F.col("event_type") == "error", F.lit('{"error": "E_X"}')).otherwise(F.to_json(F.struct(paths.alias("results"))))
    got = ledger.telemetry(T.read(spark, d, "events").select(F.col("event_id").alias("id"), response.alias("response")))
    return got.withColumn("hits", F.col("hits").cast("long"))


# --- index keeping -------------------------------------------------------------------------------
@query(f"with {CHUNKS} select chunk_id, file_id as mark from chunks where file_id % 3 <> 0 and file_id % 5 <> 0")
def i24_vector_restore(spark, d):
    c = T.chunks(spark, d).withColumn("symbol", F.lit(None).cast("string")).withColumn("kind", F.lit("window"))
    texts = ingest.embed_text(c)
    f = F.col("file_id").cast("double")
    old = texts.filter("file_id % 3 <> 0").select("embed_text", F.when(F.col("file_id") % 5 == 0, F.array(f)).otherwise(F.array(f, F.lit(0.0))).alias("vec"))
    return ledger.snapshot_restored(old, texts, 2).select("chunk_id", F.element_at("vec", 1).cast("long").alias("mark"))


@query(f"with {CHUNKS} select count(*) as chunks, count(distinct file_id) as files from chunks where file_id % 10 <> 2")
def i7_cascade(spark, d):
    gone = T.files(spark, d).filter("id % 10 = 2").select("id")
    (kept,) = ingest.cascade(gone, T.chunks(spark, d))
    return kept.agg(F.count(F.lit(1)).alias("chunks"), F.count_distinct("file_id").alias("files"))


@query("with a as (select doc_id, len(string_split(text, chr(10))) as n from documents), s as (select doc_id, n, unnest(range(0, greatest(n // 6, 0) + 1)) as idx from a) select 'd' || doc_id as path, idx, case when idx = 0 then 1 else 6 * idx end as start_line, least(n, 6 * idx + 5) as end_line from s where idx = 0 or 6 * idx <= n")
def i9_sections(spark, d):
    marked = F.array_join(F.transform(F.split("text", "\n"), lambda t, i: F.when((i + 1) % 3 == 0, F.concat(F.lit("# "), t)).otherwise(F.concat(F.lit("."), t))), "\n")
    src = T.read(spark, d, "documents").select(F.concat(F.lit("d"), F.col("doc_id").cast("string")).alias("path"), marked.alias("content"))
    return ingest.section_chunks(src).select("path", F.col("idx").cast("long"), F.col("start_line").cast("long"), F.col("end_line").cast("long"))


@query(f"with {CHUNKS} select (select count(*) from files) as files, (select count(*) from chunks) as chunks, (select sum(size) from files)::bigint as chars, (select count(*) from files where content is null) as errors")
def i27_index_report(spark, d):
    f = T.sources(spark, d).agg(F.count(F.lit(1)).alias("files"), F.sum("n_chars").alias("chars"), F.count_if(F.col("content").isNull()).alias("errors"))
    return f.crossJoin(T.chunks(spark, d).agg(F.count(F.lit(1)).alias("chunks")))  # one row each


@query(f"with {FILES}, roots as (select distinct 'src/' || source as root from documents where cast(substr(source, 4) as int) % 2 = 0 union select distinct 'src/' || source || '/en' from documents where source in ('src1', 'src2')) select f.path, arg_max(root, length(root)) as root from files f join roots on starts_with(f.path, root || '/') group by 1")
def i30_nearest_root(spark, d):
    docs = T.read(spark, d, "documents")
    even = docs.filter("cast(substr(source, 4) as int) % 2 = 0").select(F.concat(F.lit("src/"), "source").alias("root"))
    roots = even.union(docs.filter("source in ('src1', 'src2')").select(F.concat(F.lit("src/"), "source", F.lit("/en")))).distinct()
    return lookup.nearest_root(T.files(spark, d).select("path"), roots)


@query("with w as (select c_custkey as id, c_custkey % 5 = 0 as gone, c_custkey % 7 = 0 as corrupt, c_custkey % 30 as age, cast(round(abs(c_acctbal)) as bigint) as bytes from customer) select case when corrupt then 'quarantined' when gone and age > 7 then 'orphan' else 'kept' end as state, count(*) as n, sum(bytes)::bigint as bytes from w group by 1")
def i31_collect_garbage(spark, d):
    k = F.col("c_custkey")
    w = T.read(spark, d, "customer").select((k % 5 == 0).alias("gone"), (k % 7 == 0).alias("corrupt"), (k % 30).alias("age"), F.round(F.abs("c_acctbal")).cast("long").alias("bytes"))
    state = F.when(F.col("corrupt"), "quarantined").when(F.col("gone") & (F.col("age") > 7), "orphan").otherwise("kept")
    return w.groupBy(state.alias("state")).agg(F.count(F.lit(1)).alias("n"), F.sum("bytes").alias("bytes"))


@query(f"with {CHUNKS}, wanted as (select chunk_id from chunks order by chunk_id limit 60) select chunk_id, case when row_number() over (order by chunk_id) <= 50 then md5(content) end as body_md5 from chunks where chunk_id in (select chunk_id from wanted)")
def f2_f3_fetch_chunks(spark, d):
    c = T.chunks(spark, d)
    return lookup.fetch_chunks(c, c.select("chunk_id").orderBy("chunk_id").limit(60)).select("chunk_id", F.md5(F.col("content").cast("binary")).alias("body_md5"))


_ODD_CASE = "case p % 8 when 0 then 'node_modules/x' || p || '.js' when 1 then '.git/h' || p || '.py' when 2 then 'a/.env' when 3 then 'a/b' || p || '.unknown' when 4 then '.github/w' || p || '.yml' else 'lib/m' || p || '.py' end"


@query(f"with f as (select p_partkey as p from part), g as (select p, {_ODD_CASE} as path, p % 11 = 0 as nul, case when p % 13 = 0 then 0 when p % 17 = 0 then 2000000 else 100 end as size from f) select path, size from g where p % 8 >= 4 and not nul and size between 1 and 1000000")
def i1_i4_discovery(spark, d):
    p = F.col("p_partkey")
    s = p.cast("string")
    path = F.when(p % 8 == 0, F.concat(F.lit("node_modules/x"), s, F.lit(".js"))).when(p % 8 == 1, F.concat(F.lit(".git/h"), s, F.lit(".py"))).when(p % 8 == 2, "a/.env").when(p % 8 == 3, F.concat(F.lit("a/b"), s, F.lit(".unknown"))).when(p % 8 == 4, F.concat(F.lit(".github/w"), s, F.lit(".yml"))).otherwise(F.concat(F.lit("lib/m"), s, F.lit(".py")))
    content = F.when(p % 11 == 0, F.lit(b"\x00x")).otherwise(F.lit(b"text"))
    listing = T.read(spark, d, "part").select(path.alias("path"), F.when(p % 13 == 0, 0).when(p % 17 == 0, 2_000_000).otherwise(100).alias("size"), content.alias("content"))
    return watch.listed(listing).select("path", "size")


# --- reports -------------------------------------------------------------------------------------
@query(f"with {EDGES}, seeds as (select distinct src_chunk as node, 1.0 / (src_chunk + 1) as score from edges where dst_chunk is not null), direct as (select * from seeds order by score desc, node limit 33), pairs as (select distinct src_chunk as a, dst_chunk as b from edges where dst_chunk is not null), hops as (select a as seed, b as node, 'calls' as via from pairs union all select b, a, 'called_by' from pairs), near0 as (select * from hops qualify row_number() over (partition by seed, via order by node) <= 2), near as (select n.*, score from near0 n join direct d on d.node = n.seed qualify row_number() over (partition by seed order by via, n.node) <= 2), fresh as (select node, arg_max(via, struct_pack(s := score, v := via)) as via, max(score) as score from near where node not in (select node from direct) group by 1), u as (select node, 'direct' as via, score, 0 as tier from direct union all select node, via, score, 1 from fresh) select node, via, tier from u order by tier, score desc, node limit 50")
def n10_context_pack(spark, d):
    e = T.edges(spark, d)
    seeds = e.filter("dst_chunk is not null").select(F.col("src_chunk").alias("node")).distinct().withColumn("score", 1.0 / (F.col("node") + 1))
    both = e.filter("dst_chunk is not null")
    nodes = both.select(F.col("src_chunk").alias("node")).union(both.select("dst_chunk")).distinct()
    return reports.context_pack(seeds, graph.one_hop(e, nodes, 2))


@query(f"with {CHUNKS}, s as (select *, (chunk_id * 31) % 97 as score from chunks), best as (select file_id, max(score) as score, arg_max(content, score * 1000000 - idx) as content, arg_max(chunk_id, score * 1000000 - idx) as id from s group by 1), top as (select *, cast(ceil(length(content) / 4.0) as bigint) + 14 as tokens from best order by score desc, file_id limit 12), w as (select *, sum(tokens) over (order by score desc, file_id) as used from top) select id, file_id, tokens, cast(used as bigint) as used from w where used <= 2000")
def n11_evidence_pack(spark, d):
    hits = T.chunks(spark, d).select("file_id", F.col("chunk_id").alias("id"), "content", (F.col("chunk_id") * 31 % 97).alias("score"))
    return search.evidence_pack(hits, 2000).select("id", "file_id", "tokens", "used")


@query(f"with {CHUNKS}, s as (select file_id, chunk_id, (chunk_id * 31) % 97 as score, idx from chunks) select file_id, arg_max(chunk_id, score * 1000000 - idx) as id, max(score) as score from s group by 1")
def a11_best_per_file(spark, d):
    return search.best_per_file(T.chunks(spark, d).select("file_id", F.col("chunk_id").alias("id"), (F.col("chunk_id") * 31 % 97).alias("score")))


@query(f"with {EDGES}, {FILES}, langs as (select lang as key, count(*) as n from files group by 1 order by n desc, key limit 8), h as (select s.name || '#' || s.id as key, count(*) as n from edges join symbols s on s.chunk_id = dst_chunk group by 1, s.id order by n desc, s.id limit 15), r as (select path as key, cast(mtime as bigint) as n from files order by mtime desc, path limit 10) select 'languages' as section, key, n from langs union all select 'hubs', key, n from h union all select 'recent', key, n from r")
def n16_digest(spark, d):
    from .queries import a2_language_mix, a3_hub_symbols, a6_o1_recent_files

    parts = [("languages", a2_language_mix(spark, d).select(F.col("lang").alias("key"), "n")), ("hubs", a3_hub_symbols(spark, d).select(F.concat("name", F.lit("#"), F.col("id").cast("string")).alias("key"), F.col("degree").alias("n"))), ("recent", a6_o1_recent_files(spark, d).select(F.col("path").alias("key"), F.col("mtime").cast("long").alias("n")))]
    out = None
    for name, part in parts:
        part = part.select(F.lit(name).alias("section"), "key", "n")
        out = part if out is None else out.unionByName(part)
    return out


@query(f"with {CHUNKS}, {RECORDS} select (select count(*) from files) as files, (select count(*) from records where status = 'open') as open_records, (select max(id) from records where head_sha is not null) as resume_from, (select count(*) from chunks where file_id not in (select vec_id from embeddings)) * 10 > (select count(*) from chunks) as many_pending, (select max(mtime) from files) < 7 * 86400 as old")
def n17_prime(spark, d):
    r, c = T.records(spark, d), T.chunks(spark, d)
    known = T.vectors(spark, d).select(F.col("vec_id").alias("file_id"))
    pending = c.join(known, "file_id", "left_anti").agg(F.count(F.lit(1)).alias("pending"))
    # one row each
    one = T.files(spark, d).agg(F.count(F.lit(1)).alias("files"), F.max("mtime").alias("newest")).crossJoin(r.agg(F.count_if(F.col("status") == "open").alias("open_records"))).crossJoin(ledger.latest_checkpoint(r).select(F.col("id").alias("resume_from"))).crossJoin(pending).crossJoin(c.agg(F.count(F.lit(1)).alias("chunks")))
    return one.select("files", "open_records", "resume_from", (F.col("pending") * 10 > F.col("chunks")).alias("many_pending"), (F.col("newest") < 7 * 86400).alias("old"))


@query("with g as (select unnest(range(0, 20)) * 100 as least), j as (select d.n_chars, l.quality from documents d join labels l using (doc_id) where quality is not null), s as (select least, avg(cast((n_chars >= least) = (quality = 1) as int)) as accuracy, sum(cast(n_chars >= least and quality = 1 as int)) * 1.0 / nullif(sum(quality), 0) as recall from g cross join j group by 1) select least, round(accuracy, 6) as accuracy, round(recall, 6) as recall from s where recall >= 0.9 order by s.accuracy desc, least limit 1")
def a18_grid_sweep(spark, d):
    j = T.read(spark, d, "documents").select("doc_id", "n_chars").join(T.read(spark, d, "labels").filter("quality is not null").select("doc_id", "quality"), "doc_id")
    # all variants in one pass: an array of twenty verdicts a row
    each = j.select("quality", "n_chars", F.explode(F.transform(F.sequence(F.lit(0), F.lit(19)), lambda i: i * 100)).alias("least"))
    said = (F.col("n_chars") >= F.col("least")).cast("int")
    s = each.groupBy("least").agg(F.avg((said == F.col("quality")).cast("int")).alias("accuracy"), (F.sum(said * F.col("quality")) / F.sum("quality")).alias("recall"))
    return s.filter("recall >= 0.9").orderBy(F.desc("accuracy"), "least").limit(1).select(F.col("least").cast("long"), F.round("accuracy", 6).alias("accuracy"), F.round("recall", 6).alias("recall"))


@query("with q as (select label, min(vec_id) as q from embeddings group by 1), e as (select vec_id, label, cast(embedding as double[]) as v from embeddings), s as (select q.q, b.vec_id, b.label = q.label as expected, list_dot_product(a.v, b.v) as score from q join e a on a.vec_id = q.q join e b on b.vec_id <> q.q), r as (select q, expected, row_number() over (partition by q order by score desc, vec_id) as rank from s) select q, min(rank) as rank from r where expected group by 1")
def v6_model_eval(spark, d):
    v = T.vectors(spark, d)
    q = v.groupBy("label").agg(F.min_by("vec", "vec_id").alias("qv"), F.min("vec_id").alias("q")).withColumnRenamed("label", "want")
    # a query a label: ten rows
    s = v.join(F.broadcast(q), F.expr("vec_id <> q")).select("q", "vec_id", (F.col("label") == F.col("want")).alias("expected"), vector.dot(F.col("vec"), F.col("qv")).alias("score"))
    best = s.filter("expected").groupBy("q").agg(F.max(F.struct("score", (-F.col("vec_id")).alias("less"))).alias("best"))
    above = s.join(F.broadcast(best), "q").filter("score > best.score or score = best.score and -vec_id >= best.less")
    return above.groupBy("q").agg(F.count(F.lit(1)).alias("rank"))


@query("with q as (select cast(embedding as double[]) as v from embeddings where vec_id = 0), e as (select vec_id, cast(embedding as double[]) as v from embeddings where vec_id % 5 <> 1) select vec_id, round(list_dot_product(e.v, q.v), 6) as score from e, q where list_dot_product(e.v, q.v) > 0.05 order by list_dot_product(e.v, q.v) desc, vec_id limit 30")
def v3_mixed_dimensions(spark, d):
    v = T.vectors(spark, d)
    mixed = v.withColumn("vec", F.when(F.col("vec_id") % 5 == 1, F.slice("vec", 1, 32)).otherwise(F.col("vec")))
    return vector.semantic(mixed, v.filter("vec_id = 0"), 30).select("vec_id", F.round("score", 6).alias("score"))


@query("select event_id, cast(floor((epoch_us(m) - epoch_us(ts)) / 86400000000) as bigint) as days from events, (select max(ts) as m from events)")
def s16_age_in_days(spark, d):
    e = T.read(spark, d, "events")
    us = lambda c: F.unix_micros(F.col(c).cast("timestamp"))
    return e.crossJoin(e.agg(F.max("ts").alias("m"))).select("event_id", F.floor((us("m") - us("ts")) / 86_400_000_000).alias("days"))  # one row


@query("with a as (select user_id, ts, coalesce(ts - lag(ts) over (partition by user_id order by ts) > interval 6 hour, true) as starts from events), b as (select *, sum(starts::int) over (partition by user_id order by ts) as burst from a) select user_id, epoch_us(min(ts)) as began, epoch_us(max(ts)) as last, count(*) as n from b group by user_id, burst")
def w3_debounced(spark, d):
    got = debounce.debounced(T.read(spark, d, "events").select("user_id", F.col("ts").cast("timestamp").alias("ts")), "user_id", gap="6 hours")
    return got.select("user_id", F.unix_micros("began").alias("began"), F.unix_micros("last").alias("last"), "n")


_ = (ACCENTED, _POST, X)


@query(f"with {RECORDS}, t as (select max(id) + 1 as id from records) select id, 'sha-new' as head_sha, (select count(*) from records) + 1 as records from t")
def l4_checkpoint(spark, d):
    r = T.records(spark, d).select("id", "kind", "head_sha")
    after = ledger.checkpointed(r, "sha-new")
    return ledger.latest_checkpoint(after).crossJoin(after.agg(F.count(F.lit(1)).alias("records")))  # one row each


@query(f"with f as (select p_partkey as p from part), g as (select {_ODD_CASE} as path, p_partkey * 1000 as size from f, lateral (select p as p_partkey)) select path, size from g where size <= 524288 and path like 'lib/%'")
def y13_port_discovery(spark, d):
    p = F.col("p_partkey")
    s = p.cast("string")
    path = F.when(p % 8 == 0, F.concat(F.lit("node_modules/x"), s, F.lit(".js"))).when(p % 8 == 1, F.concat(F.lit(".git/h"), s, F.lit(".py"))).when(p % 8 == 2, "a/.env").when(p % 8 == 3, F.concat(F.lit("a/b"), s, F.lit(".unknown"))).when(p % 8 == 4, F.concat(F.lit(".github/w"), s, F.lit(".yml"))).otherwise(F.concat(F.lit("lib/m"), s, F.lit(".py")))
    listing = T.read(spark, d, "part").select(path.alias("path"), (p * 1000).alias("size"), F.lit(b"x").alias("content"))
    return watch.listed(listing, 512 * 1024, ("*.yml",)).select("path", "size")
