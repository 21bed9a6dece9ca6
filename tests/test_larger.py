"""Queries on made tables that the given ones are too small or too plain for: against their SQL, plans without costly steps."""

from __future__ import annotations

import compare
import pytest
from pyspark.sql import functions as F

from lakeside.operators import code, graph, lookup, reports  # noqa: F401
from lakeside.plans import code_queries, planner_queries, search_queries  # noqa: F401
from lakeside.plans import queries as engine
from lakeside.sources import storage
from lakeside.sources import tables as T
from lakeside.sources.storage import dealt


@pytest.fixture
def made(tmp_path, sf):
    """A copy of the smallest tables, some by a select of their own."""

    def make(**selects: str) -> str:
        con = compare.connect(sf)
        for t in compare.TABLES:
            con.execute(f"copy ({selects.get(t, f'select * from {t}')}) to '{tmp_path}/{t}.parquet' (format parquet)")
        return str(tmp_path)

    return make


def agree(spark, folder: str, name: str) -> None:
    cols, rows = compare.duck_rows(compare.connect(folder), engine.ORACLES[name])
    df = engine.QUERIES[name](spark, folder)
    assert sorted(df.columns) == cols
    assert compare.spark_rows(df) == rows


def test_replies_with_letters_without_a_capital(spark, made):
    texts = ["Straße und Ort", "schließen ver", "ﬁn de ver", "ſa ver der", "Kelvin ver der"]
    agree(spark, made(documents="select * replace (case doc_id " + " ".join(f"when {i + 10} then '{t}'" for i, t in enumerate(texts)) + " else text end as text) from documents"), "s15_checked_replies")


def test_citations_of_modules_over_a_million(spark, made):
    folder = made(part="select * from part union all select * replace (p_partkey + 1000000 as p_partkey) from part", lineitem="select * from lineitem union all select * replace (l_orderkey + 10000000 as l_orderkey, l_partkey + 1000000 as l_partkey) from lineitem")
    agree(spark, folder, "n12_citations")


def steps(df) -> list[tuple[str, int]]:
    """Name and rows out of each step of a query that has run."""

    def walk(p):
        name = p.getClass().getSimpleName()
        if name == "AdaptiveSparkPlanExec":
            yield from walk(p.executedPlan())
        elif name.endswith("QueryStageExec"):
            yield from walk(p.plan())
        else:
            m, below = p.metrics().get("numOutputRows"), p.children()
            yield name, m.get().value() if m.isDefined() else 0
            for i in range(below.size()):
                yield from walk(below.apply(i))

    df.collect()
    return list(walk(df._jdf.queryExecution().executedPlan()))


def count(df, name: str) -> int:
    return sum(n == name for n, _ in steps(df))


def test_calls_are_resolved_in_one_meeting(spark):
    """By hand: own file before imported before the only one, qualifiers within imports, two qualifiers on a line; calls are dealt once."""
    src = spark.createDataFrame([
        ("a.py", "import b\nimport c\ndef dup(x):\n    b.f(1) + c.f(2)\n    only(1)\n    dup(2)\n    z.f(3)"),
        ("b.py", "def f(x):\n    dup(1)\ndef dup(x):\n    two(1)"),
        ("c.py", "import d\ndef f(x):\n    two(1)\n    f(4)\n    nowhere(1)"),
        ("d.py", "def two(x):\n    only(1)"),
        ("e.py", "def two(x):\n    return self.two(1)\ndef only(x):\n    f(1)"),
    ], "path string, content string")
    found = code.symbols(src).select(F.xxhash64("path", "name").alias("id"), "name", F.col("path").alias("file"))
    got = code.resolved_calls(src, found)
    want = {("a.py", 4, "f", "b", "b.py"), ("a.py", 4, "f", "c", "c.py"), ("a.py", 5, "only", None, "e.py"), ("a.py", 6, "dup", None, "a.py"), ("a.py", 7, "f", "z", None), ("b.py", 2, "dup", None, "b.py"), ("b.py", 4, "two", None, None), ("c.py", 3, "two", None, "d.py"), ("c.py", 4, "f", None, "c.py"), ("c.py", 5, "nowhere", None, None), ("d.py", 2, "only", None, "e.py"), ("e.py", 2, "two", "self", "e.py"), ("e.py", 4, "f", None, None)}
    rows = [(r.path, r.line, r.name, r.qualifier, r.target) for r in got.collect()]
    assert set(rows) == want and len(rows) == len(want)


def test_code_edges_shuffle_calls_once(spark, sf):
    symbols = T.code_symbols(spark, sf).select(F.xxhash64("path", "name").alias("id"), "name", F.col("path").alias("file"))
    edges = code.resolved_calls(T.code(spark, sf), symbols)
    joins = [n for n, rows in steps(edges) if "Join" in n and rows >= T.code_edges(spark, sf).count()]
    assert len(joins) == 1


def test_lines_with_two_parts_follow_one_another(spark, made):
    """Repeated line numbers, gaps and repeated lines of an order."""
    folder = made(lineitem="select * replace (l_orderkey // 3 as l_orderkey) from lineitem union all select * from lineitem where l_linenumber < 3 union all select * replace (null as l_partkey) from lineitem where l_linenumber = 2")
    agree(spark, folder, "j5_resolve_qualified")
    agree(spark, folder, "a13_grouped_edges")


def test_patches_count_callers_without_ranking_them(spark, sf):
    assert count(engine.QUERIES["n5_n6_simulate_patch"](spark, sf), "WindowExec") == 0


def test_suspects_are_ranked_once_a_chunk(spark, sf, made):
    """As many traces again of the same places: the calls that are ranked stay the same."""
    folder = made(events="select * from events union all select * replace (event_id + 1000000 as event_id) from events where event_id < 100")
    agree(spark, folder, "y18_port_suspects")
    plan = engine.QUERIES["y18_port_suspects"](spark, sf)._jdf.queryExecution().optimizedPlan().toString()
    assert "windowspecdefinition(target" in plan and "windowspecdefinition(id" not in plan


def test_declarations_that_begin_and_end_alike_meet_lines_once(spark):
    """50,000 declarations on 20 lines of a path, 20 lines asked: an all-pairs join had half a million rows."""
    decls = spark.range(50_000).select("id", F.lit("p").alias("path"), F.concat(F.lit("n"), "id").alias("name"), (F.col("id") % 20 + 1).alias("decl_line"), (F.col("id") % 20 + 1 + F.col("id") % 3).alias("chunk_end"))
    lines = spark.range(1, 21).select(F.lit("p").alias("path"), F.col("id").alias("line"))
    df = lookup.nearest_declaration(lines, decls)
    assert max(rows for n, rows in steps(df) if "Join" in n) <= 20 * 60
    want = {line: max((d % 20 + 1 + d % 3 >= line, d % 20 + 1, d) for d in range(50_000) if d % 20 + 1 <= line)[2] for line in range(1, 21)}
    assert {r.line: r.name for r in df.collect()} == {line: f"n{d}" for line, d in want.items()}


def test_risk_groups_callers_without_ranking_them(spark, sf):
    assert count(engine.QUERIES["a15_risk"](spark, sf), "WindowExec") == 0


def test_callers_are_ranked_once_a_symbol(spark, sf):
    plan = engine.QUERIES["n9_suspects"](spark, sf)._jdf.queryExecution().optimizedPlan().toString()
    assert "windowspecdefinition(name" in plan and "windowspecdefinition(id" not in plan


def test_common_names_meet_their_files_not_each_other(spark):
    """1,000 edges to a name that 1,000 symbols of 5 files and none bear: an all-pairs join had a million rows."""
    s = spark.range(1000).select("id", F.col("id").alias("chunk_id"), F.lit("n").alias("name"), F.concat(F.lit("f"), (F.col("id") % 5).cast("string")).alias("file"))
    e = spark.range(1000).select(F.col("id").alias("edge_id"), F.when(F.col("id") % 7 > 0, F.concat(F.lit("f"), (F.col("id") % 7).cast("string"))).alias("file"), F.when(F.col("id") % 11 > 0, "n").alias("dst_name"), F.lit(None).cast("string").alias("qualifier"))
    loose = lookup.resolve_any(e, s)
    assert max(rows for n, rows in steps(loose) if "Join" in n) <= 1000
    assert {r.edge_id: r.dst_chunk for r in loose.collect()} == {i: None if i % 11 == 0 else i % 7 if i % 7 in range(1, 5) else 0 for i in range(1000)}
    scope = spark.createDataFrame([("f6", "f3"), ("f6", "f2"), ("f1", "f0")], "file string, imported string")
    strict = lookup.resolve_edges(e, s, scope)
    assert max(rows for n, rows in steps(strict) if "Join" in n) <= 1000
    assert {r.edge_id: r.dst_chunk for r in strict.collect()} == {i: None if i % 11 == 0 else i % 7 if i % 7 in range(1, 5) else 2 if i % 7 == 6 else None for i in range(1000)}


def test_names_of_an_unknown_file(spark, made):
    folder = made(part="select * replace (case when p_partkey % 5 = 0 then null else p_brand end as p_brand, case when p_partkey % 3 = 0 then 'a b' else p_name end as p_name) from part")
    agree(spark, folder, "y9_resolve_any_name")
    agree(spark, folder, "j5_j6_resolve_names")


def test_only_edges_of_tests_are_dealt(spark, sf):
    df = engine.QUERIES["y10_port_coverage"](spark, sf)
    plan = df._jdf.queryExecution().executedPlan().toString()
    at = plan.index("REPARTITION_BY_COL")
    assert "RLIKE" in plan[at : at + 400]


def test_siblings_meet_words_not_lists(spark, made):
    """A folder's own words are looked up word by word, not as one list beside each of its files."""
    picked = spark.range(300).select(F.format_string("d/w%d_x.py", "id").alias("path"))
    files = spark.range(400).select(F.format_string("d/w%d_x.py", "id").alias("path")).union(spark.createDataFrame([("d/q.py",), ("e/w1.py",)], "path string"))
    df = reports.sibling_hints(picked, files)
    assert "array_intersect" not in df._jdf.queryExecution().optimizedPlan().toString()
    assert [(r.path, r.shared) for r in df.orderBy(F.desc("shared"), "path").collect()] == [(f"d/w{i}_x.py", 1) for i in range(300, 306)]
    agree(spark, made(part="select * from part union all select * replace (p_partkey + 5000 as p_partkey) from part"), "n14_sibling_hints")


def test_one_hop_deals_edges_once(spark, sf):
    e = T.edges(spark, sf)
    df = graph.one_hop(e, e.select(F.col("src_chunk").alias("node")).distinct(), 2)
    assert count(df, "ShuffleExchangeExec") <= 3


def test_larger_tables_are_dealt_to_more_tasks(spark, tmp_path):
    path = str(tmp_path / "t")
    spark.range(400_000).select("id", F.sha2(F.col("id").cast("string").cast("binary"), 256).alias("x")).write.parquet(path)
    df = spark.read.parquet(path)
    assert dealt(df, "id", bytes_each=1 << 20).rdd.getNumPartitions() > 16 > dealt(df, "id").rdd.getNumPartitions()


def test_postings_are_neither_dealt_by_token_nor_sorted(spark, sf):
    plan = T.postings(spark, sf).filter("token = 'the'").groupBy("id").count()._jdf.queryExecution().executedPlan().toString()
    assert "rangepartitioning" not in plan and "Sort" not in plan and "postings" not in {name for _, _, name in storage._kept}
    assert plan.count("hashpartitioning") == 1 and "partial_count" in plan  # only what matches


@pytest.mark.parametrize("name", ["t8_bm25f", "y1_bm25f_port_weights", "r2_r4_hybrid", "r1_rrf", "t13_substring_topup", "f4_inspect_path_query"])
def test_full_text_of_repeated_and_odd_documents(spark, made, name):
    """Documents that come twice, empty ones, ones of marks alone."""
    folder = made(documents="select * from documents where doc_id % 3 > 0 or doc_id > 60 union all select * from documents where doc_id % 40 = 1 and doc_id not in (select vec_id from embeddings) union all select * replace (doc_id + 100000 as doc_id, case doc_id % 3 when 0 then '' when 1 then '... --- !' else 'the the the theory, over the ver' end as text) from documents where doc_id < 30")
    agree(spark, folder, name)


def test_path_probe_reads_texts_once(spark, sf):
    assert count(engine.QUERIES["r7_path_probe"](spark, sf), "GenerateExec") == 0


@pytest.mark.parametrize("name", ["n9_suspects", "y18_port_suspects", "n8_resolved_frames"])
def test_traces_are_parsed_once(spark, sf, name):
    df = engine.QUERIES[name](spark, sf)
    assert count(df, "MapInArrowExec") == 0
