"""Every engine query against its SQL, and the parsers against small examples."""

from __future__ import annotations

import hashlib
import re

import compare
import pytest
from pyspark.sql import functions as F

from lakeside.operators import analysis, graph, ingest
from lakeside.plans import code_queries, planner_queries, search_queries  # noqa: F401
from lakeside.plans import queries as engine
from lakeside.streaming import debounce, watch


@pytest.fixture(scope="module")
def duck(sf):
    return compare.connect(sf)


@pytest.mark.parametrize("name", sorted(engine.ORACLES))
def test_query_equals_sql(spark, sf, duck, name):
    df = engine.QUERIES[name](spark, sf)
    cols, rows = compare.duck_rows(duck, engine.ORACLES[name])
    assert sorted(df.columns) == cols
    assert compare.spark_rows(df) == rows


def test_whole_texts_are_normalized(spark, sf, duck):
    norm = {i: re.sub("[ \\t\\n\\x0b\\f\\r]+", " ", t.lower()).strip(" ") for i, t in duck.execute("select doc_id, text from documents where text is not null").fetchall()}
    got = {r.doc_id: (r.norm_md5, r.n) for r in engine.QUERIES["s14_normalize_text"](spark, sf).filter("n is not null").collect()}
    assert got == {i: (hashlib.md5(t.encode()).hexdigest(), len(t)) for i, t in norm.items()} and max(map(len, norm.values())) > 60


def test_names_resolve_among_all_definitions(spark, sf, duck):
    parts = duck.execute("select p_partkey, p_name, p_brand, p_size from part").fetchall()
    size_file = {i: (size, file) for i, _, file, size in parts}
    scope = {(file, size_file[i + 1][1]) for i, _, file, size in parts if i + 1 in size_file and size_file[i + 1][0] == size}
    name_of = {i: n for i, n, _, _ in parts}
    best, loose = {}, {}
    for edge, _, file, _ in parts:
        name = name_of.get(edge + 1)
        defs = [(i, f) for i, n, f, _ in parts if n == name]
        only = len({f for _, f in defs}) == 1
        ranked = [(1 if f == file else 2 if (file, f) in scope else 3, i) for i, f in defs if f == file or (file, f) in scope or only]
        best[edge], loose[edge] = min(ranked, default=(0, None))[1], min(((f != file, i) for i, f in defs), default=(0, None))[1]
    assert {r.edge_id: r.dst_chunk for r in engine.QUERIES["j5_j6_resolve_names"](spark, sf).collect()} == best
    assert {r.edge_id: r.dst_chunk for r in engine.QUERIES["y9_resolve_any_name"](spark, sf).collect()} == loose


def test_normalized_ranks_and_communities(spark):
    ranks = spark.createDataFrame([("a", 0.1), ("b", 0.3), ("c", 0.5)], "node string, rank double")
    assert {r.node: round(r["rank"], 6) for r in graph.normalized(ranks).collect()} == {"a": 0.0, "b": 0.5, "c": 1.0}
    assert {r["rank"] for r in graph.normalized(ranks.withColumn("rank", F.lit(0.2))).collect()} == {0.0}
    components = spark.createDataFrame([(i, c) for c in range(10) for i in range(100 * c, 100 * c + 2 + c)], "node long, component long")
    paths = spark.createDataFrame([(900, "b/x"), (901, "b/x"), (902, "b/x"), (903, "a/y"), (904, "c/z"), (905, "c/w"), (800, "b/1"), (801, "a/1")], "node long, path string")
    got = {r.component: (r["size"], r.label) for r in graph.communities(components, paths).collect()}
    assert got == {c: (2 + c, {9: "c", 8: "a"}.get(c, "?")) for c in range(2, 10)}


CODE = [("api/main.py", '@app.get("/api/users")\ndef users():\n    return Repo.load(helper(1))\n@app.post("/api/users/{uid}/ban")\ndef ban(uid):\n    check(uid)  # note'), ("web/client.ts", "export async function go() {\n  await fetch('/api/users');\n  const u = axios.get(`/api/users/1?x=1`);\n}\nclass A extends Base implements Face {}"), ("api/env.sh", "ROOT=/srv\nx='/etc/hosts'\ncall(\"/v1/ping/\")"), ("s.swift", "class View: Base {"), ("r.rs", "impl Draw for Shape {")]


def test_edges_of_other_languages(spark):
    src = spark.createDataFrame(CODE, "path string, content string")
    assert sorted((r.path, r.line, r.route, r.kind) for r in ingest.route_edges(src).collect()) == [("api/env.sh", 3, "/v1/ping", "api_call"), ("api/main.py", 1, "/api/users", "route"), ("api/main.py", 4, "/api/users/{uid}/ban", "route"), ("web/client.ts", 2, "/api/users", "api_call"), ("web/client.ts", 3, "/api/users/1", "api_call")]
    calls = {(r.path, r.line, r.qualifier, r.name) for r in ingest.call_edges(src).filter("kind = 'calls'").collect()}
    assert calls == {("api/main.py", 1, "app", "get"), ("api/main.py", 3, "Repo", "load"), ("api/main.py", 3, None, "helper"), ("api/main.py", 4, "app", "post"), ("api/main.py", 6, None, "check"), ("web/client.ts", 2, None, "fetch"), ("web/client.ts", 3, "axios", "get"), ("api/env.sh", 3, None, "call")}
    assert {(r.path, r.name, r.kind) for r in ingest.base_edges(src).collect()} == {("web/client.ts", "Base", "extends"), ("web/client.ts", "Face", "implements"), ("s.swift", "Base", "implements"), ("r.rs", "Draw", "implements")}


def test_watch_helpers(spark, tmp_path):
    now = [0.0]
    seen = watch.Cached(lambda: now[0], 30, lambda: now[0])
    assert seen.get() == 0
    now[0] = 20
    assert seen.get() == 0
    now[0] = 31
    assert seen.get() == 31
    assert watch.wait_for_lock(lambda: True, 0.0) is False and watch.wait_for_lock(lambda: False) is True
    where = str(tmp_path / "t")
    watch.check_version(spark, where)
    watch.check_version(spark, where)
    spark.createDataFrame([(99,)], "version int").write.mode("overwrite").parquet(where + "_version")
    with pytest.raises(RuntimeError):
        watch.check_version(spark, where)


def test_debounce_on_a_stream_equals_batch(spark, tmp_path):
    rows = [(1, "2024-01-01 00:00:00"), (1, "2024-01-01 00:00:01"), (1, "2024-01-01 00:00:09"), (2, "2024-01-01 00:00:00"), (1, "2024-01-02 00:00:00"), (2, "2024-01-02 00:00:00")]
    df = spark.createDataFrame(rows, "k int, t string").selectExpr("k", "cast(t as timestamp) as ts")
    for i in range(len(rows)):
        df.limit(i + 1).subtract(df.limit(i)).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(df.schema).parquet(str(tmp_path / "in"))
    q = debounce.debounced(stream, "k", late="1 hour").writeStream.outputMode("append").format("memory").queryName("bursts").trigger(availableNow=True).start()
    q.awaitTermination(60)
    batch = {tuple(r) for r in debounce.debounced(df, "k").collect()}
    done = {tuple(r) for r in spark.table("bursts").collect()}
    assert done <= batch and {(r[0], r[3]) for r in done} == {(1, 2), (1, 1), (2, 1)}


def test_trace_and_diff():
    t = 'File "src/x.py", line 42, in run\n  at go (web/a.ts:10:5)\nlib/b.rs:7 oops'
    assert analysis.parse_trace(t) == [("src/x.py", 42, "run"), ("web/a.ts", 10, "go"), ("lib/b.rs", 7, None)]
    d = analysis.parse_diff("--- a/x.py\n+++ b/x.py\n@@ -1,2 +1,2 @@\n-def f(a):\n+def f(a, b):\n     pass\n--- a/y.py\n+++ /dev/null\n@@ -1 +0,0 @@\n-z\n")
    assert [(f.path, f.hunks, f.removed, f.added) for f in d] == [("x.py", [(1, 2)], ["def f(a):"], ["def f(a, b):"]), ("y.py", [(1, 1)], ["z"], [])]
    assert analysis.arity("def f(a, b):") == 2


@pytest.mark.parametrize(("pattern", "path", "hit"), [("build/", "a/build/x.o", True), ("build/", "build", False), ("*.egg-info/", "pkg.egg-info", False), ("*.pyc", "a/b.pyc", True), ("docs/*.md", "docs/a/b.md", True), ("*/build/", "x/build/y", True), ("*/build/", "x/y/build/z", False)])
def test_ignore_patterns(pattern, path, hit):
    assert analysis.ignored(pattern, path) is hit


def test_stream_equals_batch(spark, tmp_path):
    src, out = tmp_path / "in", tmp_path / "out"
    schema = "path string, content string, mtime double"
    rows = [("a/x.py", "one", 1.0), ("a/x.py", "two", 2.0), ("node_modules/y.py", "no", 1.0), ("b.ts", "three", 1.0), ("gone.md", "m", 1.0), ("gone.md", None, 3.0), ("k.pem", "s", 1.0)]
    for i, r in enumerate(rows):
        spark.createDataFrame([r], schema).coalesce(1).write.mode("append").json(str(src))
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 2).json(str(src))
    watch.start_watch(stream, str(out), str(tmp_path / "ck"), once=True).awaitTermination(60)
    assert sorted((r.path, r.content) for r in watch.current(spark, str(out)).collect()) == [("a/x.py", "two"), ("b.ts", "three")]


def test_discover(spark, tmp_path):
    for name, data in {"a/x.py": b"print(1)", "a/bin.py": b"\0\1", "node_modules/y.js": b"x", ".env": b"K=1", "z.unknown": b"x", "e.md": b""}.items():
        p = tmp_path / name
        p.parent.mkdir(parents=True, exist_ok=True)
        p.write_bytes(data)
    assert [r.path for r in watch.discover(spark, str(tmp_path)).collect()] == ["a/x.py"]


def test_simple_paths_do_not_plan_hops_again(spark):
    arcs = sorted({(k, (k * m + m) % 23) for k in range(23) for m in (3, 5, 7, 11)})
    edges = spark.createDataFrame([(a, b, "x", "calls") for a, b in arcs if a != b], "src_chunk long, dst_chunk long, dst_name string, kind string")
    start, end = (spark.createDataFrame([(x,)], "node long") for x in (0, 22))
    got = graph.simple_paths(edges, start, end, hops=4, limit=1000)
    paths, want = [[0]], []
    for _ in range(4):
        paths = [[*p, b] for p in paths for a, b in arcs if a == p[-1] and b not in p]
        want += sorted(p for p in paths if p[-1] == 22)
        paths = [p for p in paths if p[-1] != 22]
    assert [r.path for r in got.collect()] == want and len(want) > 3
    assert str(got._jdf.queryExecution().optimizedPlan()).count("Join") == 0  # each hop reads the written rows of the one before
