"""Planner loop, replies, keys and the path probe's tries against small cases."""

from __future__ import annotations

import json

from pyspark.sql import functions as F

from lakeside.operators import analysis, planner


def run_plan(replies, gains, room=lambda: True, left=lambda: 60.0, own=("a b", "c d", "e f")):
    said, got = iter(replies), iter(gains)
    return planner.plan(list(own), lambda tried, n: next(said), lambda q, files: next(got), room, left)


def test_planner_stops():
    ask = json.dumps({"action": "search", "queries": ["new words", "A  b", "<key>", "x"]})
    r = run_plan([ask, '{"action": "answer"}'], [1, 0, 2, 0])
    assert (r.stopped, r.rounds, r.tried, r.growth, r.malformed) == ("answer", 2, ["a b", "c d", "new words", "e f"], [3, 0], 0)
    again = json.dumps({"action": "search", "query": "other"})
    assert run_plan([again] * 4, [0] * 9).stopped == "no_new_evidence"
    assert run_plan(["prose"], [1, 1]).malformed == 1
    assert run_plan([], [1, 1], room=lambda: False).stopped == "pack_full"
    assert run_plan([], [], left=lambda: 1.0).stopped == "deadline"
    many = [json.dumps({"action": "search", "queries": [f"q{i}xx"]}) for i in range(4)]
    assert run_plan(many, [1] * 9).stopped == "round_cap"

    def failing(tried, n):
        raise OSError("gone")

    assert planner.plan([], failing, lambda q, f: 1, lambda: True, lambda: 9.0).stopped == "planner_error"
    calls = []

    def once(tried, n):
        calls.append(n)
        if len(calls) == 1:
            raise OSError("cold")
        return '{"action": "answer"}'

    assert planner.plan([], once, lambda q, f: 1, lambda: True, lambda: 9.0).stopped == "answer" and calls == [1, 1]
    calls.clear()
    assert planner.plan([], once, lambda q, f: 1, lambda: True, lambda: 4.0).stopped == "planner_error"


def test_decisions():
    assert planner.decision('```json\n{"action": "Search", "queries": ["a", 3, " ", "b"], "query": "c"}\n```') == (["a", "b", "c"], False)
    assert planner.decision('{"action": "search"}') == ([], False)
    assert planner.decision("{broken") == ([], True) and planner.decision('{"action": "run"}') == ([], True) and planner.decision("[1]") == ([], True)


def test_answer_degrades():
    def failing(pack):
        raise ValueError("bad reply")

    assert planner.answer([{"id": "E01"}])["degraded"] and planner.answer([], failing)["limitations"] == ["the model failed: bad reply"]
    assert planner.answer([], lambda pack: {"answer": "yes"}) == {"answer": "yes", "evidence": [], "degraded": False}


def test_replies(spark):
    ok = {"english_terms": ["h2 headers", "Headers", "headers", "a", "bad!"], "filename_terms": ["h2 headers", "page_map"]}
    rows = [(0, "note " + json.dumps(ok), "h2 headers"), (1, json.dumps(ok)[:-1], "x"), (2, json.dumps(ok), "GA4 x"), (3, None, "x"), (4, "", None), (5, '{"english_terms": []}', "x"), (6, '{"english_terms": "one"}', "x"), (7, "x" * 9000, "x"), (8, '{" english_terms " : ["\x1b[1mbold\x1b[0m"]', "x"), (9, '{"english_terms": [1, "two", null]}', "x")]
    got = {r.id: (r.terms, r.names) for r in planner.checked_replies(spark.createDataFrame(rows, "id int, raw string, query string")).collect()}
    whole, none = (["h2 headers", "Headers"], ["page_map"]), (None, None)
    assert got == {0: whole, 1: whole, 2: none, 3: none, 4: none, 5: none, 6: none, 7: none, 8: (["bold"], []), 9: (["two"], [])}


def test_empty_queries(spark):
    q = spark.createDataFrame([(0, "", None, None), (1, None, None, None), (2, "reports", ["Site Maps"], ["log"])], "id int, query string, terms array<string>, guessed array<string>")
    got = {r.id: r.atoms for r in planner.probe_atoms(q).collect()}
    assert got[0] == [] and got[1] is None
    assert [(a.atom, a.weak, a.championless) for a in got[2]][:6] == [("site", False, False), ("maps", False, False), ("map", False, False), ("reports", False, False), ("report", False, False), ("log", True, True)]
    v = {r.id: r.variants for r in planner.variants(q.select("id", F.col("query").alias("question"))).collect()}
    assert v[0] == [] and v[2] == []


def test_path_probe_tries(spark):
    # 20 files named site, of which only number 3 speaks of mesh; one file named lone; nothing of either in other names
    post = [(i, "path", "site", 1) for i in range(20)] + [(3, "folded", "mesh", 1), (50, "path", "lone", 1)] + [(i, "folded", "data", 1) for i in range(60, 90)]
    p = spark.createDataFrame(post, "id int, field string, token string, tf int")
    sized = p.groupBy("id").agg(F.sum("tf").alias("len"))
    hits = {(r.atom, r.id) for r in planner.path_probe(p, sized, ["site", "mesh", "lone", "data", "gone"]).collect()}
    assert hits == {("site", 3), ("lone", 50)}
    bare = planner.path_probe(p.filter("token <> 'mesh'"), sized, ["site", "mesh", "lone"]).collect()
    assert {(r.atom, r.id) for r in bare} == {("lone", 50)}
    assert planner.path_probe(p, sized, ["site"]).count() == 0 and planner.path_probe(p.limit(0), sized, ["site"]).count() == 0


def test_repositories(spark, tmp_path):
    main, tree = tmp_path / "main", tmp_path / "tree"
    (main / ".git" / "worktrees" / "tree").mkdir(parents=True)
    tree.mkdir()
    (tree / ".git").write_text(f"gitdir: {main}/.git/worktrees/tree\n")
    (main / ".git" / "worktrees" / "tree" / "commondir").write_text("../..\n")
    rows = [(str(p), planner.common_folder(str(p))) for p in (main, tree, tmp_path)]
    got = [r.c for r in spark.createDataFrame(rows, "root string, common string").select(planner.main_checkout(F.col("root"), F.col("common")).alias("c")).collect()]
    assert got == [str(main), str(main), str(tmp_path)]


def test_signatures(spark, tmp_path):
    v = spark.createDataFrame([(3,), (9,)], "vec_id long")
    assert planner.signature(v).first()[0] == "legacy:2:9" and planner.signature(v.limit(0)).first()[0] == "legacy:0:0"
    where = str(tmp_path / "epoch")
    first = planner.bump_epoch(spark, where)
    assert planner.signature(v, spark.read.parquet(where)).first()[0] == first
    assert planner.bump_epoch(spark, where) != first
    assert planner.signature(v, spark.createDataFrame([], "epoch string")).first()[0] == "legacy:2:9"


def test_runtime_reports_are_left_out():
    text = "Fatal error: file App/Main.swift, line 12"
    assert analysis.parse_trace(text) == [("App/Main.swift", 12, None)] and analysis.parse_trace(text, False) == []
