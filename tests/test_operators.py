"""Operators on small inputs whose results are known."""

import datetime as dt

import pandas as pd
import pytest
from pyspark.sql import functions as F

from heddle.functions import predicates as P
from heddle.functions import text as T
from heddle.operators import chunks, evaluation, graph, incremental, lexical, rank, resolve, vector
from heddle.sources import tables
from heddle.streaming import watch


def one(spark, column):
    return spark.range(1).select(column).first()[0]


def rows(df):
    return sorted(tuple(r) for r in df.collect())


def test_tokens(spark):
    assert one(spark, T.tokens(F.lit("foo_bar.Baz 1x a Größe"))) == ["foo", "bar", "baz", "gr"]


@pytest.mark.parametrize("raw,text,outcome", [("how is the cache of tokens filled?", "cache tokens filled", "applied"), ("short one", "short one", "skip-short"), ("where is foo.bar called from", "where is foo.bar called from", "skip-symbol-like"), ("what is the of", "what is the of", "skip-overstrip")])
def test_rewritten_query(spark, raw, text, outcome):
    r = one(spark, T.rewritten_query(F.lit(raw)))
    assert (r["text"], r["outcome"]) == (text, outcome)


@pytest.mark.parametrize("word,root", [("indexing", "index"), ("chatted", "chat"), ("files", "fil"), ("abc", None), ("process", "proces")])
def test_stem(spark, word, root):
    assert one(spark, T.stem(F.lit(word))) == root


def test_module_keywords(spark):
    assert one(spark, T.module_keywords(F.lit("How does the indexing of chats work"))) == ["indexing", "index", "chats", "chat"]


@pytest.mark.parametrize("cand,caller,d", [("a.b.c", "a.b.d", 0), ("a.b.c", "a.x", 1), ("x.y", "a.b.c", 3)])
def test_import_distance(spark, cand, caller, d):
    assert one(spark, T.import_distance(F.lit(cand), F.lit(caller))) == d


def test_permutation(spark):
    assert one(spark, T.permutation(F.lit("[3] > [1] > [3] > [9]"), F.lit(4))) == [3, 1, 2, 4]


def test_uncommented_json(spark):
    assert one(spark, T.uncommented_json(F.lit('{"a": "//x", // note\n"b": /* c */ 1}'))).replace("\n", "") == '{"a": "//x", "b":  1}'


def test_capped_snippet_and_requirement(spark):
    assert one(spark, T.capped_snippet(F.lit("ab\ncd\nef"), 7)) == "ab\ncd"
    assert one(spark, T.requirement_name(F.lit("Foo-Bar[x]>=1.2; python_version>'3'"))) == "Foo-Bar"


def test_skip_path(spark):
    df = spark.createDataFrame([("node_modules/a.js",), ("src/.env",), ("src/.env.example",), ("vendor/mylib/x.py",), ("vendor/o.py",), ("src/a.pyc",), ("src/a.py",)], "p string")
    got = {r[0]: r[1] for r in df.select("p", P.skip_path(F.col("p"), exclude=(".env", ".env.*"), unignore=(".env.example", "vendor/mylib"))).collect()}
    assert got == {"node_modules/a.js": True, "src/.env": True, "src/.env.example": False, "vendor/mylib/x.py": False, "vendor/o.py": True, "src/a.pyc": True, "src/a.py": False}


@pytest.mark.parametrize("q,ok", [("SELECT 1", True), ("select 'drop it'", True), ("DROP TABLE x", False), ("SELECT 1; /* a */ delete from t", False)])
def test_read_only(q, ok):
    assert P.is_read_only(q) is ok


def test_neighbours_and_zero_vectors(spark):
    df = spark.createDataFrame([("seed", [1.0, 0.0]), ("near1", [0.9, 0.1]), ("near2", [0.5, 0.5]), ("far", [0.0, 1.0]), ("zero", [0.0, 0.0])], "vec_id string, embedding array<float>")
    assert [r["vec_id"] for r in vector.neighbours(df, "seed", 2).collect()] == ["near1", "near2"]
    assert vector.neighbours(df, "unknown", 2).count() == 0
    assert vector.neighbours(df, "zero", 2).count() == 0
    assert one(spark, vector.l2_normalised(F.array(F.lit(0.0), F.lit(0.0)))) == [0.0, 0.0]


def test_mean_vectors(spark):
    df = spark.createDataFrame([(1, [1.0, 2.0]), (1, [3.0, 4.0])], "k int, embedding array<double>")
    assert vector.mean_vectors(df, ["k"]).first()["centroid"] == [2.0, 3.0]


def test_rare_term_beats_common_one(spark):
    df = spark.createDataFrame([(i, "common words here") for i in range(9)] + [(9, "common rare here")], "doc_id int, text string")
    best = lexical.top_documents(lexical.bm25(df, ["common", "rare"]), 3).orderBy("rank").first()
    assert best["doc_id"] == 9


def test_hub_ranks_first(spark):
    e = spark.createDataFrame([(f"c{i}", "hub") for i in range(5)], "src string, dst string")
    nodes = spark.createDataFrame([(x,) for x in ["hub", "o1", *[f"c{i}" for i in range(5)]]], "qualified_name string")
    r = {x["qualified_name"]: x["pagerank"] for x in graph.by_range(graph.pagerank(e, nodes=nodes)).collect()}
    assert max(r, key=r.get) == "hub" and r["hub"] == 1.0 and min(r.values()) == 0.0
    assert graph.pagerank(e.limit(0)).count() == 0


def test_caller_hop(spark):
    e = spark.createDataFrame([("mount", "make"), ("mount", "guard"), ("a.tests.t", "make")], "src string, dst string")
    got = dict(rows(graph.breadth_first(e, spark.createDataFrame([("make",)], "qualified_name string"), 2, caller_cap=3)))
    assert got == {"make": 0, "mount": 1, "guard": 1}


def test_budget(spark):
    names = [("b", "seed", 0, 1.0, 400)] + [("b", f"neighbour{i:03d}", 1, 0.5, 0) for i in range(200)]
    df = spark.createDataFrame(names, "bundle string, qualified_name string, depth int, score double, snippet_length int")
    got = graph.budgeted(df, 100 + 20, "bundle").where("kept")
    assert 1 < got.count() < 201 and got.agg(F.sum("cost")).first()[0] <= 120


def test_round_robin_and_quota(spark):
    df = spark.createDataFrame([("a", i) for i in range(9)] + [("b", 100)], "m string, k int")
    got = rank.round_robin(df, "m", "m", "k", 4).collect()
    assert [(r["m"], r["k"]) for r in got] == [("a", 0), ("b", 100), ("a", 1), ("a", 2)]


def test_upsert_and_edges(spark):
    old = spark.createDataFrame([("a", 1, 0), ("b", 1, 0)], "k string, v int, seq int")
    new = spark.createDataFrame([("b", 2, 1), ("b", 3, 2), (None, 9, 1)], "k string, v int, seq int")
    assert rows(tables.upserted(old, new, ["k"], [F.desc("seq")]).select("k", "v")) == [("a", 1), ("b", 3)]


def test_conform(spark):
    got = tables.conform(spark.createDataFrame([("Function", "a.b")], "label string, qualified_name string"), tables.NODE_SCHEMA, tables.NODE_DEFAULTS).first()
    assert got["is_async"] is False and got["contextual_prefix"] == "" and got["path"] is None


@pytest.mark.parametrize("url,slug", [("https://github.com/Org/repo.git", "Org__repo"), ("git@github.com:o/r", "o__r"), ("https://example.com/o/r", "x"), ("", "x")])
def test_remote_slug(spark, url, slug):
    assert one(spark, tables.remote_slug(F.lit(url), F.lit("x"))) == slug


def test_source_files(spark, tmp_path):
    (tmp_path / "d").mkdir()
    (tmp_path / "d/a.py").write_text("x = 1\n")
    got = tables.source_files(spark, str(tmp_path)).select("path", "size").collect()
    assert [tuple(r) for r in got] == [("d/a.py", 6)]


def test_graph_round_trip(spark, tmp_path):
    n = spark.createDataFrame([("a", "File")], "node_id string, label string")
    e = spark.createDataFrame([("a", "a", "IMPORTS")], "from_id string, to_id string, type string")
    tables.exported(n, e, str(tmp_path / "g"))
    back_n, back_e = tables.loaded_export(spark, str(tmp_path / "g"))
    doc = tmp_path / "g.json"
    doc.write_text('{"nodes": [{"node_id": 1, "labels": ["File"]}], "relationships": [{"from_id": 1, "to_id": 1, "type": "IMPORTS"}], "metadata": {}}')
    assert [x.count() for x in tables.loaded_graph(spark, str(doc))] == [1, 1]
    assert rows(back_n.select("node_id", "label")) == rows(n) and back_e.count() == 1


def test_heading_chunks_body(spark):
    df = spark.createDataFrame([("p", "a\n# T\nb\n# T\nc")], "path string, content string")
    assert rows(chunks.heading_chunks(df, "path", "content").select("slug", "body")) == [("preamble", "a"), ("t", "# T\nb"), ("t-2", "# T\nc")]


def test_extended_start(spark):
    text = "x\n\n# c\n@d\ndef f():"
    assert one(spark, chunks.extended_start(F.lit(text), F.lit(5))) == 3
    assert one(spark, chunks.source_range(F.lit(text), F.lit(3), F.lit(4))) == "# c\n@d"


SYMBOLS = [("p.a.f", "f", "p.a", None), ("p.a.C.m", "m", "p.a", "p.a.C"), ("p.b.f", "f", "p.b", None), ("p.b.g", "g", "p.b", None), ("p.b.D.m", "m", "p.b", "p.b.D"), ("p.c.sub.h", "h", "p.c.sub", None), ("q.x.far", "far", "q.x", None), ("p.a.far", "far", "p.a", None)]
CALLS = [("p.a.main", "p.a", None, "f", 1, 0), ("p.a.C.run", "p.a", "p.a.C", "self.m", 2, 4), ("p.a.main", "p.a", None, "g", 3, 0), ("p.a.main", "p.a", None, "hh", 4, 0), ("p.a.main", "p.a", None, "mod.g", 5, 0), ("p.c.main", "p.c", None, "far", 6, 0), ("p.a.main", "p.a", None, "print", 7, 0), ("p.a.main", "p.a", None, "nothing", 8, 0), ("p.b.D.m", "p.b", "p.b.D", "super().m", 9, 8), ("p.c.main", "p.c", None, "w", 10, 0)]
IMPORTS = [("p.a", "hh", "p.pkg.h"), ("p.a", "mod", "p.b"), ("p.a", "*", "p.b"), ("p.c", "w", "p.pkg.g")]
EXPORTS = [("p.pkg", "h", "p.mid.h"), ("p.mid", "h", "p.c.sub.h"), ("p.pkg", "*", "p.b"), ("p.loop", "x", "p.loop2.x"), ("p.loop2", "x", "p.loop.x")]
REBINDS = [("p.a.C.m", "p.b.g", 1), ("p.a.C.m", "p.b.f", 2)]
PARENTS = [("p.b.D", "p.a.C", 0), ("p.b.E", "p.b.D", 0), ("p.b.E", "p.a.C", 1)]
RESOLVED = [("f", "p.b.f", "wildcard", 0.5), ("self.m", "p.b.f", "rebound", 1.0), ("g", "p.b.g", "wildcard", 0.5), ("hh", "p.c.sub.h", "exact", 1.0), ("mod.g", "p.b.g", "exact", 1.0), ("far", "p.a.far", "heuristic", 0.6), ("print", "builtins.print", "exact", 1.0), ("nothing", None, None, None), ("super().m", "p.b.f", "rebound", 1.0), ("w", "p.b.g", "wildcard", 0.5)]


def test_resolution(spark):
    t = lambda xs, schema: spark.createDataFrame(xs, schema)
    out = resolve.resolved(
        t(CALLS, "caller string, module string, class string, call_name string, line int, col int"),
        t(SYMBOLS, "qualified_name string, name string, module string, class string"),
        t(IMPORTS, "module string, alias string, target string"),
        t(EXPORTS, "module string, symbol string, target string"),
        t(REBINDS, "original string, target string, seq int"),
        builtins=t([("print",)], "name string"),
        parents=t(PARENTS, "class string, parent string, position int"),
    ).select("call_name", "callee", "resolved_via", "confidence")
    assert rows(out.fillna("", ["callee", "resolved_via"]).fillna(0.0)) == sorted((a, b or "", c or "", d or 0.0) for a, b, c, d in RESOLVED)


def test_rewire(spark):
    e = spark.createDataFrame([("a", "x"), ("b", "x")], "src string, dst string")
    assert rows(resolve.rewired(e, spark.createDataFrame([("x", "r::x")], "old string, new string"))) == [("a", "r::x"), ("b", "r::x")]


def test_expiry_and_admission(spark):
    jobs = spark.createDataFrame([(1, "running", 100.0, 90.0, 7, "r"), (2, "running", 100.0, 90.0, 8, "s"), (3, "done", 0.0, 0.0, 9, "t")], "job_id int, status string, updated_at double, started_at double, pid int, repo_slug string")
    live = spark.createDataFrame([(7,)], "pid int")
    assert rows(incremental.expired(jobs, F.lit(110.0), live, 60, 600).select("job_id")) == [(2,)]
    asked = spark.createDataFrame([("r",), ("t",)], "repo_slug string")
    assert rows(incremental.admitted(asked, jobs)) == [("t",)]


def test_renamed_slugs(spark):
    have = spark.createDataFrame([("n2",)], "repo string")
    names = spark.createDataFrame([("a", "a"), ("b", "n2"), ("c", "n3"), ("d", "n4"), ("e", "n4")], "old string, new string")
    assert dict((r["old"], r["verdict"]) for r in incremental.renamed_slugs(have, names).collect()) == {"a": "canonical", "b": "taken", "c": "rename", "d": "clash", "e": "clash"}


def test_facets_at_threshold(spark):
    df = spark.createDataFrame([(1, "alpha beta")], "id int, text string")
    r = evaluation.facet_coverage(df, "id", F.col("text"), {"a": ["alpha"], "b": ["beta"], "c": ["zzz"]}, least=2 / 3).first()
    assert r["passed"] and abs(r["coverage"] - 2 / 3) < 1e-9


def test_span_coverage(spark):
    spans = spark.createDataFrame([("t", "f", 1, 10), ("t", "g", 5, 6)], "task string, file_path string, start_line int, end_line int")
    hits = spark.createDataFrame([("t", "f", 10, 20), ("t", "g", 7, 9)], "task string, file_path string, start_line int, end_line int")
    assert evaluation.span_coverage(hits, spans, "task").first()["coverage"] == 0.5


def test_debounce_gap(spark):
    t0 = dt.datetime(2024, 1, 1)
    ev = [("r", t0 + dt.timedelta(milliseconds=m), p) for m, p in [(0, "a"), (1499, "b"), (3000, "c"), (3001, "c")]]
    got = watch.debounced(spark.createDataFrame(ev, "repo string, ts timestamp, path string"), ["repo"])
    assert sorted(r["paths"] for r in got.collect()) == [["a", "b"], ["c"]]


def test_debounce_stream(spark, tmp_path):
    t0 = dt.datetime(2024, 1, 1)
    pd.DataFrame({"repo": ["r"] * 4, "ts": [t0, t0 + dt.timedelta(seconds=1), t0 + dt.timedelta(seconds=60), t0 + dt.timedelta(seconds=600)], "path": ["a.py", "b.py", "c.py", "d.py"]}).to_parquet(tmp_path / "e.parquet", coerce_timestamps="us")
    stream = spark.readStream.schema("repo string, ts timestamp, path string").parquet(str(tmp_path))
    seen = []
    q = watch.index_changes(watch.debounced(watch.relevant(stream, (".py",)), ["repo"]), lambda df, _: seen.extend(r["paths"] for r in df.collect()), str(tmp_path / "_cp"))
    q.processAllAvailable()
    q.stop()
    assert sorted(seen)[:2] == [["a.py", "b.py"], ["c.py"]]


def test_job_states_are_final(spark):
    ev = spark.createDataFrame([(1, "running", 1, 1), (1, "done", 2, 2), (1, "running", 3, 3), (2, "queued", 1, 1)], "job long, status string, ts int, seq int")
    assert {r["job"]: r["state"] for r in incremental.job_states(ev, "job", "status", "ts", "seq").collect()} == {1: "done", 2: "queued"}


def test_nearest_module_and_snippet(spark):
    nodes = spark.createDataFrame([("m.a", "Module", "a.py", None, None), ("m.a.C", "Class", "a.py", 1, 9), ("m.a.C.f", "Method", "a.py", 2, 3), ("x", "Method", None, None, None)], "qualified_name string, label string, path string, start_line long, end_line long")
    edges = spark.createDataFrame([("m.a", "m.a.C"), ("m.a.C", "m.a.C.f")], "src string, dst string")
    assert graph.nearest_module("m.a.C.f", edges, nodes).first()["qualified_name"] == "m.a"
    texts = spark.createDataFrame([("a.py", "l1\nl2\nl3\nl4")], "path string, text string")
    got = {n: tuple(graph.snippet(n, nodes, texts).first())[1:] for n in ("m.a.C.f", "x", "nope")}
    assert got == {"m.a.C.f": (True, None, "l2\nl3"), "x": (False, "no location", None), "nope": (False, "unknown symbol", None)}


def test_costs_stop_at_the_cap(spark):
    df = spark.createDataFrame([("r", i, 1_000_000, 0) for i in range(3)], "repo string, at int, input_tokens long, output_tokens long")
    assert [r["within"] for r in incremental.costs(df, "repo", "at", 1.0, 5.0, 2.0).orderBy("at").collect()] == [True, True, False]
