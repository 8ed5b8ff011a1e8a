"""Operators against plain versions, beyond the sizes at which they once stopped."""

import itertools
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from heddle.functions import docstrings
from heddle.operators import evaluation, graph, incremental, lexical, nearest, resolve, vector
from heddle.plans import search
from heddle.sources import manifests, other_sources, python_source, tables
from heddle.streaming import watch


def plain_budget(rows, budget):
    """rows: (name, depth, score, length).  Names kept."""
    cost = {n: (length + len(n)) // 4 + 1 for n, _, _, length in rows}
    depth = {n: d for n, d, *_ in rows}
    score = {n: s for n, _, s, _ in rows}
    kept = set(cost)
    deepest = max(depth.values())
    total = lambda: sum(cost[n] for n in kept)
    while total() > budget and deepest > 0:
        kept -= {n for n in kept if depth[n] == deepest}
        deepest -= 1
    for n in sorted((n for n in kept if depth[n] == 0), key=lambda n: (-len(n), n)):
        if total() <= budget:
            break
        kept.discard(n)
    room = budget - total()
    for n in sorted(set(cost) - kept, key=lambda n: (depth[n], -score[n], n)):
        if cost[n] <= room:
            kept.add(n)
            room -= cost[n]
    return kept


def test_budget_equals_plain(spark):
    rng, want, rows = random.Random(6), {}, []
    for b in range(40):
        own = [(f"{'x' * rng.randrange(1, 20)}{b}.{i}", rng.randrange(rng.choice((1, 2, 4))), rng.randrange(5) / 4, rng.randrange(0, rng.choice((5, 60, 400)))) for i in range(rng.randrange(1, 40))]
        rows += [(b, *r) for r in own]
        want[b] = plain_budget(own, 150)
    df = spark.createDataFrame(rows, "bundle int, qualified_name string, depth int, score double, snippet_length int")
    got = {b: set() for b in want}
    for r in graph.budgeted(df, 150, "bundle").where("kept").collect():
        got[r["bundle"]].add(r["qualified_name"])
    assert got == want


def test_percentiles_equal_numpy(spark):
    rng = np.random.default_rng(3)
    groups = {"a": rng.normal(size=2000), "b": np.repeat(5.0, 70), "c": np.array([1.0]), "d": np.round(rng.random(999), 2), "e": np.array([1e300, -1e300, 0.0, 1e-300]), "f": rng.integers(0, 3, 500).astype(float)}
    rows = [(g, float(x)) for g, xs in groups.items() for x in xs] + [("a", None), ("z", None)]
    df = spark.createDataFrame(rows, "g string, x double").repartition(5)
    got = {r["g"]: r for r in evaluation.percentiles(df, "g", "x", (0.0, 0.5, 0.95, 1.0)).collect()}
    for g, xs in groups.items():
        assert [got[g][c] for c in ("p0", "p50", "p95", "p100")] == pytest.approx(np.percentile(xs, [0, 50, 95, 100]).tolist()), g
    assert got["z"]["p50"] is None


def test_nearest_equals_all_pairs(spark):
    rng = random.Random(2)
    part = lambda: rng.choice("pqrs")
    names = sorted({".".join([*[part() for _ in range(rng.randrange(1, 5))], n]) for n in ("f", "g", "p") for _ in range(60)})
    modules = sorted({".".join(part() for _ in range(rng.randrange(1, 5))) for _ in range(40)})

    def distance(c, m):
        a, b = c.split("."), m.split(".")
        same = next((i for i, (x, y) in enumerate(zip(a, b, strict=False)) if x != y), min(len(a), len(b)))
        base = max(len(a), len(b)) - same
        return base - 1 if "." in m and c.startswith(m.rsplit(".", 1)[0] + ".") else base

    symbols = spark.createDataFrame([(n, n.rsplit(".", 1)[-1]) for n in names], "qualified_name string, name string")
    wanted = spark.createDataFrame(list(itertools.product(("f", "g", "p", "none"), modules)), "name string, module string")
    got = {(r["name"], r["module"]): r["callee"] for r in resolve.nearest(wanted, symbols).collect()}
    for n, m in itertools.product(("f", "g", "p", "none"), modules):
        own = [c for c in names if c.rsplit(".", 1)[-1] == n]
        assert got.get((n, m)) == (min(own, key=lambda c: (distance(c, m), c)) if own else None), (n, m)  # noqa: B023


def test_deep_inheritance_and_many_parents(spark):
    chain = [(f"c{i}", f"c{i + 1}", 0) for i in range(40)]
    wide = [("w", f"p{i}", i) for i in (5, 9, 10, 12_345)]
    parents = spark.createDataFrame(chain + wide, "class string, parent string, position int")
    methods = spark.createDataFrame([("c40", "m"), ("c0", "m"), ("w", "n"), ("p12345", "n"), ("p10", "n")], "class string, method string")
    assert sorted(map(tuple, resolve.overrides(parents, methods).collect())) == [("c0", "m", "c40"), ("w", "n", "p10")]


def test_deletes_reach_any_depth(spark):
    e = spark.createDataFrame([("CONTAINS", f"d{i}", f"d{i + 1}") for i in range(70)] + [("DEFINES", "d70", "f")], "rel string, src string, dst string")
    n = spark.createDataFrame([(f"d{i}",) for i in range(71)] + [("f",), ("other",)], "qualified_name string")
    assert [r[0] for r in graph.without_project(n, e, "d0", ["CONTAINS"], ["DEFINES"]).collect()] == ["other"]


def test_pagerank_of_a_hub_is_the_same_dealt_out(spark, monkeypatch):
    rng = random.Random(5)
    e = spark.createDataFrame([("hub", f"n{i}") for i in range(50)] + [(f"n{rng.randrange(50)}", f"n{rng.randrange(50)}") for _ in range(120)] + [("n1", "hub")], "src string, dst string")
    plain = {r[0]: r[1] for r in graph.pagerank(e, iterations=7, tolerance=0).collect()}
    monkeypatch.setattr(graph, "HUB", 6)
    spread = {r[0]: r[1] for r in graph.pagerank(e, iterations=7, tolerance=0).collect()}
    assert spread.keys() == plain.keys() and all(abs(spread[k] - plain[k]) < 1e-12 for k in plain) and abs(sum(plain.values()) - 1) < 1e-9


def test_refused_statements_are_never_run(spark):
    spark.range(3).createOrReplaceTempView("three")
    for q in ("CACHE TABLE three", "SELECT * FROM three WHERE reflect('java.lang.System', 'nanoTime') > 0", "SELECT (SELECT java_method('java.lang.System', 'exit', '1'))", "SHOW TABLES", "EXPLAIN SELECT 1", "USE default"):
        with pytest.raises(PermissionError):
            search.guarded_sql(spark, q)
    page, more = search.guarded_sql(spark, "SELECT id FROM three WHERE id IN (SELECT max(id) FROM three) OR 'DROP' = 'x'")
    assert [r[0] for r in page.collect()] == [2] and not more
    page, more = search.guarded_sql(spark, "WITH t AS (SELECT id, row_number() OVER (ORDER BY id DESC) AS n FROM three) SELECT n FROM t JOIN three USING (id)", 1, 1)
    assert [r[0] for r in page.collect()] == [2] and more


def test_generated_queries(spark):
    assert search.generated_query(spark, "q", lambda _: "```sql SELECT 1```") == "SELECT 1;"
    with pytest.raises(PermissionError):
        search.generated_query(spark, "q", lambda _: "CREATE TABLE t AS SELECT 1")


def test_rerank_keeps_what_the_model_does_not_say():
    rows = [{"qualified_name": f"n{i}"} for i in range(6)]
    order = lambda ask, **k: [r["qualified_name"] for r in search.reranked("q", {"n0": "x" * 900}, ask, **k)(rows)]
    seen = []
    assert order(lambda p: seen.append(p) or "[3] > [3] > [9] > [1]", most=4) == ["n2", "n0", "n1", "n3", "n4", "n5"]
    assert "x" * 800 in seen[0] and "x" * 801 not in seen[0] and "n4" not in seen[0]
    plain = [f"n{i}" for i in range(6)]
    assert order(lambda _: "none") == plain and order(lambda _: 1 / 0) == plain
    import time

    assert order(lambda _: time.sleep(1) or "[2]", deadline_s=0.05) == plain


def test_semantic_search_reranks_a_bounded_head(spark):
    e = spark.createDataFrame([(f"m.s{i}", [1.0, i / 100]) for i in range(80)], "qualified_name string, embedding array<double>")
    empty = spark.createDataFrame([], "qualified_name string, pagerank double")
    store = search.Store(e, empty, spark.createDataFrame([("m.s5", "word")], "qualified_name string, content string"), None, None)
    got = search.semantic(store, [1.0, 0.0], ["word"], 3, rerank=lambda rows: [rows[i] for i in (7, 0)] + [r for i, r in enumerate(rows) if i not in (0, 7)])
    names = [r["qualified_name"] for r in search.semantic(store, [1.0, 0.0], ["word"], 9).collect()]
    assert names[0] == "m.s5" and [r["qualified_name"] for r in got.collect()][:2] == [names[7], names[0]]


def test_embedding_batches_are_tried_again(spark):
    df = spark.createDataFrame([(i, "x" * i) for i in range(6)], "k int, t string").coalesce(1)

    def flaky(texts):
        flaky.n = getattr(flaky, "n", 0) + 1
        if flaky.n == 1:
            raise TimeoutError("busy")
        return [[len(t), 1.0] for t in texts]

    got = vector.embedded(df, "t", flaky, 2, wait=lambda _: 0.0).collect()
    assert [list(r["embedding"]) for r in got] == [[float(i), 1.0] for i in range(6)] and not any(r["error"] for r in got)
    short = vector.embedded(df, "t", lambda texts: [[1.0, 2.0]], 2).collect()
    assert all(r["embedding"] is None and r["error"] for r in short)


def test_transient_errors_are_retried_with_jitter():
    slept, tries = [], []

    def call():
        tries.append(1)
        if len(tries) < 4:
            raise TimeoutError
        return "ok"

    assert incremental.retried(call, (TimeoutError,), sleep=slept.append) == "ok"
    assert len(slept) == 3 and all(0 <= s <= c for s, c in zip(slept, (1, 2, 4), strict=True))
    with pytest.raises(ValueError):
        incremental.retried(lambda: int("x"), (TimeoutError,), sleep=slept.append)
    with pytest.raises(TimeoutError):
        incremental.retried(lambda: (_ for _ in ()).throw(TimeoutError()), (TimeoutError,), sleep=slept.append)


def test_job_states_of_a_stream_equal_those_of_a_batch(spark, tmp_path):
    rng = random.Random(8)
    events = [(rng.randrange(6), rng.choice(["queued", "running", "running", "done", "failed"]), 1_700_000_000 + i // 3, i) for i in range(120)]
    schema = "job_id long, status string, at long, seq long"
    for n in range(3):  # within a file, events are in no order
        own = events[n * 40 : n * 40 + 40]
        rng.shuffle(own)
        spark.createDataFrame(own, schema).repartition(2).write.json(str(tmp_path / f"in{n}"))
    stream = spark.readStream.schema(schema).option("recursiveFileLookup", True).json(str(tmp_path)).withColumn("ts", F.timestamp_seconds("at"))
    q = watch.job_state_stream(stream).writeStream.outputMode("update").format("memory").queryName("job_states").option("checkpointLocation", str(tmp_path / "_cp")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    got = {}
    for r in spark.table("job_states").collect():
        got[r["job_id"]] = r["state"]
    batch = spark.createDataFrame(events, schema).withColumn("ts", F.timestamp_seconds("at"))
    want = {r["job_id"]: r["state"] for r in incremental.job_states(batch, "job_id", "status", "ts", "seq").collect()}
    assert got == want


def test_partial_index_leaves_known_files_alone(spark):
    stored = spark.createDataFrame([("a", "1"), ("b", "2")], "path string, sha string")
    seen = []
    run = watch.partial_index(lambda: stored, lambda df: seen.append(sorted(r["path"] for r in df.collect())))
    files = lambda *xs: spark.createDataFrame([(p, 0, 0, s) for p, s in xs], "path string, mtime_ns long, size long, sha string")
    run(files(("a", "1"), ("b", "3"), ("c", "4")), 0)
    run(files(("a", "1"), ("b", "2")), 1)
    assert seen == [["b", "c"]]


def test_throughput_is_reported_when_it_changes():
    class Event:
        class progress:
            id, name, processedRowsPerSecond = "q", "n", 3.0

    said = []
    listener = watch.throughput_listener(lambda *x: said.append(x))
    listener.onQueryProgress(Event)
    listener.onQueryProgress(Event)
    assert said == [("n", 3.0)]


def test_settled_tables_are_given_back(spark):
    tables.released()
    a, b = tables.settled(spark.range(3)), tables.settled(spark.range(4))
    tables.released(b)
    assert b.count() == 4 and list(tables._settled.values())[0][0] is b
    with pytest.raises(Exception):  # noqa: B017
        a.count()
    tables.dropped(b)
    assert not tables._settled


def test_metadata_has_a_bound(spark):
    df = spark.createDataFrame([("r", str(i), "v") for i in range(5)], "repo string, key string, value string")
    assert len(tables.key_values(df, "repo").first()["metadata"]) == 5
    with pytest.raises(ValueError):
        tables.key_values(df, "repo", most=4)


def test_docstrings_of_underlined_style():
    text = "Do it.\n\nParameters\n----------\nx : int\n    The x,\n    and more.\ny\n    The y.\n\nReturns\n-------\nstr\n    The name."
    assert docstrings.formatted(text) == "Description: Do it.\nArgs:\n  x: int The x, and more.\n  y: The y.\nReturns: The name."
    assert docstrings.formatted(None) == "" and docstrings.formatted("plain") == "Description: plain"


def test_other_languages_ignore_comments_and_strings():
    text = "// class A {}\n/* function b() {} */\nconst s = 'class C {}';\nfunction d() { return `function e() {}`; }\nif (x) { y(); }\n"
    assert [r["name"] for r in other_sources.facts("p", "a.js", text) if r["kind"] in ("Class", "Function", "Method")] == ["d"]
    assert other_sources.facts("p", "a.txt", "class A {}") == []
    assert [r["kind"] for r in other_sources.facts("p", "a.ts", "")] == ["Module"]


def test_types_of_locals():
    text = "from m import T\ndef f(a: 'T', b: Optional[T], c: T | None, d: list):\n    with T() as w:\n        e = T()\n    g: T = 1\n    return T()\n"
    rows = python_source.facts("p", "x.py", text)
    assert {(r["name"], r["target"]) for r in rows if r["kind"] == "type"} == {("a", "T"), ("b", "T"), ("c", "T"), ("d", "list"), ("w", "T"), ("e", "T"), ("g", "T")}
    assert [r["target"] for r in rows if r["kind"] == "returns"] == ["T"]


def test_clusters_of_plain_groups(spark):
    rng = np.random.default_rng(7)
    centers = np.eye(4)[:3]
    rows = [(int(i), (centers[i % 3] + rng.normal(0, 0.02, 4)).tolist()) for i in range(60)] + [(100 + i, (centers[0] + rng.normal(0, 0.02, 4)).tolist()) for i in range(9)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = {r["vec_id"]: r for r in nearest.clusters(df, 3).collect()}
    home = {}
    for i, _ in rows:
        home.setdefault(0 if i >= 100 else i % 3, set()).add(got[i]["cluster"])
    assert sorted(map(tuple, home.values())) == [(0,), (1,), (2,)] and got[100]["cluster"] == 0 and got[100]["size"] == 29
    unit = {i: np.array(v) / np.linalg.norm(v) for i, v in rows}
    mean = np.mean([unit[i] for i in got if got[i]["cluster"] == 0], axis=0)
    assert got[0]["label"] == max((i for i in got if got[i]["cluster"] == 0), key=lambda i: (unit[i] @ mean, -i))
    assert {r["cluster"] for r in nearest.clusters(df, 1).collect()} == {0}


def test_lsh_recall(spark):
    rng = np.random.default_rng(1)
    v = rng.normal(size=(600, 16))
    v /= np.linalg.norm(v, axis=1, keepdims=True)
    df = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)], "vec_id long, embedding array<double>")
    hit = 0
    for q in range(0, 600, 100):
        near = {r["vec_id"] for r in vector.lsh_top_k(df, v[q].tolist(), 10, width=2.0).collect()}
        hit += len(near & set(np.argsort(-(v @ v[q]))[:10].tolist()))
    assert hit / 60 >= 0.9


def test_running_sums_equal_plain(spark):
    rng = random.Random(4)
    rows = [(rng.choice("ab"), float(rng.randrange(40)), i, rng.randrange(9)) for i in range(300)]
    df = spark.createDataFrame(rows, "g string, at double, i int, v int").repartition(4)
    for descending in (False, True):
        order = [F.desc("at") if descending else "at", "i"]
        got = {r["i"]: r["s"] for r in tables.running(df, ["g"], F.col("at"), 7.0, order, F.col("v"), "s", descending).collect()}
        for g in "ab":
            total = 0
            for _, at, i, v in sorted((r for r in rows if r[0] == g), key=lambda r: (-r[1] if descending else r[1], r[2])):
                total += v
                assert got[i] == total


def test_results_are_kept_by_version_and_time():
    now, made = [0.0], []
    cache = tables.Versioned(10, lambda: now[0])
    make = lambda: made.append(1) or len(made)
    assert [cache.get("a", 1, make), cache.get("a", 1, make), cache.get("a", 2, make)] == [1, 1, 2]
    now[0] = 11.0
    assert cache.get("a", 2, make) == 3 and cache.get("b", 2, make) == 4


@pytest.mark.parametrize("kind", ["csv", "text", "json", "parquet", "orc", "binaryFile", "xml", "avro"])
def test_no_query_reads_a_file(spark, kind):
    """Files are no relations of a guarded query, in any place and whatever their format."""
    spark.range(3).createOrReplaceTempView("three")
    file = f"{kind}.`/etc/passwd`"
    for q in (
        f"SELECT * FROM {file}", f"SELECT * FROM three WHERE id IN (SELECT 1 FROM {file})", f"SELECT (SELECT max(1) FROM {file} LIMIT 1)", f"WITH t AS (SELECT * FROM {file}) SELECT * FROM t", f"TABLE {file}",
        f"SELECT * FROM three, LATERAL (SELECT * FROM {file})", f"SELECT 1 UNION ALL SELECT 2 FROM {file}", f"SELECT * FROM `{kind.upper()}`.`/etc/passwd`", f"SELECT * FROM IDENTIFIER('{kind}.`/etc/passwd`')", "SELECT * FROM `/etc/passwd`",
        f"SELECT * FROM three JOIN {file} ON EXISTS (SELECT 1 FROM {file})", f"FROM {file} SELECT 1", f"SELECT * FROM ({file})", f"SELECT * FROM {file} TABLESAMPLE (5 ROWS)",
    ):
        assert search.refusal(spark, q) is not None, q
        with pytest.raises(PermissionError):
            search.guarded_sql(spark, q)


def test_relations_are_an_allow_list(spark):
    spark.range(3).createOrReplaceTempView("three")
    spark.range(4).createOrReplaceTempView("four")
    assert search.refusal(spark, "SELECT * FROM four", ["three"]) == "relation" and search.refusal(spark, "SELECT * FROM Three", ["three"]) is None
    assert search.refusal(spark, "SELECT * FROM nowhere") == "relation"
    assert search.refusal(spark, "WITH four AS (SELECT 1) SELECT * FROM four", ["three"]) is None
    assert search.refusal(spark, "WITH four AS (SELECT * FROM four) SELECT * FROM four", ["three"]) == "relation"  # its own definition means the table
    assert search.refusal(spark, "SELECT * FROM (WITH four AS (SELECT 1) SELECT * FROM four) JOIN four", ["three"]) == "relation"
    assert search.refusal(spark, "WITH a AS (SELECT 1 AS x), b AS (SELECT * FROM a) SELECT * FROM b, three", ["three"]) is None
    page, more = search.guarded_sql(spark, "SELECT id FROM range(9000) ORDER BY id DESC LIMIT 8000")
    assert more and page.count() == search.MOST_ROWS and page.first()[0] == 8999


def test_external_modules_are_whole(spark):
    m = spark.range(12_000).select(F.concat(F.lit("x"), F.col("id").cast("string")).alias("qualified_name"))
    assert resolve.external_modules(m, "own.").count() == 12_000 and [r[0] for r in resolve.external_modules(m, "own.", 2).collect()] == ["x0", "x1"]


@pytest.mark.parametrize("pointers", [4, 0])
def test_closure_of_any_graph(spark, monkeypatch, pointers):
    """Containment with many parents, cycles and roots below roots, by pointers and step by step."""
    monkeypatch.setattr(graph, "POINTERS", pointers)
    rng = random.Random(3)
    for n, m in ((30, 25), (30, 60), (12, 0)):
        pairs = [(f"n{rng.randrange(n)}", f"n{rng.randrange(n)}") for _ in range(m)]
        roots = {"n0", "n3", "elsewhere"}
        want, ahead = set(roots), list(roots)
        while ahead:
            at = ahead.pop()
            for a, b in pairs:
                if a == at and b not in want:
                    want.add(b)
                    ahead.append(b)
        e = spark.createDataFrame(pairs, "src string, dst string")
        got = [r[0] for r in graph.closure(e, spark.createDataFrame([(r,) for r in roots], "qualified_name string")).collect()]
        assert sorted(got) == sorted(want)


def test_a_chain_of_ten_thousand_takes_few_rounds(spark, monkeypatch):
    tables_written = []
    plain = graph.settled
    monkeypatch.setattr(graph, "settled", lambda df: (tables_written.append(1), plain(df))[1])
    e = spark.range(10_000).select(F.concat(F.lit("d"), F.col("id").cast("string")).alias("src"), F.concat(F.lit("d"), (F.col("id") + 1).cast("string")).alias("dst"))
    got = graph.closure(e, spark.createDataFrame([("d17",)], "qualified_name string"))
    assert got.count() == 10_000 - 16 and len(tables_written) <= 3 + 2 * 16


def test_what_queries_only_show(spark):
    """Scalars alone are shown, rows of a deleted repository are gone, packages are nodes once, a table that can be read has its rows."""
    kinds = spark.createDataFrame([("scalar",)], "kind string")
    assert graph.scalars_or_structs(kinds).count() == 1
    docs = spark.createDataFrame([("a", 1), ("b", 2)], "repo string, x int")
    assert [r["repo"] for r in incremental.delete_report("a", documents=docs)["documents"].collect()] == ["b"]
    found = spark.createDataFrame([("r", "n", "1"), ("r", "n", "2"), ("r", "m", "1")], "path string, name string, version_spec string")
    assert manifests.external_packages(found, "proj")[0].count() == 2
    assert tables.row_count(lambda: docs) == 2


def test_operators_are_rows_of_a_table(spark):
    """Names that a language brings along: functions, operators with what they stand for, each for its language."""
    calls = spark.createDataFrame([("m.f", "m", None, n, i, 0, lang) for i, (n, lang) in enumerate([("print", "py"), ("operator_plus", "cpp"), ("operator_plus", "py"), ("equals", "java"), ("equals", None), ("own", "cpp")])], "caller string, module string, class string, call_name string, line int, col int, language string")
    symbols = spark.createDataFrame([("m.own", "own", "m", None)], "qualified_name string, name string, module string, class string")
    builtins = spark.createDataFrame([("print", None, "py"), ("operator_plus", "builtin.cpp.operator_plus", "cpp"), ("equals", "java.lang.Object.equals", "java"), ("equals", "any.equals", None), ("own", "never", None)], "name string, callee string, language string")
    none = lambda schema: spark.createDataFrame([], schema)
    got = resolve.resolved(calls, symbols, none("module string, alias string, target string"), none("module string, symbol string, target string"), none("original string, target string, module string, line int, seq int"), builtins)
    assert {r["line"]: r["callee"] for r in got.collect()} == {0: "builtins.print", 1: "builtin.cpp.operator_plus", 2: None, 3: "java.lang.Object.equals", 4: "java.lang.Object.equals", 5: "m.own"}
