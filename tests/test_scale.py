"""Plans and steps that must hold at size: what is broadcast, dealt out or held by one task."""

import os

import pytest
from pyspark.sql import functions as F

from heddle.plans import search_queries
from heddle.sources import tables

SF = "/root/testdata/sf0.001"
needs_tables = pytest.mark.skipif(not os.path.isdir(SF), reason="no driver tables")


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_few_leaves_no_large_table_to_an_estimate(spark):
    a, b = spark.range(100).withColumn("x", F.lit(1)), spark.range(50).withColumn("y", F.lit(2))
    assert "BroadcastHashJoin" in plan(a.join(tables.few(b, 50), "id"))
    assert "Broadcast" not in plan(a.join(tables.few(b, 49), "id"))


@needs_tables
def test_code_edges_and_hits_broadcast_no_names(spark):
    for df in (search_queries.code_edges(spark, SF), search_queries.code_hits(spark, SF), search_queries.code_ranking(spark, SF)):
        assert "Broadcast" not in plan(df)


@needs_tables
def test_source_files_are_dealt_out_before_they_are_read(spark):
    from heddle.plans import source_queries

    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    assert source_queries.python_files(spark, SF).rdd.getNumPartitions() >= parts
    assert source_queries.other_files(spark, SF).rdd.getNumPartitions() == parts


def test_facts_of_some_kinds_are_those_of_all(spark):
    from heddle.sources import python_source

    text = "import a\ndef f(x: A):\n    def g():\n        yield 1\n    return lambda: (yield)\nclass C(B):\n    def m(self):\n        yield x()\n"
    files = spark.createDataFrame([("p/m.py", text)], "path string, text string")
    every = python_source.parsed(files, "proj")
    some = python_source.parsed(files, "proj", kinds=("Function", "Method"))
    assert sorted(map(str, some.collect())) == sorted(map(str, every.where("kind IN ('Function', 'Method')").collect()))
    assert {r["name"]: r["is_generator"] for r in some.collect()} == {"f": False, "g": True, "m": True}


def test_classes_that_found_their_methods_go_no_further_up(spark, monkeypatch):
    from heddle.operators import resolve

    rounds = []
    monkeypatch.setattr(resolve, "settled", lambda df: (rounds.append(1), tables.settled(df))[1])
    chain = [(f"c{i}", f"c{i + 1}", 0) for i in range(40)] + [("x", "y", 0), ("y", "x", 0)]
    parents = spark.createDataFrame(chain, "class string, parent string, position int")
    methods = spark.createDataFrame([(f"c{i}", "m") for i in range(41)] + [("x", "lost")], "class string, method string")
    got = {(r["class"], r["method"]): r["ancestor"] for r in resolve.overrides(parents, methods).collect()}
    assert got == {(f"c{i}", "m"): f"c{i + 1}" for i in range(40)}
    assert len(rounds) < 30  # each of 40 depths was settled before


@pytest.mark.parametrize("strict", [False, True])
def test_nodes_meet_few_projects_where_they_lie(spark, monkeypatch, strict):
    from heddle.operators import graph

    names = ["", ".x", "a", "a.b", "a.bc", "a.b.c", "ab.c", "b", None, "a.b"]
    nodes = spark.createDataFrame(list(enumerate(names)), "i int, qualified_name string")
    projects = spark.createDataFrame([(x,) for x in ("", "a", "a.b", "ab", None, "a.b")], "project string")
    few = graph.with_project(nodes, projects, strict)
    assert "Exchange hashpartitioning(qualified_name" not in plan(few)
    got = {r["i"]: r["project"] for r in few.collect()}
    monkeypatch.setattr(graph, "FEW_PROJECTS", 0)
    assert got == {r["i"]: r["project"] for r in graph.with_project(nodes, projects, strict).collect()}


@needs_tables
def test_edges_by_key_are_the_edges(spark):
    from heddle.plans import trade

    a, b = trade.edges(spark, SF), trade.edges(spark, SF, by_key=True)
    assert b.count() == a.count() and b.exceptAll(a).isEmpty()


def test_an_export_makes_its_edges_once(spark, tmp_path):
    made = spark.sparkContext.accumulator(0)

    def counted(batches):
        for b in batches:
            made.add(b.num_rows)
            yield b

    nodes = spark.createDataFrame([("a",), ("b",)], "label string")
    edges = spark.range(7).repartition(2).mapInArrow(counted, "id long")
    tables.exported(nodes, edges, str(tmp_path / "x"))
    assert made.value == 7
    assert spark.read.json(str(tmp_path / "x/metadata")).first().asDict() == {"total_nodes": 2, "total_relationships": 7}


def test_pagerank_moves_no_names_in_its_rounds(spark, monkeypatch):
    from heddle.operators import graph

    written = []
    monkeypatch.setattr(graph, "settled", lambda df: (written.append(dict(df.dtypes)), tables.settled(df))[1])
    edges = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "a"), ("a", "c"), ("a", "c"), ("d", None)], "src string, dst string")
    got = {r[0]: round(r[1], 9) for r in graph.pagerank(edges, iterations=4, tolerance=0).collect()}
    rounds = [w for w in written if "pagerank" in w]
    assert len(rounds) == 4 and all("string" not in w.values() for w in rounds)
    assert set(got) == {"a", "b", "c", "d", None}
    monkeypatch.setattr(graph.F, "xxhash64", lambda *_: F.lit(7))  # names that share their hash
    assert got == {r[0]: round(r[1], 9) for r in graph.pagerank(edges, iterations=4, tolerance=0).collect()}


def test_a_shallow_closure_follows_no_pointers(spark, monkeypatch):
    from heddle.operators import graph

    written = []
    monkeypatch.setattr(graph, "settled", lambda df: (written.append(df.columns), tables.settled(df))[1])
    edges = spark.createDataFrame([("r", "a"), ("r", "b"), ("a", "c"), ("c", "a"), ("x", "y"), ("y", "b")], "src string, dst string")
    got = graph.closure(edges, spark.createDataFrame([("r",), ("r",)], "qualified_name string"))
    assert sorted(r[0] for r in got.collect()) == ["a", "b", "c", "r"]
    assert written.count(["node", "above"]) == 1  # the edges; pairs of all nodes and what is above them before


def test_a_chain_that_found_its_symbol_goes_no_further(spark, monkeypatch):
    from heddle.operators import resolve

    rounds = []
    monkeypatch.setattr(resolve, "settled", lambda df: (rounds.append(1), tables.settled(df))[1])
    exports = spark.createDataFrame([(f"m{i}", "h", f"m{i + 1}.h") for i in range(14)], "module string, symbol string, target string")
    symbols = spark.createDataFrame([("m1.h",), ("m1.h",), ("m9.h",)], "qualified_name string")
    starts = spark.createDataFrame([("m0.h",)], "qualified_name string")
    got = [tuple(r) for r in resolve.re_exports(starts, exports, symbols).collect()]
    assert got == [("m0.h", "m1.h", False, 1)]
    assert len(rounds) == 2  # 15 before


def test_re_exports_broadcast_nothing_by_an_estimate(spark, monkeypatch):
    from heddle.operators import resolve

    monkeypatch.setattr(resolve, "few", lambda df: tables.few(df, 0))
    plans = []
    monkeypatch.setattr(resolve, "settled", lambda df: (plans.append(plan(df)), tables.settled(df))[1])
    exports = spark.createDataFrame([("a", "h", "b.h"), ("b", "*", "c")], "module string, symbol string, target string")
    names = lambda x: spark.createDataFrame([(x,)], "qualified_name string")
    assert [tuple(r) for r in resolve.re_exports(names("a.h"), exports, names("c.h")).collect()] == [("a.h", "c.h", True, 2)]
    assert plans and all("Broadcast" not in p for p in plans)


@needs_tables
def test_a_tree_is_dealt_out_once_and_is_compressed_where_it_is_left_out(spark, monkeypatch, tmp_path):
    from heddle.plans import store_queries

    monkeypatch.setattr(store_queries, "scratch_folder", lambda *_: f"file://{tmp_path}/tree")
    assert store_queries.q_source_tree(spark, SF).count() > 0
    ids = lambda f: {(r["source"], r["lang"], r["value"]) for r in spark.read.text(f"{tmp_path}/tree/{f}").collect()}
    for folder, walked in store_queries.TREE.items():
        assert all(str(p).endswith(".txt" if walked else ".txt.gz") for p in (tmp_path / "tree" / folder).glob("source=*/lang=*/part-*"))
        assert ids(folder) == ids("src/app")


def test_an_index_moves_its_texts_and_its_postings_once(spark, tmp_path):
    from heddle.operators.segments import SegmentedIndex

    index = SegmentedIndex(spark, str(tmp_path / "i"), ["text"])
    docs = spark.createDataFrame([("r", "b", "x y2 x"), (None, "a", "x"), ("r", "c", None), ("r", "d", "")], "repo string, doc_id string, text string")
    held = index.documents(docs)
    exchanges = lambda df: plan(df).count("Exchange hashpartitioning") + plan(df).count("Exchange rangepartitioning")
    assert exchanges(held) == 1
    got = {r["key"]: (r["dl"] or 0, [tuple(t) for t in r["terms"]]) for r in held.collect()}
    blocks = index._blocks(held.withColumn("seq", F.lit(1).cast("long")))
    assert exchanges(blocks) == 2
    listed = sorted((r["repo"] or "", r["n"], r["max_tf"], r["min_dl"], [tuple(d) for d in r["docs"]]) for r in blocks.collect())
    assert all(n == len(d) for _, n, _, _, d in listed) and sum(n for _, n, *_ in listed) == sum(len(t) for _, t in got.values())
    assert got["c"] == (0, []) and got["d"] == (0, []) and got["a"][1] == [] and got["b"] == (1, [("y2", 1)])


@needs_tables
def test_a_schema_is_described_from_rows(spark):
    from heddle.plans import source_queries

    df = spark.createDataFrame([(1, None, None), (2, "x", None)], "a int, b string, c double")
    assert [tuple(r) for r in tables.described({"t": df, "u": df.limit(0)}).collect()] == [("t", "- t: a (int), b (string)", 2), ("u", "- u: ", 0)]
    assert "FileScan" in plan(source_queries.q_schema_text(spark, SF))


@needs_tables
def test_edges_are_validated_by_keys_and_move_once_for_each_end(spark):
    from heddle.plans import ledger_queries, trade
    from heddle.plans.registry import values

    df = ledger_queries.q_edge_validate(spark, SF)
    p = plan(df)
    assert p.count("REPARTITION_BY_NUM") == 2 and "star." not in p  # by sources and by targets, as keys
    assert p.count("BroadcastExchange") == 1  # the pairs of labels, not the nodes
    allowed = values(spark, ledger_queries.ALLOWED, "rel string, src_label string, dst_label string")
    nodes = trade.nodes(spark, SF).where("NOT (label = 'Part' AND name LIKE 'red%')")
    named = tables.validated_edges(trade.edges(spark, SF), nodes, allowed, [F.col("src")])
    assert sorted(df.collect()) == sorted(named.groupBy("rel", "verdict").count().collect())


def test_short_keys_are_judged_with_their_kinds_as_names_are(spark):
    nodes = spark.createDataFrame([(1, 0, "A"), (1, 1, "B"), (-2, 1, "B")], "key long, kind int, label string")
    rows = [(1, 0, 1, 1, 9), (1, 0, 1, 1, 8), (1, 0, 1, 1, 7), (1, 1, 1, 0, 1), (1, 1, 1, 0, 2), (1, 0, -2, 0, 1), (1, 0, -2, 0, 2), (1, 0, -2, 1, 1), (None, 0, 1, 1, 1), (None, 0, 1, 1, 2), (1, 0, None, 1, 1)]
    edges = spark.createDataFrame(rows, "src long, src_kind int, dst long, dst_kind int, line int").withColumn("rel", F.lit("R"))
    allowed = spark.createDataFrame([("R", "A", "B")], "rel string, src_label string, dst_label string")
    name = lambda kind, key: F.concat(F.col(kind), F.lit("."), F.col(key))
    by_key = tables.validated_edges(edges, nodes.withColumnRenamed("key", "qualified_name"), allowed, [F.desc("line")], kind="kind")
    named = edges.select("rel", name("src_kind", "src").alias("src"), name("dst_kind", "dst").alias("dst"), "line")
    by_name = tables.validated_edges(named, nodes.select(name("kind", "key").alias("qualified_name"), "label"), allowed, [F.desc("line")])
    got = lambda df: sorted((r["verdict"], r["src_label"] or "", r["dst_label"] or "", r["line"]) for r in df.collect())
    assert got(by_key) == got(by_name)
    assert [v for v, *_ in got(by_key)] == ["dangling"] * 5 + ["illegal"] * 2 + ["ok"] * 2 + ["replaced"] * 2
    once = tables.validated_edges(edges, nodes.withColumnRenamed("key", "qualified_name"), allowed, [F.desc("line")], kind="kind", once=True)
    assert sorted((r["verdict"], r["line"]) for r in once.collect()) == [("dangling", 1), ("dangling", 2), ("dangling", 2), ("illegal", 2), ("ok", 1), ("ok", 9)]


def test_an_edge_to_a_repeated_node_is_not_replaced(spark):
    nodes = spark.createDataFrame([("a", "A"), ("b", "B"), ("b", "B")], "qualified_name string, label string")
    edges = spark.createDataFrame([("R", "a", "b", 1), ("R", "a", "b", 2)], "rel string, src string, dst string, line int")
    allowed = spark.createDataFrame([("R", "A", "B")], "rel string, src_label string, dst_label string")
    got = tables.validated_edges(edges, nodes, allowed, [F.desc("line")])
    assert sorted((r["verdict"], r["line"]) for r in got.collect()) == [("ok", 2), ("ok", 2), ("replaced", 1), ("replaced", 1)]
