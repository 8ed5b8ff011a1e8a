"""Queries on the graph of the star tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from heddle.functions import text as T
from heddle.operators import graph
from heddle.plans import trade
from heddle.plans.registry import Registry, sql_array, sql_list, sql_values, table, values
from heddle.plans.trade import SQL_EDGES, SQL_NODES, SQL_TRADES

R = Registry()
SEEDS = ["star.Customer.1", "star.Customer.4", "star.Nation.3"]


@R.query(f"WITH {SQL_NODES}, {SQL_TRADES} SELECT DISTINCT n.qualified_name, n.path AS file_path, n.start_line AS line_number FROM trades t JOIN nodes n ON n.qualified_name = t.src WHERE t.dst = 'star.Supplier.7'")
def q_callers(spark, sf_dir):
    return graph.related(trade.trades(spark, sf_dir), trade.nodes(spark, sf_dir), "star.Supplier.7", incoming=True)


@R.query(f"WITH {SQL_NODES}, {SQL_TRADES} SELECT DISTINCT n.qualified_name, n.path AS file_path, n.start_line AS line_number FROM trades t JOIN nodes n ON n.qualified_name = t.dst WHERE t.src = 'star.Customer.4'")
def q_callees(spark, sf_dir):
    return graph.related(trade.trades(spark, sf_dir), trade.nodes(spark, sf_dir), "star.Customer.4", incoming=False)


PROJECTS = ["star", "star.Customer", "star.Order.1", "star.P", "moon"]


@R.query(f"""WITH {SQL_NODES}, p AS (SELECT * FROM {sql_values([(x,) for x in PROJECTS], 'project')}),
m AS (SELECT qualified_name, arg_max(project, length(project)) AS project FROM nodes JOIN p ON starts_with(qualified_name, project) GROUP BY qualified_name)
SELECT n.qualified_name, n.path, m.project FROM nodes n LEFT JOIN m USING (qualified_name)""")
def q_symbol_locate(spark, sf_dir):
    projects = values(spark, [(x,) for x in PROJECTS], "project string")
    return graph.with_project(trade.nodes(spark, sf_dir), projects).select("qualified_name", "path", "project")


KEYS = ["star.Customer.1", "star.Part.9", "star.Nowhere.1"]


@R.query(f"WITH {SQL_NODES}, k AS (SELECT * FROM {sql_values([(x,) for x in KEYS], 'qualified_name')}) SELECT k.qualified_name, coalesce(path, '') AS file_path, coalesce(start_line, 0) AS start_line, coalesce(end_line, 0) AS end_line FROM k LEFT JOIN nodes n USING (qualified_name)")
def q_locations(spark, sf_dir):
    return graph.located(values(spark, [(x,) for x in KEYS], "qualified_name string"), trade.nodes(spark, sf_dir))


EXACT = ["FRANCE", "ASIA", "1-URGENT"]


@R.query(f"WITH {SQL_NODES} SELECT DISTINCT qualified_name FROM nodes WHERE name IN {sql_list(EXACT)}")
def q_exact_names(spark, sf_dir):
    wanted = values(spark, [(x,) for x in EXACT], "name string")
    return trade.nodes(spark, sf_dir).join(F.broadcast(wanted), "name", "left_semi").select("qualified_name").distinct()


@R.query(f"WITH {SQL_NODES} SELECT w.label, CAST(count(n.label) AS BIGINT) AS n FROM (SELECT unnest({sql_array([x[0] for x in trade.LABELS] + ['Galaxy'])}) AS label) w LEFT JOIN nodes n USING (label) GROUP BY w.label")
def q_type_counts(spark, sf_dir):
    return graph.type_counts(trade.nodes(spark, sf_dir), [x[0] for x in trade.LABELS] + ["Galaxy"])


@R.query(f"""WITH {SQL_NODES}, {SQL_EDGES}, u AS (SELECT 'node' AS kind, label AS name FROM nodes UNION ALL SELECT 'relation', rel FROM edges)
SELECT kind, coalesce(name, '(all)') AS name, CAST(count(*) AS BIGINT) AS n FROM u GROUP BY GROUPING SETS ((kind, name), (kind))""")
def q_graph_stats(spark, sf_dir):
    both = trade.nodes(spark, sf_dir).select(F.lit("node").alias("kind"), F.col("label").alias("name")).unionByName(trade.edges(spark, sf_dir).select(F.lit("relation").alias("kind"), F.col("rel").alias("name")))
    counts = both.groupBy("kind", "name").agg(F.count("*").alias("n"))
    totals = counts.groupBy("kind").agg(F.sum("n").alias("n")).select("kind", F.lit("(all)").alias("name"), "n")
    return counts.unionByName(totals)


@R.query("SELECT o_orderkey, o_custkey, o_orderstatus, true AS has_more FROM (SELECT o_orderkey, o_custkey, o_orderstatus FROM orders ORDER BY ALL LIMIT 50 OFFSET 100)")
def q_page_stable(spark, sf_dir):
    page, more = graph.paged(table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderstatus"), 100, 50)
    return page.withColumn("has_more", F.lit(more))


@R.query("SELECT url AS path, string_split(url, '/')[-1] AS name, regexp_extract(string_split(url, '/')[-1], '(\\.[^.]+)$', 1) AS extension, CAST(count(*) OVER () AS BIGINT) AS total FROM pages WHERE contains(lower(url), 'example.com') ORDER BY url LIMIT 40")
def q_file_list(spark, sf_dir):
    files = graph.listed_files(table(spark, sf_dir, "pages"), "url", "Example.com")
    total = files.agg(F.count("*").alias("total"))
    return files.orderBy("path").limit(40).join(F.broadcast(total), how="cross")  # one row


@R.query(f"""WITH {SQL_EDGES}, e AS (SELECT *, row_number() OVER (ORDER BY rel, src, dst) AS i FROM (SELECT rel, src, dst FROM edges WHERE rel IN ('IN_REGION', 'PLACED')
ORDER BY rel, src, dst LIMIT 200)),
f AS (SELECT id, min(p) AS p FROM (SELECT src AS id, 2 * i AS p FROM e UNION ALL SELECT dst, 2 * i + 1 FROM e) GROUP BY id ORDER BY 2 LIMIT 40)
SELECT rel, src, dst FROM e WHERE src IN (SELECT id FROM f) AND dst IN (SELECT id FROM f)""")
def q_overview(spark, sf_dir):
    return graph.overview(trade.edges(spark, sf_dir), ["IN_REGION", "PLACED"], 40)


BFS = f"""WITH RECURSIVE {SQL_EDGES}, d AS (SELECT DISTINCT qualified_name, 0 AS depth FROM {sql_values([(x,) for x in SEEDS], 'qualified_name')})"""


@R.query(f"""{BFS}, r(qualified_name, depth) AS (SELECT qualified_name, depth FROM d UNION SELECT e.dst, r.depth + 1 FROM r JOIN edges e ON e.src = r.qualified_name WHERE r.depth < 3)
SELECT qualified_name, CAST(min(depth) AS INTEGER) AS depth FROM r GROUP BY qualified_name""")
def q_bfs_depth(spark, sf_dir):
    return graph.breadth_first(trade.edges(spark, sf_dir), values(spark, [(x,) for x in SEEDS], "qualified_name string"), 3)


@R.query(f"""{BFS}, c AS (SELECT DISTINCT src FROM (SELECT src, row_number() OVER (PARTITION BY dst ORDER BY src) AS k FROM (SELECT DISTINCT src, dst FROM edges JOIN d ON dst = d.qualified_name))
WHERE k <= 3),
f AS (SELECT qualified_name, depth FROM d UNION ALL SELECT src, 1 FROM c WHERE src NOT IN (SELECT qualified_name FROM d)),
h1 AS (SELECT DISTINCT dst, 1 AS depth FROM edges JOIN f ON src = f.qualified_name WHERE dst NOT IN (SELECT qualified_name FROM f)),
k1 AS (SELECT * FROM f UNION ALL SELECT * FROM h1),
h2 AS (SELECT DISTINCT e.dst, 2 AS depth FROM edges e JOIN h1 ON e.src = h1.dst WHERE e.dst NOT IN (SELECT qualified_name FROM k1))
SELECT qualified_name, CAST(depth AS INTEGER) AS depth FROM k1 UNION ALL SELECT dst, depth FROM h2""")
def q_bfs_callers(spark, sf_dir):
    return graph.breadth_first(trade.edges(spark, sf_dir), values(spark, [(x,) for x in SEEDS], "qualified_name string"), 2, caller_cap=3, exclude_tests=True)


def pagerank_sql(steps: int) -> str:
    out = f"WITH {SQL_TRADES}, e AS MATERIALIZED (SELECT DISTINCT src, dst FROM trades), o AS MATERIALIZED (SELECT src, count(*) AS k FROM e GROUP BY src), v AS MATERIALIZED (SELECT src AS q FROM e UNION SELECT dst FROM e), n AS (SELECT count(*) AS n FROM v), r0 AS (SELECT q, 1.0::DOUBLE / n AS p FROM v, n)"
    for i in range(steps):
        out += f", r{i + 1} AS MATERIALIZED (SELECT v.q, 0.15 / n.n + 0.85 * (SELECT coalesce(sum(p), 0) FROM r{i} WHERE q NOT IN (SELECT src FROM o)) / n.n + 0.85 * coalesce(s, 0) AS p FROM v CROSS JOIN n LEFT JOIN (SELECT dst, sum(p / k) AS s FROM e JOIN r{i} ON src = q JOIN o USING (src) GROUP BY dst) g ON dst = v.q)"
    return out


@R.query(pagerank_sql(5) + " SELECT q AS qualified_name, round(p, 8) AS pagerank FROM r5")
def q_pagerank_5(spark, sf_dir):
    ranks = graph.pagerank(trade.trades(spark, sf_dir), iterations=5, tolerance=0)
    return ranks.withColumn("pagerank", F.round("pagerank", 8))


@R.query(pagerank_sql(5) + ", m AS (SELECT min(p) AS lo, max(p) AS hi FROM r5) SELECT q AS qualified_name, round(p / hi, 4) AS by_max, round((p - lo) / (hi - lo), 4) AS by_range FROM r5, m")
def q_pagerank_norm(spark, sf_dir):
    ranks = graph.settled(graph.pagerank(trade.trades(spark, sf_dir), iterations=5, tolerance=0))
    a = graph.by_greatest(ranks).select("qualified_name", F.round("pagerank", 4).alias("by_max"))
    return a.join(graph.by_range(ranks).select("qualified_name", F.round("pagerank", 4).alias("by_range")), "qualified_name")


def settled_sql(steps: int) -> str:
    """The first of so many steps after which the summed change is below a millionth for each node."""
    changes = " UNION ALL ".join(f"SELECT {i + 1} AS i, sum(abs(a.p - b.p)) AS change FROM r{i} a JOIN r{i + 1} b USING (q)" for i in range(steps))
    every = " UNION ALL ".join(f"SELECT {i + 1} AS i, q, p FROM r{i + 1}" for i in range(steps))
    return pagerank_sql(steps) + f", ch AS MATERIALIZED ({changes}), ev AS ({every}), st AS (SELECT min(i) AS i FROM ch, n WHERE change < n.n * 1e-6), la AS (SELECT q, p FROM ev JOIN st USING (i))"


@R.query(settled_sql(70) + " SELECT q AS qualified_name, round(p / (SELECT max(p) FROM la), 4) AS pagerank FROM la")
def q_pagerank_settled(spark, sf_dir):
    return graph.by_greatest(graph.pagerank(trade.trades(spark, sf_dir))).withColumn("pagerank", F.round("pagerank", 4))


SCORES = [("star.Customer.1", 0.9), ("star.Customer.4", 0.6)]


@R.query(f"""WITH {SQL_EDGES}, s AS (SELECT * FROM {sql_values(SCORES, 'q, score')}), fl AS (SELECT min(score) AS f FROM s),
l1 AS (SELECT dst AS q, least(max(score) * 0.5, 0.99 * any_value(f)) AS score FROM edges JOIN s ON src = q, fl WHERE dst NOT IN (SELECT q FROM s) GROUP BY dst),
l2 AS (SELECT dst AS q, least(max(score) * 0.5, 0.99 * any_value(f)) AS score FROM edges JOIN (SELECT * FROM s UNION ALL SELECT * FROM l1) u ON src = u.q, fl WHERE dst NOT IN (SELECT q
FROM s) AND dst NOT IN (SELECT q FROM l1) GROUP BY dst)
SELECT q AS qualified_name, round(CAST(score AS DOUBLE), 4) AS score FROM (SELECT * FROM s UNION ALL SELECT * FROM l1 UNION ALL SELECT * FROM l2)""")
def q_score_propagation(spark, sf_dir):
    e = trade.edges(spark, sf_dir)
    seeds = values(spark, SCORES, "qualified_name string, score double")
    depths = graph.breadth_first(e, seeds.select("qualified_name"), 2)
    return graph.propagated(seeds, e, depths).withColumn("score", F.round("score", 4))


@R.query(f"""WITH {SQL_NODES}, {SQL_EDGES}, c AS (SELECT dst, count(*) AS callers FROM edges GROUP BY dst)
SELECT qualified_name, coalesce(callers, 0) AS callers, sha1(substring('# ' || label || ': ' || qualified_name || chr(10) || '# Module: ' || path || chr(10) || '# Callers: ' || coalesce(callers, 0) || chr(10) || '# ---' || CASE WHEN name <> '' THEN chr(10) || name ELSE '' END, 1, 4096)) AS content_hash
FROM nodes LEFT JOIN c ON dst = qualified_name WHERE label IN ('Part', 'Supplier', 'Nation')""")
def q_embed_text(spark, sf_dir):
    n = graph.inbound_counts(graph.scan(trade.nodes(spark, sf_dir), "Part", "Supplier", "Nation"), trade.edges(spark, sf_dir))
    text = T.embed_text(F.col("label"), F.col("qualified_name"), F.col("path"), F.col("callers").cast("string"), F.col("name"), F.lit(None).cast("string"))
    return n.select("qualified_name", "callers", T.content_hash(text).alias("content_hash"))


@R.query(f"WITH {SQL_NODES}, {SQL_EDGES} SELECT n.qualified_name, array_to_string(list_sort(list(m.name)), ',') AS members FROM nodes n JOIN edges e ON e.src = n.qualified_name AND rel = 'IN_REGION' JOIN nodes m ON m.qualified_name = e.dst WHERE n.label = 'Nation' GROUP BY ALL")
def q_member_names(spark, sf_dir):
    n = trade.nodes(spark, sf_dir)
    got = graph.member_names(graph.scan(n, "Nation"), trade.edges(spark, sf_dir).where("rel = 'IN_REGION'"), n)
    return got.select("qualified_name", F.array_join("members", ",").alias("members"))
