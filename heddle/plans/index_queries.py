"""Queries on stored and living structures: neighbours and clusters in blocks, versioned stores, silent jobs, statistics."""

from __future__ import annotations

from pyspark.sql import functions as F

from heddle.operators import graph, nearest, rank
from heddle.plans import trade
from heddle.plans.registry import Registry, quoted, scratch_folder, sql_values, table, values
from heddle.plans.text_queries import COS
from heddle.plans.trade import SQL_EDGES, SQL_NODES
from heddle.sources import results
from heddle.sources.snapshots import Snapshots
from heddle.streaming import silence, watch

R = Registry()

# --- neighbours and clusters ---------------------------------------------------------------------

ALL = f"""WITH s AS (SELECT a.vec_id AS query, b.vec_id AS key, round({COS}, 9) AS score FROM embeddings a JOIN embeddings b ON a.vec_id <> b.vec_id),
r AS (SELECT *, CAST(row_number() OVER (PARTITION BY query ORDER BY score DESC, key) AS INTEGER) AS rank FROM s)"""


@R.query(f"{ALL} SELECT query, rank, key, round(score, 6) AS score FROM r WHERE rank <= 10")
def q_neighbours_all(spark, sf_dir):
    """The ten nearest of every vector, all against all in blocks."""
    e = table(spark, sf_dir, "embeddings")
    return nearest.k_nearest(e, e, 10).withColumn("score", F.round("score", 6))


@R.query(f"{ALL} SELECT query, rank, key, round(score, 6) AS score FROM r WHERE rank <= 5")
def q_stored_lists(spark, sf_dir):
    """A stored index, built once and searched by two sets of queries through all its lists, which is exact."""
    e = table(spark, sf_dir, "embeddings")
    index = nearest.InvertedLists(spark, scratch_folder(spark, "lists"))
    index.build(e, 12)
    low, high = (index.search(e.where(side), 5, probes=12) for side in (F.col("label") < 5, F.col("label") >= 5))
    return low.unionByName(high).withColumn("score", F.round("score", 6))


@R.query("SELECT count(*) AS queries, true AS recalled FROM embeddings")
def q_lists_recall(spark, sf_dir):
    """Whether probing some of the lists finds nine of ten true neighbours, over all vectors."""
    e = table(spark, sf_dir, "embeddings")
    index = nearest.InvertedLists(spark, scratch_folder(spark, "lists"))
    index.build(e)
    found = index.search(e, 10).select("query", "key", F.lit(1).alias("found"))
    both = nearest.k_nearest(e, e, 10).join(found, ["query", "key"], "left")
    return both.agg(F.countDistinct("query").alias("queries"), (F.count("found") / F.count("*") >= 0.9).alias("recalled"))


def _clusters_sql(k: int, steps: int) -> str:
    """Farthest-first start from the smallest key, then so many steps, each written out."""
    far = "round(greatest(list_inner_product(v.u, v.u) - 2 * list_inner_product(v.u, c.u) + list_inner_product(c.u, c.u), 0), 9)"
    out = ["v AS MATERIALIZED (SELECT vec_id, list_transform(x, lambda y: y / sqrt(list_inner_product(x, x))) AS u FROM (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS x FROM embeddings))"]
    out += ["w AS MATERIALIZED (SELECT vec_id, unnest(u) AS x, unnest(range(0, 64)) AS place FROM v)", "s0 AS MATERIALIZED (SELECT 0 AS c, u FROM v ORDER BY vec_id LIMIT 1)"]
    out += [f"s{i} AS MATERIALIZED (SELECT * FROM s{i - 1} UNION ALL SELECT {i}, u FROM (SELECT v.vec_id, any_value(v.u) AS u, min({far}) AS d FROM v, s{i - 1} c GROUP BY v.vec_id ORDER BY d DESC, v.vec_id LIMIT 1))" for i in range(1, k)]
    given = lambda t, c: f"{t} AS MATERIALIZED (SELECT v.vec_id, arg_min(c.c, ({far}, c.c)) AS c FROM v, {c} c GROUP BY v.vec_id)"
    mean = lambda t, a: f"{t} AS MATERIALIZED (SELECT c, list(m ORDER BY place) AS u FROM (SELECT c, place, avg(x) AS m FROM w JOIN {a} USING (vec_id) GROUP BY c, place) GROUP BY c)"
    last = f"s{k - 1}"
    for i in range(steps):
        out += [given(f"a{i}", last), mean(f"c{i}", f"a{i}")]
        last = f"c{i}"
    out += [given("a", last), mean("m", "a")]
    return f"""WITH {', '.join(out)},
    d AS (SELECT vec_id, a.c, round(list_inner_product(v.u, m.u), 9) AS d FROM v JOIN a USING (vec_id) JOIN m USING (c)),
    h AS (SELECT c, count(*) AS size, arg_min(vec_id, (-d, vec_id)) AS label FROM d GROUP BY c),
    n AS (SELECT c, CAST(row_number() OVER (ORDER BY size DESC, label) - 1 AS INTEGER) AS cluster, size, label FROM h)
    SELECT vec_id, cluster, size, label FROM a JOIN n USING (c)"""


@R.query(_clusters_sql(8, 10))
def q_clusters(spark, sf_dir):
    """k-means from a defined start."""
    return nearest.clusters(table(spark, sf_dir, "embeddings"), 8, iterations=10)


# --- versioned stores ----------------------------------------------------------------------------


@R.query("""SELECT 'before' AS reader, o_orderstatus AS status, count(*) AS n, CAST(sum(o_custkey) AS BIGINT) AS keys FROM orders WHERE o_orderstatus <> 'F' GROUP BY 2
UNION ALL SELECT 'after', o_orderstatus, count(*), CAST(sum(o_custkey + CASE WHEN o_orderstatus = 'O' THEN 1 ELSE 0 END) AS BIGINT) FROM orders GROUP BY 2""")
def q_versions(spark, sf_dir):
    """What a reader that came before a write sees, and one that came after; the write reads the table that it replaces."""
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderstatus")
    store = Snapshots(spark, scratch_folder(spark, "versions"))
    store.write(orders.where("o_orderstatus <> 'F'"))
    before = store.read()
    moved = before.withColumn("o_custkey", F.col("o_custkey") + (F.col("o_orderstatus") == "O").cast("long"))
    store.write(moved.unionByName(orders.where("o_orderstatus = 'F'")))
    out = None
    for reader, df in (("before", before), ("after", store.read())):
        sums = df.groupBy(F.col("o_orderstatus").alias("status")).agg(F.count("*").alias("n"), F.sum("o_custkey").alias("keys")).select(F.lit(reader).alias("reader"), "status", "n", "keys")
        out = sums if out is None else out.unionByName(sums)
    return out


@R.query("""WITH f AS (SELECT 'u' || user_id AS path, epoch_us(ts) AS mtime, event_id, event_type FROM events),
l AS (SELECT path, arg_max(event_type || ':' || event_id, (mtime, event_id)) AS sha FROM f GROUP BY path)
SELECT path, sha FROM l WHERE NOT starts_with(sha, 'purchase')""")
def q_applied_once(spark, sf_dir):
    """Files as their last writes leave them, from three micro-batches of which two come twice; the last write of some is a deletion."""
    e = table(spark, sf_dir, "events")
    sha = F.when(F.col("event_type") != "purchase", F.concat_ws(":", "event_type", F.col("event_id").cast("string")))
    micros = F.unix_micros(F.col("ts").cast("timestamp"))
    files = e.select(F.concat(F.lit("u"), F.col("user_id").cast("string")).alias("path"), micros.alias("mtime_ns"), F.col("event_id").alias("size"), sha.alias("sha"), F.when(F.col("ts") < "2024-01-11", 1).when(F.col("ts") < "2024-01-21", 2).otherwise(3).alias("_batch"))
    store = Snapshots(spark, scratch_folder(spark, "files"))
    run = watch.indexed_once(store, "events")
    for number in (1, 2, 2, 3, 1):
        run(files.where(F.col("_batch") == number).drop("_batch"), number)
    return store.read().select("path", "sha")


# --- silent jobs ---------------------------------------------------------------------------------

STATUS = {"signup": "queued", "purchase": "done"}


@R.query(f"""WITH e AS (SELECT user_id AS job_id, CASE event_type {' '.join(f"WHEN {quoted(a)} THEN {quoted(b)}" for a, b in STATUS.items())} ELSE 'running' END AS status, CASE WHEN value > 50 THEN 'writing' ELSE 'parsing' END AS phase,
epoch_us(ts) // 1000 AS t, ts, event_id FROM events),
o AS (SELECT *, lead(t) OVER w AS later, coalesce(max(CASE WHEN status = 'done' THEN 1 ELSE 0 END) OVER (PARTITION BY job_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS ended FROM e WINDOW w AS (PARTITION BY job_id ORDER BY ts, event_id)),
s AS (SELECT *, t + CASE WHEN phase = 'writing' THEN 180000 ELSE 30000 END AS stale FROM o WHERE ended = 0 AND status = 'running')
SELECT job_id, phase, CAST(stale AS BIGINT) AS stale_ms FROM s WHERE coalesce(later > stale, stale <= 1800000000000)""")
def q_silences(spark, sf_dir):
    """When running jobs were silent for too long, as timers of a stream tell it."""
    status = F.lit("running")
    for a, b in STATUS.items():
        status = F.when(F.col("event_type") == a, b).otherwise(status)
    e = table(spark, sf_dir, "events")
    e = e.select(F.col("user_id").alias("job_id"), F.col("ts").cast("timestamp").alias("ts"), F.col("event_id").alias("seq"), status.alias("status"), F.when(F.col("value") > 50, "writing").otherwise("parsing").alias("phase"))
    return silence.silences(e, 1_800_000_000_000, 30, 180)


# --- statistics, ranks and results ---------------------------------------------------------------


@R.query(f"""WITH {SQL_NODES}, {SQL_EDGES}, n AS (SELECT label AS repo, count(*) AS nodes FROM nodes GROUP BY label),
e AS (SELECT label AS repo, count(*) AS relations FROM edges JOIN nodes ON src = qualified_name GROUP BY label),
v AS (SELECT CASE WHEN label < 3 THEN 'Customer' WHEN label < 5 THEN 'Order' ELSE 'Lost' END AS repo, count(*) AS embeddings FROM embeddings GROUP BY 1),
r AS (SELECT * FROM {sql_values([("Customer", "/src/customer"), ("Order", "/src/order"), ("Nobody", "/src/nobody")], 'repo, root')})
SELECT coalesce(n.repo, r.repo, v.repo) AS repo, root, CAST(coalesce(nodes, 0) AS BIGINT) AS nodes, CAST(coalesce(relations, 0) AS BIGINT) AS relations, CAST(coalesce(embeddings, 0) AS BIGINT) AS embeddings
FROM n FULL JOIN r ON n.repo = r.repo FULL JOIN v ON v.repo = coalesce(n.repo, r.repo) LEFT JOIN e ON e.repo = coalesce(n.repo, r.repo, v.repo)""")
def q_repo_stats(spark, sf_dir):
    """A row for each repository: its root, nodes, relations and embeddings; here a label is one."""
    nodes = trade.nodes(spark, sf_dir).withColumn("repo", F.col("label"))
    where = F.when(F.col("label") < 3, "Customer").when(F.col("label") < 5, "Order").otherwise("Lost")
    vectors = table(spark, sf_dir, "embeddings").select(where.alias("repo"))
    roots = values(spark, [("Customer", "/src/customer"), ("Order", "/src/order"), ("Nobody", "/src/nobody")], "repo string, root string")
    return graph.repository_stats(nodes, trade.edges(spark, sf_dir), vectors, roots)


NAMES = ["src1", "web.src1", "src1.part"]


@R.query(f"""WITH d AS (SELECT doc_id, CASE doc_id % 4 WHEN 0 THEN source WHEN 1 THEN 'web.' || source WHEN 2 THEN source || '.part' ELSE 'x' || source END AS name, n_chars FROM documents)
SELECT doc_id, name, CAST(row_number() OVER (ORDER BY CASE WHEN name IN {"(" + ", ".join(map(quoted, NAMES)) + ")"} THEN 0 ELSE 1 END, n_chars DESC, doc_id) AS INTEGER) AS rank FROM d ORDER BY rank LIMIT 60""")
def q_pinned(spark, sf_dir):
    """Hits whose name is the query, or ends or begins with it at a dot, go first; the others by score."""
    m, s = F.col("doc_id") % 4, F.col("source")
    name = F.when(m == 0, s).when(m == 1, F.concat(F.lit("web."), s)).when(m == 2, F.concat(s, F.lit(".part"))).otherwise(F.concat(F.lit("x"), s))
    docs = table(spark, sf_dir, "documents").select("doc_id", name.alias("name"), F.col("n_chars").alias("score"))
    return rank.pin_final(docs, "src1", "name", "doc_id", 60).select("doc_id", "name", "rank")


@R.query("""SELECT 'one' AS session, lang, count(*) AS n FROM documents WHERE n_chars > 300 GROUP BY lang
UNION ALL SELECT 'two', lang, count(*) FROM documents WHERE n_chars > 300 GROUP BY lang UNION ALL SELECT 'newer', lang, count(*) FROM documents WHERE n_chars > 300 AND lang <> 'de' GROUP BY lang""")
def q_kept_results(spark, sf_dir):
    """A result that one session made and another reuses, and made anew when its input has a newer version."""
    folder = scratch_folder(spark, "results")
    docs = table(spark, sf_dir, "documents").select("lang", "n_chars")
    store = Snapshots(spark, f"{folder}/input")
    version = store.write(docs)
    counts = lambda: store.read().where("n_chars > 300").groupBy("lang").agg(F.count("*").alias("n"))
    kept, other = results.Results(spark, f"{folder}/kept"), results.Results(spark, f"{folder}/kept")
    one = kept.get(counts(), {"documents": version})
    two = other.get(counts(), {"documents": version})
    version = store.write(docs.where("lang <> 'de'"))
    newer = other.get(counts(), {"documents": version})
    said = [df.select(F.lit(name).alias("session"), "lang", "n") for name, df in (("one", one), ("two", two), ("newer", newer))]
    return said[0].unionByName(said[1]).unionByName(said[2])


# --- documents, models and schemas ---------------------------------------------------------------


@R.query("""SELECT n_nationkey AS nation, count(*) AS nodes, CAST(sum(o) AS BIGINT) AS relations FROM nation
JOIN (SELECT c_nationkey, c_custkey, (SELECT count(*) FROM orders WHERE o_custkey = c_custkey) AS o FROM customer) ON c_nationkey = n_nationkey GROUP BY 1""")
def q_loaded_graphs(spark, sf_dir):
    """Graphs as JSON documents, one for each nation, written and loaded again."""
    from heddle.sources import tables

    customers, orders = table(spark, sf_dir, "customer"), table(spark, sf_dir, "orders")
    each = orders.groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.collect_list(F.struct(F.col("o_custkey").alias("src"), F.lit("PLACED").alias("rel"), F.col("o_orderkey").alias("dst"))).alias("r"))
    joined = customers.join(each, "c_custkey", "left").withColumn("r", F.coalesce("r", F.array().cast("array<struct<src:bigint,rel:string,dst:bigint>>")))
    node = F.struct(F.col("c_custkey").alias("id"), F.col("c_name").alias("name"), F.col("c_nationkey").alias("nation"))
    docs = joined.groupBy("c_nationkey").agg(F.collect_list(node).alias("nodes"), F.flatten(F.collect_list("r")).alias("relationships"))
    path = scratch_folder(spark, "graphs")
    docs.repartition("c_nationkey").write.partitionBy("c_nationkey").json(path)
    nodes, relations = tables.loaded_graph(spark, path)
    n = nodes.groupBy("nation").agg(F.count("*").alias("nodes"))
    e = relations.join(nodes.select(F.col("id").alias("src"), "nation"), "src").groupBy("nation").agg(F.count("*").alias("relations"))
    return n.join(e, "nation")


@R.query(f"""WITH s AS (SELECT a.vec_id, {COS} AS score FROM embeddings a, embeddings b WHERE b.vec_id = 7 AND a.vec_id <> 7),
t AS (SELECT vec_id, row_number() OVER (ORDER BY score DESC, vec_id) AS n FROM s ORDER BY n LIMIT 20)
SELECT vec_id, CAST(row_number() OVER (ORDER BY CASE n WHEN 4 THEN -2 WHEN 2 THEN -1 ELSE n END) AS INTEGER) AS place FROM t""")
def q_reranked(spark, sf_dir):
    """The head of a list in the order that a model names; what it doesn't name, or names wrongly, stays as it was."""
    from heddle.operators import vector
    from heddle.plans import search

    best = vector.neighbours(table(spark, sf_dir, "embeddings"), 7, 20).withColumn("qualified_name", F.concat(F.lit("v"), F.col("vec_id").cast("string")))
    rows = search.reranked("near 7", {}, lambda prompt: f"[4] > [2], not [999]; [4] again ({prompt.count('[')})")(best.collect())  # twenty rows
    return values(spark, [(r["vec_id"], i) for i, r in enumerate(rows, 1)], "vec_id long, place int")


@R.query("SELECT lang, count(*) AS n, CAST(3 AS INTEGER) AS attempts FROM documents WHERE n_chars > 200 GROUP BY lang")
def q_generated_query(spark, sf_dir):
    """A query text that a model wrote, cleaned, judged and run; the store answers at the third attempt."""
    from heddle.operators import incremental
    from heddle.plans import search

    table(spark, sf_dir, "documents").createOrReplaceTempView("asked_documents")
    text = search.generated_query(spark, "How many long texts has each language?", lambda q: "```sql\nSELECT lang, count(*) AS n FROM asked_documents WHERE n_chars > 200 GROUP BY lang\n```", ["asked_documents"])
    tried = []

    def ask():
        tried.append(1)
        if len(tried) < 3:
            raise TimeoutError
        return search.guarded_sql(spark, text.rstrip("; "), 0, 100, ["asked_documents"])[0]

    answer = incremental.retried(ask, (TimeoutError,), sleep=lambda s: None)
    return answer.withColumn("attempts", F.lit(len(tried)))


@R.query(f"""WITH {SQL_NODES}, {SQL_EDGES}, e AS (SELECT s.label AS src_label, rel, d.label AS dst_label FROM edges JOIN nodes s ON s.qualified_name = src JOIN nodes d ON d.qualified_name = dst)
SELECT 'node' AS kind, '(' || label || ')' AS line, count(*) AS n, CAST(count(path) AS BIGINT) AS with_path FROM nodes GROUP BY label
UNION ALL SELECT 'relation', '(' || src_label || ')-[' || rel || ']->(' || dst_label || ')', count(*), 0 FROM e GROUP BY src_label, rel, dst_label""")
def q_graph_schema(spark, sf_dir):
    """What a graph's rows say of its schema: labels with how many have a path, and which labels each relation joins."""
    return graph.observed_schema(trade.nodes(spark, sf_dir), trade.edges(spark, sf_dir, by_key=True))
