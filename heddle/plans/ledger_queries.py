"""Queries on changes, jobs, names and repositories."""

from __future__ import annotations

from pyspark.sql import functions as F

from heddle.operators import graph, incremental
from heddle.plans import trade
from heddle.plans.registry import Registry, sql_values, table, values
from heddle.plans.trade import SQL_EDGES, SQL_NODES
from heddle.sources import tables
from heddle.streaming import watch

R = Registry()
#: The driver's events end in January 2024.
NOW = "timestamp '2024-01-31 00:00:00'"


@R.query("""WITH o AS (SELECT user_id, event_type, event_id, value, ts FROM events WHERE ts < TIMESTAMP '2024-01-20' QUALIFY row_number() OVER (PARTITION BY user_id, event_type
ORDER BY ts DESC, event_id DESC) = 1),
n AS (SELECT user_id, event_type, event_id, value, ts FROM events WHERE ts >= TIMESTAMP '2024-01-20' QUALIFY row_number() OVER (PARTITION BY user_id, event_type
ORDER BY ts DESC, event_id DESC) = 1)
SELECT user_id, event_type, event_id, value FROM n UNION ALL SELECT user_id, event_type, event_id, value FROM o WHERE NOT EXISTS (SELECT 1 FROM n
WHERE n.user_id = o.user_id AND n.event_type = o.event_type)""")
def q_upsert_last_write(spark, sf_dir):
    e = table(spark, sf_dir, "events").select("user_id", "event_type", "event_id", "value", "ts")
    order = [F.desc("ts"), F.desc("event_id")]
    old = tables.latest(e.where("ts < timestamp '2024-01-20'"), ["user_id", "event_type"], order)
    return tables.upserted(old, e.where("ts >= timestamp '2024-01-20'"), ["user_id", "event_type"], order).drop("ts")


ALLOWED = [("PLACED", "Customer", "Order"), ("CONTAINS", "Order", "Part"), ("IN_NATION", "Customer", "Nation"), ("IN_REGION", "Nation", "Region")]


@R.query(f"""WITH {SQL_NODES}, {SQL_EDGES}, n AS (SELECT * FROM nodes WHERE NOT (label = 'Part' AND starts_with(name, 'red'))), a AS (SELECT * FROM {sql_values(ALLOWED, 'rel, sl, dl')})
SELECT rel, verdict, CAST(count(*) AS BIGINT) AS n FROM (SELECT e.rel, CASE WHEN s.label IS NULL OR d.label IS NULL THEN 'dangling' WHEN a.rel IS NULL THEN 'illegal' ELSE 'ok' END AS verdict
FROM edges e LEFT JOIN n s ON s.qualified_name = e.src LEFT JOIN n d ON d.qualified_name = e.dst LEFT JOIN a ON a.rel = e.rel AND a.sl = s.label AND a.dl = d.label) GROUP BY ALL""")
def q_edge_validate(spark, sf_dir):
    n = trade.keyed_nodes(spark, sf_dir).where("NOT (label = 'Part' AND name LIKE 'red%')")  # edges to these dangle
    allowed = values(spark, ALLOWED, "rel string, src_label string, dst_label string")
    judged = tables.validated_edges(trade.keyed_edges(spark, sf_dir), n, allowed, [F.col("src")], kind="kind", once=True)
    return judged.groupBy("rel", "verdict").agg(F.count("*").alias("n"))


MONTH = "o_orderdate >= timestamp '1996-01-01' AND o_orderdate < timestamp '1996-02-01'"


@R.query(f"SELECT c_custkey FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE {MONTH})")
def q_orphans(spark, sf_dir):
    packages = table(spark, sf_dir, "customer").withColumn("qualified_name", F.col("c_custkey"))
    children = table(spark, sf_dir, "orders").where(MONTH).select(F.col("o_custkey").alias("parent"))
    return graph.orphans(packages, children).select("c_custkey")


@R.query(f"""WITH a AS (SELECT DISTINCT o_custkey AS k FROM orders WHERE {MONTH}), b AS (SELECT DISTINCT c_custkey AS k FROM customer WHERE c_mktsegment = 'BUILDING')
SELECT 'except' AS op, k FROM (SELECT k FROM b EXCEPT SELECT k FROM a) UNION ALL SELECT 'intersect', k FROM (SELECT k FROM a INTERSECT SELECT k FROM b) UNION ALL SELECT 'union', k
FROM (SELECT k FROM a UNION SELECT k FROM b)""")
def q_set_ops(spark, sf_dir):
    a = table(spark, sf_dir, "orders").where(MONTH).select(F.col("o_custkey").alias("k"))
    b = table(spark, sf_dir, "customer").where("c_mktsegment = 'BUILDING'").select(F.col("c_custkey").alias("k"))
    ops = {"except": b.subtract(a), "intersect": a.intersect(b), "union": a.union(b).distinct()}
    out = [df.select(F.lit(op).alias("op"), "k") for op, df in ops.items()]
    return out[0].unionByName(out[1]).unionByName(out[2])


def snapshots(spark, sf_dir):
    """The documents as files, before and after some changes."""
    d = table(spark, sf_dir, "documents").withColumn("path", F.concat("source", F.lit("/"), F.col("doc_id").cast("string")))
    old = d.where("n_chars >= 200").select("path", (F.col("doc_id") * 1000).alias("mtime_ns"), F.length("text").cast("long").alias("size"), F.sha1("text").alias("sha"))
    text = F.when(F.col("doc_id") % 7 == 0, F.concat("text", F.lit("!"))).otherwise(F.col("text"))
    new = d.where("lang <> 'fr' OR n_chars > 900").select("path", (F.col("doc_id") * 1000 + F.when(F.col("doc_id") % 5 == 0, 9).otherwise(0)).alias("mtime_ns"), F.length(text).cast("long").alias("size"), F.sha1(text).alias("sha"))
    return old, new


SQL_SNAPSHOTS = """o AS (SELECT source || '/' || doc_id AS path, doc_id * 1000 AS mtime_ns, length(text) AS size, sha1(text) AS sha FROM documents WHERE n_chars >= 200),
n AS (SELECT source || '/' || doc_id AS path, doc_id * 1000 + CASE WHEN doc_id % 5 = 0 THEN 9 ELSE 0 END AS mtime_ns, length(text) + (doc_id % 7 = 0)::INT AS size, sha1(CASE WHEN doc_id % 7 = 0 THEN text || '!' ELSE text END) AS sha FROM documents WHERE lang <> 'fr' OR n_chars > 900),
diff AS (SELECT coalesce(o.path, n.path) AS path, CASE WHEN o.path IS NULL THEN 'new' WHEN n.path IS NULL THEN 'deleted' WHEN (o.size = n.size AND o.mtime_ns = n.mtime_ns) OR o.sha = n.sha THEN 'unchanged' ELSE 'changed' END AS status,
n.path IS NOT NULL AND NOT coalesce(o.size = n.size AND o.mtime_ns = n.mtime_ns, false) AS rehashed FROM o FULL JOIN n ON o.path = n.path)"""


@R.query(f"WITH {SQL_SNAPSHOTS} SELECT path, status, rehashed FROM diff")
def q_snapshot_diff(spark, sf_dir):
    return incremental.snapshot_diff(*snapshots(spark, sf_dir))


@R.query(f"""WITH {SQL_SNAPSHOTS}, x AS (SELECT string_split(path, '/')[1] AS source, CASE status WHEN 'unchanged' THEN 'unchanged' WHEN 'deleted' THEN 'filtered' ELSE 'embedded' END AS outcome
FROM diff)
SELECT source, count(*) AS expected, count(*) FILTER (outcome = 'embedded') AS embedded, count(*) FILTER (outcome = 'unchanged') AS unchanged, count(*) FILTER (outcome = 'filtered') AS filtered, 0::BIGINT AS unreadable, 0::BIGINT AS failed, count(*) AS total,
round(count(*) FILTER (outcome = 'unchanged') / nullif(count(*) FILTER (outcome <> 'filtered'), 0), 4) AS hash_match_rate, 0::BIGINT AS unaccounted FROM x GROUP BY source""")
def q_diff_metrics(spark, sf_dir):
    d = incremental.snapshot_diff(*snapshots(spark, sf_dir))
    o = d.select(F.split("path", "/")[0].alias("source"), F.when(F.col("status") == "unchanged", "unchanged").when(F.col("status") == "deleted", "filtered").otherwise("embedded").alias("outcome"))
    return incremental.diff_metrics(o, "source")


@R.query("""WITH g AS (SELECT user_id, ts, event_type, CASE WHEN ts > lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) + INTERVAL 3600 SECOND OR lag(ts) OVER (PARTITION BY user_id
ORDER BY ts, event_id) IS NULL THEN 1 ELSE 0 END AS start, event_id FROM events),
s AS (SELECT *, sum(start) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS k FROM g)
SELECT user_id, epoch_us(min(ts)) AS first_us, epoch_us(max(ts)) + 3600000000 AS closed_us, array_to_string(list_sort(list(DISTINCT event_type)), ',') AS paths, count(*) AS n_events
FROM s GROUP BY user_id, k""")
def q_debounce(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    out = watch.debounced(e, ["user_id"], "ts", "event_type", "3600 seconds")
    return out.select("user_id", F.unix_micros(F.col("first_ts").cast("timestamp")).alias("first_us"), F.unix_micros(F.col("closed_ts").cast("timestamp")).alias("closed_us"), F.array_join("paths", ",").alias("paths"), "n_events")


STATUS = {"view": "queued", "click": "running", "signup": "running", "purchase": "done", "error": "failed"}


def job_events(spark, sf_dir):
    status = F.create_map(*[F.lit(x) for kv in STATUS.items() for x in kv])
    e = table(spark, sf_dir, "events")
    return e.select((F.col("event_id") % 997).alias("job_id"), status[F.col("event_type")].alias("status"), F.unix_micros(F.col("ts").cast("timestamp")).alias("ts"), "event_id", "user_id")


SQL_JOBS = "e AS (SELECT event_id % 997 AS job_id, CASE event_type " + " ".join(f"WHEN '{a}' THEN '{b}'" for a, b in STATUS.items()) + " END AS status, epoch_us(ts) AS ts, event_id, user_id FROM events)"


@R.query(f"""WITH {SQL_JOBS}, t AS (SELECT job_id, arg_min(status, (ts, event_id)) AS state FROM e WHERE status IN ('done', 'failed') GROUP BY job_id),
l AS (SELECT job_id, arg_max(status, (ts, event_id)) AS state, max(ts) AS updated_at, min(ts) AS started_at, count(*) AS n_events FROM e GROUP BY job_id)
SELECT job_id, coalesce(t.state, l.state) AS state, updated_at, started_at, n_events FROM l LEFT JOIN t USING (job_id)""")
def q_job_state(spark, sf_dir):
    return incremental.job_states(job_events(spark, sf_dir), "job_id", "status", "ts", "event_id")


def ledger(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    status = F.when(F.col("event_id") % 3 == 0, "running").when(F.col("event_id") % 3 == 1, "queued").otherwise("done")
    seconds = F.unix_micros(F.col("ts").cast("timestamp")) / 1e6
    return e.select(F.col("event_id").alias("job_id"), status.alias("status"), F.when(F.col("event_id") % 2 == 0, "writing").otherwise("parsing").alias("phase"), seconds.alias("updated_at"), (seconds - 60).alias("started_at"), F.concat(F.lit("w"), (F.col("user_id") % 4).cast("string")).alias("worker_token"), F.concat(F.lit("r"), (F.col("user_id") % 20).cast("string")).alias("repo_slug"), F.col("event_type").alias("kind"), F.col("user_id").cast("string").alias("actor_oid"))


SQL_LEDGER = "j AS (SELECT event_id AS job_id, CASE event_id % 3 WHEN 0 THEN 'running' WHEN 1 THEN 'queued' ELSE 'done' END AS status, CASE event_id % 2 WHEN 0 THEN 'writing' ELSE 'parsing' END AS phase, epoch_us(ts) / 1e6 AS updated_at, epoch_us(ts) / 1e6 - 60 AS started_at, 'w' || (user_id % 4) AS worker_token, 'r' || (user_id % 20) AS repo_slug, event_type AS kind FROM events)"
NOW_S = 1706140800.0


@R.query(f"WITH {SQL_LEDGER} SELECT job_id, phase FROM j WHERE status = 'running' AND updated_at < {NOW_S} - CASE WHEN phase = 'writing' THEN 864000 ELSE 86400 END")
def q_stale(spark, sf_dir):
    return incremental.stale_jobs(ledger(spark, sf_dir), F.lit(NOW_S), 86400, 864000).select("job_id", "phase")


@R.query(f"WITH {SQL_LEDGER} SELECT worker_token, CASE WHEN status IN ('queued', 'running') AND worker_token <> 'w1' THEN 'interrupted' ELSE status END AS status, count(*) AS n FROM j GROUP BY ALL")
def q_sweep(spark, sf_dir):
    return incremental.swept(ledger(spark, sf_dir), "w1").groupBy("worker_token", "status").agg(F.count("*").alias("n"))


@R.query(f"WITH {SQL_LEDGER} SELECT repo_slug, arg_max(job_id, (started_at, job_id)) AS job_id FROM j WHERE status IN ('queued', 'running') GROUP BY repo_slug")
def q_newest_active(spark, sf_dir):
    return incremental.newest_active(ledger(spark, sf_dir))


@R.query(f"WITH {SQL_LEDGER} SELECT job_id, repo_slug, status FROM j WHERE repo_slug = 'r3' AND status IN ('done', 'running') AND kind IN ('click', 'view') ORDER BY started_at DESC, job_id LIMIT 20 OFFSET 5")
def q_job_list(spark, sf_dir):
    return incremental.listed_jobs(ledger(spark, sf_dir), slug="r3", statuses=["done", "running"], kinds=["click", "view"], limit=20, offset=5).select("job_id", "repo_slug", "status")


@R.query(f"WITH {SQL_LEDGER} SELECT job_id FROM j WHERE NOT (status = 'done' AND updated_at < {NOW_S} - 240 * 3600)")
def q_clear_terminal(spark, sf_dir):
    jobs = ledger(spark, sf_dir)
    return incremental.cleared(jobs, jobs.select("job_id"), F.lit(NOW_S), 240)[0].select("job_id")


@R.query("""WITH s AS (SELECT o_custkey AS repo, o_orderkey AS snapshot_id, epoch(o_orderdate) AS ts, row_number() OVER (PARTITION BY o_custkey ORDER BY epoch(o_orderdate) DESC, o_orderkey) AS k
FROM orders)
SELECT repo, snapshot_id, k <= 3 OR ts > 883612800 - 86400 * 30 AS kept FROM s""")
def q_retention(spark, sf_dir):
    s = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("repo"), F.col("o_orderkey").alias("snapshot_id"), (F.unix_micros(F.col("o_orderdate").cast("timestamp")) / 1e6).alias("ts"))
    return tables.rotated(s, 3, 86400 * 30, 883612800).select("repo", "snapshot_id", "kept")


@R.query("""WITH f AS (SELECT source AS repo, doc_id::VARCHAR AS path, n_chars AS size, doc_id * 60.0 AS mtime FROM documents),
t AS (SELECT *, mtime >= 60000 - 48000 AS young, sum(CASE WHEN mtime >= 60000 - 48000 THEN size ELSE 0 END) OVER (PARTITION BY repo ORDER BY mtime DESC, path) AS total FROM f)
SELECT repo, path, NOT young OR total > 50000 AS evicted FROM t""")
def q_cache_eviction(spark, sf_dir):
    f = table(spark, sf_dir, "documents").select(F.col("source").alias("repo"), F.col("doc_id").cast("string").alias("path"), F.col("n_chars").alias("size"), (F.col("doc_id") * 60.0).alias("mtime"))
    return tables.evicted(f, 48000, 50000, 60000).select("repo", "path", "evicted")


@R.query(f"WITH {SQL_NODES}, {SQL_EDGES}, g AS (SELECT DISTINCT dst FROM edges WHERE rel = 'PLACED' AND src = 'star.Customer.4') SELECT qualified_name FROM nodes WHERE qualified_name <> 'star.Customer.4' AND label IN ('Customer', 'Order') AND qualified_name NOT IN (SELECT dst FROM g)")
def q_delete_module(spark, sf_dir):
    e = trade.edges(spark, sf_dir).withColumn("rel", F.when(F.col("rel") == "PLACED", "DEFINES").otherwise(F.col("rel")))
    return graph.without_module(graph.scan(trade.nodes(spark, sf_dir), "Customer", "Order"), e, "star.Customer.4").select("qualified_name")


@R.query(f"SELECT user_id, epoch_us(ts) / 1e6 AS at, CASE WHEN epoch_us(ts) > lag(epoch_us(ts)) OVER w THEN round((event_id - lag(event_id) OVER w) / ((epoch_us(ts) / 1e6) - lag(epoch_us(ts) / 1e6) OVER w), 2) END AS rate FROM events WINDOW w AS (PARTITION BY user_id ORDER BY epoch_us(ts) / 1e6)")
def q_throughput(spark, sf_dir):
    e = table(spark, sf_dir, "events").select("user_id", "event_id", (F.unix_micros(F.col("ts").cast("timestamp")) / 1e6).alias("at"))
    return incremental.throughput(e, "user_id", "at", "event_id").select("user_id", "at", "rate")
