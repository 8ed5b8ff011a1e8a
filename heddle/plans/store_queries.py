"""Queries on stores and sources: writes, exports, manifests, ledgers, embedding runs and scalar functions."""

from __future__ import annotations

from pyspark import StorageLevel
from pyspark.sql import functions as F

from heddle.functions import predicates as P
from heddle.functions import text as T
from heddle.operators import chunks, evaluation, graph, incremental, resolve, vector
from heddle.plans import trade
from heddle.plans.ledger_queries import SQL_LEDGER, ledger
from heddle.plans.registry import Registry, scratch_folder, sql_array, sql_values, table, values
from heddle.plans.trade import SQL_EDGES, SQL_NODES
from heddle.sources import manifests, python_source, tables, walk

R = Registry()


# --- vectors -------------------------------------------------------------------------------------

UNITS = "list_transform(embedding, lambda x: CAST(x AS DOUBLE))"


@R.query(f"""WITH e AS (SELECT vec_id, label, list_transform({UNITS}, lambda x: x * (1 + vec_id % 3)) AS v FROM embeddings)
SELECT vec_id, round(v[1] / sqrt(list_inner_product(v, v)), 4) AS first, round(v[64] / sqrt(list_inner_product(v, v)), 4) AS last FROM e""")
def q_normalised(spark, sf_dir):
    e = table(spark, sf_dir, "embeddings")
    v = vector.l2_normalised(F.transform("embedding", lambda x: x.cast("double") * (1 + F.col("vec_id") % 3)))
    return e.select("vec_id", F.round(F.get(v, F.lit(0)), 4).alias("first"), F.round(F.get(v, F.lit(63)), 4).alias("last"))


@R.query("""SELECT label, count(*) AS n, round(sum(CAST(embedding[1] AS DOUBLE)), 3) AS first FROM
(SELECT vec_id, label, embedding FROM embeddings WHERE label > 2 UNION ALL SELECT vec_id, label, list_transform(embedding, lambda x: -x) FROM embeddings WHERE label <= 2) GROUP BY label""")
def q_vector_upsert(spark, sf_dir):
    """Stored vectors, of which some are written anew at twice the length and turned round; read back from files."""
    e = table(spark, sf_dir, "embeddings").withColumn("seq", F.lit(0))
    turned = F.transform("embedding", lambda x: (x.cast("double") * -2).cast("float"))
    new = e.where("label <= 2").withColumn("embedding", turned).withColumn("seq", F.lit(1))
    out = tables.vectors_upserted(e, new.unionByName(e.where("label <= 2")), "vec_id", [F.desc("seq")])
    path = scratch_folder(spark, "vectors")
    tables.bulk_written(out.where("label < 5"), path, "label")
    tables.bulk_written(out.where("label >= 5"), path, "label")
    back = spark.read.parquet(path)
    return back.groupBy("label").agg(F.count("*").alias("n"), F.round(F.sum(F.get("embedding", F.lit(0)).cast("double")), 3).alias("first"))


@R.query("SELECT count(*) FILTER (label <> 3) AS left_, count(*) FILTER (label = 3) AS gone, 0::BIGINT AS unknown FROM embeddings")
def q_deleted_count(spark, sf_dir):
    e = table(spark, sf_dir, "embeddings")
    left, gone = tables.deleted_count(e, e.where("label = 3"), ["vec_id"])
    unknown = tables.row_count(lambda: spark.read.parquet(f"{sf_dir}/nowhere.parquet"))
    return left.agg(F.count("*").alias("left_")).select("left_", F.lit(gone).cast("long").alias("gone"), F.lit(unknown).cast("long").alias("unknown"))


@R.query("""WITH t AS (SELECT doc_id FROM documents ORDER BY n_chars DESC, doc_id LIMIT 50), u AS (SELECT unnest(embedding) AS x, unnest(range(0, 64)) AS place FROM embeddings
WHERE vec_id IN (SELECT doc_id FROM t))
SELECT (SELECT count(*) FROM embeddings WHERE vec_id IN (SELECT doc_id FROM t)) AS n, CAST(place AS INTEGER) AS place, round(avg(CAST(x AS DOUBLE)), 5) + 0.0 AS mean FROM u GROUP BY place""")
def q_central_mean(spark, sf_dir):
    ranks = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("vec_id"), "n_chars")
    got = vector.central_mean(ranks, table(spark, sf_dir, "embeddings"), 50, "vec_id", "n_chars")
    return got.select("n", F.posexplode("centroid").alias("place", "mean")).withColumn("mean", F.round("mean", 5) + F.lit(0.0))


@R.query("""SELECT batch, outcome, count(*) AS n FROM (SELECT doc_id // 8 AS batch, CASE WHEN bool_or(doc_id % 41 = 0) OVER (PARTITION BY doc_id // 8) OR count(*) OVER (PARTITION BY doc_id // 8) <> 8 THEN 'failed' ELSE 'embedded' END AS outcome FROM documents) GROUP BY ALL""")
def q_batch_outcome(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select(F.floor(F.col("doc_id") / 8).alias("batch"), "doc_id", vector.hashed_embedding(F.array("lang", "source"), 4).alias("embedding"), F.when(F.col("doc_id") % 41 == 0, "timeout").alias("error"))
    expected = d.select("batch").distinct().withColumn("n", F.lit(8))
    return vector.batch_outcome(d, "batch", expected).groupBy("batch", "outcome").agg(F.count("*").alias("n"))


@R.query(f"""WITH d AS (SELECT doc_id, CASE WHEN doc_id % 29 = 0 THEN NULL WHEN doc_id % 31 = 0 THEN ' ' || chr(10) ELSE text END AS t FROM documents),
k AS (SELECT doc_id, list_transform(regexp_extract_all(translate(t, '._', '  '), '[A-Za-z][A-Za-z0-9]+'), lambda x: lower(x)) AS w FROM d WHERE trim(regexp_replace(coalesce(t, ''),
'\\s+', ' ', 'g')) <> '')
SELECT doc_id, CAST(len(w) AS DOUBLE) AS total, (SELECT count(*) FROM d WHERE t IS NULL) AS unreadable, (SELECT count(*) FROM d WHERE t = ' ' || chr(10)) AS blank FROM k""")
def q_embed_run(spark, sf_dir):
    """Texts that can be read, embedded in batches by a function that fails at first, and what was left out."""
    d = table(spark, sf_dir, "documents").withColumn("t", F.when(F.col("doc_id") % 29 == 0, F.lit(None)).when(F.col("doc_id") % 31 == 0, " \n").otherwise(F.col("text")))
    good, left = incremental.readable(d.withColumn("error", F.lit(None).cast("string")), "t", "error")
    tried = []

    def embed(texts):
        """Counts tokens; every second call fails, as a busy server does."""
        import re

        tried.append(1)
        if len(tried) % 2:
            raise TimeoutError("busy")
        return [[float(len(re.findall("[A-Za-z][A-Za-z0-9]+", t.translate(str.maketrans("._", "  ")))))] for t in texts]

    rows = vector.embedded(good.select("doc_id", "t"), "t", embed, 1)
    got = rows.where("error IS NULL").select("doc_id", F.get("embedding", F.lit(0)).cast("double").alias("total"))
    return got.join(F.broadcast(left), how="cross")  # one row


@R.query("""WITH s AS (SELECT doc_id, md5(text) AS h FROM documents WHERE n_chars > 300), n AS (SELECT doc_id, CASE WHEN lang = 'fr' THEN md5(text || '!') ELSE md5(text) END AS h FROM documents)
SELECT n.doc_id, CASE WHEN s.h IS NULL THEN 'missing' ELSE 'changed' END AS why FROM n LEFT JOIN s USING (doc_id) WHERE s.h IS NULL OR s.h <> n.h""")
def q_to_embed(spark, sf_dir):
    d = table(spark, sf_dir, "documents")
    stored = d.where("n_chars > 300").select("doc_id", F.md5("text").alias("content_hash"))
    new = d.select("doc_id", F.md5(F.when(F.col("lang") == "fr", F.concat("text", F.lit("!"))).otherwise(F.col("text"))).alias("content_hash"))
    todo = incremental.to_embed(new, stored, "doc_id")
    return todo.join(stored.select("doc_id", F.lit("changed").alias("why")), "doc_id", "left").select("doc_id", F.coalesce("why", F.lit("missing")).alias("why"))


@R.query("""WITH m AS (SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT vec_id FROM embeddings) OR lang = 'de' ORDER BY doc_id)
SELECT doc_id, (SELECT count(*) FROM m) AS missing, (SELECT count(*) FROM m) = 0 OR 2 * (SELECT count(*) FROM documents) - 2 * (SELECT count(*) FROM m) >= (SELECT count(*)
FROM documents) AS enough FROM (SELECT doc_id FROM m ORDER BY doc_id LIMIT 10)""")
def q_missing_sample(spark, sf_dir):
    d = table(spark, sf_dir, "documents")
    stored = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("doc_id")).join(d.where("lang <> 'de'"), "doc_id", "left_semi")
    gone, sample = incremental.missing_sample(d, stored, "doc_id")
    n = gone.agg(F.count("*").alias("missing")).join(F.broadcast(d.agg(F.count("*").alias("_n"))), how="cross")  # one row each
    n = n.select("missing", incremental.persisted_enough(F.col("_n"), F.col("_n") - F.col("missing")).alias("enough"))
    return sample.join(F.broadcast(n), how="cross")


@R.query("SELECT count(*) FILTER (doc_id % 37 = 0) AS failed, count(*) FILTER (doc_id % 37 = 0) > 0 AS run_failed FROM documents")
def q_failed_share(spark, sf_dir):
    o = table(spark, sf_dir, "documents").select(F.when(F.col("doc_id") % 37 == 0, "failed").otherwise("embedded").alias("outcome"))
    return incremental.failed_share(o)


# --- graphs and files ------------------------------------------------------------------------------

@R.query(f"WITH {SQL_NODES}, {SQL_EDGES} SELECT 'node' AS kind, label AS name, count(*) AS n FROM nodes GROUP BY label UNION ALL SELECT 'relation', rel, count(*) FROM edges GROUP BY rel UNION ALL SELECT 'total', 'nodes', count(*) FROM nodes UNION ALL SELECT 'total', 'relationships', count(*) FROM edges")
def q_export(spark, sf_dir):
    """A graph written as JSON, read back and summed up."""
    path = scratch_folder(spark, "export")
    tables.exported(trade.nodes(spark, sf_dir), trade.edges(spark, sf_dir, by_key=True), path)
    nodes, edges = tables.loaded_export(spark, path)
    meta = spark.read.json(f"{path}/metadata").select(F.explode(F.create_map(F.lit("nodes"), "total_nodes", F.lit("relationships"), "total_relationships")).alias("name", "n"))
    a = nodes.groupBy(F.lit("node").alias("kind"), F.col("label").alias("name")).agg(F.count("*").alias("n"))
    b = edges.groupBy(F.lit("relation").alias("kind"), F.col("rel").alias("name")).agg(F.count("*").alias("n"))
    return a.unionByName(b).unionByName(meta.select(F.lit("total").alias("kind"), "name", "n"))


@R.query("""SELECT user_id AS src, event_type AS rel, count(*) AS n_writes, arg_max(value, event_id) AS value, coalesce(max(event_id) FILTER (event_id % 5 = 0), -1) AS fifth FROM events GROUP BY ALL""")
def q_merged_properties(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    props = F.map_filter(F.create_map(F.lit("value"), F.col("value").cast("string"), F.lit("fifth"), F.when(F.col("event_id") % 5 == 0, F.col("event_id").cast("string"))), lambda _, v: v.isNotNull())
    edges = e.select(F.col("user_id").alias("src"), F.col("event_type").alias("rel"), F.lit(0).alias("dst"), "event_id", props.alias("properties"))
    nodes = e.select(F.col("user_id").alias("id"), "event_id")
    _, merged = tables.merged_properties(nodes, edges, "event_id")
    n = e.groupBy(F.col("user_id").alias("src"), F.col("event_type").alias("rel")).agg(F.count("*").alias("n_writes"))
    return merged.join(n, ["src", "rel"]).select("src", "rel", "n_writes", F.col("properties")["value"].cast("double").alias("value"), F.coalesce(F.col("properties")["fifth"].cast("long"), F.lit(-1)).alias("fifth"))


@R.query(f"""WITH RECURSIVE {SQL_NODES}, {SQL_EDGES}, r(q) AS (SELECT 'star.Customer.4' UNION SELECT dst FROM r JOIN edges ON src = q WHERE rel IN ('PLACED', 'CONTAINS')), s(q) AS (SELECT q
FROM r UNION SELECT dst FROM s JOIN edges ON src = q WHERE rel = 'SUPPLIED_BY')
SELECT label, count(*) AS n FROM nodes WHERE qualified_name NOT IN (SELECT q FROM s) GROUP BY label""")
def q_delete_project(spark, sf_dir):
    left = graph.without_project(trade.nodes(spark, sf_dir), trade.edges(spark, sf_dir, by_key=True), "star.Customer.4", ["PLACED", "CONTAINS"], ["SUPPLIED_BY"])
    return left.groupBy("label").agg(F.count("*").alias("n"))


@R.query("SELECT o_orderkey AS src, CASE WHEN o_orderpriority = '1-URGENT' THEN '' ELSE o_orderstatus END AS was, CASE WHEN o_orderpriority = '1-URGENT' THEN 'p/' || (o_orderkey % 7) ELSE o_orderstatus END AS file_path FROM orders")
def q_backfilled_paths(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    edges = o.select(F.lit("DEFINES").alias("rel"), F.col("o_orderkey").alias("src"), F.when(F.col("o_orderpriority") == "1-URGENT", "").otherwise(F.col("o_orderstatus")).alias("file_path"))
    modules = o.select(F.col("o_orderkey").alias("qualified_name"), F.concat(F.lit("p/"), (F.col("o_orderkey") % 7).cast("string")).alias("path"))
    return tables.backfilled_paths(edges.withColumn("was", F.col("file_path")), modules).select("src", "was", "file_path")


@R.query("SELECT source AS repo, count(*) AS keys, min(lang) AS first_value, max(CASE WHEN doc_id = (SELECT min(doc_id) FROM documents x WHERE x.source = d.source) THEN lang END) AS of_first FROM documents d GROUP BY source")
def q_metadata(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select(F.col("source").alias("repo"), F.col("doc_id").cast("string").alias("key"), F.col("lang").alias("value"), "doc_id")
    maps = tables.key_values(d, "repo", most=1_000_000)
    first = d.groupBy("repo").agg(F.min("doc_id").cast("string").alias("k"))
    return maps.join(first, "repo").select("repo", F.size("metadata").cast("long").alias("keys"), F.array_min(F.map_values("metadata")).alias("first_value"), F.col("metadata")[F.col("k")].alias("of_first"))


@R.query("SELECT url AS path, string_split(url, '/')[-1] AS name, regexp_extract(string_split(url, '/')[-1], '(\\.[^.]+)$', 1) AS extension FROM (SELECT url, min(page_id) AS r FROM pages GROUP BY url) ORDER BY r LIMIT 60 OFFSET 5")
def q_files_by_rank(spark, sf_dir):
    return graph.listed_by_rank(table(spark, sf_dir, "pages"), "url", "page_id", limit=60, offset=5)


@R.query(f"WITH {SQL_NODES} SELECT label, count(*) AS n FROM nodes WHERE label IN ('Customer', 'Part') GROUP BY label")
def q_types_non_zero(spark, sf_dir):
    return graph.type_counts(trade.nodes(spark, sf_dir), ["Customer", "Part", "Galaxy"], non_zero=True)


@R.query(f"WITH {SQL_NODES} SELECT qualified_name, starts_with(qualified_name, 'star.Order.12.') OR starts_with(qualified_name, 'star.Nation.') AS below, ends_with(qualified_name, '.7') AS ends FROM nodes WHERE starts_with(qualified_name, 'star.Nation.') OR ends_with(qualified_name, '.7') OR qualified_name = 'Part.7'")
def q_registry(spark, sf_dir):
    n = trade.nodes(spark, sf_dir).select("qualified_name")
    a = graph.with_prefix(n, "star.Nation").unionByName(graph.with_prefix(n, "star.Order.12")).withColumn("below", F.lit(True))
    b = graph.ending_with(n, "7").withColumn("ends", F.lit(True))
    return a.join(b, "qualified_name", "full").select("qualified_name", F.coalesce("below", F.lit(False)).alias("below"), F.coalesce("ends", F.lit(False)).alias("ends"))


@R.query("SELECT CASE WHEN event_type = 'view' THEN 'node' ELSE 'relationship' END AS kind, count(*) AS n FROM events WHERE event_type <> 'error' GROUP BY 1")
def q_row_values(spark, sf_dir):
    kind = F.when(F.col("event_type") == "view", "node").when(F.col("event_type") == "error", "scalar").otherwise("relationship")
    e = table(spark, sf_dir, "events").withColumn("kind", kind)
    return graph.scalars_or_structs(e).groupBy("kind").agg(F.count("*").alias("n"))


@R.query(f"WITH {SQL_NODES}, p AS (SELECT * FROM {sql_values([('star',), ('star.Customer.1',), ('star.Order',)], 'project')}), m AS (SELECT qualified_name, arg_max(project, length(project)) AS project FROM nodes JOIN p ON starts_with(qualified_name || '.', project || '.') GROUP BY qualified_name) SELECT qualified_name, project FROM m")
def q_project_strict(spark, sf_dir):
    projects = values(spark, [("star",), ("star.Customer.1",), ("star.Order",)], "project string")
    return graph.with_project(trade.nodes(spark, sf_dir), projects, strict=True).where("project IS NOT NULL").select("qualified_name", "project")


@R.query(f"WITH {SQL_NODES}, {SQL_EDGES} SELECT qualified_name, path FROM nodes WHERE label = 'Region' AND qualified_name IN (SELECT b.dst FROM edges a JOIN edges b ON a.dst = b.src WHERE a.src = 'star.Customer.4' AND a.rel = 'IN_NATION') ORDER BY qualified_name LIMIT 1")
def q_nearest_module(spark, sf_dir):
    n = trade.nodes(spark, sf_dir).withColumn("label", F.when(F.col("label") == "Region", "Module").otherwise(F.col("label")))
    e = trade.edges(spark, sf_dir).where("rel IN ('IN_NATION', 'IN_REGION')")
    return graph.nearest_module("star.Customer.4", e, n).select("qualified_name", "path")


@R.query(f"WITH {SQL_NODES}, d AS (SELECT count(*) FILTER (label IN ('Galaxy')) AS definitions, count(*) AS total FROM nodes) SELECT definitions, total, definitions = 0 AND total > 0 AS truncated FROM d")
def q_truncated(spark, sf_dir):
    return graph.truncated(graph.type_counts(trade.nodes(spark, sf_dir)), ["Galaxy"])


@R.query("""WITH t AS (SELECT doc_id, source AS path, text, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS r FROM documents), f AS (SELECT path, text, doc_id FROM t WHERE r = 1)
SELECT 'doc.' || d AS qualified_name, f.doc_id IS NOT NULL AND d <> 3 AS found, CASE WHEN f.doc_id IS NULL THEN 'unknown symbol' WHEN d = 3 THEN 'no location' END AS reason,
CASE WHEN f.doc_id IS NOT NULL AND d <> 3 THEN array_to_string(string_split(text, chr(10))[1:2], chr(10)) END AS snippet FROM (SELECT unnest([0, 3, 5, -1]) AS d) LEFT JOIN f ON f.doc_id = d""")
def q_snippets(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    first = docs.groupBy("source").agg(F.min_by("text", "doc_id").alias("text"), F.min("doc_id").alias("doc_id"))
    nodes = first.select(F.concat(F.lit("doc."), F.col("doc_id").cast("string")).alias("qualified_name"), F.col("source").alias("path"), F.when(F.col("doc_id") != 3, 1).alias("start_line"), F.lit(2).alias("end_line"))
    out = [graph.snippet(f"doc.{d}", nodes, first.select(F.col("source").alias("path"), "text")) for d in (0, 3, 5, -1)]
    return out[0].unionByName(out[1]).unionByName(out[2]).unionByName(out[3])


@R.query("""SELECT * FROM (VALUES ('missing', 1::BIGINT), ('damaged', 1), ('extra', 1)) t(verdict, n) UNION ALL SELECT 'ok', count(DISTINCT source) - 2 FROM documents""")
def q_restore(spark, sf_dir):
    """Files of a snapshot held against its manifest; one has been lost since, one damaged, one added."""
    root = scratch_folder(spark, "snapshot")
    docs = table(spark, sf_dir, "documents")
    docs.repartition("source").write.partitionBy("source").parquet(root)
    kept = values(spark, [tuple(r) for r in tables.manifest(spark, root).select("path", "sha").collect()], "path string, sha string")  # a file for each source
    path = spark._jvm.org.apache.hadoop.fs.Path
    fs = path(root).getFileSystem(spark._jsc.hadoopConfiguration())
    fs.delete(path(f"{root}/source=src1"), True)
    damaged = kept.where(F.col("path").startswith("source=src2/")).first()["path"]
    for name in (damaged, "source=new/extra.parquet"):
        out = fs.create(path(f"{root}/{name}"), True)
        out.write(bytearray(b"not what it was"))
        out.close()
    return tables.restored(spark, root, kept).groupBy("verdict").agg(F.count("*").alias("n"))


@R.query("""SELECT source, 1::BIGINT AS files, CAST(sum(octet_length(encode(text)) + 1) AS BIGINT) AS bytes FROM documents WHERE source NOT IN ('src1', 'src3') GROUP BY source""")
def q_source_files(spark, sf_dir):
    """Files below a folder, less those in folders that are left out, which are not opened."""
    root = scratch_folder(spark, "files")
    docs = table(spark, sf_dir, "documents")
    docs.select("source", "text").repartition("source").write.partitionBy("source").text(root)
    skipped = ("source=src1", "source=src3")
    files = tables.source_files(spark, root, lambda p: ~P.skip_path(p, exclude=skipped), exclude=skipped)
    return files.groupBy(F.regexp_extract("path", "source=([^/]*)/", 1).alias("source")).agg(F.count("*").alias("files"), F.sum("size").alias("bytes"))


# Folders of a written tree, and what a walk with these rules reads of them.
TREE = {"src/app": True, "src/node_modules/x": False, "lib/vendor/keep": True, "lib/vendor/other": False, "build": False, "docs/gen/deep/er": False, "docs/guide": True, "__pycache__": False}


@R.query(f"""WITH f AS (SELECT source, lang, CAST(sum(octet_length(encode(text)) + 1) AS BIGINT) AS bytes FROM documents GROUP BY source, lang),
t AS (SELECT * FROM {sql_values(list(TREE.items()), 'folder, walked')})
SELECT folder, 'source=' || source || '/lang=' || lang AS leaf, 1::BIGINT AS files, bytes FROM f, t WHERE walked AND source <> 'src1'""")
def q_source_tree(spark, sf_dir):
    """A tree of the documents' texts below eight folders, walked with folders left out and one let in.  The texts are dealt
    out once for all folders; those that are left out have them compressed."""
    root = scratch_folder(spark, "tree")
    docs = table(spark, sf_dir, "documents").select("source", "lang", "text").repartition("source", "lang").sortWithinPartitions("source", "lang").persist(StorageLevel.DISK_ONLY)
    for folder, walked in TREE.items():
        docs.write.partitionBy("source", "lang").text(f"{root}/{folder}", compression=None if walked else "gzip")
    docs.unpersist()
    files = walk.source_tree(spark, root, ("source=src1", "docs/gen"), ("lib/vendor/keep",))
    leaf = F.regexp_extract("path", "(source=[^/]*/lang=[^/]*)/", 1)
    return files.groupBy(F.regexp_extract("path", "^(.*?)/source=", 1).alias("folder"), leaf.alias("leaf")).agg(F.count("*").alias("files"), F.sum("size").alias("bytes"))


# --- paths, names and texts -------------------------------------------------------------------------

PATH = "CASE page_id % 8 WHEN 0 THEN 'src/node_modules/a.js' WHEN 1 THEN 'lib/vendor/keep/x.py' WHEN 2 THEN 'docs/a.tmp' WHEN 3 THEN 'gen/b.py' WHEN 4 THEN 'src/skip_me.py' WHEN 5 THEN 'build/out.o' WHEN 6 THEN 'web/' || page_id || '/dist/z.ts' ELSE 'src/p' || page_id || '.py' END"


@R.query(f"""WITH p AS (SELECT page_id, {PATH} AS path FROM pages), q AS (SELECT *, string_split(path, '/')[-1] AS name, string_split(path, '/')[:-2] AS dirs FROM p)
SELECT page_id, CASE WHEN ends_with(name, '.tmp') OR ends_with(name, '.o') OR list_contains(dirs, 'gen') OR starts_with(path, 'gen/') OR path = 'gen' THEN true WHEN regexp_matches(name, '^p1.*$') THEN false WHEN name = 'skip_me.py' THEN true
WHEN starts_with(path, 'lib/vendor/keep/') THEN false ELSE list_has_any(dirs, {sql_array(P.IGNORED_NAMES)}) END AS skipped,
CASE WHEN list_contains(dirs, 'gen') OR array_to_string(dirs, '/') = 'gen' OR starts_with(array_to_string(dirs, '/'),
'gen/') THEN true WHEN array_to_string(dirs, '/') = 'lib/vendor/keep' OR starts_with('lib/vendor/keep', array_to_string(dirs, '/') || '/') OR starts_with(array_to_string(dirs, '/'),
'lib/vendor/keep/') THEN false ELSE list_has_any(dirs, {sql_array(P.IGNORED_NAMES)}) END AS pruned FROM q""")
def q_skipped_paths(spark, sf_dir):
    m, i = F.col("page_id") % 8, F.col("page_id").cast("string")
    path = F.when(m == 0, "src/node_modules/a.js").when(m == 1, "lib/vendor/keep/x.py").when(m == 2, "docs/a.tmp").when(m == 3, "gen/b.py").when(m == 4, "src/skip_me.py").when(m == 5, "build/out.o").when(m == 6, F.concat(F.lit("web/"), i, F.lit("/dist/z.ts"))).otherwise(F.concat(F.lit("src/p"), i, F.lit(".py")))
    exclude, unignore = ("gen", "skip_me.py"), ("p1*", "lib/vendor/keep")
    p = table(spark, sf_dir, "pages").select("page_id", path.alias("path"))
    folder = F.regexp_replace("path", "/[^/]*$", "")
    return p.select("page_id", P.skip_path(F.col("path"), exclude, unignore).alias("skipped"), P.prune_folder(folder, ("gen",), ("lib/vendor/keep",)).alias("pruned"))


@R.query("""SELECT doc_id, regexp_matches(name, '^\\w[\\w.]*\\w$') AND contains(name, '.') AS shaped, regexp_matches(name, '(^|\\.)anonymous_[0-9]+_[0-9]+(\\.|$)') OR (len(string_split(name, '.')) >= 2 AND string_split(name, '.')[-1] = string_split(name, '.')[-2])
OR length(regexp_replace(text, '\\s', '', 'g')) < 150 OR len(list_filter(string_split(text, chr(10)),
lambda x: trim(x) <> '')) < 5 AS trivial, list_contains(tags, 'task') AS is_task, len(list_filter(tags, lambda d: lower(d) IN ('get', 'post'))) > 0 AS is_route, starts_with(name, 'a.') AS a, source IN ('src1', 'src2') AS one
FROM (SELECT doc_id, text, source, CASE doc_id % 4 WHEN 0 THEN 'a.b' || doc_id WHEN 1 THEN 'x y.z' WHEN 2 THEN 'm.run.run' ELSE 'a.anonymous_1_2' END AS name, CASE doc_id % 3 WHEN 0 THEN ['task'] WHEN 1 THEN ['GET', 'x'] ELSE [] END AS tags FROM documents)""")
def q_name_filters(spark, sf_dir):
    m = F.col("doc_id") % 4
    name = F.when(m == 0, F.concat(F.lit("a.b"), F.col("doc_id").cast("string"))).when(m == 1, "x y.z").when(m == 2, "m.run.run").otherwise("a.anonymous_1_2")
    tags = F.when(F.col("doc_id") % 3 == 0, F.array(F.lit("task"))).when(F.col("doc_id") % 3 == 1, F.array(F.lit("GET"), F.lit("x"))).otherwise(F.array().cast("array<string>"))
    d = table(spark, sf_dir, "documents").select("doc_id", "text", "source", name.alias("name"), tags.alias("tags"))
    plain = F.regexp_replace("text", r"[\x{A0}\x{2000}-\x{200A}]", "x")
    return d.select("doc_id", P.has_name_shape(F.col("name")).alias("shaped"), P.is_trivial(F.col("name"), plain).alias("trivial"), F.array_contains("tags", "task").alias("is_task"), F.exists("tags", lambda t: F.lower(t).isin("get", "post")).alias("is_route"), F.col("name").startswith("a.").alias("a"), F.col("source").isin("src1", "src2").alias("one"))


@R.query("""WITH p AS (SELECT p_partkey AS k, p_name, p_brand, 'proj.' || lower(p_type) || '.m' || p_size AS module FROM part),
t AS (SELECT *, p_brand || '::' || module AS crossed, 'r.' || module || '::module::summary' AS summary, p_name || ' >= 1.' || (k % 9) || ' ; x' AS req FROM p)
SELECT k, crossed, contains(crossed, '::') AS is_cross, summary, lower(trim(regexp_replace('-' || p_name || '..X', '[-_.]+', '_', 'g'), '_')) AS py, sha1(substring(repeat(p_name, 900),
1, 4096)) AS hash, sha256(p_name) AS file_hash, length(p_name || module) // 4 AS tokens,
'query: ' || p_name AS prefixed, coalesce(CASE WHEN k % 2 = 0 THEN 'about ' || p_name END, '[from ' || module || ']') AS prefix, regexp_extract(req, '^\\s*([A-Za-z0-9](?:[A-Za-z0-9._-]*[A-Za-z0-9])?)', 1) AS requirement,
strftime(to_timestamp(1700000000 + k) AT TIME ZONE 'UTC', '%Y-%m-%dT%H:%M:%SZ') AS at FROM t""")
def q_text_functions(spark, sf_dir):
    k = F.col("p_partkey")
    module = F.concat(F.lit("proj."), F.lower("p_type"), F.lit(".m"), F.col("p_size").cast("string"))
    p = table(spark, sf_dir, "part").select(k.alias("k"), "p_name", "p_brand", module.alias("module"))
    crossed = T.cross_repo_name(F.col("p_brand"), F.col("module"))
    req = F.concat("p_name", F.lit(" >= 1."), (F.col("k") % 9).cast("string"), F.lit(" ; x"))
    return p.select(
        "k", crossed.alias("crossed"), T.is_cross_repo(crossed).alias("is_cross"), T.summary_name(F.lit("r"), F.col("module"), F.lit("module")).alias("summary"), T.python_name(F.concat(F.lit("-"), "p_name", F.lit("..X"))).alias("py"),
        T.content_hash(F.repeat("p_name", 900)).alias("hash"), F.sha2("p_name", 256).alias("file_hash"), T.token_estimate(F.concat("p_name", "module")).alias("tokens"), T.role_prefixed(F.col("p_name"), "query: ").alias("prefixed"),
        T.context_prefix(F.when(F.col("k") % 2 == 0, F.concat(F.lit("about "), "p_name")), F.col("module")).alias("prefix"), T.requirement_name(req).alias("requirement"), T.iso_time(F.lit(1_700_000_000) + F.col("k")).alias("at"),
    )


@R.query("""WITH p AS (SELECT p_partkey AS k, ['a', 'b', 'c', 'd'][1:1 + p_partkey % 4] AS xs, ['a', 'b', 'x', 'd', 'e'][1:1 + p_size % 5] AS ys FROM part),
d AS (SELECT k, array_to_string(xs, '.') AS a, array_to_string(ys, '.') AS b, len(xs) AS n, len(ys) AS m, CASE WHEN xs[1:4] = ys[1:4] AND len(xs) = len(ys) THEN len(xs) WHEN len(xs) >= 2 AND len(ys) >= 2 THEN 2 ELSE 1 END AS same FROM p)
SELECT k, greatest(n, m) - same - CASE WHEN contains(b, '.') AND starts_with(a, regexp_replace(b, '\\.[^.]*$', '') || '.') THEN 1 ELSE 0 END AS distance FROM d""")
def q_import_distance(spark, sf_dir):
    xs = F.slice(F.array(*map(F.lit, "abcd")), F.lit(1), (1 + F.col("p_partkey") % 4).cast("int"))
    ys = F.slice(F.array(*map(F.lit, "abxde")), F.lit(1), (1 + F.col("p_size") % 5).cast("int"))
    p = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("k"), F.array_join(xs, ".").alias("a"), F.array_join(ys, ".").alias("b"))
    return p.select("k", T.import_distance(F.col("a"), F.col("b")).cast("long").alias("distance"))


@R.query("""WITH d AS (SELECT doc_id, text, lang, string_split(text, chr(10)) AS l FROM documents)
SELECT doc_id, CASE WHEN length(text) <= 120 THEN text WHEN contains(substring(text, 1, 120), chr(10)) THEN substring(text, 1, 120 - instr(reverse(substring(text, 1, 120)),
chr(10))) ELSE substring(text, 1, 120) END AS capped,
array_to_string(l[2:3], chr(10)) AS lines, substring('doc' || doc_id || chr(10) || text, 1, 600) AS lexical, substring('f/' || doc_id || chr(10) || array_to_string(l[1:120], chr(10)),
1, 6000) AS file,
'# Doc: p' || doc_id || chr(10) || '# Section: ' || lang || chr(10) || '# ---' || chr(10) || text AS embed, array_to_string(l[1:3], chr(10)) AS summary FROM d""")
def q_source_ranges(spark, sf_dir):
    i, text = F.col("doc_id").cast("string"), F.col("text")
    return table(spark, sf_dir, "documents").select(
        "doc_id", T.capped_snippet(text, 120).alias("capped"), chunks.source_range(text, F.lit(2), F.lit(3)).alias("lines"), chunks.lexical_document(F.concat(F.lit("doc"), i), F.lit(None).cast("string"), text, 600).alias("lexical"),
        chunks.lexical_file(F.concat(F.lit("f/"), i), text).alias("file"), chunks.markdown_embed_text(F.concat(F.lit("p"), i), F.col("lang"), text).alias("embed"), chunks.hydrated(text, 3).alias("summary"),
    )


@R.query("""WITH d AS (SELECT doc_id, doc_id % 4 AS n, CASE doc_id % 5 WHEN 0 THEN '[2] > [1]' WHEN 1 THEN '[9] [3] [3] none' WHEN 2 THEN '' ELSE '[4][1][2][3]' END AS a FROM documents),
s AS (SELECT *, list_filter(list_transform(regexp_extract_all(a, '\\[(\\d{1,9})\\]', 1), lambda x: CAST(x AS INTEGER)), lambda i: i >= 1 AND i <= n) AS said FROM d),
u AS (SELECT doc_id, n, list_filter(said, lambda x, i: list_position(said, x) = i) AS said FROM s)
SELECT doc_id, array_to_string(list_concat(said, list_filter(range(1, n + 1), lambda i: NOT list_contains(said, i))), ',') AS places,
CASE doc_id % 3 WHEN 0 THEN 'MATCH (n) RETURN n;' WHEN 1 THEN 'MATCH (n);' ELSE 'SELECT 1;' END AS query, CASE doc_id % 2 WHEN 0 THEN '{"a": "x//y", "b": 1}' ELSE '{"a": 2 }' END AS json FROM u""")
def q_answers(spark, sf_dir):
    d, i = table(spark, sf_dir, "documents"), F.col("doc_id")
    answer = F.when(i % 5 == 0, "[2] > [1]").when(i % 5 == 1, "[9] [3] [3] none").when(i % 5 == 2, "").otherwise("[4][1][2][3]")
    query = F.when(i % 3 == 0, "```cypher MATCH (n) RETURN n```").when(i % 3 == 1, "MATCH (n);").otherwise("`SELECT 1`")
    json = F.when(i % 2 == 0, '{"a": "x//y", "b": 1}').otherwise('{"a": 2 /* two */}')
    return d.select("doc_id", F.array_join(T.permutation(answer, (i % 4).cast("int")), ",").alias("places"), T.cleaned_query(query).alias("query"), T.uncommented_json(json).alias("json"))


@R.query("""SELECT c_custkey, CASE c_custkey % 5 WHEN 0 THEN 'org__repo' || c_custkey WHEN 1 THEN 'Org-1__r.x' WHEN 2 THEN 'o__r' || c_custkey WHEN 3 THEN 'base' || c_custkey ELSE 'base' || c_custkey END AS slug FROM customer""")
def q_slugs(spark, sf_dir):
    k = F.col("c_custkey")
    s = k.cast("string")
    url = F.when(k % 5 == 0, F.concat(F.lit("git@github.com:org/repo"), s, F.lit(".git"))).when(k % 5 == 1, "https://user:tok@github.com/Org-1/r.x/").when(k % 5 == 2, F.concat(F.lit("ssh://git@github.com/o/r"), s)).when(k % 5 == 3, F.concat(F.lit("https://example.com/o/r"), s)).otherwise("")
    return table(spark, sf_dir, "customer").select("c_custkey", tables.remote_slug(url, F.concat(F.lit("base"), s)).alias("slug"))


@R.query("""SELECT p_partkey AS k, CASE p_partkey % 3 WHEN 0 THEN 'requirements.txt' WHEN 1 THEN 'package.json' ELSE 'go.mod' END AS kind, unnest(CASE p_partkey % 3 WHEN 0 THEN ['dep' || p_partkey, 'other.pkg'] WHEN 1 THEN ['@s/d' || p_partkey, 'dev'] ELSE ['ex.com/m' || p_partkey] END) AS name,
unnest(CASE p_partkey % 3 WHEN 0 THEN ['>=1.' || p_size, ''] WHEN 1 THEN ['^' || p_size, '~2'] ELSE ['v1.' || p_size || '.0'] END) AS spec FROM part""")
def q_manifests(spark, sf_dir):
    k, n = F.col("p_partkey").cast("string"), F.col("p_size").cast("string")
    m = F.col("p_partkey") % 3
    kind = F.when(m == 0, "requirements.txt").when(m == 1, "package.json").otherwise("go.mod")
    text = (
        F.when(m == 0, F.concat(F.lit("# deps\ndep"), k, F.lit(">=1."), n, F.lit("\n-r x\nother.pkg ; python_version > '3'\n")))
        .when(m == 1, F.concat(F.lit('{"dependencies": {"@s/d'), k, F.lit('": "^'), n, F.lit('"}, "devDependencies": {"dev": "~2"}}')))
        .otherwise(F.concat(F.lit("module a\nrequire (\n\tex.com/m"), k, F.lit(" v1."), n, F.lit(".0\n)\n")))
    )
    files = table(spark, sf_dir, "part").select(F.concat(F.lit("r/"), k, F.lit("/"), kind).alias("path"), text.alias("text"))
    got = manifests.declared(files)
    return got.select(F.split("path", "/")[1].cast("long").alias("k"), F.split("path", "/")[2].alias("kind"), "name", F.col("version_spec").alias("spec"))


@R.query("""WITH f AS (SELECT DISTINCT source || '/d' || (doc_id % 3) || '/f' || doc_id || CASE WHEN doc_id % 3 = 0 THEN '.py' ELSE '.md' END AS path FROM documents), i AS (SELECT path FROM f
UNION ALL SELECT DISTINCT source || '/__init__.py' FROM documents WHERE lang = 'en'),
u AS (SELECT path, unnest(range(1, len(string_split(path, '/')) + 1)) AS n FROM i),
e AS (SELECT DISTINCT array_to_string(string_split(path, '/')[:n - 1], '/') AS parent, array_to_string(string_split(path, '/')[:n], '/') AS p, n = len(string_split(path, '/')) AS is_file FROM u),
l AS (SELECT *, CASE WHEN is_file THEN 'File' WHEN p || '/__init__.py' IN (SELECT path FROM i) THEN 'Package' ELSE 'Folder' END AS label FROM e)
SELECT 'CONTAINS_' || upper(label) AS rel, CASE WHEN parent = '' THEN 'proj' ELSE parent END AS src, p AS dst, label FROM l""")
def q_structure(spark, sf_dir):
    d = table(spark, sf_dir, "documents")
    s = lambda x: x.cast("string")
    files = d.select(F.concat("source", F.lit("/d"), s(F.col("doc_id") % 3), F.lit("/f"), s(F.col("doc_id")), F.when(F.col("doc_id") % 3 == 0, ".py").otherwise(".md")).alias("path")).distinct()
    inits = d.where("lang = 'en'").select(F.concat("source", F.lit("/__init__.py")).alias("path")).distinct()
    return python_source.structure(files.unionByName(inits), "proj")


# --- jobs and runs ------------------------------------------------------------------------------------

@R.query(f"WITH {SQL_LEDGER} SELECT count(*) FILTER (status IN ('queued', 'running')) AS active, count(*) FILTER (status IN ('queued', 'running') AND kind = 'click') AS clicks, count(*) FILTER (repo_slug = 'r3') AS total, count(*) FILTER (status = 'running') AS running FROM j")
def q_jobs_head(spark, sf_dir):
    jobs = ledger(spark, sf_dir)
    head = incremental.list_header(jobs, F.col("repo_slug") == "r3")
    a = incremental.active_count(jobs).withColumnRenamed("n", "active")
    b = incremental.active_count(jobs, "click").withColumnRenamed("n", "clicks")
    return a.join(b, how="cross").join(head, how="cross")  # one row each


@R.query("""WITH l AS (SELECT event_id AS id, user_id AS job_id, epoch_us(ts) AS ts, event_type AS kind FROM events WHERE ts < TIMESTAMP '2024-01-10'),
n AS (SELECT user_id AS job_id, epoch_us(ts) AS ts, event_type AS kind FROM events WHERE ts >= TIMESTAMP '2024-01-10'),
m AS (SELECT * FROM l UNION ALL SELECT (SELECT max(id) FROM l) + row_number() OVER (ORDER BY ts, job_id, kind), job_id, ts, kind FROM n)
SELECT id, job_id, ts, kind FROM m WHERE job_id = 7 ORDER BY ts, id LIMIT 30""")
def q_event_log(spark, sf_dir):
    e = table(spark, sf_dir, "events").select(F.col("event_id").alias("id"), F.col("user_id").alias("job_id"), F.unix_micros(F.col("ts").cast("timestamp")).alias("ts"), F.col("event_type").alias("kind"))
    cut = F.unix_micros(F.to_timestamp(F.lit("2024-01-10 00:00:00")))
    log = incremental.recorded(e.where(F.col("ts") < cut), e.where(F.col("ts") >= cut).drop("id"))
    return incremental.listed_events(log, 7, 30)


@R.query(f"""WITH {SQL_LEDGER}, r AS (SELECT DISTINCT 'r' || (c_custkey % 30) AS repo_slug FROM customer), l AS (SELECT repo_slug, max(updated_at) AS seen FROM j
WHERE status IN ('queued', 'running') GROUP BY 1)
SELECT repo_slug, CASE WHEN seen IS NULL THEN 'start' WHEN seen < 1706000000 - 864000 THEN 'preempt' ELSE 'conflict' END AS verdict, seen IS NULL AS admitted FROM r LEFT
JOIN l USING (repo_slug)""")
def q_start_requests(spark, sf_dir):
    jobs = ledger(spark, sf_dir)
    r = table(spark, sf_dir, "customer").select(F.concat(F.lit("r"), (F.col("c_custkey") % 30).cast("string")).alias("repo_slug")).distinct()
    admitted = incremental.admitted(r, jobs).withColumn("admitted", F.lit(True))
    out = incremental.preempted(r, jobs, F.lit(1_706_000_000.0), 864_000).join(admitted, "repo_slug", "left")
    return out.select("repo_slug", "verdict", F.coalesce("admitted", F.lit(False)).alias("admitted"))


@R.query(f"WITH {SQL_LEDGER} SELECT job_id FROM j WHERE status IN ('queued', 'running') AND (job_id % 50 NOT IN (SELECT n_nationkey FROM nation) OR updated_at < 1706140800 - 500000 OR started_at < 1706140800 - 900000)")
def q_expired(spark, sf_dir):
    jobs = ledger(spark, sf_dir).withColumn("pid", F.col("job_id") % 50)
    live = table(spark, sf_dir, "nation").select(F.col("n_nationkey").cast("long").alias("pid"))
    return incremental.expired(jobs, F.lit(1_706_140_800.0), live, 500_000, 900_000).select("job_id")


@R.query("""WITH r AS (SELECT 's' || o_custkey AS repo FROM orders), n AS (SELECT 's' || c_custkey AS old, CASE c_custkey % 4 WHEN 0 THEN 's' || c_custkey WHEN 1 THEN 's' || (c_custkey + 2) WHEN 2 THEN 'same' || (c_custkey // 8) ELSE 'new' || c_custkey END AS new FROM customer)
SELECT old, new, CASE WHEN old = new THEN 'canonical' WHEN count(*) OVER (PARTITION BY new) > 1 THEN 'clash' WHEN new IN (SELECT repo FROM r) THEN 'taken' ELSE 'rename' END AS verdict FROM n""")
def q_renamed_slugs(spark, sf_dir):
    k = F.col("c_custkey")
    s = lambda x: x.cast("string")
    rows = table(spark, sf_dir, "orders").select(F.concat(F.lit("s"), s(F.col("o_custkey"))).alias("repo"))
    new = F.when(k % 4 == 0, F.concat(F.lit("s"), s(k))).when(k % 4 == 1, F.concat(F.lit("s"), s(k + 2))).when(k % 4 == 2, F.concat(F.lit("same"), s(F.floor(k / 8)))).otherwise(F.concat(F.lit("new"), s(k)))
    names = table(spark, sf_dir, "customer").select(F.concat(F.lit("s"), s(k)).alias("old"), new.alias("new"))
    return incremental.renamed_slugs(rows, names).select("old", "new", "verdict")


@R.query("SELECT 'documents' AS resource, count(*) FILTER (source = 'src1') AS removed, CASE WHEN count(*) FILTER (source = 'src1') > 0 THEN 'deleted' ELSE 'absent' END AS status FROM documents UNION ALL SELECT 'customers', 0, 'absent'")
def q_delete_report(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").withColumn("repo", F.col("source"))
    customers = table(spark, sf_dir, "customer").withColumn("repo", F.col("c_mktsegment"))
    return incremental.deleted_report("src1", {"documents": docs, "customers": customers})


@R.query("""SELECT user_id, event_id, round((event_id * 0.25 + (event_id % 100) * 1.25) / 1e6, 9) AS usd, sum(event_id * 0.25 + (event_id % 100) * 1.25) OVER (PARTITION BY user_id ORDER BY event_id) / 1e6 <= 0.01 AS within FROM events""")
def q_costs(spark, sf_dir):
    e = table(spark, sf_dir, "events").select("user_id", "event_id", F.col("event_id").alias("input_tokens"), (F.col("event_id") % 100).alias("output_tokens"))
    return incremental.costs(e, "user_id", "event_id", 0.25, 1.25, 0.01).select("user_id", "event_id", F.round("usd", 9).alias("usd"), "within")


@R.query("SELECT user_id, event_id, event_type FROM (SELECT *, lag(event_type) OVER (PARTITION BY user_id ORDER BY event_id) AS b FROM events) WHERE b IS NULL OR b <> event_type")
def q_changed_progress(spark, sf_dir):
    return incremental.changed_progress(table(spark, sf_dir, "events"), "user_id", "event_id", ["event_type"]).select("user_id", "event_id", "event_type")


@R.query("""WITH h AS (SELECT user_id, event_type = 'purchase' AS ok, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS r FROM events)
SELECT user_id, coalesce(bool_or(r <= 1 AND ok), false) AS top1, coalesce(bool_or(r <= 5 AND ok), false) AS top5, bool_or(ok) AS topk FROM h GROUP BY user_id""")
def q_relevance(spark, sf_dir):
    from pyspark.sql import Window as W

    h = table(spark, sf_dir, "events").withColumn("r", F.row_number().over(W.partitionBy("user_id").orderBy("event_id")))
    return evaluation.relevance(h, "user_id", "r", F.col("event_type") == "purchase")


@R.query("SELECT c_custkey, c_acctbal AS before, c_acctbal - (c_custkey % 3) AS now FROM customer WHERE c_custkey % 3 > 0.5")
def q_regressions(spark, sf_dir):
    c = table(spark, sf_dir, "customer").select("c_custkey", F.col("c_acctbal").alias("v"))
    return evaluation.regressions(c.withColumn("v", F.col("v") - F.col("c_custkey") % 3), c, "c_custkey", "v", 0.5)


@R.query("""WITH s AS (SELECT DISTINCT l_orderkey AS task, l_partkey AS f, l_linenumber * 10 AS a, l_linenumber * 10 + 5 AS b FROM lineitem),
h AS (SELECT DISTINCT l_orderkey AS task, l_partkey AS f, l_linenumber * 10 + 4 AS a, l_linenumber * 10 + 8 AS b FROM lineitem WHERE l_returnflag = 'A')
SELECT task, round(count(*) FILTER (EXISTS (SELECT 1 FROM h WHERE h.task = s.task AND h.f = s.f AND h.a <= s.b AND h.b >= s.a)) / count(*), 4) AS coverage FROM s GROUP BY task""")
def q_span_coverage(spark, sf_dir):
    item = table(spark, sf_dir, "lineitem")
    n = F.col("l_linenumber") * 10
    spans = item.select(F.col("l_orderkey").alias("task"), F.col("l_partkey").alias("file_path"), n.alias("start_line"), (n + 5).alias("end_line"))
    hits = item.where("l_returnflag = 'A'").select(F.col("l_orderkey").alias("task"), F.col("l_partkey").alias("file_path"), (n + 4).alias("start_line"), (n + 8).alias("end_line"))
    return evaluation.span_coverage(hits, spans, "task").withColumn("coverage", F.round("coverage", 4))


@R.query(f"""WITH {SQL_NODES}, d AS (SELECT 'proj.' || p_name || '.c' || p_partkey || '::Symbol::card' AS card FROM part WHERE p_size > 10),
e AS (SELECT 'proj.' || p_name || '.c' || p_partkey || '::Symbol::card' AS card FROM part WHERE p_brand <> 'Brand#1')
SELECT card FROM e WHERE card IN (SELECT card FROM d)""")
def q_orphan_cards(spark, sf_dir):
    """Stored cards less those that are no longer wanted."""
    p = table(spark, sf_dir, "part").withColumn("card", F.concat(F.lit("proj."), "p_name", F.lit(".c"), F.col("p_partkey").cast("string"), F.lit(T.CARD_SUFFIX)))
    stored, wanted = p.where("p_brand <> 'Brand#1'").select("card"), p.where("p_size > 10").select("card")
    orphans = stored.join(wanted, "card", "left_anti")
    return tables.deleted(stored, orphans, ["card"])


@R.query("""WITH m AS (SELECT DISTINCT string_split(string_split(url, '/')[3], ':')[1] AS q FROM pages), x AS (SELECT q FROM m WHERE NOT starts_with(q, 'm.') AND NOT contains(q, '::')
ORDER BY q LIMIT 10000)
SELECT DISTINCT coalesce(CASE WHEN x.q IS NOT NULL THEN 'shared::' || m.q END, m.q) AS dst FROM m LEFT JOIN x USING (q)""")
def q_externals(spark, sf_dir):
    """Modules that are not a repository's own, rewired to those of another."""
    q = F.split(F.split("url", "/")[2], ":")[0]
    modules = table(spark, sf_dir, "pages").select(q.alias("qualified_name")).distinct()
    names = resolve.external_modules(modules, "m.").select(F.col("qualified_name").alias("old"), T.cross_repo_name(F.lit("shared"), F.col("qualified_name")).alias("new"))
    edges = modules.select(F.lit("app").alias("src"), F.col("qualified_name").alias("dst"))
    return resolve.rewired(edges, names).select("dst")
