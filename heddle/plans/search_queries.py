"""Queries on searches: semantic ranking, seeds and bundles, stored indexes and guards."""

from __future__ import annotations

from pyspark.sql import functions as F

from heddle.functions import predicates as P
from heddle.functions import text as T
from heddle.operators import graph, lexical, rank, segments, vector
from heddle.plans import search, trade
from heddle.plans.registry import Registry, quoted, scratch_folder, sql_array, sql_values, table, values
from heddle.plans.text_queries import BM25, COS, SEED, TERMS, seed_vector
from heddle.plans.trade import SQL_NODES, SQL_TRADES

R = Registry()


def doc_name(doc_id="doc_id"):
    """Names of the documents as symbols: some fixtures, tests, and cards of other symbols."""
    d = F.col(doc_id)
    s = lambda x: x.cast("string")
    plain = F.concat(F.lit("proj.s"), s(d % 5), F.lit(".n"), s(d))
    card = F.concat(F.lit("proj.s"), s(d % 5), F.lit(".n"), s(d - 5), F.lit(T.CARD_SUFFIX))
    return F.when(d % 13 == 0, F.concat(F.lit("proj.fixtures.n"), s(d))).when(d % 11 == 0, F.concat(F.lit("proj.tests.n"), s(d))).when(d % 17 == 0, card).otherwise(plain)


DOC_NAME = f"""CASE WHEN doc_id % 13 = 0 THEN 'proj.fixtures.n' || doc_id WHEN doc_id % 11 = 0 THEN 'proj.tests.n' || doc_id
WHEN doc_id % 17 = 0 THEN 'proj.s' || (doc_id % 5) || '.n' || (doc_id - 5) || '{T.CARD_SUFFIX}' ELSE 'proj.s' || (doc_id % 5) || '.n' || doc_id END"""
NOISE = """(list_has_any(string_split(q, '.'), ['fixtures', 'large-file', '__fixtures__']) OR string_split(q, '.')[-1] = string_split(q, '.')[-2]
OR len(list_filter(string_split(q, '.'), lambda p: regexp_matches(p, '^anonymous_[0-9]+_[0-9]+$'))) > 0)"""
FOLD = f"regexp_replace(q, '{T.CARD_SUFFIX}$', '')"


def store(spark, sf_dir) -> search.Store:
    docs = table(spark, sf_dir, "documents").withColumn("qualified_name", doc_name())
    e = table(spark, sf_dir, "embeddings").withColumnRenamed("vec_id", "doc_id")
    plain = docs.where(~F.col("qualified_name").endswith(T.CARD_SUFFIX) & (F.col("n_chars") > 200))
    top = docs.agg(F.max("n_chars").alias("_top"))
    ranks = plain.join(F.broadcast(top), how="cross").select("qualified_name", (F.col("n_chars") / F.col("_top")).alias("pagerank"))  # one row
    return search.Store(e.withColumn("qualified_name", doc_name()), ranks, docs.select("qualified_name", F.col("text").alias("content")), trade.edges(spark, sf_dir), docs.select("qualified_name", F.col("text").alias("source")))


@R.query(f"""WITH {BM25},
s AS (SELECT {DOC_NAME} AS q, score FROM (SELECT a.vec_id AS doc_id, {COS} AS score FROM embeddings a, embeddings b WHERE b.vec_id = {SEED}) ORDER BY score DESC, q LIMIT 1000),
v AS (SELECT {FOLD} AS q, max(score) AS score FROM s WHERE NOT {NOISE} GROUP BY 1),
c AS (SELECT {DOC_NAME} AS q, CAST(n_chars AS DOUBLE) / (SELECT max(n_chars) FROM documents) AS p FROM documents WHERE n_chars > 200 AND NOT ends_with({DOC_NAME}, '{T.CARD_SUFFIX}')),
u AS (SELECT q, CASE WHEN (SELECT count(*) FROM v JOIN c USING (q)) > 0 THEN 0.7 * score + 0.3 * coalesce(p, 0) ELSE score END AS score FROM v LEFT JOIN c USING (q)),
w AS (SELECT {FOLD} AS q, max(score) AS score FROM (SELECT {DOC_NAME} AS q, score FROM b ORDER BY score DESC, q LIMIT 1000) GROUP BY 1),
x AS (SELECT *, row_number() OVER (ORDER BY score DESC, q) AS ra FROM u), y AS (SELECT q, row_number() OVER (ORDER BY score DESC, q) AS rb FROM w)
SELECT q AS qualified_name, round(score, 4) AS score FROM x LEFT JOIN y USING (q) ORDER BY 1.0 / (60 + ra) + coalesce(1.0 / (60 + rb), 0) DESC, score DESC, q LIMIT 20""")
def q_semantic(spark, sf_dir):
    return search.semantic(store(spark, sf_dir), seed_vector(spark, sf_dir), TERMS, 20)


@R.query(f"""WITH {SQL_NODES}, h AS (SELECT vec_id AS k, score FROM (SELECT a.vec_id, {COS} AS score FROM embeddings a, embeddings b WHERE b.vec_id = {SEED}) ORDER BY score DESC, k LIMIT 300)
SELECT qualified_name, label, name, path, round(score, 4) AS score FROM h JOIN nodes ON qualified_name = 'star.Supplier.' || k""")
def q_hits_with_nodes(spark, sf_dir):
    hits = vector.top_k(table(spark, sf_dir, "embeddings"), seed_vector(spark, sf_dir), 300).select(trade.node("Supplier", "vec_id").alias("qualified_name"), "score")
    return graph.hits_with_nodes(hits, trade.nodes(spark, sf_dir)).withColumn("score", F.round("score", 4))


# The parts as functions of modules: label, name, module, qualified_name.
def code_nodes(spark, sf_dir, *more):
    k = F.col("p_partkey")
    s = lambda x: x.cast("string")
    place = F.when(k % 7 == 0, "web").when(k % 11 == 0, "tests").otherwise("src")
    module = F.concat(F.lit("proj."), place, F.lit("."), F.lower("p_type"), F.lit("."), F.regexp_replace("p_name", " ", "_"), F.lit("_"), s(F.col("p_size") % 3))
    verb = F.when(k % 5 == 0, "handle_").when(k % 23 == 0, "anonymous_").otherwise("run_")
    p = table(spark, sf_dir, "part").select(F.when(k % 2 == 0, "Function").otherwise("Method").alias("label"), F.concat(verb, s(k)).alias("name"), module.alias("module"), F.concat(F.lit("src/"), F.col("p_brand"), F.when(k % 3 == 0, ".md").otherwise(".py")).alias("path"), *more)
    return p.withColumn("qualified_name", F.concat_ws(".", "module", "name"))


CODE_NODES = """code AS MATERIALIZED (SELECT *, module || '.' || name AS q FROM (SELECT CASE WHEN p_partkey % 2 = 0 THEN 'Function' ELSE 'Method' END AS label,
CASE WHEN p_partkey % 5 = 0 THEN 'handle_' WHEN p_partkey % 23 = 0 THEN 'anonymous_' ELSE 'run_' END || p_partkey AS name,
'proj.' || CASE WHEN p_partkey % 7 = 0 THEN 'web' WHEN p_partkey % 11 = 0 THEN 'tests' ELSE 'src' END || '.' || lower(p_type) || '.' || replace(p_name, ' ', '_') || '_' || (p_size % 3) AS module,
'src/' || p_brand || CASE WHEN p_partkey % 3 = 0 THEN '.md' ELSE '.py' END AS path FROM part))"""
TASK = "Explain how the small widgets and red rings of the economy type work"
WORDS = ["small", "widgets", "widget", "rings", "ring", "economy", "type"]
MODULES = f"""k AS (SELECT {sql_array(WORDS)} AS k), m AS (SELECT DISTINCT module AS m FROM code),
h AS (SELECT m, len(list_filter(k, lambda x: contains(string_split(m, '.')[-1], x) OR contains(m, '.' || x))) AS hits, len(list_filter(k, lambda x: contains(m, x))) AS b FROM m, k),
o AS (SELECT q, m, CASE WHEN b >= 2 THEN b ELSE 0 END AS b FROM code JOIN h ON m = module
WHERE hits > 0 AND NOT regexp_matches(name, '^(anonymous_|iife_arrow_)') AND NOT contains(m, '.test') AND NOT contains(m, 'tests.')),
f1 AS (SELECT * FROM o WHERE NOT contains(m, '.web.') ORDER BY q LIMIT 100), f2 AS (SELECT * FROM o ORDER BY q LIMIT 100),
d1 AS (SELECT *, row_number() OVER (PARTITION BY m ORDER BY q) AS slot FROM f1), d2 AS (SELECT *, row_number() OVER (PARTITION BY m ORDER BY q) AS slot FROM f2),
e1 AS (SELECT q, 0 AS leg, row_number() OVER (ORDER BY slot, b DESC, CASE WHEN b > 0 THEN length(m) ELSE 0 END, m) AS i FROM d1 WHERE slot <= 5 QUALIFY i <= 25),
e2 AS (SELECT q, 1 AS leg, row_number() OVER (ORDER BY slot, b DESC, CASE WHEN b > 0 THEN length(m) ELSE 0 END, m) AS i FROM d2 WHERE slot <= 5 QUALIFY i <= 25),
mods AS (SELECT q, row_number() OVER (ORDER BY leg, i) - 1 AS place FROM (SELECT * FROM e1 UNION ALL SELECT * FROM e2 WHERE q NOT IN (SELECT q FROM e1)) QUALIFY place < 25)"""


@R.query(f"WITH {CODE_NODES}, {MODULES} SELECT q AS qualified_name, CAST(place AS INTEGER) AS place FROM mods")
def q_module_symbols(spark, sf_dir):
    s = store(spark, sf_dir)
    s.nodes = code_nodes(spark, sf_dir)
    return search.module_symbols(s, F.lit(TASK), 25)


@R.query(f"SELECT m AS module, CAST(len(list_filter({sql_array(WORDS)}, lambda x: contains(m, x))) AS INTEGER) AS hits FROM (WITH {CODE_NODES} SELECT DISTINCT module AS m FROM code) WHERE hits >= 2 ORDER BY hits DESC, length(m), m LIMIT 50")
def q_module_coverage(spark, sf_dir):
    words = spark.range(1).select(T.module_keywords(F.lit(TASK)).alias("k"))
    modules = code_nodes(spark, sf_dir).select("module").distinct().join(F.broadcast(words), how="cross")  # one row
    hits = F.size(F.filter("k", lambda k: F.lower("module").contains(k)))
    return modules.select("module", hits.alias("hits")).where("hits >= 2").orderBy(F.desc("hits"), F.length("module"), "module").limit(50)


ENTRY = """(regexp_matches(lower(string_split(module, '.')[-1]), 'route|cli|main|handler') OR starts_with(lower(name), 'handle_') OR starts_with(lower(name), 'create_') OR lower(name) = 'main')"""


@R.query(f"WITH {CODE_NODES} SELECT qualified_name, CAST(row_number() OVER (ORDER BY qualified_name) - 1 AS INTEGER) AS place FROM (SELECT DISTINCT q AS qualified_name FROM code WHERE {ENTRY} AND NOT regexp_matches(name, '^(anonymous_|iife_arrow_)') ORDER BY q LIMIT 10)")
def q_entry_points(spark, sf_dir):
    return search.entry_seeds(code_nodes(spark, sf_dir), 10)


# Lexical hits of the code: the parts by price.
def code_hits(spark, sf_dir):
    both = code_nodes(spark, sf_dir, "p_retailprice").select("qualified_name", F.col("path").alias("file_path"), F.col("p_retailprice").alias("score"))
    return rank.ranked(both.orderBy(F.desc("score"), "qualified_name").limit(200), "score", "qualified_name")


CODE_HITS = "hits AS (SELECT q, path, row_number() OVER (ORDER BY p_retailprice DESC, q) AS rank FROM code JOIN part ON p_partkey = CAST(regexp_extract(name, '([0-9]+)$', 1) AS BIGINT) QUALIFY rank <= 200)"
LEXICAL = """l1 AS (SELECT *, row_number() OVER (PARTITION BY path ORDER BY rank) AS f FROM hits),
l2 AS (SELECT *, ends_with(path, '.md') AS md, row_number() OVER (PARTITION BY ends_with(path, '.md') ORDER BY rank) AS j FROM l1 WHERE f <= 2),
l3 AS (SELECT q, rank FROM l2 WHERE NOT md OR j <= 6 ORDER BY rank LIMIT 12),
lex AS (SELECT q, row_number() OVER (ORDER BY rank, q) - 1 AS place FROM l3 WHERE NOT contains(lower(q), '.tests.') QUALIFY place < 6)"""


@R.query(f"WITH {CODE_NODES}, {CODE_HITS}, {LEXICAL} SELECT q AS qualified_name, CAST(place AS INTEGER) AS place FROM lex")
def q_lexical_seeds(spark, sf_dir):
    return search.lexical_seeds(code_hits(spark, sf_dir), 6)


# A semantic ranking of the code: the parts by size and price.
def code_ranking(spark, sf_dir):
    both = code_nodes(spark, sf_dir, "p_size", "p_retailprice").select("qualified_name", (1 - F.col("p_size") / 100.0 - F.col("p_retailprice") / 1e6).alias("score"))
    return rank.ranked(both.orderBy(F.desc("score"), "qualified_name").limit(100), "score", "qualified_name")


RANKED = "ranked AS (SELECT q, 1 - p_size / 100.0::DOUBLE - p_retailprice / 1e6 AS score, row_number() OVER (ORDER BY 1 - p_size / 100.0::DOUBLE - p_retailprice / 1e6 DESC, q) AS rank FROM code JOIN part ON p_partkey = CAST(regexp_extract(name, '([0-9]+)$', 1) AS BIGINT) QUALIFY rank <= 100)"
SEED_TASK = "Add small widgets to red rings and call run_1499 and handle_250"
SEED_WORDS = ["small", "widgets", "widget", "rings", "ring", "call", "run_1499", "handle_250"]


def seeds_sql(k: int, module_limit: int, lexical_limit: int) -> str:
    """Seeds with the legs exact, lexical and module."""
    mods = MODULES.replace(sql_array(WORDS), sql_array(SEED_WORDS)).replace("LIMIT 100", f"LIMIT {4 * module_limit}").replace("<= 25", f"<= {module_limit}").replace("< 25", f"< {module_limit}")
    lex = LEXICAL.replace("j <= 6", f"j <= {lexical_limit}").replace("LIMIT 12", f"LIMIT {2 * lexical_limit}").replace("place < 6", f"place < {lexical_limit}")
    return f"""WITH RECURSIVE {CODE_NODES}, {CODE_HITS}, {RANKED}, {mods}, {lex},
exact AS (SELECT q, row_number() OVER (ORDER BY q) - 1 AS place FROM (SELECT DISTINCT q FROM code
WHERE name IN (SELECT unnest(regexp_extract_all({quoted(SEED_TASK)}, '[A-Za-z_][A-Za-z0-9_]{{2,}}'))) ORDER BY q LIMIT {2 * k})),
top AS (SELECT max(score) AS t, max(CASE WHEN rank = {max(k // 2 - 1, 0) + 1} THEN score END) AS mid FROM ranked),
legs AS (SELECT 'exact' AS leg, q, place, t * 0.98 AS base FROM exact, top UNION ALL SELECT 'lexical', q, place, least(t * 0.975, mid * 1.0025) FROM lex, top
UNION ALL SELECT 'module', q, place, least(t * 0.97, mid * 1.002) FROM mods, top),
merged AS (SELECT q, max(score) * CASE WHEN contains(lower(q), '.tests.') THEN 0.4 ELSE 1 END AS score FROM (SELECT q, score FROM ranked WHERE rank <= {2 * k}
UNION ALL SELECT q, base * (1 - place * 1e-4) FROM legs) GROUP BY q),
cap AS (SELECT least(greatest({k}, (SELECT count(*) FROM legs)), {2 * k}) AS cap, (SELECT count(*) FROM mods) AS boosts),
sure AS (SELECT q FROM lex UNION SELECT q FROM mods, cap WHERE place < least(boosts, greatest(cap // 3, 6))),
head AS (SELECT q, score FROM merged WHERE q NOT IN (SELECT q FROM sure) QUALIFY row_number() OVER (ORDER BY score DESC, q) <= (SELECT least(cap, greatest({2 * k} - (SELECT count(*)
FROM sure), 1)) FROM cap)),
seeds AS MATERIALIZED (SELECT q, score, 0 AS part FROM head UNION ALL SELECT q, score, 1 FROM merged WHERE q IN (SELECT q FROM sure))"""


@R.query(seeds_sql(12, 15, 6) + " SELECT q AS qualified_name, round(score, 6) AS score, part FROM seeds")
def q_bundle_seeds(spark, sf_dir):
    s = store(spark, sf_dir)
    s.nodes = code_nodes(spark, sf_dir)
    got = search.bundle_seeds(s, code_ranking(spark, sf_dir), SEED_TASK, 12, search.INTENT_SETTINGS["design"], code_hits(spark, sf_dir))
    return got.withColumn("score", F.round("score", 6))


# Calls between the parts: each calls the ones with keys near a seventh, a half and twice of its own.
def code_edges(spark, sf_dir):
    n = code_nodes(spark, sf_dir).select(F.regexp_extract("name", "([0-9]+)$", 1).cast("long").alias("k"), F.col("qualified_name"))
    calls = n.select("k", F.col("qualified_name").alias("src"), F.explode(F.array(F.floor(F.col("k") / 7), F.floor(F.col("k") / 2), F.col("k") * 2)).alias("to"))
    ends = n.select(F.col("k").alias("to"), F.col("qualified_name").alias("dst")).hint("merge")  # names are far longer than Spark's estimate from the file, so none is broadcast
    return calls.join(ends, "to").where("src <> dst").select("src", "dst").distinct()


CODE_EDGES = """ck AS MATERIALIZED (SELECT CAST(regexp_extract(name, '([0-9]+)$', 1) AS BIGINT) AS k, q FROM code),
ce AS MATERIALIZED (SELECT DISTINCT a.q AS src, b.q AS dst FROM (SELECT q, unnest([k // 7, k // 2, k * 2]) AS t FROM ck) a JOIN ck b ON b.k = a.t WHERE a.q <> b.q)"""
IS_TEST = "regexp_matches({0}, '\\.tests\\.|\\.test\\.|\\.spec\\.|\\.test$')"
REFILL = """ord AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY bundle ORDER BY depth, score DESC, q) AS i FROM gone),
fill(bundle, i, room, took, q) AS (SELECT bundle, 0::BIGINT, room, false, '' FROM rooms UNION ALL
SELECT f.bundle, o.i, CASE WHEN o.cost <= f.room THEN f.room - o.cost ELSE f.room END, o.cost <= f.room, o.q FROM fill f JOIN ord o ON o.bundle = f.bundle AND o.i = f.i + 1)"""


def budget_sql(budget: int) -> str:
    """From sym(bundle, q, depth, score, cost): kept(bundle, q)."""
    return f"""lay AS (SELECT bundle, depth, sum(sum(cost)) OVER (PARTITION BY bundle ORDER BY depth) AS upto FROM sym GROUP BY bundle, depth),
deep AS (SELECT bundle, coalesce(max(depth) FILTER (upto <= {budget}), 0) AS d, coalesce(bool_or(depth = 0 AND upto > {budget}), false) AS over FROM lay GROUP BY bundle),
shrt AS (SELECT bundle, q, cost FROM (SELECT s.bundle, s.q, s.cost, sum(s.cost) OVER (PARTITION BY s.bundle ORDER BY length(s.q), s.q DESC ROWS UNBOUNDED PRECEDING) AS upto FROM sym s
JOIN deep USING (bundle) WHERE over AND s.depth = 0) WHERE upto <= {budget}),
first AS MATERIALIZED (SELECT s.bundle, s.q, s.cost FROM sym s JOIN deep USING (bundle) WHERE NOT over AND depth <= d UNION ALL SELECT * FROM shrt),
rooms AS MATERIALIZED (SELECT bundle, {budget} - coalesce((SELECT sum(cost) FROM first f WHERE f.bundle = d.bundle), 0) AS room FROM deep d),
gone AS (SELECT s.* FROM sym s WHERE NOT EXISTS (SELECT 1 FROM first f WHERE f.bundle = s.bundle AND f.q = s.q)), {REFILL},
kept AS (SELECT bundle, q FROM first UNION ALL SELECT bundle, q FROM fill WHERE took)"""


@R.query(seeds_sql(12, 15, 6) + f""", {CODE_EDGES},
up AS (SELECT DISTINCT src AS q FROM (SELECT src, row_number() OVER (PARTITION BY dst ORDER BY src) AS k FROM ce WHERE dst IN (SELECT q FROM seeds) AND NOT {IS_TEST.format('src')})
WHERE k <= 3),
z0 AS MATERIALIZED (SELECT q, 0 AS depth FROM seeds), z1 AS MATERIALIZED (SELECT q, 1 AS depth FROM up WHERE q NOT IN (SELECT q FROM z0)),
h1 AS MATERIALIZED (SELECT DISTINCT dst AS q, 1 AS depth FROM ce WHERE src IN (SELECT q FROM z0 UNION ALL SELECT q FROM z1) AND dst NOT IN (SELECT q FROM z0 UNION ALL SELECT q
FROM z1) AND NOT {IS_TEST.format('dst')}),
h2 AS MATERIALIZED (SELECT DISTINCT dst AS q, 2 AS depth FROM ce WHERE src IN (SELECT q FROM h1) AND dst NOT IN (SELECT q FROM z0 UNION ALL SELECT q FROM z1 UNION ALL SELECT q
FROM h1) AND NOT {IS_TEST.format('dst')}),
reach AS MATERIALIZED (SELECT * FROM z0 UNION ALL SELECT * FROM z1 UNION ALL SELECT * FROM h1 UNION ALL SELECT * FROM h2),
fl AS (SELECT min(score) AS f FROM seeds),
p1 AS MATERIALIZED (SELECT dst AS q, least(max(score) * 0.5, 0.99 * any_value(f)) AS score FROM ce JOIN seeds ON src = seeds.q, fl WHERE dst IN (SELECT q FROM reach WHERE depth = 1)
GROUP BY dst),
p2 AS MATERIALIZED (SELECT dst AS q, least(max(score) * 0.5, 0.99 * any_value(f)) AS score FROM ce JOIN (SELECT q, score FROM seeds UNION ALL SELECT q, score
FROM p1) u ON src = u.q, fl WHERE dst IN (SELECT q FROM reach WHERE depth = 2) GROUP BY dst),
scores AS (SELECT q, score FROM seeds UNION ALL SELECT * FROM p1 UNION ALL SELECT * FROM p2),
src AS (SELECT q, 30 * (k % 400) AS n FROM ck),
sym AS MATERIALIZED (SELECT 0 AS bundle, r.q, r.depth, coalesce(score, 0) AS score, (least(coalesce(n, 0), 2000) + length(r.q)) // 4 + 1 AS cost FROM reach r LEFT JOIN scores USING (q)
LEFT JOIN src USING (q)),
{budget_sql(12_000)}
SELECT q AS qualified_name, CAST(depth AS INTEGER) AS depth, round(score, 6) AS score, CAST(cost AS BIGINT) AS cost, q IN (SELECT q FROM kept) AS kept FROM sym""")
def q_context_bundle(spark, sf_dir):
    s = store(spark, sf_dir)
    s.nodes, s.edges = code_nodes(spark, sf_dir), code_edges(spark, sf_dir)
    key = F.regexp_extract("name", "([0-9]+)$", 1).cast("int")
    s.sources = s.nodes.select("qualified_name", F.repeat(F.lit("x"), key % 400 * 30).alias("source"))
    got = search.context_bundle(s, code_ranking(spark, sf_dir), SEED_TASK, hits=code_hits(spark, sf_dir))
    return got.withColumn("score", F.round("score", 6))


@R.query(f"""WITH RECURSIVE sym AS MATERIALIZED (SELECT source AS bundle, 'doc.' || doc_id AS q, doc_id % 4 AS depth, (doc_id % 17) / 17.0::DOUBLE AS score, (length(text) + length('doc.' || doc_id)) // 4 + 1 AS cost FROM documents), {budget_sql(3000)}
SELECT bundle, q AS qualified_name, CAST(cost AS BIGINT) AS cost, (bundle, q) IN (SELECT (bundle, q) FROM kept) AS kept FROM sym""")
def q_budget_truncate(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    symbols = docs.select(F.col("source").alias("bundle"), F.concat(F.lit("doc."), F.col("doc_id").cast("string")).alias("qualified_name"), (F.col("doc_id") % 4).cast("int").alias("depth"), ((F.col("doc_id") % 17) / 17.0).alias("score"), F.length("text").alias("snippet_length"))
    return graph.budgeted(symbols, 3000, "bundle")


@R.query(f"""WITH t AS (SELECT conv_id, turn, CASE {' '.join(f"WHEN regexp_matches(text, {quoted('(?i)' + '|'.join(f'(?:{p})' for p in ps))}) THEN {quoted(n)}" for n, ps in T.INTENTS)} ELSE 'symbol' END AS intent
FROM (SELECT conv_id, turn, CASE WHEN turn % 3 = 0 THEN 'Explain ' WHEN turn % 3 = 1 THEN 'Add ' ELSE '' END || text AS text FROM conversations)),
s AS (SELECT * FROM {sql_values([(n, *v.values()) for n, v in search.INTENT_SETTINGS.items()], 'intent, ' + ', '.join(next(iter(search.INTENT_SETTINGS.values()))))})
SELECT conv_id, turn, intent, CAST(k AS INTEGER) AS k, CAST(depth AS INTEGER) AS depth, CAST(snippet_cap AS INTEGER) AS snippet_cap, exclude_tests FROM t JOIN s USING (intent)""")
def q_intent_settings(spark, sf_dir):
    names = list(next(iter(search.INTENT_SETTINGS.values())))
    kinds = ", ".join(f"{n} {'boolean' if n == 'exclude_tests' else 'int'}" for n in names)
    settings = values(spark, [(n, *v.values()) for n, v in search.INTENT_SETTINGS.items()], f"intent string, {kinds}")
    text = F.concat(F.when(F.col("turn") % 3 == 0, "Explain ").when(F.col("turn") % 3 == 1, "Add ").otherwise(""), F.col("text"))
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", T.intent(text).alias("intent"))
    return turns.join(F.broadcast(settings), "intent").select("conv_id", "turn", "intent", "k", "depth", "snippet_cap", "exclude_tests")  # four rows


TOKENS = "list_transform(regexp_extract_all(translate(coalesce({0}, ''), '._', '  '), '[A-Za-z][A-Za-z0-9]+'), lambda x: lower(x))"


@R.query(f"""WITH f AS (SELECT doc_id, 'text' AS field, {TOKENS.format('text')} AS t FROM documents WHERE lang = 'en' UNION ALL SELECT doc_id, 'source', {TOKENS.format('source')} FROM documents
WHERE lang = 'en'),
n AS (SELECT field, count(*) AS n, avg(len(t)) AS a FROM f GROUP BY field),
p AS (SELECT doc_id, field, term, len(t) AS dl, len(list_filter(t, lambda x: x = term)) AS tf
FROM f, (SELECT unnest({sql_array(["the", "thea", "ther", "ci", "nes", "heitver", "licensed", "src1"])}) AS term)),
d AS (SELECT field, term, count(*) AS df FROM p WHERE tf > 0 GROUP BY ALL)
SELECT doc_id, round(sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * dl / a))), 4) AS score FROM p JOIN d USING (field, term) JOIN n USING (field)
WHERE tf > 0 GROUP BY doc_id ORDER BY sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * dl / a))) DESC, doc_id LIMIT 50""")
def q_index_search(spark, sf_dir):
    """A stored index that has seen additions, replacements, deletions and a merge, searched for one repository."""
    index = segments.SegmentedIndex(spark, scratch_folder(spark, "index"), ["text", "source"], "doc_id", "lang", "long")
    docs = table(spark, sf_dir, "documents")
    stale = docs.withColumn("text", F.concat_ws(" ", F.lit("the thea ther"), F.substring("text", 1, 100)))
    extra = docs.where("n_chars > 2000").withColumn("doc_id", -1 - F.col("doc_id"))
    index.add(docs.where("n_chars > 500").unionByName(extra))
    index.add(stale.where("n_chars <= 500"))
    index.add(docs.where("n_chars <= 500"))
    index.remove(extra)
    index.merge(2)
    found = index.search(" ".join(['"', *TERMS, 'src1"']), 50, repo="en")
    return found.hits.select(F.col("key").alias("doc_id"), F.round("score", 4).alias("score"))


@R.query(f"""WITH {SQL_NODES}, {SQL_TRADES}, d AS (SELECT dst AS q, count(*) AS n FROM trades GROUP BY dst), t AS (SELECT q, n / 1000.0::DOUBLE AS p FROM d ORDER BY p DESC, q LIMIT 40)
SELECT q AS qualified_name, round(p, 4) AS pagerank, path AS file_path, start_line, end_line FROM t JOIN nodes ON qualified_name = q""")
def q_central(spark, sf_dir):
    """Ranks stored for a repository, cleared, stored again and read, with their places."""
    from heddle.sources import tables

    path = scratch_folder(spark, "centrality")
    ranks = trade.trades(spark, sf_dir).groupBy(F.col("dst").alias("qualified_name")).agg((F.count("*") / F.lit(1000.0)).alias("pagerank")).withColumn("computed_at", F.timestamp_seconds(F.lit(1_700_000_000)))
    tables.centrality_written(ranks, path, "r1")
    tables.centrality_cleared(spark, path, "r1")
    tables.centrality_written(ranks, path, "r1")
    top = graph.central(tables.centrality_read(spark, path, "r1"), 40, trade.nodes(spark, sf_dir))
    return top.select("qualified_name", F.round("pagerank", 4).alias("pagerank"), "file_path", "start_line", "end_line")


@R.query("""WITH t AS (SELECT o_custkey AS k, count(*) AS n, '2023-11-' || lpad(CAST(1 + o_custkey % 28 AS VARCHAR), 2, '0') AS day FROM orders GROUP BY o_custkey
ORDER BY n DESC, 'c' || o_custkey LIMIT 25)
SELECT k, c_name AS name, CAST(n AS BIGINT) AS n, day, (SELECT max(day) FROM t) AS last_computed FROM t JOIN customer ON c_custkey = k""")
def q_central_latest(spark, sf_dir):
    """The latest time of the rows shown, not of all."""
    n = table(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("k")).agg(F.count("*").alias("n"))
    day = F.concat(F.lit("2023-11-"), F.lpad((1 + F.col("k") % 28).cast("string"), 2, "0"))
    ranks = n.select(F.concat(F.lit("c"), F.col("k").cast("string")).alias("qualified_name"), F.col("n").cast("double").alias("pagerank"), day.alias("computed_at"))
    top = graph.central(ranks, 25).withColumn("k", F.expr("cast(substring(qualified_name, 2) as bigint)"))
    names = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("k"), F.col("c_name").alias("name"))
    day = F.concat(F.lit("2023-11-"), F.lpad((1 + F.col("k") % 28).cast("string"), 2, "0"))
    return top.join(names, "k").select("k", "name", F.col("pagerank").cast("long").alias("n"), day.alias("day"), F.col("last_computed_at").alias("last_computed"))


# Query texts around a page's address, which is a path to some and a string to others.
STATEMENTS = (
    "SELECT * FROM text.`{}`", "SELECT a.x FROM pages a JOIN parquet . `{}` b USING (url)", "SELECT * FROM pages /* csv.`{}` */ WHERE url = 'FROM json.`{}`'", "SELECT (SELECT max(value) FROM `binaryFile`.`{}`) FROM pages",
    "MERGE INTO pages USING csv.`{}` t ON true WHEN MATCHED THEN DELETE", "SELECT count(*) FROM pages, orc.`{}` WHERE true", "WITH text AS (SELECT url FROM pages) SELECT text.url FROM text -- json.`{}`",
)


@R.query(f"""WITH t AS (SELECT page_id, n, replace(s, '{{}}', url) AS q FROM pages, {sql_values(list(enumerate(STATEMENTS)), 'n, s')}),
b AS (SELECT page_id, n, regexp_replace(q, '''(?:[^''\\\\]|\\\\.)*''|"(?:[^"\\\\]|\\\\.)*"', '''''', 'g') AS q FROM t)
SELECT page_id, n, CASE WHEN regexp_matches(q, {quoted(P.WRITES)}) THEN 'word' WHEN regexp_matches(regexp_replace(q, {quoted(P.COMMENTS)}, ' ', 'g'), {quoted(P.FILE_RELATION)}) THEN 'relation' ELSE 'allowed' END AS verdict FROM b""")
def q_guard_statements(spark, sf_dir):
    """Query texts made of pages and why they would be refused; none is run."""
    texts = F.array(*[F.replace(F.lit(s), F.lit("{}"), F.col("url")) for s in STATEMENTS])
    q = table(spark, sf_dir, "pages").select("page_id", F.posexplode(texts).alias("n", "q"))
    return q.select("page_id", "n", F.when(P.has_write_word(F.col("q")), "word").when(P.names_file(F.col("q")), "relation").otherwise("allowed").alias("verdict"))


@R.query(f"""WITH t AS (SELECT page_id, CASE page_id % 7 WHEN 0 THEN 'MATCH (n) SET n.x = 1 RETURN n' WHEN 1 THEN 'MATCH (n) WHERE n.url = ''' || url || ''' RETURN n.a AS one, n.b AS two' WHEN 2 THEN 'CREATE /* x */ INDEX ON :A(b)'
WHEN 3 THEN 'MATCH (n) WHERE n.x = "DELETE me" RETURN n' WHEN 4 THEN 'LOAD // c' || chr(10) || ' CSV FROM ''' || url || '''' WHEN 5 THEN 'MATCH (reset) RETURN reset.settings AS offset' ELSE 'call x() yield y' END AS q FROM pages)
SELECT page_id, regexp_matches(regexp_replace(q, '''(?:[^''\\\\]|\\\\.)*''|"(?:[^"\\\\]|\\\\.)*"', '''''', 'g'),
{quoted(P.WRITES)}) AS writes, regexp_matches(q, {quoted(P.GENERATED_WRITES)}) AS generated_writes FROM t""")
def q_write_words(spark, sf_dir):
    url, m = F.col("url"), F.col("page_id") % 7
    q = (
        F.when(m == 0, "MATCH (n) SET n.x = 1 RETURN n").when(m == 1, F.concat(F.lit("MATCH (n) WHERE n.url = '"), url, F.lit("' RETURN n.a AS one, n.b AS two"))).when(m == 2, "CREATE /* x */ INDEX ON :A(b)")
        .when(m == 3, 'MATCH (n) WHERE n.x = "DELETE me" RETURN n').when(m == 4, F.concat(F.lit("LOAD // c\n CSV FROM '"), url, F.lit("'"))).when(m == 5, "MATCH (reset) RETURN reset.settings AS offset").otherwise("call x() yield y")
    )
    return table(spark, sf_dir, "pages").select("page_id", P.has_write_word(q).alias("writes"), P.has_generated_write_word(q).alias("generated_writes"))


@R.query("SELECT o_orderkey AS b, o_custkey AS a, true AS has_more FROM orders ORDER BY o_custkey, o_orderkey LIMIT 40 OFFSET 60")
def q_page_by_alias(spark, sf_dir):
    """A page in the order of the names that a query text gives its columns."""
    by = search.return_aliases("WITH x AS y MATCH (o) RETURN o.cust AS a, o.key AS b, o.cust AS a")
    rows = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("b"), F.col("o_custkey").alias("a"))
    page, more = graph.paged(rows, 60, 40, by)
    return page.withColumn("has_more", F.lit(more))
