"""Queries on vectors, lexical ranking, fusion and text."""

from __future__ import annotations

from pyspark.sql import functions as F

from heddle.functions import predicates as P
from heddle.functions import text as T
from heddle.operators import chunks, evaluation, lexical, rank, vector
from heddle.operators.rank import LEAST_DEEP
from heddle.plans.registry import Registry, quoted, sql_array, sql_list, sql_values, table, values

R = Registry()

#: Vector queries start from stored rows with these keys.
SEED = 7
TERMS = ["the", "thea", "ther", "ciónes", "heitver", "licensed"]
DOC_TOKENS = "list_transform(regexp_extract_all(translate(coalesce(text, ''), '._', '  '), '[A-Za-z][A-Za-z0-9]+'), lambda x: lower(x))"
UNIT = "list_transform(embedding, lambda x: CAST(x AS DOUBLE))"
COS = "list_cosine_similarity(CAST(a.embedding AS DOUBLE[]), CAST(b.embedding AS DOUBLE[]))"


def seed_vector(spark, sf_dir, key=SEED):
    return table(spark, sf_dir, "embeddings").where(F.col("vec_id") == key).select("embedding").first()[0]


@R.query(f"""WITH s AS (SELECT a.vec_id, {COS} AS score FROM embeddings a, embeddings b WHERE b.vec_id = {SEED})
SELECT vec_id, round(score, 4) AS score, CAST(row_number() OVER (ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM s ORDER BY score DESC, vec_id LIMIT 20""")
def q_cosine_topk(spark, sf_dir):
    return vector.top_k(table(spark, sf_dir, "embeddings"), seed_vector(spark, sf_dir), 20).withColumn("score", F.round("score", 4))


@R.query(f"SELECT a.vec_id, round({COS}, 4) AS score FROM embeddings a, embeddings b WHERE b.vec_id = {SEED} AND a.vec_id <> {SEED} ORDER BY {COS} DESC, a.vec_id LIMIT 10")
def q_knn_of_row(spark, sf_dir):
    return vector.neighbours(table(spark, sf_dir, "embeddings"), SEED, 10).withColumn("score", F.round("score", 4))


@R.query("SELECT label, CAST(count(*) AS BIGINT) AS n FROM embeddings WHERE len(embedding) = 64 GROUP BY label")
def q_dim_guard(spark, sf_dir):
    e = vector.preferred(table(spark, sf_dir, "embeddings").withColumn("embedding_v2", F.when(F.col("vec_id") % 2 == 0, F.col("embedding"))))
    return vector.guarded(e, 64).groupBy("label").agg(F.count("*").alias("n"))


@R.query("""WITH u AS (SELECT label, unnest(embedding) AS x, unnest(range(0, 64)) AS place FROM embeddings)
SELECT label, CAST(place AS INTEGER) AS place, round(avg(CAST(x AS DOUBLE)), 4) AS mean FROM u GROUP BY label, place""")
def q_centroid_by_label(spark, sf_dir):
    means = vector.mean_vectors(table(spark, sf_dir, "embeddings"), ["label"])
    rounded = F.round("mean", 4)
    out = means.select("label", F.posexplode("centroid").alias("place", "mean"))
    return out.withColumn("mean", F.when(rounded == 0, F.col("mean") * 0.0).otherwise(rounded))  # SQL keeps the sign of zero


@R.query(f"SELECT term, CAST(count(*) AS BIGINT) AS tf, CAST(count(DISTINCT doc_id) AS BIGINT) AS df FROM (SELECT doc_id, unnest({DOC_TOKENS}) AS term FROM documents) GROUP BY term")
def q_tokens(spark, sf_dir):
    p = lexical.postings(table(spark, sf_dir, "documents"), "doc_id", "text")
    return p.groupBy("term").agg(F.sum("tf").alias("tf"), F.count("*").alias("df"))


BM25 = f"""d AS MATERIALIZED (SELECT doc_id, source, {DOC_TOKENS} AS t FROM documents),
n AS (SELECT count(*) AS n, avg(len(t)) AS a FROM d),
q AS (SELECT unnest({sql_array(TERMS)}) AS term),
p AS MATERIALIZED (SELECT doc_id, term, len(t) AS dl, len(list_filter(t, lambda x: x = term)) AS tf FROM d, q),
f AS (SELECT term, count(*) FILTER (tf > 0) AS df FROM p GROUP BY term),
b AS (SELECT doc_id, sum(ln(1 + (n.n - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * dl / n.a))) AS score FROM p JOIN f USING (term), n WHERE tf > 0 GROUP BY doc_id)"""


@R.query(f"WITH {BM25} SELECT doc_id, round(score, 4) AS score FROM b ORDER BY score DESC, doc_id LIMIT 50")
def q_bm25_topk(spark, sf_dir):
    scored = lexical.bm25(table(spark, sf_dir, "documents"), TERMS)
    return lexical.top_documents(scored, 50).select("doc_id", F.round("score", 4).alias("score"))


@R.query(f"""WITH {BM25}, r AS (SELECT doc_id, source, row_number() OVER (ORDER BY score DESC, doc_id) AS rank FROM b JOIN documents USING (doc_id) QUALIFY rank <= 100),
c AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY rank) AS k, source LIKE '%1' AS md FROM r),
m AS (SELECT *, row_number() OVER (PARTITION BY md ORDER BY rank) AS j FROM c WHERE k <= 2)
SELECT doc_id, source, CAST(rank AS INTEGER) AS rank FROM m WHERE NOT md OR j <= 6 ORDER BY rank LIMIT 12""")
def q_lexical_quota(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    top = lexical.top_documents(lexical.bm25(docs, TERMS), 100).join(docs.select("doc_id", "source"), "doc_id")
    return lexical.quota(top, 12, "source", F.col("source").endswith("1"), "doc_id").select("doc_id", "source", "rank")


@R.query(f"""WITH s AS (SELECT a.vec_id AS doc_id, {COS} AS score FROM embeddings a, embeddings b WHERE b.vec_id = {SEED}),
p AS (SELECT doc_id, CAST(n_chars AS DOUBLE) / max(n_chars) OVER () AS pagerank FROM documents WHERE doc_id IN (SELECT doc_id FROM labels))
SELECT doc_id, round(0.7 * score + 0.3 * coalesce(pagerank, 0), 4) AS fused FROM s LEFT JOIN p USING (doc_id)""")
def q_linear_fusion(spark, sf_dir):
    return fused(spark, sf_dir).select("doc_id", F.round("fused", 4).alias("fused"))


def fused(spark, sf_dir):
    q = F.array(*[F.lit(float(x)) for x in seed_vector(spark, sf_dir)])
    semantic = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("doc_id"), vector.cosine(F.col("embedding"), q).alias("score"))
    labelled = table(spark, sf_dir, "labels").select("doc_id").distinct()
    docs = table(spark, sf_dir, "documents").join(labelled, "doc_id", "left_semi")  # documents without a label have no pagerank
    top = docs.agg(F.max("n_chars").alias("_top"))
    central = docs.join(F.broadcast(top), how="cross").select("doc_id", (F.col("n_chars") / F.col("_top")).alias("pagerank"))  # one row
    return rank.linear_fusion(semantic, central, "doc_id")


@R.query(f"""WITH {BM25}, s AS (SELECT a.vec_id AS doc_id, {COS} AS score FROM embeddings a, embeddings b WHERE b.vec_id = {SEED}),
x AS (SELECT doc_id, row_number() OVER (ORDER BY score DESC, doc_id) AS ra FROM s QUALIFY ra <= {LEAST_DEEP}),
y AS (SELECT doc_id, row_number() OVER (ORDER BY score DESC, doc_id) AS rb FROM b QUALIFY rb <= {LEAST_DEEP})
SELECT doc_id, round(1.0 / (60 + ra) + coalesce(1.0 / (60 + rb), 0), 6) AS rrf FROM x LEFT JOIN y USING (doc_id)""")
def q_rrf(spark, sf_dir):
    q = F.array(*[F.lit(float(x)) for x in seed_vector(spark, sf_dir)])
    semantic = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("doc_id"), vector.cosine(F.col("embedding"), q).alias("score"))
    near = semantic.orderBy(F.desc("score"), "doc_id").limit(LEAST_DEEP)  # the over-fetch of a short search
    best = lexical.bm25(table(spark, sf_dir, "documents"), TERMS).orderBy(F.desc("score"), "doc_id").limit(LEAST_DEEP)
    found = rank.reciprocal_ranks(near, best, "doc_id")
    return found.select("doc_id", F.round("rrf", 6).alias("rrf"))


@R.query("SELECT source || '.doc' AS name, max(n_chars) AS score FROM documents GROUP BY source")
def q_fold_max(spark, sf_dir):
    name = F.concat("source", F.lit(".doc"), F.when(F.col("doc_id") % 3 == 0, T.CARD_SUFFIX).otherwise(""))
    scored = table(spark, sf_dir, "documents").select(name.alias("name"), F.col("n_chars").alias("score"))
    return rank.folded(scored, T.folded_card(F.col("name")), "name")


@R.query("""WITH r AS (SELECT source, lang, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS slot, doc_id FROM documents)
SELECT doc_id, source, CAST(slot AS INTEGER) AS slot FROM r WHERE slot <= 5 ORDER BY slot, source, doc_id LIMIT 40""")
def q_round_robin_cap(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    return rank.round_robin(docs, "source", "source", "doc_id", 40).select("doc_id", "source", "slot")


QUERY = "explain how the indexing of parts and pages hosts example pages work"
KEYWORDS = ["indexing", "index", "parts", "part", "pages", "page", "hosts", "host", "example"]


@R.query(f"""WITH k AS (SELECT page_id, len(list_filter({sql_array(KEYWORDS)}, lambda k: contains(lower(url), k))) AS hits FROM pages)
SELECT page_id, CAST(hits AS INTEGER) AS hits FROM k WHERE hits >= 2""")
def q_keyword_coverage(spark, sf_dir):
    words = spark.range(1).select(T.module_keywords(F.lit(QUERY)).alias("k"))
    pages = table(spark, sf_dir, "pages").join(F.broadcast(words), how="cross")  # one row of at most 12 words
    hits = F.size(F.filter("k", lambda k: F.lower("url").contains(k)))
    return pages.select("page_id", hits.alias("hits")).where("hits >= 2")


@R.query()
def q_chunk_windows(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    return chunks.windows(docs, "doc_id", "text").select("doc_id", "part", F.length("piece").cast("long").alias("n"), F.sha1("piece").alias("sha"))


R.sql["q_chunk_windows"] = """WITH c AS (SELECT doc_id, text, length(text) AS len, CASE WHEN length(text) <= 3500 THEN 1 ELSE 1 + CAST(ceil((length(text) - 3500) / 3300.0) AS BIGINT) END AS parts FROM documents),
p AS (SELECT doc_id, text, unnest(range(1, parts + 1)) AS part FROM c)
SELECT doc_id, CAST(part AS INTEGER) AS part, CAST(length(substring(text, (part - 1) * 3300 + 1, 3500)) AS BIGINT) AS n, sha1(substring(text, (part - 1) * 3300 + 1, 3500)) AS sha FROM p"""


TURNS = "trim(regexp_replace(text, '\\?+$', ''))"


@R.query(f"""WITH c AS (SELECT conv_id, turn, text, list_filter(string_split_regex({TURNS}, '\\s+'), lambda t: t <> '') AS w FROM conversations WHERE role = 'user'),
k AS (SELECT *, list_filter(w, lambda t: NOT list_contains({sql_array(T.QUERY_STOP_WORDS)}, lower(t))) AS kept FROM c),
o AS (SELECT *, CASE WHEN len(w) < 4 THEN 'skip-short' WHEN len(list_filter(w, lambda t: regexp_matches(t, '[._-]'))) > 0 THEN 'skip-symbol-like' WHEN len(kept) < 2 THEN 'skip-overstrip' ELSE 'applied' END AS outcome FROM k)
SELECT conv_id, turn, CASE WHEN outcome = 'applied' THEN array_to_string(kept, ' ') ELSE text END AS rewritten, outcome FROM o""")
def q_rewrite(spark, sf_dir):
    turns = table(spark, sf_dir, "conversations").where("role = 'user'").withColumn("r", T.rewritten_query(F.col("text")))
    return turns.select("conv_id", "turn", F.col("r.text").alias("rewritten"), F.col("r.outcome").alias("outcome"))


NAMES = ["a.fixtures.b", "a.b.b", "a.anonymous_1_2.c", "proj.tests.t", "scripts.run", "a.mod.run_tests", "x.spec.y", "x.test", "src/tests/a.py", "src/a_test.go", "vendor/x.c", "docs/readme.md", "README.md", "a/__tests__/b.ts", "proj.src.latest.thing", "docs/dist/x.md", "conftest.py", "x/conftest.py"]


@R.query(f"""SELECT name, list_has_any(string_split(name, '.'), {sql_array(P.FIXTURE_SEGMENTS)}) OR len(list_filter(string_split(name, '.'),
lambda p: regexp_matches(p, '^anonymous_[0-9]+_[0-9]+$'))) > 0 OR (len(string_split(name, '.')) >= 2 AND string_split(name, '.')[-1] = string_split(name, '.')[-2]) AS noise,
{' OR '.join([f"contains(lower(name), '{m}')" for m in P.DOTTED_MARKERS] + [f"starts_with(lower(name), '{m}') OR contains(lower(name), '.{m}')" for m in P.LEADING_MARKERS])} AS test_or_script,
regexp_matches(name, '\\.tests\\.|\\.test\\.|\\.spec\\.|\\.test$') AS test_symbol,
regexp_matches(name, {quoted('|'.join(f'(?:{p})' for p in P.SKIPPED_PATHS))}) AS skipped,
ends_with(name, '.md') AND NOT ({' OR '.join(f"contains(name, '{x}')" for x in P.MARKDOWN_EXCLUDED)}) AND CASE WHEN contains(name, '/') THEN string_split(name, '/')[1] IN {sql_list(P.MARKDOWN_FOLDERS)} ELSE name IN {sql_list(P.MARKDOWN_ROOT)} END AS markdown
FROM (SELECT name FROM {sql_values([(n,) for n in NAMES], 'name')} UNION ALL SELECT url FROM pages)""")
def q_noise_flags(spark, sf_dir):
    names = values(spark, [(n,) for n in NAMES], "name string").unionByName(table(spark, sf_dir, "pages").select(F.col("url").alias("name")))
    c = F.col("name")
    return names.select("name", P.is_noise(c).alias("noise"), P.is_test_or_script(c).alias("test_or_script"), P.is_test_symbol(c).alias("test_symbol"), P.skip_embedding(c).alias("skipped"), P.is_markdown_source(c).alias("markdown"))


@R.query("""SELECT event_type AS grp, round(quantile_cont(value, 0.5), 4) AS p50, round(quantile_cont(value, 0.95), 4) AS p95 FROM events GROUP BY event_type
UNION ALL SELECT 'lineitem', round(quantile_cont(l_extendedprice, 0.5), 4), round(quantile_cont(l_extendedprice, 0.95), 4) FROM lineitem""")
def q_percentile(spark, sf_dir):
    a = evaluation.percentiles(table(spark, sf_dir, "events"), "event_type", "value", (0.5, 0.95))
    b = evaluation.percentiles(table(spark, sf_dir, "lineitem").withColumn("g", F.lit("lineitem")), "g", "l_extendedprice", (0.5, 0.95))
    out = a.toDF("grp", "p50", "p95").unionByName(b.toDF("grp", "p50", "p95"))
    return out.select("grp", F.round("p50", 4).alias("p50"), F.round("p95", 4).alias("p95"))


FACETS = [("and", ["and", "und", " et "]), ("of", [" of ", " von ", " de "]), ("rare", ["licensed", "zzzz"])]


@R.query("WITH f AS (SELECT item_id, " + ", ".join(f"list_bool_or(list_transform({sql_array(xs)}, lambda s: contains(lower(text), s)))::INT AS f_{n}" for n, xs in FACETS).replace("list_bool_or", "list_max") + f" FROM benchmark) SELECT item_id, round(({' + '.join('f_' + n for n, _ in FACETS)}) / {len(FACETS)}.0, 4) AS coverage, ({' + '.join('f_' + n for n, _ in FACETS)}) / {len(FACETS)}.0 >= 0.7 AS passed FROM f")
def q_facets(spark, sf_dir):
    got = evaluation.facet_coverage(table(spark, sf_dir, "benchmark"), "item_id", F.lower("text"), dict(FACETS))
    return got.select("item_id", F.round("coverage", 4).alias("coverage"), "passed")


