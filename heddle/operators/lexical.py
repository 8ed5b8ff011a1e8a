"""Inverted index and BM25."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from heddle.functions.text import tokens
from heddle.sources.tables import settled


def postings(docs: DataFrame, key: str, text: str) -> DataFrame:
    """key, term, tf: one row for each distinct term of a document."""
    return docs.select(key, F.explode(tokens(F.col(text))).alias("term")).groupBy(key, "term").agg(F.count("*").alias("tf"))


def lengths(docs: DataFrame, key: str, text: str) -> DataFrame:
    return docs.select(key, F.size(tokens(F.col(text))).cast("long").alias("dl"))


def counted(docs: DataFrame, terms: list[str], key: str, text: str) -> DataFrame:
    """key, dl and how often each term occurs (_tf0, _tf1, ...), of every document, settled.  The
    tokens pass through a generator, behind which nothing computes them again."""

    def times(term: str):
        return F.size(F.filter("_t", lambda x: x == term)).cast("double")

    one = docs.select(key, F.explode(F.array(tokens(F.col(text)))).alias("_t"))
    return settled(one.select(key, F.size("_t").cast("double").alias("dl"), *[times(t).alias(f"_tf{i}") for i, t in enumerate(terms)]))


def scored(counts: DataFrame, stats: DataFrame, n: int, key: str, k1: float, b: float) -> DataFrame:
    joined = counts.where(" OR ".join(f"_tf{i} > 0" for i in range(n)) or "false").join(F.broadcast(stats), how="cross")  # one row
    idf = lambda i: F.log(1 + (F.col("_n") - F.col(f"_df{i}") + 0.5) / (F.col(f"_df{i}") + 0.5))
    part = lambda i: idf(i) * F.col(f"_tf{i}") * (k1 + 1) / (F.col(f"_tf{i}") + k1 * (1 - b + b * F.col("dl") / F.col("_avg")))
    return joined.select(key, sum((part(i) for i in range(n)), F.lit(0.0)).alias("score"))


def bm25(docs: DataFrame, query_terms: list[str], key: str = "doc_id", text: str = "text", k1: float = 1.2, b: float = 0.75) -> DataFrame:
    """BM25 of every document with a query term: key, score.

    One pass over the texts counts the query's terms and writes a few numbers for each document;
    totals and scores are read from these.  For many queries, see ``segments.SegmentedIndex``.
    """
    terms = list(dict.fromkeys(t.lower() for t in query_terms))
    counts = counted(docs, terms, key, text)
    stats = counts.agg(F.count("*").cast("double").alias("_n"), F.avg("dl").alias("_avg"), *[F.sum((F.col(f"_tf{i}") > 0).cast("double")).alias(f"_df{i}") for i in range(len(terms))])
    return scored(counts, stats, len(terms), key, k1, b)


def fielded_bm25(docs: DataFrame, query_terms: list[str], fields: list[str], key: str, repo: str | None = None, repo_column: str = "repo") -> DataFrame:
    """BM25 of each field, summed; only documents of ``repo`` if one is given."""
    own = docs.where(F.col(repo_column) == repo) if repo is not None else docs
    legs = [bm25(own, query_terms, key, f) for f in fields]
    out = legs[0]
    for leg in legs[1:]:
        out = out.unionByName(leg)
    return out.groupBy(key).agg(F.sum("score").alias("score"))


def top_documents(scored: DataFrame, k: int, key: str = "doc_id") -> DataFrame:
    """Best k of those that score at all: key, score, rank."""
    best = scored.where("score > 0").orderBy(F.desc("score"), key).limit(max(1, min(200, k)))
    return best.withColumn("rank", F.row_number().over(W.orderBy(F.desc("score"), key)))


def quota(ranked: DataFrame, limit: int, file: str, is_markdown, key: str, per_file: int = 2) -> DataFrame:
    """At most ``per_file`` hits of a file, and half the limit from Markdown, in rank order."""
    half = max(1, limit // 2)
    kept = ranked.orderBy("rank").limit(200)  # the most that top_documents gives; windows over it are small
    kept = kept.withColumn("_f", F.row_number().over(W.partitionBy(file).orderBy("rank"))).where(F.col("_f") <= per_file)
    kept = kept.withColumn("_md", is_markdown).withColumn("_m", F.row_number().over(W.partitionBy("_md").orderBy("rank"))).where(~F.col("_md") | (F.col("_m") <= half))
    return kept.drop("_f", "_m", "_md").orderBy("rank").limit(limit)
