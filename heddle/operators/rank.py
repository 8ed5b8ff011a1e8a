"""Ranks, fusion, boosts and quotas.

Ranks over a whole list (windows without a partition) are for candidate lists that a top-k has
bounded; nothing here ranks a corpus.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W


#: Candidates of each list that a search for k results ranks: so many times k, and so many at least.
DEEP, LEAST_DEEP = 50, 500


def ranked(df: DataFrame, score: str, key: str, rank: str = "rank") -> DataFrame:
    return df.withColumn(rank, F.row_number().over(W.orderBy(F.desc(score), key)))


def linear_fusion(semantic: DataFrame, central: DataFrame, key: str, weight: float = 0.7) -> DataFrame:
    """weight * score + (1 - weight) * pagerank; the score alone if no key has a pagerank."""
    joined = semantic.join(central.select(key, "pagerank"), key, "left")
    any_ = joined.agg(F.coalesce(F.bool_or(F.col("pagerank").isNotNull()), F.lit(False)).alias("_any"))
    fused = F.col("score") * weight + F.coalesce("pagerank", F.lit(0.0)) * (1 - weight)
    return joined.join(F.broadcast(any_), how="cross").withColumn("fused", F.when(F.col("_any"), fused).otherwise(F.col("score"))).drop("_any")


def reciprocal_ranks(semantic: DataFrame, lexical: DataFrame, key: str, k: int = 60) -> DataFrame:
    """Semantic candidates by summed reciprocal ranks in both lists; their score stays."""
    a = ranked(semantic, "score", key, "_a")
    b = ranked(lexical, "score", key, "_b").select(key, "_b")
    return a.join(b, key, "left").withColumn("rrf", 1 / (k + F.col("_a")) + F.coalesce(1 / (k + F.col("_b")), F.lit(0.0))).drop("_a", "_b")


def folded(scored: DataFrame, name: Column, key: str) -> DataFrame:
    """Greatest score of each folded name."""
    return scored.withColumn(key, name).groupBy(key).agg(F.max("score").alias("score"))


def pinned(scored: DataFrame, query: str, key: str) -> Column:
    """Whether a name is the query, ends with it after a dot, or starts with it before one."""
    c = F.col(key)
    return (c == query) | c.endswith("." + query) | c.startswith(query + ".")


def pin_final(scored: DataFrame, query: str, name: str, key: str, k: int) -> DataFrame:
    """The first k rows with their rank: those whose name is ``pinned``, then the others, each by score, ties by key."""
    order = [F.desc("_pin"), F.desc("score"), key]
    best = scored.withColumn("_pin", pinned(scored, query, name)).orderBy(*order).limit(k)
    return best.withColumn("rank", F.row_number().over(W.orderBy(*order))).drop("_pin")


def max_merged(*legs: DataFrame, key: str) -> DataFrame:
    out = legs[0].select(key, "score")
    for leg in legs[1:]:
        out = out.unionByName(leg.select(key, "score"))
    return out.groupBy(key).agg(F.max("score").alias("score"))


def boost_bases(scores: DataFrame, k: int) -> DataFrame:
    """Bases of the seed legs from the semantic scores: top and the one in the middle."""
    r = ranked(scores, "score", scores.columns[0])
    n = F.max("rank")
    mid = F.max(F.when(F.col("rank") - 1 == F.least(F.lit(max(k // 2 - 1, 0)), F.col("_n") - 1), F.col("score")))
    r = r.withColumn("_n", F.max("rank").over(W.partitionBy(F.lit(0))))
    top = F.max("score")
    return r.agg(top.alias("top"), mid.alias("mid"), n.alias("n")).select(
        "top",
        "mid",
        (F.col("top") * 0.98).alias("exact"),
        F.least(F.col("top") * 0.975, F.col("mid") * 1.0025).alias("lexical"),
        F.least(F.col("top") * 0.97, F.col("mid") * 1.002).alias("module"),
        F.least(F.col("top") * 0.96, F.col("mid") * 1.001).alias("entry"),
    )


def penalised(score: Column, flag: Column, factor: float = 0.4) -> Column:
    return F.when(flag, score * factor).otherwise(score)


def round_robin(df: DataFrame, bucket: str, bucket_order: str, key: str, limit: int, cap: int = 5) -> DataFrame:
    """At most ``cap`` rows of a bucket, one of each bucket in turn."""
    slot = F.row_number().over(W.partitionBy(bucket).orderBy(key))
    dealt = df.withColumn("slot", slot).where(F.col("slot") <= cap)
    return dealt.orderBy("slot", bucket_order, bucket, key).limit(limit)


def summary_quota(scored: DataFrame, limit: int, summary: Column, key: str, most: int = 4) -> DataFrame:
    """The first ``limit`` of a bounded list by score, with at most ``most`` summaries among them;
    later rows take the places of the summaries left out."""
    r = ranked(scored, "score", key).withColumn("_s", F.when(summary, 1).otherwise(0))
    r = r.withColumn("_k", F.sum("_s").over(W.orderBy("rank"))).where((F.col("_s") == 0) | (F.col("_k") <= most))
    return r.drop("_s", "_k", "rank").orderBy(F.desc("score"), key).limit(limit)


def seeds(scored: DataFrame, guaranteed: DataFrame, k: int, key: str, summary: Column | None = None) -> DataFrame:
    """Seeds of a bundle, from bounded lists: key, score, part (0 the head, 1 guaranteed).

    ``scored``: key and merged score of all candidates; ``guaranteed``: leg, place, key.  All lexical
    names are seeds, and so many of the module and entry-point names, in this order, as a third of
    the cap or six.  The head is the ranking without these, as long as the cap, but so that both
    fit twice k.  With no boost, the head alone.
    """
    counts = {r["leg"]: r["n"] for r in guaranteed.groupBy("leg").agg(F.count("*").alias("n")).collect()}  # four legs
    cap = min(max(k, sum(counts.values())), 2 * k)
    boosts = counts.get("module", 0) + counts.get("entry", 0)
    summary = summary if summary is not None else F.lit(False)
    if not boosts and not counts.get("lexical"):
        return summary_quota(scored, cap, summary, key).select(key, "score", F.lit(0).alias("part"))
    quota = min(boosts, max(cap // 3, 6))
    order = F.when(F.col("leg") == "module", 0).otherwise(1)
    other = guaranteed.where("leg IN ('module', 'entry')").withColumn("_i", F.row_number().over(W.orderBy(order, "place"))).where(F.col("_i") <= quota)
    sure = guaranteed.where("leg = 'lexical'").select(key).unionByName(other.select(key)).distinct()
    n = sure.count()
    head = summary_quota(scored.join(sure, key, "left_anti"), min(cap, max(2 * k - n, 1)), summary, key)
    return head.select(key, "score", F.lit(0).alias("part")).unionByName(scored.join(sure, key).select(key, "score", F.lit(1).alias("part")))


def lift_capture(df: DataFrame) -> Column:
    """Share of the oracle's lift that a composed run reaches; null unless the oracle lifts."""
    gain = F.col("oracle") - F.col("none")
    return F.when(gain > 0, F.round((F.col("composed") - F.col("none")) / gain, 4))
