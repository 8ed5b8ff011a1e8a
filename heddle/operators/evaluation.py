"""Measures of retrieval quality and latency."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from heddle.operators.rank import lift_capture
from heddle.sources.tables import few, settled


def kth_values(df: DataFrame, by: str, value: str, ranks: DataFrame) -> DataFrame:
    """The values at the wanted ranks (from 0) of each group: by, rank, value.  ``ranks``: by, rank.

    No group is sorted in one place: each round counts, for every wanted rank, the values of the
    interval that holds it in 1024 parts, and goes on with the part that the rank lies in, until it
    holds one value.  Counts are combined before they are shuffled.
    """
    ends = df.where(F.col(value).isNotNull()).groupBy(by).agg(F.min(value).alias("lo"), F.max(value).alias("hi"))
    now = settled(ranks.join(ends, by).select(by, "rank", "lo", "hi", F.lit(0).cast("long").alias("below")))
    done = now.where("lo = hi")
    while not (now := now.where("lo < hi")).isEmpty():
        x = df.select(F.col(by).alias("_by"), F.col(value).alias("_x"))
        inside = x.join(few(now), (F.col("_by").eqNullSafe(F.col(by))) & F.col("_x").between(F.col("lo"), F.col("hi")))
        part = F.least(F.floor((F.col("_x") - F.col("lo")) / (F.col("hi") - F.col("lo")) * 1024), F.lit(1023)).alias("part")
        counts = inside.groupBy(by, "rank", "below", part).agg(F.count("*").alias("n"), F.min("_x").alias("lo"), F.max("_x").alias("hi"))
        upto = F.sum("n").over(W.partitionBy(by, "rank").orderBy("part"))  # 1024 rows at most
        cut = counts.withColumn("_upto", F.col("below") + upto).withColumn("_from", F.col("_upto") - F.col("n"))
        now = settled(cut.where((F.col("_from") <= F.col("rank")) & (F.col("rank") < F.col("_upto"))).select(by, "rank", "lo", "hi", F.col("_from").alias("below")))
        done = done.unionByName(now.where("lo = hi"))
    return done.select(by, "rank", F.col("lo").alias("value"))


def percentiles(df: DataFrame, by: str, value: str, shares: tuple[float, ...]) -> DataFrame:
    """Linearly interpolated percentiles of each group, exact; null for groups without a value."""
    sizes = df.groupBy(by).agg(F.count(value).alias("n"))
    at = F.array(*[F.struct(F.lit(i).alias("i"), ((F.col("n") - 1) * F.lit(float(p))).alias("at")) for i, p in enumerate(shares)])
    wanted = settled(sizes.where("n > 0").select(by, F.explode(at).alias("_w")).select(by, "_w.i", "_w.at").withColumn("low", F.floor("at")).withColumn("high", F.ceil("at")))
    found = settled(kth_values(df, by, value, wanted.select(by, F.explode(F.array("low", "high")).alias("rank")).distinct()))
    a, b = (found.select(F.col(by).alias(f"_by{x}"), F.col("rank").alias(f"_rank{x}"), F.col("value").cast("double").alias(f"_v{x}")) for x in "ab")
    both = wanted.join(a, F.col(by).eqNullSafe(F.col("_bya")) & (F.col("low") == F.col("_ranka"))).join(b, F.col(by).eqNullSafe(F.col("_byb")) & (F.col("high") == F.col("_rankb")))
    x = F.col("_va") + (F.col("_vb") - F.col("_va")) * (F.col("at") - F.col("low"))
    got = both.groupBy(by).agg(*[F.max(F.when(F.col("i") == i, x)).alias(f"p{round(p * 100)}") for i, p in enumerate(shares)])
    return sizes.select(F.col(by).alias("_k")).join(got, F.col("_k").eqNullSafe(F.col(by)), "left").select(F.col("_k").alias(by), *got.columns[1:])


def facet_coverage(df: DataFrame, key: str, text: Column, facets: dict[str, list[str]], least: float = 0.7) -> DataFrame:
    """Share of the facets of which a text has any mark, and whether that is enough."""
    has = [F.coalesce(F.exists(F.array(*map(F.lit, marks)), lambda m: text.contains(m)), F.lit(False)).cast("int") for marks in facets.values()]
    share = sum(has, F.lit(0)) / F.lit(float(max(len(facets), 1)))
    return df.select(key, share.alias("coverage"), (share >= least).alias("passed"))


def relevance(hits: DataFrame, by: str, rank: str, relevant: Column) -> DataFrame:
    """Whether any of the first, the first five and all hits are relevant."""
    return hits.groupBy(by).agg(F.bool_or((F.col(rank) <= 1) & relevant).alias("top1"), F.bool_or((F.col(rank) <= 5) & relevant).alias("top5"), F.bool_or(relevant).alias("topk"))


def mean_lift(df: DataFrame) -> DataFrame:
    return df.agg(F.avg(lift_capture(df)).alias("mean_lift"))


def regressions(now: DataFrame, snapshot: DataFrame, key: str, value: str, tolerance: float = 0.0) -> DataFrame:
    """Keys whose value fell below the snapshot's."""
    old = snapshot.select(key, F.col(value).alias("before"))
    return now.join(old, key).where(F.col(value) < F.col("before") - tolerance).select(key, "before", F.col(value).alias("now"))


def span_coverage(hits: DataFrame, spans: DataFrame, by: str) -> DataFrame:
    """Share of each task's spans (file, start, end) that some hit overlaps."""
    s = spans.withColumn("_span", F.struct("file_path", "start_line", "end_line"))
    h = hits.select(F.col(by).alias("_b"), F.col("file_path").alias("_f"), F.col("start_line").alias("_s"), F.col("end_line").alias("_e"))
    hit = s.join(h, (s[by] == h["_b"]) & (s["file_path"] == h["_f"]) & (h["_s"] <= s["end_line"]) & (h["_e"] >= s["start_line"]), "left_semi").groupBy(by).agg(F.countDistinct("_span").alias("hit"))
    return s.groupBy(by).agg(F.countDistinct("_span").alias("n")).join(hit, by, "left").select(by, (F.coalesce("hit", F.lit(0)) / F.col("n")).alias("coverage"))
