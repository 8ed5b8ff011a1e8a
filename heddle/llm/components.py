"""Connected components of a graph that is never gathered in one place."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from heddle.llm.common import by_key, dropped, written


def components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """Smallest node that each node of ``edges`` (u, v) can reach: (node, component).

    Large-star and small-star steps in turn: each node hooks its larger, then its smaller
    neighbours to the least of them, until nothing changes.  Minima are combined before they are
    shuffled, and edges of a node with very many neighbours meet its minimum where they are, so
    such a node costs no task more than its share of edges.  Every round is a written table.  Self-loops and repeated edges are allowed; no edge, no row.
    """
    now = written(edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).where("u <> v").distinct())
    said = None
    for _ in range(rounds):
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = written(both.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("n")).withColumn("m", F.least("u", "m")))
        large = by_key(both, least, ["u"], "n").where(F.col("v") > F.col("u")).select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = written(large.where("u <> v").distinct())
        down = written(large.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("n")))
        small = by_key(large, down, ["u"], "n").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(down.select("u", F.col("m").alias("v")))
        after = written(small.where("u <> v").distinct())
        dropped(now, large, least, down)
        now = after
        sums = now.agg(F.count("*"), F.sum(F.xxhash64("u", "v") % 1_000_003), F.sum("v")).first()
        if sums == said:
            break
        said = sums
    else:
        raise RuntimeError("components did not settle")
    tops = now.select(F.col("v").alias("node")).distinct()
    return now.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(tops.select("node", F.col("node").alias("component")))
