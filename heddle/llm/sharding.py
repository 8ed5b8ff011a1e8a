"""Weighted rendezvous hashing of record keys over shards."""

from __future__ import annotations

import math
from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from heddle.llm.common import numbered


def rendezvous(key: Column, weights: Mapping[int, float]) -> Column:
    """The shard that wins the key: each shard draws an exponential variate of rate weight
    from a hash of (key, shard); the smallest draw wins.  A shard that is added takes only the
    keys that it wins, one that goes gives away only its own, and shares follow the weights.
    A null key is a key like any other."""
    if not weights or any(not w > 0 or math.isinf(w) for w in weights.values()):
        raise ValueError("weights must be finite and positive")

    def draw(shard: int, weight: float) -> Column:
        bits = F.shiftrightunsigned(F.xxhash64(key, F.lit(int(shard))), 11)
        unit = (bits.cast("double") + F.lit(0.5)) / F.lit(float(1 << 53))
        return F.struct((-F.log(unit) / F.lit(float(weight))).alias("draw"), F.lit(int(shard)).alias("shard"))

    draws = [draw(s, w) for s, w in sorted(weights.items())]
    return (F.least(*draws) if len(draws) > 1 else draws[0])["shard"]


def assign_shards(docs: DataFrame, weights: Mapping[int, float], grown: Mapping[int, float] | None = None, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Shard, and a gapless slot within it, for every row of ``docs``.

    Returns key, size (UTF-8 bytes of the text plus 1), text_crc32, shard, slot and grown_shard
    (the shard under ``grown``, else null).  Only the key and the shards decide, so equal texts
    spread as their keys do.  Slots number a shard's rows by (key, crc, size), in as many ranges as they
    fill (``common.numbered``): a rerun gives the same slots, and neither a large shard nor a row repeated very
    often is one task's.

    Null text counts as empty (size 1, crc 0); a null key is a key; rows with equal keys share a
    shard and have slots of their own; an empty table gives an empty one; other columns are left out.
    """
    body = F.coalesce(F.col(text), F.lit(""))
    shard = rendezvous(F.col(key), weights)
    rows = docs.select(
        F.col(key),
        (F.octet_length(body).cast("long") + 1).alias("size"),
        F.crc32(body.cast("binary")).alias("text_crc32"),
        shard.alias("shard"),
        (rendezvous(F.col(key), grown) if grown else F.lit(None).cast("int")).alias("grown_shard"),
    )
    return numbered(rows, ["shard"], [key, "text_crc32", "size"], "slot").select(key, "size", "text_crc32", "shard", "slot", "grown_shard")


def write_shards(docs: DataFrame, path: str, weights: Mapping[int, float], key: str = "doc_id") -> None:
    """Write the rows of ``docs``, all columns, as Parquet partitioned by ``_shard``.  Each shard
    is written by several tasks, so that a shard may outgrow an executor."""
    shard = rendezvous(F.col(key), weights)
    docs.withColumn("_shard", shard).write.partitionBy("_shard").parquet(path)
