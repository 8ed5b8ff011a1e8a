"""Helpers that the operators of this subpackage share."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: Documents, and bytes of them, handed to Python at once; bounds a worker's memory when texts are long.
ARROW_ROWS, ARROW_BYTES = 512, 8 << 20
#: Rows up to which a table of fixed-width rows is broadcast; beyond, joins shuffle.
BROADCAST_ROWS = 500_000
#: The same where a table of each key's figures meets the rows of that key (``by_key``).
KEY_ROWS = 100_000
#: A key is hot if it has more than HOT_ROWS rows and more than one in HOT_KEYS of all rows, so there
#: are never more than HOT_KEYS hot keys, however large a table is.
HOT_ROWS, HOT_KEYS = 1000, 100_000

_LIMITS = {"spark.sql.execution.arrow.maxRecordsPerBatch": ARROW_ROWS, "spark.sql.execution.arrow.maxBytesPerBatch": ARROW_BYTES}
#: What sessions had before ``small_batches``, and the tables written for them and not yet dropped.
_before: dict[str, str] = {}
_written: list[DataFrame] = []


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def small_batches(spark: SparkSession) -> None:
    """Hand documents to Python in batches of ARROW_ROWS rows and about ARROW_BYTES bytes at most.
    Plans read these settings when they run, so they stay until ``released``."""
    for name, most in _LIMITS.items():
        now = spark.conf.get(name)
        if not 0 < spark._jvm.org.apache.spark.network.util.JavaUtils.byteStringAsBytes(now) <= most:
            _before.setdefault(name, now)
            spark.conf.set(name, str(most))


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or, where that is unset and
    all run in one process (tests), a folder of this process."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        folder = f"file://{tempfile.mkdtemp(prefix='heddle-')}"
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder.rstrip("/")


def written(df: DataFrame) -> DataFrame:
    """Write a table into the shared folder and read it again: what follows has no lineage
    beyond that file, whatever executors are lost.  ``dropped`` or ``released`` removes it."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/heddle-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._heddle_path = path
    _written.append(out)
    return out


def dropped(*tables: DataFrame) -> None:
    """Delete tables made by ``written`` that no later plan reads."""
    for df in tables:
        path = df._heddle_path
        jvm = df.sparkSession._jvm
        where = jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(where, True)
        _written[:] = [x for x in _written if x is not df]


@contextmanager
def scratch() -> Iterator[list[DataFrame]]:
    """Drops the tables written within it at its end, except those put into the list that it gives."""
    before, keep = list(_written), []
    try:
        yield keep
    finally:
        dropped(*[x for x in _written if all(x is not y for y in [*before, *keep])])


def released(spark: SparkSession, *but: DataFrame) -> None:
    """Delete every table that operators of this subpackage wrote for themselves, except ``but``, and
    put the session's batch sizes back.  For callers that have stored an operator's result: until
    then its plan still reads such tables."""
    dropped(*[x for x in _written if all(x is not y for y in but)])
    while _before:
        spark.conf.set(*_before.popitem())


def row_hash(text: Column) -> Column:
    """Tells apart rows that share a doc_id but not a text."""
    return F.xxhash64(F.coalesce(text, F.lit("")))


def joinable(table: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """Broadcast a written table of fixed-width rows if a count shows that it has few."""
    return F.broadcast(table) if table.count() <= rows else table


def by_key(left: DataFrame, right: DataFrame, on: list[str], n: str, how: str = "inner", rows: int = KEY_ROWS) -> DataFrame:
    """``left`` joined with ``right``, a written table that has one row for each key and, in column
    ``n``, how many rows of ``left`` that key has; ``how`` is inner, left_semi or left_anti.

    A small table is broadcast.  Otherwise rows of hot keys, of which there are at most HOT_KEYS, meet
    a broadcast table of these and stay where they are; only the others are shuffled, and none of
    their keys is more than a small share of all.
    """
    count, total = right.agg(F.count("*"), F.sum(n)).first()
    if count <= rows:
        return left.join(F.broadcast(right), on, how)
    hot = F.col(n) > max(HOT_ROWS, (total or 0) // HOT_KEYS)
    high = F.broadcast(right.where(hot))
    low = left.join(F.broadcast(right.where(hot).select(on)), on, "left_anti").join(right.where(~hot), on, how)
    return low if how == "left_anti" else left.join(high, on, how).unionByName(low)


def numbered(rows: DataFrame, by: list[str], order: list[str], name: str) -> DataFrame:
    """``rows`` with their numbers from 0, in column ``name``, in the order of ``order`` among those that share
    ``by`` (columns without nulls).  Rows are written in sorted ranges; each task numbers what lies in its own,
    shifted by the counts of those before, so a group of any size, of equal rows too, lies in as many tasks as it
    fills.  Equal rows get any order, all others always the same numbers, however rows are dealt."""
    sort = [*by, *order]
    ranged = rows.withColumn("_copy", F.monotonically_increasing_id()).repartitionByRange(*sort, "_copy").sortWithinPartitions(*sort)
    ranged = written(ranged.drop("_copy").withColumns({"_part": F.spark_partition_id(), "_at": F.monotonically_increasing_id()}))
    parts = ranged.groupBy(*by, "_part").agg(F.count("*").alias("_n"), F.min("_at").alias("_from"))
    before = F.sum("_n").over(W.partitionBy(*by).orderBy("_part")) - F.col("_n")
    parts = written(parts.withColumn("_before", before))
    return by_key(ranged, parts, [*by, "_part"], "_n").withColumn(name, F.col("_at") - F.col("_from") + F.col("_before")).drop("_part", "_at", "_n", "_from", "_before")
