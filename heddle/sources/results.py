"""Results kept between sessions, by what was asked and of which versions."""

from __future__ import annotations

import hashlib
import json
import uuid
from collections.abc import Mapping

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


class Results:
    """Materialised results in a shared folder, one for each plan and versions of its inputs.

    A plan is known by its canonical form, in which names of columns' numbers don't count, and its columns;
    the caller says which version of each input it reads.  A newer version is another result, so an
    outdated one is never given; ``evict`` deletes what is old or too much.  A result is written beside
    its place and renamed into it, so no reader sees half of one, and of two writers of one result the first stays.
    Plans with functions that change from call to call are the caller's to leave out.
    """

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path, self.made = spark, path.rstrip("/"), 0
        self._path = spark._jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(self.path).getFileSystem(spark._jsc.hadoopConfiguration())

    def key(self, df: DataFrame, inputs: Mapping[str, object]) -> str:
        conf, name = df.sparkSession.conf, "spark.sql.debug.maxToStringFields"
        before = conf.get(name)
        conf.set(name, "100000")
        try:
            plan = df._jdf.queryExecution().analyzed().canonicalized().toString()
        finally:
            conf.set(name, before)
        return hashlib.sha256(json.dumps([plan, df.schema.jsonValue(), sorted((k, str(v)) for k, v in inputs.items())]).encode()).hexdigest()

    def get(self, df: DataFrame, inputs: Mapping[str, object]) -> DataFrame:
        """The kept result, or ``df`` computed now and kept; read by the session of ``df``."""
        place = f"{self.path}/{self.key(df, inputs)}"
        if not self._fs.exists(self._path(f"{place}/_SUCCESS")):
            draft = f"{self.path}/.{uuid.uuid4().hex}"
            df.write.parquet(draft)
            self.made += 1
            if self._fs.exists(self._path(place)) or not self._fs.rename(self._path(draft), self._path(place)):
                self._fs.delete(self._path(draft), True)  # another writer was first
        return df.sparkSession.read.schema(df.schema).parquet(place)

    def entries(self) -> DataFrame:
        """repo (one for all), path, size and mtime (seconds) of every result."""
        from heddle.sources import walk

        folder = F.substring_index("path", "/", 1)
        files = walk.source_tree(self.spark, self.path, ignore=False).where(~F.col("path").startswith("."))
        return files.groupBy(folder.alias("path")).agg(F.sum("size").alias("size"), (F.max("mtime_ns") / 1e9).alias("mtime")).withColumn("repo", F.lit("results"))

    def evict(self, ttl_s: float, quota: int, now_s: float) -> list[str]:
        """Delete results older than ``ttl_s``, and beyond ``quota`` bytes counted from the newest; returns their names."""
        from heddle.sources import tables

        gone = [r["path"] for r in tables.evicted(self.entries(), ttl_s, quota, now_s).where("evicted").select("path").collect()]  # names of results
        for name in gone:
            self._fs.delete(self._path(f"{self.path}/{name}"), True)
        return gone
