"""Jobs that fall silent: timers of their own on a stream, and the same rule on a table."""

from __future__ import annotations

import sys
from collections.abc import Iterator

import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

TERMINAL = ("done", "failed", "cancelled", "interrupted")
#: Seconds without a sign of life after which a running job is stale, longer while it writes, and hours for which ended jobs are known.
SILENT, WRITING, KEPT_HOURS = 300, 1800, 240
STALE = "job_id long, phase string, stale_ms long"


class Watchdog(StatefulProcessor):
    """Per job: its status, phase and last sign of life, and one timer, for when it will have been silent too
    long or, once it has ended, for when it is forgotten."""

    def __init__(self, silent: float, writing: float, kept_hours: float):
        self.silent, self.writing, self.kept = int(silent * 1000), int(writing * 1000), int(kept_hours * 3_600_000)

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.job = handle.getValueState("job", "status string, phase string, at long, told boolean")

    def limit(self, phase: str | None) -> int:
        return self.writing if phase == "writing" else self.silent

    def timed(self, at: int) -> None:
        for old in list(self.handle.listTimers()):
            self.handle.deleteTimer(old)
        self.handle.registerTimer(at)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        status, phase, at, told = self.job.get() if self.job.exists() else (None, None, -1, False)
        out = []
        said = sorted((int(t.value // 1_000_000), int(n), s, p) for pdf in rows for t, n, s, p in pdf[["ts", "seq", "status", "phase"]].itertuples(index=False))
        for t, _, s, p in said:
            if status in TERMINAL:
                break  # an end is final
            if status == "running" and not told and t > at + self.limit(phase):
                out.append((key[0], phase, at + self.limit(phase)))  # the silence lay between two events that came together
            if t >= at:
                status, phase, at, told = s, p, t, False
        self.job.update((status, phase, at, told))
        if status in TERMINAL:
            self.timed(at + self.kept)
        elif status == "running" and not told:
            self.timed(at + self.limit(phase))
        yield pd.DataFrame(out, columns=["job_id", "phase", "stale_ms"])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        status, phase, at, told = self.job.get()
        if status in TERMINAL:
            self.job.clear()
        elif status == "running" and not told and expiredTimerInfo.getExpiryTimeInMs() >= at + self.limit(phase):
            self.job.update((status, phase, at, True))
            yield pd.DataFrame([(key[0], phase, at + self.limit(phase))], columns=["job_id", "phase", "stale_ms"])

    def close(self) -> None:
        pass


def silent_jobs(events: DataFrame, delay: str = "10 seconds", silent: float = SILENT, writing: float = WRITING, kept_hours: float = KEPT_HOURS) -> DataFrame:
    """A stream of the times at which running jobs fell silent for too long: job_id, phase, stale_ms.

    ``events``: a stream of job_id, ts, seq, status, phase.  A timer of event time fires when the watermark has
    passed the moment at which a job's last sign of life is too old, so a job that says nothing more is told of without
    a poll; a later sign of life starts over.  Ended jobs are forgotten after ``kept_hours``; an event that
    comes after that is a job of its own.  Timers need the RocksDB state store, which this sets for the session.
    """
    spark = events.sparkSession
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    keyed = events.select("job_id", "ts", "seq", "status", "phase").withWatermark("ts", delay).groupBy("job_id")
    return keyed.transformWithStateInPandas(Watchdog(silent, writing, kept_hours), STALE, "Append", "EventTime")


def silences(events: DataFrame, now_ms: int, silent: float = SILENT, writing: float = WRITING) -> DataFrame:
    """The same of a table of events, as told up to a moment: job_id, phase, stale_ms.  Events after a job's first end
    count for nothing.  Jobs are partitions of a window; each holds one job's events."""
    ms = F.unix_millis("ts")
    order = W.partitionBy("job_id").orderBy("ts", "seq")
    ended = F.max(F.col("status").isin(*TERMINAL).cast("int")).over(order.rowsBetween(W.unboundedPreceding, -1))
    rows = events.withColumn("_ended", F.coalesce(ended, F.lit(0))).where("_ended = 0")
    rows = rows.select("job_id", "phase", "status", ms.alias("_at"), F.lead(ms).over(order).alias("_next"))
    limit = F.when(F.col("phase") == "writing", int(writing * 1000)).otherwise(int(silent * 1000))
    stale = F.col("_at") + limit
    told = F.when(F.col("_next").isNull(), stale <= now_ms).otherwise(F.col("_next") > stale)
    return rows.where((F.col("status") == "running") & told).select("job_id", "phase", stale.alias("stale_ms"))


cloudpickle.register_pickle_by_value(sys.modules[__name__])  # executors need no copy of this package
