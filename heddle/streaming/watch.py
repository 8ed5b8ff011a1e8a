"""File events: debounced change sets, on batches and on streams."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from heddle.functions.predicates import IGNORED_NAMES
from heddle.sources.snapshots import Snapshots
from heddle.sources.tables import dropped, settled

GAP = "1500 milliseconds"
#: Later events open a window of their own.
WATERMARK = "15 seconds"


def relevant(events: DataFrame, extensions: tuple[str, ...], path: str = "path") -> DataFrame:
    """Events on files with these extensions in no ignored folder."""
    parts = F.split(path, "/")
    ok = F.lit(False)
    for e in extensions:
        ok = ok | F.col(path).endswith(e)
    return events.where(ok & ~F.arrays_overlap(parts, F.array(*map(F.lit, IGNORED_NAMES))))


def debounced(events: DataFrame, by: list[str], ts: str = "ts", path: str = "path", gap: str = GAP) -> DataFrame:
    """Distinct paths of each burst: events less than a gap after the one before it are one burst."""
    stream = events.withWatermark(ts, WATERMARK) if events.isStreaming else events
    out = stream.groupBy(*by, F.session_window(ts, gap).alias("_w")).agg(F.array_sort(F.collect_set(path)).alias("paths"), F.count("*").alias("n_events"))  # the paths of one burst are what is asked for
    return out.select(*by, F.col("_w.start").alias("first_ts"), F.col("_w.end").alias("closed_ts"), "paths", "n_events")


def index_changes(changes: DataFrame, apply: Callable[[DataFrame, int], None], checkpoint: str):
    """Starts a query that hands each micro-batch of change sets to ``apply``, one after another."""
    return changes.writeStream.outputMode("append").option("checkpointLocation", checkpoint).foreachBatch(apply).start()


TERMINAL = ("done", "failed", "cancelled", "interrupted")


def job_state_stream(events: DataFrame) -> DataFrame:
    """State of each job as events (job_id, status, ts, seq) come; a terminal state is final.  All of a
    micro-batch's events of a job are put in order, ties by seq, before any is looked at; an event
    older than the state's last one changes nothing, unless it is the first terminal one."""

    def step(key, rows: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        status, at, seq = state.get if state.exists else ("queued", -1, -1)
        said = sorted((int(t.value // 1000), int(n), s) for pdf in rows for s, t, n in pdf[["status", "ts", "seq"]].itertuples(index=False))
        for t, n, s in said:
            if status not in TERMINAL and (s in TERMINAL or (t, n) > (at, seq)):
                status, at, seq = s, max(at, t), n
        state.update((status, at, seq))
        yield pd.DataFrame({"job_id": [key[0]], "state": [status], "updated_us": [at]})

    return events.groupBy("job_id").applyInPandasWithState(step, "job_id long, state string, updated_us long", "status string, at long, seq long", "update", "NoTimeout")


def last_writes(batch: DataFrame) -> DataFrame:
    """One row for each path: the one written last, ties by size and hash."""
    last = F.max_by(F.struct(*batch.columns), F.struct("mtime_ns", "size", "sha")).alias("_last")
    return batch.groupBy("path").agg(last).select("_last.*")


def partial_index(stored: Callable[[], DataFrame], apply: Callable[[DataFrame], None]) -> Callable[[DataFrame, int], None]:
    """What ``index_changes`` calls for each micro-batch of files (path, mtime_ns, size, sha): of each
    path the last write, those whose hash is the stored one left alone, and nothing is applied if none is
    left.  Micro-batches come one after another, so a repository is never indexed twice at once."""

    def run(batch: DataFrame, _: int) -> None:
        old = stored().select("path", F.col("sha").alias("_sha"))
        new = last_writes(batch).join(old, "path", "left").where(~F.col("sha").eqNullSafe(F.col("_sha"))).drop("_sha")
        if not new.isEmpty():
            apply(new)

    return run


def indexed_once(store: Snapshots, stream: str, index: Callable[[DataFrame], DataFrame] | None = None) -> Callable[[DataFrame, int], None]:
    """What ``index_changes`` calls to keep ``store`` equal to the last write of every path, each micro-batch
    applied exactly once.

    ``index`` makes a file's stored rows from the changed files (as they are, if none is given); path and sha stay.
    A path without a hash is deleted.  Rows and the batch's number go into the store in one step
    (``Snapshots.write``), so a batch that fails before it changes nothing, and one that comes again after it is
    known and left alone.  A batch that changes nothing adds no version.
    """

    def run(batch: DataFrame, number: int) -> None:
        base = store.current()
        if store.applied(stream, number):
            return
        last = last_writes(batch)
        old = store.read(base)
        if old is not None:
            known = old.select("path", F.col("sha").alias("_sha")).distinct()
            last = last.join(known, "path", "left").where(~F.col("sha").eqNullSafe(F.col("_sha"))).drop("_sha")
        changed = settled(last)
        try:
            if changed.isEmpty():
                return
            live = changed.where(F.col("sha").isNotNull())
            rows = index(live) if index else live
            if old is not None:
                rows = old.join(changed.select("path"), "path", "left_anti").select(*old.columns).unionByName(rows.select(*old.columns))
            store.write(rows, base, stream, number)
        finally:
            dropped(changed)

    return run


def throughput_listener(report: Callable[[str, float], None]):
    """Listener that reports each query's rows a second, where it has changed since the last report."""
    from pyspark.sql.streaming import StreamingQueryListener

    class Listener(StreamingQueryListener):
        last: dict[str, float] = {}

        def onQueryStarted(self, event) -> None:
            pass

        def onQueryProgress(self, event) -> None:
            p = event.progress
            rate = round(p.processedRowsPerSecond or 0.0, 2)
            if self.last.get(str(p.id)) != rate:
                self.last[str(p.id)] = rate
                report(p.name or str(p.id), rate)

        def onQueryIdle(self, event) -> None:
            pass

        def onQueryTerminated(self, event) -> None:
            self.last.pop(str(event.id), None)

    return Listener()
