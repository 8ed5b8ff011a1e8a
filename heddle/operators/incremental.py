"""Change detection, job ledgers and their measures."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from heddle.sources.tables import running

TERMINAL = ("done", "failed", "cancelled", "interrupted")
ACTIVE = ("queued", "running")


def snapshot_diff(old: DataFrame, new: DataFrame, tolerance_ns: int = 0) -> DataFrame:
    """path and status: new, changed, unchanged or deleted; rehashed where size or time moved."""
    a = old.select("path", F.struct("mtime_ns", "size", "sha").alias("_a"))
    b = new.select("path", F.struct("mtime_ns", "size", "sha").alias("_b"))
    both = a.join(b, "path", "full")
    stat = (F.col("_a.size") == F.col("_b.size")) & (F.abs(F.col("_a.mtime_ns") - F.col("_b.mtime_ns")) <= tolerance_ns)
    status = F.when(F.col("_a").isNull(), "new").when(F.col("_b").isNull(), "deleted").when(stat | F.col("_a.sha").eqNullSafe(F.col("_b.sha")), "unchanged").otherwise("changed")
    return both.select("path", status.alias("status"), (F.col("_b").isNotNull() & ~F.coalesce(stat, F.lit(False))).alias("rehashed"))


def to_embed(symbols: DataFrame, stored: DataFrame, key: str = "qualified_name") -> DataFrame:
    """Symbols whose content hash isn't the stored one."""
    s = stored.select(key, F.col("content_hash").alias("_stored"))
    return symbols.join(s, key, "left").where(F.col("_stored").isNull() | ~F.col("content_hash").eqNullSafe(F.col("_stored"))).drop("_stored")


def described(symbols: DataFrame, stored: DataFrame, key: str, card: str, describe: Column) -> DataFrame:
    """Cards of all symbols: the stored one where the content hash is the same, else a new one."""
    old = stored.select(key, F.col("content_hash").alias("_stored"), F.col(card).alias("_card"))
    same = F.col("content_hash").eqNullSafe(F.col("_stored")) & F.col("_stored").isNotNull()
    return symbols.join(old, key, "left").withColumn(card, F.when(same, F.col("_card")).otherwise(describe)).drop("_stored", "_card")


def diff_metrics(outcomes: DataFrame, by: str) -> DataFrame:
    """Counts of outcomes, and the share of unchanged among embedded and unchanged."""
    n = lambda o: F.count_if(F.col("outcome") == o)
    out = outcomes.groupBy(by).agg(F.count("*").alias("expected"), *[n(o).alias(o) for o in ("embedded", "unchanged", "filtered", "unreadable", "failed")])
    done = F.col("embedded") + F.col("unchanged")
    rate = F.when(done > 0, F.round(F.col("unchanged") / done, 4)).otherwise(0.0)
    rest = F.col("expected") - sum((F.col(o) for o in ("embedded", "unchanged", "filtered", "unreadable", "failed")), F.lit(0))
    return out.withColumn("total", done + F.col("filtered")).withColumn("hash_match_rate", rate).withColumn("unaccounted", rest)


def persisted_enough(claimed: Column, persisted: Column, share: float = 0.5) -> Column:
    return ~((claimed > 0) & ((persisted == 0) | (persisted < claimed * share)))


def job_states(events: DataFrame, job: str, status: str, ts: str, seq: str) -> DataFrame:
    """State of each job: its first terminal one if it has any, else its last."""
    end = F.min_by(F.col(status), F.when(F.col(status).isin(*TERMINAL), F.struct(ts, seq)))
    last = F.max_by(status, F.struct(ts, seq))
    ended = F.bool_or(F.col(status).isin(*TERMINAL))
    return events.groupBy(job).agg(F.when(ended, end).otherwise(last).alias("state"), F.max(ts).alias("updated_at"), F.min(ts).alias("started_at"), F.count("*").alias("n_events"))


def stale_jobs(jobs: DataFrame, now: Column, seconds: float = 300, writing_seconds: float = 1800) -> DataFrame:
    """Running jobs without a sign of life for so long, oldest first; longer while writing."""
    limit = F.when(F.col("phase") == "writing", writing_seconds).otherwise(seconds) if "phase" in jobs.columns else F.lit(float(seconds))
    return jobs.where((F.col("status") == "running") & (F.col("updated_at") < now - limit))


def swept(jobs: DataFrame, token: str) -> DataFrame:
    """Active jobs of other workers as interrupted; the rest as they are."""
    mine = F.col("worker_token").eqNullSafe(F.lit(token))
    return jobs.withColumn("status", F.when(F.col("status").isin(*ACTIVE) & ~mine, "interrupted").otherwise(F.col("status")))


def cleared(jobs: DataFrame, events: DataFrame, now: Column, hours: float) -> tuple[DataFrame, DataFrame]:
    """Jobs and events without the terminal jobs of over so many hours ago."""
    old = jobs.where(F.col("status").isin(*TERMINAL) & (F.col("updated_at") < now - hours * 3600)).select("job_id")
    return jobs.join(old, "job_id", "left_anti"), events.join(old, "job_id", "left_anti")


def listed_jobs(jobs: DataFrame, actor=None, slug=None, statuses=None, kinds=None, limit: int = 100, offset: int = 0) -> DataFrame:
    """Jobs that match all given filters, the newest first."""
    out = jobs
    for c, v in (("actor_oid", actor), ("repo_slug", slug)):
        out = out.where(F.col(c) == v) if v is not None else out
    for c, vs in (("status", statuses), ("kind", kinds)):
        out = out.where(F.col(c).isin(*vs)) if vs else out
    return out.orderBy(F.desc("started_at"), "job_id").offset(max(offset, 0)).limit(max(1, min(500, limit)))


def newest_active(jobs: DataFrame) -> DataFrame:
    """The newest active job of each repository."""
    return jobs.where(F.col("status").isin(*ACTIVE)).groupBy("repo_slug").agg(F.max_by("job_id", F.struct("started_at", "job_id")).alias("job_id"))


def expired(jobs: DataFrame, now: Column, live_pids: DataFrame, seconds: float, ceiling: float) -> DataFrame:
    """Active jobs whose process is gone, that made no progress, or that are too old."""
    live = live_pids.select(F.col("pid").alias("_pid"), F.lit(True).alias("_live"))
    j = jobs.where(F.col("status").isin(*ACTIVE)).join(live, F.col("pid") == F.col("_pid"), "left")
    return j.where(F.col("_live").isNull() | (F.col("updated_at") < now - seconds) | (F.col("started_at") < now - ceiling)).drop("_pid", "_live")


def admitted(requests: DataFrame, jobs: DataFrame) -> DataFrame:
    """Start requests for repositories without a live job."""
    return requests.join(jobs.where(F.col("status").isin(*ACTIVE)).select("repo_slug"), "repo_slug", "left_anti")


def active_count(jobs: DataFrame, kind: str | None = None) -> DataFrame:
    """How many jobs are queued or running, of one kind or of all: n."""
    own = jobs.where(F.col("kind") == kind) if kind is not None else jobs
    return own.agg(F.count_if(F.col("status").isin(*ACTIVE)).alias("n"))


def list_header(jobs: DataFrame, matching: Column) -> DataFrame:
    """Head of a job list: how many match, and how many are running in all."""
    return jobs.agg(F.count_if(matching).alias("total"), F.count_if(F.col("status") == "running").alias("running"))


def recorded(log: DataFrame, events: DataFrame) -> DataFrame:
    """An event log with events (ts in microseconds) appended; ids go on from the log's last, in the order
    ts, job_id, kind.  A minute's events are numbered together."""
    last = log.agg(F.coalesce(F.max("id"), F.lit(0)).alias("_last"))
    new = running(events, [], F.col("ts"), 60_000_000.0, ["ts", "job_id", "kind"], F.lit(1), "_n").join(F.broadcast(last), how="cross").withColumn("id", F.col("_last") + F.col("_n"))  # one row
    return log.unionByName(new.select(*log.columns))


def listed_events(log: DataFrame, job, limit: int = 100) -> DataFrame:
    """The first events of a job, oldest first, 1 to 1000 of them."""
    return log.where(F.col("job_id") == job).orderBy("ts", "id").limit(max(1, min(1000, limit)))


def missing_sample(expected: DataFrame, stored: DataFrame, key: str, most: int = 10) -> tuple[DataFrame, DataFrame]:
    """Expected keys that aren't stored, and the first of them by name."""
    gone = expected.select(key).distinct().join(stored.select(key), key, "left_anti")
    return gone, gone.orderBy(key).limit(most)


def readable(df: DataFrame, source: str, error: str) -> tuple[DataFrame, DataFrame]:
    """Sources that can be embedded, and counts of what was left out: unreadable (an error, or no
    source at all) and blank (white space alone)."""
    bad = F.col(error).isNotNull() | F.col(source).isNull()
    blank = ~bad & (F.trim(F.regexp_replace(F.coalesce(source, F.lit("")), r"\s+", " ")) == "")
    return df.where(~bad & ~blank), df.agg(F.count_if(bad).alias("unreadable"), F.count_if(blank).alias("blank"))


def waits(attempts: int = 5, seed: int = 0) -> list[float]:
    """Seconds to wait before each retry: any from 0 to the ceiling."""
    import random

    rng = random.Random(seed)
    return [rng.uniform(0, c) for c in backoff_ceilings(attempts)]


def retried(call, transient: tuple[type[BaseException], ...], attempts: int = 5, sleep=None, seed: int = 0):
    """Result of ``call``, tried again after errors said to be transient; others are raised at once."""
    import time

    for wait in [*waits(attempts, seed), None]:
        try:
            return call()
        except transient:
            if wait is None:
                raise
            (sleep or time.sleep)(wait)
    raise AssertionError


def failed_share(outcomes: DataFrame) -> DataFrame:
    """How many rows failed for good, and whether a run with any fails."""
    return outcomes.agg(F.count_if(F.col("outcome") == "failed").alias("failed")).withColumn("run_failed", F.col("failed") > 0)


def deleted_report(repo: str, before: dict[str, DataFrame]) -> DataFrame:
    """What deleting a repository does to each table: resource, removed, status (deleted or absent)."""
    rows = [df.agg(F.lit(name).alias("resource"), F.count_if(F.col("repo") == repo).alias("removed")) for name, df in before.items()]
    out = rows[0]
    for r in rows[1:]:
        out = out.unionByName(r)
    return out.withColumn("status", F.when(F.col("removed") > 0, "deleted").otherwise("absent"))


def changed_progress(polls: DataFrame, by: str, order: str, watched: list[str]) -> DataFrame:
    """Polls that say something new: those whose watched columns differ from the poll before."""
    now = F.struct(*watched)
    before = F.lag(now).over(W.partitionBy(by).orderBy(order))
    return polls.withColumn("_before", before).where(F.col("_before").isNull() | ~F.col("_before").eqNullSafe(now)).drop("_before")


def preempted(requests: DataFrame, jobs: DataFrame, now: Column, seconds: float) -> DataFrame:
    """Verdict on start requests: start, preempt (the live job is stale) or conflict."""
    live = jobs.where(F.col("status").isin(*ACTIVE)).groupBy("repo_slug").agg(F.max("updated_at").alias("_seen"))
    out = requests.join(live, "repo_slug", "left")
    return out.withColumn("verdict", F.when(F.col("_seen").isNull(), "start").when(F.col("_seen") < now - seconds, "preempt").otherwise("conflict")).drop("_seen")


def progress(events: DataFrame, by: str, order: str) -> DataFrame:
    """Percent done, never falling, and seconds to go; null up to 10 and from 100 on."""
    pct = (
        F.when(F.col("phase") == "discovering", 2.0)
        .when(F.col("phase") == "parsing", 5.0 + F.col("files_done") / F.greatest(F.col("files_total"), F.lit(1)) * 60.0)
        .when(F.col("phase") == "writing", 65.0)
        .when(F.col("phase") == "embedding", 70.0)
        .when(F.col("phase") == "finalizing", 98.0)
        .when(F.col("phase") == "done", 100.0)
        .otherwise(0.0)
    )
    w = W.partitionBy(by).orderBy(order)
    out = events.withColumn("progress_pct", F.max(F.least(pct, F.lit(100.0))).over(w)).withColumn("_t", F.col(order) - F.min(order).over(W.partitionBy(by)))
    p = F.col("progress_pct")
    return out.withColumn("eta_sec", F.when((p > 10) & (p < 100), F.col("_t") * (100 - p) / p)).drop("_t")


def throughput(polls: DataFrame, by: str, ts: str, count: str) -> DataFrame:
    """Items a second since the poll before."""
    w = W.partitionBy(by).orderBy(ts)
    dt = F.col(ts) - F.lag(ts).over(w)
    return polls.withColumn("rate", F.when(dt > 0, F.round((F.col(count) - F.lag(count).over(w)) / dt, 2)))


def freshness(repos: DataFrame) -> DataFrame:
    """unindexed, fresh, stale or indexed (nothing to compare with)."""
    a, b = F.col("last_indexed_sha"), F.col("current_head")
    verdict = F.when(F.col("last_indexed_at").isNull(), "unindexed").when(a.isNotNull() & b.isNotNull(), F.when(a == b, "fresh").otherwise("stale")).when(a.isNull() & b.isNull(), "indexed").otherwise("stale")
    return repos.withColumn("verdict", verdict)


def renamed_slugs(rows: DataFrame, names: DataFrame) -> DataFrame:
    """Each old slug's verdict: rename, canonical (nothing to do), taken (the target has rows) or
    clash (two old slugs have one target)."""
    have = rows.select(F.col("repo").alias("new")).distinct().withColumn("_have", F.lit(True))
    n = names.withColumn("_k", F.count("*").over(W.partitionBy("new"))).join(have, "new", "left")
    return n.select("old", "new", F.when(F.col("old") == F.col("new"), "canonical").when(F.col("_k") > 1, "clash").when(F.col("_have"), "taken").otherwise("rename").alias("verdict"))


def delete_report(repo: str, **tables: DataFrame) -> dict[str, DataFrame]:
    """Each table without a repository's rows."""
    return {name: df.where(F.col("repo") != repo) for name, df in tables.items()}


def backoff_ceilings(attempts: int = 5) -> list[int]:
    """Seconds that waits before retries don't exceed."""
    return [2**i for i in range(attempts)]


def costs(requests: DataFrame, by: str, order: str, input_price: float, output_price: float, cap: float) -> DataFrame:
    """Price of each model request by tokens (prices a million), and whether the running total of
    its repository stays within the cap."""
    price = (F.col("input_tokens") * input_price + F.col("output_tokens") * output_price) / 1e6
    total = F.sum("usd").over(W.partitionBy(by).orderBy(order).rowsBetween(W.unboundedPreceding, 0))
    return requests.withColumn("usd", price).withColumn("within", total <= cap)
