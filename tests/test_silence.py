"""Silent jobs on a stream, by timers, are those of the same rule on a table."""

import random

from pyspark.sql import functions as F

from heddle.streaming import silence

SCHEMA = "job_id long, at double, seq long, status string, phase string"


def told(spark, tmp_path, batches, rounds=2):
    """What the stream tells when the batches come one after another."""
    source, out = tmp_path / "in", str(tmp_path / "out")
    source.mkdir()
    for n, batch in enumerate(batches):
        spark.createDataFrame(batch, SCHEMA).coalesce(1).write.json(str(source / f"b{n}"))
        stream = spark.readStream.schema(SCHEMA).option("recursiveFileLookup", True).json(str(source)).withColumn("ts", F.timestamp_seconds("at")).drop("at")
        q = silence.silent_jobs(stream, "1 second").writeStream.outputMode("append").format("parquet").option("path", out).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
        q.awaitTermination(180)
        assert q.exception() is None
    return sorted(map(tuple, spark.read.schema(silence.STALE).parquet(out).collect()), key=str)


def test_timers_tell_what_the_table_tells(spark, tmp_path):
    rng = random.Random(11)
    events, t = [], 0.0
    for seq in range(120):
        t += rng.choice([1, 20, 200, 700])
        events.append((rng.randrange(6), t, seq, rng.choice(["running"] * 8 + ["queued", "done"]), rng.choice(["parsing", "writing", None])))
    cuts = [events[:40], events[40:80], events[80:], [(99, t + 40_000, 999, "queued", None)], [(99, t + 40_100, 1000, "queued", None)]]
    got = told(spark, tmp_path, cuts)
    table = spark.createDataFrame(events, SCHEMA).withColumn("ts", F.timestamp_seconds("at"))
    want = sorted(map(tuple, silence.silences(table, int((t + 40_000) * 1000)).collect()), key=str)
    assert got == want and len({j for j, *_ in want}) > 3 and {p for _, p, _ in want} == {"parsing", "writing", None}


def test_a_silent_job_is_told_of_once(spark, tmp_path):
    """At 300 s, at 1800 s while it writes; not at all once it has ended; again after a new sign of life."""
    first = [(1, 1e6, 0, "running", "parsing"), (2, 1e6, 1, "running", "writing"), (3, 1e6, 2, "running", "parsing"), (3, 1e6 + 5, 3, "done", None)]
    clock = lambda t: [(9, 1e6 + t, 100 + int(t), "queued", None)]
    got = told(spark, tmp_path, [first, clock(299.0), clock(400.0), clock(900.0), [(1, 1e6 + 1000, 7, "running", "parsing")], clock(2500.0), clock(2600.0)])
    assert got == [(j, p, 1_000_000_000 + ms) for j, p, ms in ((1, "parsing", 300_000), (1, "parsing", 1_300_000), (2, "writing", 1_800_000))]
