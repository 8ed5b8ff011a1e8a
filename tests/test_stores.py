"""Stores: source trees, versioned snapshots, replayed batches."""

import os

import pytest
from pyspark.sql import functions as F

from heddle.functions import predicates
from heddle.sources import tables, walk
from heddle.sources.snapshots import Conflict, Snapshots
from heddle.streaming import watch

# --- walks ---------------------------------------------------------------------------------------


def tree(tmp_path, *paths):
    for i, p in enumerate(paths):
        (tmp_path / p).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / p).write_bytes(b"x" * i)


def test_folders_left_out_are_never_listed():
    seen = []
    content = {"": ["src", "node_modules", "lib"], "src": ["a", ".git"], "src/a": [], "lib": ["vendor"], "lib/vendor": ["keep", "other"], "lib/vendor/keep": []}

    def listed(folder):
        seen.append(folder)
        return content[folder], [("f.py", 1, 2)]

    rules = walk.Rules(unignore=("lib/vendor/keep",))
    got = sorted(p for p, *_ in walk.walked(listed, "", rules))
    assert got == ["f.py", "lib/f.py", "lib/vendor/f.py", "lib/vendor/keep/f.py", "src/a/f.py", "src/f.py"]
    assert sorted(seen) == ["", "lib", "lib/vendor", "lib/vendor/keep", "src", "src/a"]
    for fan_out in (1, 2, 3, 100):
        seen.clear()
        plan = walk.planned(listed, rules, fan_out)
        assert len(seen) <= fan_out
        assert sorted(p for f, deep in plan for p, *_ in walk.walked(listed, f, rules, deep)) == got


@pytest.mark.parametrize("exclude,unignore", [((), ()), (("src", "a/b"), ()), (("x",), ("lib/vendor/keep", "build"))])
def test_rules_are_those_of_the_column(spark, exclude, unignore):
    paths = ["src", "src/a", "a/b", "a/bc", "a/b/c", "lib", "lib/vendor", "lib/vendor/keep", "lib/vendor/keep/tmp", "lib/vendor/other", "build", "build/x", "q/build", "x/y", "y/x", ".git"]
    df = spark.createDataFrame([(p,) for p in paths], "path string")
    want = {r[0]: r[1] for r in df.select("path", predicates.prune_folder(F.col("path"), exclude, unignore)).collect()}
    assert {p: walk.Rules(exclude, unignore).pruned(p) for p in paths} == want


def test_source_tree(spark, tmp_path):
    tree(tmp_path, "a/__init__.py", "a/_private/b.py", "a/deep/er/c.py", "node_modules/x.js", "top.py", "é ü/d e.py", "_SUCCESS", "a/.x.crc")
    df = walk.source_tree(spark, str(tmp_path), fan_out=2)
    assert {r["path"]: r["size"] for r in df.collect()} == {"a/__init__.py": 0, "a/_private/b.py": 1, "a/deep/er/c.py": 2, "top.py": 4, "é ü/d e.py": 5}
    got = {r["path"]: bytes(r["content"]) for r in walk.with_content(df, str(tmp_path)).collect()}
    assert got["é ü/d e.py"] == b"x" * 5 and len(got) == 5
    os.utime(tmp_path / "top.py", ns=(10**18, 10**18))
    assert df.where("path = 'top.py'").first()["mtime_ns"] == 10**18
    assert sorted(r["path"] for r in walk.source_tree(spark, str(tmp_path), ignore=False).collect())[2:4] == ["a/deep/er/c.py", "node_modules/x.js"]
    assert tables.disk_usage(spark, str(tmp_path)).first() == (15, 6)
    (tmp_path / "none").mkdir()
    assert walk.source_tree(spark, str(tmp_path / "none")).count() == 0
    assert tables.source_files(spark, str(tmp_path), lambda p: p.endswith("c.py")).select("path", F.length("sha").alias("n")).collect() == [("a/deep/er/c.py", 64)]


def test_filters_bound_the_folders(spark, tmp_path):
    tree(tmp_path, "a/b/x.py", "a/c/y.py", "b/z.py")
    df = walk.source_tree(spark, str(tmp_path))
    assert [r["path"] for r in df.where(F.col("path").startswith("a/b")).collect()] == ["a/b/x.py"]
    assert [r["path"] for r in df.where("path IN ('b/z.py', 'a/c/y.py')").orderBy("path").collect()] == ["a/c/y.py", "b/z.py"]
    rules = walk.Rules(under=("a/b", "b/z.py"))
    assert [rules.pruned(x) for x in ("a", "a/b", "a/bb", "a/c", "b", "c")] == [False, False, False, True, False, True]


# --- snapshots -----------------------------------------------------------------------------------


def rows(df):
    return sorted(map(tuple, df.collect()))


def test_readers_see_one_version(spark, tmp_path):
    store = Snapshots(spark, str(tmp_path / "s"))
    assert store.current() == 0 and store.read() is None and store.versions() == []
    assert store.write(spark.range(3)) == 1
    before = store.read()
    half = before.union(spark.range(3, 5).select(F.raise_error("a write fails half-way").cast("long")))
    with pytest.raises(Exception, match="half-way"):
        store.write(half)
    assert store.current() == 1 and rows(store.read()) == [(0,), (1,), (2,)]
    store.write(before.union(spark.range(10, 11)))  # reads the table that it replaces
    assert rows(before) == [(0,), (1,), (2,)] and rows(store.read()) == [(0,), (1,), (2,), (10,)] and rows(store.read(1)) == rows(before)


def test_of_two_writers_one_loses(spark, tmp_path):
    store, other = Snapshots(spark, str(tmp_path / "s")), Snapshots(spark, f"file://{tmp_path}/s")
    base = store.write(spark.range(1))
    assert other.write(spark.range(2), base) == 2
    with pytest.raises(Conflict):
        store.write(spark.range(3), base)
    assert store.current() == 2 and store.read().count() == 2
    assert len(list((tmp_path / "s" / "data").iterdir())) == 2  # the loser's rows are gone
    assert [x.name for x in (tmp_path / "s" / "versions").iterdir() if not x.name.endswith(".crc")] and store.write(spark.range(3)) == 3


def test_vacuum_keeps_the_newest(spark, tmp_path):
    store = Snapshots(spark, str(tmp_path / "s"))
    for n in range(1, 5):
        store.write(spark.range(n))
    assert store.vacuum(2) == [1, 2] and store.versions() == [3, 4] and store.read(3).count() == 3
    assert len(list((tmp_path / "s" / "data").iterdir())) == 2 and store.vacuum(0) == [3]


def test_centrality_is_replaced_whole(spark, tmp_path):
    ranks = lambda *xs: spark.createDataFrame([(n, r, None) for n, r in xs], tables.RANKS)
    where = str(tmp_path)
    assert tables.centrality_read(spark, where, "r").count() == 0
    assert tables.centrality_written(ranks(("a", 1.0), ("b", 2.0)), where, "r") == 2
    reader = tables.centrality_read(spark, where, "r")
    tables.centrality_written(ranks(("c", 3.0)), where, "r")
    assert sorted(r[0] for r in reader.collect()) == ["a", "b"] and [r[0] for r in tables.centrality_read(spark, where, "r").collect()] == ["c"]
    tables.centrality_cleared(spark, where, "r")
    assert tables.centrality_read(spark, where, "r").count() == 0


# --- changes applied once ------------------------------------------------------------------------


def files(spark, *xs):
    return spark.createDataFrame([(p, t, 1, s) for p, t, s in xs], "path string, mtime_ns long, size long, sha string")


def test_a_replayed_batch_changes_nothing(spark, tmp_path):
    store = Snapshots(spark, str(tmp_path / "s"))
    run = watch.indexed_once(store, "watch")
    run(files(spark, ("a", 1, "1"), ("b", 1, "1")), 0)
    second = files(spark, ("a", 2, "old"), ("a", 5, "new"), ("a", 3, "older"), ("c", 1, "1"), ("b", 9, None))
    run(second, 1)
    want = [("a", 5, 1, "new"), ("c", 1, 1, "1")]
    assert rows(store.read().select("path", "mtime_ns", "size", "sha")) == want
    version = store.current()
    run(files(spark, ("a", 99, "replayed with other rows")), 1)  # the stream lost its note of the batch and sends it again
    assert store.current() == version and rows(store.read().select("path", "mtime_ns", "size", "sha")) == want
    run(files(spark, ("a", 6, "new")), 2)
    assert store.current() == version  # nothing new


def test_a_batch_that_fails_is_applied_when_it_comes_again(spark, tmp_path):
    store = Snapshots(spark, str(tmp_path / "s"))
    broken = [True]

    def index(changed):
        return changed.withColumn("size", F.raise_error("no").cast("long") if broken[0] else F.col("size"))

    run = watch.indexed_once(store, "watch", index)
    with pytest.raises(Exception, match="no"):
        run(files(spark, ("a", 1, "1")), 0)
    assert store.current() == 0
    broken[0] = False
    run(files(spark, ("a", 1, "1")), 0)
    run(files(spark, ("a", 1, "1")), 0)
    assert store.current() == 1 and store.read().count() == 1


def test_a_stream_ends_as_its_last_writes(spark, tmp_path):
    source, store = tmp_path / "in", Snapshots(spark, str(tmp_path / "s"))
    source.mkdir()
    schema = "path string, mtime_ns long, size long, sha string"
    run = watch.indexed_once(store, "watch")
    calls = []

    def twice(batch, number):  # fails after its write, so that the stream sends it again
        run(batch, number)
        calls.append(number)
        if len(calls) == 1:
            raise RuntimeError("lost after the write")

    def start():
        stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).json(str(source))
        return stream.writeStream.option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).foreachBatch(twice).start()

    files(spark, ("a", 1, "1"), ("b", 1, "1")).coalesce(1).write.mode("append").json(str(source))
    with pytest.raises(Exception, match="lost after the write"):
        start().awaitTermination()
    files(spark, ("a", 2, "2")).coalesce(1).write.mode("append").json(str(source))
    start().awaitTermination()
    assert calls[:2] == [0, 0] and store.current() == 2
    assert rows(store.read().select("path", "sha")) == [("a", "2"), ("b", "1")]


def test_partial_index_takes_the_later_version(spark):
    seen = []
    run = watch.partial_index(lambda: files(spark, ("a", 0, "0")), lambda df: seen.append(rows(df.select("path", "sha"))))
    run(files(spark, ("a", 2, "2"), ("a", 3, "0"), ("b", 1, "x"), ("b", 2, "y")), 0)
    assert seen == [[("b", "y")]]
