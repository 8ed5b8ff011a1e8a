"""Line dedup against a plain version: shared lines, ties, copies, missing texts and keys."""

import hashlib
import random
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from heddle.llm import common, line_dedup

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
SCHEMA = "doc_id long, text string, n_lines string, keep int, _k string"


def plain(rows, least, keep="none"):
    """(doc_id, text) to lines before, lines dropped and text that stays."""
    where = defaultdict(dict)
    for d, t in dict.fromkeys(rows):
        for i, line in enumerate((t or "").split("\n")):
            k = line.strip(" \t\n\x0b\x0c\r").translate(LOWER)
            if k:
                where[k].setdefault((d, t or ""), i)
    repeated = {k for k, v in where.items() if len(v) >= least}
    out = []
    for d, t in rows:
        lines = (t or "").split("\n")
        stays = []
        for i, x in enumerate(lines):
            k = x.strip(" \t\n\x0b\x0c\r").translate(LOWER)
            first = keep == "first" and k in repeated and min(where[k], key=lambda y: y[0]) == (d, t or "") and where[k][d, t or ""] == i
            if k not in repeated or first:
                stays.append(x)
        out.append((d, len(lines), len(lines) - len(stays), hashlib.sha256("\n".join(stays).encode()).hexdigest()))
    return sorted(out, key=str)


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(3)
    shared = [f"Shared line {i} É" for i in range(6)] + [" ", "é", "É", "x"]
    out = []
    for i in range(60):
        lines = [rng.choice(shared) if rng.random() < 0.5 else f"own {i} {j}" for j in range(rng.randrange(0, 12))]
        out.append((i, "\n".join(rng.choice([x, x.upper(), f" \t{x}\r", x]) for x in lines)))
    out += [(100, None), (101, ""), (102, "\n\n"), (103, "Shared line 0 É\n" * 500), (104, "z" * 200_000 + "\nshared line 1 É"), (105, "\n".join(f"l{i}" for i in range(5000)))]
    return out


def result(df, rows_of, **k):
    return sorted((tuple(r) for r in line_dedup.digest(df, line_dedup.keep_bitmaps(df, **k)).collect()), key=str)


@pytest.mark.parametrize("least,keep", [(10, "none"), (2, "none"), (2, "first"), (1, "none")])
def test_equals_plain(spark, rows, least, keep):
    df = spark.createDataFrame([(d, t, "a", 1, "b") for d, t in rows], SCHEMA).repartition(3)
    assert result(df, rows, min_docs=least, keep=keep) == plain(rows, least, keep)


def test_repeated_rows_and_keys(spark):
    """A row many times is one document; rows that share a key, null too, but not a text are documents of their own."""
    rows = [(1, "a\nb")] * 50 + [(2, "a\nc"), (None, "b\nq"), (None, "b\nr"), (3, None)]
    df = spark.createDataFrame([(d, t, "a", 1, "b") for d, t in rows], SCHEMA)
    assert result(df, rows, min_docs=3) == plain(rows, 3)
    assert sum(x[2] for x in result(df, rows, min_docs=3)) == 52  # b goes, a doesn't
    empty = df.limit(0)
    assert result(empty, [], min_docs=3) == []
    with pytest.raises(ValueError):
        line_dedup.keep_bitmaps(df, keep="last")


def test_many_repeated_lines_are_joined_by_hot_keys(spark, rows, monkeypatch):
    """Beyond the limit of a broadcast, rows of hot lines stay, those of others are shuffled."""
    monkeypatch.setattr(line_dedup, "by_key", lambda left, right, on, n: common.by_key(left, right, on, n, rows=2))
    monkeypatch.setattr(common, "HOT_ROWS", 20)
    df = spark.createDataFrame([(d, t, "a", 1, "b") for d, t in rows], SCHEMA).repartition(3)
    assert result(df, rows, min_docs=2) == plain(rows, 2)


def test_bitmaps_are_runs_of_lines(spark):
    df = spark.createDataFrame([(1, "a\nx\nx\nb"), (2, "x"), (3, "c\nx"), (4, "d")], "doc_id long, text string")
    got = {r["doc_id"]: list(r["keep"]) for r in line_dedup.keep_bitmaps(df, min_docs=3).collect()}
    assert got == {1: [1, 2, 1], 2: [0, 1, 0], 3: [1, 1, 0], 4: [1]}


def test_a_hot_line_lies_in_several_ranges(spark):
    """The plan partitions by ranges of (hash, document): a line that all documents share isn't one task's."""
    df = spark.range(4000).select(F.col("id").alias("doc_id"), F.lit("the same line").alias("text"))
    ranged = df.select(F.xxhash64("text").alias("a"), "doc_id").repartitionByRange(4, "a", "doc_id")
    assert max(r["n"] for r in ranged.groupBy(F.spark_partition_id().alias("p")).agg(F.count("*").alias("n")).collect()) < 2000
    got = line_dedup.keep_bitmaps(df)
    assert got.where("n_dropped = 1").count() == 4000
    plan = line_dedup.digest(df, got)._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan
