"""Neighbours in blocks, clusters of a defined start, stored lists, kept results."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from heddle.operators import nearest
from heddle.sources.results import Results

SCHEMA = "vec_id long, embedding array<double>, key string, list int"


def frame(spark, rows):
    return spark.createDataFrame([(i, v, "x", 1) for i, v in rows], SCHEMA).repartition(3)


def plain(queries, rows, k, dims):
    unit = {}
    for i, v in rows:
        if i is not None and v is not None and all(x is not None and np.isfinite(x) for x in v):
            u = np.zeros(dims)
            u[: len(v)] = v
            n = np.linalg.norm(u)
            if n and (i not in unit or v < unit[i][1]):
                unit[i] = (u / n, v)
    out = []
    for q in {i for i, _ in queries} & set(unit):
        s = sorted((-round(float(unit[q][0] @ u), 9) + 0.0, i) for i, (u, _) in unit.items() if i != q)[:k]
        out += [(q, r, i, round(-d, 6)) for r, (d, i) in enumerate(s, 1)]
    return sorted(out)


def got(df):
    return sorted((r["query"], r["rank"], r["key"], round(r["score"], 6) + 0.0) for r in df.collect())


def clustered(n, dims, groups=8, spread=0.4, seed=3):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(groups, dims))
    return [(i, (centres[rng.integers(groups)] + rng.normal(size=dims) * spread).tolist()) for i in range(n)]


@pytest.mark.parametrize("n,dims,k", [(300, 12, 7), (40, 1, 3), (60, 4, 100)])
def test_neighbours_of_all(spark, monkeypatch, n, dims, k):
    monkeypatch.setattr(nearest, "ROW_CELLS", 32 * dims)
    monkeypatch.setattr(nearest, "QUERY_CELLS", 16 * dims)
    monkeypatch.setattr(nearest, "HELD", 3)
    rows = clustered(n, dims)
    df = frame(spark, rows)
    assert got(nearest.k_nearest(df, df, k)) == plain(rows, rows, k, dims)


def test_odd_vectors(spark):
    """Missing, empty, zero, short and repeated vectors, a key twice, ties, strings as keys, nothing at all."""
    rng = random.Random(1)
    rows = [(i, [rng.choice([0.0, 1.0, -1.0]) for _ in range(3)]) for i in range(60)] + [(7, [9.0, 9.0, 9.0])] * 5
    rows += [(100, None), (101, [1.0, None]), (102, [float("nan")] * 3), (103, []), (104, [0.0] * 3), (105, [1.0]), (None, [1.0, 1.0])]
    df = frame(spark, rows)
    asked = frame(spark, [r for r in rows if r[0] in (3, 7, 104, 105)])
    assert got(nearest.k_nearest(asked, df, 4)) == plain([(3, 0), (7, 0), (105, 0)], rows, 4, 3)
    named = df.withColumn("vec_id", F.format_string("n%03d", "vec_id"))
    assert nearest.k_nearest(named, named, 2).where("query = 'n003'").count() == 2
    assert nearest.k_nearest(df, df.limit(0), 3).count() == 0 and nearest.k_nearest(df.limit(0), df, 3).count() == 0


def test_stored_lists(spark, tmp_path):
    rows = clustered(1200, 16, groups=30)
    df = frame(spark, rows)
    index = nearest.InvertedLists(spark, str(tmp_path / "lists"))
    assert index.search(df, 3).count() == 0
    index.build(df)
    exact = got(nearest.k_nearest(df, df, 10))
    truth = {(q, i) for q, _, i, _ in exact}
    found = {(q, i) for q, _, i, _ in got(index.search(df, 10))}
    assert len(found & truth) / len(truth) >= 0.9  # recall at ten
    assert 1 <= index.store.read().first()["probes"] < 18  # of 35 lists
    some = df.where("vec_id < 40")
    assert got(index.search(some, 10, probes=10_000)) == [x for x in exact if x[0] < 40]  # all lists are exact
    files = sorted(p.name for p in (tmp_path / "lists").rglob("*.parquet"))
    index.search(some, 5).count()
    assert files == sorted(p.name for p in (tmp_path / "lists").rglob("*.parquet"))  # searches reuse it
    index.build(df.where("vec_id < 100"), 4)
    assert {i for _, _, i, _ in got(index.search(some, 3, probes=4))} <= set(range(100))


def test_clusters_start_where_they_should(spark):
    """The smallest key, then the farthest; the centres are those of plain steps; one without members moves."""
    rows = clustered(200, 5, groups=4, spread=0.1, seed=8)
    unit = np.array([v for _, v in rows])
    unit /= np.linalg.norm(unit, axis=1, keepdims=True)
    centres = unit[:1]
    while len(centres) < 4:
        d = np.round(((unit[:, None] - centres) ** 2).sum(axis=2).min(axis=1), 9)
        centres = np.vstack([centres, unit[int(d.argmax())]])
    for _ in range(6):
        given = ((unit[:, None] - centres) ** 2).sum(axis=2).argmin(axis=1)
        centres = np.array([unit[given == c].mean(axis=0) for c in range(4)])
    df = frame(spark, rows).select(F.col("vec_id").alias("key"), F.col("embedding").alias("vector"))
    mine, dims = nearest.k_means(df, 4, 6)
    assert dims == 5 and np.allclose(mine, centres, atol=1e-9)
    same = frame(spark, [(i, [1.0, 0.0]) for i in range(5)])
    assert {(r["cluster"], r["size"], r["label"]) for r in nearest.clusters(same, 3).collect()} == {(0, 5, 0)}
    assert nearest.clusters(same.limit(0), 3).count() == 0


def test_an_empty_cluster_moves_to_the_worst_fit(spark, monkeypatch):
    rows = [(0, [1.0, 0.0]), (1, [0.99, 0.1]), (2, [0.0, 1.0]), (3, [-1.0, 0.05])]
    df = frame(spark, rows).select(F.col("vec_id").alias("key"), F.col("embedding").alias("vector"))
    real, calls = nearest._sums, []

    def sums(rows, centres, dims):
        calls.append(centres.copy())
        n, total = real(rows, centres, dims)
        if len(calls) == 1:
            n[1], total[1] = 0, 0  # as if the second had no members
        return n, total

    monkeypatch.setattr(nearest, "_sums", sums)
    nearest.k_means(df, 2, 2)
    far = nearest._farthest(df, calls[0], 2)[0][2]
    assert np.allclose(calls[1][1], far)


def test_kept_results(spark, tmp_path):
    one, two = Results(spark, str(tmp_path / "r")), Results(spark, str(tmp_path / "r"))
    ask = lambda n=3: spark.range(n).withColumn("x", F.col("id") * 2).groupBy("x").count()
    assert one.get(ask(), {"t": 1}).count() == 3 and two.get(ask(), {"t": 1}).count() == 3 and (one.made, two.made) == (1, 0)
    two.get(ask(), {"t": 2})
    two.get(ask(4), {"t": 2})
    two.get(spark.range(3).withColumn("x", F.col("id") * 3).groupBy("x").count(), {"t": 2})
    assert two.made == 3
    other = spark.newSession()
    assert Results(other, str(tmp_path / "r")).get(other.range(3).withColumn("x", F.col("id") * 2).groupBy("x").count(), {"t": 1}).count() == 3
    assert one.entries().count() == 4
    newest = one.entries().agg(F.max("mtime")).first()[0]
    assert one.evict(10**9, 10**9, newest) == [] and len(one.evict(10**9, 0, newest)) == 4 and one.entries().count() == 0


def test_what_tasks_find_does_not_grow_with_the_blocks_of_rows(spark, monkeypatch, tmp_path):
    rng = np.random.default_rng(3)
    df = spark.createDataFrame([(i, [float(x) for x in rng.standard_normal(8)]) for i in range(600)], "vec_id long, embedding array<double>")
    monkeypatch.setattr(nearest, "MOST_ROWS", 16)
    monkeypatch.setattr(nearest, "MOST_QUERIES", 16)
    found, scanned = spark.sparkContext.accumulator(0), nearest._scanned

    def counted(*args):
        scan = scanned(*args)

        def run(batches):
            for b in scan(batches):
                found.add(b.num_rows)
                yield b

        return run

    monkeypatch.setattr(nearest, "_scanned", counted)
    index = nearest.InvertedLists(spark, str(tmp_path / "i"))
    index.build(df, 12)
    for out in (nearest.k_nearest(df, df, 3), index.search(df, 3, probes=12)):
        before = found.value
        assert len(out.collect()) == 1800
        assert found.value - before <= 1800 * nearest.GROUPS  # 38 blocks of rows and 12 lists before
