"""Hard negatives against a plain version: ties, odd rows, huge components, blocks of few rows."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from heddle.llm import hard_negatives as hn

SCHEMA = "vec_id long, embedding array<float>, label int, id int, q string"


def plain(rows, anchor, positives=5, negatives=10, low=30, high=90):
    used = {}
    for i, v, y in rows:
        if i is None or y is None or v is None or any(x is None or not np.isfinite(x) for x in v):
            continue
        q = [int(max(-hn.LARGEST, min(hn.LARGEST, np.floor(256 * float(np.float32(x)))))) for x in v]
        used[i] = min(used.get(i, (y, q)), (y, q))
    dot = lambda p, q: sum(a * b for a, b in zip(p, q, strict=False))
    out = []
    for a, (y, q) in used.items():
        if not anchor(a):
            continue
        s = sorted((-dot(q, p), i, z) for i, (z, p) in used.items() if i != a)
        for n, i, _ in [x for x in s if x[2] == y][:positives]:
            fit = [(b, m) for m, b, z in s if z != y and low * -n <= 100 * -m <= high * -n][:negatives]
            out += [(a, i, r, b, -n, -m) for r, (b, m) in enumerate(fit, 1)]
    return sorted(out)


def frame(spark, rows):
    return spark.createDataFrame([(i, v, y, 1, "x") for i, v, y in rows], SCHEMA).repartition(3)


def clustered(n, dims, seed=1):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(6, dims))
    out = []
    for i in range(n):
        v = centres[i % 6] + rng.normal(size=dims) * 0.7
        out.append((i, [float(x) for x in v / np.linalg.norm(v)], int(rng.integers(0, 4))))
    return out


@pytest.mark.parametrize("n,dims", [(400, 24), (60, 1), (90, 3)])
def test_equals_plain(spark, monkeypatch, n, dims):
    monkeypatch.setattr(hn, "ROW_CELLS", 32 * dims)
    monkeypatch.setattr(hn, "ANCHOR_CELLS", 16 * dims)
    rows = clustered(n, dims)
    got = sorted(map(tuple, hn.hard_negatives(frame(spark, rows), lambda i: i % 10 == 0).collect()))
    assert got == plain(rows, lambda i: i % 10 == 0) and (got or dims == 1)


def test_odd_rows(spark):
    """Ties, repeats, a key twice, missing and infinite values, lengths, few positives, all equal, extra columns."""
    rng = random.Random(2)
    rows = [(i, [rng.choice([0.0, 0.5, -0.5]) for _ in range(4)], i % 3) for i in range(80)]
    rows += rows[:5] * 40 + [(7, [0.5] * 4, 0), (7, [0.25] * 4, 2)]
    rows += [(200, None, 1), (210, [0.1, None], 1), (220, [float("nan")] * 4, 1), (230, [float("inf")] * 4, 1), (240, [0.5] * 4, None), (None, [0.5] * 4, 1)]
    rows += [(250, [0.5] * 7, 1), (260, [], 1), (270, [0.5, 0.5], 9), (280, [3e38, -3e38, 0.0, 1.0], 2), (290, [1e6] * 4, 0)]
    got = sorted(map(tuple, hn.hard_negatives(frame(spark, rows), lambda i: i % 10 == 0).collect()))
    assert got == plain(rows, lambda i: i % 10 == 0)
    none = hn.hard_negatives(frame(spark, rows).limit(0), lambda i: i % 10 == 0)
    assert none.count() == 0 and none.columns == ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]


def test_bounds_lose_nothing_and_discard_early():
    rng = np.random.default_rng(4)
    q = np.floor(rng.normal(size=(600, 32)) * np.linspace(3, 0.05, 32) * 100).astype(np.int64)
    turn = np.linalg.eigh((q.T @ q).astype(float))[1][:, ::-1].copy()
    share, steps = hn.slack(turn), (8, 16)
    assert share < 1e-11
    make = lambda m: hn.Block({"size": len(m), "ids": np.arange(len(m)).tobytes(), "labels": np.zeros(len(m), np.int64).tobytes(), "scores": b"", "q": m.astype(np.int32).tobytes(), "rotated": (m @ turn).tobytes()}, 32, steps)
    a, b = make(q[:50]), make(q[50:])
    s = q[:50] @ q[50:].T
    least = np.sort(s, axis=1)[:, -5]
    verified = []
    products = np.einsum
    try:
        np.einsum = lambda spec, x, y: (verified.append(len(x)) if x.dtype == np.int64 else None, products(spec, x, y))[1]
        i, j, got = hn.survivors(a, b, np.ones(s.shape, bool), least, np.full(50, s.max()), steps, share)
    finally:
        np.einsum = products
    want = np.argwhere(s >= least[:, None])
    assert sorted(zip(i, j, strict=True)) == sorted(map(tuple, want)) and (s[i, j] == got).all()
    assert sum(verified) < s.size / 20  # the rest was discarded by bounds


def test_best_keeps_ties_by_id():
    best = hn.Best(2, 2)
    best.add(np.array([0, 0, 1]), np.array([5, 5, 1]), np.array([9, 8, 3]))
    best.add(np.array([0, 0]), np.array([5, 4]), np.array([7, 1]))
    assert list(zip(best.group.tolist(), best.score.tolist(), best.id.tolist(), strict=True)) == [(0, 5, 7), (0, 5, 8), (1, 1, 3)]
    assert best.least.tolist() == [5, hn.NONE]


def test_held_lists_are_emptied(spark, monkeypatch):
    """A task that meets more anchor blocks than it may hold gives its lists and begins new ones."""
    rows = clustered(300, 6)
    monkeypatch.setattr(hn, "HELD", 1)
    monkeypatch.setattr(hn, "ROW_CELLS", 6 * 40)
    monkeypatch.setattr(hn, "ANCHOR_CELLS", 6)
    got = sorted(map(tuple, hn.hard_negatives(frame(spark, rows), lambda i: F.lit(5) * 1 == i % 6).collect()))
    assert got == plain(rows, lambda i: i % 6 == 5)
