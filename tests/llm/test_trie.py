"""The prefix trie against a plain version: shared, missing, empty, long and repeated conversations."""

import hashlib
import random
import zlib
from collections import defaultdict

import pytest

from heddle.llm import common, prefix_trie as pt

SCHEMA = "conv_id long, turn long, role string, text string, depth string, node int, a string"


def plain(rows, group=100, most=6):
    own = defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            own[c].append((turn is not None, turn or 0, role or "", text or ""))
    own = {c: [x[2:] for x in sorted(v)] for c, v in own.items()}
    built = {}
    for c, v in own.items():
        h = zlib.crc32(str(c).encode()) % most
        lead = c - int(c / group) * group if c < 0 else c % group
        built[c] = own.get(c - lead, [])[:h] + v[h:]
    nodes = defaultdict(list)
    for c, v in sorted(built.items()):
        for d in range(len(v) + 1):
            nodes[tuple(v[:d])].append(c)
    sub = {k: [0, 0] for k in nodes}
    for k, members in nodes.items():
        leaf = not any(len(built[c]) > len(k) for c in members)
        for d in range(len(k) + 1):
            sub[k[:d]][0] += leaf
            sub[k[:d]][1] += (len(members) - 1) * (len(k[-1][1]) if k else 0)
    out = []
    for k, members in nodes.items():
        children = {tuple(built[c][: len(k) + 1]) for c in members if len(built[c]) > len(k)}
        ends = ",".join(str(c) for c in members if len(built[c]) == len(k))
        out.append((members[0], len(k), nodes[k[:-1]][0] if k else None, len(members), len(children), *sub[k], hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out, key=str)


def result(spark, rows):
    df = spark.createDataFrame([(*r, "x", 1, "y") for r in rows], SCHEMA).repartition(3)
    turns, sizes = pt.numbered_turns(df)
    return sorted((tuple(r) for r in pt.prefix_trie(*pt.borrowed(turns, sizes)).collect()), key=str)


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(8)
    out = []
    for c in [*range(0, 230, 3), 100, 200, -5, -100, 555]:
        for t in range(rng.randrange(1, 7)):
            out.append((c, None if t == 1 and rng.random() < 0.4 else t, rng.choice(["user", None]), rng.choice(["a", "é" * 3, None, "", f"own {c}"])))
    out += [(900, 0, "user", "same"), (900, 1, "user", "z" * 100_000), *[(901, t, "user", "again") for t in range(12)], *[(902, t, "user", "again") for t in range(12)]]
    return out + [(None, 0, "user", "lost"), (None, None, None, None)]


def test_equals_plain(spark, rows):
    assert result(spark, rows) == plain(rows)


def test_ties_are_one_order(spark):
    """Turns with one number go by their hashes, in the same order everywhere."""
    rows = [(c, 1, "user", x) for c in (7, 8, 9) for x in ("p", "q", "r")] * 2
    got = result(spark, rows)
    assert got == result(spark, rows[::-1]) and max(r[1] for r in got) == 6


def test_hot_conversations_and_nodes(spark, rows, monkeypatch):
    """Many copies of one conversation, ids digested in parts, hot nodes that stay where they are."""
    monkeypatch.setattr(pt, "PART_BYTES", 20)
    monkeypatch.setattr(common, "HOT_ROWS", 30)
    monkeypatch.setattr(pt, "by_key", lambda left, right, on, n: common.by_key(left, right, on, n, rows=1))
    more = rows + [(c, t, "user", f"common {t}") for c in range(1000, 1200) for t in range(3)]
    assert result(spark, more) == plain(more)


def test_empty_and_turnless(spark):
    assert result(spark, []) == []
    rows = [(6, 0, "u", "x"), (7, 0, "u", "x"), (8, 0, "u", "x")]  # no group's first one: those that lend a turn or more are turnless
    assert result(spark, rows) == plain(rows)
    one = [(100, 0, "u", "x")]
    assert result(spark, one) == plain(one)


def test_numbering_spans_ranges(spark):
    """A conversation of many turns lies in several tasks' ranges and is numbered without a gap."""
    df = spark.range(5000).selectExpr("1L AS conv_id", "id AS turn", "'u' AS role", "CAST(id AS string) AS text")
    turns, sizes = pt.numbered_turns(df)
    assert turns.count() == 5000 and turns.select("depth").distinct().count() == 5000 and turns.agg({"depth": "max"}).first()[0] == 5000
    assert sizes.collect()[0]["size"] == 5000
