"""The segmented index gives what an index made anew of its live documents gives."""

import math
import random
import re
from collections import Counter, defaultdict

import pytest

from heddle.operators import segments
from heddle.operators.segments import SegmentedIndex
from heddle.sources.snapshots import Conflict

SCHEMA = "repo string, doc_id long, title string, body string"


def plain(docs, query, k, repo=None, k1=1.2, b=0.75):
    """docs: (repo, key) to (title, body)."""
    terms = list(dict.fromkeys(re.findall("[a-z][a-z0-9]+", query.lower().replace(".", " ").replace("_", " "))))
    docs = {d: v for d, v in docs.items() if repo is None or d[0] == repo}
    out = defaultdict(float)
    for f in range(2):
        toks = {d: re.findall("[a-z][a-z0-9]+", (v[f] or "").lower()) for d, v in docs.items()}
        if not toks:
            continue
        avg = sum(map(len, toks.values())) / len(toks)
        for t in terms:
            df = sum(t in x for x in toks.values())
            for d, x in toks.items():
                if tf := Counter(x)[t]:
                    out[d] += math.log(1 + (len(toks) - df + 0.5) / (df + 0.5)) * tf * (k1 + 1) / (tf + k1 * (1 - b + b * len(x) / avg))
    best = sorted(out.items(), key=lambda x: (-round(x[1], 9), x[0]))[:k]
    return [(*d, round(s, 6)) for d, s in best]


def found(index, query, k=10, **more):
    return [(r["repo"], r["key"], round(r["score"], 6)) for r in index.search(query, k, **more).hits.orderBy("rank").collect()]


def frame(spark, docs):
    return spark.createDataFrame([(*d, *v) for d, v in docs.items()], SCHEMA)


def some(rng, n, start=0, repos=("r1", "r2")):
    text = lambda m: " ".join(rng.choice(["alpha", "beta", "gamma", f"w{rng.randrange(30)}", "the"]) for _ in range(rng.randrange(m)))
    return {(rng.choice(repos), start + i): (text(6), text(40)) for i in range(n)}


@pytest.fixture
def index(spark, tmp_path):
    return SegmentedIndex(spark, str(tmp_path / "i"), ["title", "body"], key_type="long")


QUERY = "the.alpha w3 W7 nowhere"


def test_additions_replacements_deletions_and_merges(spark, index):
    rng = random.Random(4)
    live = some(rng, 60)
    index.add(frame(spark, live))

    def holds():
        for repo in (None, "r1", "r9"):
            assert found(index, QUERY, 12, repo=repo) == plain(live, QUERY, 12, repo)

    holds()
    more = some(rng, 30, 40)  # some keys that there are, in either repository
    live |= more
    index.add(frame(spark, more))
    holds()
    gone = [d for d in live if d[1] % 7 == 0]
    index.remove(spark.createDataFrame([*gone, ("r1", 999)], "repo string, doc_id long"))
    live = {d: v for d, v in live.items() if d not in gone}
    holds()
    again = {gone[0]: ("alpha back", "the alpha"), next(iter(live)): ("replaced twice", "the w3")}
    live |= again
    index.add(frame(spark, again))
    holds()
    assert len(index.segments()) == 4
    index.merge(2)
    assert len(index.segments()) == 3
    holds()
    live.pop(gone[0])
    index.remove(spark.createDataFrame([gone[0]], "repo string, doc_id long"))
    holds()
    index.merge()
    assert len(index.segments()) == 1
    holds()
    assert index.vacuum(1) >= 5
    holds()


def test_adding_the_same_rows_again_changes_no_score(spark, index):
    docs = {("r", 1): ("", "alpha beta"), ("r", 2): ("alpha", "alpha"), ("s", 1): ("", "alpha beta gamma")}
    index.add(frame(spark, docs))
    first = found(index, "alpha")
    index.add(frame(spark, docs))
    assert found(index, "alpha") == first == plain(docs, "alpha", 10)
    assert {x[:2] for x in first} == set(docs)  # equal keys of two repositories are two documents


def test_blocks_are_skipped_without_a_change(spark, index, monkeypatch):
    rng = random.Random(9)
    monkeypatch.setattr(segments, "BLOCK", 16)
    monkeypatch.setattr(segments, "HEAD", 2)
    docs = {("r", i): ("", " ".join(["rare"] * (5 if i % 300 == 0 else 0) + ["common"] * rng.choice([1, 1, 1, 2, 6]) + ["filler"] * rng.randrange(5, 200))) for i in range(1500)}
    index.add(frame(spark, docs))
    for q in ("common", "common rare"):
        got = index.search(q, 5)
        assert [(r["repo"], r["key"], round(r["score"], 6)) for r in got.hits.orderBy("rank").collect()] == plain(docs, q, 5)
        assert got.blocks > 90 and (got.read < got.blocks / 10 or q != "common")  # a rare term's bound leaves no common block out


def test_a_frequent_term_is_in_several_tasks(spark, index):
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    docs = frame(spark, {("r", i): ("", "common") for i in range(3000)}).repartition(3)
    blocks = index._blocks(index.documents(docs).selectExpr("0L AS seq", "*"))
    parts = blocks.where("term = 'common'").selectExpr("shiftright(block, 26)").distinct().count()
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert parts > 1
    assert blocks.agg({"n": "max"}).first()[0] <= segments.BLOCK and blocks.agg({"n": "sum"}).first()[0] == 3000


def test_odd_queries_and_empty_tables(spark, index):
    assert found(index, "alpha") == [] and index.merge() == 0
    index.add(frame(spark, {("r", 1): ("al", "alpha")}).limit(0))
    assert found(index, "alpha") == []
    index.add(frame(spark, {("r", 1): (None, "alpha"), ("r", 2): ("x1", None)}))
    assert found(index, "  '\"") == [] and found(index, "alpha OR (") == plain({("r", 1): (None, "alpha"), ("r", 2): ("x1", None)}, "alpha or", 9)
    assert found(index, "alpha", 0) == [] and found(index, "alpha", fields=["title"]) == []
    twice = frame(spark, {("r", 3): ("", "alpha")}).union(frame(spark, {("r", 3): ("", "alpha alpha")}))
    index.add(twice)
    assert {x[1] for x in found(index, "alpha")} == {1, 3}


def test_of_two_writers_one_loses(spark, index, monkeypatch):
    docs = frame(spark, {("r", 1): ("", "alpha")})
    index.add(docs)
    late = index.store.current
    monkeypatch.setattr(index.store, "current", lambda: late() - 1)
    with pytest.raises(Conflict):
        index.add(docs)
    monkeypatch.undo()
    assert len(index.segments()) == 1 and len(found(index, "alpha")) == 1
