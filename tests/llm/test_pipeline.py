"""The pipeline against a plain version of its stages, and the queries' SQL."""

import itertools
import os
import zlib

import duckdb
import numpy as np
import pytest

from heddle.llm import queries

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    if not os.path.isdir(SF):
        pytest.skip("no driver tables")
    con = duckdb.connect()
    for t in ("documents", "benchmark", "labels", "embeddings", "conversations"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_query_equals_its_sql(spark, duck, name):
    got = queries.queries()[name](spark, SF).toPandas()
    want = duck.sql(queries.oracle_sql()[name]).df()
    columns = sorted(got.columns)
    assert columns == sorted(want.columns)
    order = lambda df: df[columns].convert_dtypes().astype(str).sort_values(columns).reset_index(drop=True)
    assert order(got).equals(order(want))


def test_pipeline(spark, duck):
    import public_tokenizers
    from tokenizers import Tokenizer

    import corpus_pipeline as C
    from heddle.llm import pii, quality_classifier
    from tests.llm.test_free import plain_components
    from tests.llm.test_native import plain_decontamination

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    model = quality_classifier.fit(docs, spark.read.parquet(f"{SF}/labels.parquet"))
    good = {r["doc_id"] for r in quality_classifier.score(docs, model).where("predicted = 1").collect()}
    rows = sorted((r["doc_id"], r["text"]) for r in docs.collect() if r["doc_id"] in good)
    kept = plain_components(rows)
    rows = [(i, t) for i, t in rows if kept[i][2]]
    items = duck.sql("SELECT item_id, text FROM benchmark").fetchall()
    hits = plain_decontamination([t for _, t in rows], items)
    rows = [r for r, h in zip(rows, hits, strict=True) if not h[-1]]
    names = pii.Pseudonyms(queries.PSEUDONYM_KEY.encode())
    want = {i: names.replaced(t)[0] for i, t in rows}

    stage = docs
    for name, f in C.STAGES[:4]:
        stage = C.written(f(spark, stage, SF))
        assert stage.columns == C.COLUMNS, name
    assert {r["doc_id"]: r["text"] for r in stage.collect()} == want
    packed = C.STAGES[4][1](spark, stage, SF).collect()
    assert {r["doc_id"] for r in packed} == set(want)
    tok = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    ids = {i: tok.encode(t or "", add_special_tokens=False).ids + [0] for i, t in want.items()}
    pieces = {(r["doc_id"], r["piece"]): (r["start"], r["length"], r["ids_crc32"]) for r in packed}
    assert len(pieces) == len(packed)
    for i, own in ids.items():
        cuts = [0, *range(len(own) % 2048 or 2048, len(own) + 1, 2048)]
        whole = [(a, b - a, zlib.crc32(np.array(own[a:b], dtype="<u4").tobytes())) for a, b in itertools.pairwise(cuts)]
        assert whole == [pieces[i, n] for n in range(len(whole))] and (i, len(whole)) not in pieces
    places = {}
    for r in packed:
        places.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for own in places.values():
        own.sort()
        assert [o for o, _ in own] == [sum(n for _, n in own[:k]) for k in range(len(own))] and sum(n for _, n in own) <= 2048
