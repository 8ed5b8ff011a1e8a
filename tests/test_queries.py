"""Every query with SQL gives the SQL's rows at the smallest scale."""

import os

import duckdb
import pytest

from heddle import catalogue

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
SQL = catalogue.oracle_sql()


@pytest.fixture(scope="module")
def duck():
    if not os.path.isdir(SF):
        pytest.skip("no driver tables")
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_equals_its_sql(spark, duck, name):
    got = catalogue.queries()[name](spark, SF).toPandas()
    want = duck.sql(SQL[name]).df()
    columns = sorted(got.columns)
    assert columns == sorted(want.columns)
    order = lambda df: df[columns].astype(str).sort_values(columns).reset_index(drop=True)
    a, b = order(got), order(want)
    assert a.equals(b), a.merge(b, how="outer", indicator=True).query("_merge != 'both'").head(10)


@pytest.mark.parametrize("name", sorted(set(catalogue.queries()) - set(SQL) - {"q_pagerank_settled"}))
def test_query_without_sql_runs(spark, duck, name):
    assert catalogue.queries()[name](spark, SF).count() > 0
