"""Corpus queries against their SQL on the smallest tables, by DuckDB."""

import glob
import os

import duckdb
import pytest

from millrace.llm.queries import QUERIES, SQL

DIR = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_equals_its_sql(spark, name):
    duck = duckdb.connect()
    for path in glob.glob(f"{DIR}/*.parquet"):
        duck.execute(f"create view {os.path.basename(path).split('.')[0]} as select * from '{path}'")
    df = QUERIES[name](spark, DIR)
    answer = duck.execute(SQL[name])
    names = [d[0] for d in answer.description]
    assert sorted(names) == sorted(df.columns)
    want = sorted(tuple(r) for r in answer.fetchall())
    assert sorted(tuple(r[c] for c in names) for r in df.collect()) == want and want
