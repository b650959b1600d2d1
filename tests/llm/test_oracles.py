"""Queries of the subpackage against their SQL equivalents."""

import collections
import os

import duckdb
import pytest

from quarrylight.llm import queries

SF_DIR = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_query(spark, name):
    con = duckdb.connect()
    for t in ("documents", "embeddings", "conversations", "benchmark"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF_DIR}/{t}.parquet')")
    frame = queries.QUERIES[name](spark, SF_DIR)
    columns = sorted(frame.columns)
    answer = con.sql(queries.ORACLES[name])
    assert sorted(answer.columns) == columns
    want = collections.Counter(tuple(str(r[answer.columns.index(c)]) for c in columns) for r in answer.fetchall())
    assert collections.Counter(tuple(str(r[c]) for c in columns) for r in frame.collect()) == want


def test_every_operator_has_a_query():
    assert {q.split("_")[0] for q in queries.QUERIES} == {f"op{n}" for n in range(1, 14)}
