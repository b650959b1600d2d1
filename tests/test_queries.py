"""Every named query against its SQL equivalent on the same tables."""

import collections
import os

import duckdb
import pytest
from pyspark.sql import Row

from quarrylight.plans import catalog

SF_DIR = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def con():
    connection = duckdb.connect()
    for t in TABLES:
        connection.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF_DIR}/{t}.parquet')")
    return connection


def plain(value):
    if isinstance(value, float):
        return repr(round(value, 9) + 0.0)
    if isinstance(value, dict):
        return tuple(plain(v) for v in value.values())
    if isinstance(value, (Row, list, tuple)):
        return tuple(plain(v) for v in value)
    return str(value)


@pytest.mark.parametrize("name", sorted(catalog.QUERIES))
def test_query(spark, con, name):
    frame = catalog.QUERIES[name](spark, SF_DIR)
    columns = sorted(frame.columns)
    got = collections.Counter(plain([r[c] for c in columns]) for r in frame.collect())
    if name not in catalog.ORACLES:
        assert got
        return
    answer = con.sql(catalog.ORACLES[name])
    assert sorted(answer.columns) == columns
    want = collections.Counter(plain([r[answer.columns.index(c)] for c in columns]) for r in answer.fetchall())
    assert got == want


def test_contract():
    import __spark_entry__ as entry

    assert set(catalog.QUERIES) <= set(entry.queries())
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_entry_without_the_training_data_folder():
    """The library and the entry point work where the subpackage is missing."""
    import subprocess
    import sys

    code = "import sys; sys.modules['corpus_pipeline'] = None; import __spark_entry__ as e; assert 'note_search' in e.queries() and not any(q.startswith('op1_') for q in e.queries()); e.oracle_sql()"
    subprocess.run([sys.executable, "-c", code], check=True, cwd=os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
