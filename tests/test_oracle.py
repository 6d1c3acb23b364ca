"""Every registered query against the SQL that states its result."""

import duckdb
import pytest

import __spark_entry__ as entry_point
from siltstream import catalog, oracle

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages"
    " benchmark labels conversations"
).split()


@pytest.fixture(scope="module")
def engine():
    connection = duckdb.connect()
    for name in TABLES:
        path = f"/root/testdata/sf0.001/{name}.parquet"
        connection.execute(f"CREATE VIEW {name} AS SELECT * FROM '{path}'")
    return connection


def test_every_query_has_its_sql():
    assert catalog.QUERIES.keys() == oracle.ORACLE_SQL.keys()
    assert catalog.QUERIES.keys() <= entry_point.queries().keys()
    assert oracle.ORACLE_SQL.keys() <= entry_point.oracle_sql().keys()


@pytest.mark.parametrize("name", catalog.QUERIES)
def test_query_equals_its_sql(spark, sf_dir, engine, name):
    frame = entry_point.queries()[name](spark, sf_dir)
    columns = sorted(frame.columns)
    cursor = engine.execute(entry_point.oracle_sql()[name])
    names = [d[0] for d in cursor.description]
    assert sorted(names) == columns
    at = [names.index(c) for c in columns]
    expected = sorted(repr(tuple(row[i] for i in at)) for row in cursor.fetchall())
    actual = sorted(repr(tuple(row[c] for c in columns)) for row in frame.collect())
    assert actual == expected and len(actual) > 0


def test_entry(spark, sf_dir):
    rows = {r.topic: r.records for r in entry_point.entry(spark).collect()}
    assert rows == {
        "dwd_dirty_log": 22, "dwd_start_log": 193, "dwd_page_log": 785, "dwd_display_log": 1165,
    }
