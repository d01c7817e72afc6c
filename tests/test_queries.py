"""Every registered query on the smallest tables, against its SQL where there is one."""

import os
from collections import Counter

import duckdb
import pytest

import __spark_entry__ as entry

DATA = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no tables")


def plain(value):
    if isinstance(value, float):
        return round(value, 6)
    return tuple(map(plain, value)) if isinstance(value, (list, tuple)) else value


@pytest.fixture(scope="module")
def sql():
    connection = duckdb.connect()
    for name in os.listdir(DATA):
        connection.sql(f"CREATE VIEW {name.split('.')[0]} AS SELECT * FROM '{DATA}/{name}'")
    return connection


@pytest.mark.parametrize("name", sorted(entry.queries()))
def test_query(spark, sql, name):
    df = entry.queries()[name](spark, DATA)
    columns = sorted(df.columns)
    found = Counter(plain(tuple(r[c] for c in columns)) for r in df.collect())
    if name in entry.oracle_sql():
        result = sql.sql(entry.oracle_sql()[name])
        assert sorted(result.columns) == columns
        places = [result.columns.index(c) for c in columns]
        assert found == Counter(plain(tuple(row[i] for i in places)) for row in result.fetchall())


def test_entry(spark):
    assert entry.entry(spark).columns == ["doc_id", "score", "first_term"]
    assert set(entry.oracle_sql()) <= set(entry.queries())
