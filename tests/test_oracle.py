"""Every query with SQL against DuckDB, on the smallest tables."""

import oracle
import pytest

import __spark_entry__ as entry

SQL = entry.oracle_sql()


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_equals_sql(spark, sf, name):
    assert oracle.compare(entry.queries()[name](spark, sf), SQL[name], sf) == ""


def test_every_sql_has_a_query():
    assert SQL.keys() <= entry.queries().keys()


def test_entry(spark, sf):
    assert entry.entry(spark).columns == ["node_id", "key_hex", "seq_no"]
