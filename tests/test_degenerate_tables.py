"""The problem queries over tables without rows and over rows of nulls."""

import pytest

from tidelog.plans import problem_queries as q

TABLES = ("wal_record", "sst_entry", "sst_backup", "manifest_table", "flush_run")


@pytest.fixture(scope="module", params=["no rows", "null rows"])
def tables(request, spark, tmp_path_factory):
    d = tmp_path_factory.mktemp("tables")
    for t in TABLES:
        schema = spark.read.parquet(f"/root/testdata/sf0.001/{t}.parquet").schema
        rows = [] if request.param == "no rows" else [[None] * len(schema)] * 3
        for f in schema:
            f.nullable = True
        spark.createDataFrame(rows, schema).write.parquet(f"{d}/{t}.parquet")
    return request.param, str(d)


@pytest.mark.parametrize("name", sorted(q.QUERIES))
def test_degenerate(spark, tables, name):
    kind, d = tables
    want = {"p6_rounds": 1, "p1_keys": 1 if kind == "null rows" else 0}.get(name, 0)
    assert q.QUERIES[name](spark, d).count() == want
