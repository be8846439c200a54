"""The text queries over tables without rows and over rows of nulls."""

import pytest

from tidelog.llm import queries as q


@pytest.mark.parametrize("rows", [0, 3])
@pytest.mark.parametrize("name", sorted(q.QUERIES))
def test_degenerate(spark, tmp_path, name, rows):
    for t in ("documents", "mix_target", "sst_entry", "wal_incoming"):
        schema = spark.read.parquet(f"/root/testdata/sf0.001/{t}.parquet").schema
        for f in schema:
            f.nullable = True
        spark.createDataFrame([[None] * len(schema)] * rows, schema).write.parquet(f"{tmp_path}/{t}.parquet")
    got = q.QUERIES[name](spark, str(tmp_path)).collect()
    assert len(got) == {"p7_ids": rows, "p7_reuse": 1, "p2_rate": 1, "p2_rate_short": 1}.get(name, 0)
    if name == "p7_ids":
        assert all(r.ids == [] for r in got)


def test_bytes_that_are_no_text(spark):
    from pyspark.sql import functions as F

    from tidelog.llm import mojibake, tokenize

    rows = spark.createDataFrame([(1, b"plain \xff\xfe end"), (2, "fine é\n".encode()), (3, None)], "doc_id long, b binary")
    docs = rows.select("doc_id", F.col("b").cast("string").alias("text"))
    plain = tokenize.Encoder(tokenize.rank_file()).bpe
    got = {r.doc_id: r.ids for r in tokenize.token_ids(docs).collect()}
    assert got == {1: plain.encode_ordinary("plain \ufffd\ufffd end"), 2: plain.encode_ordinary("fine é\n"), 3: []}
    assert [r.doc_id for r in mojibake.find(docs).documents.collect()] == [1]
