import random

import pytest

from tidelog.operators import snapshot
from tidelog.schema import MUTATION


def log(spark, rows):
    return spark.createDataFrame(rows, MUTATION)


def model(rows):
    state = {}
    for s, op, k, v in sorted(rows):
        state[k] = (s, op, v)
    return state


@pytest.mark.parametrize("seed", range(3))
def test_fold_against_a_dictionary(spark, seed):
    rnd = random.Random(seed)
    rows = [(i, op := rnd.choice([1, 1, 2]), rnd.choice([b"hot", b"\x80", b"\x7f", "é".encode(), b"k%d" % rnd.randrange(20)]), None if op == 2 else rnd.randbytes(3)) for i in range(300)]
    want = model(rows)
    rnd.shuffle(rows)
    df = log(spark, rows)
    assert {bytes(r.key): (r.seq_no, r.op, r.value and bytes(r.value)) for r in snapshot.latest(df).collect()} == want
    assert {bytes(r.key) for r in snapshot.live(df).collect()} == {k for k, v in want.items() if v[1] == 1}
    assert {bytes(r.key) for r in snapshot.deleted(df).collect()} == {k for k, v in want.items() if v[1] == 2}
    at = 120
    early = model([r for r in rows if r[0] <= at])
    assert {bytes(r.key) for r in snapshot.as_of(df, at).collect()} == {k for k, v in early.items() if v[1] == 1}
    size = sum(len(k) + len(v[2] or b"") for k, v in want.items())
    assert tuple(snapshot.memory_size(df).first()) == (len(want), size)


def test_gets(spark):
    df = log(spark, [(1, 1, b"a", b"x"), (2, 1, b"b", b""), (3, 2, b"a", None), (4, 2, b"never", None)])
    assert [bytes(r.value) for r in snapshot.get(df, b"b").collect()] == [b""]
    assert snapshot.get(df, b"a").count() == snapshot.get(df, b"none").count() == 0
    asked = spark.createDataFrame([(k,) for k in (b"a", b"b", b"b", b"none")], "key binary")
    assert {bytes(r.key): r.found for r in snapshot.multi_get(asked, df).collect()} == {b"a": False, b"b": True, b"none": False}


def test_equality_reaches_the_scan(spark, tmp_path):
    log(spark, [(1, 1, b"a", b"x")]).write.parquet(str(tmp_path / "t"))
    plan = snapshot.get(spark.read.parquet(str(tmp_path / "t")), b"a")._jdf.queryExecution().executedPlan().toString()
    assert "EqualTo(key" in plan


def test_invalid_rows(spark):
    rows = [(1, 1, b"a", b"x"), (2, 2, b"a", b"x"), (3, 1, b"", b"x"), (4, 1, None, b"x"), (None, 1, b"a", b"x"), (6, 9, b"a", b"x"), (7, None, b"a", None), (8, 2, b"a", b""), (9, 1, b"a", b"")]
    good, bad = snapshot.split_invalid(spark.createDataFrame(rows, MUTATION))
    assert sorted(r.seq_no for r in good.collect()) == [1, 8, 9]
    assert sorted((str(r.seq_no), r.reason) for r in bad.collect()) == [("2", "value"), ("3", "key"), ("4", "key"), ("6", "op"), ("7", "op"), ("None", "seq_no")]


def test_numbering_and_recovery(spark):
    rows = spark.createDataFrame([(2, b"b", b"2"), (1, b"a", b"1")], "ord long, key binary, value binary")
    assert [(r.seq_no, bytes(r.key)) for r in snapshot.put(rows, 10).orderBy("seq_no").collect()] == [(11, b"a"), (12, b"b")]
    assert [r.op for r in snapshot.delete(rows.drop("value"), 0).collect()] == [2, 2]
    layers = spark.createDataFrame([(1, b"a", b"old", 1, False), (1, b"b", None, 2, True)], "layer_id long, key binary, value binary, seq_no long, tombstone boolean")
    after = snapshot.recover(layers, log(spark, [(1, 1, b"a", b"old"), (3, 1, b"b", b"back")]))
    assert {bytes(r.key): r.op for r in after.collect()} == {b"a": 1, b"b": 1}


def test_empty_log(spark):
    e = log(spark, [])
    assert snapshot.live(e).count() == 0 and tuple(snapshot.memory_size(e).first()) == (0, 0)
