import random

import pytest
from pyspark.sql import functions as F

from tidelog.operators import incremental
from tidelog.session import hadoop_path, new_path
from tidelog.sources import publish

SCHEMA = "node_id string, seq_no long, value string, lo long, block long"


def source(spark, data):
    return spark.createDataFrame([(n, s, v, 1, 2) for n, s, v in data], SCHEMA)


def ranges(spark, data):
    return spark.createDataFrame(data, "node_id string, lo long, hi long")


def test_not_covered_against_brute_force(spark):
    rnd = random.Random(5)
    spans = []
    for _ in range(120):
        lo = rnd.randrange(2000)
        spans.append((rnd.choice("ab"), lo, lo + rnd.choice([0, 1, 5, 40, 300])))
    spans += [("a", 1 << 40, 1 << 61), ("c", 5, 3)]
    data = [(rnd.choice(["a", "b", "c", None]), rnd.randrange(2600), "v") for _ in range(900)] + [("a", None, "v"), ("a", (1 << 50) + 3, "v"), ("a", (1 << 61) + 1, "v")]
    want = sorted((r for r in data if r[1] is None or not any(n == r[0] and lo <= r[1] <= hi for n, lo, hi in spans)), key=str)
    for bits in (3, 16):
        got = incremental.not_covered(source(spark, data), ranges(spark, spans), bits)
        assert sorted(((r.node_id, r.seq_no, r.value) for r in got.collect()), key=str) == want


def test_committed_ranges_drop_other_runs(spark):
    m = spark.createDataFrame([("a", 1, 5, 9), ("a", 2, 1, 3), ("a", 1, 5, 9), (None, 1, 1, 2), ("a", 1, None, 4)], "node_id string, run_id long, min_seq_no long, max_seq_no long")
    r = spark.createDataFrame([(1, "committed"), (2, "failed"), (3, None)], "run_id long, status string")
    assert [tuple(x) for x in incremental.committed_ranges(m, r).collect()] == [("a", 5, 9)]


def test_failures_neither_skip_nor_repeat(spark):
    t = incremental.IncrementalTarget(spark, new_path(spark, "t"), ["node_id", "seq_no"], ranges=ranges(spark, [("a", 0, 9)]))
    first = source(spark, [("a", i % 15, "v") for i in range(40)] + [(None, 1, "v")])

    def die():
        raise InterruptedError

    with pytest.raises(InterruptedError):
        t.run(first, before_publish=die)
    assert t.rows() is None
    assert t.vacuum() == 1
    assert t.run(first) == 1 and t.vacuum() == 0
    assert t.run(first) == 2
    more = source(spark, [("a", i, "w") for i in range(20)])
    t.run(more)
    got = sorted((r.seq_no, r.value, r.target_version) for r in t.rows().where("node_id = 'a'").collect())
    assert got == [(i, "v", 1) for i in range(10, 15)] + [(i, "w", 3) for i in range(15, 20)]
    assert t.rows().where("node_id is null").count() == 1


def test_changed_records_have_a_new_version(spark):
    t = incremental.IncrementalTarget(spark, new_path(spark, "t"), ["node_id"], ["seq_no"])
    t.run(source(spark, [("a", 1, "x"), ("b", 1, "y")]))
    t.run(source(spark, [("a", 2, "x2"), ("b", 1, "y")]), lambda df: df.withColumn("value", F.upper("value")))
    assert sorted((r.node_id, r.seq_no, r.value) for r in t.rows().collect()) == [("a", 1, "x"), ("a", 2, "X2"), ("b", 1, "y")]


def test_two_writers_cannot_publish_one_version(spark):
    folder = new_path(spark, "t")
    publish.publish(spark, folder, 1, {"a": 1})
    with pytest.raises(publish.PublishConflict):
        publish.publish(spark, folder, 1, {"a": 2})
    assert publish.load(spark, folder, 1) == {"a": 1} and publish.latest_version(spark, folder) == 1
    fs, target = hadoop_path(spark, f"{folder}/{publish._name(2)}")
    publish._create(spark, fs, target, bytearray(b'{"b": 1}'))
    with pytest.raises(publish.PublishConflict):
        publish._create(spark, fs, target, bytearray(b'{"b": 2}'))
    assert publish.load(spark, folder, 2) == {"b": 1}


def test_empty(spark):
    t = incremental.IncrementalTarget(spark, new_path(spark, "t"), ["node_id", "seq_no"], ranges=ranges(spark, []))
    t.run(source(spark, []))
    assert t.rows().count() == 0
