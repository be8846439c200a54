import random

import pytest
from pyspark.sql import functions as F

from tidelog.llm import seen
from tidelog.schema import InvalidArgument
from tidelog.session import new_path, table

SCHEMA = "record_id long, key binary, extra string, h long, n long, zone int"


def batch(spark, data):
    return spark.createDataFrame([(i, k, "x", 1, 2, 3) for i, k in data], SCHEMA)


def ids(d):
    return sorted(r.record_id for r in d.found.collect())


def test_batches_against_a_set(spark):
    rnd = random.Random(1)
    index, known, at = seen.SeenKeys(spark, new_path(spark, "t"), fanout=2, keys_per_file=4, max_buckets=2), set(), 0
    for _ in range(4):
        data = [(at + i, rnd.choice([None, b"", b"hot", b"hot", b"k%d" % rnd.randrange(40)])) for i in range(60)]
        at += 60
        rnd.shuffle(data)
        want = []
        for i, k in sorted(data, key=lambda x: x[0]):
            if k:
                if k in known:
                    want.append(i)
                known.add(k)
        assert ids(index.process(batch(spark, data))) == sorted(want)
    levels = [r["level"] for r in index.runs]
    assert max(levels) >= 1 and all(levels.count(x) < 2 for x in levels)  # full levels were merged
    assert max(r["zones"] for r in index.runs) > 1 and sum(r["keys"] for r in index.runs) == len(known)
    for r in index.runs:  # another session does not know the tables
        spark.sql(f"DROP TABLE {r['table']}")
    again = seen.SeenKeys(spark, index.path, fanout=2)
    assert ids(again.process(batch(spark, [(10**6, b"hot"), (10**6 + 1, b"new")]))) == [10**6]


def test_a_batch_given_again_gets_the_same_answers(spark):
    path = new_path(spark, "t")
    index = seen.SeenKeys(spark, path)
    index.add(spark.createDataFrame([(b"a",)], "key binary"))
    data = batch(spark, [(1, b"a"), (2, b"b"), (3, b"b"), (4, b"c")])

    def die():
        raise InterruptedError

    with pytest.raises(InterruptedError):
        index.process(data, batch="first", before_publish=die)
    for _ in range(3):  # after a failure before publishing, and after one that came later
        index = seen.SeenKeys(spark, path)
        assert ids(index.process(data, batch="first")) == [1, 3]
    assert ids(index.process(data, batch="second")) == [1, 2, 3, 4]
    index.forget("first")
    assert list(index.batches) == ["second"] and list(seen.SeenKeys(spark, path).batches) == ["second"]


def test_layout_grows_with_the_run(spark):
    index = seen.SeenKeys(spark, new_path(spark, "t"))
    assert index.layout(1) == (1, 1) and index.layout(seen.KEYS_PER_FILE) == (1, 1)
    assert index.layout(10 * seen.KEYS_PER_FILE) == (16, 1)
    assert index.layout(10**12) == (seen.MAX_BUCKETS, seen.MAX_ZONES)


def test_a_small_batch_reads_a_part_of_a_large_run(spark):
    index = seen.SeenKeys(spark, new_path(spark, "t"), keys_per_file=64, max_buckets=4)
    index.add(spark.range(20000).select(F.col("id").cast("string").cast("binary").alias("key")), level=1)
    (run,) = index.runs
    assert (run["buckets"], run["zones"]) == (4, 128)
    probes = index.first_per_key(batch(spark, [(1, b"17"), (2, b"absent"), (3, b"4711"), (4, b"4711")]), "key", "record_id")
    zones = index.zones_met(probes, run)
    assert 2 <= len(zones) <= 3
    held = index._read(run).where(F.col("zone").isin(zones))
    plan = held._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(zone" in plan or "PartitionFilters: [zone" in plan
    assert held.count() < 20000 * 4 / 128 and len(held.inputFiles()) < len(index._read(run).inputFiles())
    assert ids(index.process(batch(spark, [(1, b"17"), (2, b"absent"), (3, b"4711"), (4, b"4711")]))) == [1, 3, 4]


def test_the_index_side_of_a_probe_is_not_shuffled(spark, sf):
    index = seen.SeenKeys(spark, new_path(spark, "t"), keys_per_file=256)
    index.add(table(spark, sf, "sst_entry"), level=1)
    probed = index._probe(index.first_per_key(table(spark, sf, "wal_incoming"), "key", "record_id"))
    text = probed._jdf.queryExecution().executedPlan().toString()
    side = text[text.index("SortMergeJoin") :]
    assert "Bucketed: true" in side
    run = side[side.rindex("Sort [run_h") :]
    assert "Exchange" not in run


def test_short_hashes_are_verified(spark):
    old = spark.createDataFrame([(b"k%d" % i,) for i in range(3000)], "key binary")
    d = seen.seen_before(spark, old, batch(spark, [(i, b"k%d" % (i * 2)) for i in range(3000)] + [(9000, b"k0"), (9001, b"k9998")]), hash_bits=16)
    assert ids(d) == [*range(1500), 9000]
    r = seen.wrong_rate(d, old).first()
    assert (r.records, r.seen, r.wrong) == (3002, 1501, 0) and r.wrong_by_hash > 0


def test_invalid_options(spark):
    for options in ({"hash_bits": 12}, {"hash_bits": 65}, {"fanout": 1}, {"keys_per_file": 0}, {"max_buckets": 0}):
        with pytest.raises(InvalidArgument):
            seen.SeenKeys(spark, new_path(spark, "t"), **options)


def test_empty(spark):
    d = seen.seen_before(spark, spark.createDataFrame([], "key binary"), batch(spark, []))
    assert ids(d) == []
    assert seen.wrong_rate(d, spark.createDataFrame([], "key binary")).first().wrong_rate == 0.0
