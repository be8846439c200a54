from collections import Counter
from decimal import Decimal

from pyspark.sql import functions as F

from tidelog.operators import keyload

SCHEMA = "key binary, value binary, seq_no long, extra string, n long"


def rows(spark, data):
    return spark.createDataFrame([(k, v, s, "x", 9) for k, v, s in data], SCHEMA)


def test_join_of_states_equals_the_join_of_rows(spark):
    a = [(b"hot", b"12", i) for i in range(300)] + [(b"", b"1", 1), (None, b"1", 2), (b"k", None, 3)]
    b = [(b"hot", b"3", i) for i in range(50)] + [(b"", b"", 1), (None, b"1", 2), (b"z", b"1", 3)]
    size = F.coalesce(F.length("value"), F.lit(0))
    got = {bytes(r.key): (int(r.pairs), int(r.a), int(r.b)) for r in keyload.eager_join_aggregate(rows(spark, a), rows(spark, b), "key", {"a": size}, {"b": size}).collect()}
    want: dict = {}
    for k, v, _ in a:
        for k2, v2, _ in b:
            if k is not None and k == k2:
                p, x, y = want.get(k, (0, 0, 0))
                want[k] = (p + 1, x + len(v or b""), y + len(v2 or b""))
    assert got == want


def test_rollup_sums_the_keys(spark):
    a, b = rows(spark, [(b"a", None, 1), (b"b", None, 1)] * 2), rows(spark, [(b"a", None, 1), (b"b", None, 1), (b"b", None, 1)])
    got = keyload.eager_join_aggregate(a, b, "key", rollup=F.length("key")).collect()
    assert [(r.grp, r.pairs) for r in got] == [(1, Decimal(6))]


def test_states_tell_null_from_empty(spark):
    s = keyload.store_key_states(rows(spark, [(None, b"v", None), (b"", b"v", 4), (None, None, None)]), rows(spark, [(b"", None, 1)]))
    got = {(bytes(r["_key"]), r["_none"]): (r.wal_n, r.wal_latest, r.sst_n) for r in s.collect()}
    assert got == {(b"", True): (2, None, 0), (b"", False): (1, 4, 1)}


def test_heavy_keys_against_counting(spark):
    data = [(b"h%d" % (i % 7), b"", i) for i in range(70)] + [(b"r%d" % i, b"", i) for i in range(1, 931)]
    got = {(r.tab, r.key_hex) for r in keyload.heavy_keys(rows(spark, data), rows(spark, data[:5])).collect()}
    n = Counter(k for k, _, _ in data)
    want = {("wal_record", k.hex()) for k, c in n.items() if c * 100 >= len(data)} | {("sst_entry", k.hex()) for k, _, _ in data[:5]}
    assert got == want


def test_empty_tables(spark):
    e = rows(spark, [])
    assert keyload.heavy_keys(e, e).count() == 0
    assert keyload.store_key_states(e, e).count() == 0
    assert keyload.eager_join_aggregate(e, e, "key").count() == 0
