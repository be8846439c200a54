import random

import numpy as np
import pytest

from tidelog.functions import modular as gf
from tidelog.operators import reconcile

SCHEMA = "layer_id long, key binary, value binary, seq_no long, tombstone boolean, bucket long, h long, diff string"


def copy(spark, rows):
    return spark.createDataFrame([(*r, 1, 2, "x") for r in rows], SCHEMA)


def brute(a, b):
    x, y = {r[:2]: r for r in a}, {r[:2]: r for r in b}
    out = [(*k, "only_a") for k in x.keys() - y.keys()] + [(*k, "only_b") for k in y.keys() - x.keys()]
    for k in x.keys() & y.keys():
        out += [(*k, f) for i, f in ((2, "value"), (3, "seq_no"), (4, "tombstone")) if x[k][i] != y[k][i]]
    return sorted(out, key=str)


def run(spark, a, b, **k):
    return sorted(((r.layer_id, None if r.key is None else bytes(r.key), r["diff"]) for r in reconcile.differences(copy(spark, a), copy(spark, b), reconcile.STORE).collect()), key=str)


def rows(n, seed=0):
    rnd = random.Random(seed)
    return [(rnd.choice([1, 1, 2, None]), b"k%d" % i, rnd.randbytes(4), i, False) for i in range(n)]


def test_a_few_differences(spark):
    a = rows(1500)
    b = [r for i, r in enumerate(a) if i % 97]
    b = [(r[0], r[1], None, r[3], r[4]) if i % 101 == 0 else (r[0], r[1], r[2], None, True) if i % 103 == 0 else r for i, r in enumerate(b)]
    b += [(5, b"new%d" % i, b"", i, False) for i in range(20)] + b[:30]
    random.Random(1).shuffle(b)
    assert run(spark, a, b) == brute(a, b)


@pytest.mark.parametrize("a, b", [(rows(300), []), ([], rows(300)), ([], []), (rows(200), rows(200)), (rows(260), rows(260, seed=9))])
def test_all_or_nothing_differs(spark, a, b):
    assert run(spark, a, b) == brute(a, b)


def test_null_differs_from_empty(spark):
    a = [(1, b"a", None, 1, True), (1, b"b", b"", None, None), (None, None, b"x", 1, False)]
    b = [(1, b"a", b"", 1, True), (1, b"b", b"", None, None), (None, None, b"y", 1, False)]
    assert run(spark, a, b) == brute(a, b)


def test_interpolation_finds_the_roots():
    rnd = np.random.default_rng(0)
    for only_a, only_b, m in ((3, 2, 8), (0, 5, 8), (4, 4, 8), (6, 1, 8), (0, 0, 8)):
        x = rnd.integers(0, gf.P - gf.SAMPLES, 40 + only_a + only_b)
        common, a, b = x[:40], x[40 : 40 + only_a], x[40 + only_a :]
        z = gf.points(m)
        value = lambda s: gf.segment_products((z[None, :] - s[:, None]) % gf.P, np.zeros(1, np.int64))[0]
        ratio = value(np.concatenate((common, a))) * gf.inverse(value(np.concatenate((common, b)))) % gf.P
        num, den, ok = gf.interpolate(ratio[None, :], np.array([only_a - only_b]))
        assert ok[0]
        at = lambda p, s: gf.evaluate(np.repeat(p, len(s), axis=0), s)
        assert (at(num, a) == 0).all() and (at(den, b) == 0).all()
        is_root = (at(num, common) == 0) & (at(den, common) != 0)
        assert not is_root.any()


def test_segment_products():
    f = np.array([[2], [3], [5], [7], [11]], np.int64)
    assert gf.segment_products(f, np.array([0, 3, 4])).tolist() == [[30], [7], [11]]
    assert (gf.inverse(np.array([2, 12345])) * np.array([2, 12345]) % gf.P).tolist() == [1, 1]
