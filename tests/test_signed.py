import random

from tidelog.operators import signed

SCHEMA = "node_id string, seq_no long, op tinyint, key binary, value binary, put long, chunk string"


def log(spark, data):
    return spark.createDataFrame([(*r, 5, "x") for r in data], SCHEMA)


def fold(data, base=()):
    state = {(n, k): (s, 1, v) for n, k, s, v in base}
    for n, s, op, k, v in data:
        ok = s is not None and op in (1, 2) and k and (op == 1 or not v)
        if ok and state.get((n, k), (-1,))[0] < s:
            state[n, k] = (s, op, v)
    return {(n, k, s, v) for (n, k), (s, op, v) in state.items() if op == 1}


def got(df):
    return {(r.node_id, bytes(r.key), r.seq_no, bytes(r.value)) for r in df.collect()}


def test_any_order_and_any_number_of_deliveries(spark):
    rnd = random.Random(3)
    data = []
    for s in range(400):
        op = rnd.choice([1, 1, 2])
        data.append((rnd.choice(["a", "b", None]), s, op, b"hot" if s % 3 == 0 else b"k%d" % rnd.randrange(9), b"v%d" % s if op == 1 else rnd.choice([None, b""])))
    dirty = [("a", None, 1, b"k", b"x"), ("a", 900, 7, b"k", b"x"), ("a", 901, 2, b"k1", b"x"), ("a", 902, 1, b"", b"x"), ("a", 903, 1, None, b"x"), ("a", 904, None, b"k", b"x")]
    sent = data + rnd.choices(data, k=300) + dirty
    rnd.shuffle(sent)
    for chunk, span in ((2, 5), (1, 2), (10, 30)):
        assert got(signed.live_rows(log(spark, sent), chunk_bits=chunk, span_bits=span)) == fold(data)


def test_every_superseded_change_has_a_minus_one_image(spark, sf):
    rows = spark.read.parquet(f"{sf}/wal_record.parquet")
    seqs, minus = {}, 0
    for r in rows.where(signed.is_valid()).collect():
        seqs.setdefault((r.node_id, bytes(r.key)), {})[r.seq_no] = r.op
    puts = sum(op == 1 for held in seqs.values() for s, op in held.items() if s < max(held))
    every = sum(len(held) - 1 for held in seqs.values())
    got_puts = got_all = 0
    for steps, group in signed.levels(rows):
        minus = signed.images(steps, *group).where("sign = -1")
        got_all += minus.count()
        got_puts += minus.where("op = 1").count()
    assert every > 0 and (got_all, got_puts) == (every, puts)


BASE = "node_id string, key binary, seq_no long, op tinyint, value binary"


def test_base_and_late_repeats(spark):
    base = [("a", b"x", 10, 1, b"old"), ("a", b"y", 11, 1, b"keep"), ("a", b"z", 12, 1, b"gone"), ("a", b"dead", 30, 2, None)]
    changes = [("a", 9, 1, b"x", b"late"), ("a", 10, 1, b"x", b"old"), ("a", 20, 1, b"x", b"new"), ("a", 21, 2, b"z", None), ("a", 3, 2, b"y", None), ("a", 29, 1, b"dead", b"late")]
    b = spark.createDataFrame(base, BASE)
    assert got(signed.live_rows(log(spark, changes), b)) == {("a", b"x", 20, b"new"), ("a", b"y", 11, b"keep")}
    assert got(signed.live_rows(log(spark, []), b)) == {(n, k, s, v) for n, k, s, op, v in base if op == 1}


def test_batches_of_late_changes_equal_one_fold(spark):
    rnd = random.Random(8)
    data = [("a", s, op := rnd.choice([1, 2]), b"k%d" % rnd.randrange(15), b"v%d" % s if op == 1 else None) for s in range(200)]
    sent = data + data[:40]
    rnd.shuffle(sent)
    base = None
    for i in range(0, 240, 80):
        base = spark.createDataFrame(signed.state(log(spark, sent[i : i + 80]), base, chunk_bits=3, span_bits=5).collect(), BASE)
    assert got(base.where("op = 1")) == fold(data)


def test_empty_value_is_live(spark):
    assert got(signed.live_rows(log(spark, [("a", 1, 1, b"k", b"")]))) == {("a", b"k", 1, b"")}
