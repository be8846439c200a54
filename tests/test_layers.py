import random

from tidelog.functions import hashing
from tidelog.operators import bloom, layers, snapshot
from tidelog.sources import codec

FLUSHED = "layer_id long, key binary, seq_no long, op int, value binary"


def flushed(spark, rows):
    return spark.createDataFrame(rows, FLUSHED)


def rows(seed=0, n=400):
    rnd = random.Random(seed)
    return [(i % 3, b"key%05d" % i, i, 2 if i % 7 == 0 else 1, None if i % 7 == 0 else rnd.randbytes(rnd.randrange(80))) for i in range(n)]


def test_merge_vectors(spark):
    older = [(1, b"alpha", 1, 1, b"old-alpha"), (1, b"bravo", 2, 1, b"only-in-older"), (1, b"charlie", 3, 1, b"old-charlie")]
    newer = [(2, b"alpha", 4, 1, b"new-alpha"), (2, b"charlie", 5, 2, None), (2, b"delta", 6, 1, b"only-in-newer")]
    got = layers.merge(flushed(spark, older + newer)).orderBy("key").collect()
    assert [(bytes(r.key), r.seq_no, r.op) for r in got] == [(b"alpha", 4, 1), (b"bravo", 2, 1), (b"charlie", 5, 2), (b"delta", 6, 1)]
    tie = layers.merge(flushed(spark, [(2, b"k", 7, 1, b"second"), (1, b"k", 7, 1, b"first")])).first()
    assert bytes(tie.value) == b"first"


def test_read_rules_differ_after_a_merge_out_of_order(spark):
    held = flushed(spark, [(3, b"k", 100, 1, b"new"), (4, b"k", 1, 1, b"old")])
    assert bytes(layers.layer_rule(held).first().value) == b"old"
    assert bytes(snapshot.latest(held).first().value) == b"new"


def test_blocks_and_sizes_equal_the_file(spark, tmp_path):
    data = rows()
    blocks = layers.blocks(flushed(spark, data), 1000).collect()
    sizes = {r.layer_id: r.file_size for r in layers.file_sizes(flushed(spark, data), 1000).collect()}
    for layer in range(3):
        path = tmp_path / f"{layer}.sst"
        size = codec.write_table(path, [(k, v, s, op == 2) for l, k, s, op, v in data if l == layer], 1000)
        _, index, _ = codec.read_table(path)
        assert size == path.stat().st_size == sizes[layer]
        assert [(bytes(b.first_key), b.offset) for b in sorted(blocks, key=lambda b: b.block) if b.layer_id == layer] == index


def test_locate_against_search(spark):
    data = rows()
    index = layers.blocks(flushed(spark, data), 700)
    asks = [(i % 3, b"key%05d" % i) for i in range(0, 500, 3)] + [(0, b"a"), (1, b"zzz"), (9, b"k")]
    per = {}
    for b in index.collect():
        per.setdefault(b.layer_id, []).append((bytes(b.first_key), b.block))
    want = {(l, k): max((b for f, b in per.get(l, []) if f <= k), default=None) for l, k in asks}
    got = layers.locate(spark.createDataFrame(asks, "layer_id long, key binary"), index).collect()
    assert {(r.layer_id, bytes(r.key)): r.block for r in got} == want


def test_rotation_counts_overwrites_once(spark):
    log = spark.createDataFrame([(n, i, b"same", b"x" * 10) for i in range(20) for n in "ab"] + [(n, 20 + i, b"k%d" % i, b"x" * 10) for i in range(6) for n in "ab"], "node string, seq_no long, key binary, value binary")
    got = layers.assign_rotations(log, 40, ["node"]).where("node = 'b'").orderBy("seq_no").collect()
    assert [r.layer_no for r in got] == [0] * 23 + [1] * 3


def test_rotation_against_a_plain_fold(spark):
    rnd = random.Random(11)
    data = [(i // 200, i, b"k%d" % rnd.randrange(30), None if rnd.random() < 0.2 else rnd.randbytes(rnd.randrange(40))) for i in range(600)]
    want, at, no, held = {}, None, 0, {}
    for s, i, k, v in data:
        if s != at:
            at, no, held = s, 0, {}
        want[i] = no
        held[k] = len(k) + len(v or b"")
        if sum(held.values()) >= 300:
            no, held = no + 1, {}
    got = layers.assign_rotations(spark.createDataFrame(data, "shard long, seq_no long, key binary, value binary"), 300, ["shard"])
    assert {r.seq_no: r.layer_no for r in got.collect()} == want and max(want.values()) > 1


def test_bloom_is_exact_and_never_misses(spark):
    data = rows()
    params = {r.layer_id: (r.m, r.k) for r in bloom.parameters(flushed(spark, data)).collect()}
    built = bloom.build(flushed(spark, data)).collect()
    for layer, (m, k) in params.items():
        keys = sorted(key for l, key, *_ in data if l == layer)
        own = bloom.marshal(m, k, {b.block: bytes(b.bits) for b in built if b.layer_id == layer})
        assert own == codec.bloom_bytes(keys, 0.01)
        assert bloom.unmarshal(own)[:2] == (m, k)
    asked = flushed(spark, data).select("layer_id", "key").union(spark.createDataFrame([(0, b"zzz_not_in_file%d" % i) for i in range(200)], "layer_id long, key binary"))
    said = {(r.layer_id, bytes(r.key)): r.maybe for r in bloom.probe(asked, bloom.build(flushed(spark, data)), bloom.parameters(flushed(spark, data))).collect()}
    assert all(said[l, k] for l, k, *_ in data)
    assert sum(v for (_, k), v in said.items() if k.startswith(b"zzz")) < 20


def test_key_hashes_against_plain_integers():
    keys = [b"", b"a", b"\xff" * 9, "žluť".encode()]
    def plain(key, h, prime):
        for b in key:
            h = ((h ^ b) * prime) % (1 << 64)
        return h
    h1, h2 = hashing.bloom_hashes(keys)
    assert h1.tolist() == [plain(k, 14695981039346656037, 1099511628211) for k in keys]
    assert h2.tolist() == [plain(k, 1099511628211, 1000000007) for k in keys]


def test_write_layer_is_sorted_with_bloom(spark, tmp_path):
    layers.write_layer(flushed(spark, rows()), str(tmp_path / "l"), bloom_ndv=400)
    back = layers.read_layers(spark, [str(tmp_path / "l")])
    assert back.count() == 400
    import pyarrow.parquet as pq

    for f in (tmp_path / "l").glob("*.parquet"):
        keys = pq.read_table(f)["key"].to_pylist()
        assert keys == sorted(keys)


def test_live_and_orphan_layers(spark):
    t = spark.createDataFrame([(0,), (5,)], "id long")
    assert {r.layer_id for r in layers.live_layers(flushed(spark, rows()), t).collect()} == {0}
    assert sorted(r.layer_id for r in layers.orphans(flushed(spark, rows()), t).collect()) == [1, 2]


def test_invalid_filters():
    import struct

    import pytest

    from tidelog.schema import Corruption

    for m, k, n in ((0, 1, 0), (9, 1, 2), (64, 0, 8), (64, 1, 7)):
        with pytest.raises(Corruption):
            bloom.unmarshal(struct.pack("<QQ", m, k) + bytes(n))


def test_read_metrics_against_lookups(spark, tmp_path):
    from tidelog.operators import stats
    from tidelog.sources import datasource

    data = [(0, b"a", 1, 1, b"x"), (1, b"a", 2, 1, b"y"), (1, b"b", 3, 2, None), (2, b"c", 4, 1, b"z")]
    datasource.write_tables(layers.entries(flushed(spark, data)), str(tmp_path))
    asked = spark.createDataFrame([(k,) for k in (b"a", b"b", b"c", b"d", b"a")], "key binary")
    files = {l: codec.TableFile(datasource.table_path(str(tmp_path), l)) for l in range(3)}
    checks = skips = reads = 0
    for k in (b"a", b"b", b"c", b"d"):
        for l in (2, 1, 0):
            checks += 1
            skips += not files[l].maybe(k)
            reads += files[l].maybe(k)
            if (l, k) in {r[:2] for r in data}:
                break
    assert tuple(stats.read_metrics(asked, str(tmp_path)).first()) == (checks, skips, reads)


def test_read_metrics_are_shared_out_by_spans_of_tables(spark, tmp_path, monkeypatch):
    from tidelog.operators import stats
    from tidelog.sources import datasource

    data = [(l, b"k%d" % k, l * 100 + k, 2 if (l + k) % 5 == 0 else 1, b"v%d" % k) for l in range(13) for k in range(l % 4, 60, l + 1)]
    datasource.write_tables(layers.entries(flushed(spark, [(l, k, s, op, None if op == 2 else v) for l, k, s, op, v in data])), str(tmp_path), 64)
    keys = [b"k%d" % k for k in range(60)] + [b"absent%d" % k for k in range(400)] + [b"", b"k0\0"]
    files = [codec.TableFile(datasource.table_path(str(tmp_path), l)) for l in range(13)]
    for k in keys:
        next((l for l in range(12, -1, -1) if files[l].get(k)), None)
    asked = spark.createDataFrame([(k,) for k in keys], "key binary").coalesce(1)
    assert datasource.point_reads(asked, str(tmp_path)).rdd.getNumPartitions() > 1
    monkeypatch.setattr(datasource, "SPAN", 3)
    assert stats.read_metrics(asked, str(tmp_path)).first().asDict() == {c: sum(t.counters[c] for t in files) for c in files[0].counters}
