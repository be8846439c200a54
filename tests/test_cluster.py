import bisect
import hashlib

import pytest

from tidelog.operators import quorum, ring
from tidelog.schema import Corruption, InvalidArgument, NodeConfig, NotFound, Peer, StorageConfig, StoreClosed, WriteStall, status_of


def nodes(n):
    return tuple(Peer(f"node-{i}", f"127.0.0.1:{18080 + i}") for i in range(1, n + 1))


def plain(r, key, n):
    toks = sorted((int(hashlib.sha1(f"{p.node_id}#{v}".encode()).hexdigest()[:16], 16), p.node_id) for p in r.nodes for v in range(r.vnodes))
    at = bisect.bisect_left([t for t, _ in toks], int(hashlib.sha1(key).hexdigest()[:16], 16))
    return list(dict.fromkeys(toks[(at + i) % len(toks)][1] for i in range(len(toks))))[:n]


@pytest.mark.parametrize("count, vnodes, n", [(3, 32, 3), (5, 16, 3), (1, 8, 3), (40, 32, 2), (3, 1, 10)])
def test_placement_against_search(spark, count, vnodes, n):
    r = ring.Ring(nodes(count), vnodes)
    keys = [f"key-{i}".encode() for i in range(400)] + [b"", b"\x80\xff"]
    got = r.place(spark.createDataFrame([(k,) for k in keys], "key binary"), n)
    assert {bytes(x.key): list(x.prefs) for x in got.collect()} == {k: plain(r, k, n) for k in keys}
    assert all(x.coordinator == x.prefs[0] for x in got.collect())


def test_invalid_rings():
    for bad in ((), nodes(1) + nodes(1), (Peer("", "a"),)):
        with pytest.raises(InvalidArgument):
            ring.Ring(bad)
    with pytest.raises(InvalidArgument):
        ring.Ring(nodes(3), 0)


def test_routes(spark):
    from pyspark.sql import functions as F

    placed = ring.Ring(nodes(3)).place(spark.createDataFrame([(f"k{i}",) for i in range(30)], "key string"), 3)
    for r in ring.route(placed, F.lit("node-1")).collect():
        assert r.route == ("local" if r.coordinator == "node-1" else "forward") and len(r.targets) == 3
    for r in ring.route(placed, F.lit("node-1"), single_copy_forwarding=True).collect():
        assert list(r.targets) == (list(r.prefs) if r.route == "local" else [r.coordinator])


def spread(spark, log, r):
    return r.place(spark.createDataFrame(log, "key string, seq_no long, op int, value string"), 3)


def down(spark, rows):
    return spark.createDataFrame(rows, "node_id string, from_seq long, to_seq long")


@pytest.mark.parametrize("limit", [1024, 0])
def test_quorums_with_a_node_down(spark, limit):
    from pyspark.sql import functions as F

    r = ring.Ring(nodes(3), 16)
    log = [("alpha", 1, 1, "v1"), ("beta", 2, 1, "v2"), ("alpha", 3, 2, None), ("gamma", 4, 1, "")]
    m = spread(spark, log, r)
    out = {(x.key, x.seq_no): (x.acks, x.ok) for x in quorum.write_outcomes(m, down(spark, [("node-3", 3, 9), ("node-3", 3, 4), ("node-2", 4, 4)]), 2, limit).collect()}
    assert out == {("alpha", 1): (3, True), ("beta", 2): (3, True), ("alpha", 3): (2, True), ("gamma", 4): (1, False)}
    state = quorum.replica_state(m, down(spark, [("node-3", 3, 3), (None, 1, 9), ("node-1", 9, 1)]), limit)
    replicas = ring.replicas(m.select("key", "prefs", "coordinator").distinct())
    # node-3 missed the delete of alpha; if it answers first, the old value comes back
    first = quorum.read_outcomes(replicas, state, 2, arrival=F.when(F.col("node_id") == "node-3", "0").otherwise(F.col("node_id")))
    got = {x.key: (x.status, x.value) for x in first.collect()}
    assert got == {"alpha": ("FOUND", "v1"), "beta": ("FOUND", "v2"), "gamma": ("FOUND", "")}
    last = quorum.read_outcomes(replicas, state, 2, arrival=F.col("node_id"))
    assert {x.key: x.status for x in last.collect()} == {"alpha": "NOT_FOUND", "beta": "FOUND", "gamma": "FOUND"}
    strict = quorum.read_outcomes(replicas, state, 2, arrival=F.col("node_id"), empty_is_missing=True)
    assert {x.key: x.status for x in strict.collect()}["gamma"] == "NOT_FOUND"
    one_left = quorum.read_outcomes(replicas, state, 2, unreachable=["node-1", "node-2"])
    assert {x.status for x in one_left.collect()} == {"UNAVAILABLE"}
    assert [(x.node_id, x.key, x.seq_no, x.latest_seq_no) for x in quorum.stale(state, m).collect()] == [("node-3", "alpha", 1, 3)]


def test_the_log_is_not_shuffled_by_node(spark):
    m = spread(spark, [("alpha", 1, 1, "v1")], ring.Ring(nodes(3), 16))
    d = down(spark, [("node-3", 3, 9)])
    for df in (quorum.write_outcomes(m, d, 2), quorum.applied(m, d)):
        assert "Exchange hashpartitioning" not in df._jdf.queryExecution().executedPlan().toString()


def test_configuration(tmp_path):
    assert StorageConfig.load(None) == StorageConfig.load(str(tmp_path / "none")) == StorageConfig()
    (tmp_path / "c.json").write_text('{"compression": "snappy", "log_level": "debug", "block_size": 4096}')
    c = StorageConfig.load(str(tmp_path / "c.json"))
    assert (c.compression, c.log_level, c.block_size, c.memtable_max_bytes) == ("snappy", "debug", 4096, 67108864)
    (tmp_path / "n.json").write_text('{"node_id": "x", "listen_addr": "h:1", "seed_nodes": [{"node_id": "y", "listen_addr": "h:2"}], "storage": {"block_size": 1}}')
    n = NodeConfig.load(str(tmp_path / "n.json"))
    assert [p.node_id for p in n.members()] == ["x", "y"] and n.storage.block_size == 1 and n.reachable_quorums()
    assert not NodeConfig().reachable_quorums()
    for text in ('{"unknown": 1}', '{"storage": {"nope": 1}}', '[]'):
        (tmp_path / "b.json").write_text(text)
        with pytest.raises(InvalidArgument):
            NodeConfig.load(str(tmp_path / "b.json"))


BAD = [
    {"data_dir": ""}, {"memtable_max_bytes": 0}, {"block_size": 0}, {"bloom_false_positive": 1.0}, {"wal_fsync_every_n": 0}, {"max_immutable_tables": 0}, {"wal_segment_roll_bytes": -1}, {"l0_compaction_trigger": -1},
    {"size_tiered_fan_in": 1}, {"size_tiered_size_ratio": 0.5}, {"tombstone_grace_seconds": -1}, {"l0_stop_writes": -1}, {"l0_stop_writes": 3}, {"compression": "zip"}, {"log_level": "loud"},
]


@pytest.mark.parametrize("change", BAD)
def test_invalid_storage(change):
    with pytest.raises(InvalidArgument):
        StorageConfig(**change)


@pytest.mark.parametrize("change", [{"node_id": " "}, {"listen_addr": ""}, {"seed_nodes": (Peer("node-1", "x"),)}, {"replication_factor": 0}, {"write_quorum": 4}, {"read_quorum": 0}])
def test_invalid_node(change):
    with pytest.raises(InvalidArgument):
        NodeConfig(**change)


def test_statuses():
    assert [status_of(e) for e in (None, InvalidArgument(), NotFound(), WriteStall(), StoreClosed(), Corruption(), OSError())] == [
        "OK", "INVALID_ARGUMENT", "NOT_FOUND", "RESOURCE_EXHAUSTED", "UNAVAILABLE", "DATA_LOSS", "INTERNAL",
    ]
