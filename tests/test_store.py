import pytest

from tidelog.operators.store import Store
from tidelog.schema import InvalidArgument, StorageConfig, StoreClosed, TooManyImmutables, WriteStall
from tidelog.session import new_path
from tidelog.streaming.fold import StateStream

SCHEMA = "ord long, op int, key binary, value binary"


def write(spark, store, *rows):
    store.write(spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], SCHEMA))


def held(store):
    return {bytes(r.key): bytes(r.value) for r in store.scan().collect()}


def test_write_flush_merge_reopen(spark):
    s = Store(spark, new_path(spark, "s"), StorageConfig(size_tiered_fan_in=2))
    write(spark, s, (1, b"alpha", b"old"), (1, b"bravo", b"b"), (1, b"e", b""))
    s.flush()
    write(spark, s, (1, b"alpha", b"new"), (2, b"bravo", None), (2, b"never", None))
    want = {b"alpha": b"new", b"e": b""}
    assert held(s) == want
    s.flush()
    s.flush()
    assert held(s) == want and [t["id"] for t in s.doc["tables"]] == [2, 1] and s.doc["epoch"] == 2
    assert s.compact() == [2, 1] and [t["id"] for t in s.doc["tables"]] == [3] and s.doc["epoch"] == 3
    assert held(s) == want and s.entries().where("op = 2").count() == 2  # tombstones stay
    write(spark, s, (1, b"bravo", b"back"))
    again = Store(spark, s.path)
    assert held(again) == want | {b"bravo": b"back"} and again.doc["last_seq_no"] == 7
    assert [bytes(r.value) for r in again.get(b"bravo").collect()] == [b"back"] and again.compact() == []
    stats = s.stats()
    assert (stats["puts"], stats["deletes"], stats["flushes"], stats["compactions"], stats["active_entries"], stats["sst_count"]) == (5, 2, 2, 1, 1, 1)
    s.close()
    with pytest.raises(StoreClosed):
        s.scan()


def test_a_crash_before_publishing_changes_nothing(spark):
    s = Store(spark, new_path(spark, "s"), StorageConfig(size_tiered_fan_in=2))
    for v in (b"1", b"2"):
        write(spark, s, (1, b"alpha", v))
        s.flush()

    def die():
        raise InterruptedError

    with pytest.raises(InterruptedError):
        s.compact(before_publish=die)
    again = Store(spark, s.path)
    assert again.doc["epoch"] == 2 and len(again.doc["tables"]) == 2 and held(again) == {b"alpha": b"2"}
    assert again.vacuum() >= 1 and held(again) == {b"alpha": b"2"}


def test_stall_and_invalid_writes(spark):
    s = Store(spark, new_path(spark, "s"), StorageConfig(l0_stop_writes=2, l0_compaction_trigger=2, size_tiered_fan_in=2))
    for i in range(2):
        write(spark, s, (1, b"k%d" % i, b"v"))
        s.flush()
    with pytest.raises(WriteStall):
        write(spark, s, (1, b"x", b"v"))
    s.compact()
    write(spark, s, (1, b"x", b"v"))
    for bad in ((1, b"", b"v"), (2, b"k", b"v"), (5, b"k", b"v")):
        with pytest.raises(InvalidArgument):
            write(spark, s, bad)
    assert s.doc["last_seq_no"] == 3 and set(held(s)) == {b"k0", b"k1", b"x"}


def test_stream_equals_batch_and_repeats_do_nothing(spark, tmp_path):
    stream = StateStream(spark, new_path(spark, "stream"))
    schema = "key string, seq_no long, op int, value string"
    batches = [[("a", 1, 1, "x"), ("b", 2, 1, "y")], [("a", 3, 2, None), ("c", 4, 1, "z")], [("b", 2, 1, "y"), ("a", 1, 1, "x")]]
    for i, rows in enumerate(batches):
        spark.createDataFrame(rows, schema).write.parquet(str(tmp_path / f"in/{i}"))
    log = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in/*"))
    stream.start(log).awaitTermination()
    assert sorted((r.key, r.seq_no) for r in stream.live().collect()) == [("b", 2), ("c", 4)]
    stream.apply(spark.createDataFrame([("zzz", 99, 1, "late")], schema), 0)  # a batch number already published
    assert stream.live().count() == 2


def test_stream_merges_its_layers(spark):
    import random

    rnd, want, seq = random.Random(3), {}, 0
    stream = StateStream(spark, new_path(spark, "stream"), trigger=3, fan_in=2)
    for batch in range(7):
        rows = []
        for _ in range(20):
            seq += 1
            k, op = f"k{rnd.randrange(12)}", rnd.choice([1, 1, 2])
            rows.append((k, seq, op, str(seq)))
            want[k] = (seq, op)
        stream.apply(spark.createDataFrame(rows, "key string, seq_no long, op int, value string"), batch)
        assert len(stream.layers()) < 4
        assert {r.key: (r.seq_no, r.op) for r in stream.state().collect()} == want


def test_numbering_is_dense_and_ordered(spark):
    import random

    from tidelog.operators import snapshot

    ords = random.Random(1).sample(range(10**6), 3000)
    got = snapshot.numbered(spark.createDataFrame([(o, "x") for o in ords], "ord long, key string").repartition(7), 100).collect()
    assert [r.ord for r in sorted(got, key=lambda r: r.seq_no)] == sorted(ords)
    assert sorted(r.seq_no for r in got) == list(range(101, 3101))
    assert snapshot.numbered(spark.createDataFrame([], "ord long, key string"), 0).count() == 0


def test_frozen_tables_and_their_limit(spark):
    s = Store(spark, new_path(spark, "s"), StorageConfig(memtable_max_bytes=10, max_immutable_tables=2))
    for i in range(2):
        write(spark, s, (1, b"k%d" % i, b"x" * 9))
    assert len(s.doc["immutables"]) == 2 and s.doc["log"] == [] and s.due() == ["flush", "flush"]
    write(spark, s, (1, b"k2", b"x"))  # not full yet
    with pytest.raises(TooManyImmutables):
        write(spark, s, (1, b"k3", b"x" * 9))
    assert set(held(s)) == {b"k0", b"k1", b"k2", b"k3"} and s.doc["last_seq_no"] == 4  # it is in the log all the same
    assert s.background() == ["flush"] and [t["min_seq_no"] for t in s.doc["tables"]] == [2, 1]
    write(spark, s, (1, b"k4", b""))
    assert len(s.doc["immutables"]) == 1 and set(held(Store(spark, s.path))) == {b"k0", b"k1", b"k2", b"k3", b"k4"}


def test_overwrites_do_not_fill_a_table(spark):
    s = Store(spark, new_path(spark, "s"), StorageConfig(memtable_max_bytes=20))
    for _ in range(4):
        write(spark, s, (1, b"same", b"x" * 9))
    assert s.doc["immutables"] == [] and s.doc["log_bytes"] == 52 and s.stats()["active_bytes"] == 13


def test_closing(spark):
    config = StorageConfig(memtable_max_bytes=4)
    s = Store(spark, new_path(spark, "s"), config)
    write(spark, s, (1, b"a", b"1234"))
    s.close(fast=True)
    s.close()
    again = Store(spark, s.path, config)
    assert len(again.doc["immutables"]) == 1 and held(again) == {b"a": b"1234"}
    again.close()
    assert again.doc["immutables"] == [] and len(again.doc["tables"]) == 1
    assert held(Store(spark, s.path)) == {b"a": b"1234"}
    with pytest.raises(StoreClosed):
        write(spark, again, (1, b"b", b""))


def test_lookups_read_the_layers_that_may_hold_the_key(spark, tmp_path):
    s = Store(spark, new_path(spark, "s"))
    for keys in ((b"a", b"c"), (b"d", b"f"), (b"a", b"z")):
        write(spark, s, *[(1, k, k) for k in keys])
        s.flush()
    assert [bytes(r.value) for r in s.get(b"d").collect()] == [b"d"]
    c = s.stats()
    assert (c["gets"], c["range_skips"], c["table_reads"]) == (1, 1, 2)
    write(spark, s, (2, b"d", None), (1, b"new", b"n"))
    assert s.get(b"d").collect() == []
    s.export(str(tmp_path))
    tables = spark.read.format("kvsst").load(str(tmp_path))
    assert sorted((r.layer_id, bytes(r.key)) for r in tables.collect()) == [(1, b"a"), (1, b"c"), (2, b"d"), (2, b"f"), (3, b"a"), (3, b"z")]
    log = spark.read.format("kvwal").load(str(tmp_path))
    assert sorted((r.seq_no, r.op, bytes(r.key)) for r in log.collect()) == [(7, 2, b"d"), (8, 1, b"new")]


def test_background_work_and_status(spark):
    s = Store(spark, new_path(spark, "s"), StorageConfig(memtable_max_bytes=6, l0_compaction_trigger=2, size_tiered_fan_in=2))
    write(spark, s, (1, b"a", b"1"))
    assert s.background() == []
    write(spark, s, (1, b"b", b"12345"))
    assert s.background() == ["flush"]
    write(spark, s, (1, b"c", b"12345"))
    assert s.background_status()["flush_queue_len"] == 1
    assert s.background() == ["flush", "compact"] and len(s.doc["tables"]) == 1
    status = s.background_status()
    assert (status["flush_jobs_total"], status["compact_jobs_total"], status["last_error"]) == (2, 1, "none")

    def fail():
        raise OSError("disk")

    write(spark, s, (1, b"d", b"12345"))
    s.drain = fail
    assert s.background() == [] and s.background_status()["last_error"] == "flush: disk"
    assert s.stats()["engine_status"] == "degraded: flush: disk"


def test_command_line(spark, tmp_path):
    from tidelog.__main__ import main

    (tmp_path / "c.json").write_text('{"data_dir": "%s"}' % (tmp_path / "data"))
    said = []

    def call(*argv):
        said.clear()
        return main([*argv, "--config", str(tmp_path / "c.json")], spark, said.append)

    assert call("init") == 0
    assert call("put", "--key", "k", "--value", "v") == 0 and said == ["ok seq_no=1"]
    assert call("get", "--key", "k") == 0 and said == ["v"]
    assert call("flush") == 0 and said == ["ok sst_count=1 last_seq_no=1"]
    assert call("del", "--key", "k") == 0 and call("get", "--key", "k") == 0 and said == ["not found"]
    assert call("manifest-info") == 0 and said == ["1 000001.sst 6b 6b 1 1 23"]
    assert call("list-sst") == 0 and said == ["1 000001.sst 23 1"]
    assert call("compact") == 0 and call("stats") == 0 and "last_seq_no: 2" in said
    assert call("bg-status") == 0 and "last_error: none" in said and call("close") == 0
    with pytest.raises(SystemExit):
        call("put", "--key", "k")
