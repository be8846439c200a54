import random
from pathlib import Path

import pytest

from tidelog.functions import hashing
from tidelog.schema import Corruption, InvalidArgument
from tidelog.sources import codec, datasource


def records(n=50):
    rnd = random.Random(4)
    return [(op := rnd.choice([1, 2]), i, b"key%d" % i, None if op == 2 else rnd.randbytes(rnd.randrange(30))) for i in range(n)]


def test_known_checksum():
    assert [int(c) for c in hashing.crc32c([b"123456789", b"", b"a"])] == [0xE3069283, 0, 0xC1D04330]


def test_record_layout():
    (raw,) = codec.encode([(1, 42, b"user:123", b"hello")])
    assert len(raw) == 21 + 8 + 5 and raw[0] == 1 and raw[1:9] == (42).to_bytes(8, "little")
    assert list(codec.decode(raw)) == [(1, 42, b"user:123", b"hello")]


def test_segments_roll_and_replay(tmp_path):
    rows = records()
    assert len(codec.write_segments(str(tmp_path), rows[:30], 200)) > 2
    codec.write_segments(str(tmp_path), rows[30:], 200)
    (tmp_path / "junk.wal").write_text("x")
    (tmp_path / "000000.wal").write_text("x")
    got = [r for i in codec.segment_ids(str(tmp_path)) for r in codec.read_segment(codec.segment_path(str(tmp_path), i))]
    assert got == rows
    assert codec.segment_ids(str(tmp_path / "none")) == []


def test_torn_tail_and_corruption(tmp_path):
    codec.write_segments(str(tmp_path), records(3))
    path = Path(codec.segment_path(str(tmp_path), 1))
    whole = path.read_bytes()
    for cut in (4, 30):
        path.write_bytes(whole[:-cut])
        with pytest.raises(Corruption):
            codec.read_segment(path)
        assert codec.read_segment(path, torn_tail=True) == records(3)[: len(codec.read_segment(path, torn_tail=True))]
        assert path.stat().st_size == len(whole) - cut
    for at, what in ((0, 0xFF), (4, 9), (len(whole) - 1, whole[-1] ^ 1)):
        path.write_bytes(whole[:at] + bytes([what]) + whole[at + 1 :])
        with pytest.raises(Corruption):
            codec.read_segment(path, torn_tail=True)
    path.write_bytes(b"LS")
    with pytest.raises(Corruption):
        codec.read_segment(path)


def test_records_that_may_not_be_written(tmp_path):
    for bad in ((3, 1, b"k", b"v"), (1, 1, b"", b"v"), (2, 1, b"k", b"v"), (1, 1 << 63, b"k", b"v"), (1, 1, b"k", bytes(65 << 20))):
        with pytest.raises(InvalidArgument):
            codec.write_segments(str(tmp_path), [bad])


def test_table_files(tmp_path):
    entries = [(b"charlie", b"3", 3, False), (b"alpha", b"1", 1, False), (b"bravo", None, 2, True), (b"empty", b"", 4, False)]
    codec.write_table(tmp_path / "000001.sst", entries)
    got, index, _ = codec.read_table(tmp_path / "000001.sst")
    assert got == sorted(entries) and index == [(b"alpha", 0)]
    whole = (tmp_path / "000001.sst").read_bytes()
    for bad in (whole[:10], whole[:-8] + bytes([255] * 8), whole[:25] + bytes([whole[25] ^ 1]) + whole[26:]):
        (tmp_path / "bad.sst").write_bytes(bad)
        with pytest.raises(Corruption):
            codec.read_table(tmp_path / "bad.sst")


def test_spark_sources(spark, tmp_path):
    datasource.register(spark)
    rows = records(200)
    df = spark.createDataFrame([(s, op, k, v) for op, s, k, v in rows], "seq_no long, op tinyint, key binary, value binary").repartition(3)
    df.write.format("kvwal").mode("append").option("path", str(tmp_path)).option("rollBytes", "900").save()
    back = spark.read.format("kvwal").load(str(tmp_path))
    assert sorted((r.op, r.seq_no, bytes(r.key), None if r.value is None else bytes(r.value)) for r in back.collect()) == sorted(rows)
    assert back.select("segment_id").distinct().count() == len(codec.segment_ids(str(tmp_path))) > 3
    codec.write_table(tmp_path / "000007.sst", [(b"a", b"1", 1, False), (b"b", None, 2, True)])
    t = spark.read.format("kvsst").load(str(tmp_path))
    assert sorted((r.layer_id, bytes(r.key), r.tombstone) for r in t.collect()) == [(7, b"a", False), (7, b"b", True)]
    assert [bytes(r.value) for r in t.where("key = X'61'").collect()] == [b"1"]


def test_records_longer_than_a_chunk(tmp_path):
    rows = [(1, i, b"key%d" % i, bytes(rnd)) for i, rnd in enumerate((0, 3, 5000, 70, 9000))]
    codec.write_segments(f"file://{tmp_path}", rows)
    raw = Path(codec.segment_path(str(tmp_path), 1)).read_bytes()[8:]
    import io

    for chunk in (1, 100, 4000, 1 << 20):
        assert list(codec.decode_stream(io.BytesIO(raw), len(raw), chunk=chunk)) == rows
    assert codec.read_segment(codec.segment_path(f"file://{tmp_path}", 1)) == rows


def test_a_lookup_reads_one_block(tmp_path):
    entries = [(b"k%04d" % i, None if i % 9 == 0 else b"v" * 50, i, i % 9 == 0) for i in range(2000)]
    size = codec.write_table(tmp_path / "000001.sst", entries, 512)
    t = codec.TableFile(tmp_path / "000001.sst")
    read = []

    class Counting:
        def __init__(self, f):
            self.f = f

        def seek(self, at):
            self.f.seek(at)

        def read(self, n):
            read.append(n)
            return self.f.read(n)

    t.file = Counting(t.file)
    for i in (0, 1, 777, 1998, 1999):
        assert t.get(b"k%04d" % i) == entries[i]
    assert sum(read) < 5 * 700 < size and t.counters == {"bloom_checks": 5, "bloom_skips": 0, "block_reads": 5}
    for i in range(300):
        assert t.get(b"absent%d" % i) is None
    assert t.get(b"") is None and t.counters["bloom_skips"] > 280


def test_tables_written_and_looked_up_by_spark(spark, tmp_path):
    rows = [(i % 3, b"k%03d" % (i // 2), i, i % 7 == 0) for i in range(300)]
    best = {}
    for l, k, s, t in rows:
        best[l, k] = (s, t)
    data = [(l, k, None if t else b"v%d" % s, s, t) for (l, k), (s, t) in best.items()]
    datasource.write_tables(spark.createDataFrame(data, "layer_id long, key binary, value binary, seq_no long, tombstone boolean"), str(tmp_path), 256)
    back = spark.read.format("kvsst").load(str(tmp_path))
    plain = lambda r: (r.layer_id, bytes(r.key), None if r.value is None else bytes(r.value), r.seq_no, r.tombstone)
    assert sorted(map(plain, back.collect())) == sorted(data)
    assert sorted(map(plain, back.where("key in (X'6B303035', X'6B303036', X'00')").collect())) == sorted(d for d in data if d[1] in (b"k005", b"k006"))
    asked = spark.createDataFrame([(b"k005",), (b"none",), (b"k005",), (None,)], "key binary")
    got = datasource.point_reads(asked, str(tmp_path)).collect()
    newest = max(d for d in data if d[1] == b"k005")
    assert [(r.layer_id, r.seq_no) for r in got if r.key is not None and bytes(r.key) == b"k005"] == [(newest[0], newest[3])] * 2
    assert [(r.layer_id, r.bloom_checks) for r in got if r.key is None or bytes(r.key) == b"none"] == [(None, 3), (None, 0)]
    with pytest.raises(Exception, match="written twice"):
        datasource.write_tables(spark.createDataFrame(data[:1], "layer_id long, key binary, value binary, seq_no long, tombstone boolean"), str(tmp_path))


def test_a_folder_that_is_not_shared_is_noticed(tmp_path):
    w = datasource.LogWriter({"path": str(tmp_path)})
    m = w.write([{"op": 1, "seq_no": 1, "key": b"k", "value": b"v"}])
    for f in Path(m.part).iterdir():
        f.unlink()
    with pytest.raises(Corruption):
        w.commit([m])


def test_spark_source_torn_tail(spark, tmp_path):
    datasource.register(spark)
    for part in (records(5), records(4)):
        codec.write_segments(str(tmp_path), part)
    last = Path(codec.segment_path(str(tmp_path), 2))
    last.write_bytes(last.read_bytes()[:-1])
    assert spark.read.format("kvwal").load(str(tmp_path)).count() == 8
    first = Path(codec.segment_path(str(tmp_path), 1))
    first.write_bytes(first.read_bytes()[:-1])
    with pytest.raises(Exception, match="cut off"):
        spark.read.format("kvwal").load(str(tmp_path)).count()
    assert spark.read.format("kvwal").option("mode", "PERMISSIVE").load(str(tmp_path)).count() == 7


def test_many_keys_are_looked_up_in_a_table_together(tmp_path):
    entries = [(b"k%04d" % i, None if i % 9 == 0 else b"v" * 50, i, i % 9 == 0) for i in range(2000)]
    size = codec.write_table(tmp_path / "000001.sst", entries, 512)
    t = codec.TableFile(tmp_path / "000001.sst")
    keys = [b"k%04d" % i for i in range(0, 2000, 7)] + [b"absent%d" % i for i in range(3000)] + [b"", b"a", b"z", b"k0000\0"]
    passing = t.passing(*hashing.bloom_hashes(keys)).tolist()
    assert passing == [i for i, k in enumerate(keys) if t.maybe(k)] and 286 < len(passing) < 400
    keys = dict.fromkeys(sorted(keys))
    assert t.find(keys) == {k: e for k in keys if (e := t.get(k))} and len(t.find(keys)) == 286
    assert t.find([]) == t.find([b"a"]) == {} and t.passing(*hashing.bloom_hashes([])).tolist() == []
    read, held = [], t.file

    class Counting:
        def seek(self, at):
            held.seek(at)

        def read(self, n):
            read.append(n)
            return held.read(n)

    t.file = Counting()
    t.find(keys)
    assert sum(read) <= size and len(read) < 286
    read.clear()
    assert list(t.find([b"k0001", b"k0002", b"k1500"])) == [b"k0001", b"k0002", b"k1500"] and sum(read) < 2 * 700


@pytest.mark.parametrize("span", [1, 64])
def test_point_reads_answer_every_request(spark, tmp_path, monkeypatch, span):
    """Also what is asked more than 1,024 times, null keys, and keys that several spans of tables hold."""
    monkeypatch.setattr(datasource, "SPAN", span)
    monkeypatch.setattr(datasource, "HELD", 2)
    schema = "layer_id long, key binary, value binary, seq_no long, tombstone boolean"
    rows = [(1, b"a", b"1", 1, False), (1, b"b", b"2", 2, False), (2, b"a", None, 3, True), (3, b"c", b"", 4, False), (4, b"b", b"5", 5, False), (5, b"d", b"6", 6, False)]
    datasource.write_tables(spark.createDataFrame(rows, schema), str(tmp_path))
    asked = [b"a"] * 2500 + [b"b", b"b", None, b"", b"none", None] + [b"c"] * 1024 + [b"d"] * 1025
    got = datasource.point_reads(spark.createDataFrame([(k,) for k in asked], "key binary"), str(tmp_path))
    count = {(k and bytes(k), l, v and bytes(v), s, t, c): n for k, l, v, s, t, c, n in got.groupBy("key", "layer_id", "value", "seq_no", "tombstone", "bloom_checks").count().collect()}
    assert count == {
        (b"a", 2, None, 3, True, 4): 2500, (b"b", 4, b"5", 5, False, 2): 2, (b"c", 3, b"", 4, False, 3): 1024, (b"d", 5, b"6", 6, False, 1): 1025,
        (None, None, None, None, None, 0): 2, (b"", None, None, None, None, 5): 1, (b"none", None, None, None, None, 5): 1,
    }
    assert datasource.point_reads(spark.createDataFrame([(b"a",)], "key binary"), f"{tmp_path}/none").select("layer_id", "bloom_checks").collect() == [(None, 0)]


@pytest.mark.parametrize("partitions", [1, 4])
def test_many_keys_are_answered_without_a_lookup_each(spark, tmp_path, monkeypatch, partitions):
    """What is asked more than 1,024 times, null keys, tombstones, empty values and keys of several tables too, as point_reads says."""
    schema = "layer_id long, key binary, value binary, seq_no long, tombstone boolean"
    rows = [(l, b"k%d" % k, None if (dead := (l + k) % 5 == 0) else b"" if k % 7 == 0 else b"v%d" % l, l * 1000 + k, dead) for l in range(9) for k in range(l, 90, l + 1)]
    datasource.write_tables(spark.createDataFrame(rows, schema), str(tmp_path), 128)
    asked = [b"k%d" % k for k in range(100)] + [b"absent%d" % k for k in range(2000)] + [b"", None, None, b"k0\0"] + [b"k12"] * 1500
    requests = spark.createDataFrame([(k,) for k in asked], "key binary")
    said = lambda df: sorted(map(repr, df.select("key", "layer_id", "value", "seq_no", "tombstone").collect()))
    one_by_one = said(datasource.point_reads(requests, str(tmp_path)))
    few = spark.createDataFrame([(b"k12",), (b"none",)], "key binary")
    assert said(datasource.answers(few, str(tmp_path))) == said(datasource.point_reads(few, str(tmp_path)))
    monkeypatch.setattr(datasource, "_each_looked_up", None)
    held = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", partitions)
    try:
        assert said(datasource.answers(requests, str(tmp_path))) == one_by_one and len(one_by_one) == len(asked)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", held)


def test_the_newest_entries_are_read_without_filters_and_each_table_once(tmp_path, monkeypatch):
    for l in range(4):
        codec.write_table(datasource.table_path(tmp_path.as_posix(), l), [(b"k%03d" % k, b"v%d" % l, k, False) for k in range(l * 20, 100)], 64)
    monkeypatch.setattr(codec.TableFile, "passing", None)
    monkeypatch.setattr(codec.TableFile, "find", None)
    read, whole = [], codec.stream_columns
    monkeypatch.setattr(codec, "stream_columns", lambda file, length, *a: read.append(length) or whole(file, length, *a))
    got = [r for batch in datasource._newest_entries(tmp_path.as_posix(), [3, 2, 1, 0]) for r in batch.to_pylist()]
    assert {r["key"]: r["layer_id"] for r in got} == {b"k%03d" % k: min(k // 20, 3) for k in range(100)} and len(got) == 100
    assert len(read) == 4


def test_tables_are_written_from_any_batches(tmp_path):
    """A layer over several batches, several layers in one, rows not in order of their keys, and entries that may not be."""
    import pyarrow as pa

    schema = pa.schema({"layer_id": pa.int64(), "key": pa.binary(), "value": pa.binary(), "seq_no": pa.int64(), "tombstone": pa.bool_()})
    rnd = random.Random(3)
    entries = {l: {rnd.randbytes(rnd.randrange(1, 9)): (None if i % 4 == 0 else rnd.randbytes(rnd.randrange(0, 40)), i, i % 4 == 0) for i in range(60)} for l in (3, 5, 8)}
    for at, order in enumerate((sorted, list)):
        rows = [(l, k, *e[k]) for l, e in entries.items() for k in order(e)]
        for n in (1, 7, 70, 1000):
            folder = f"{tmp_path}/{at}-{n}"
            w = datasource.TableWriter({"path": folder, "blocksize": "256"})
            w.commit([w.write(pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows[i : i + n]), schema)], schema=schema) for i in range(0, len(rows), n))])
            for l, e in entries.items():
                path = datasource.table_path(folder, l)
                assert codec.read_table(path)[0] == [(k, *e[k]) for k in sorted(e)]
                codec.write_table(f"{tmp_path}/alone.sst", [(k, *e[k]) for k in e], 256)
                assert Path(path).read_bytes() == Path(f"{tmp_path}/alone.sst").read_bytes()
    for bad in ((None, b"k", b"v", 1, False), (1, None, b"v", 1, False), (1, b"k", b"v", None, False), (1, b"k", b"v", -1, False)):
        w = datasource.TableWriter({"path": f"{tmp_path}/bad"})
        with pytest.raises(InvalidArgument):
            w.write([pa.RecordBatch.from_arrays([pa.array([c], f.type) for c, f in zip(bad, schema)], schema=schema)])


def test_checksums_of_all_lengths():
    def slow(b):
        c = 0xFFFFFFFF
        for x in b:
            c ^= x
            for _ in range(8):
                c = c >> 1 ^ (hashing.CASTAGNOLI if c & 1 else 0)
        return c ^ 0xFFFFFFFF

    rnd = random.Random(5)
    data = [rnd.randbytes(n) for n in [*range(20), 0, 300, 3, 301]]
    assert hashing.crc32c(data).tolist() == [slow(b) for b in data]
    assert hashing.crc32c([]).tolist() == []
