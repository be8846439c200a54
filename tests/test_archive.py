import random

import pytest

from tidelog.operators import archive
from tidelog.session import new_path

ENTRY = "layer_id long, key binary, value binary, seq_no long, tombstone boolean, part long, container string"
MANIFEST = "node_id string, run_id long, epoch long, id long, file string, file_size long"


def entries(spark, rows):
    return spark.createDataFrame([(*r, 7, "x") for r in rows], ENTRY)


def tables(spark, ids):
    return spark.createDataFrame([(i, "n", 1, f"{i:06d}.sst", 100 * i, 1) for i in ids], "id long, node_id string, run_id long, file string, file_size long, epoch long")


def plain(df):
    return sorted(((r.layer_id, r.key and bytes(r.key), None if r.value is None else bytes(r.value), r.seq_no, r.tombstone) for r in df.collect()), key=str)


def data():
    rnd = random.Random(2)
    rows = [(rnd.choice([1, 2, 3, 9]), b"k%05d" % i, rnd.randbytes(rnd.randrange(60)), i, False) for i in range(300)]
    rows += [(3, b"hot%05d" % i, b"x" * 50, i, False) for i in range(900)]
    return rows + [(1, b"t", None, 5, True), (1, b"n1", b"v", None, False), (1, b"n2", b"", 5, None), (2, None, b"v", 1, False), (2, b"", b"v", 1, False), (5, b"", None, None, None)]


def test_round_trip_and_parts(spark):
    rows = data()
    a = archive.pack(entries(spark, rows + rows[:50]), tables(spark, [1, 2, 3, 5, 8]), new_path(spark, "a"), target=8000)
    want = sorted({r for r in rows if r[0] in (1, 2, 3, 5, 8)}, key=str)
    assert plain(archive.unpack(a)) == want
    index = a.index.collect()
    assert len([r for r in index if r.id == 3]) > 3  # the large layer is split
    assert [(r.length, r.container) for r in index if r.id == 8] == [(0, None)]
    sizes = [len(r.payload) for r in a.containers.collect()]
    assert max(sizes) < 3 * 8000 and sum(sizes) == sum(r.length for r in index)
    assert plain(archive.unpack(a, spark.createDataFrame([(2,), (2,), (77,)], "id long"))) == [r for r in want if r[0] == 2]


def test_damage_is_noticed(spark):
    a = archive.pack(entries(spark, data()), tables(spark, [1]), new_path(spark, "a"))
    other = archive.Archive(spark, new_path(spark, "b"))
    a.containers.selectExpr("container", "payload", "transform(members, m -> named_struct('layer_id', m.layer_id, 'part', m.part, 'offset', m.offset, 'length', m.length, 'crc', m.crc + 1, 'entries', m.entries)) as members").write.parquet(f"{other.path}/containers")
    a.index.selectExpr("id", "file", "file_size", "part", "container", "offset", "length", "crc + 1 as crc", "entries").write.parquet(f"{other.path}/index")
    with pytest.raises(Exception, match="ChecksumError"):
        archive.unpack(other).collect()
    with pytest.raises(Exception, match="ChecksumError"):
        archive.small_layers(other).collect()


def test_the_salted_join_gives_the_same(spark):
    rows = data()
    a = archive.pack(entries(spark, rows), tables(spark, [1, 3]), new_path(spark, "a"), target=8000, most_broadcast=0)
    assert plain(archive.unpack(a)) == sorted({r for r in rows if r[0] in (1, 3)}, key=str)
    assert a.index.where("id = 3").count() > 3


def test_found_ids_are_read_from_the_containers(spark):
    a = archive.pack(entries(spark, data()), tables(spark, [1, 2, 3, 5, 8]), new_path(spark, "a"), target=8000)
    assert sorted(r.id for r in archive.small_layers(a, 801).collect()) == [1, 2, 3, 5, 8]
    other = archive.Archive(spark, new_path(spark, "b"))
    a.index.write.parquet(f"{other.path}/index")
    a.containers.limit(0).write.parquet(f"{other.path}/containers")
    assert [r.id for r in archive.small_layers(other, 801).collect()] == [8]  # nothing without its bytes

def test_right_tables(spark):
    rows = [("n", 1, 1, 7, "a", None), ("n", 1, 3, 7, "a", 50), ("n", 1, 3, 7, "a", 50), ("n", 2, 9, 7, "a", 1), ("n", 3, 1, 8, "b", 9), ("n", 1, None, 9, "c", 5), ("n", 1, 1, None, "d", 5), ("n", 1, 2, 10, "e", None)]
    runs = spark.createDataFrame([(1, "committed"), (2, "failed"), (3, None)], "run_id long, status string")
    got = archive.right_tables(spark.createDataFrame(rows, MANIFEST), runs).collect()
    assert sorted((r.id, r.file_size) for r in got) == [(7, 50), (9, 5), (10, None)]


def test_empty(spark):
    a = archive.pack(entries(spark, []), tables(spark, []), new_path(spark, "a"))
    assert archive.unpack(a).count() == 0 and archive.small_layers(a).count() == 0
