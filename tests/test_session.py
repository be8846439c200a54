import pytest

from tidelog import session


class Conf(dict):
    def get(self, key, default=None):
        return dict.get(self, key, default)


class Fake:
    def __init__(self, master, **conf):
        self.conf = Conf({"spark.checkpoint.dir": conf["dir"]} if conf else {})
        self.sparkContext = type("Context", (), {"master": master})()


def test_the_shared_folder_is_the_clusters():
    assert session.shared_dir(Fake("spark://host:7077", dir="hdfs://x/y")) == "hdfs://x/y"
    with pytest.raises(RuntimeError):
        session.shared_dir(Fake("spark://host:7077"))
    with pytest.raises(RuntimeError):
        session.shared_dir(Fake("local-cluster[3,2,1024]"))
    local = Fake("local[4]")
    assert session.shared_dir(local).startswith("file://") and session.shared_dir(local) == session.shared_dir(local)


def test_written_keeps_rows_and_schema(spark):
    df = spark.createDataFrame([(1, None), (None, b"x")], "a long, b binary")
    back = session.written(df, "test")
    assert back.schema == df.schema and sorted(back.collect(), key=str) == sorted(df.collect(), key=str)
    assert session.written(df.limit(0), "test").count() == 0


def test_another_session_can_use_python_workers(spark):
    from tidelog.operators import bloom

    other = spark.newSession()
    for s in (spark, other):
        assert bloom.key_hashes(s.createDataFrame([(b"a",)], "key binary")).count() == 1
