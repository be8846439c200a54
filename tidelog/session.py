"""Session-level helpers: input tables and the folder that all executors share."""

from __future__ import annotations

import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One input table, whole."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder for written intermediates.

    It is ``spark.checkpoint.dir`` of the session. Only where that is unset, and only with a local
    master, a temporary folder is made (tests); a cluster without the setting is an error, since a
    machine-local folder would be lost with its machine.
    """
    set_by_cluster = spark.conf.get("spark.checkpoint.dir", None)
    if set_by_cluster:
        return set_by_cluster
    context = spark.sparkContext  # shared by all sessions
    if not hasattr(context, "_tidelog_dir"):
        if context.master != "local" and not context.master.startswith("local["):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        context._tidelog_dir = "file://" + tempfile.mkdtemp(prefix="tidelog-")
    return context._tidelog_dir


def new_path(spark: SparkSession, what: str) -> str:
    """A fresh path for one written table in the shared folder."""
    return f"{shared_dir(spark).rstrip('/')}/tidelog/{what}-{uuid.uuid4().hex}"


def written(df: DataFrame, what: str) -> DataFrame:
    """``df`` written to the shared folder and read back: cuts lineage and survives lost executors."""
    path = new_path(df.sparkSession, what)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def clear_written(spark: SparkSession) -> None:
    """Remove everything written under the shared folder by this package; results read from it become invalid."""
    fs, p = hadoop_path(spark, f"{shared_dir(spark).rstrip('/')}/tidelog")
    fs.delete(p, True)


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def hadoop_path(spark: SparkSession, path: str):
    """(FileSystem, Path) of ``path`` on whatever file system its scheme names."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()), p


def ship(spark: SparkSession) -> SparkSession:
    """Make this package importable in Python workers, wherever the driver has it from."""
    if not hasattr(spark.sparkContext, "_tidelog_shipped"):
        root = Path(__file__).resolve().parent
        archive = Path(tempfile.mkdtemp(prefix="tidelog-code-")) / "tidelog.zip"
        with zipfile.ZipFile(archive, "w") as z:
            for p in sorted(root.rglob("*.py")):
                z.write(p, p.relative_to(root.parent))
        spark.sparkContext.addPyFile(str(archive))
        spark.sparkContext._tidelog_shipped = True
    return spark
