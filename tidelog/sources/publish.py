"""Atomic publication of small JSON documents in numbered versions, through Hadoop file systems.

On file systems whose rename refuses an existing target (HDFS, a mounted folder) a version is written
under a temporary name and renamed to its number, so of two writers one wins; what was written but
not renamed is never read. Object stores have no such rename, but show an object only when it is
whole: there the version itself is created on the condition that it does not exist, which their
connectors do in one request (for s3a with Hadoop 3.4.1 or later and a store that knows conditional
writes). Other schemes are refused rather than trusted.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import SparkSession

from tidelog.session import hadoop_path


#: Schemes whose rename refuses an existing target, and schemes that create on condition.
RENAMING, CONDITIONAL = frozenset(("file", "hdfs", "viewfs", "webhdfs")), frozenset(("s3a", "gs", "abfs", "abfss"))


class PublishConflict(RuntimeError):
    """Another writer has published this version."""


def _name(version: int) -> str:
    return f"{version:012d}.json"


def latest_version(spark: SparkSession, folder: str) -> int:
    """The highest published version, 0 if there is none."""
    fs, p = hadoop_path(spark, folder)
    if not fs.exists(p):
        return 0
    names = [s.getPath().getName() for s in fs.listStatus(p)]
    return max((int(n[:-5]) for n in names if n.endswith(".json") and n[:-5].isdigit()), default=0)


def load(spark: SparkSession, folder: str, version: int) -> dict:
    fs, p = hadoop_path(spark, f"{folder}/{_name(version)}")
    stream = fs.open(p)
    try:
        return json.loads(bytes(stream.readAllBytes()).decode())
    finally:
        stream.close()


def _create(spark: SparkSession, fs, target, data: bytearray) -> None:
    """Write ``target`` whole if it does not exist, in one conditional request."""
    try:
        builder = fs.createFile(target)
        stream = builder.overwrite(False).opt("fs.option.create.conditional.overwrite", True).build()
        stream.write(data)
        stream.close()
    except Exception as e:
        raise PublishConflict(f"{target} exists or cannot be created: {e}") from e


def publish(spark: SparkSession, folder: str, version: int, document: dict) -> None:
    """Make ``document`` version ``version``; PublishConflict if that number exists."""
    fs, target = hadoop_path(spark, f"{folder}/{_name(version)}")
    scheme = fs.getUri().getScheme()
    if scheme in CONDITIONAL:
        return _create(spark, fs, target, bytearray(json.dumps(document).encode()))
    if scheme not in RENAMING:
        raise ValueError(f"no atomic publication is known for {scheme}")
    _, tmp = hadoop_path(spark, f"{folder}/.{uuid.uuid4().hex}.tmp")
    stream = fs.create(tmp, False)
    stream.write(bytearray(json.dumps(document).encode()))
    stream.close()
    if fs.exists(target) or not fs.rename(tmp, target):
        fs.delete(tmp, False)
        raise PublishConflict(f"version {version} of {folder} exists")


def remove(spark: SparkSession, path: str) -> None:
    fs, p = hadoop_path(spark, path)
    fs.delete(p, True)


def remove_unnamed(spark: SparkSession, folder: str, prefix: str | tuple[str, ...], named: set[str]) -> int:
    """Remove what lies in ``folder``, begins with ``prefix`` and is not ``named``; the number removed."""
    fs, p = hadoop_path(spark, folder)
    loose = [s.getPath() for s in fs.listStatus(p)] if fs.exists(p) else []
    loose = [x for x in loose if x.getName().startswith(prefix) and x.getName() not in named]
    for x in loose:
        fs.delete(x, True)
    return len(loose)
