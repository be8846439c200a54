"""Log records as rows of bytes: encoding, checksums and decoding, many at a time."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidelog.functions import hashing
from tidelog.session import ship
from tidelog.sources import codec


def encoded(log: DataFrame) -> DataFrame:
    """(seq_no, record): each mutation (op, seq_no, key, value) as the bytes of its log record. Invalid mutations raise."""
    ship(log.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = list(zip(*(c.to_pylist() for c in batch.columns)))
            for r in rows:
                codec.check_record(*r)
            yield pa.RecordBatch.from_arrays([batch.column(1), pa.array(codec.encode(rows), pa.binary())], names=["seq_no", "record"])

    narrow = log.select(F.col("op").cast("int").alias("op"), "seq_no", F.col("key").cast("binary").alias("key"), F.col("value").cast("binary").alias("value"))
    return narrow.mapInArrow(run, "seq_no long, record binary")


def decoded(records: DataFrame) -> DataFrame:
    """(op, seq_no, key, value, crc) of rows ``record``, each holding one whole record; a wrong checksum raises."""
    ship(records.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw = batch.column(0).to_pylist()
            rows = [r for data in raw for r in codec.decode(data)]
            crcs = hashing.crc32c([data[:17] + data[codec.RECORD.size :] for data in raw])
            cols = [[r[i] for r in rows] for i in range(4)]
            kinds = (pa.int32(), pa.int64(), pa.binary(), pa.binary())
            yield pa.RecordBatch.from_arrays([*(pa.array(c, k) for c, k in zip(cols, kinds)), pa.array(crcs.astype("int64"))], names=["op", "seq_no", "key", "value", "crc"])

    return records.select("record").mapInArrow(run, "op int, seq_no long, key binary, value binary, crc long")
