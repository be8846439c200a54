"""Counters of a store as one-row tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidelog.operators.layers import record_bytes
from tidelog.schema import DEL, PUT
from tidelog.sources import datasource


def op_counts(log: DataFrame) -> DataFrame:
    return log.groupBy("op").agg(F.count(F.lit(1)).alias("n"), F.min("seq_no").alias("first_seq_no"), F.max("seq_no").alias("last_seq_no"))


def log_bytes(log: DataFrame, by: list[str] = []) -> DataFrame:
    """Records and encoded bytes of the log, in all or per segment."""
    return log.groupBy(*by).agg(F.count(F.lit(1)).alias("records"), F.sum(record_bytes()).cast("long").alias("bytes"), F.max("seq_no").alias("last_seq_no"))


def segments(log: DataFrame) -> DataFrame:
    """Per node: number of segments, the active (highest) one, and counters over all of them."""
    return log.groupBy("node_id").agg(
        F.countDistinct("segment_id").alias("total_segments"), F.max("segment_id").alias("active_segment"), F.count(F.lit(1)).alias("records"),
        F.sum(F.lit(21) + F.coalesce(F.length("key"), F.lit(0)) + F.coalesce(F.length("value"), F.lit(0))).cast("long").alias("bytes"), F.max("seq_no").alias("last_seq_no"),
    )


def store_stats(log: DataFrame, tables: DataFrame) -> DataFrame:
    """One row: counters of the log and of the live tables (id, file_size)."""
    l = log.agg(
        F.count(F.lit(1)).alias("mutations"), F.coalesce(F.sum((F.col("op") == PUT).cast("long")), F.lit(0)).alias("puts"), F.coalesce(F.sum((F.col("op") == DEL).cast("long")), F.lit(0)).alias("deletes"),
        F.max("seq_no").alias("last_seq_no"), F.coalesce(F.sum(record_bytes()).cast("long"), F.lit(0)).alias("bytes_written"),
    )
    t = tables.agg(F.count(F.lit(1)).alias("tables"), F.coalesce(F.sum("file_size"), F.lit(0)).cast("long").alias("bytes")).select(F.struct("tables", "bytes")).scalar()
    return l.withColumns({"sst_count": t["tables"], "sst_total_bytes": t["bytes"]})


def read_metrics(requests: DataFrame, folder: str) -> DataFrame:
    """One row: filter checks, filter skips and block reads of looking up every key of ``requests`` in the tables of ``folder``."""
    met = datasource.point_reads(requests.select("key").distinct(), folder)
    return met.agg(*[F.coalesce(F.sum(c), F.lit(0)).cast("long").alias(c) for c in ("bloom_checks", "bloom_skips", "block_reads")])
