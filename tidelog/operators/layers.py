"""Immutable layers: assigning, flushing, describing and merging them."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidelog.operators import bloom, snapshot
from tidelog.schema import DEL
from tidelog.session import ship

RECORD_HEADER, INDEX_HEADER, FOOTER = 21, 12, 16


def flush(log: DataFrame) -> DataFrame:
    """The entries (layer_id, key, seq_no, op, value) of each layer: the fold within the layer, tombstones kept."""
    return snapshot.latest(log, ("layer_id", "key"))


def entries(flushed: DataFrame) -> DataFrame:
    """Entry form of flushed rows: a tombstone flag instead of the operation."""
    return flushed.select("layer_id", "key", "value", "seq_no", (F.col("op") == DEL).alias("tombstone"))


def record_bytes():
    return F.lit(RECORD_HEADER) + F.length("key") + F.coalesce(F.length("value"), F.lit(0))


def sized(log: DataFrame) -> DataFrame:
    """What ``flush`` and ``describe`` need to describe layers: (layer_id, key, seq_no, bytes), without the values."""
    return log.select("layer_id", "key", "seq_no", record_bytes().cast("long").alias("bytes"))


def describe(flushed: DataFrame) -> DataFrame:
    """Per layer: entry count, key and sequence range, and the bytes of its records, from the values or from ``bytes`` as of ``sized``."""
    size = F.col("bytes") if "bytes" in flushed.columns else record_bytes()
    return flushed.groupBy("layer_id").agg(
        F.count(F.lit(1)).alias("entries"), F.min("key").alias("min_key"), F.max("key").alias("max_key"), F.min("seq_no").alias("min_seq_no"), F.max("seq_no").alias("max_seq_no"),
        F.sum(size).cast("long").alias("data_bytes"),
    )


def write_layer(flushed: DataFrame, path: str, codec: str = "snappy", page_bytes: int = 8192, fp_rate: float = 0.01, bloom_ndv: int | None = None) -> None:
    """One layer as Parquet: range-partitioned and sorted by key, with pages of ``page_bytes`` and a Bloom filter on the key."""
    writer = flushed.repartitionByRange("key").sortWithinPartitions("key").write.option("compression", codec)
    writer = writer.option("parquet.bloom.filter.enabled#key", "true").option("parquet.bloom.filter.fpp#key", str(fp_rate)).option("parquet.page.size", str(page_bytes))
    if bloom_ndv:
        writer = writer.option("parquet.bloom.filter.expected.ndv#key", str(bloom_ndv))
    writer.parquet(path)


def read_layers(spark: SparkSession, paths: list[str]) -> DataFrame:
    """Every entry of the given live layers; the list is the snapshot, later layers are not seen."""
    return spark.read.parquet(*paths)


def live_layers(rows: DataFrame, tables: DataFrame) -> DataFrame:
    """Rows of layers named in ``tables`` (id)."""
    return rows.join(tables.select(F.col("id").alias("layer_id")).distinct(), "layer_id", "left_semi")


def orphans(rows: DataFrame, tables: DataFrame) -> DataFrame:
    """Layers that exist without being in ``tables``: invisible, for a vacuum to remove."""
    return rows.select("layer_id").distinct().join(tables.select(F.col("id").alias("layer_id")), "layer_id", "left_anti")


def merge(inputs: DataFrame, rank: str = "layer_id") -> DataFrame:
    """One entry per key: the greatest seq_no; of equal ones the input of lowest ``rank``. Tombstones stay."""
    order = F.struct(F.col("seq_no"), -F.col(rank))
    return snapshot.latest(inputs, ("key",), order)


def layer_rule(flushed: DataFrame) -> DataFrame:
    """Reads resolved by layer order instead of sequence number: the newest layer that has the key wins."""
    return snapshot.latest(flushed, ("key",), "layer_id")


def assign_rotations(log: DataFrame, max_bytes: int, shard: list[str]) -> DataFrame:
    """``log`` with ``layer_no``: within each shard a table is frozen once its current entries reach ``max_bytes``.

    Bytes are those of the distinct keys' latest entries, as an overwrite replaces its predecessor. What an
    overwrite replaces is told by the row before it of the same key, so the fold over a shard is over
    numbers only and its state is two of them; its keys and values are not touched. The fold is
    sequential within a shard, so a shard must be bounded: a fixed range of sequence numbers, or a log segment,
    of one node. Numbers must be unique within a shard; a null value has no bytes.
    """
    ship(log.sparkSession)
    size = F.length("key") + F.coalesce(F.length("value"), F.lit(0))
    of_key = Window.partitionBy(*shard, "key").orderBy("seq_no")
    sized = log.select(*shard, "seq_no", size.cast("long").alias("size"), F.lag("seq_no").over(of_key).alias("prev"), F.lag(size.cast("long")).over(of_key).alias("prev_size"))
    sized = sized.select(*shard, "seq_no", "size", F.coalesce("prev", F.lit(-1)).alias("prev"), F.coalesce("prev_size", F.lit(0)).alias("prev_size"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, no, start, total = None, 0, 0, 0
        for batch in batches:
            out = []
            columns = (batch.column(batch.schema.get_field_index(c)).to_pylist() for c in (*shard, "seq_no", "size", "prev", "prev_size"))
            for *where, seq, own, prev, replaced in zip(*columns):
                if where != at:
                    at, no, start, total = where, 0, seq, 0
                out.append(no)
                total += own - (replaced if prev >= start else 0)
                if total >= max_bytes:
                    no, start, total = no + 1, seq + 1, 0
            kept = [batch.schema.get_field_index(c) for c in (*shard, "seq_no")]
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in kept), pa.array(out, pa.int64())], names=[*shard, "seq_no", "layer_no"])

    kinds = ", ".join(f"`{n}` {log.schema[n].dataType.simpleString()}" for n in (*shard, "seq_no"))
    parted = sized.repartition(*shard).sortWithinPartitions(*shard, "seq_no")
    numbers = parted.mapInArrow(run, f"{kinds}, layer_no long")
    return log.join(numbers, [*shard, "seq_no"])


def blocks(flushed: DataFrame, block_size: int = 8192) -> DataFrame:
    """(layer_id, block, first_key, offset): entries in key order fill a block until it reaches ``block_size``.

    A block closes after the entry that fills it, so the fold is sequential per layer; it streams
    with constant memory, and a layer is bounded by the memtable limit.
    """
    ship(flushed.sparkSession)
    kind = flushed.schema["key"].dataType.simpleString()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        layer, block, offset, start = None, -1, 0, None
        for pdf in batches:
            out = []
            for own, key, size in zip(pdf["layer_id"], pdf["key"], pdf["size"]):
                if own != layer:
                    layer, block, offset, start = own, -1, 0, None
                if start is None:
                    block, start = block + 1, offset
                    out.append((own, block, key, offset))
                offset += size
                if offset - start >= block_size:
                    start = None
            yield pd.DataFrame(out, columns=["layer_id", "block", "first_key", "offset"])

    sized = flushed.select("layer_id", "key", record_bytes().cast("long").alias("size")).repartition("layer_id").sortWithinPartitions("layer_id", "key")
    return sized.mapInPandas(run, f"layer_id long, block int, first_key {kind}, offset long")


def file_sizes(flushed: DataFrame, block_size: int = 8192, fp_rate: float = 0.01) -> DataFrame:
    """Bytes of each layer as a file: records, block index, Bloom filter and footer."""
    index = blocks(flushed, block_size).groupBy("layer_id").agg(F.sum(F.lit(INDEX_HEADER) + F.length("first_key")).cast("long").alias("index_bytes"), F.count(F.lit(1)).alias("blocks"))
    data = describe(flushed).join(index, "layer_id").withColumn("m", bloom.bits(F.col("entries"), fp_rate))
    size = F.col("data_bytes") + F.col("index_bytes") + 16 + F.col("m") / 8 + FOOTER
    return data.select("layer_id", "entries", "blocks", "data_bytes", "index_bytes", size.cast("long").alias("file_size"))


def locate(requests: DataFrame, index: DataFrame, salts: int = 16) -> DataFrame:
    """The block of each requested (layer_id, key): the last one whose first key is not above it.

    Requests and blocks are sorted together, and each request takes the last block before it: an as-of
    join with one shuffle. A layer with a large part of all requests is spread over ``salts`` tasks, each
    with a copy of the layer's blocks, which are few beside its entries. Requests below the first
    block, or of a layer without blocks, get nulls; repeated requests are answered each.
    """
    marks = index.select("layer_id", F.col("first_key").alias("at"), F.struct("block", "first_key").alias("b"), F.lit(0).alias("ask"), F.explode(F.sequence(F.lit(0), F.lit(salts - 1))).alias("salt"))
    asks = requests.select("layer_id", F.col("key").alias("at"), F.lit(None).cast(marks.schema["b"].dataType).alias("b"), F.lit(1).alias("ask"), F.pmod(F.xxhash64("key"), F.lit(salts)).cast("int").alias("salt"))
    order = Window.partitionBy("layer_id", "salt").orderBy("at", "ask").rowsBetween(Window.unboundedPreceding, 0)
    found = marks.unionByName(asks).withColumn("b", F.last("b", ignorenulls=True).over(order)).where("ask = 1")
    return found.select("layer_id", F.col("at").alias("key"), F.col("b.block").alias("block"), F.col("b.first_key").alias("first_key"))
