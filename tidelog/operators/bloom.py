"""Bloom filters as data: sizing, exact positions, building and probing."""

from __future__ import annotations

import math
import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidelog.functions import hashing
from tidelog.schema import Corruption
from tidelog.session import ship


def bits(n: Column, fp_rate: float) -> Column:
    """m for n entries: -n ln p / ln(2)^2, at least 64, in whole bytes. An empty layer counts as one entry."""
    n = F.greatest(n, F.lit(1))
    m = F.greatest(F.ceil(-n * math.log(fp_rate) / (math.log(2) * math.log(2))), F.lit(64))
    return (F.floor((m + 7) / 8) * 8).cast("long")


def hashes(n: Column, m: Column) -> Column:
    """k for n entries in m bits: m/n ln 2, rounded, at least 1."""
    return F.greatest(F.round(m / F.greatest(n, F.lit(1)) * math.log(2)), F.lit(1)).cast("long")


def parameters(layers: DataFrame, fp_rate: float = 0.01) -> DataFrame:
    """(layer_id, n, m, k) from entries (layer_id, ...)."""
    sized = layers.groupBy("layer_id").agg(F.count(F.lit(1)).alias("n")).withColumn("m", bits(F.col("n"), fp_rate))
    return sized.withColumn("k", hashes(F.col("n"), F.col("m")))


def key_hashes(keys: DataFrame) -> DataFrame:
    """(key, h1, h2) with the two 64-bit hashes as 16 hex digits."""
    ship(keys.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            h1, h2 = hashing.bloom_hashes(batch.column(1).to_pylist())
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array([f"{v:016x}" for v in h.tolist()], pa.string()) for h in (h1, h2))], names=["key", "h1", "h2"])

    kind = keys.schema["key"].dataType.simpleString()
    return keys.select("key", F.col("key").cast("binary").alias("b")).mapInArrow(run, f"key {kind}, h1 string, h2 string")


def positions(rows: DataFrame) -> DataFrame:
    """(layer_id, key, pos) for rows (layer_id, key, m, k): the k positions of each key."""
    ship(rows.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            h1, h2 = hashing.bloom_hashes(batch.column(2).to_pylist())
            m, k = (batch.column(i).to_numpy(zero_copy_only=False) for i in (3, 4))
            row = np.repeat(np.arange(batch.num_rows), k)
            i = np.arange(len(row)) - np.repeat(np.cumsum(k) - k, k)
            with np.errstate(over="ignore"):
                pos = (h1[row] + i.astype(np.uint64) * h2[row]) % m[row].astype(np.uint64)
            take = pa.array(row)
            yield pa.RecordBatch.from_arrays([batch.column(0).take(take), batch.column(1).take(take), pa.array(pos.astype(np.int64))], names=["layer_id", "key", "pos"])

    kind = rows.schema["key"].dataType.simpleString()
    return rows.select("layer_id", "key", F.col("key").cast("binary").alias("b"), "m", "k").mapInArrow(run, f"layer_id long, key {kind}, pos long")


#: Filters are held in blocks of so many bits, 4 KiB.
BLOCK_BITS = 15


def build(entries: DataFrame, fp_rate: float = 0.01) -> DataFrame:
    """The filters of all layers as rows (layer_id, block, bits), a bitmap of 2**BLOCK_BITS bits each.

    Bits are set in the map tasks and ORed after the shuffle, a block at a time: a filter of any size is never one object.
    """
    sized = entries.select("layer_id", "key").join(parameters(entries, fp_rate), "layer_id")
    each = positions(sized).select("layer_id", F.shiftright("pos", BLOCK_BITS).alias("block"), F.col("pos").bitwiseAND((1 << BLOCK_BITS) - 1).alias("bit"))
    return each.groupBy("layer_id", "block").agg(F.bitmap_construct_agg("bit").alias("bits"))


def probe(requests: DataFrame, filters: DataFrame, params: DataFrame) -> DataFrame:
    """(layer_id, key, maybe): whether the layer may hold the key, for requests (layer_id, key)."""
    asked = positions(requests.select("layer_id", "key").distinct().join(params, "layer_id")).withColumn("block", F.shiftright("pos", BLOCK_BITS))
    met = asked.join(filters, ["layer_id", "block"], "left")
    byte = F.conv(F.hex(F.substring("bits", F.shiftright(F.col("pos").bitwiseAND((1 << BLOCK_BITS) - 1), 3).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    is_set = F.coalesce(byte.bitwiseAND(F.expr("shiftleft(1, cast(pos % 8 as int))")) > 0, F.lit(False))
    return met.groupBy("layer_id", "key").agg(F.min(is_set).alias("maybe"))


def marshal(m: int, k: int, blocks: dict[int, bytes]) -> bytes:
    """One filter's bytes: m, k, then the bit array."""
    width = 1 << (BLOCK_BITS - 3)
    out = bytearray(-(-m // (8 * width)) * width)
    for block, bits in blocks.items():
        out[block * width : (block + 1) * width] = bits
    return struct.pack("<QQ", m, k) + bytes(out[: m // 8])


def unmarshal(data: bytes) -> tuple[int, int, bytes]:
    """(m, k, bits); sizes that do not fit together are Corruption."""
    m, k = struct.unpack_from("<QQ", data) if len(data) >= 16 else (0, 0)
    if m == 0 or m % 8 or k == 0 or len(data) - 16 != m // 8:
        raise Corruption("Bloom filter sizes")
    return m, k, data[16:]
