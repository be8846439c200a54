"""Far too many small files: packing the layers of committed runs into indexed archive containers (problem 5).

The entries of a layer are encoded to the layer's bytes; many layers' bytes are laid end to end in
containers of a target size, and an index row per layer part gives container, offset, length and a
checksum, so that any layer can be cut out again byte for byte, and containers are read in
parallel. Everything runs on the JVM side; Python decodes only what is looked up.

A layer larger than a fraction of a container is split into parts by key hash, before its rows are
brought together, so no task ever holds more than about one container, whatever a layer's size.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidelog.session import new_path, ship, written

TARGET_BYTES = 32 << 20
#: A larger layer is split into parts of this fraction of a container, so that containers fill evenly.
PARTS_PER_CONTAINER = 8
#: Containers in one file: readers hold a file's cells of many rows at once.
CONTAINERS_PER_FILE = 8
#: Large layers are broadcast up to so many, and joined by salted keys beyond.
MOST_BROADCAST, SALTS = 1 << 18, 32
#: Bits of the flag byte of an encoded entry.
TOMBSTONE, NO_TOMBSTONE, NO_SEQ, NO_VALUE, NO_KEY = 1, 2, 4, 8, 16
HEAD = struct.Struct(">BqII")


def _be(c: Column, width: int) -> Column:
    return F.unhex(F.lpad(F.hex(c), 2 * width, "0")) if width == 8 else F.unhex(F.right(F.lpad(F.hex(c), 16, "0"), F.lit(2 * width)))


def entry() -> Column:
    """What an entry is encoded from: (key, head, value), nulls as empty; ``head`` is flags 1, seq_no 8, key length 4, value length 4 (big-endian)."""
    bit = lambda cond, b: F.when(cond, F.lit(b)).otherwise(F.lit(0))
    flags = (
        bit(F.coalesce("tombstone", F.lit(False)), TOMBSTONE) + bit(F.col("tombstone").isNull(), NO_TOMBSTONE) + bit(F.col("seq_no").isNull(), NO_SEQ)
        + bit(F.col("value").isNull(), NO_VALUE) + bit(F.col("key").isNull(), NO_KEY)
    )
    key, value = F.coalesce("key", F.lit(b"")), F.coalesce("value", F.lit(b""))
    head = F.concat(_be(flags.cast("long"), 1), _be(F.coalesce("seq_no", F.lit(0)), 8), _be(F.length(key).cast("long"), 4), _be(F.length(value).cast("long"), 4))
    return F.struct(key.alias("key"), head.alias("head"), value.alias("value"))


def encoded(entries: str) -> Column:
    """The bytes of an array of entries, in linear time: head, key and value of each."""
    return F.unhex(F.array_join(F.transform(entries, lambda e: F.hex(F.concat(e["head"], e["key"], e["value"]))), ""))


def decode_entries(data: bytes) -> Iterator[tuple]:
    """(key, value, seq_no, tombstone) of each entry in ``data``."""
    at = 0
    while at < len(data):
        flags, seq, k, v = HEAD.unpack_from(data, at)
        at += HEAD.size
        key, value = data[at : at + k], data[at + k : at + k + v]
        at += k + v
        yield (None if flags & NO_KEY else key, None if flags & NO_VALUE else value, None if flags & NO_SEQ else seq, None if flags & NO_TOMBSTONE else bool(flags & TOMBSTONE))


def right_tables(manifest: DataFrame, runs: DataFrame) -> DataFrame:
    """(id, node_id, run_id, file, file_size, epoch) of committed runs: per id the row of the highest epoch.

    Rows with a null id are dropped; a null epoch is lower than any; among unequal rows of the same
    epoch (clean data has none) the greatest size counts.
    """
    good = runs.where(F.col("status") == "committed").select("run_id").distinct()
    rows = manifest.where("id is not null").join(good, "run_id", "left_semi")
    best = rows.groupBy("id").agg(F.max(F.struct("epoch", "file_size", "file", "node_id", "run_id")).alias("t"))
    return best.select("id", "t.node_id", "t.run_id", "t.file", "t.file_size", "t.epoch")


@dataclass(frozen=True)
class Archive:
    """Paths of the containers and of the index."""

    spark: SparkSession
    path: str

    @property
    def containers(self) -> DataFrame:
        """(container, payload, members); ``members`` lists what lies in the payload, in its order."""
        return self.spark.read.parquet(f"{self.path}/containers")

    @property
    def index(self) -> DataFrame:
        """(id, file, file_size, part, container, offset, length, crc, entries); layers without entries have length 0 and no container."""
        return self.spark.read.parquet(f"{self.path}/index")


def layer_bytes(entries: DataFrame) -> DataFrame:
    """(layer_id, bytes) of the encoded rows, repeats included; lengths are summed before the shuffle."""
    size = HEAD.size + F.coalesce(F.length("key"), F.lit(0)) + F.coalesce(F.length("value"), F.lit(0))
    return entries.where("layer_id is not null").groupBy("layer_id").agg(F.sum(size.cast("long")).alias("bytes"))


def pack(entries: DataFrame, tables: DataFrame, path: str, target: int = TARGET_BYTES, most_broadcast: int = MOST_BROADCAST) -> Archive:
    """Pack the entries of ``tables`` (see right_tables) into containers of about ``target`` bytes.

    Exactly repeated entries are stored once; entries of layers not in ``tables`` are left out;
    empty inputs give an archive without containers. Nulls in any column come back as nulls.

    A row's part follows from its key's hash, and its container from (layer, part), so the rows are
    shuffled once to their part, where they are encoded, and the parts once to their container. Only
    the parts of the large layers must be looked up: one narrow row for each of them.
    """
    spark = entries.sparkSession
    sizes = layer_bytes(entries)
    large = written(sizes.select("layer_id", F.ceil(F.col("bytes") * PARTS_PER_CONTAINER / target).cast("long").alias("parts"), "bytes"), "parts")
    total = large.agg(F.coalesce(F.sum("bytes"), F.lit(0))).first()[0]
    large = large.where("parts > 1").select("layer_id", "parts")
    many, shards = large.count(), max(1, -(-total // target))

    own = entries.where("layer_id is not null").select("layer_id", "key", "value", "seq_no", "tombstone")
    own = own.withColumn("salt", F.pmod(F.xxhash64("key"), F.lit(SALTS)).cast("int"))
    if many <= most_broadcast:
        parted = own.join(F.broadcast(large), "layer_id", "left")  # at most ``most_broadcast`` rows of two numbers
    else:
        salted = large.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        parted = own.join(salted.hint("merge"), ["layer_id", "salt"], "left")
    part = F.when(F.col("parts").isNotNull(), F.pmod(F.xxhash64("key", F.lit(1)), F.col("parts"))).otherwise(F.lit(0)).cast("long")
    parted = parted.select("layer_id", part.alias("part"), entry().alias("e"))
    members = parted.groupBy("layer_id", "part").agg(F.sort_array(F.collect_set("e")).alias("es"))  # repeats drop out in the map tasks
    members = members.select("layer_id", "part", F.size("es").alias("entries"), encoded("es").alias("data"))
    # layers of other runs leave here, where a layer is one row
    members = members.join(tables.select(F.col("id").alias("layer_id")), "layer_id", "left_semi")
    members = members.withColumn("container", F.pmod(F.xxhash64("layer_id", "part"), F.lit(shards)))
    members = members.withColumn("length", F.length("data").cast("long"))
    before = F.sum("length").over(Window.partitionBy("container").orderBy("layer_id", "part")) - F.col("length")  # a container's members meet anyway
    named = F.struct("layer_id", "part", "offset", "length", F.crc32("data").alias("crc"), F.col("entries").cast("long").alias("entries"))
    packed = members.withColumn("offset", before).groupBy("container").agg(
        F.expr("listagg(data, X'') within group (order by layer_id, part)").alias("payload"), F.sort_array(F.collect_list(named)).alias("members")
    )
    packed.write.option("maxRecordsPerFile", CONTAINERS_PER_FILE).parquet(f"{path}/containers")

    archive = Archive(spark, path)
    listed = archive.containers.select("container", F.explode("members").alias("m")).select("container", "m.*")  # the payload is not read
    index = tables.select(F.col("id").alias("layer_id"), "file", "file_size").join(listed, "layer_id", "left")
    none = F.lit(0).cast("long")
    index.select(
        F.col("layer_id").alias("id"), "file", "file_size", F.coalesce("part", none).alias("part"), "container", "offset", F.coalesce("length", none).alias("length"), "crc", F.coalesce("entries", none).alias("entries"),
    ).write.parquet(f"{path}/index")
    return archive


class ChecksumError(ValueError):
    """The bytes cut from a container do not match their index row."""


def unpack(archive: Archive, ids: DataFrame | None = None) -> DataFrame:
    """The entries (layer_id, key, value, seq_no, tombstone) of all layers, or of those in ``ids`` (id).

    Only containers that hold a wanted layer are opened. A checksum that does not match raises.
    """
    ship(archive.spark)
    wanted = archive.index.where("container is not null")
    if ids is not None:
        wanted = wanted.join(ids.select("id").distinct(), "id", "left_semi")
    cuts = wanted.groupBy("container").agg(F.collect_list(F.struct("id", "offset", "length", "crc")).alias("cuts"))

    def decode(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for payload, own in zip(batch["payload"], batch["cuts"]):
                rows = []
                for cut in own:
                    data = payload[cut["offset"] : cut["offset"] + cut["length"]]
                    if zlib.crc32(data) != cut["crc"]:
                        raise ChecksumError(f"layer {cut['id']}")
                    rows += [(cut["id"], *e) for e in decode_entries(data)]
                out = pd.DataFrame(rows, columns=["layer_id", "key", "value", "seq_no", "tombstone"], dtype=object)
                out["seq_no"] = out["seq_no"].astype("Int64")
                yield out

    schema = "layer_id long, key binary, value binary, seq_no long, tombstone boolean"
    return archive.containers.join(cuts, "container").select("payload", "cuts").mapInPandas(decode, schema)


def verified(archive: Archive) -> DataFrame:
    """(id, part, entries) of every member read from the containers, with the checksum of its bytes compared.

    Members are cut from the container's buffer without copying. One whose bytes do not match raises.
    """
    ship(archive.spark)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for payload, members in zip(batch.column(0), batch.column(1)):
                view, rows = memoryview(payload.as_buffer()), members.as_py()
                for m in rows:
                    if zlib.crc32(view[m["offset"] : m["offset"] + m["length"]]) != m["crc"]:
                        raise ChecksumError(f"layer {m['layer_id']}")
                yield pa.RecordBatch.from_arrays([pa.array([m[c] for m in rows], pa.int64()) for c in ("layer_id", "part", "entries")], names=["id", "part", "entries"])

    return archive.containers.select("payload", "members").mapInArrow(run, "id long, part long, entries long")


def small_layers(archive: Archive, limit: int = 16384) -> DataFrame:
    """(id) of the layers that were files of fewer than ``limit`` bytes and have come whole out of the archive.

    The ids are those of the members read back from the containers, all of whose parts and entries
    must be there; layers without entries have no bytes to read and come from the index. Null sizes are not small.
    """
    read = verified(archive).groupBy("id").agg(F.count(F.lit(1)).alias("parts"), F.sum("entries").alias("entries"))
    small = archive.index.where(F.col("file_size") < limit)
    named = small.where("container is not null").groupBy("id").agg(F.count(F.lit(1)).alias("want_parts"), F.sum("entries").alias("want_entries"))
    whole = read.join(named, "id").where("parts = want_parts and entries = want_entries").select("id")
    return whole.unionByName(small.where("container is null").select("id").distinct())


def pack_committed(spark: SparkSession, entries: DataFrame, manifest: DataFrame, runs: DataFrame, target: int = TARGET_BYTES) -> Archive:
    return pack(entries, right_tables(manifest, runs), new_path(spark, "archive"), target)
