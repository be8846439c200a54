"""Spark data sources for the store's own files: ``kvwal`` (log segments) and ``kvsst`` (sorted tables).

One input partition per file, streamed. ``kvwal`` reads a folder of segments; only the last may have a
torn tail (``mode=FAILFAST``, the default), or any (``mode=PERMISSIVE``). Files are never changed. Folders
may lie on any file system pyarrow can reach; what tasks write is looked for by the commit, which fails if the
folder is not one that all machines share.
"""

from __future__ import annotations

import uuid
from collections import defaultdict
from collections.abc import Iterator
from itertools import groupby

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, DataSourceWriter, EqualTo, In, InputPartition, WriterCommitMessage

from tidelog.functions import hashing
from tidelog.schema import DEL, Corruption, InvalidArgument
from tidelog.session import partitions, ship, written
from tidelog.sources import codec, files


class LogSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "kvwal"

    def schema(self) -> str:
        return "segment_id int, seq_no long, op tinyint, key binary, value binary"

    def reader(self, schema) -> DataSourceReader:
        return LogReader(self.options)

    def writer(self, schema, overwrite: bool) -> DataSourceWriter:
        return LogWriter(self.options)


class LogReader(DataSourceReader):
    def __init__(self, options: dict) -> None:
        self.folder, self.lenient = options["path"], options.get("mode", "FAILFAST").upper() == "PERMISSIVE"

    def partitions(self) -> list[InputPartition]:
        ids = codec.segment_ids(self.folder)
        return [InputPartition((i, self.lenient or i == ids[-1])) for i in ids]

    def read(self, partition: InputPartition):
        number, torn = partition.value
        for op, seq, key, value in codec.stream_segment(codec.segment_path(self.folder, number), torn):
            yield number, seq, op, key, value


class PartWriter(DataSourceWriter):
    """Tasks write into folders of their own; the commit moves their files to their places."""

    def __init__(self, options: dict) -> None:
        self.folder, self.options = options["path"].rstrip("/"), dict(options)

    def write(self, rows) -> WriterCommitMessage:
        part = f"{self.folder}/_tmp-{uuid.uuid4().hex}"
        files.make_folder(part)
        message = WriterCommitMessage()
        message.part, message.made, message.order = part, *self.write_part(part, rows)
        return message

    def moves(self, messages: list) -> list[tuple[str, str]]:
        raise NotImplementedError

    def commit(self, messages) -> None:
        messages = [m for m in messages if m is not None]
        for m in messages:
            if lost := set(m.made) - files.names(m.part).keys():
                raise Corruption(f"{sorted(lost)} written to {m.part} cannot be seen from here: is the folder shared?")
        for source, target in self.moves(sorted(messages, key=lambda m: m.order)):
            files.move(source, target)
        self.abort(messages)

    def abort(self, messages) -> None:
        for m in (m for m in messages if m is not None):
            files.remove_folder(m.part)


class LogWriter(PartWriter):
    """Segments get the next free numbers, tasks in the order of their first sequence numbers."""

    def write_part(self, part: str, rows) -> tuple[list[str], int]:
        first = -1

        def records() -> Iterator[tuple]:
            nonlocal first
            for r in rows:
                first = r["seq_no"] if first < 0 else min(first, r["seq_no"])
                yield r["op"], r["seq_no"], bytes(r["key"] or b""), None if r["op"] == DEL and not r["value"] else bytes(r["value"] or b"")

        made = codec.write_segments(part, records(), int(self.options.get("rollbytes", self.options.get("rollBytes", 64 << 20))))
        return [f"{i:06d}.wal" for i in made], first

    def moves(self, messages: list) -> list[tuple[str, str]]:
        number = max(codec.segment_ids(self.folder), default=0)
        own = [f"{m.part}/{name}" for m in messages for name in m.made]
        return [(source, codec.segment_path(self.folder, number + i + 1)) for i, source in enumerate(own)]


class TableSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "kvsst"

    def schema(self) -> str:
        return "layer_id long, key binary, value binary, seq_no long, tombstone boolean"

    def reader(self, schema) -> DataSourceReader:
        return TableReader(self.options)

    def writer(self, schema, overwrite: bool) -> DataSourceWriter:
        return TableWriter(self.options)


def table_path(folder: str, number: int) -> str:
    return f"{folder.rstrip('/')}/{number:06d}.sst"


def table_ids(folder: str) -> list[int]:
    """The numbers of the tables in ``folder``, ascending."""
    stems = [n.removesuffix(".sst") for n in files.names(folder) if n.endswith(".sst")]
    return sorted(int(s) for s in stems if s.isascii() and s.isdigit())


class TableReader(DataSourceReader):
    """Equality and IN on the key reach the reader, which then looks the keys up; other filters are left to Spark."""

    def __init__(self, options: dict) -> None:
        self.folder, self.keys = options["path"], None

    def pushFilters(self, filters):
        for f in filters:
            if isinstance(f, EqualTo) and f.attribute == ("key",):
                self.keys = [bytes(f.value)]
            elif isinstance(f, In) and f.attribute == ("key",):
                self.keys = sorted({bytes(v) for v in f.value if v is not None})
            yield f

    def partitions(self) -> list[InputPartition]:
        return [InputPartition(i) for i in table_ids(self.folder)]

    def read(self, partition: InputPartition):
        table = codec.TableFile(table_path(self.folder, partition.value))
        found = table.scan() if self.keys is None else (e for e in map(table.get, self.keys) if e is not None)
        for key, value, seq, tombstone in found:
            yield partition.value, key, value, seq, tombstone
        table.close()


class TableWriter(PartWriter, DataSourceArrowWriter):
    """One table per layer_id. A layer's rows must come together in one task, as write_tables sees to it.

    Rows come as Arrow batches, which are encoded by columns; a layer's encoded records are held until it ends.
    """

    def write_part(self, part: str, batches: Iterator[pa.RecordBatch]) -> tuple[list[str], int]:
        made = []
        for layer, runs in groupby((r for batch in batches for r in _encoded(batch)), key=lambda r: r[0]):
            name = table_path("", layer).lstrip("/")
            if name in made:
                raise Corruption(f"rows of layer {layer} are not together")
            runs = list(runs)
            parts, path = [records for _, records, _ in runs], f"{part}/{name}"
            size = int(self.options.get("blocksize", 8192)), float(self.options.get("fprate", 0.01))
            keys = [k for _, _, k in runs]
            if all(pc.all(pc.less_equal(k[:-1], k[1:])).as_py() is not False for k in keys) and all(a[-1].as_py() <= b[0].as_py() for a, b in zip(keys, keys[1:])):
                codec.write_records(path, parts, *size)
            else:
                rows = (r for data, _, _ in parts for r in codec.decode(data.tobytes()))
                codec.write_table(path, [(key, value, seq, bool(first)) for first, seq, key, value in rows], *size)
            made.append(name)
        return made, 0

    def moves(self, messages: list) -> list[tuple[str, str]]:
        own = [(f"{m.part}/{name}", f"{self.folder}/{name}") for m in messages for name in m.made]
        if len({t for _, t in own}) < len(own) or any(t.rsplit("/", 1)[1] in files.names(self.folder) for _, t in own):
            raise Corruption("a layer was written twice")
        return own


def _encoded(batch: pa.RecordBatch) -> Iterator[tuple[int, tuple[np.ndarray, np.ndarray, np.ndarray], pa.Array]]:
    """(layer, its records as of ``codec.encode_columns``, their keys) of each run of rows of one layer."""
    kinds = {"layer_id": pa.int64(), "seq_no": pa.int64(), "key": pa.large_binary(), "value": pa.large_binary(), "tombstone": pa.bool_()}
    layer, seq, key, value, tombstone = (batch.column(c).cast(kind) for c, kind in kinds.items())
    if layer.null_count or seq.null_count or pc.any(pc.less(seq, 0)).as_py():
        raise InvalidArgument("an entry without a layer or with no valid seq_no")
    tombstone = tombstone.fill_null(False)
    layer = layer.to_numpy()
    data, start, lengths = codec.encode_columns(tombstone.to_numpy(zero_copy_only=False).astype(np.uint8), seq.to_numpy(), key, pc.if_else(tombstone, None, value))
    bounds = [0, *(np.flatnonzero(np.diff(layer)) + 1).tolist(), len(layer)]
    for a, b in zip(bounds, bounds[1:]):
        if a < b:
            own = data[start[a] : start[b - 1] + lengths[b - 1]]
            yield int(layer[a]), (own, start[a:b] - start[a], lengths[a:b]), key[a:b]


def write_tables(entries: DataFrame, folder: str, block_size: int = 8192, fp_rate: float = 0.01) -> None:
    """Write (layer_id, key, value, seq_no, tombstone) as one table file per layer; a layer is bounded by the memtable limit."""
    register(entries.sparkSession)
    together = entries.select("layer_id", "key", "value", "seq_no", "tombstone").repartition("layer_id").sortWithinPartitions("layer_id", "key")
    together.write.format("kvsst").mode("append").option("path", folder).option("blockSize", block_size).option("fpRate", fp_rate).save()


#: Tables that a task of point_reads looks through, if there are so many that they must be shared out, and the keys it holds at a time.
SPAN, HELD = 64, 1 << 18


def point_reads(requests: DataFrame, folder: str) -> DataFrame:
    """(key, layer_id, value, seq_no, tombstone, bloom_checks, bloom_skips, block_reads) of looking every ``key`` up.

    A lookup asks the tables that ``folder`` holds now from the newest on and stops at the first that holds the
    key, tombstones included; keys that none holds have a null layer_id. Null keys are in no table. Each
    distinct key is looked up once. A task takes a span of tables and a part of the keys, opens a table once for up to
    HELD keys, asks its filter for all of them together and reads a block once for all that pass; the counters are those of
    lookups one by one. Spans are looked through at the same time: a key found in one is looked for in older spans in
    vain, and what that counted is left out.
    """
    return _repeated(_each_looked_up(_asked(requests), folder), "bloom_checks", (F.col("bloom_checks") - F.col("block_reads")).alias("bloom_skips"), "block_reads")


def answers(requests: DataFrame, folder: str) -> DataFrame:
    """(key, layer_id, value, seq_no, tombstone): what ``point_reads`` finds, without its counters.

    A filter of k hashes lets one absent key in 2^k pass. Once the distinct keys are so many that this alone would have every block of
    a table (the median of them) read, each table is read once, whole, and its entries are joined with the keys: that work grows with
    the tables and the keys, that of lookups with their product. Fewer keys are looked up. The distinct keys are written aside, to be counted.
    """
    spark = register(requests.sparkSession)
    asked, sizes = written(_asked(requests), "asked"), files.names(folder)
    newest = table_ids(folder)[::-1]
    bytes_of = [sizes[table_path("", i).lstrip("/")] for i in newest]
    if not newest or asked.count() < _keys_that_read_all(table_path(folder, newest[bytes_of.index(sorted(bytes_of)[len(newest) // 2])])):
        return _repeated(_each_looked_up(asked, folder))
    upto = np.cumsum(bytes_of)
    spans = min(len(newest), max(partitions(spark), int(-(-upto[-1] // SCANNED))))
    ends = np.searchsorted(upto, upto[-1] * np.arange(spans + 1) // spans, side="right").tolist()
    of_span = [newest[a:b] for a, b in zip(ends, ends[1:])]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for span in batch.column(0).to_pylist():
                yield from _newest_entries(folder, of_span[span])

    found = spark.range(0, spans, 1, spans).mapInArrow(run, ENTRIES)
    if spans > 1:
        found = found.withColumn("nth", F.row_number().over(Window.partitionBy("key").orderBy(F.desc("layer_id")))).where("nth = 1").drop("nth")
    return _repeated(asked.join(found.hint("merge"), "key", "left"))


#: Bytes of tables that a task of answers reads, of which it holds the keys, and checks of a filter that take as long as reading an entry.
SCANNED, CHECKS = 32 << 20, 100
ENTRIES = "key binary, layer_id long, value binary, seq_no long, tombstone boolean"


def _keys_that_read_all(path: str) -> int:
    """From so many keys on, those that pass a table's filter by chance are as many as its blocks, or the checks take as long as reading the table."""
    t = codec.TableFile(path)
    t.close()
    return min(len(t.index) << t.k, CHECKS * (t.data_end // codec.RECORD.size))


def _newest_entries(folder: str, tables: list[int]) -> Iterator[pa.RecordBatch]:
    """The rows ENTRIES of every key in ``tables``, each from the first of them that holds it."""
    seen: set[bytes] = set()
    for number in tables:
        t = codec.TableFile(table_path(folder, number))
        try:
            for data, start, head in t.columns():
                at = start + codec.RECORD.size
                keys, new = [data[a:b] for a, b in zip(at.tolist(), (at + head["key"]).tolist())], []
                for i, key in enumerate(keys):
                    if key not in seen:
                        seen.add(key)
                        new.append(i)
                if new:
                    own, tombstone = head[new], (head["first"][new] & 1).astype(bool)
                    value = at[new] + own["key"]
                    values = [None if dead else data[a:b] for a, b, dead in zip(value.tolist(), (value + own["value"]).tolist(), tombstone.tolist())]
                    cols = [pa.array([keys[i] for i in new], pa.binary()), pa.array(np.full(len(new), number)), pa.array(values, pa.binary()), pa.array(own["seq"].astype(np.int64)), pa.array(tombstone)]
                    yield pa.RecordBatch.from_arrays(cols, names=[c.split()[0] for c in ENTRIES.split(", ")])
        finally:
            t.close()


def _asked(requests: DataFrame) -> DataFrame:
    """(key, n): the distinct keys with their numbers of requests."""
    return requests.select(F.col("key").cast("binary").alias("key")).groupBy("key").agg(F.count(F.lit(1)).alias("n"))


def _repeated(met: DataFrame, *counters) -> DataFrame:
    """As many rows of each key as its ``n`` requests, by arrays of bounded length."""
    each = met.withColumn("lot", F.explode(F.sequence(F.lit(0), F.floor((F.col("n") - 1) / 1024)))).withColumn("copy", F.explode(F.sequence(F.lit(1), F.least(F.col("n") - F.col("lot") * 1024, F.lit(1024)))))
    return each.select("key", "layer_id", "value", "seq_no", "tombstone", *counters)


def _each_looked_up(asked: DataFrame, folder: str) -> DataFrame:
    """The rows LOOKED_UP of (key, n), one a key."""
    spark = register(asked.sparkSession)
    newest, tasks = table_ids(folder)[::-1], partitions(spark)
    spans = max(1, min(tasks, len(newest) // SPAN))
    parts = -(-tasks // spans)
    of_span = [newest[len(newest) * i // spans : len(newest) * (i + 1) // spans] for i in range(spans)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = defaultdict(list)
        for batch in batches:
            for span, key, n in zip(*(c.to_pylist() for c in batch.columns)):
                held[span].append((key, n))
            for span in [s for s, own in held.items() if len(own) >= HELD]:
                yield from _looked_up(folder, of_span[span], span, held.pop(span))
        for span, own in held.items():
            yield from _looked_up(folder, of_span[span], span, own)

    spread = asked.select(F.explode(F.sequence(F.lit(0), F.lit(spans - 1))).alias("span"), "key", "n")
    part = F.when(F.col("key").isNull(), parts - 1).otherwise(F.pmod(F.xxhash64("key"), F.lit(parts)).cast("int"))
    met = spread.repartitionById(spans * parts, F.col("span") * parts + part).mapInArrow(run, LOOKED_UP)
    if spans > 1:
        so_far = Window.partitionBy("key").orderBy("span").rowsBetween(Window.unboundedPreceding, 0)
        hits = F.sum(F.col("layer_id").isNotNull().cast("int")).over(so_far)
        met = met.withColumns({"hits": hits, "bloom_checks": F.sum("bloom_checks").over(so_far), "block_reads": F.sum("block_reads").over(so_far)})
        met = met.where(F.when(F.col("layer_id").isNull(), (F.col("hits") == 0) & (F.col("span") == spans - 1)).otherwise(F.col("hits") == 1))
    return met


LOOKED_UP = "key binary, n long, span int, layer_id long, value binary, seq_no long, tombstone boolean, bloom_checks long, block_reads long"


def _looked_up(folder: str, tables: list[int], span: int, asked: list[tuple[bytes | None, int]]) -> Iterator[pa.RecordBatch]:
    """The rows LOOKED_UP of distinct keys with their numbers of requests; those found in a table come once it is read."""
    kinds = (pa.binary(), pa.int64(), pa.int32(), pa.int64(), pa.binary(), pa.int64(), pa.bool_(), pa.int64(), pa.int64())
    names = [c.split()[0] for c in LOOKED_UP.split(", ")]

    def batch(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names=names)

    nulls, asked = [a for a in asked if a[0] is None], sorted(a for a in asked if a[0] is not None)
    left, reads = np.arange(len(asked)), np.zeros(len(asked), np.int64)
    keys = np.empty(len(asked), object)
    keys[:] = [key for key, _ in asked]
    h1, h2 = hashing.bloom_hashes(keys.tolist())
    for checks, number in enumerate(tables, 1):
        if not len(left):
            break
        t = codec.TableFile(table_path(folder, number))
        try:
            passing = t.passing(h1, h2)
            reads[left[passing]] += 1
            place = dict(zip(keys[left[passing]].tolist(), passing.tolist()))
            found = t.find(place)
        finally:
            t.close()
        if found:
            hit = [place[key] for key in found]
            yield batch([(*asked[i], span, number, *found[asked[i][0]][1:], checks, int(reads[i])) for i in left[hit].tolist()])
            kept = np.ones(len(left), bool)
            kept[hit] = False
            left, h1, h2 = left[kept], h1[kept], h2[kept]
    if len(left):
        none, ns = [pa.nulls(len(left), k) for k in kinds[3:7]], np.fromiter((n for _, n in asked), np.int64, len(asked))
        same = (pa.array(np.full(len(left), v), k) for v, k in ((span, pa.int32()), (len(tables), pa.int64())))
        yield pa.RecordBatch.from_arrays([pa.array(keys[left].tolist(), pa.binary()), pa.array(ns[left]), next(same), *none, next(same), pa.array(reads[left])], names=names)
    if nulls:
        yield batch([(*a, span, None, None, None, None, 0, 0) for a in nulls])


def register(spark: SparkSession) -> SparkSession:
    """Make both sources known to the session, and let filters reach their readers."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    for source in (LogSource, TableSource):
        ship(spark).dataSource.register(source)
    return spark
