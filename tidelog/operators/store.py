"""A single-node store on Parquet: log, layers and manifest, with flush, merge and recovery.

Reads see the layers of the newest published manifest and the log written since. All state changes
are one publication; files of unfinished work are never read and can be removed by ``vacuum``.

The log is the active table's until its entries reach the memtable limit; then it is frozen as an
immutable table, and later flushed to a layer. Of the configuration, ``wal_fsync_every_n`` has nothing
to say here: a batch is durable when it is published, or not there.
"""

from __future__ import annotations

import time
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidelog.operators import layers, manifest, snapshot
from tidelog.schema import DEL, MUTATION, InvalidArgument, StorageConfig, StoreClosed, TooManyImmutables, WriteStall
from tidelog.sources import datasource, publish

COUNTERS = ("puts", "deletes", "gets", "range_skips", "table_reads", "flushes", "compactions", "last_flush_ms", "last_compact_ms")
EMPTY = {"epoch": 0, "tables": [], "log": [], "log_bytes": 0, "immutables": [], "last_seq_no": 0}


class Store:
    def __init__(self, spark: SparkSession, path: str, config: StorageConfig = StorageConfig()):
        self.spark, self.path, self.config, self.closed = spark, path, config, False
        self.counters = dict.fromkeys(COUNTERS, 0)
        self.last_error: str | None = None
        v = publish.latest_version(spark, f"{path}/versions")
        self.version = v
        self.doc = EMPTY | (publish.load(spark, f"{path}/versions", v) if v else {})

    def _publish(self, **change) -> None:
        doc = self.doc | change
        publish.publish(self.spark, f"{self.path}/versions", self.version + 1, doc)
        self.version, self.doc = self.version + 1, doc

    def _open(self) -> None:
        if self.closed:
            raise StoreClosed("the store is closed")

    def write(self, mutations: DataFrame) -> None:
        """Append (op, key, value, ord) rows; they get the next sequence numbers in the order of ``ord``.

        The batch is rejected as a whole if a row is invalid or too many tables are live. If the table it
        fills cannot be frozen, because too many frozen ones wait to be flushed, TooManyImmutables
        is raised although the batch is in the log and stays there.
        """
        self._open()
        if manifest.stalled(len(self.doc["tables"]), self.config.l0_stop_writes):
            raise WriteStall(f"{len(self.doc['tables'])} live tables")
        base = self.doc["last_seq_no"]
        rows = snapshot.numbered(mutations.select("ord", "op", "key", "value"), base)
        empty = (F.col("op") == DEL) & (F.length("value") == 0)
        rows = rows.select("seq_no", F.col("op").cast("tinyint").alias("op"), "key", F.when(~F.coalesce(empty, F.lit(False)), F.col("value")).alias("value"))
        folder = f"{self.path}/log-{uuid.uuid4().hex}"
        rows.write.parquet(folder)
        kept = self.spark.read.schema(MUTATION).parquet(folder)
        size = F.length("key") + F.coalesce(F.length("value"), F.lit(0))
        n, bad, deletes, added = kept.agg(F.count(F.lit(1)), F.count(snapshot.invalid_reason()), F.count(F.when(F.col("op") == DEL, 1)), F.coalesce(F.sum(size), F.lit(0))).first()
        if bad:
            publish.remove(self.spark, folder)
            raise InvalidArgument(f"{bad} invalid mutations")
        self._publish(log=[*self.doc["log"], folder], last_seq_no=base + n, log_bytes=self.doc["log_bytes"] + added)
        self.counters["puts"] += n - deletes
        self.counters["deletes"] += deletes
        if self._is_full():
            if len(self.doc["immutables"]) >= self.config.max_immutable_tables:
                raise TooManyImmutables(f"{len(self.doc['immutables'])} frozen tables wait to be flushed")
            self.rotate()

    def _is_full(self) -> bool:
        """Whether the active entries have reached the limit; overwrites are folded only once the bytes written have."""
        limit = self.config.memtable_max_bytes
        return self.doc["log_bytes"] >= limit and snapshot.memory_size(self._rows(self.doc["log"])).first().bytes >= limit

    def rotate(self) -> None:
        """Freeze the active table, if it has entries."""
        if self.doc["log"]:
            self._publish(log=[], log_bytes=0, immutables=[self.doc["log"], *self.doc["immutables"]])

    def _rows(self, folders: list[str]) -> DataFrame:
        return self.spark.read.schema(MUTATION).parquet(*folders) if folders else self.spark.createDataFrame([], MUTATION)

    def _logged(self) -> list[str]:
        """The folders of the log that is in no layer yet."""
        return [*self.doc["log"], *(f for table in self.doc["immutables"] for f in table)]

    def entries(self) -> DataFrame:
        """The folded state, tombstones included."""
        self._open()
        return self._folded([t["path"] for t in self.doc["tables"]])

    def _folded(self, paths: list[str]) -> DataFrame:
        return snapshot.latest(self._rows([*self._logged(), *paths]))

    def scan(self) -> DataFrame:
        """Live (key, value, seq_no)."""
        return self.entries().where(F.col("op") != DEL).select("key", "value", "seq_no")

    def get(self, key: bytes) -> DataFrame:
        """The live row of ``key`` or none; only layers whose key range holds it are read, and within them what filters let pass."""
        self._open()
        inside = [t["path"] for t in self.doc["tables"] if t["min_key"] <= key.hex() <= t["max_key"]]
        self.counters["gets"] += 1
        self.counters["table_reads"] += len(inside)
        self.counters["range_skips"] += len(self.doc["tables"]) - len(inside)
        return snapshot.get(self._rows([*self._logged(), *inside]), key).select("key", "value", "seq_no")

    def multi_get(self, requests: DataFrame) -> DataFrame:
        return snapshot.multi_get(requests, self.entries())

    def flush(self) -> int:
        """Freeze the active table and flush every frozen one; the number of layers made."""
        self._open()
        self.rotate()
        return self.drain()

    def drain(self, before_publish: Callable[[], None] = lambda: None) -> int:
        """Flush the frozen tables, oldest first, each to a layer; its log goes with the same publication."""
        made = 0
        while self.doc["immutables"]:
            began = time.time()
            *rest, oldest = self.doc["immutables"]
            self._add_layer(snapshot.latest(self._rows(oldest)), [], before_publish, immutables=rest)
            for folder in oldest:
                publish.remove(self.spark, folder)
            self.counters["flushes"] += 1
            self.counters["last_flush_ms"] = int((time.time() - began) * 1000)
            made += 1
        return made

    def _add_layer(self, rows: DataFrame, inputs: list[int], before_publish: Callable[[], None] = lambda: None, **change) -> None:
        number = max((t["id"] for t in self.doc["tables"]), default=0) + 1
        path = f"{self.path}/layer-{number:06d}-{uuid.uuid4().hex}"
        layers.write_layer(rows, path, self.config.parquet_codec, self.config.block_size, self.config.bloom_false_positive)
        kept = self.spark.read.schema(MUTATION).parquet(path).withColumn("layer_id", F.lit(number).cast("long"))
        d = layers.describe(kept).withColumns({c: F.lower(F.hex(c)) for c in ("min_key", "max_key")}).first()
        before_publish()
        table = {"id": number, "file": f"{number:06d}.sst", "path": path, "min_key": d.min_key, "max_key": d.max_key, "min_seq_no": d.min_seq_no, "max_seq_no": d.max_seq_no, "file_size": d.data_bytes}
        self._publish(epoch=self.doc["epoch"] + 1, tables=[table, *[t for t in self.doc["tables"] if t["id"] not in inputs]], **change)

    def compact(self, before_publish: Callable[[], None] = lambda: None) -> list[int]:
        """One size-tiered merge; the ids of the merged layers, newest first."""
        self._open()
        sizes = {t["id"]: t["file_size"] for t in self.doc["tables"]}
        inputs = manifest.pick_local(sizes, self.config.size_tiered_fan_in, self.config.size_tiered_size_ratio)
        if not inputs:
            return []
        began = time.time()
        paths = [t["path"] for t in self.doc["tables"] if t["id"] in inputs]
        merged = snapshot.latest(self._rows(paths))
        self._add_layer(merged, inputs, before_publish)
        for p in paths:
            publish.remove(self.spark, p)
        self.counters["compactions"] += 1
        self.counters["last_compact_ms"] = int((time.time() - began) * 1000)
        return inputs

    def due(self) -> list[str]:
        """The background work the configuration asks for now; frozen tables are flushed before anything is merged."""
        waiting = len(self.doc["immutables"])
        return ["flush"] * waiting or ["compact"] * manifest.wants_compaction(len(self.doc["tables"]), self.config.l0_compaction_trigger, waiting)

    def background(self) -> list[str]:
        """Do what is due, as after a micro-batch; an error is kept for the status and does not stop the store."""
        done = []
        while (jobs := self.due()) and (not done or done[-1] != jobs[0]):
            try:
                self.drain() if jobs[0] == "flush" else self.compact()
            except Exception as e:
                self.last_error = f"{jobs[0]}: {e}"
                break
            done += jobs[:1]
        return done

    def background_status(self) -> dict:
        c, jobs = self.counters, self.due()
        return {
            "flush_queue_len": jobs.count("flush"), "compact_queue_len": jobs.count("compact"), "flush_jobs_total": c["flushes"], "compact_jobs_total": c["compactions"], "last_flush_ms": c["last_flush_ms"],
            "last_compact_ms": c["last_compact_ms"], "compaction_trigger": self.config.l0_compaction_trigger, "last_error": self.last_error or "none",
        }

    def vacuum(self) -> int:
        """Remove layer and log folders no manifest names; the number removed."""
        named = {x.rsplit("/", 1)[-1] for x in (*self._logged(), *(t["path"] for t in self.doc["tables"]))}
        return publish.remove_unnamed(self.spark, self.path, ("layer-", "log-"), named)

    def export(self, folder: str) -> None:
        """Write the store in its file formats: layers as sorted tables, what is only logged as segments."""
        self._open()
        held = [self._rows([t["path"]]).withColumn("layer_id", F.lit(t["id"]).cast("long")) for t in self.doc["tables"]]
        for rows in held:
            datasource.write_tables(layers.entries(rows), folder, self.config.block_size, self.config.bloom_false_positive)
        if logged := self._logged():
            rows = self._rows(logged).repartitionByRange("seq_no").sortWithinPartitions("seq_no")
            datasource.register(self.spark)
            rows.write.format("kvwal").mode("append").option("path", folder).option("rollBytes", self.config.wal_segment_roll_bytes).save()

    def stats(self) -> dict:
        active = snapshot.memory_size(self._rows(self.doc["log"])).first() if not self.closed and self.doc["log"] else None
        return {
            "engine_status": "closed" if self.closed else f"degraded: {self.last_error}" if self.last_error else "open", "last_seq_no": self.doc["last_seq_no"], "active_entries": active.entries if active else 0, "active_bytes": active.bytes if active else 0,
            "immutables": len(self.doc["immutables"]), "sst_count": len(self.doc["tables"]), "sst_total_bytes": sum(t["file_size"] for t in self.doc["tables"]), "epoch": self.doc["epoch"], **self.counters,
        }

    def close(self, fast: bool = False) -> None:
        """Close after doing the background work that is due, or at once. Either way nothing is lost:
        what is not flushed stays in the log and is read again on opening. Closing again does nothing.
        """
        if not self.closed and not fast:
            self.background()
        self.closed = True
