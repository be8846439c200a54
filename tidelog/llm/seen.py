"""Has this key been seen before? A log-structured index of key hashes in sorted runs (problem 2).

Keys are kept in immutable runs of (hash, key). A run is cut into zones, which are ranges of the hash,
and each zone into buckets, and every file is sorted by hash; the least and greatest hash of a zone
are its fence. Zones and buckets grow with the run, so that a file stays at about KEYS_PER_FILE keys:
first buckets, up to MAX_BUCKETS, then zones. New keys form a run of level 0; when a level holds
``fanout`` runs they are merged into one run of the next level.

A batch is decided by its distinct keys. They are held against each run's fences, only the zones they
fall into are opened, and they meet those in a merge join on the hash, for which the run needs no
shuffle; every hit is verified by its full key. Nothing is held in memory but the fences, at most
MAX_ZONES rows a run; joins and merges sort and spill.

A batch's answers are written before its new keys are published, and one document publishes both. A
batch that is given again under its name after a failure gets the answers it got, whether the failure came
before or after that.
"""

from __future__ import annotations

import math
import uuid
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidelog.schema import InvalidArgument
from tidelog.session import new_path
from tidelog.sources import publish

KEYS_PER_FILE, MAX_BUCKETS, MAX_ZONES = 1 << 18, 1024, 1 << 12
KEYS = "key binary, h long, first long, n long, hash_hit boolean, hit boolean"


@dataclass(frozen=True)
class Decisions:
    """``keys``: (key, h, first, n, hash_hit, hit) per distinct key of the batch; ``found``: the ids of records seen before."""

    keys: DataFrame
    found: DataFrame


class SeenKeys:
    """The index under ``path``. ``hash_bits`` below 64 gives shorter hashes and more hits to verify.

    Null and empty keys are never indexed and never found. A record id must be unique in its batch;
    the record with the smallest id of a key new to the index is the one not seen before.
    """

    def __init__(self, spark: SparkSession, path: str, fanout: int = 4, hash_bits: int = 64, keys_per_file: int = KEYS_PER_FILE, max_buckets: int = MAX_BUCKETS):
        if not math.log2(MAX_ZONES) < hash_bits <= 64 or fanout < 2 or keys_per_file < 1 or max_buckets < 1:
            raise InvalidArgument(f"hash_bits {hash_bits}, fanout {fanout}, keys_per_file {keys_per_file}, max_buckets {max_buckets}")
        self.spark, self.path, self.fanout, self.hash_bits = spark, path, fanout, hash_bits
        self.keys_per_file, self.max_buckets = keys_per_file, max_buckets
        self.version = publish.latest_version(spark, f"{path}/versions")
        state = publish.load(spark, f"{path}/versions", self.version) if self.version else {"runs": [], "batches": {}}
        self.runs, self.batches = state["runs"], state["batches"]

    def hash_of(self, key: str) -> Column:
        return F.shiftrightunsigned(F.xxhash64(key), 64 - self.hash_bits) if self.hash_bits < 64 else F.xxhash64(key)

    def zone_of(self, h: str, zones: int) -> Column:
        """The leading bits of the hash: ``zones`` is a power of two. Never a constant, so that joins on it are equi-joins."""
        return F.shiftrightunsigned(F.col(h), self.hash_bits - zones.bit_length() + 1).cast("int") if zones > 1 else F.pmod(F.col(h), F.lit(1)).cast("int")

    def layout(self, n: int) -> tuple[int, int]:
        """(buckets, zones) of a run of ``n`` keys, powers of two."""
        files = 1 << max(0, n - 1).bit_length() >> (self.keys_per_file.bit_length() - 1)
        buckets = min(max(1, files), self.max_buckets)
        return buckets, min(max(1, files // buckets), MAX_ZONES)

    def first_per_key(self, records: DataFrame, key: str, id_: str | None) -> DataFrame:
        """(key, h, first, n): one row per key; partial aggregation keeps a hot key to a row per task."""
        known = records.where(F.col(key).isNotNull() & (F.length(key) > 0))
        first = F.min(id_) if id_ else F.lit(None).cast("long")
        each = known.groupBy(F.col(key).alias("key")).agg(first.alias("first"), F.count(F.lit(1)).alias("n"))
        return each.select("key", self.hash_of("key").alias("h"), "first", "n")

    def add(self, records: DataFrame, key: str = "key", level: int = 0) -> None:
        """Index the keys of ``records`` as one run; a bulk load may go straight to a deep level."""
        keys = f"{self.path}/keys-{uuid.uuid4().hex}"
        self.first_per_key(records, key, None).select("h", "key").write.parquet(keys)
        self._publish([*self.runs, *self._write_run(self.spark.read.parquet(keys), level)], self.batches)
        publish.remove(self.spark, keys)
        self.compact()

    def process(self, records: DataFrame, id_: str = "record_id", key: str = "key", batch: str | None = None, before_publish: Callable[[], None] = lambda: None) -> Decisions:
        """Decide for every record whether its key came earlier, and index the keys that did not.

        Only distinct keys are probed. A record is seen before unless it is the first of a new key,
        so the records themselves meet only the list of those firsts, joined by id, without skew.
        ``batch`` names the records: given again, the answers stored under the name are the answers.
        """
        batch = batch or uuid.uuid4().hex
        if batch not in self.batches:
            stored = f"{self.path}/decisions-{uuid.uuid4().hex}"
            self._probe(self.first_per_key(records, key, id_)).write.parquet(stored)
            new = self.spark.read.schema(KEYS).parquet(stored).where(~F.col("hit")).select("h", "key")
            runs = [*self.runs, *self._write_run(new, 0)]
            before_publish()
            self._publish(runs, {**self.batches, batch: stored})
            self.compact()
        keys = self.spark.read.schema(KEYS).parquet(self.batches[batch])
        known = records.where(F.col(key).isNotNull() & (F.length(key) > 0)).select(id_)
        firsts = keys.where(~F.col("hit")).select(F.col("first").alias(id_))
        return Decisions(keys, known.join(firsts, id_, "left_anti"))

    def zones_met(self, probes: DataFrame, run: dict) -> list[int]:
        """The zones of ``run`` in whose fences a probe falls; at most MAX_ZONES numbers."""
        fences = F.broadcast(self.spark.read.parquet(run["path"] + "/fences"))  # a row a zone
        inside = (self.zone_of("h", run["zones"]) == fences["zone"]) & F.col("h").between(fences["min_h"], fences["max_h"])
        return sorted(r[0] for r in probes.join(fences, inside).select("zone").distinct().collect())

    def _probe(self, probes: DataFrame) -> DataFrame:
        path = f"{self.path}/probes-{uuid.uuid4().hex}"
        probes.write.parquet(path)
        out = probes = self.spark.read.parquet(path)
        none = {"hash_hit": F.lit(False), "hit": F.lit(False)}
        out = out.withColumns(none)
        for run in self.runs:
            zones = self.zones_met(probes, run)
            if not zones:
                continue
            held = self._read(run).where(F.col("zone").isin(zones)).select(F.col("h").alias("run_h"), F.col("key").alias("run_key"))
            met = out.join(held.hint("merge"), F.col("h") == F.col("run_h"), "left")
            hash_hit, hit = F.col("run_h").isNotNull(), F.coalesce(F.col("run_key") == F.col("key"), F.lit(False))
            met = met.select("key", "h", "first", "n", (F.col("hash_hit") | hash_hit).alias("hash_hit"), (F.col("hit") | hit).alias("hit"))
            # several keys of a run may share a hash: one decision per key, within the same partitioning
            out = met.groupBy("h", "key").agg(*[F.max(c).alias(c) for c in ("first", "n", "hash_hit", "hit")])
        return out.select("key", "h", "first", "n", "hash_hit", "hit")

    def _write_run(self, rows: DataFrame, level: int) -> list[dict]:
        """``rows`` (h, key), written already, as one run, or no run if there are none."""
        n = rows.count()
        if not n:
            return []
        buckets, zones = self.layout(n)
        path, name = f"{self.path}/run-{uuid.uuid4().hex}", "tidelog_run_" + uuid.uuid4().hex
        # every task writes whole buckets, zone after zone
        placed = rows.select("h", "key", self.zone_of("h", zones).alias("zone")).repartition(buckets, "h")
        placed.write.partitionBy("zone").bucketBy(buckets, "h").sortBy("h").option("path", f"{path}/data").saveAsTable(name)
        fences = self.spark.table(name).groupBy("zone").agg(F.min("h").alias("min_h"), F.max("h").alias("max_h"), F.count(F.lit(1)).alias("n"))
        fences.coalesce(1).write.parquet(f"{path}/fences")
        return [{"path": path, "level": level, "table": name, "buckets": buckets, "zones": zones, "keys": n}]

    def _read(self, run: dict) -> DataFrame:
        if not self.spark.catalog.tableExists(run["table"]):  # another session made it
            self.spark.sql(
                f"CREATE TABLE {run['table']} (h BIGINT, key BINARY, zone INT) USING parquet PARTITIONED BY (zone) "
                f"CLUSTERED BY (h) SORTED BY (h) INTO {run['buckets']} BUCKETS LOCATION '{run['path']}/data'"
            )
            self.spark.sql(f"MSCK REPAIR TABLE {run['table']}")
        return self.spark.table(run["table"])

    def _publish(self, runs: list[dict], batches: dict[str, str]) -> None:
        publish.publish(self.spark, f"{self.path}/versions", self.version + 1, {"runs": runs, "batches": batches})
        self.version, self.runs, self.batches = self.version + 1, runs, batches

    def forget(self, batch: str) -> None:
        """Drop the stored answers of a batch that will not be given again."""
        if folder := self.batches.get(batch):
            self._publish(self.runs, {b: f for b, f in self.batches.items() if b != batch})
            publish.remove(self.spark, folder)

    def compact(self) -> None:
        """Merge full levels, lowest first; a merged run is published before its inputs are removed."""
        level = 0
        while any(r["level"] >= level for r in self.runs):
            same = [r for r in self.runs if r["level"] == level]
            if len(same) >= self.fanout:
                rows = self._read(same[0]).select("h", "key")
                for r in same[1:]:
                    rows = rows.union(self._read(r).select("h", "key"))
                keys = f"{self.path}/keys-{uuid.uuid4().hex}"
                rows.dropDuplicates(["h", "key"]).write.parquet(keys)
                merged = self._write_run(self.spark.read.parquet(keys), level + 1)
                self._publish([r for r in self.runs if r["level"] != level] + merged, self.batches)
                for r in same:
                    self.spark.sql(f"DROP TABLE IF EXISTS {r['table']}")
                    publish.remove(self.spark, r["path"])
                publish.remove(self.spark, keys)
            level += 1


def seen_before(spark: SparkSession, known: DataFrame, incoming: DataFrame, path: str | None = None, **options) -> Decisions:
    """Bulk-load the keys of ``known`` as one deep run, then decide the batch ``incoming``."""
    index = SeenKeys(spark, path or new_path(spark, "seen"), **options)
    index.add(known, level=1)
    return index.process(incoming)


def wrong_rate(decisions: Decisions, known: DataFrame) -> DataFrame:
    """One row: records decided, records called seen, and how many answers are wrong, with their rates.

    The truth is an exact semi-join of the full keys with ``known``, and within the batch the first
    record of each key. Repeats within the batch are answers like any other. ``wrong_by_hash`` counts
    the answers that the hash alone would have got wrong (a repeat is right either way).
    """
    truth = known.select("key").distinct().select("key", F.lit(True).alias("known"))
    each = decisions.keys.join(truth, "key", "left").select("n", "hash_hit", "hit", F.coalesce("known", F.lit(False)).alias("known"))
    seen = F.col("n") - F.when(F.col("hit"), 0).otherwise(1)
    count = lambda c: F.coalesce(F.sum(c), F.lit(0)).cast("long")
    out = each.agg(
        count(F.col("n")).alias("records"), count(seen).alias("seen"), count((F.col("hash_hit") != F.col("known")).cast("long")).alias("wrong_by_hash"), count((F.col("hit") != F.col("known")).cast("long")).alias("wrong")
    )
    rate = lambda c: F.when(F.col("records") > 0, F.col(c) / F.col("records")).otherwise(F.lit(0.0))
    return out.withColumns({"wrong_rate_by_hash": rate("wrong_by_hash"), "wrong_rate": rate("wrong")})
