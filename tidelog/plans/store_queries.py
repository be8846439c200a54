"""Queries over the store's own operators, on the events table read as a changelog, and their SQL.

Changelog: key = user_id as text, seq_no = event_id + 1, a delete where event_type is 'error', value
= props, layer_id = event_id / 1000. Node outage in the quorum queries: node-3 after sequence number
8000. Queries whose names end in ``_store`` run over the store tables instead.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidelog.operators import bloom, layers, manifest, quorum, ring, signed, snapshot, stats
from tidelog.schema import Peer
from tidelog.session import hadoop_path, new_path, table, written
from tidelog.streaming.fold import StateStream

RING = ring.Ring(tuple(Peer(f"node-{i}", f"127.0.0.1:1808{i}") for i in (1, 2, 3)), 32)
N, W, R, DOWN_AFTER = 3, 2, 2, 8000


def log(events: DataFrame) -> DataFrame:
    is_delete = F.col("event_type") == "error"
    return events.select(
        F.col("user_id").cast("string").alias("key"), (F.col("event_id") + 1).alias("seq_no"), F.when(is_delete, 2).otherwise(1).alias("op"), F.when(~is_delete, F.col("props")).alias("value"),
        F.floor(F.col("event_id") / 1000).alias("layer_id"),
    )


def changelog(spark: SparkSession, d: str) -> DataFrame:
    return log(table(spark, d, "events"))


def flushed(spark: SparkSession, d: str) -> DataFrame:
    return layers.flush(changelog(spark, d))


def sized(spark: SparkSession, d: str) -> DataFrame:
    return layers.flush(layers.sized(changelog(spark, d)))


def live_tables(spark: SparkSession, d: str) -> DataFrame:
    """The flushed layers as manifest rows; record bytes stand for the file size."""
    m = layers.describe(sized(spark, d))
    return m.select((F.col("layer_id") + 1).alias("id"), F.format_string("%06d.sst", F.col("layer_id") + 1).alias("file"), "min_key", "max_key", "min_seq_no", "max_seq_no", F.col("data_bytes").alias("file_size"))


def placed(spark: SparkSession, d: str) -> DataFrame:
    return RING.place(changelog(spark, d).select("key").distinct(), N)


def spread(spark: SparkSession, d: str) -> DataFrame:
    """Every mutation with the replica list of its key, which is computed in the row."""
    return RING.place(changelog(spark, d), N)


def outage(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([("node-3", DOWN_AFTER + 1, (1 << 63) - 1)], "node_id string, from_seq long, to_seq long")


def live_snapshot(spark: SparkSession, d: str) -> DataFrame:
    return snapshot.live(changelog(spark, d)).select("key", "seq_no", "value")


def latest_with_tombstones(spark: SparkSession, d: str) -> DataFrame:
    return snapshot.latest(changelog(spark, d)).select("key", "seq_no", "op", "value")


def deleted_keys(spark: SparkSession, d: str) -> DataFrame:
    return snapshot.deleted(changelog(spark, d).select("key", "seq_no", "op")).select("key", "seq_no")


def point_get(spark: SparkSession, d: str) -> DataFrame:
    return snapshot.get(changelog(spark, d), "7").select("key", "seq_no", "value")


def multi_get(spark: SparkSession, d: str) -> DataFrame:
    requests = table(spark, d, "events").select((F.col("user_id") * 2).cast("string").alias("key"))
    return snapshot.multi_get(requests, changelog(spark, d))


def snapshot_as_of_seq(spark: SparkSession, d: str) -> DataFrame:
    half_way = changelog(spark, d).agg(F.floor(F.max("seq_no") / 2)).scalar()
    return snapshot.as_of(changelog(spark, d), half_way).select("key", "seq_no", "value")


def memory_size(spark: SparkSession, d: str) -> DataFrame:
    return snapshot.memory_size(changelog(spark, d))


def layer_flush(spark: SparkSession, d: str) -> DataFrame:
    return flushed(spark, d).select("layer_id", "key", "seq_no", "op", "value")


def layer_manifest(spark: SparkSession, d: str) -> DataFrame:
    return layers.describe(sized(spark, d))


def layer_sizes(spark: SparkSession, d: str) -> DataFrame:
    return layers.file_sizes(written(flushed(spark, d), "flushed"), 1024)


def merge_layers(spark: SparkSession, d: str) -> DataFrame:
    return layers.merge(flushed(spark, d)).select("key", "seq_no", "op", "value", "layer_id")


def compaction_equivalence(spark: SparkSession, d: str) -> DataFrame:
    """Per key the live row by fold(merge(layers)) beside the one by fold(log)."""
    merged = snapshot.live(layers.merge(flushed(spark, d)).select("key", "seq_no", "op")).select("key", F.col("seq_no").alias("merged_seq"))
    direct = snapshot.live(changelog(spark, d).select("key", "seq_no", "op")).select("key", F.col("seq_no").alias("direct_seq"))
    return merged.join(direct, "key", "full_outer")


def layer_read_rule(spark: SparkSession, d: str) -> DataFrame:
    return layers.layer_rule(_merged_out_of_order(spark, d)).select("key", "seq_no", "op")


def seq_read_rule(spark: SparkSession, d: str) -> DataFrame:
    return snapshot.latest(_merged_out_of_order(spark, d)).select("key", "seq_no", "op")


def _merged_out_of_order(spark: SparkSession, d: str) -> DataFrame:
    """Layers after a merge of the two oldest ones, whose output is numbered as the newest."""
    rows = layers.flush(changelog(spark, d).select("layer_id", "key", "seq_no", "op"))
    old = F.col("layer_id") < 2
    return layers.merge(rows.where(old)).withColumn("layer_id", F.lit(1 << 30).cast("long")).unionByName(rows.where(~old))


def size_tiered_pick(spark: SparkSession, d: str) -> DataFrame:
    return manifest.pick(live_tables(spark, d).select("id", F.col("file_size").alias("size")), 4, 2.0)


def pick_fallback(spark: SparkSession, d: str) -> DataFrame:
    spaced = live_tables(spark, d).select("id", (F.col("id") * F.col("id") * F.col("id") * F.col("file_size")).alias("size"))
    return manifest.pick(spaced, 4, 1.0)


def pick_per_node_store(spark: SparkSession, d: str) -> DataFrame:
    best = table(spark, d, "manifest_table").groupBy("node_id", "id").agg(F.max_by("file_size", "epoch").alias("size"))
    return manifest.pick(best, 4, 2.0, ["node_id"])


def manifest_after_compaction(spark: SparkSession, d: str) -> DataFrame:
    t = live_tables(spark, d)
    inputs = size_tiered_pick(spark, d).select("id")
    merged = layers.merge(sized(spark, d).join(inputs.select((F.col("id") - 1).alias("layer_id")), "layer_id", "left_semi"))
    m = layers.describe(merged.withColumn("layer_id", F.lit(0).cast("long")))
    number = t.agg(F.max("id") + 1).scalar()
    out = m.select(number.alias("id"), F.format_string("%06d.sst", number).alias("file"), "min_key", "max_key", "min_seq_no", "max_seq_no", F.col("data_bytes").alias("file_size"))
    return manifest.replaced(t, inputs, out)


def manifest_info(spark: SparkSession, d: str) -> DataFrame:
    return manifest.info(table(spark, d, "manifest_table").select("id", "file", "min_key", "max_key", "min_seq_no", "max_seq_no", "file_size"))


def manifest_violations(spark: SparkSession, d: str) -> DataFrame:
    return manifest.violations(table(spark, d, "manifest_table"))


def list_layers(spark: SparkSession, d: str) -> DataFrame:
    return manifest.list_layers(table(spark, d, "manifest_table").select("id", "file", "file_size").distinct(), table(spark, d, "sst_entry"))


def orphan_layers(spark: SparkSession, d: str) -> DataFrame:
    runs = table(spark, d, "flush_run").where("status = 'committed'").select("run_id")
    return layers.orphans(table(spark, d, "sst_entry"), table(spark, d, "manifest_table").join(runs, "run_id", "left_semi"))


def live_layer_entries(spark: SparkSession, d: str) -> DataFrame:
    runs = table(spark, d, "flush_run").where("status = 'committed'").select("run_id")
    rows = layers.live_layers(table(spark, d, "sst_entry"), table(spark, d, "manifest_table").join(runs, "run_id", "left_semi"))
    return rows.groupBy("layer_id").agg(F.count(F.lit(1)).alias("entries"), F.sum(F.col("tombstone").cast("long")).alias("tombstones"))


def recovery_fold_store(spark: SparkSession, d: str) -> DataFrame:
    """State after a restart per node and key: layers of committed runs and the valid log, folded together."""
    runs = table(spark, d, "flush_run").where("status = 'committed'").select("run_id")
    owner = table(spark, d, "manifest_table").join(runs, "run_id", "left_semi").select(F.col("id").alias("layer_id"), "node_id").distinct()
    entries = table(spark, d, "sst_entry").where("seq_no is not null and tombstone is not null and key is not null").join(owner, "layer_id")
    state = snapshot.recover(entries.select("node_id", "key", "seq_no", "tombstone"), table(spark, d, "wal_record").where(signed.is_valid()).select("node_id", "key", "seq_no", "op"), ["node_id", "key"])
    return state.where("op = 1").select("node_id", F.lower(F.hex("key")).alias("key_hex"), "seq_no")


def ring_tokens(spark: SparkSession, d: str) -> DataFrame:
    return RING.tokens(spark).select("token", "node_id", F.col("vnode").cast("long").alias("vnode"))


def ring_preference(spark: SparkSession, d: str) -> DataFrame:
    return ring.replicas(placed(spark, d)).select("key", "node_id", F.col("pref").cast("long").alias("pref"))


def ring_ownership(spark: SparkSession, d: str) -> DataFrame:
    return ring.ownership(placed(spark, d))


def routing(spark: SparkSession, d: str) -> DataFrame:
    entered = RING.place(changelog(spark, d), N)
    node = F.concat(F.lit("node-"), (F.col("seq_no") % 3 + 1).cast("string"))
    r = ring.route(entered, node)
    return r.select("seq_no", "key", "entry_node", "coordinator", "route", ring.local_index("prefs", F.col("entry_node")).cast("long").alias("local_index"))


def write_quorum_outcome(spark: SparkSession, d: str) -> DataFrame:
    out = quorum.write_outcomes(spread(spark, d), outage(spark), W)
    return out.groupBy("acks", "ok").agg(F.count(F.lit(1)).alias("mutations"))


def replica_state(spark: SparkSession, d: str) -> DataFrame:
    return quorum.replica_state(spread(spark, d), outage(spark)).select("node_id", "key", "seq_no", "op", "value")


def read_quorum_outcome(spark: SparkSession, d: str) -> DataFrame:
    return quorum.read_outcomes(ring.replicas(placed(spark, d)), replica_state(spark, d), R)


def read_quorum_unavailable(spark: SparkSession, d: str) -> DataFrame:
    """Reads of every key while two nodes cannot be reached, with a quorum of one: values of the third node only, or none."""
    alone = quorum.read_outcomes(ring.replicas(placed(spark, d)), replica_state(spark, d), 1, unreachable=["node-1", "node-2"])
    both = quorum.read_outcomes(ring.replicas(placed(spark, d)), replica_state(spark, d), R, unreachable=["node-1", "node-2"])
    return alone.select("key", F.col("status").alias("status_of_one"), "seq_no").join(both.select("key", F.col("status").alias("status_of_two")), "key")


def stale_after_missed_writes(spark: SparkSession, d: str) -> DataFrame:
    narrow = spread(spark, d).select("key", "seq_no", "op", "prefs")
    return quorum.stale(quorum.replica_state(narrow, outage(spark)), changelog(spark, d))


def bloom_params(spark: SparkSession, d: str) -> DataFrame:
    return bloom.parameters(sized(spark, d))


def bloom_hash(spark: SparkSession, d: str) -> DataFrame:
    return bloom.key_hashes(changelog(spark, d).select("key").distinct())


def index_blocks(spark: SparkSession, d: str) -> DataFrame:
    return layers.blocks(written(flushed(spark, d), "flushed"), 1024).withColumn("block", F.col("block").cast("long"))


def index_locate(spark: SparkSession, d: str) -> DataFrame:
    """For every layer entry the block that would be read."""
    rows = written(flushed(spark, d), "flushed")
    return layers.locate(rows.select("layer_id", "key"), layers.blocks(rows, 1024)).select("layer_id", "key", F.col("block").cast("long").alias("block"), "first_key")


def store_stats(spark: SparkSession, d: str) -> DataFrame:
    return stats.store_stats(changelog(spark, d), live_tables(spark, d))


def op_counts(spark: SparkSession, d: str) -> DataFrame:
    return stats.op_counts(changelog(spark, d))


def wal_bytes(spark: SparkSession, d: str) -> DataFrame:
    return stats.log_bytes(changelog(spark, d), ["layer_id"])


def wal_segments_store(spark: SparkSession, d: str) -> DataFrame:
    return stats.segments(table(spark, d, "wal_record"))


def invalid_mutations(spark: SparkSession, d: str) -> DataFrame:
    _, bad = snapshot.split_invalid(table(spark, d, "wal_record"))
    return bad.select("record_id", "reason")


def stream_live_snapshot(spark: SparkSession, d: str) -> DataFrame:
    """The changelog as a stream of files, folded batch by batch until all are read."""
    source = table(spark, d, "events")
    stream = StateStream(spark, new_path(spark, "stream"))
    reader = spark.readStream.schema(source.schema).option("maxFilesPerTrigger", 1)
    fs, path = hadoop_path(spark, f"{d}/events.parquet")
    events = reader.parquet(f"{d}/events.parquet") if fs.getFileStatus(path).isDirectory() else reader.option("pathGlobFilter", "events.parquet").parquet(d)
    stream.start(log(events)).awaitTermination()
    return stream.live().select("key", "seq_no", "value")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        live_snapshot, latest_with_tombstones, deleted_keys, point_get, multi_get, snapshot_as_of_seq, memory_size, layer_flush, layer_manifest, layer_sizes, merge_layers, compaction_equivalence,
        layer_read_rule, seq_read_rule, size_tiered_pick, pick_fallback, pick_per_node_store, manifest_after_compaction, manifest_info, manifest_violations, list_layers, orphan_layers, live_layer_entries,
        recovery_fold_store, ring_tokens, ring_preference, ring_ownership, routing, write_quorum_outcome, replica_state, read_quorum_outcome, read_quorum_unavailable, stale_after_missed_writes, bloom_params,
        bloom_hash, index_blocks, index_locate, store_stats, op_counts, wal_bytes, wal_segments_store, invalid_mutations, stream_live_snapshot,
    )
}

LOG = """log AS (SELECT CAST(user_id AS VARCHAR) AS key, event_id + 1 AS seq_no, CASE WHEN event_type = 'error' THEN 2 ELSE 1 END AS op,
 CASE WHEN event_type = 'error' THEN NULL ELSE props END AS value, CAST(floor(event_id / 1000.0) AS BIGINT) AS layer_id FROM events)"""
FLUSHED = f"{LOG}, flushed AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY layer_id, key ORDER BY seq_no DESC) AS rn FROM log) z WHERE rn = 1)"
SIZE = "21 + octet_length(CAST(key AS BLOB)) + coalesce(octet_length(CAST(value AS BLOB)), 0)"
TABLES = f"""{FLUSHED}, tables AS (SELECT layer_id + 1 AS id, format('{{:06d}}.sst', layer_id + 1) AS file, min(key) AS min_key, max(key) AS max_key, min(seq_no) AS min_seq_no, max(seq_no) AS max_seq_no,
 CAST(sum({SIZE}) AS BIGINT) AS file_size FROM flushed GROUP BY layer_id)"""
RINGED = f"""{LOG}, toks AS (SELECT n.node_id, substr(sha1(concat(n.node_id, '#', CAST(t.i AS VARCHAR))), 1, 16) AS tok, t.i AS vnode FROM (VALUES ('node-1'), ('node-2'), ('node-3')) n(node_id), range(0, 32) t(i)),
 ks AS (SELECT DISTINCT key, substr(sha1(key), 1, 16) AS pos FROM log),
 f AS (SELECT key, node_id, min(concat(CASE WHEN tok >= pos THEN '0' ELSE '1' END, tok)) AS dist FROM ks, toks GROUP BY key, node_id),
 prefs AS (SELECT key, node_id, row_number() OVER (PARTITION BY key ORDER BY dist, node_id) AS pref FROM f)"""
REPLICAS = f"""{RINGED}, rst AS (SELECT * FROM (SELECT l.*, p.node_id, row_number() OVER (PARTITION BY p.node_id, l.key ORDER BY l.seq_no DESC) AS rn
 FROM log l JOIN prefs p ON l.key = p.key WHERE NOT (p.node_id = 'node-3' AND l.seq_no > {DOWN_AFTER})) z WHERE rn = 1)"""
LAST = "SELECT *, row_number() OVER (PARTITION BY key ORDER BY seq_no DESC) AS rn FROM {}"
PICK = """s AS (SELECT id, sz, row_number() OVER (ORDER BY sz, id DESC) AS rn FROM t), n AS (SELECT least({k}, count(*)) AS k, count(*) AS n FROM t),
 fit AS (SELECT min(a.rn) AS st FROM s a CROSS JOIN n JOIN s b ON b.rn = a.rn + n.k - 1 WHERE b.sz <= greatest(a.sz, 1) * {r}), nw AS (SELECT id, sz, row_number() OVER (ORDER BY id DESC) AS rk FROM t),
 picked AS (SELECT id, sz AS size FROM s CROSS JOIN n CROSS JOIN fit WHERE n.n >= 2 AND st IS NOT NULL AND rn BETWEEN st AND st + n.k - 1
 UNION ALL SELECT id, sz FROM nw CROSS JOIN n CROSS JOIN fit WHERE n.n >= 2 AND st IS NULL AND rk <= n.k)"""
COMMITTED = "SELECT id FROM manifest_table WHERE run_id IN (SELECT run_id FROM flush_run WHERE status = 'committed')"
MERGED = f"""{FLUSHED}, lay AS (SELECT key, seq_no, op, 1073741824 AS layer_id FROM ({LAST.format("flushed WHERE layer_id < 2").replace("AS rn FROM", "AS r2 FROM")}) z WHERE r2 = 1
 UNION ALL SELECT key, seq_no, op, layer_id FROM flushed WHERE layer_id >= 2)"""
VALID = "seq_no IS NOT NULL AND op IN (1, 2) AND key IS NOT NULL AND octet_length(key) > 0 AND (op = 1 OR value IS NULL OR octet_length(value) = 0)"
M = "SELECT DISTINCT node_id, id, file, min_key, max_key, min_seq_no, max_seq_no, file_size FROM manifest_table"
FNV = "list_reduce(list_prepend({start}::HUGEINT, list_transform(range(1, length(key) + 1), lambda i: CAST(ascii(substr(key, i, 1)) AS HUGEINT))), lambda a, b: (xor(a, b) * {prime}::HUGEINT) % 18446744073709551616::HUGEINT)"

ORACLE: dict[str, str] = {
    "live_snapshot": f"WITH {LOG} SELECT key, seq_no, value FROM ({LAST.format('log')}) z WHERE rn = 1 AND op = 1",
    "stream_live_snapshot": f"WITH {LOG} SELECT key, seq_no, value FROM ({LAST.format('log')}) z WHERE rn = 1 AND op = 1",
    "latest_with_tombstones": f"WITH {LOG} SELECT key, seq_no, op, value FROM ({LAST.format('log')}) z WHERE rn = 1",
    "deleted_keys": f"WITH {LOG} SELECT key, seq_no FROM ({LAST.format('log')}) z WHERE rn = 1 AND op = 2",
    "point_get": f"WITH {LOG} SELECT key, seq_no, value FROM ({LAST.format('log')}) z WHERE rn = 1 AND op = 1 AND key = '7'",
    "multi_get": f"""WITH {LOG}, live AS (SELECT * FROM ({LAST.format('log')}) z WHERE rn = 1 AND op = 1)
 SELECT q.key, l.seq_no IS NOT NULL AS found, l.value, l.seq_no FROM (SELECT DISTINCT CAST(user_id * 2 AS VARCHAR) AS key FROM events) q LEFT JOIN live l ON q.key = l.key""",
    "snapshot_as_of_seq": f"WITH {LOG} SELECT key, seq_no, value FROM ({LAST.format('log WHERE seq_no <= (SELECT floor(max(seq_no) / 2) FROM log)')}) z WHERE rn = 1 AND op = 1",
    "memory_size": f"WITH {LOG} SELECT count(*) AS entries, CAST(sum(length(key) + coalesce(length(value), 0)) AS BIGINT) AS bytes FROM ({LAST.format('log')}) z WHERE rn = 1",
    "layer_flush": f"WITH {FLUSHED} SELECT layer_id, key, seq_no, op, value FROM flushed",
    "layer_manifest": f"""WITH {FLUSHED} SELECT layer_id, count(*) AS entries, min(key) AS min_key, max(key) AS max_key, min(seq_no) AS min_seq_no, max(seq_no) AS max_seq_no, CAST(sum({SIZE}) AS BIGINT) AS data_bytes
 FROM flushed GROUP BY layer_id""",
    "merge_layers": f"WITH {FLUSHED} SELECT key, seq_no, op, value, layer_id FROM (SELECT *, row_number() OVER (PARTITION BY key ORDER BY seq_no DESC, layer_id) AS r2 FROM flushed) z WHERE r2 = 1",
    "compaction_equivalence": f"""WITH {FLUSHED}, m AS (SELECT key, seq_no FROM (SELECT *, row_number() OVER (PARTITION BY key ORDER BY seq_no DESC) AS r2 FROM flushed) z WHERE r2 = 1 AND op = 1),
 l AS (SELECT key, seq_no FROM ({LAST.format('log')}) z WHERE rn = 1 AND op = 1) SELECT key, m.seq_no AS merged_seq, l.seq_no AS direct_seq FROM m FULL OUTER JOIN l USING (key)""",
    "layer_read_rule": f"WITH {MERGED} SELECT key, seq_no, op FROM (SELECT *, row_number() OVER (PARTITION BY key ORDER BY layer_id DESC) AS r3 FROM lay) z WHERE r3 = 1",
    "seq_read_rule": f"WITH {MERGED} SELECT key, seq_no, op FROM (SELECT *, row_number() OVER (PARTITION BY key ORDER BY seq_no DESC) AS r3 FROM lay) z WHERE r3 = 1",
    "size_tiered_pick": f"WITH {TABLES}, t AS (SELECT id, file_size AS sz FROM tables), {PICK.format(k=4, r=2.0)} SELECT * FROM picked",
    "pick_fallback": f"WITH {TABLES}, t AS (SELECT id, id * id * id * file_size AS sz FROM tables), {PICK.format(k=4, r=1.0)} SELECT * FROM picked",
    "manifest_after_compaction": f"""WITH {TABLES}, t AS (SELECT id, file_size AS sz FROM tables), {PICK.format(k=4, r=2.0)},
 best AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY key ORDER BY seq_no DESC) AS r2 FROM flushed WHERE layer_id + 1 IN (SELECT id FROM picked)) z WHERE r2 = 1)
 SELECT * FROM tables WHERE id NOT IN (SELECT id FROM picked)
 UNION ALL SELECT x.id, format('{{:06d}}.sst', x.id), b.* FROM (SELECT max(id) + 1 AS id FROM tables) x, (SELECT min(key), max(key), min(seq_no), max(seq_no), CAST(sum({SIZE}) AS BIGINT) FROM best HAVING count(*) > 0) b""",
    "manifest_info": """SELECT id, file, CASE WHEN length(min_key) > 18 THEN substr(min_key, 1, 15) || '...' ELSE min_key END AS min_key,
 CASE WHEN length(max_key) > 18 THEN substr(max_key, 1, 15) || '...' ELSE max_key END AS max_key, min_seq_no, max_seq_no, file_size FROM manifest_table""",
    "manifest_violations": f"""WITH m AS ({M}) SELECT node_id, id, 'id' AS rule FROM m WHERE id IS NULL OR id <= 0 UNION ALL SELECT node_id, id, 'file' FROM m WHERE file IS NULL OR file = '' OR contains(file, '/')
 UNION ALL SELECT node_id, id, 'key_range' FROM m WHERE min_key > max_key UNION ALL SELECT node_id, id, 'seq_range' FROM m WHERE min_seq_no > max_seq_no
 UNION ALL SELECT node_id, id, 'file_size' FROM m WHERE file_size IS NULL OR file_size < 0
 UNION ALL SELECT node_id, id, 'duplicate_id' FROM m GROUP BY node_id, id HAVING count(*) > 1 UNION ALL SELECT node_id, min(id), 'duplicate_file' FROM m GROUP BY node_id, file HAVING count(*) > 1""",
    "list_layers": """SELECT m.id, m.file, m.file_size, coalesce(c.n, -1) AS entries FROM (SELECT DISTINCT id, file, file_size FROM manifest_table) m
 LEFT JOIN (SELECT layer_id, count(*) AS n FROM sst_entry GROUP BY layer_id) c ON c.layer_id = m.id""",
    "orphan_layers": f"SELECT DISTINCT layer_id FROM sst_entry s WHERE NOT EXISTS (SELECT 1 FROM ({COMMITTED}) c WHERE c.id = s.layer_id)",
    "live_layer_entries": f"SELECT layer_id, count(*) AS entries, CAST(sum(CASE WHEN tombstone THEN 1 WHEN tombstone IS NULL THEN NULL ELSE 0 END) AS BIGINT) AS tombstones FROM sst_entry WHERE layer_id IN ({COMMITTED}) GROUP BY layer_id",
    "recovery_fold_store": f"""WITH r AS (SELECT DISTINCT m.node_id, e.key, e.seq_no, CASE WHEN e.tombstone THEN 2 ELSE 1 END AS op FROM sst_entry e JOIN (SELECT DISTINCT id, node_id FROM manifest_table
 WHERE run_id IN (SELECT run_id FROM flush_run WHERE status = 'committed')) m ON m.id = e.layer_id WHERE e.seq_no IS NOT NULL AND e.tombstone IS NOT NULL AND e.key IS NOT NULL
 UNION SELECT node_id, key, seq_no, op FROM wal_record WHERE {VALID})
 SELECT node_id, lower(hex(key)) AS key_hex, seq_no FROM (SELECT *, row_number() OVER (PARTITION BY node_id, key ORDER BY seq_no DESC, op DESC) AS rn FROM r) z WHERE rn = 1 AND op = 1""",
    "ring_tokens": f"WITH {RINGED} SELECT tok AS token, node_id, vnode FROM toks",
    "ring_preference": f"WITH {RINGED} SELECT key, node_id, pref FROM prefs WHERE pref <= {N}",
    "ring_ownership": f"WITH {RINGED} SELECT node_id, count(*) AS keys FROM prefs WHERE pref = 1 GROUP BY node_id",
    "routing": f"""WITH {RINGED} SELECT l.seq_no, l.key, l.entry_node, p.node_id AS coordinator, CASE WHEN p.node_id = l.entry_node THEN 'local' ELSE 'forward' END AS route, e.pref - 1 AS local_index
 FROM (SELECT *, concat('node-', CAST(seq_no % 3 + 1 AS VARCHAR)) AS entry_node FROM log) l JOIN prefs p ON p.key = l.key AND p.pref = 1 JOIN prefs e ON e.key = l.key AND e.node_id = l.entry_node""",
    "write_quorum_outcome": f"""WITH {RINGED}, acks AS (SELECT l.key, l.seq_no, CAST(sum(CASE WHEN p.node_id = 'node-3' AND l.seq_no > {DOWN_AFTER} THEN 0 ELSE 1 END) AS BIGINT) AS acks FROM log l JOIN prefs p ON l.key = p.key GROUP BY l.key, l.seq_no)
 SELECT acks, acks >= {W} AS ok, count(*) AS mutations FROM acks GROUP BY acks""",
    "replica_state": f"WITH {REPLICAS} SELECT node_id, key, seq_no, op, value FROM rst",
    "read_quorum_outcome": f"""WITH {REPLICAS}, rep AS (SELECT p.key, r.value, r.seq_no, CASE WHEN r.op = 1 THEN 1 ELSE 0 END AS found, row_number() OVER (PARTITION BY p.key ORDER BY sha1(concat(p.key, p.node_id))) AS arr
 FROM prefs p LEFT JOIN rst r ON r.key = p.key AND r.node_id = p.node_id), q AS (SELECT *, row_number() OVER (PARTITION BY key ORDER BY CASE WHEN found = 1 THEN 0 ELSE 1 END, arr) AS w FROM rep WHERE arr <= {R})
 SELECT key, CASE WHEN found = 1 THEN 'FOUND' ELSE 'NOT_FOUND' END AS status, CASE WHEN found = 1 THEN value END AS value, CASE WHEN found = 1 THEN seq_no END AS seq_no FROM q WHERE w = 1""",
    "read_quorum_unavailable": f"""WITH {REPLICAS}, up AS (SELECT p.key, count(*) FILTER (WHERE p.node_id NOT IN ('node-1', 'node-2')) AS n FROM prefs p WHERE p.pref <= {N} GROUP BY p.key)
 SELECT u.key, CASE WHEN u.n < 1 THEN 'UNAVAILABLE' WHEN r.op = 1 THEN 'FOUND' ELSE 'NOT_FOUND' END AS status_of_one, CASE WHEN u.n >= 1 AND r.op = 1 THEN r.seq_no END AS seq_no,
 CASE WHEN u.n < {R} THEN 'UNAVAILABLE' WHEN r.op = 1 THEN 'FOUND' ELSE 'NOT_FOUND' END AS status_of_two FROM up u LEFT JOIN rst r ON r.key = u.key AND r.node_id = 'node-3'""",
    "stale_after_missed_writes": f"WITH {REPLICAS} SELECT r.node_id, r.key, r.seq_no, n.s AS latest_seq_no FROM rst r JOIN (SELECT key, max(seq_no) AS s FROM log GROUP BY key) n ON n.key = r.key WHERE r.seq_no < n.s",
    "bloom_params": f"""WITH {FLUSHED}, c AS (SELECT layer_id, count(*) AS n FROM flushed GROUP BY layer_id), s AS (SELECT *, CAST(floor((greatest(ceil(-n * ln(0.01) / (ln(2) * ln(2))), 64) + 7) / 8) * 8 AS BIGINT) AS m FROM c)
 SELECT layer_id, n, m, CAST(greatest(round(m / n * ln(2)), 1) AS BIGINT) AS k FROM s""",
    "bloom_hash": f"""WITH {LOG} SELECT key, lpad(lower(printf('%x', h1)), 16, '0') AS h1, lpad(lower(printf('%x', h2)), 16, '0') AS h2 FROM
 (SELECT key, CAST({FNV.format(start="14695981039346656037", prime="1099511628211")} AS UBIGINT) AS h1, CAST({FNV.format(start="1099511628211", prime="1000000007")} AS UBIGINT) AS h2 FROM (SELECT DISTINCT key FROM log) u) v""",
    "store_stats": f"""WITH {TABLES} SELECT (SELECT count(*) FROM log) AS mutations, (SELECT count(*) FROM log WHERE op = 1) AS puts, (SELECT count(*) FROM log WHERE op = 2) AS deletes, (SELECT max(seq_no) FROM log) AS last_seq_no,
 (SELECT CAST(sum({SIZE}) AS BIGINT) FROM log) AS bytes_written, (SELECT count(*) FROM tables) AS sst_count, (SELECT CAST(sum(file_size) AS BIGINT) FROM tables) AS sst_total_bytes""",
    "op_counts": f"WITH {LOG} SELECT op, count(*) AS n, min(seq_no) AS first_seq_no, max(seq_no) AS last_seq_no FROM log GROUP BY op",
    "wal_bytes": f"WITH {LOG} SELECT layer_id, count(*) AS records, CAST(sum({SIZE}) AS BIGINT) AS bytes, max(seq_no) AS last_seq_no FROM log GROUP BY layer_id",
    "wal_segments_store": """SELECT node_id, count(DISTINCT segment_id) AS total_segments, max(segment_id) AS active_segment, count(*) AS records,
 CAST(sum(21 + coalesce(octet_length(key), 0) + coalesce(octet_length(value), 0)) AS BIGINT) AS bytes, max(seq_no) AS last_seq_no FROM wal_record GROUP BY node_id""",
    "invalid_mutations": """SELECT record_id, reason FROM (SELECT record_id, CASE WHEN op IS NULL OR op NOT IN (1, 2) THEN 'op' WHEN seq_no IS NULL THEN 'seq_no' WHEN key IS NULL OR octet_length(key) = 0 THEN 'key'
 WHEN op = 2 AND coalesce(octet_length(value), 0) > 0 THEN 'value' END AS reason FROM wal_record) z WHERE reason IS NOT NULL""",
}
