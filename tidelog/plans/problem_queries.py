"""The pN_ queries of the general problems (1 and 3 to 6) and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidelog.operators import archive, incremental, keyload, reconcile, signed
from tidelog.session import new_path, table, written


def as_hex(c: str) -> Column:
    return F.lower(F.hex(c)).alias(f"{c}_hex")


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    return keyload.heavy_keys(table(spark, d, "wal_record"), table(spark, d, "sst_entry"))


def p1_keys(spark: SparkSession, d: str) -> DataFrame:
    s = keyload.store_key_states(table(spark, d, "wal_record"), table(spark, d, "sst_entry"))
    return s.select(F.when(~F.col("_none"), F.lower(F.hex("_key"))).alias("key_hex"), *[c for c in s.columns if c not in ("_key", "_none")])


def p1_join(spark: SparkSession, d: str) -> DataFrame:
    wal, sst = table(spark, d, "wal_record"), table(spark, d, "sst_entry")
    size = F.coalesce(F.length("value"), F.lit(0)).cast("long")
    j = keyload.eager_join_aggregate(wal, sst, "key", {"wal_bytes": size}, {"sst_bytes": size}, rollup=F.length("key"))
    return j.select(F.col("grp").cast("long").alias("key_length"), *[F.col(c).cast("string").alias(c) for c in ("pairs", "wal_bytes", "sst_bytes")])


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    return signed.live_images(table(spark, d, "wal_record")).select("node_id", as_hex("key"), "seq_no")


def p3_live(spark: SparkSession, d: str) -> DataFrame:
    return signed.live_rows(table(spark, d, "wal_record")).select("node_id", as_hex("key"), "seq_no", as_hex("value"))


def p3_from_base(spark: SparkSession, d: str) -> DataFrame:
    """The first half of the deliveries folded to a base, the other half applied to it."""
    log = table(spark, d, "wal_record")
    half = log.agg(F.floor(F.max("record_id") / 2)).scalar()
    base = written(signed.state(log.where(F.col("record_id") <= half)), "base")
    live = signed.live_rows(log.where(F.col("record_id") > half), base)
    return live.select("node_id", as_hex("key"), "seq_no", as_hex("value"))


def p4_target(spark: SparkSession, d: str) -> incremental.IncrementalTarget:
    taken = incremental.committed_ranges(table(spark, d, "manifest_table"), table(spark, d, "flush_run"))
    return incremental.IncrementalTarget(spark, new_path(spark, "target"), ["node_id", "key"], ["seq_no"], ranges=taken)


def valid_records(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "wal_record").where(signed.is_valid()).select("record_id", "node_id", "seq_no", "op", "key", "value")


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    """Two runs, as records arrive: what the first has published the second meets again among all records."""
    target, log = p4_target(spark, d), valid_records(spark, d)
    half = log.agg(F.floor(F.max("record_id") / 2)).scalar()
    target.run(log.where(F.col("record_id") <= half))
    target.run(log)
    return target.rows().select("node_id", "seq_no")


def p4_rerun(spark: SparkSession, d: str) -> DataFrame:
    """The target after a run that dies before publishing and two whole runs: each record once, all of one version."""
    target, log = p4_target(spark, d), valid_records(spark, d)

    def die() -> None:
        raise InterruptedError

    try:
        target.run(log, before_publish=die)
    except InterruptedError:
        pass
    target.run(log)
    target.run(log)
    return target.rows().select("node_id", "seq_no", "op", as_hex("key"), as_hex("value"), "target_version")


def p5_archive(spark: SparkSession, d: str) -> archive.Archive:
    return archive.pack_committed(spark, table(spark, d, "sst_entry"), table(spark, d, "manifest_table"), table(spark, d, "flush_run"))


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    return archive.small_layers(p5_archive(spark, d))


def p5_entries(spark: SparkSession, d: str) -> DataFrame:
    return archive.unpack(p5_archive(spark, d)).select("layer_id", as_hex("key"), as_hex("value"), "seq_no", "tombstone")


def p5_index(spark: SparkSession, d: str) -> DataFrame:
    """Per layer what the index says of its parts together."""
    parts = p5_archive(spark, d).index.groupBy("id", "file_size")
    return parts.agg(F.sum("entries").alias("entries"), F.sum("length").alias("length"))


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    diffs = reconcile.differences(table(spark, d, "sst_entry"), table(spark, d, "sst_backup"), reconcile.STORE, ("only_entry", "only_backup"))
    return diffs.select("layer_id", as_hex("key"), "diff")


def p6_rounds(spark: SparkSession, d: str) -> DataFrame:
    """How the buckets were settled: per bound how many were tried, solved, listed whole or tried again."""
    return reconcile.differing_hashes(table(spark, d, "sst_entry"), table(spark, d, "sst_backup"), reconcile.STORE).rounds


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f for f in (p1_found, p1_keys, p1_join, p3_found, p3_live, p3_from_base, p4_found, p4_rerun, p5_found, p5_entries, p5_index, p6_found, p6_rounds)
}

VALID = "seq_no IS NOT NULL AND op IN (1, 2) AND key IS NOT NULL AND octet_length(key) > 0 AND (op = 1 OR value IS NULL OR octet_length(value) = 0)"
LAST = f"SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY node_id, key ORDER BY seq_no DESC) AS rn FROM wal_record WHERE {VALID}) z WHERE rn = 1 AND op = 1"
COMMITTED = "SELECT run_id FROM flush_run WHERE status = 'committed'"
PENDING = f"""FROM (SELECT DISTINCT node_id, seq_no, op, key, value FROM wal_record WHERE {VALID}) w
WHERE NOT EXISTS (SELECT 1 FROM (SELECT DISTINCT node_id, min_seq_no AS lo, max_seq_no AS hi FROM manifest_table WHERE run_id IN ({COMMITTED})) m
                  WHERE m.node_id = w.node_id AND w.seq_no BETWEEN m.lo AND m.hi)"""
SIDE = "SELECT key, count(*) AS n, sum(coalesce(octet_length(key), 0) + coalesce(octet_length(value), 0)) AS bytes, max(seq_no) AS latest FROM {} GROUP BY key"
ORACLE: dict[str, str] = {
    "p1_found": " UNION ALL ".join(
        f"SELECT '{t}' AS tab, lower(hex(key)) AS key_hex FROM {t} WHERE key IS NOT NULL AND octet_length(key) > 0 GROUP BY key HAVING count(*) * 100 >= (SELECT count(*) FROM {t})" for t in ("wal_record", "sst_entry")
    ),
    "p1_keys": f"""SELECT lower(hex(coalesce(w.key, s.key))) AS key_hex, coalesce(w.n, 0) AS wal_n, CAST(w.bytes AS BIGINT) AS wal_bytes, w.latest AS wal_latest,
 coalesce(s.n, 0) AS sst_n, CAST(s.bytes AS BIGINT) AS sst_bytes, s.latest AS sst_latest
 FROM ({SIDE.format("wal_record")}) w FULL OUTER JOIN ({SIDE.format("sst_entry")}) s ON w.key IS NOT DISTINCT FROM s.key""",
    "p1_join": """SELECT CAST(octet_length(w.key) AS BIGINT) AS key_length, CAST(sum(CAST(w.n AS HUGEINT) * s.n) AS VARCHAR) AS pairs,
 CAST(sum(CAST(w.b AS HUGEINT) * s.n) AS VARCHAR) AS wal_bytes, CAST(sum(CAST(s.b AS HUGEINT) * w.n) AS VARCHAR) AS sst_bytes
 FROM (SELECT key, count(*) AS n, sum(coalesce(octet_length(value), 0)) AS b FROM wal_record GROUP BY key) w
 JOIN (SELECT key, count(*) AS n, sum(coalesce(octet_length(value), 0)) AS b FROM sst_entry GROUP BY key) s ON w.key = s.key GROUP BY octet_length(w.key)""",
    "p3_found": f"SELECT node_id, lower(hex(key)) AS key_hex, seq_no FROM ({LAST}) x",
    "p3_live": f"SELECT node_id, lower(hex(key)) AS key_hex, seq_no, lower(hex(value)) AS value_hex FROM ({LAST}) x",
    "p3_from_base": f"SELECT node_id, lower(hex(key)) AS key_hex, seq_no, lower(hex(value)) AS value_hex FROM ({LAST}) x",
    "p4_found": f"SELECT DISTINCT node_id, seq_no {PENDING}",
    "p4_rerun": f"SELECT node_id, seq_no, op, lower(hex(key)) AS key_hex, lower(hex(max(value))) AS value_hex, 1 AS target_version {PENDING} GROUP BY node_id, seq_no, op, key",
    "p5_found": f"SELECT id FROM (SELECT id, file_size, row_number() OVER (PARTITION BY id ORDER BY epoch DESC) AS rn FROM manifest_table WHERE run_id IN ({COMMITTED})) z WHERE rn = 1 AND file_size < 16384",
    "p5_entries": f"""SELECT DISTINCT layer_id, lower(hex(key)) AS key_hex, lower(hex(value)) AS value_hex, seq_no, tombstone FROM sst_entry
 WHERE layer_id IN (SELECT id FROM manifest_table WHERE run_id IN ({COMMITTED}))""",
    "p5_index": f"""WITH t AS (SELECT id, file_size FROM (SELECT id, file_size, row_number() OVER (PARTITION BY id ORDER BY epoch DESC) AS rn FROM manifest_table WHERE run_id IN ({COMMITTED})) z WHERE rn = 1)
 SELECT t.id, t.file_size, count(e.layer_id) AS entries, CAST(coalesce(sum(17 + coalesce(octet_length(e.key), 0) + coalesce(octet_length(e.value), 0)), 0) AS BIGINT) AS length
 FROM t LEFT JOIN (SELECT DISTINCT * FROM sst_entry) e ON e.layer_id = t.id GROUP BY t.id, t.file_size""",
    "p6_found": """WITH a AS (SELECT DISTINCT * FROM sst_entry), b AS (SELECT DISTINCT * FROM sst_backup),
 j AS (SELECT coalesce(a.layer_id, b.layer_id) AS layer_id, lower(hex(coalesce(a.key, b.key))) AS key_hex, a.layer_id IS NOT NULL AS ina, b.layer_id IS NOT NULL AS inb,
   a.value IS DISTINCT FROM b.value AS dv, a.seq_no IS DISTINCT FROM b.seq_no AS ds, a.tombstone IS DISTINCT FROM b.tombstone AS dt
   FROM a FULL OUTER JOIN b ON a.layer_id = b.layer_id AND a.key = b.key)
 SELECT layer_id, key_hex, 'only_entry' AS diff FROM j WHERE NOT inb UNION ALL SELECT layer_id, key_hex, 'only_backup' FROM j WHERE NOT ina
 UNION ALL SELECT layer_id, key_hex, 'value' FROM j WHERE ina AND inb AND dv UNION ALL SELECT layer_id, key_hex, 'seq_no' FROM j WHERE ina AND inb AND ds
 UNION ALL SELECT layer_id, key_hex, 'tombstone' FROM j WHERE ina AND inb AND dt""",
}
