"""The pN_ queries of problems 2, 7, 8 and 9 and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidelog.llm import mixture, mojibake, seen, tokenize
from tidelog.session import new_path, table


def p2_decided(spark: SparkSession, d: str, **options) -> seen.Decisions:
    return seen.seen_before(spark, table(spark, d, "sst_entry"), table(spark, d, "wal_incoming"), **options)


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    return p2_decided(spark, d).found


def p2_batches(spark: SparkSession, d: str) -> DataFrame:
    """The same answers with the incoming records in four batches by arrival and runs merged in pairs."""
    index = seen.SeenKeys(spark, new_path(spark, "seen"), fanout=2)
    index.add(table(spark, d, "sst_entry"), level=2)
    incoming = table(spark, d, "wal_incoming")
    span = incoming.agg(F.min("record_id").alias("lo"), (F.max("record_id") + 1).alias("hi")).select(F.struct("lo", "hi")).scalar()
    numbered = incoming.withColumn("batch", F.floor((F.col("record_id") - span["lo"]) * 4 / (span["hi"] - span["lo"])))
    found = [index.process(numbered.where(F.col("batch") == i), batch=str(i)).found for i in range(4)]
    return found[0].union(found[1]).union(found[2]).union(found[3])


def p2_rate(spark: SparkSession, d: str) -> DataFrame:
    """How many answers were given, how many of them "seen", and how many wrong; of all records with a key, repeats included."""
    rate = seen.wrong_rate(p2_decided(spark, d), table(spark, d, "sst_entry"))
    return rate.select("records", "seen", "wrong", "wrong_rate")


def p2_rate_short(spark: SparkSession, d: str) -> DataFrame:
    """The same with hashes of 20 bits, whose wrong hits the full keys correct."""
    return seen.wrong_rate(p2_decided(spark, d, hash_bits=20), table(spark, d, "sst_entry"))


def p7_ids(spark: SparkSession, d: str) -> DataFrame:
    return tokenize.token_ids(table(spark, d, "documents"))


def p7_reuse(spark: SparkSession, d: str) -> DataFrame:
    return tokenize.reuse(table(spark, d, "documents"))


def p8_both(spark: SparkSession, d: str, **options) -> tuple[DataFrame, DataFrame]:
    return mixture.mixture(table(spark, d, "documents"), table(spark, d, "mix_target"), **options)


def p8_found(spark: SparkSession, d: str) -> DataFrame:
    """The sources whose sample ends at the cap of every document, short of its tokens."""
    return p8_both(spark, d)[1].where("short").select("source")


def p8_mix(spark: SparkSession, d: str) -> DataFrame:
    return p8_both(spark, d)[0]


def p8_shares(spark: SparkSession, d: str) -> DataFrame:
    return p8_both(spark, d)[1]


def p8_exact(spark: SparkSession, d: str) -> DataFrame:
    """The report of the largest mixture in which every source that has documents reaches its weight."""
    documents, targets = table(spark, d, "documents"), table(spark, d, "mix_target")
    own = documents.join(targets.select("source").distinct(), "source", "left_semi")
    most = mixture.largest_exact(mixture.plan(tokenize.token_counts(own, ["source"]), targets)).first()[0]
    return mixture.mixture(documents, targets, size=most or 0)[1]


def p8_faults(spark: SparkSession, d: str) -> DataFrame:
    return mixture.faults(*p8_both(spark, d))


def p9_found(spark: SparkSession, d: str) -> DataFrame:
    return mojibake.find(table(spark, d, "documents")).documents.select("doc_id")


def p9_restored(spark: SparkSession, d: str) -> DataFrame:
    documents = table(spark, d, "documents")
    return mojibake.restore(documents, mojibake.find(documents))


def p9_accuracy(spark: SparkSession, d: str) -> DataFrame:
    """Recall, accuracy of the predicted chain and exact restoration on documents garbled for the purpose."""
    return mojibake.accuracy(table(spark, d, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in (p2_found, p2_batches, p2_rate, p2_rate_short, p7_ids, p7_reuse, p8_found, p8_mix, p8_shares, p8_exact, p8_faults, p9_found, p9_restored, p9_accuracy)}
#: Tokenizing and restoring have no SQL; these queries are tested against plain encoding, brute force and held-out texts.
ORACLE: dict[str, str] = {
    "p2_found": """SELECT record_id FROM (SELECT record_id, key, row_number() OVER (PARTITION BY key ORDER BY record_id) AS rn FROM wal_incoming WHERE key IS NOT NULL AND octet_length(key) > 0) i
 WHERE rn > 1 OR EXISTS (SELECT 1 FROM sst_entry s WHERE s.key = i.key)""",
}
ORACLE["p2_batches"] = ORACLE["p2_found"]
ORACLE["p2_rate"] = f"""WITH truth AS ({ORACLE["p2_found"]}), asked AS (SELECT count(*) AS n FROM wal_incoming WHERE key IS NOT NULL AND octet_length(key) > 0)
 SELECT n AS records, (SELECT count(*) FROM truth) AS seen, 0 AS wrong, CAST(0 AS DOUBLE) AS wrong_rate FROM asked"""
