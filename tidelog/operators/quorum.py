"""Quorum writes and reads over replicas, with nodes down for ranges of sequence numbers.

``down`` (node_id, from_seq, to_seq) is a table of outages; arrival order of read replies is a
column, so results are defined where a running cluster would race.

A few outages are tested in the row: every mutation carries its replica list, and the outages, whose
number is checked, are a constant of the expression. Neither acknowledgements nor the rows that reach
a replica need a shuffle then. More outages than MAX_OUTAGES are met in a join on node and block of
sequence numbers.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidelog.operators import incremental, snapshot
from tidelog.schema import PUT

#: So many outages at most are tested in the row.
MAX_OUTAGES = 1024


def outages(down: DataFrame, limit: int = MAX_OUTAGES) -> list[tuple[str, int, int]] | None:
    """The outages as a list, or None if there are more than ``limit``; those with a null in them cover nothing."""
    rows = down.where("node_id is not null and from_seq <= to_seq").select("node_id", "from_seq", "to_seq").limit(limit + 1).collect()
    return None if len(rows) > limit else sorted(map(tuple, rows))


def is_up(node: Column, seq_no: Column, gaps: list[tuple[str, int, int]]) -> Column:
    """Whether ``node`` was up at ``seq_no``."""
    up = F.lit(True)
    for name in sorted({g[0] for g in gaps}):
        spans = F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b")) for n, a, b in gaps if n == name])
        up = up & ~((node == name) & F.exists(spans, lambda s: seq_no.between(s["a"], s["b"])))
    return up


def applied(placed: DataFrame, down: DataFrame, limit: int = MAX_OUTAGES) -> DataFrame:
    """(node_id, ...) of ``placed`` (key, seq_no, prefs, ...): one row for each replica that was up."""
    gaps = outages(down, limit)
    rest = [c for c in placed.columns if c not in ("prefs", "coordinator", "node_id")]
    if gaps is not None:
        placed = placed.withColumn("prefs", F.filter("prefs", lambda n: is_up(n, F.col("seq_no"), gaps)))
    each = placed.select(*rest, F.explode("prefs").alias("node_id"))
    if gaps is None:
        each = incremental.not_covered(each, down.select("node_id", F.col("from_seq").alias("lo"), F.col("to_seq").alias("hi")))
    return each


def write_outcomes(placed: DataFrame, down: DataFrame, quorum: int, limit: int = MAX_OUTAGES) -> DataFrame:
    """(key, seq_no, acks, ok) of each mutation of ``placed`` (key, seq_no, prefs); every replica that is up applies.

    Mutations without any live replica stay in, with 0 acknowledgements. (key, seq_no) should be unique.
    """
    gaps = outages(down, limit)
    if gaps is not None:
        acks = placed.select("key", "seq_no", F.size(F.filter("prefs", lambda n: is_up(n, F.col("seq_no"), gaps))).cast("long").alias("acks"))
    else:
        reached = applied(placed.select("key", "seq_no", "prefs"), down, limit).select("key", "seq_no", F.lit(1).alias("one"))
        every = placed.select("key", "seq_no", F.lit(0).alias("one"))
        acks = every.unionByName(reached).groupBy("key", "seq_no").agg(F.sum("one").alias("acks"))
    return acks.withColumn("ok", F.col("acks") >= quorum)


def replica_state(placed: DataFrame, down: DataFrame, limit: int = MAX_OUTAGES) -> DataFrame:
    """The latest entry each node holds of each key, tombstones included; missed writes are not repaired."""
    return snapshot.latest(applied(placed, down, limit), ("node_id", "key"))


def arrival_by_hash() -> Column:
    """A fixed order of replies for (key, node_id) that no node is favoured by."""
    return F.sha1(F.concat("key", "node_id"))


def read_outcomes(replicas: DataFrame, state: DataFrame, quorum: int, arrival: Column | None = None, unreachable: list[str] = [], empty_is_missing: bool = False) -> DataFrame:
    """(key, status, value, seq_no) of reads of every key in ``replicas`` (key, node_id).

    The first ``quorum`` replies in order of arrival count, not found being a reply; the first of
    them that found the key gives the value. Fewer replies make the read UNAVAILABLE. There is no
    comparison of versions, so a stale or resurrected value can win. ``empty_is_missing`` treats an
    empty value as not found. A key has at most as many replies as replicas.
    """
    up = replicas.select("key", "node_id").withColumn("asked", ~F.col("node_id").isin(unreachable) if unreachable else F.lit(True))
    held = state.select("node_id", "key", "value", "seq_no", (F.col("op") == PUT).alias("is_put"))
    reply = up.withColumn("arr_key", arrival_by_hash() if arrival is None else arrival).join(held, ["key", "node_id"], "left")
    found = F.coalesce("is_put", F.lit(False))
    if empty_is_missing:
        found = found & (F.coalesce(F.length("value"), F.lit(0)) > 0)
    order = Window.partitionBy("key").orderBy(F.desc("asked"), "arr_key", "node_id")
    reply = reply.withColumn("found", found & F.col("asked")).withColumn("arr", F.row_number().over(order))
    counts = F.col("asked") & (F.col("arr") <= quorum)
    winner = F.min_by(F.struct("value", "seq_no"), F.when(counts & F.col("found"), F.col("arr"))).alias("v")
    read = reply.groupBy("key").agg(F.sum(counts.cast("int")).alias("replies"), winner, F.max(counts & F.col("found")).alias("any"))
    status = F.when(F.col("replies") < quorum, "UNAVAILABLE").when(F.col("any"), "FOUND").otherwise("NOT_FOUND")
    shown = F.when(F.col("status") == "FOUND", F.col("v"))
    return read.withColumn("status", status).select("key", "status", shown["value"].alias("value"), shown["seq_no"].alias("seq_no"))


def stale(state: DataFrame, truth: DataFrame) -> DataFrame:
    """(node_id, key, seq_no, latest_seq_no) where a node's entry is behind the newest of the key."""
    newest = truth.groupBy("key").agg(F.max("seq_no").alias("latest_seq_no"))
    return state.select("node_id", "key", "seq_no").join(newest, "key").where("seq_no < latest_seq_no").select("node_id", "key", "seq_no", "latest_seq_no")
