"""Consistent-hash placement: tokens, preference lists, coordinators and routing.

A ring has nodes times virtual nodes tokens; its size is checked, and it reaches the tasks as a small
table of segments. Positions are the first 16 hex digits of SHA-1, whose order as text
is the order of the unsigned numbers.
"""

from __future__ import annotations

import hashlib
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidelog.schema import InvalidArgument, Peer

VNODES = 32
#: Above so many tokens the ring is too large to be broadcast.
MAX_TOKENS = 1 << 16


def position(key: Column | str) -> Column:
    return F.substring(F.sha1(key), 1, 16)


@dataclass(frozen=True)
class Ring:
    nodes: tuple[Peer, ...]
    vnodes: int = VNODES

    def __post_init__(self) -> None:
        if not self.nodes or self.vnodes < 1:
            raise InvalidArgument("a ring needs nodes and virtual nodes")
        if len({n.node_id for n in self.nodes}) < len(self.nodes) or not all(n.node_id for n in self.nodes):
            raise InvalidArgument("node ids must be distinct and not empty")
        if len(self.nodes) * self.vnodes > MAX_TOKENS:
            raise InvalidArgument(f"more than {MAX_TOKENS} tokens")

    def tokens(self, spark: SparkSession) -> DataFrame:
        """(token, node_id, addr, vnode), unordered."""
        nodes = spark.createDataFrame([(n.node_id, n.listen_addr) for n in self.nodes], "node_id string, addr string")
        each = nodes.withColumn("vnode", F.explode(F.sequence(F.lit(0), F.lit(self.vnodes - 1))))
        return each.select(position(F.concat_ws("#", "node_id", "vnode")).alias("token"), "node_id", "addr", "vnode")

    def segments(self, spark: SparkSession, n: int) -> DataFrame:
        """(prefix, lo, hi, prefs): the preference list of positions in lo < pos <= hi, per leading hex digits.

        A segment ends at each token and lies once under every prefix it touches, so a position finds
        its one row by an equi-join on its prefix. There are at most tokens + 16**digits + 1 rows.
        """
        ring = sorted((hashlib.sha1(f"{p.node_id}#{v}".encode()).hexdigest()[:16], p.node_id) for p in self.nodes for v in range(self.vnodes))
        names = [node for _, node in ring]
        digits = 2 if len(ring) <= 256 else 3
        ends = [t for t, _ in ring] + ["f" * 16]
        rows, lo = [], ""
        for i, hi in enumerate(ends):
            clockwise = names[i % len(ring) :] + names[: i % len(ring)]
            prefs = list(dict.fromkeys(clockwise))[:n]
            rows += [(f"{p:0{digits}x}", lo, hi, prefs) for p in range(int(lo[:digits] or "0", 16), int(hi[:digits], 16) + 1)]
            lo = hi
        return spark.createDataFrame(rows, "prefix string, lo string, hi string, prefs array<string>")

    def place(self, keys: DataFrame, n: int) -> DataFrame:
        """``keys`` (key, ...) with ``prefs``, the first ``n`` distinct nodes clockwise from the key (fewer if
        there are fewer nodes), and ``coordinator``. Null keys have no place and drop out.
        """
        segments = self.segments(keys.sparkSession, n)
        digits = len(segments.first()["prefix"])
        pos = keys.withColumn("_pos", position("key"))
        on = (F.substring("_pos", 1, digits) == F.col("prefix")) & (F.col("_pos") > F.col("lo")) & (F.col("_pos") <= F.col("hi"))
        placed = pos.join(F.broadcast(segments), on).drop("_pos", "prefix", "lo", "hi")  # bounded by MAX_TOKENS
        return placed.withColumn("coordinator", F.col("prefs")[0])


def local_index(prefs: str, node: Column) -> Column:
    """Zero-based place of a node in the list, -1 if it is no replica."""
    return (F.array_position(prefs, node) - 1).cast("int")


def replicas(placed: DataFrame) -> DataFrame:
    """One row per key and replica: node_id and ``pref`` from 1."""
    return placed.select("*", F.posexplode("prefs").alias("p0", "node_id")).withColumn("pref", F.col("p0") + 1).drop("p0", "prefs", "coordinator")


def ownership(placed: DataFrame) -> DataFrame:
    """Keys per coordinator."""
    return placed.groupBy(F.col("coordinator").alias("node_id")).agg(F.count(F.lit(1)).alias("keys"))


def route(placed: DataFrame, entry_node: Column, single_copy_forwarding: bool = False) -> DataFrame:
    """How a request entering at ``entry_node`` runs: locally, or forwarded to the coordinator.

    ``targets`` are the nodes that apply it. Forwarded requests reach the full preference list; with
    ``single_copy_forwarding`` they stop at the coordinator's own copy, as a store that marks
    forwarded and replicated requests alike would do.
    """
    local = F.col("coordinator") == entry_node
    full = local if single_copy_forwarding else F.lit(True)
    targets = F.when(full, F.col("prefs")).otherwise(F.array("coordinator"))
    return placed.withColumn("entry_node", entry_node).withColumn("route", F.when(local, "local").otherwise("forward")).withColumn("targets", targets)


def cluster(peers: Sequence[Peer]) -> Ring:
    return Ring(tuple(peers))
