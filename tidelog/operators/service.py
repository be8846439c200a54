"""Puts, gets and deletes of a batch as one pipeline: validate, route to the coordinator, apply by quorum, answer.

A batch is answered as a whole: its writes take effect in the order of their ids, its reads see them
all. Replicas that are down miss what they miss; nothing is repaired.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidelog.operators import quorum, ring, snapshot
from tidelog.schema import DEL, PUT
from tidelog.session import written

REQUEST = "request_id long, op string, key binary, value binary, entry_node string"


def fault() -> Column:
    """Why a request is invalid, or null: the first of its faults."""
    return (
        F.when(F.col("op").isNull() | ~F.col("op").isin("PUT", "GET", "DELETE"), "op")
        .when(F.col("key").isNull() | (F.length("key") == 0), "key")
        .when(F.coalesce(F.length("value"), F.lit(0)).cast("boolean") & (F.col("op") != "PUT"), "value")
    )


def handle(requests: DataFrame, cluster: ring.Ring, down: DataFrame, n: int, w: int, r: int, base: int = 0, log: DataFrame | None = None) -> DataFrame:
    """(request_id, status, coordinator, route, seq_no, acks, found, value), one row per request.

    Status is INVALID_ARGUMENT, UNAVAILABLE (fewer than ``w`` acknowledgements or ``r`` replies) or OK;
    a write that is not acknowledged by enough replicas stays on those it reached. A put without a value puts an empty one.
    ``log`` (key, seq_no, op, value) are earlier writes, of numbers up to ``base``. Outages (node_id, from_seq, to_seq) count
    for writes by their numbers, and for reads by the number of the batch's last write. Request ids must be unique.
    """
    spark = requests.sparkSession
    asked = requests.withColumn("fault", fault())
    good = cluster.place(asked.where("fault is null").drop("fault"), n)
    routed = ring.route(good, F.col("entry_node")).select("request_id", "op", "key", "value", "prefs", "coordinator", "route")
    routed = written(routed, "routed")

    writes = routed.where("op <> 'GET'").withColumn("ord", F.col("request_id"))
    numbered = written(snapshot.numbered(writes, base), "numbered")
    is_put = F.col("op") == "PUT"
    mutations = numbered.select(
        "request_id", "key", "seq_no", "prefs", F.when(is_put, PUT).otherwise(DEL).cast("tinyint").alias("op"), F.when(is_put, F.coalesce("value", F.lit(b""))).alias("value")
    )
    acks = quorum.write_outcomes(mutations, down, w)
    wrote = numbered.select("request_id", "coordinator", "route", "key", "seq_no").join(acks, ["key", "seq_no"]).select(
        "request_id", F.when(F.col("ok"), "OK").otherwise("UNAVAILABLE").alias("status"), "coordinator", "route", "seq_no", "acks", F.lit(None).cast("boolean").alias("found"), F.lit(None).cast("binary").alias("value")
    )

    history = mutations.drop("request_id")
    if log is not None:
        earlier = cluster.place(log.select("key", "seq_no", F.col("op").cast("tinyint").alias("op"), "value"), n).select(*history.columns)
        history = history.unionByName(earlier)
    keys = routed.where("op = 'GET'").select("key", "prefs", "coordinator").distinct()
    wanted = history.join(keys.select("key"), "key", "left_semi")
    last = numbered.agg(F.coalesce(F.max("seq_no"), F.lit(base))).first()[0]
    gone = sorted({x for x, a, b in quorum.outages(down) or () if a <= last <= b})
    read = quorum.read_outcomes(ring.replicas(keys), quorum.replica_state(wanted, down), r, unreachable=gone)
    read = read.select("key", F.col("status").alias("read_status"), F.col("value").alias("read_value"), F.col("seq_no").alias("read_seq"))
    answered = routed.where("op = 'GET'").select("request_id", "coordinator", "route", "key").join(read, "key").select(
        "request_id", F.when(F.col("read_status") == "UNAVAILABLE", "UNAVAILABLE").otherwise("OK").alias("status"), "coordinator", "route", F.col("read_seq").alias("seq_no"),
        F.lit(None).cast("long").alias("acks"), F.when(F.col("read_status") != "UNAVAILABLE", F.col("read_status") == "FOUND").alias("found"), F.col("read_value").alias("value"),
    )
    refused = asked.where("fault is not null").select(
        "request_id", F.lit("INVALID_ARGUMENT").alias("status"), F.lit(None).cast("string").alias("coordinator"), F.lit(None).cast("string").alias("route"), F.lit(None).cast("long").alias("seq_no"),
        F.lit(None).cast("long").alias("acks"), F.lit(None).cast("boolean").alias("found"), F.lit(None).cast("binary").alias("value"),
    )
    return wrote.unionByName(answered).unionByName(refused)
