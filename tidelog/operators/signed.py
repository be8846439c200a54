"""Current state from an unordered, repeated change feed as a signed multiset (problem 3).

A change takes away its key's before-image (multiplicity -1) and brings its after-image (+1). The
after-image of a delete is a tombstone, so that older changes which arrive late cancel against it.
Summed over all deduplicated changes and the base, every image but the last of its key cancels,
whatever the order of delivery; images that keep a positive multiplicity are the state, and those
that are no tombstones are live.

A before-image is the after-image of the change before it, which asks for the changes of a key in
order. A key may hold a third of all rows, so no task orders a whole key: sequence numbers are cut
into chunks of ``2**CHUNK_BITS``. Within a chunk the images are emitted and summed; what remains is
the chunk's net change, its last image. Net changes are changes again, and are summed in the same way
within spans of ``2**SPAN_BITS`` numbers, and those over the key. A window thus meets at most
2**CHUNK_BITS, 2**(SPAN_BITS - CHUNK_BITS) and (last number / 2**SPAN_BITS) rows. Repeated deliveries
are merged in the map tasks, before anything is shuffled.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

PUT, DEL = 1, 2
#: Widths of the two inner levels at which images are summed.
CHUNK_BITS, SPAN_BITS = 10, 30


def is_valid(value: str = "value") -> Column:
    """seq_no present, op 1 or 2, key neither null nor empty, no value bytes on a delete.

    For filters: a null ``op`` gives null, which a filter drops; coalesce it before negating.
    """
    ok = F.col("seq_no").isNotNull() & F.col("op").isin(PUT, DEL) & F.col("key").isNotNull() & (F.length("key") > 0)
    return ok & ((F.col("op") == PUT) | F.col(value).isNull() | (F.length(value) == 0))


def changes(log: DataFrame) -> DataFrame:
    """(node_id, key, seq_no, op) of the valid changes, each once however often it was delivered.

    Of a put and a delete with one number (which valid logs lack) the delete counts.
    """
    valid = log.where(is_valid()).select("node_id", "key", "seq_no", "op")
    return valid.groupBy("node_id", "key", "seq_no").agg(F.max("op").alias("op"))


def images(steps: DataFrame, *group: str) -> DataFrame:
    """(group..., seq_no, op, sign): +1 for the after-image and -1 for the before-image of each change.

    ``steps`` (node_id, key, seq_no, op, ...) are changes with one row per number; the before-image is
    that of the change before it in its group, and the first change of a group has none there.
    """
    order = Window.partitionBy(*group).orderBy("seq_no")
    here = F.struct("seq_no", "op")
    signed = F.array(F.struct("seq_no", "op", F.lit(1).alias("sign")), F.struct("before.seq_no", "before.op", F.lit(-1).alias("sign")))
    each = steps.withColumn("before", F.lag(here).over(order)).select(*group, F.explode(signed).alias("i"))
    return each.select(*group, "i.*").where("seq_no is not null")


def net(steps: DataFrame, *group: str) -> DataFrame:
    """The images left in each group when multiplicities are summed: its net change (group..., seq_no, op)."""
    left = images(steps, *group).groupBy(*group, "seq_no").agg(F.sum("sign").alias("m"), F.max("op").alias("op"))
    return left.where("m > 0").drop("m")


def levels(log: DataFrame, base: DataFrame | None = None, chunk_bits: int = CHUNK_BITS, span_bits: int = SPAN_BITS) -> list[tuple[DataFrame, tuple[str, ...]]]:
    """The changes that are summed at each level, with their groups: per chunk, per span, per key with the base."""
    chunk, span = ("node_id", "key", "chunk"), ("node_id", "key", "span")
    first = changes(log).withColumn("chunk", F.shiftright("seq_no", chunk_bits))
    second = net(first, *chunk).select("node_id", "key", "seq_no", "op", F.shiftright("seq_no", span_bits).alias("span"))
    third = net(second, *span).select("node_id", "key", "seq_no", "op")
    if base is not None:  # a row of the base is the image of a change, which may be delivered again
        held = base.select("node_id", "key", "seq_no", F.col("op").cast("tinyint").alias("op"))
        third = third.withColumn("op", F.col("op").cast("tinyint")).unionByName(held).groupBy("node_id", "key", "seq_no").agg(F.max("op").alias("op"))
    return [(first, chunk), (second, span), (third, ("node_id", "key"))]


def state_images(log: DataFrame, base: DataFrame | None = None, chunk_bits: int = CHUNK_BITS, span_bits: int = SPAN_BITS) -> DataFrame:
    """(node_id, key, seq_no, op): the images of positive multiplicity, one per key, tombstones (op 2) included.

    ``base`` (node_id, key, seq_no, op, value) is the state before these changes, see ``state``.
    Invalid records are ignored; a null node_id is a node of its own; an empty log gives the base.
    """
    steps, group = levels(log, base, chunk_bits, span_bits)[-1]
    return net(steps, *group)


def live_images(log: DataFrame, base: DataFrame | None = None, **bits: int) -> DataFrame:
    """(node_id, key, seq_no) of the live rows."""
    return state_images(log, base, **bits).where(F.col("op") == PUT).drop("op")


def _with_values(found: DataFrame, log: DataFrame, base: DataFrame | None) -> DataFrame:
    """Live images with their values, which come from the valid deliveries of the image's (node_id, seq_no, key).

    Deliveries agree, and of disagreeing ones the greatest counts. The base's values serve for its own rows.
    """
    columns = ["node_id", "key", "seq_no", "value"]
    source = log.where(is_valid() & (F.col("op") == PUT)).select(*columns)
    if base is not None:
        source = source.unionByName(base.where(F.col("op") == PUT).select(*columns))
    l, s = found.alias("l"), source.alias("s")
    on = F.col("l.node_id").eqNullSafe(F.col("s.node_id")) & (F.col("l.seq_no") == F.col("s.seq_no")) & (F.col("l.key") == F.col("s.key"))
    return l.join(s, on).groupBy("l.node_id", "l.key", "l.seq_no").agg(F.max("s.value").alias("value"))


def live_rows(log: DataFrame, base: DataFrame | None = None, **bits: int) -> DataFrame:
    """The live rows with their values: (node_id, key, seq_no, value)."""
    return _with_values(live_images(log, base, **bits), log, base)


def state(log: DataFrame, base: DataFrame | None = None, **bits: int) -> DataFrame:
    """The base for the next changes: live rows (op 1) and the last delete of every dead key (op 2)."""
    every = state_images(log, base, **bits)
    live = _with_values(every.where(F.col("op") == PUT).drop("op"), log, base)
    live = live.select("node_id", "key", "seq_no", F.lit(PUT).cast("tinyint").alias("op"), "value")
    dead = every.where(F.col("op") == DEL).select("node_id", "key", "seq_no", F.col("op").cast("tinyint").alias("op"), F.lit(None).cast("binary").alias("value"))
    return live.unionByName(dead)
