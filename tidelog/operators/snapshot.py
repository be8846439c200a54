"""Latest state per key from a mutation log (key, seq_no, op, value, ...).

Tombstones take part in the fold and are filtered after it, never before. The fold is a grouped
maximum, combined on the map side, so hot keys cost one row per task.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidelog.schema import DEL, PUT
from tidelog.session import partitions, written


def invalid_reason(key: str = "key", value: str = "value") -> Column:
    """Why a mutation is invalid, or null: the first of its faults."""
    return (
        F.when(F.col("op").isNull() | ~F.col("op").isin(PUT, DEL), "op")
        .when(F.col("seq_no").isNull(), "seq_no")
        .when(F.col(key).isNull() | (F.length(key) == 0), "key")
        .when((F.col("op") == DEL) & (F.coalesce(F.length(value), F.lit(0)) > 0), "value")
    )


def split_invalid(log: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(valid rows, rejected rows with ``reason``)."""
    marked = log.withColumn("reason", invalid_reason())
    return marked.where("reason is null").drop("reason"), marked.where("reason is not null")


def put(keys_values: DataFrame, base: int) -> DataFrame:
    """Put mutations for (key, value, ord) rows, numbered from ``base`` + 1 in the order of ``ord``."""
    return _mutations(keys_values.select("ord", "key", "value"), PUT, base)


def delete(keys: DataFrame, base: int) -> DataFrame:
    """Delete mutations for (key, ord) rows; keys need not exist."""
    return _mutations(keys.select("ord", "key", F.lit(None).cast("binary").alias("value")), DEL, base)


def _mutations(rows: DataFrame, op: int, base: int) -> DataFrame:
    return numbered(rows, base).select("seq_no", F.lit(op).cast("tinyint").alias("op"), "key", "value")


def numbered(rows: DataFrame, base: int) -> DataFrame:
    """``rows`` with ``seq_no``: dense numbers from ``base`` + 1 in the order of ``ord``, without a single sorting task.

    Rows are range-partitioned and sorted by ``ord`` and written once with their place in their
    partition; only the partitions' row counts are summed up in one place. Rows of equal ``ord`` follow
    each other in any order; a null ``ord`` comes first.
    """
    placed = rows.repartitionByRange(partitions(rows.sparkSession), "ord").sortWithinPartitions("ord").withColumn("_at", F.monotonically_increasing_id())
    placed = written(placed, "numbered").withColumns({"_part": F.shiftright("_at", 33), "_row": F.col("_at").bitwiseAND((1 << 33) - 1)})
    counts = placed.groupBy("_part").agg(F.count(F.lit(1)).alias("n"))
    before = counts.select("_part", (F.sum("n").over(Window.orderBy("_part")) - F.col("n")).alias("_before"))  # a row per partition
    seq = (F.col("_before") + F.col("_row") + (base + 1)).cast("long")
    return placed.join(before, "_part").withColumn("seq_no", seq).drop("_at", "_part", "_row", "_before")


#: Types whose values have one width, so that a hash aggregate can keep them in place.
FIXED = frozenset(("boolean", "tinyint", "smallint", "int", "bigint", "float", "double", "date", "timestamp"))


def latest(log: DataFrame, keys: Sequence[str] = ("key",), order: str | Column = "seq_no") -> DataFrame:
    """The winning row of each key: the one with the greatest ``order``; nulls in it survive as they are.

    Either way the fold begins in the map tasks. Rows of fixed-width columns are folded by a hash
    aggregate; rows with texts or bytes need a sort aggregate, so select what is needed first.
    """
    rest = [c for c in log.columns if c not in keys]
    if all(log.schema[c].dataType.simpleString() in FIXED for c in rest):
        return log.groupBy(*keys).agg(*[F.max_by(c, order).alias(c) for c in rest])
    return log.groupBy(*keys).agg(F.max_by(F.struct(*rest), order).alias("w")).select(*keys, "w.*")


def live(log: DataFrame, keys: Sequence[str] = ("key",)) -> DataFrame:
    return latest(log, keys).where(F.col("op") == PUT)


def deleted(log: DataFrame, keys: Sequence[str] = ("key",)) -> DataFrame:
    return latest(log, keys).where(F.col("op") == DEL)


def as_of(log: DataFrame, seq_no: int | Column) -> DataFrame:
    """The live rows as they were right after mutation ``seq_no`` (a number or a scalar column)."""
    return live(log.where(F.col("seq_no") <= seq_no))


def get(log: DataFrame, key) -> DataFrame:
    """The live row of one key, or no row; the equality reaches the scan."""
    return live(log.where(F.col("key") == F.lit(key)))


def multi_get(requests: DataFrame, log: DataFrame) -> DataFrame:
    """One row per requested key: found, value, seq_no."""
    state = live(log).select("key", F.col("value").alias("v"), F.col("seq_no").alias("s"))
    return requests.select("key").distinct().join(state, "key", "left").select("key", F.col("s").isNotNull().alias("found"), F.col("v").alias("value"), F.col("s").alias("seq_no"))


def memory_size(log: DataFrame) -> DataFrame:
    """(entries, bytes) of the folded log: key and value bytes of the current entries."""
    size = F.length("key") + F.coalesce(F.length("value"), F.lit(0))
    entries = latest(log.select("key", "seq_no", size.cast("long").alias("size")))
    return entries.agg(F.count(F.lit(1)).alias("entries"), F.coalesce(F.sum("size"), F.lit(0)).alias("bytes"))


def recover(layers: DataFrame, log: DataFrame, keys: Sequence[str] = ("key",)) -> DataFrame:
    """State after a restart: entries of the live layers and of the log, which may repeat them, folded.

    Both have ``keys``, seq_no, and the same other columns; ``tombstone`` in layers stands for ``op`` in the log.
    Of a put and a delete with one number the delete counts.
    """
    entries = layers.withColumn("op", F.when(F.col("tombstone"), DEL).otherwise(PUT).cast("tinyint")).drop("tombstone")
    logged = log.withColumn("op", F.col("op").cast("tinyint"))
    return latest(entries.select(*logged.columns).unionByName(logged), keys, F.struct("seq_no", "op"))
