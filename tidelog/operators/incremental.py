"""Processing only new or changed records, with the target as the only state (problem 4).

There is no separate cursor to lose: the published target rows carry the key and version of the
source record they came from, and what is pending is the source anti-joined against them. A run
writes its rows to a folder of its own and then publishes the next target version by one rename, so
a failed run leaves nothing visible and is simply run again. Where a target (a store of merged
layers) keeps the taken-up sequence numbers as ranges, those ranges stand for its rows.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidelog.sources import publish

BLOCK_BITS = 16


def committed_ranges(manifest: DataFrame, runs: DataFrame) -> DataFrame:
    """(node_id, lo, hi) of the table entries whose run committed; a range with a null end covers nothing."""
    good = runs.where(F.col("status") == "committed").select("run_id").distinct()
    named = manifest.select("node_id", "run_id", F.col("min_seq_no").alias("lo"), F.col("max_seq_no").alias("hi"))
    return named.where("node_id is not null and lo <= hi").distinct().join(good, "run_id", "left_semi").drop("run_id")


def coverage(ranges: DataFrame, blocks: DataFrame, block_bits: int = BLOCK_BITS) -> DataFrame:
    """(node_id, block, lo, hi): disjoint covered ranges for each (node_id, block) of ``blocks``.

    Sequence numbers are cut into blocks of ``2**block_bits``. Per start of a range the farthest end
    suffices, so a block has at most that many range starts; within a block overlapping ranges are
    merged in order of their starts, and across blocks only the farthest end so far is carried. No
    range is expanded, however long it is, and no group is larger than a block or a node's list of blocks.
    """
    starts = ranges.groupBy("node_id", F.shiftright("lo", block_bits).alias("block"), "lo").agg(F.max("hi").alias("hi"))
    by_block = Window.partitionBy("node_id", "block").orderBy("lo")
    reach = F.max("hi").over(by_block.rowsBetween(Window.unboundedPreceding, -1))
    island = F.sum("new").over(by_block)
    merged = (
        starts.withColumn("new", F.coalesce((F.col("lo") > reach + 1).cast("int"), F.lit(1)))
        .withColumn("island", island)
        .groupBy("node_id", "block", "island")
        .agg(F.min("lo").alias("lo"), F.max("hi").alias("hi"))
        .drop("island")
    )
    ends = merged.groupBy("node_id", "block").agg(F.max("hi").alias("hi"), F.lit(False).alias("asked"))
    asked = blocks.select("node_id", "block", F.lit(None).cast("long").alias("hi"), F.lit(True).alias("asked"))
    steps = ends.unionByName(asked).groupBy("node_id", "block").agg(F.max("hi").alias("hi"), F.max("asked").alias("asked"))
    by_node = Window.partitionBy("node_id").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    carried = steps.withColumn("hi", F.max("hi").over(by_node)).withColumn("lo", F.shiftleft("block", block_bits))
    return merged.unionByName(carried.where("asked and hi >= lo").select("node_id", "block", "lo", "hi"))


def not_covered(source: DataFrame, ranges: DataFrame, block_bits: int = BLOCK_BITS) -> DataFrame:
    """The rows of ``source`` (node_id, seq_no, ...) in no range of their node.

    A null node_id has no ranges; rows with a null seq_no are in none. Both come out.
    """
    block = F.shiftright("seq_no", block_bits)
    blocks = source.where("node_id is not null and seq_no is not null").select("node_id", block.alias("block")).distinct()
    s, c = source.withColumn("_tidelog_block", block).alias("s"), coverage(ranges, blocks, block_bits).alias("c")
    on = (F.col("s.node_id") == F.col("c.node_id")) & (F.col("s._tidelog_block") == F.col("c.block")) & F.col("s.seq_no").between(F.col("c.lo"), F.col("c.hi"))
    return s.join(c, on, "left_anti").drop("_tidelog_block")


class IncrementalTarget:
    """A table under ``path`` that takes up each source record, by ``key`` and ``version`` columns, once.

    ``ranges`` (node_id, lo, hi) are sequence numbers already taken up before this table began.
    """

    def __init__(self, spark: SparkSession, path: str, key: list[str], version: list[str] = [], ranges: DataFrame | None = None):
        self.spark, self.path, self.identity, self.ranges = spark, path, [*key, *version], ranges

    def published(self) -> int:
        return publish.latest_version(self.spark, f"{self.path}/versions")

    def rows(self) -> DataFrame | None:
        """The published rows with ``target_version``; None before the first version."""
        if not (v := self.published()):
            return None
        folders = publish.load(self.spark, f"{self.path}/versions", v)["folders"]
        return self.spark.read.parquet(*folders)

    def pending(self, source: DataFrame) -> DataFrame:
        """Source records whose (key, version) no published row carries, one per identity.

        Nulls in the identity are equal to each other. Of repeated deliveries one is kept; they are
        reduced per task before the shuffle, so many copies of one record meet in no single task.
        """
        todo = not_covered(source, self.ranges) if self.ranges is not None else source
        done = self.rows()
        if done is not None:
            t, d = todo.alias("t"), done.select(*self.identity).alias("d")
            on = F.lit(True)
            for c in self.identity:
                on = on & F.col(f"t.{c}").eqNullSafe(F.col(f"d.{c}"))
            todo = t.join(d, on, "left_anti")
        return todo.dropDuplicates(self.identity)

    def run(self, source: DataFrame, process: Callable[[DataFrame], DataFrame] = lambda df: df, before_publish: Callable[[], None] = lambda: None) -> int:
        """Process what is pending and publish the next version; returns its number.

        ``process`` must keep the identity columns. Rows written by a run that fails before the
        rename stay invisible; running again neither skips nor repeats a record.
        """
        base = self.published()
        folder = f"{self.path}/rows/{base + 1:012d}-{uuid.uuid4().hex}"
        before = publish.load(self.spark, f"{self.path}/versions", base)["folders"] if base else []
        process(self.pending(source)).withColumn("target_version", F.lit(base + 1).cast("long")).write.mode("overwrite").parquet(folder)
        before_publish()
        publish.publish(self.spark, f"{self.path}/versions", base + 1, {"folders": [*before, folder]})
        return base + 1

    def vacuum(self) -> int:
        """Remove the rows of failed runs, which no version names; the number of folders removed. No run may be under way."""
        v = self.published()
        named = {f.rsplit("/", 1)[-1] for f in (publish.load(self.spark, f"{self.path}/versions", v)["folders"] if v else [])}
        return publish.remove_unnamed(self.spark, f"{self.path}/rows", "", named)
