"""Per-key results where a few keys hold most rows (problem 1).

Eager aggregation: each input is reduced to one compact state per join key before anything is
joined. Partial aggregation on the map side turns a hot key into at most one row per map task, so
no task sees its rows; the join then meets one row per key and side, and what the join of the raw
rows would have given is computed from the states: counts multiply, and a sum of one side is
scaled by the count of the other.
"""

from __future__ import annotations

from collections.abc import Mapping
from decimal import Decimal

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

WIDE = "decimal(38,0)"


def key_states(rows: DataFrame, key: str, sums: Mapping[str, Column], maxima: Mapping[str, Column] = {}) -> DataFrame:
    """One row per key: ``_key``, ``_none``, ``n``, and the named sums and maxima.

    A null key is a group of its own, distinct from the empty key: ``_none`` tells them apart, and
    both columns are non-null so that a later equi-join on them reuses this partitioning.
    """
    aggs = [F.count(F.lit(1)).alias("n")]
    aggs += [F.sum(c).alias(k) for k, c in sums.items()] + [F.max(c).alias(k) for k, c in maxima.items()]
    return rows.groupBy(F.coalesce(F.col(key), F.lit(b"")).alias("_key"), F.col(key).isNull().alias("_none")).agg(*aggs)


def join_states(left: DataFrame, right: DataFrame, prefixes: tuple[str, str] = ("l_", "r_"), how: str = "full_outer") -> DataFrame:
    """The states of both sides per key; columns of a side get its prefix, absent sides count 0 rows."""
    on = ["_key", "_none"]
    sides = [df.select(*on, *[F.col(c).alias(p + c) for c in df.columns if c not in on]) for df, p in zip((left, right), prefixes, strict=True)]
    joined = sides[0].join(sides[1], on, how)
    return joined.withColumns({p + "n": F.coalesce(p + "n", F.lit(0)) for p in prefixes})


def eager_join_aggregate(
    left: DataFrame, right: DataFrame, key: str, left_sums: Mapping[str, Column] = {}, right_sums: Mapping[str, Column] = {}, rollup: Column | None = None
) -> DataFrame:
    """Counts and sums over ``left JOIN right ON key`` without producing the joined rows.

    Result per key, or per value of ``rollup`` (an expression over ``key``): ``pairs`` and one
    column per requested sum, all decimal(38,0). Null keys join nothing, as in SQL; empty keys are
    keys like any other. Empty inputs give an empty result. A sum over only nulls is null.
    """
    a = key_states(left.where(F.col(key).isNotNull()), key, left_sums)
    b = key_states(right.where(F.col(key).isNotNull()), key, right_sums)
    j = join_states(a, b, how="inner")
    n1, n2 = F.col("l_n").cast(WIDE), F.col("r_n").cast(WIDE)
    per_key = j.select(
        F.col("_key").alias(key),
        (F.col("l_n").cast("decimal(19,0)") * F.col("r_n").cast("decimal(19,0)")).cast(WIDE).alias("pairs"),
        *[(F.col("l_" + c).cast("decimal(19,0)") * F.col("r_n").cast("decimal(19,0)")).cast(WIDE).alias(c) for c in left_sums],
        *[(F.col("r_" + c).cast("decimal(19,0)") * F.col("l_n").cast("decimal(19,0)")).cast(WIDE).alias(c) for c in right_sums],
    )
    if rollup is None:
        return per_key
    return per_key.groupBy(rollup.alias("grp")).agg(*[F.sum(c).cast(WIDE).alias(c) for c in ("pairs", *left_sums, *right_sums)])


def store_key_states(wal: DataFrame, sst: DataFrame) -> DataFrame:
    """Row count, latest sequence number and bytes of every key in the log and in the layers.

    Columns ``_key``, ``_none`` (true for the null key), and with prefixes ``wal_`` and ``sst_``:
    ``n``, ``bytes``, ``latest``. Repeated and invalid rows count; a null value has no bytes; a key
    whose sequence numbers are all null has a null ``latest``. Empty tables give no keys.
    """
    size = F.length("key").cast("long") + F.coalesce(F.length("value"), F.lit(0)).cast("long")
    bytes_ = {"bytes": F.coalesce(size, F.coalesce(F.length("value"), F.lit(0)).cast("long"))}
    latest = {"latest": F.col("seq_no")}
    return join_states(key_states(wal, "key", bytes_, latest), key_states(sst, "key", bytes_, latest), ("wal_", "sst_"))


def heavy_keys(wal: DataFrame, sst: DataFrame, share: Decimal = Decimal("0.01")) -> DataFrame:
    """(tab, key_hex) of the keys, neither null nor empty, with at least ``share`` of a table's rows.

    Totals are rolled up from the same states, so each table is read once for both.
    """
    states = store_key_states(wal, sst)
    total = states.agg(F.sum("wal_n").alias("w"), F.sum("sst_n").alias("s")).select(F.struct("w", "s")).scalar()
    known = states.where(~F.col("_none") & (F.length("_key") > 0))
    sides = F.array(
        F.struct(F.lit("wal_record").alias("tab"), F.col("wal_n").alias("n"), total["w"].alias("total")),
        F.struct(F.lit("sst_entry").alias("tab"), F.col("sst_n").alias("n"), total["s"].alias("total")),
    )
    each = known.select(F.lower(F.hex("_key")).alias("key_hex"), F.explode(sides).alias("x"))
    return each.where((F.col("x.n") > 0) & (F.col("x.n") >= F.lit(share) * F.col("x.total"))).select("x.tab", "key_hex")
