"""Differences between two copies of a table by characteristic-polynomial set reconciliation (problem 6).

Each side hashes its distinct rows and cuts them into buckets by key hash. A side sends, per bucket,
its row count, a 64-bit checksum and the values of the bucket's characteristic polynomial, the
product of (z - element), at m points of GF(2^31 - 1). The quotient of both sides' values is a
rational function whose numerator and denominator have as roots the rows only one side has; it is
interpolated from m values if at most m rows differ. Each side then finds which of its own rows are
roots. A bucket is settled when counts and checksums agree after taking the found rows away;
otherwise it is tried again with m doubled and other elements. A bucket whose m would exceed its rows
sends the row hashes themselves, which is then the shorter message. What crosses between the sides
grows with the differences, not with the rows. The differing rows are fetched and compared by field.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidelog.functions import modular as gf
from tidelog.session import partitions, ship, written

ROWS_PER_BUCKET, FIRST_BOUND = 64, 16


@dataclass(frozen=True)
class Keyed:
    """Which columns name a row and which are compared."""

    keys: list[str]
    fields: list[str]

    def key_hash(self) -> Column:
        return F.xxhash64(*self._marked(self.keys))

    def row_hash(self) -> Column:
        return F.xxhash64(*self._marked([*self.keys, *self.fields]))

    def _marked(self, names: list[str]) -> list[Column]:
        return [x for c in names for x in (F.col(c), F.col(c).isNull())]  # xxhash64 skips nulls


def row_hashes(rows: DataFrame, keyed: Keyed) -> DataFrame:
    """(kh, h) of the distinct rows; repeats of a row drop out before the shuffle."""
    return rows.select(keyed.key_hash().alias("kh"), keyed.row_hash().alias("h")).distinct()


def _by_bucket(df: DataFrame) -> DataFrame:
    return df.repartition(partitions(df.sparkSession), "bucket").sortWithinPartitions("bucket")


def sketches(hashes: DataFrame, m: int, seed: int) -> DataFrame:
    """(bucket, n, check, evals) of one side; ``evals`` are m values as 4-byte little-endian integers."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None  # the last bucket of a batch may go on in the next

        def out(bucket, n, check, evals):
            if not len(bucket):
                return []
            cells = [e.tobytes() for e in evals.astype("<u4")]
            return [pa.RecordBatch.from_arrays([pa.array(bucket, pa.int64()), pa.array(n, pa.int64()), pa.array(check.view(np.int64), pa.int64()), pa.array(cells, pa.binary())], names=["bucket", "n", "check", "evals"])]

        z = gf.points(m)
        for batch in batches:
            if not batch.num_rows:
                continue
            bucket, h = (batch.column(i).to_numpy(zero_copy_only=False) for i in (0, 1))
            starts = np.flatnonzero(np.concatenate(([True], bucket[1:] != bucket[:-1])))
            x = gf.elements(h.view(np.uint64), seed)
            evals = gf.segment_products((z[None, :] - x[:, None]) % gf.P, starts)
            check = np.add.reduceat(gf.mix(h.view(np.uint64), -2), starts)
            n = np.diff(np.append(starts, len(bucket)))
            now = [bucket[starts], n, check, evals]
            if held is not None and held[0][0] == now[0][0]:
                now[1][:1] += held[1]
                now[2][:1] += held[2]  # modulo 2^64
                now[3][:1] = now[3][:1] * held[3] % gf.P
            elif held is not None:
                yield from out(*held)
            held = [v[-1:].copy() for v in now]
            yield from out(*[v[:-1] for v in now])
        if held is not None:
            yield from out(*held)

    return _by_bucket(hashes.select("bucket", "h")).mapInArrow(run, "bucket long, n long, check long, evals binary")


def polynomials(pairs: DataFrame, m: int) -> DataFrame:
    """Of bucket pairs that differ: (bucket, num, den), where the interpolation has a solution."""
    per_call = max(1, (1 << 22) // (m * (m + 1)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, per_call):
                part = batch.slice(at, per_call)
                bucket, na, nb = (part.column(i).to_numpy(zero_copy_only=False) for i in range(3))
                ea, eb = (np.array([np.frombuffer(v.as_buffer(), "<u4") for v in part.column(i)]).astype(np.int64) for i in (3, 4))
                num, den, ok = gf.interpolate(ea * gf.inverse(eb) % gf.P, na - nb)
                w = np.flatnonzero(ok)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(bucket[w]), pa.array([num[i].astype("<u4").tobytes() for i in w], pa.binary()), pa.array([den[i].astype("<u4").tobytes() for i in w], pa.binary())], names=["bucket", "num", "den"]
                )

    return pairs.select("bucket", "na", "nb", "ea", "eb").mapInArrow(run, "bucket long, num binary, den binary")


def roots(hashes: DataFrame, solved: DataFrame, mine: str, other: str, seed: int) -> DataFrame:
    """(bucket, kh, h, mixed) of a side's rows that are roots of its polynomial and not of the other's."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            bucket, kh, h = (batch.column(i).to_numpy(zero_copy_only=False) for i in (0, 1, 2))
            x = gf.elements(h.view(np.uint64), seed)
            own, foreign = (np.array([np.frombuffer(v.as_buffer(), "<u4") for v in batch.column(i)]).astype(np.int64) for i in (3, 4))
            w = (gf.evaluate(own, x) == 0) & (gf.evaluate(foreign, x) != 0)
            mixed = gf.mix(h[w].view(np.uint64), -2).view(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in (bucket[w], kh[w], h[w], mixed)], names=["bucket", "kh", "h", "mixed"])

    return hashes.join(solved, "bucket").select("bucket", "kh", "h", mine, other).mapInArrow(run, "bucket long, kh long, h long, mixed long")


def _wrapping_sum(c: str) -> Column:
    """The sum modulo 2^64 of a long, as two 32-bit halves that cannot overflow."""
    low = F.sum(F.col(c).bitwiseAND(0xFFFFFFFF))
    high = F.sum(F.shiftrightunsigned(F.col(c), 32))
    carried = (high + F.shiftrightunsigned(low, 32)).bitwiseAND(0xFFFFFFFF)
    return F.coalesce(F.shiftleft(carried, 32).bitwiseOR(low.bitwiseAND(0xFFFFFFFF)), F.lit(0).cast("long"))


def _minus(a: Column, b: Column) -> Column:
    """a - b modulo 2^64 on longs, by halves."""
    low = a.bitwiseAND(0xFFFFFFFF) - b.bitwiseAND(0xFFFFFFFF)
    high = F.shiftrightunsigned(a, 32) - F.shiftrightunsigned(b, 32) + F.shiftright(low, 32)
    return F.shiftleft(high.bitwiseAND(0xFFFFFFFF), 32).bitwiseOR(low.bitwiseAND(0xFFFFFFFF))


@dataclass(frozen=True)
class Differing:
    """(kh, h) of the rows only ``a`` has and of those only ``b`` has; ``rounds`` (bound, buckets, solved, listed, tried_again)."""

    a: DataFrame
    b: DataFrame
    rounds: DataFrame


def differing_hashes(a: DataFrame, b: DataFrame, keyed: Keyed, per_bucket: int = ROWS_PER_BUCKET, first_bound: int = FIRST_BOUND) -> Differing:
    """The hashes of the rows only one side has. A row is named by its key's hash and its own, 128 bits together."""
    ship(a.sparkSession)
    sides = [written(row_hashes(df, keyed), "hashes") for df in (a, b)]
    buckets = max(1, max(s.count() for s in sides) // per_bucket)
    sides = [s.select(F.pmod("kh", F.lit(buckets)).alias("bucket"), "kh", "h") for s in sides]
    found: list[list[DataFrame]] = [[], []]
    rounds: list[DataFrame] = []
    open_, m, seed = None, first_bound, 0
    while True:
        now = sides if open_ is None else [s.join(open_, "bucket", "left_semi") for s in sides]
        sa, sb = (sketches(s, m, seed).select("bucket", *[F.col(c).alias(c[0] + k) for c in ("n", "check", "evals")]) for s, k in zip(now, "ab"))
        ones = F.lit(np.ones(m, "<u4").tobytes())
        pairs = sa.join(sb, "bucket", "full_outer").select(
            "bucket", *[F.coalesce(c, F.lit(0).cast("long")).alias(c) for c in ("na", "nb", "ca", "cb")], F.coalesce("ea", ones).alias("ea"), F.coalesce("eb", ones).alias("eb")
        )
        pairs = written(pairs.where("na != nb or ca != cb"), "pairs")
        small = F.lit(m) <= F.col("na") + F.col("nb")
        solved = written(polynomials(pairs.where(small).repartition(partitions(a.sparkSession)), m), "polynomials")  # much work per row
        hits = [written(roots(s, solved, *names, seed), "roots") for s, names in zip(now, (("num", "den"), ("den", "num")))]
        known = pairs.select("bucket", "na", "nb", "ca", "cb")
        for r, k in zip(hits, "ab"):
            known = known.join(r.groupBy("bucket").agg(F.count(F.lit(1)).alias("f" + k), _wrapping_sum("mixed").alias("g" + k)), "bucket", "left")
        zero = F.lit(0).cast("long")
        fa, fb, ga, gb = (F.coalesce(c, zero) for c in ("fa", "fb", "ga", "gb"))
        right = (F.col("na") - fa == F.col("nb") - fb) & (_minus(F.col("ca"), ga) == _minus(F.col("cb"), gb))
        verdict = written(known.select("bucket", right.alias("right"), (F.lit(2 * m) > F.col("na") + F.col("nb")).alias("listed")), "verdict")
        settled = verdict.where("right").select("bucket")
        for k in (0, 1):
            found[k].append(hits[k].join(settled, "bucket", "left_semi").select("kh", "h"))
        listed = verdict.where("not right and listed").select("bucket")  # the hashes are the shorter message
        for k in (0, 1):
            found[k].append(now[k].join(listed, "bucket", "left_semi").join(now[1 - k].join(listed, "bucket", "left_semi"), ["bucket", "kh", "h"], "left_anti").select("kh", "h"))
        in_round = lambda c: F.coalesce(F.sum(c.cast("long")), F.lit(0)).cast("long")
        solved_, listed_ = F.col("right"), ~F.col("right") & F.col("listed")
        rounds.append(verdict.agg(F.lit(m).alias("bound"), F.count(F.lit(1)).alias("buckets"), in_round(solved_).alias("solved"), in_round(listed_).alias("listed"), in_round(~solved_ & ~listed_).alias("tried_again")))
        open_ = verdict.where("not right and not listed").select("bucket")
        if open_.isEmpty():
            break
        m, seed = 2 * m, seed + 1
    union = lambda parts: reduce(DataFrame.union, parts)
    return Differing(*[written(union(parts), "differing") for parts in found], union(rounds))


def differences(a: DataFrame, b: DataFrame, keyed: Keyed, names: tuple[str, str] = ("only_a", "only_b")) -> DataFrame:
    """(keys..., diff): ``diff`` is a name in ``names`` for a row without counterpart, else a differing field.

    Rows are matched by the key columns, where null equals null; repeats of equal rows count once.
    A null field differs from everything but null. The keys must be unique among the distinct rows
    of a side; where they are not, each row that the other side lacks is compared with the other
    side's unmatched rows of its key. Other columns are ignored. Empty tables are allowed.
    """
    fetched = []
    hashes = differing_hashes(a, b, keyed)
    for rows, named in ((a, hashes.a), (b, hashes.b)):
        own = rows.select(*keyed.keys, *keyed.fields).withColumns({"_kh": keyed.key_hash(), "_h": keyed.row_hash()})
        wanted = named.select(F.col("kh").alias("_kh"), F.col("h").alias("_h"))
        fetched.append(own.join(wanted, ["_kh", "_h"], "left_semi").drop("_kh", "_h").distinct().withColumn("_there", F.lit(True)))
    x, y = fetched[0].alias("x"), fetched[1].alias("y")
    on = F.lit(True)
    for c in keyed.keys:
        on = on & F.col(f"x.{c}").eqNullSafe(F.col(f"y.{c}"))
    both = F.col("x._there").isNotNull() & F.col("y._there").isNotNull()
    kinds = [F.when(F.col("y._there").isNull(), F.lit(names[0])), F.when(F.col("x._there").isNull(), F.lit(names[1]))]
    kinds += [F.when(both & ~F.col(f"x.{c}").eqNullSafe(F.col(f"y.{c}")), F.lit(c)) for c in keyed.fields]
    keys = [F.when(F.col("x._there"), F.col(f"x.{c}")).otherwise(F.col(f"y.{c}")).alias(c) for c in keyed.keys]
    return x.join(y, on, "full_outer").select(*keys, F.explode(F.array_compact(F.array(*kinds))).alias("diff"))


STORE = Keyed(["layer_id", "key"], ["value", "seq_no", "tombstone"])
