"""Mixing sources to target weights by cube-method balanced sampling (problem 8).

A source with weight w should give w times the size of the mixture, which is a parameter and without
one the total of tokens. Each of its documents is used
floor(f) times, f being the wanted over the available tokens, capped at ``max_repeats``; which
documents are used once more, with probability f - floor(f) each, is sampled by the cube method: the
vector of inclusion probabilities moves through the null space of the balancing constraints (tokens
and number of documents), so both totals keep their expected values exactly until fewer units are
undecided than there are constraints.

The flight runs in blocks of bounded size within a source; a block leaves at most two undecided
documents, which meet again in the blocks of the next round, until a source is a single block. Only
its last units are landed. A source with a third of all rows is many blocks in the first round.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Callable
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidelog.llm.tokenize import token_counts
from tidelog.session import ship, written

BLOCK = 2048
EPS = 1e-9


def flight(p: np.ndarray, sizes: np.ndarray, rng: np.random.Generator) -> np.ndarray:
    """Move probabilities ``p`` to 0 or 1, keeping sum(p) and sum(p * sizes), until two or fewer are undecided.

    Three undecided units always have a direction in the null space of the two constraints; both
    ways along it end at a face of the cube, and the chance of each keeps every expectation.
    """
    p = p.astype(float).copy()
    p[p < EPS], p[p > 1 - EPS] = 0.0, 1.0
    waiting = list(np.flatnonzero((p > 0) & (p < 1)))[::-1]
    held: list[int] = []
    draws = rng.random(len(waiting) + 3)
    used = 0
    while True:
        while len(held) < 3 and waiting:
            held.append(waiting.pop())
        if len(held) < 3:
            return p
        a, b, c = (float(sizes[i]) for i in held)
        u = (b - c, c - a, a - b)
        if u == (0.0, 0.0, 0.0):
            u = (1.0, -1.0, 0.0)
        up = min(((1 - p[i]) / x if x > 0 else p[i] / -x) for i, x in zip(held, u) if x)
        down = min((p[i] / x if x > 0 else (1 - p[i]) / -x) for i, x in zip(held, u) if x)
        step = up if draws[used] * (up + down) < down else -down
        used += 1
        for i, x in zip(held, u):
            p[i] += step * x
            if p[i] < EPS:
                p[i] = 0.0
            elif p[i] > 1 - EPS:
                p[i] = 1.0
        held = [i for i in held if 0 < p[i] < 1]


def land(p: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Decide the one or two units left: of all decisions, the one whose token total is nearest."""
    open_ = np.flatnonzero((p > 0) & (p < 1))
    if not len(open_):
        return p
    want = float((p[open_] * sizes[open_]).sum())
    best = min(range(1 << len(open_)), key=lambda m: abs(sum(sizes[j] for k, j in enumerate(open_) if m >> k & 1) - want))
    p = p.copy()
    for k, j in enumerate(open_):
        p[j] = float(best >> k & 1)
    return p


#: What tells units apart: a document and, among rows equal in all of it, a number.
UNIT = ["doc_id", "source", "tokens", "dup"]


def _flyer(seed: int, round_: int, last: bool) -> Callable[[tuple, pd.DataFrame], pd.DataFrame]:
    def fly(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["doc_id", "tokens", "dup"])
        size = pdf["tokens"].to_numpy()
        rng = np.random.default_rng([seed, round_, zlib.crc32(repr(key).encode())])
        p = flight(pdf["p"].to_numpy(), size, rng)
        return pdf.assign(p=land(p, size) if last else p)

    return fly


def plan(sizes: DataFrame, targets: DataFrame, size: int | None = None) -> DataFrame:
    """One row per source of ``targets``: documents, tokens, wanted tokens, repeats and how often a document is used.

    ``sizes`` (source, tokens) counts only sources in ``targets``; ``size`` is the wanted number of
    tokens of the mixture, by default all of theirs. A source without documents has 0
    tokens. Of several target rows of a source the one with the
    greatest weight counts; a null weight or ``max_repeats`` is 0.
    """
    have = sizes.groupBy("source").agg(F.count(F.lit(1)).alias("documents"), F.sum("tokens").alias("tokens"))
    row = F.struct(F.coalesce("weight", F.lit(0.0)).alias("weight"), F.coalesce("max_repeats", F.lit(0)).alias("max_repeats"))
    named = targets.where("source is not null").groupBy("source").agg(F.max(row).alias("t")).select("source", "t.weight", "t.max_repeats")
    each = named.join(have, "source", "left").na.fill(0, ["documents", "tokens"])
    total = have.agg(F.coalesce(F.sum("tokens"), F.lit(0).cast("long")).alias("t")).scalar() if size is None else F.lit(size).cast("long")
    wanted = F.col("weight") * total
    cap = F.col("max_repeats").cast("double")
    factor = F.when(F.col("tokens") > 0, F.least(wanted / F.col("tokens"), cap)).otherwise(F.when(F.col("weight") > 0, cap).otherwise(F.lit(0.0)))
    return each.select("source", "weight", "max_repeats", "documents", "tokens", total.alias("total_tokens"), wanted.alias("wanted"), factor.alias("factor"))


def units(sizes: DataFrame) -> DataFrame:
    """(doc_id, source, tokens, dup): every row of ``sizes``, equal ones numbered from 0.

    Equal rows are counted before the shuffle, so many copies of one row meet in no task.
    """
    counted = sizes.groupBy("doc_id", "source", "tokens").agg(F.count(F.lit(1)).cast("int").alias("n"))
    return counted.select("doc_id", "source", "tokens", F.explode(F.sequence(F.lit(0), F.col("n") - 1)).alias("dup"))


def mixture(documents: DataFrame, targets: DataFrame, seed: int = 0, block: int = BLOCK, size: int | None = None) -> tuple[DataFrame, DataFrame]:
    """(copies, report).

    ``copies`` (doc_id, source, tokens, copies): every document of a target source and how often it
    is used, 0 to ``max_repeats`` times. ``report``: the plan with the documents and tokens used, the
    share reached, and whether the source is short: the sample has used each of its documents
    ``max_repeats`` times and still holds fewer tokens than wanted. The same seed gives the same sample,
    however the rows are partitioned. Documents of other or null sources are left out; null and empty
    texts have no tokens and are sampled for the document total only. Empty tables give an empty
    mixture. Repeated rows are units of their own.
    """
    spark = ship(documents.sparkSession)
    own = documents.join(targets.select("source").distinct(), "source", "left_semi")
    sizes = written(token_counts(own, ["doc_id", "source"]), "tokens")
    sources = written(plan(sizes, targets, size), "plan")
    each = units(sizes).join(sources.select("source", "factor"), "source")
    each = each.withColumn("base", F.floor("factor").cast("int")).withColumn("p", F.col("factor") - F.col("base")).drop("factor")
    each = written(each, "units")
    kept = [*UNIT, "base"]
    is_open = (F.col("p") > EPS) & (F.col("p") < 1 - EPS)
    decided = [each.where(~is_open).select(*kept, (F.col("p") > 0.5).cast("int").alias("extra"))]
    open_ = each.where(is_open).select(*kept, "p")
    most = lambda df: max((r[0] for r in df.groupBy("source").count().select(F.max("count")).collect() if r[0]), default=0)
    left, round_ = most(open_), 0
    schema = f"doc_id {documents.schema['doc_id'].dataType.simpleString()}, source string, tokens long, dup int, base int, p double, block long"
    while left:
        blocks = math.ceil(left / block)
        grouped = open_.withColumn("block", F.pmod(F.xxhash64("doc_id", "tokens", "dup", F.lit(seed), F.lit(round_)), F.lit(blocks)))
        flown = grouped.groupBy("source", "block").applyInPandas(_flyer(seed, round_, blocks == 1), schema)
        flown = written(flown.drop("block"), "flight")
        decided.append(flown.where("p = 0 or p = 1").select(*kept, F.col("p").cast("int").alias("extra")))
        open_ = flown.where("p > 0 and p < 1").select(*kept, "p")
        left, round_ = most(open_), round_ + 1
    copies = reduce(DataFrame.union, decided).select("doc_id", "source", "tokens", (F.col("base") + F.col("extra")).alias("copies"))
    copies = written(copies, "copies")
    used = copies.groupBy("source").agg(F.sum("copies").alias("used_documents"), F.sum(F.col("copies") * F.col("tokens")).alias("used_tokens"), F.max("copies").alias("most_copies"))
    report = sources.join(used, "source", "left").na.fill(0, ["used_documents", "used_tokens", "most_copies"])
    at_the_cap = F.col("used_documents") == F.col("max_repeats") * F.col("documents")
    report = report.withColumn("short", at_the_cap & (F.col("used_tokens") < F.col("wanted")))
    mixed = used.agg(F.sum("used_tokens").alias("t")).scalar()
    share = F.when(mixed > 0, F.col("used_tokens") / mixed).otherwise(F.lit(0.0))
    return copies, report.withColumn("share", share)


def largest_exact(report: DataFrame) -> DataFrame:
    """(tokens): the size of the largest mixture in which every source with documents reaches its weight; null without one.

    That is the least of max_repeats * tokens / weight. Sources without any tokens reach nothing at any size and are left out.
    """
    able = report.where("weight > 0 and tokens > 0")
    return able.agg(F.floor(F.min(F.col("max_repeats") * F.col("tokens") / F.col("weight"))).alias("tokens"))


def faults(copies: DataFrame, report: DataFrame) -> DataFrame:
    """(source, fault) of everything a mixture may not have; no rows if it is right.

    'cap': a document is used too often. 'documents': not every document has exactly one row. 'total':
    the report's tokens are not those of the copies. 'target': a source that is not short misses its
    wanted tokens by more than its two largest documents, which is what landing decides.
    """
    seen = copies.groupBy("source").agg(
        F.max("copies").alias("top"), F.min("copies").alias("low"), F.count(F.lit(1)).alias("n"), F.sum(F.col("copies") * F.col("tokens")).alias("sum"), F.max("tokens").alias("longest")
    )
    j = report.join(seen, "source", "left").na.fill(0, ["top", "low", "n", "sum", "longest"])
    missed = F.abs(F.col("used_tokens") - F.col("wanted")) > 2 * F.col("longest")
    checks = {
        "cap": (F.col("top") > F.col("max_repeats")) | (F.col("low") < 0), "documents": F.col("n") != F.col("documents"), "total": F.col("sum") != F.col("used_tokens"),
        "target": ~F.col("short") & missed,
    }
    return j.select("source", F.explode(F.array_compact(F.array(*[F.when(c, F.lit(n)) for n, c in checks.items()]))).alias("fault"))


def materialize(documents: DataFrame, copies: DataFrame) -> DataFrame:
    """The mixture itself: each document as often as it is used, with ``copy`` from 1."""
    used = copies.where("copies > 0").select("doc_id", F.explode(F.sequence(F.lit(1), F.col("copies"))).alias("copy"))
    return documents.join(used, "doc_id")
