"""The manifest: which layers are live, and how flushes and merges change that."""

from __future__ import annotations

import json
import math
from dataclasses import asdict, dataclass, replace
from pathlib import PurePath

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidelog.schema import Corruption
from tidelog.sources import files


@dataclass(frozen=True)
class Table:
    # Field names of the manifest's JSON.
    id: int
    file: str
    min_key: str
    max_key: str
    min_seq_no: int
    max_seq_no: int
    file_size: int


@dataclass(frozen=True)
class Manifest:
    """An immutable version of the live tables, newest first."""

    version: int = 1
    epoch: int = 0
    tables: tuple[Table, ...] = ()

    def next_id(self) -> int:
        return max((t.id for t in self.tables), default=0) + 1

    def with_table(self, table: Table) -> Manifest:
        return replace(self, epoch=self.epoch + 1, tables=(table, *self.tables))

    def after_compaction(self, inputs: set[int], output: Table) -> Manifest:
        kept = tuple(t for t in self.tables if t.id not in inputs)
        return replace(self, epoch=self.epoch + 1, tables=(output, *kept))

    def save(self, path: str) -> None:
        """Written aside and renamed: a reader sees the old or the new manifest, nothing between."""
        with files.open_write(f"{path}.tmp") as f:
            f.write(json.dumps(asdict(self), indent=2).encode())
        files.move(f"{path}.tmp", path)


def load(path: str) -> Manifest:
    """The manifest at ``path``; a missing file is an empty store. Anything malformed is Corruption."""
    try:
        length = files.size(path)
    except FileNotFoundError:
        return Manifest()
    try:
        with files.open_read(path) as f:
            raw = json.loads(f.read(length))
        m = Manifest(int(raw.get("version", 0)), int(raw.get("epoch", 0)), tuple(Table(**t) for t in raw.get("tables") or ()))
    except (ValueError, TypeError, AttributeError) as e:
        raise Corruption(f"manifest {path}: {e}") from e
    if faults := problems(m):
        raise Corruption(f"manifest {path}: {faults[0]}")
    return m


def problems(m: Manifest) -> list[str]:
    found = [] if m.version == 1 else [f"version {m.version}"]
    for t in m.tables:
        checks = {
            "id": t.id > 0, "empty file": bool(t.file), "path in file": PurePath(t.file).name == t.file, "key range": t.min_key <= t.max_key,
            "seq range": t.min_seq_no <= t.max_seq_no, "file size": t.file_size >= 0,
        }
        found += [f"table {t.id}: {name}" for name, ok in checks.items() if not ok]
    for name in ("id", "file"):
        if len({getattr(t, name) for t in m.tables}) < len(m.tables):
            found.append(f"duplicate {name}")
    return found


def violations(tables: DataFrame, store: list[str] = ["node_id"]) -> DataFrame:
    """Rows of manifest tables that break a structural rule, with ``rule``; one row per rule and table row.

    Duplicate ids and files are looked for per store among distinct rows.
    """
    rows = tables.select(*store, "id", "file", "min_key", "max_key", "min_seq_no", "max_seq_no", "file_size").distinct()
    rules = {
        "id": F.col("id").isNull() | (F.col("id") <= 0), "file": F.col("file").isNull() | (F.col("file") == "") | F.col("file").contains("/"), "key_range": F.col("min_key") > F.col("max_key"),
        "seq_range": F.col("min_seq_no") > F.col("max_seq_no"), "file_size": F.col("file_size").isNull() | (F.col("file_size") < 0),
    }
    own = rows.select(*store, "id", F.explode(F.array_compact(F.array(*[F.when(c, F.lit(n)) for n, c in rules.items()]))).alias("rule"))
    out = own
    for name in ("id", "file"):
        twice = rows.groupBy(*store, name).agg(F.count(F.lit(1)).alias("n"), F.min("id").alias("one")).where("n > 1")
        out = out.unionByName(twice.select(*store, F.col("one").alias("id"), F.lit(f"duplicate_{name}").alias("rule")))
    return out


def pick(tables: DataFrame, fan_in: int = 4, ratio: float = 2.0, store: list[str] = []) -> DataFrame:
    """The tables (id, size) of one size-tiered merge, per store.

    In order of size the first ``fan_in`` neighbours whose largest is at most ``ratio`` times the
    smallest; if there are none, the newest ``fan_in``. Fewer than two tables give nothing. A fan-in
    below 2 counts as 2, a ratio below 1 as 2.
    """
    fan_in, ratio = max(2, fan_in), ratio if ratio >= 1 else 2.0
    whole = Window.partitionBy(*store) if store else Window.partitionBy(F.lit(0))
    by_size = whole.orderBy("size", F.desc("id"))
    newest = whole.orderBy(F.desc("id"))
    s = tables.select(*store, "id", "size", F.row_number().over(by_size).alias("rn"), F.count(F.lit(1)).over(whole).alias("n"), F.row_number().over(newest).alias("age"))
    s = s.withColumn("k", F.least("n", F.lit(fan_in)))
    last = F.when(F.col("n") >= fan_in, F.lead("size", fan_in - 1).over(by_size)).when(F.col("rn") == 1, F.max("size").over(whole))
    s = s.withColumn("fits", last <= F.greatest(F.col("size"), F.lit(1)) * ratio)
    s = s.withColumn("start", F.min(F.when(F.col("fits"), F.col("rn"))).over(whole))
    chosen = F.when(F.col("start").isNotNull(), (F.col("rn") >= F.col("start")) & (F.col("rn") < F.col("start") + F.col("k"))).otherwise(F.col("age") <= F.col("k"))
    return s.where((F.col("n") >= 2) & chosen).select(*store, "id", "size")


def pick_local(sizes: dict[int, int], fan_in: int = 4, ratio: float = 2.0) -> list[int]:
    """The same choice for one store's few live tables, newest first."""
    if len(sizes) < 2:
        return []
    fan_in, ratio = min(max(2, fan_in), len(sizes)), ratio if ratio >= 1 else 2.0
    by_size = sorted(sizes, key=lambda i: (sizes[i], -i))
    windows = [by_size[i : i + fan_in] for i in range(len(by_size) - fan_in + 1)]
    fit = next((w for w in windows if sizes[w[-1]] <= max(sizes[w[0]], 1) * ratio), None)
    return sorted(fit or sorted(sizes, reverse=True)[:fan_in], reverse=True)


def replaced(tables: DataFrame, inputs: DataFrame, output: DataFrame) -> DataFrame:
    """Live tables after a merge: the inputs leave, the output comes."""
    return tables.join(inputs.select("id"), "id", "left_anti").select(*tables.columns).unionByName(output.select(*tables.columns))


def stalled(live_tables: int, stop_writes: int) -> bool:
    """Whether a write is to be rejected; a limit of 0 is off."""
    return math.isfinite(stop_writes) and 0 < stop_writes <= live_tables


def wants_compaction(live_tables: int, trigger: int, immutables: int = 0) -> bool:
    return trigger > 0 and live_tables >= trigger and immutables == 0


def info(tables: DataFrame) -> DataFrame:
    """The live tables as shown to people: keys longer than 18 characters are cut to 15 and dots."""
    short = lambda c: F.when(F.length(c) > 18, F.concat(F.substring(c, 1, 15), F.lit("..."))).otherwise(F.col(c)).alias(c)
    return tables.select(*[short(c) if c in ("min_key", "max_key") else c for c in tables.columns])


def list_layers(tables: DataFrame, entries: DataFrame) -> DataFrame:
    """(id, file, file_size, entries) of each table; tombstones count, and -1 means no readable layer."""
    counts = entries.groupBy(F.col("layer_id").alias("id")).agg(F.count(F.lit(1)).alias("entries"))
    return tables.select("id", "file", "file_size").join(counts, "id", "left").na.fill(-1, ["entries"])
