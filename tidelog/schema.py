"""Canonical schemas, errors and validated configuration."""

from __future__ import annotations

import json
from dataclasses import dataclass, field, fields
from pathlib import Path

MUTATION = "seq_no long, op tinyint, key binary, value binary"
ENTRY = "layer_id long, key binary, value binary, seq_no long, tombstone boolean"
TABLE = "id long, file string, min_key string, max_key string, min_seq_no long, max_seq_no long, file_size long"
MANIFEST = f"version int, epoch long, tables array<struct<{TABLE.replace(' ', ':').replace(',:', ',')}>>"
PUT, DEL = 1, 2


class StoreError(Exception):
    """Base of the store's errors; ``status`` is the name of the matching remote status."""

    status = "INTERNAL"


class InvalidArgument(StoreError, ValueError):
    status = "INVALID_ARGUMENT"


class NotFound(StoreError, KeyError):
    status = "NOT_FOUND"


class WriteStall(StoreError):
    """Rejected before a sequence number was given: too many live tables."""

    status = "RESOURCE_EXHAUSTED"


class TooManyImmutables(StoreError):
    """Raised although the write is already in the log."""

    status = "RESOURCE_EXHAUSTED"


class StoreClosed(StoreError):
    status = "UNAVAILABLE"


class Corruption(StoreError):
    status = "DATA_LOSS"


def status_of(error: BaseException | None) -> str:
    """OK, the status of a store error, or INTERNAL."""
    return "OK" if error is None else getattr(error, "status", "INTERNAL")


def _need(ok: bool, what: str) -> None:
    if not ok:
        raise InvalidArgument(what)


def _load(cls, path: str | None):
    """Defaults, overridden by the JSON file if there is one; unknown fields are errors."""
    p = Path(path) if path else None
    text = p.read_text().strip() if p and p.exists() else ""
    return _from_json(cls, json.loads(text) if text else {})


def _from_json(cls, raw: dict):
    names = {f.name for f in fields(cls)}
    _need(isinstance(raw, dict) and not raw.keys() - names, f"unknown fields {sorted(set(raw) - names)}")
    raw = dict(raw)
    if "storage" in raw:
        raw["storage"] = _from_json(StorageConfig, raw["storage"])
    if "seed_nodes" in raw:
        raw["seed_nodes"] = tuple(_from_json(Peer, p) for p in raw["seed_nodes"] or ())
    return cls(**raw)


@dataclass(frozen=True)
class StorageConfig:
    # Defaults of the storage configuration.
    data_dir: str = "./data"
    memtable_max_bytes: int = 67108864
    max_immutable_tables: int = 2
    block_size: int = 8192
    bloom_false_positive: float = 0.01
    wal_fsync_every_n: int = 1
    wal_segment_roll_bytes: int = 67108864
    compression: str = "off"
    log_level: str = "info"
    l0_compaction_trigger: int = 8
    size_tiered_fan_in: int = 4
    size_tiered_size_ratio: float = 2.0
    tombstone_grace_seconds: int = 86400
    l0_stop_writes: int = 20

    def __post_init__(self) -> None:
        _need(bool(self.data_dir), "data_dir is empty")
        for name in ("memtable_max_bytes", "max_immutable_tables", "block_size", "wal_fsync_every_n", "wal_segment_roll_bytes"):
            _need(getattr(self, name) >= 1, f"{name} must be at least 1")
        for name in ("l0_compaction_trigger", "tombstone_grace_seconds", "l0_stop_writes"):
            _need(getattr(self, name) >= 0, f"{name} must not be negative")
        _need(0 < self.bloom_false_positive < 1, "bloom_false_positive must lie between 0 and 1")
        _need(self.size_tiered_fan_in >= 2, "size_tiered_fan_in must be at least 2")
        _need(self.size_tiered_size_ratio >= 1, "size_tiered_size_ratio must be at least 1")
        _need(not (0 < self.l0_stop_writes < self.l0_compaction_trigger), "l0_stop_writes must not be below l0_compaction_trigger")
        _need(self.compression in ("off", "snappy", "lz4"), f"compression {self.compression!r}")
        _need(self.log_level in ("debug", "info", "warn", "error"), f"log_level {self.log_level!r}")

    @classmethod
    def load(cls, path: str | None = None) -> StorageConfig:
        return _load(cls, path)

    @property
    def parquet_codec(self) -> str:
        return "uncompressed" if self.compression == "off" else self.compression


@dataclass(frozen=True)
class Peer:
    node_id: str
    listen_addr: str


@dataclass(frozen=True)
class NodeConfig:
    # Defaults of the node configuration.
    node_id: str = "node-1"
    listen_addr: str = "127.0.0.1:18080"
    seed_nodes: tuple[Peer, ...] = ()
    storage: StorageConfig = field(default_factory=StorageConfig)
    replication_factor: int = 3
    write_quorum: int = 2
    read_quorum: int = 2

    def __post_init__(self) -> None:
        members = self.members()
        for p in members:
            _need(bool(p.node_id.strip()) and bool(p.listen_addr.strip()), "a node needs an id and an address")
        _need(len({p.node_id for p in members}) == len(members), "duplicate node_id")
        _need(len({p.listen_addr for p in members}) == len(members), "duplicate listen_addr")
        _need(self.replication_factor >= 1, "replication_factor must be at least 1")
        for name in ("write_quorum", "read_quorum"):
            _need(1 <= getattr(self, name) <= self.replication_factor, f"{name} must lie in 1..replication_factor")

    @classmethod
    def load(cls, path: str | None = None) -> NodeConfig:
        return _load(cls, path)

    def members(self) -> tuple[Peer, ...]:
        return (Peer(self.node_id, self.listen_addr), *self.seed_nodes)

    def reachable_quorums(self) -> bool:
        """Whether both quorums can be met by the nodes there are."""
        return max(self.write_quorum, self.read_quorum) <= min(self.replication_factor, len(self.members()))
