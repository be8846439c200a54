"""Command line of the store: ``python -m tidelog COMMAND [--config FILE] [--key K] [--value V]``."""

from __future__ import annotations

import argparse
import sys

from tidelog.operators import manifest
from tidelog.operators.store import Store
from tidelog.schema import StorageConfig, StoreError

COMMANDS = ("init", "put", "get", "del", "delete", "stats", "bg-status", "flush", "compact", "close", "manifest-info", "list-sst")


def main(argv: list[str] | None = None, spark=None, out=print) -> int:
    parser = argparse.ArgumentParser(prog="tidelog", description=__doc__)
    parser.add_argument("command", choices=COMMANDS)
    for name in ("config", "key", "value"):
        parser.add_argument(f"--{name}")
    a = parser.parse_args(argv)
    if (a.command in ("put", "get", "del", "delete") and not a.key) or (a.command == "put" and a.value is None):
        parser.error(f"{a.command} needs --key" + " and --value" * (a.command == "put"))
    if spark is None:
        from pyspark.sql import SparkSession

        spark = SparkSession.builder.appName("tidelog").getOrCreate()
    try:
        config = StorageConfig.load(a.config)
        run(Store(spark, config.data_dir, config), a, out)
    except StoreError as e:
        print(f"{e.status}: {e}", file=sys.stderr)
        return 1
    return 0


def run(store: Store, a: argparse.Namespace, out) -> None:
    spark = store.spark
    if a.command in ("put", "del", "delete"):
        op, value = (1, a.value.encode()) if a.command == "put" else (2, None)
        store.write(spark.createDataFrame([(0, op, a.key.encode(), value)], "ord long, op int, key binary, value binary"))
        store.background()
        out(f"ok seq_no={store.doc['last_seq_no']}")
    elif a.command == "get":
        rows = store.get(a.key.encode()).collect()
        out(bytes(rows[0].value).decode(errors="replace") if rows else "not found")
    elif a.command == "flush":
        store.flush()
        out(f"ok sst_count={len(store.doc['tables'])} last_seq_no={store.doc['last_seq_no']}")
    elif a.command == "compact":
        before = len(store.doc["tables"])
        store.compact()
        out(f"ok sst_count_before={before} sst_count_after={len(store.doc['tables'])}")
    elif a.command in ("stats", "bg-status"):
        for k, v in (store.stats() if a.command == "stats" else store.background_status()).items():
            out(f"{k}: {v}")
    elif a.command == "manifest-info" and store.doc["tables"]:
        for r in manifest.info(spark.createDataFrame(store.doc["tables"])).orderBy("id", ascending=False).collect():
            out(f"{r.id} {r.file} {r.min_key} {r.max_key} {r.min_seq_no} {r.max_seq_no} {r.file_size}")
    elif a.command == "list-sst":
        for t in store.doc["tables"]:
            out(f"{t['id']} {t['file']} {t['file_size']} {store.spark.read.parquet(t['path']).count()}")
    else:
        store.close() if a.command == "close" else None
        out(f"{a.command}: {store.path}, epoch {store.doc['epoch']}")


if __name__ == "__main__":
    sys.exit(main())
