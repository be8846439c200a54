"""The latest state per key kept by a stream over a mutation log.

The state is a list of immutable layers, newest first. A micro-batch is folded and written as one more
layer, so its cost is that of the batch; when there are ``trigger`` layers, some of similar size are
merged into one. The new list is published by one rename together with the batch number. A batch
that is delivered again after a failure finds its number published and does nothing, and repeated
mutations change nothing anyway, since layers are resolved by sequence number.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from tidelog.operators import manifest, snapshot
from tidelog.sources import publish

TRIGGER, FAN_IN = 8, 4


class StateStream:
    """State under ``path``; ``log`` is a streaming DataFrame (key, seq_no, op, value, ...)."""

    def __init__(self, spark: SparkSession, path: str, trigger: int = TRIGGER, fan_in: int = FAN_IN):
        self.spark, self.path, self.trigger, self.fan_in = spark, path, trigger, fan_in

    def layers(self) -> list[dict]:
        """The live layers (id, folder, rows), newest first."""
        return (self._doc() or {"layers": []})["layers"]

    def state(self) -> DataFrame | None:
        """The folded state, tombstones included, or None before the first batch."""
        live = self.layers()
        return snapshot.latest(self.spark.read.parquet(*[x["folder"] for x in live])) if live else None

    def live(self) -> DataFrame | None:
        state = self.state()
        return None if state is None else state.where(f"op = {snapshot.PUT}")

    def _doc(self) -> dict | None:
        v = publish.latest_version(self.spark, f"{self.path}/versions")
        return publish.load(self.spark, f"{self.path}/versions", v) if v else None

    def _write(self, rows: DataFrame, number: int) -> dict:
        folder = f"{self.path}/layer-{number:012d}-{uuid.uuid4().hex}"
        rows.write.parquet(folder)
        return {"id": number, "folder": folder, "rows": self.spark.read.parquet(folder).count()}

    def apply(self, batch: DataFrame, batch_id: int) -> None:
        doc = self._doc() or {"batch": -1, "layers": [], "gone": []}
        if doc["batch"] >= batch_id:
            return
        live = doc["layers"]
        live = [self._write(snapshot.latest(batch), 1 + max((x["id"] for x in live), default=0)), *live]
        inputs: list[int] = []
        if manifest.wants_compaction(len(live), self.trigger):
            inputs = manifest.pick_local({x["id"]: x["rows"] for x in live}, self.fan_in)
            merged = snapshot.latest(self.spark.read.parquet(*[x["folder"] for x in live if x["id"] in inputs]))
            live = [self._write(merged, live[0]["id"] + 1), *[x for x in live if x["id"] not in inputs]]
        kept = {x["folder"] for x in live}
        gone = [x["folder"] for x in doc["layers"] if x["folder"] not in kept]
        version = publish.latest_version(self.spark, f"{self.path}/versions") + 1
        publish.publish(self.spark, f"{self.path}/versions", version, {"batch": batch_id, "layers": live, "gone": gone})
        for folder in doc["gone"]:  # left by the version before last; the last one may still be being read
            publish.remove(self.spark, folder)

    def start(self, log: DataFrame, **trigger) -> StreamingQuery:
        return log.writeStream.foreachBatch(self.apply).option("checkpointLocation", f"{self.path}/checkpoint").trigger(**(trigger or {"availableNow": True})).start()
