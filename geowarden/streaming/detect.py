"""Detection on streams: each micro-batch goes through the batch plan with what earlier ones left behind.

Two small tables carry over: every device's last position, and the state of every (device, rule)
that has a firing policy.  A batch reads those of the batch before it and writes its own under its
number, so a batch that is run again after a failure starts from the same tables and replaces its
own; the sink gets the batch number for the same purpose.  Tables of batches before the last are
removed; states of rules that are gone go with them.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from geowarden.engine import Engine
from geowarden.operators import stores
from geowarden.operators.gate import gate_states
from geowarden.plans.detect import events, normalise, policies

STATE = "device_id string, rule_id string, last_seen double, last_reset double, hits int"


class StreamDetector:
    """Keeps an engine's state in ``folder`` (any file system that the cluster shares)."""

    def __init__(self, engine: Engine, folder: str, sink: Callable[[DataFrame, int], None]) -> None:
        self.engine, self.folder, self.sink = engine, folder.rstrip("/"), sink

    def _path(self, name: str, batch: int) -> str:
        return f"{self.folder}/{name}/batch={batch}"

    def _read(self, name: str, batch: int) -> DataFrame | None:
        """The table that a batch left; None before the first.  A lost table is an error, not a fresh start."""
        if batch < 0:
            return None
        folder, files = self._folder(name, batch)
        if not files.exists(folder):
            raise FileNotFoundError(f"batch {batch + 1} needs {self._path(name, batch)}, which is gone")
        return self.engine.spark.read.parquet(self._path(name, batch))

    def _folder(self, name: str, batch: int):
        spark = self.engine.spark
        folder = spark._jvm.org.apache.hadoop.fs.Path(self._path(name, batch))
        return folder, folder.getFileSystem(spark._jsc.hadoopConfiguration())

    def _drop(self, batch: int) -> None:
        for name in ("devices", "states"):
            folder, files = self._folder(name, batch)
            files.delete(folder, True)

    def states(self, batch: int) -> DataFrame:
        """The firing states after a batch."""
        return self._read("states", batch)

    def restore(self, devices: DataFrame, states: DataFrame, number: int) -> None:
        """Puts tables where batch ``number + 1`` looks for them: a snapshot of another stream, or states without some keys."""
        devices.write.mode("overwrite").parquet(self._path("devices", number))
        states.write.mode("overwrite").parquet(self._path("states", number))

    def __call__(self, batch: DataFrame, number: int) -> None:
        """Handles one micro-batch: events to the sink, then the tables for the next batch."""
        spark, engine = self.engine.spark, self.engine
        readings = normalise(batch).persist()
        try:
            past, states = self._read("devices", number - 1), self._read("states", number - 1)
            rules = engine.every_rule()
            rows = engine.evaluated(readings, past)
            held = {k: v for k, v in policies(rules).items() if v[0] is not None}
            states = states if states is not None else spark.createDataFrame([], STATE)
            ordered = F.col("rule_id").isin(list(held))
            both = gate_states(rows.filter(ordered), states.filter(ordered), held, engine.compat).persist()
            plain = rows.filter(~ordered & F.col("ok"))
            fired = both.filter(~F.col("is_state")).select(*rows.columns)
            self.sink(events(plain.unionByName(fired)), number)
            both.filter("is_state").select("device_id", "rule_id", "last_seen", "last_reset", "hits").write.mode("overwrite").parquet(self._path("states", number))
            last = stores.latest(readings if past is None else past.unionByName(readings))
            last.write.mode("overwrite").parquet(self._path("devices", number))
            both.unpersist()
            self._drop(number - 2)
        finally:
            readings.unpersist()


def detect_stream(engine: Engine, readings: DataFrame, folder: str, sink: Callable[[DataFrame, int], None], **options: str) -> StreamingQuery:
    """Starts a query over streaming ``readings``; ``options`` go to the stream writer.

    Readings have to arrive in the order of their time within a device, as firing policies and
    last positions follow it from batch to batch; within a batch any order will do.
    """
    writer = readings.writeStream.foreachBatch(StreamDetector(engine, folder, sink)).option("checkpointLocation", f"{folder}/checkpoint")
    for k, v in options.items():
        writer = writer.trigger(**{k: v}) if k in ("processingTime", "once", "availableNow") else writer.option(k, v)
    return writer.start()
