"""The worker pool as a stream: registration, heartbeats and expiry as keyed state.

One state per worker.  A heartbeat of an unknown worker answers ``exist`` false; a checked
worker's timer removes it when it has been silent for the expiry.  State is in RocksDB and
checkpointed, so the pool survives lost executors and restarts.  ``pool_state`` reads it between batches or after a stop, so a
list of models, an address or a status is a plan over the pool as it is.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..operators.registry import EXPIRATION

OUTPUT = "worker string, event string, exist boolean, queue_length int, last_beat_ms long"
STATE = "queue_length int, check_heart_beat boolean, last_beat_ms long, registered_ms long, speed int, model_names array<string>"
PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class WorkerPool(StatefulProcessor):
    """Rows of one worker (event, queue_length, check_heart_beat, ts) to answers and removals."""

    def __init__(self, gap: int = EXPIRATION) -> None:
        self.gap_ms = gap * 1000

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("worker", STATE)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        out = []
        known = self.state.get() if self.state.exists() else None
        for part in rows:
            for r in part.sort_values(["ts"], kind="stable").itertuples():
                beat = max(int(r.ts.value // 1_000_000), known[2] if known is not None else 0)  # a late event doesn't set the clock back
                if r.event == "register":
                    names = [] if r.model_names is None else [str(m) for m in r.model_names]
                    known = (int(r.queue_length), bool(r.check_heart_beat), beat, beat if known is None else known[3], 0 if pd.isna(r.speed) else int(r.speed), names)
                elif known is not None:
                    known = (int(r.queue_length), known[1], beat, *known[3:])
                out.append((key[0], r.event, known is not None, known[0] if known else None, known[2] if known else None))
        if known is not None:
            self.state.update(known)
            for t in list(self.handle.listTimers()):
                self.handle.deleteTimer(t)
            if known[1]:
                self.handle.registerTimer(known[2] + self.gap_ms + 1)
        yield pd.DataFrame(out, columns=["worker", "event", "exist", "queue_length", "last_beat_ms"])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        known = self.state.get()
        self.state.clear()
        yield pd.DataFrame([(key[0], "removed", False, known[0], known[2])], columns=["worker", "event", "exist", "queue_length", "last_beat_ms"])

    def close(self) -> None:
        pass


def worker_stream(events: DataFrame, gap: int = EXPIRATION, delay: str = "1 minute") -> DataFrame:
    """Answers and removals of a stream of worker events (worker, event, queue_length, check_heart_beat, ts, and if there are speed and model_names), by event time."""
    missing = {c: F.lit(None).cast(kind) for c, kind in (("speed", "int"), ("model_names", "array<string>")) if c not in events.columns}
    rows = events.withColumns({"ts": F.col("ts").cast("timestamp"), **missing}).withWatermark("ts", delay)
    return rows.groupBy("worker").transformWithStateInPandas(WorkerPool(gap), outputStructType=OUTPUT, outputMode="Append", timeMode="EventTime")


def pool_state(spark: SparkSession, checkpoint: str) -> DataFrame:
    """(worker, queue_length, check_heart_beat, last_beat_ms, registered_ms, speed, model_names): the pool as the stream of ``checkpoint`` last committed it."""
    state = spark.read.format("statestore").option("path", checkpoint).option("stateVarName", "worker").load()
    return state.select("key.worker", "value.*")


def beat_windows(events: DataFrame, width: str = "1 hour", delay: str = "10 minutes") -> DataFrame:
    """Added beside the worker pool: beats and mean queue by worker and window, late beats dropped."""
    rows = events.withColumn("ts", F.col("ts").cast("timestamp"))
    rows = rows.withWatermark("ts", delay) if rows.isStreaming else rows
    return rows.groupBy(F.window("ts", width), "worker").agg(F.count("*").alias("beats"), F.avg("queue_length").alias("mean_queue")).select("worker", F.col("window.start").alias("window_start"), "beats", "mean_queue")
