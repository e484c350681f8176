"""Per-user delete buffer as keyed state: flushed when full or when its tick has passed."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import chain

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from linkweave.constants import DELETE_BATCH_SIZE, DELETE_TICK_MS
from linkweave.operators.flush import flush_ends

# Delete tasks of one user, in the time that a volume is measured over, that one buffer takes.
TASKS_PER_LANE = 100_000
FLUSHES = "user_id string, lane int, reason string, ids array<string>"
_ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def state_session(spark: SparkSession) -> SparkSession:
    """A session of the same application that keeps stream state in RocksDB."""
    session = spark.newSession()
    session.conf.set("spark.sql.streaming.stateStore.providerClass", _ROCKSDB)
    session.conf.set("spark.sql.shuffle.partitions", spark.conf.get("spark.sql.shuffle.partitions"))
    session.conf.set("spark.sql.session.timeZone", spark.conf.get("spark.sql.session.timeZone"))
    return session


class DeleteBuffer(StatefulProcessor):
    """The state never holds ``threshold`` ids or more: a task that reaches it flushes them all."""

    def __init__(self, threshold: int, tick_ms: int):
        self.threshold, self.tick_ms = threshold, tick_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.ids = handle.getListState("ids", "short_id string")

    def _held(self) -> list[str]:
        return [row[0] for row in self.ids.get()]

    def _flush(self, key, reason: str, batches: list[list[str]]) -> pd.DataFrame:
        n = len(batches)
        return pd.DataFrame({"user_id": [key[0]] * n, "lane": [key[1]] * n, "reason": [reason] * n, "ids": batches})

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        held = self._held()
        waiting = bool(held)
        for frame in rows:
            tasks = frame.sort_values(["ts", "req_id"])["ids"].tolist()
            sizes = np.fromiter(map(len, tasks), dtype=np.int64, count=len(tasks))
            full, start = [], 0
            for end in flush_ends(sizes, len(held), self.threshold):
                full.append([*held, *chain.from_iterable(tasks[start:end])])
                held, start = [], end
            held.extend(chain.from_iterable(tasks[start:]))
            if full:
                yield self._flush(key, "full", full)
        if held:
            self.ids.put([(short_id,) for short_id in held])
            if not waiting:
                self.handle.registerTimer(timerValues.getCurrentProcessingTimeInMs() + self.tick_ms)
        elif waiting:
            self.ids.clear()

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        held = self._held()
        self.ids.clear()
        if held:
            yield self._flush(key, "tick", [held])

    def close(self) -> None:
        pass


def lanes_of(history: DataFrame, tasks_per_lane: int = TASKS_PER_LANE) -> DataFrame:
    """``user_id, lanes`` of the users whose volume, a table of their delete tasks, needs more than one buffer."""
    volume = history.groupBy("user_id").agg(F.count(F.lit(1)).alias("n"))
    lanes = F.ceil(F.col("n") / tasks_per_lane).cast("int")
    return volume.where(F.col("n") > tasks_per_lane).select("user_id", lanes.alias("lanes"))


def stream_deletes(
    tasks: DataFrame,
    threshold: int = DELETE_BATCH_SIZE,
    tick_ms: int = DELETE_TICK_MS,
    lanes: int | DataFrame = 1,
) -> DataFrame:
    """Stream of flushed batches ``user_id, lane, reason, ids`` from delete tasks
    ``req_id, ts, user_id, ids``.

    A user has as many buffers as ``lanes`` says: a number for all, or the table that ``lanes_of`` makes from the
    volume of each (one for users it does not list), so that no user's deletes all go to one task. Each buffer
    flushes by the same two rules, and every id is flushed once. Start it from a ``state_session``.
    """
    rows = tasks.select("req_id", "ts", "user_id", "ids")
    if isinstance(lanes, DataFrame):
        rows = rows.join(lanes.withColumnRenamed("lanes", "_lanes"), "user_id", "left")
    else:
        rows = rows.withColumn("_lanes", F.lit(lanes))
    lane = F.pmod(F.xxhash64("req_id"), F.coalesce("_lanes", F.lit(1))).cast("int")
    return (
        rows.select("req_id", "ts", "user_id", "ids", lane.alias("lane"))
        .groupBy("user_id", "lane")
        .transformWithStateInPandas(
            DeleteBuffer(threshold, tick_ms),
            outputStructType=FLUSHES,
            outputMode="append",
            timeMode="processingTime",
        )
    )


def flushed_ids(flushes: DataFrame) -> DataFrame:
    """``short_id, user_id`` rows of flushed batches."""
    return flushes.select(F.explode("ids").alias("short_id"), "user_id")
