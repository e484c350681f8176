"""Batches of a user's delete buffer.

The buffer is emptied after the task that brings it to ``threshold`` ids, so where a batch ends
depends on where the one before ended. To split a user with very many tasks, each piece of the
user's tasks is first summed up as a table: for every fill level the buffer can have on entry, the
level on exit and the number of flushes. The tables of a user are chained, one row per piece, and
then all pieces are numbered at the same time from their known entry level.

Both passes stream: a task holds one Arrow batch of a sorted piece and the state between batches.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from linkweave.constants import DELETE_BATCH_SIZE
from linkweave.operators.ranking import PIECE, POSITION, lay_out

_TABLE = "_piece long, user_id string, _level array<int>, _flushes array<long>"
_ENTRY = "_piece long, user_id string, _entry_level int, _entry_batch long"


def _flush_after(sizes: np.ndarray, threshold: int) -> np.ndarray:
    """For each task the place after the one that fills a buffer empty before it; ``len + 1`` if none does."""
    total = np.cumsum(sizes)
    before = total - sizes
    return np.searchsorted(total, before + threshold) + 1


def _summary(sizes: np.ndarray, threshold: int) -> tuple[np.ndarray, np.ndarray]:
    """Exit level and flush count for each entry level ``0 … threshold - 1``."""
    n = len(sizes)
    total = np.concatenate([[0], np.cumsum(sizes)])
    # from an empty buffer before each task, and before the end: where the last flush leaves off, by pointer doubling
    goes = np.append(_flush_after(sizes, threshold), n + 1)
    ends = goes > n
    to = np.where(ends, np.arange(n + 1), goes)
    count = (~ends).astype(np.int64)
    while True:
        further = to[to]
        if (further == to).all():
            break
        count, to = count + count[to], further
    level = total[n] - total[to]
    # the first flush from each entry level
    entry = np.arange(threshold)
    first = np.searchsorted(total[1:], threshold - entry) + 1
    none = first > n
    start = np.where(none, 0, first)
    return np.where(none, entry + total[n], level[start]), np.where(none, 0, 1 + count[start])


def flush_ends(sizes: np.ndarray, level: int, threshold: int) -> list[int]:
    """The places after the tasks that fill the buffer, which holds ``level`` ids at first. One step per flush."""
    n = len(sizes)
    goes = _flush_after(sizes, threshold)
    at = int(np.searchsorted(np.cumsum(sizes), threshold - level)) + 1
    ends = []
    while at <= n:
        ends.append(at)
        at = int(goes[at]) if at < n else n + 1
    return ends


def _number(sizes: np.ndarray, level: int, batch: int, threshold: int) -> tuple[np.ndarray, int, int]:
    """Batch numbers of one user's tasks in a row, and the level and batch they leave."""
    n = len(sizes)
    starts = flush_ends(sizes, level, threshold)
    flushed = np.zeros(n + 1, dtype=np.int64)
    flushed[starts] = 1
    numbers = batch + np.cumsum(flushed)[:n]
    left = int(sizes[starts[-1] :].sum()) if starts else level + int(sizes.sum())
    return numbers, left, batch + len(starts)


def _stretches(frame: pd.DataFrame) -> Iterator[tuple[tuple, int, int]]:
    """(piece, user) and bounds of the stretches of equal ones in a sorted frame."""
    piece, user = frame[PIECE].to_numpy(), frame["user_id"].to_numpy()
    codes = pd.factorize(user, use_na_sentinel=False)[0]
    cuts = np.flatnonzero((piece[1:] != piece[:-1]) | (codes[1:] != codes[:-1])) + 1
    for start, end in zip(np.append(0, cuts), np.append(cuts, len(frame))):
        yield (int(piece[start]), user[start]), int(start), int(end)


def delete_batches(tasks: DataFrame, threshold: int = DELETE_BATCH_SIZE) -> DataFrame:
    """``tasks`` (``req_id, ts, user_id, n_ids``) with ``batch_no``, 0, 1, 2 … per user.

    A task is never split, so a batch may hold more than ``threshold`` ids. A piece of a user is summed up in
    two arrays of ``threshold`` entries, and all pieces of one user are chained in one task: that is
    a row per piece, not per task, but ``threshold`` should stay in the hundreds.
    """
    placed = lay_out(
        tasks.select("req_id", "ts", "user_id", F.col("n_ids").cast("bigint").alias("n_ids")),
        ["user_id"],
        [F.col("ts"), F.col("req_id")],
    )
    # users that go on from one piece to the next: at most two per piece
    counts = placed.groupBy("user_id", PIECE).agg(F.count(F.lit(1)).alias("_n"))
    of_user = Window.partitionBy("user_id")
    spanning = F.broadcast(
        counts.withColumn("_pieces", F.count(F.lit(1)).over(of_user)).where("_pieces > 1").select("user_id", PIECE)
    )

    def summarize(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        current, level, flushes = None, np.arange(threshold), np.zeros(threshold, dtype=np.int64)

        def row() -> pd.DataFrame:
            return pd.DataFrame(
                {"_piece": [current[0]], "user_id": [current[1]], "_level": [level.astype(np.int32)], "_flushes": [flushes]}
            )

        for frame in frames:
            sizes = frame["n_ids"].to_numpy()
            for key, start, end in _stretches(frame) if len(frame) else ():
                if key != current:
                    if current is not None:
                        yield row()
                    current, level, flushes = key, np.arange(threshold), np.zeros(threshold, dtype=np.int64)
                next_level, more = _summary(sizes[start:end], threshold)
                flushes = flushes + more[level]
                level = next_level[level]
        if current is not None:
            yield row()

    def chain(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values(PIECE)
        level, batch, entries = 0, 0, []
        for levels, flushes in zip(frame["_level"], frame["_flushes"]):
            entries.append((level, batch))
            level, batch = int(levels[level]), batch + int(flushes[level])
        return pd.DataFrame(
            {
                "_piece": frame[PIECE].to_numpy(),
                "user_id": frame["user_id"].to_numpy(),
                "_entry_level": np.array([e[0] for e in entries], dtype=np.int32),
                "_entry_batch": np.array([e[1] for e in entries], dtype=np.int64),
            }
        )

    def number(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        current, level, batch = None, 0, 0
        for frame in frames:
            sizes = frame["n_ids"].to_numpy()
            entry_level, entry_batch = frame["_entry_level"].to_numpy(), frame["_entry_batch"].to_numpy()
            numbers = np.zeros(len(frame), dtype=np.int64)
            for key, start, end in _stretches(frame) if len(frame) else ():
                if key != current:
                    current, level, batch = key, int(entry_level[start]), int(entry_batch[start])
                numbers[start:end], level, batch = _number(sizes[start:end], level, batch, threshold)
            yield frame[["req_id", "ts", "user_id", "n_ids"]].assign(batch_no=numbers)

    def in_order(rows: DataFrame) -> DataFrame:
        return rows.repartition(PIECE).sortWithinPartitions(PIECE, POSITION)

    keys = [PIECE, "user_id"]
    cut = placed.select(*keys, POSITION, "n_ids").join(spanning, keys)
    tables = in_order(cut).mapInPandas(summarize, _TABLE)
    entries = F.broadcast(tables.groupBy("user_id").applyInPandas(chain, _ENTRY))
    out = T.StructType(
        [placed.schema[c] for c in ("req_id", "ts", "user_id", "n_ids")] + [T.StructField("batch_no", T.LongType())]
    )
    known = placed.join(entries, keys, "left").fillna(0, ["_entry_level", "_entry_batch"])
    return in_order(known).mapInPandas(number, out)


def even_batches(buffer: DataFrame, threshold: int = DELETE_BATCH_SIZE) -> DataFrame:
    """``batch_no`` where every task holds one id: a division of its place ``seq`` in the buffer."""
    return buffer.withColumn("batch_no", F.floor((F.col("seq") - 1) / threshold).cast("bigint"))


def flush_window(deletes: DataFrame, width: str) -> DataFrame:
    """Label each delete with the tick ``[window_start, window_end)`` that flushes it. No shuffle."""
    span = F.window("ts", width)
    return deletes.select(
        "*", span["start"].cast("timestamp_ntz").alias("window_start"), span["end"].cast("timestamp_ntz").alias("window_end")
    )


def tumbling_deletes(deletes: DataFrame, width: str) -> DataFrame:
    """One row per tick and user: how many ids are flushed and how many distinct ones.

    The ids themselves are the rows of ``flush_window``; a list per user and tick has no bound.
    """
    return (
        deletes.groupBy(F.window("ts", width).alias("_w"), "user_id")
        .agg(F.count("short_id").alias("n_ids"), F.min("req_id").alias("first_req"), F.max("req_id").alias("last_req"))
        .select(
            F.col("_w.start").cast("timestamp_ntz").alias("window_start"),
            F.col("_w.end").cast("timestamp_ntz").alias("window_end"),
            "user_id",
            "n_ids",
            "first_req",
            "last_req",
        )
    )
