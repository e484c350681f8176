"""Streams over requests, deletes, clicks and audit events.

Every job takes a streaming DataFrame, its own checkpoint folder and a trigger, and returns the
running query. Micro-batch N writes only folder N of its target, so a batch that is run again after
a failure replaces its own output.
"""

from __future__ import annotations

import time
from collections.abc import Callable, Mapping

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter, StreamingQuery

from linkweave.operators.lookup import resolve
from linkweave.operators.shorten import new_links, shorten_append, shorten_unique
from linkweave.session import scratch_scope
from linkweave.sources.stores import LinkStore, ParquetStore
from linkweave.sources.versions import VersionedStore
from linkweave.sources.writers import Send, post_pending

AVAILABLE_NOW = {"availableNow": True}

Sink = Callable[[DataFrame, int], None]


def start_batches(stream: DataFrame, work: Sink, checkpoint: str, trigger: Mapping = AVAILABLE_NOW) -> StreamingQuery:
    """Run ``work`` on every micro-batch; what it stages is removed when it is done."""

    def run(batch: DataFrame, batch_id: int) -> None:
        with scratch_scope(batch.sparkSession):
            work(batch, batch_id)

    return stream.writeStream.foreachBatch(run).option("checkpointLocation", checkpoint).trigger(**trigger).start()


def stream_shorten(
    requests: DataFrame, store: ParquetStore | VersionedStore, outcomes: str, checkpoint: str, trigger: Mapping = AVAILABLE_NOW,
    mode: str = "unique",
) -> StreamingQuery:
    """Shorten a stream of requests. In ``unique`` mode the first writer of a URL wins, across and
    within micro-batches; in ``append`` mode every request makes a link. Links go to ``store``, one outcome per request to ``outcomes``.

    Each micro-batch is reduced to its distinct URLs before the store is asked, so a hot URL costs
    no more than any other. The store is read without the batch's own load: a batch run again must
    not meet the links of its first run.
    """

    def work(batch: DataFrame, batch_id: int) -> None:
        path = f"{outcomes}/batch={batch_id}"
        links = store.links(before=batch_id)
        made = shorten_unique(batch, links, index=store.index(before=batch_id)) if mode == "unique" else shorten_append(batch, links)
        made.write.mode("overwrite").parquet(path)
        # the written outcomes, not a second evaluation of them
        store.append(new_links(batch.sparkSession.read.parquet(path)), batch_id)

    return start_batches(requests, work, checkpoint, trigger)


def stream_delete_apply(
    deletes: DataFrame, store: LinkStore, checkpoint: str, trigger: Mapping = AVAILABLE_NOW
) -> StreamingQuery:
    """Turn deletes (``short_id, user_id``) into tombstones of the store."""
    return start_batches(deletes, store.tombstone, checkpoint, trigger)


def stream_resolve(
    clicks: DataFrame, store: LinkStore, outcomes: str, checkpoint: str, trigger: Mapping = AVAILABLE_NOW
) -> StreamingQuery:
    """Resolve clicks against the links as they are when the micro-batch starts."""

    def work(batch: DataFrame, batch_id: int) -> None:
        resolve(batch, store.read_for("short_id", batch)).write.mode("overwrite").parquet(f"{outcomes}/batch={batch_id}")

    return start_batches(clicks, work, checkpoint, trigger)


def stream_audit_fanout(
    events: Mapping[str, DataFrame] | DataFrame,
    sinks: Mapping[str, Sink],
    checkpoint: str,
    trigger: Mapping = AVAILABLE_NOW,
) -> dict[str, StreamingQuery]:
    """Deliver every audit event to every sink.

    One query and one checkpoint per sink: a slow or failing sink holds back only itself, and takes
    up where it stopped. A sink is any function of a micro-batch and its number.
    """
    queries = {}
    for name, sink in sinks.items():
        stream = events[name] if isinstance(events, Mapping) else events
        queries[name] = start_batches(stream, sink, f"{checkpoint}/{name}", trigger)
    return queries


def file_sink(path: str) -> Sink:
    """Audit events as JSON lines, one folder per micro-batch."""

    def write(batch: DataFrame, batch_id: int) -> None:
        events = batch.withColumn("user_id", F.nullif(F.col("user_id"), F.lit("")))
        events.write.mode("overwrite").json(f"{path}/batch={batch_id}")

    return write


def http_sink(path: str, send: Send) -> Sink:
    """Audit events by ``send``, at least once: what a micro-batch could not deliver is kept in ``path`` and sent again with
    the next one. ``post_pending`` sends the rest when the stream has ended."""

    def deliver(batch: DataFrame, batch_id: int) -> None:
        post_pending(batch.sparkSession, path, send, batch_id, batch)

    return deliver


def stream_tumbling_deletes(
    deletes: DataFrame, width: str, lateness: str, target: str, checkpoint: str, trigger: Mapping = AVAILABLE_NOW
) -> StreamingQuery:
    """Count each user's deletes per tick; a tick is written once no event of it can come any more."""
    counts = (
        deletes.withWatermark("ts", lateness)
        .groupBy(F.window("ts", width).alias("tick"), "user_id")
        .agg(F.count("short_id").alias("n_ids"))
        .select("tick.start", "tick.end", "user_id", "n_ids")
    )
    return (
        counts.writeStream.format("parquet")
        .option("path", target)
        .option("checkpointLocation", checkpoint)
        .outputMode("append")
        .trigger(**trigger)
        .start()
    )


def run_until_idle(writer: DataStreamWriter) -> None:
    """Run a job with timers until a micro-batch has neither input nor state left, then stop it.

    Timers fire only in a later micro-batch, which a one-off trigger would not wait for. A job with
    timers never reports that it is done, hence the look at its progress.
    """
    query = writer.trigger(processingTime="0 seconds").start()
    try:
        while query.isActive:
            progress = query.lastProgress
            if progress is not None and not progress.numInputRows:
                if not any(state.numRowsTotal for state in progress.stateOperators):
                    break
            time.sleep(0.1)
        if query.exception() is not None:
            raise query.exception()
    finally:
        query.stop()
