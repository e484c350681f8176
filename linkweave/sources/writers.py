"""Sinks and table maintenance."""

from __future__ import annotations

import urllib.error
import urllib.request
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from linkweave import schemas
from linkweave.constants import BAD_REQUEST
from linkweave.functions.ids import link_uuid
from linkweave.functions.json import encode_event
from linkweave.functions.text import compressible, deleted_flag
from linkweave.session import stage

Send = Callable[[str], int]


def link_lines(links: DataFrame) -> DataFrame:
    """``links`` in the column names and order of the NDJSON file."""
    columns = set(links.columns)
    text = F.lit("")
    return links.select(
        (F.col("uuid") if "uuid" in columns else text).alias("uuid"),
        F.col("short_id").alias("short_url"),
        "original_url",
        "user_id",
        deleted_flag(F.col("is_deleted")).alias("is_deleted"),
    )


def append_links(links: DataFrame, path: str, load_id: int) -> None:
    """Add links to an NDJSON folder as one load.

    The load is visible whole or not at all, and writing it again replaces it. Loads are read in
    the order of their numbers. Links without a ``uuid`` get one here, where it is written down.
    """
    if "uuid" not in links.columns:
        links = links.withColumn("uuid", link_uuid())
    folder = f"{path}/load={load_id:012d}"
    link_lines(links).write.mode("overwrite").option("ignoreNullFields", "false").json(folder)


def rewrite_links(links: DataFrame, path: str) -> None:
    """Write the table as a new NDJSON folder, deleted links included. ``path`` must not exist yet:
    the folder being read is never overwritten."""
    link_lines(links).write.mode("error").option("ignoreNullFields", "false").json(path)


def append_audit(events: DataFrame, path: str, load_id: int) -> None:
    """Append one JSON line per event; an empty user is left out of the line.

    A load has a folder of its own: a job that runs again replaces its events instead of doubling them.
    """
    lines = events.withColumn("user_id", F.nullif(F.col("user_id"), F.lit("")))
    lines.write.mode("overwrite").json(f"{path}/load={load_id:012d}")


def http_sender(endpoint: str, timeout: float = 10.0) -> Send:
    """A ``send`` that posts JSON and returns the status."""

    def send(payload: str) -> int:
        request = urllib.request.Request(
            endpoint, payload.encode(), {"Content-Type": "application/json"}, method="POST"
        )
        try:
            with urllib.request.urlopen(request, timeout=timeout) as answer:
                return answer.status
        except urllib.error.HTTPError as error:
            return error.code

    return send


def post_audit(events: DataFrame, send: Send) -> DataFrame:
    """Send every event as JSON; returns ``payload, http_status, error, delivered``.

    A failing event does not stop the others: whatever ``send`` raises is that event's own, by name in ``error``. The outcomes are written down, so reading them again
    does not send again; a task that is retried does, hence delivery is at least once.
    """

    payload = encode_event(F.col("ts"), F.col("action"), F.col("user_id"), F.col("url"))
    return post_payloads(events.select(payload.alias("payload")), send)


def post_payloads(payloads: DataFrame, send: Send) -> DataFrame:
    def deliver(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            statuses, errors = [], []
            for payload in frame["payload"]:
                try:
                    status, error = send(payload), None
                except Exception as raised:  # an event's failure must not end the job
                    status, error = None, type(raised).__name__
                statuses.append(status)
                errors.append(error)
            yield frame.assign(http_status=pd.array(statuses, dtype="Int32"), error=errors)

    sent = payloads.select("payload").mapInPandas(deliver, "payload string, http_status int, error string")
    delivered = F.coalesce(F.col("http_status") < BAD_REQUEST, F.lit(False))
    return stage(sent.withColumn("delivered", delivered), "posted")


def pending_audit(spark: SparkSession, path: str, before: int) -> DataFrame:
    """``payload`` of the events that the last load before ``before`` could not deliver, those it took over included."""
    try:
        rows = spark.read.schema("payload string, delivered boolean, load long").parquet(path)
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], "payload string")
    rows = rows.where(F.col("load") < before)
    last = rows.agg(F.max("load").alias("last"))  # one row
    return rows.join(F.broadcast(last), F.col("load") == F.col("last")).where("not delivered").select("payload")


def post_pending(spark: SparkSession, path: str, send: Send, load_id: int, events: DataFrame | None = None) -> None:
    """Send ``events`` and what earlier loads could not deliver; outcomes are written to load ``load_id`` of ``path``.

    A load that runs again replaces its outcomes and starts from the same earlier load, so no event is lost.
    """
    payloads = pending_audit(spark, path, load_id)
    if events is not None:
        payload = encode_event(F.col("ts"), F.col("action"), F.col("user_id"), F.col("url"))
        payloads = payloads.unionByName(events.select(payload.alias("payload")))
    # a load without events still marks that it took over what was pending
    post_payloads(payloads, send).write.mode("overwrite").parquet(f"{path}/load={load_id}")


def write_links_table(links: DataFrame, url: str, table: str = "urls", batch_size: int = 10_000, **options) -> None:
    """Insert links into a database table. Resolve conflicts first: this only inserts."""
    rows = links.select("short_id", "original_url", "user_id", "is_deleted", "created_at", "updated_at")
    (
        rows.write.format("jdbc")
        .options(url=url, dbtable=table, batchsize=str(batch_size), **{k: str(v) for k, v in options.items()})
        .mode("append")
        .save()
    )


def encoding(status: Column, content_type: Column, accepts_gzip: Column) -> Column:
    """gzip for a 2xx answer of a compressible type when the client takes it, else identity."""
    squeeze = accepts_gzip & (status >= 200) & (status < 300) & compressible(content_type)
    return F.when(F.coalesce(squeeze, F.lit(False)), "gzip").otherwise("identity")


def write_responses(responses: DataFrame, path: str) -> None:
    """Write ``req_id, status, content_type, body, accepts_gzip`` into one folder per encoding."""
    coded = responses.withColumn(
        "encoding", encoding(F.col("status"), F.col("content_type"), F.col("accepts_gzip"))
    ).drop("accepts_gzip")
    coded = stage(coded, "coded")  # written twice below, made once
    for name, codec in (("gzip", "gzip"), ("identity", "none")):
        part = coded.where(F.col("encoding") == name).drop("encoding")
        part.write.option("compression", codec).json(f"{path}/encoding={name}")


def upgrade_schema(links: DataFrame) -> DataFrame:
    """Bring an older link table to the current columns: what is missing gets its typed default."""
    present = set(links.columns)
    columns = []
    for field in schemas.LINKS:
        if field.name in present:
            column = F.col(field.name)
        else:
            column = F.lit(None).cast(field.dataType)
        if field.name == "is_deleted":
            column = deleted_flag(column)
        columns.append(column.cast(field.dataType).alias(field.name))
    return links.select(*columns)


def downgrade_schema(links: DataFrame) -> DataFrame:
    """The table as it was before soft deletes."""
    return links.drop("is_deleted")
