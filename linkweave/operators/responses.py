"""Request checks, response bodies and audit events."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from linkweave.constants import (
    ACCEPTED,
    ACTION_FOLLOW,
    ACTION_SHORTEN,
    BAD_REQUEST,
    CONFLICT,
    CREATED,
    FOLLOWED,
    UNAUTHORIZED,
)
from linkweave.functions.json import decode_array_body
from linkweave.functions.text import event_time, join_path, unicode_trim

TEXT = "text"
JSON = "json"


def user_urls_projection(links: DataFrame, base: str) -> DataFrame:
    return links.select(join_path(base, F.col("short_id")).alias("short_url"), "original_url")


def batch_response(saved: DataFrame, base: str) -> DataFrame:
    """One row per item of a saved batch, in request order by ``pos``, with its JSON text."""
    url = join_path(base, F.col("short_id"))
    return saved.select(
        "batch_id",
        "pos",
        "correlation_id",
        url.alias("short_url"),
        F.to_json(F.struct("correlation_id", url.alias("short_url"))).alias("item"),
    )


def shorten_response(outcomes: DataFrame, base: str, keep: Sequence[str] = ()) -> DataFrame:
    """``req_id, status, content_type, body`` and the columns to ``keep``. Text requests get the
    bare URL, JSON requests an object, failures no body. ``outcomes`` has ``kind``."""
    url = join_path(base, F.col("short_id"))
    answered = F.col("status").isin(CREATED, CONFLICT)
    is_text = F.col("kind") == TEXT
    return outcomes.select(
        "req_id",
        "status",
        F.when(answered, F.when(is_text, "text/plain").otherwise("application/json")).alias("content_type"),
        F.when(answered, F.when(is_text, url).otherwise(F.to_json(F.struct(url.alias("result"))))).alias("body"),
        *keep,
    )


def _events(outcomes: DataFrame, action: str, url: str) -> DataFrame:
    return outcomes.select(
        event_time(F.col("ts")).alias("ts"), F.lit(action).alias("action"), "user_id", F.col(url).alias("url")
    )


def shorten_events(outcomes: DataFrame) -> DataFrame:
    """A new link leaves an audit event; a conflict or failure does not."""
    return _events(outcomes.where(F.col("status") == CREATED), ACTION_SHORTEN, "original_url")


def follow_events(outcomes: DataFrame) -> DataFrame:
    """A redirect leaves an audit event; an unknown or deleted link does not."""
    return _events(outcomes.where(F.col("status") == FOLLOWED), ACTION_FOLLOW, "location")


def audit_projection(shortened: DataFrame, followed: DataFrame) -> DataFrame:
    """Audit events of both kinds of outcomes."""
    return shorten_events(shortened).unionByName(follow_events(followed))


def stored_url(kind: Column, url: Column) -> Column:
    """The URL a shorten request stores: a text body is trimmed, a JSON url is kept as it came."""
    return F.when(kind == TEXT, unicode_trim(url)).otherwise(url)


def valid_shorten(requests: DataFrame) -> DataFrame:
    """Add ``original_url`` and ``valid`` to rows with ``kind`` and ``url``; a blank URL is refused."""
    blank = F.coalesce(unicode_trim(F.col("url")) == "", F.lit(True))
    return requests.withColumn("valid", ~blank).withColumn(
        "original_url", F.when(~blank, stored_url(F.col("kind"), F.col("url")))
    )


def valid_delete(requests: DataFrame) -> DataFrame:
    """Decode the delete ``body`` and add ``ids`` and ``status``.

    401 without a valid user (column ``valid``), 400 for anything but a non-empty array of strings,
    else 202.
    """
    ids = decode_array_body(F.col("body"), StringType())
    known = F.coalesce(F.col("valid"), F.lit(False)) & (F.coalesce(F.col("user_id"), F.lit("")) != "")
    status = (
        F.when(~known, UNAUTHORIZED)
        .when(F.coalesce(F.size("_ids"), F.lit(0)) <= 0, BAD_REQUEST)
        .otherwise(ACCEPTED)
    )
    return (
        requests.withColumn("_ids", ids)
        .withColumn("status", status.cast("int"))
        .withColumn("ids", F.when(F.col("status") == ACCEPTED, F.col("_ids")))
        .drop("_ids")
    )
