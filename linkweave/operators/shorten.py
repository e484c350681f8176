"""Turning original URLs into links.

Two modes. ``unique``: an original URL has one link, later requests get the stored id (409).
``append``: every request makes a link.
"""

from __future__ import annotations

from collections.abc import Sequence
from decimal import Decimal

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from linkweave.constants import (
    CONFLICT,
    CREATED,
    FAILED,
    ID_CHARSET,
    ID_LENGTH,
    MAX_ATTEMPTS,
)
from linkweave.functions.ids import short_id
from linkweave.operators.ranking import number_rows
from linkweave.operators.skew import ROWS_PER_TASK, lookup
from linkweave.session import stage

# Request ids are signed longs, so a step in time must exceed their whole span.
_STEP = Decimal(2 * 10**19)
_LAST_MICROS, _LAST_ID = Decimal(10**18 - 1), Decimal(2**63 - 1)


def arrival_parts(ts: Column, req_id: Column) -> tuple[Column, Column]:
    """The two numbers that ``arrival`` joins: time, then request id, each with a last value for null."""
    micros = F.coalesce(F.unix_micros(ts.cast("timestamp")), F.lit(int(_LAST_MICROS)).cast("long"))
    return micros, F.coalesce(req_id.cast("long"), F.lit(int(_LAST_ID)).cast("long"))


def as_one(micros: Column, number: Column) -> Column:
    return (micros.cast("decimal(18,0)") * F.lit(_STEP) + number.cast("decimal(19,0)")).cast("decimal(38,0)")


def arrival(ts: Column, req_id: Column) -> Column:
    """Order of requests by time, then id, as one number; a null time comes last, and so does a null id.

    A fixed-width key keeps ``min`` and ``max`` inside hash aggregation; a struct or string key
    would sort each partition first.
    """
    return as_one(*arrival_parts(ts, req_id))


def latest_by_id(links: DataFrame, order: Column) -> DataFrame:
    """The last link of each short id."""
    row = F.struct(*(F.col(c) for c in links.columns))
    return links.groupBy("short_id").agg(F.max_by(row, order).alias("_row")).select("_row.*")


def original_index(links: DataFrame, order: Column) -> DataFrame:
    """``original_url, short_id`` of the last link of each URL. Run it on ``latest_by_id``."""
    return links.groupBy("original_url").agg(F.max_by("short_id", order).alias("short_id"))


def first_by_original(requests: DataFrame) -> DataFrame:
    """The first request of each URL, with the number of requests it has."""
    order = arrival(F.col("ts"), F.col("req_id"))
    row = F.struct("ts", "req_id", "user_id")
    return (
        requests.groupBy("original_url")
        .agg(F.min_by(row, order).alias("_first"), F.count(F.lit(1)).alias("n_requests"))
        .select("original_url", "_first.*", "n_requests")
    )


def matching(stored: DataFrame, wanted: DataFrame, key: str) -> DataFrame:
    """Rows of ``stored`` whose ``key`` is wanted.

    A left join would shuffle the whole store even for a handful of wanted keys. This one lets Spark
    broadcast them when they are few, and otherwise leaves the rows partitioned for the left join.
    """
    return stored.join(wanted.select(key), key, "left_semi")


def id_collisions(
    candidates: DataFrame,
    stored: DataFrame,
    salt_by: Sequence[str] = ("req_id",),
    rows_per_task: int = ROWS_PER_TASK,
) -> DataFrame:
    """Candidates whose ``short_id`` is in the store already."""
    return lookup(candidates, stored.select("short_id"), ["short_id"], salt_by, "left_semi", None, rows_per_task)


def assign_ids(
    rows: DataFrame,
    key: str,
    order: str,
    stored: DataFrame | None = None,
    charset: str = ID_CHARSET,
    length: int = ID_LENGTH,
    attempts: int = MAX_ATTEMPTS,
) -> DataFrame:
    """Add ``short_id``, unique among the rows and the ``stored`` ids; null when all attempts fail.

    Round k gives every open row its k-th candidate. Among rows with the same candidate the first in
    ``order`` gets it, unless it is taken; the others go to the next round. Ids are hashes, so the
    groups compared here are tiny and even, whatever the URLs look like. ``key`` must be unique.
    """
    known = None if stored is None else stored.select("short_id")
    by_id = Window.partitionBy("short_id").orderBy(order)
    done: list[DataFrame] = []
    pending = rows
    for attempt in range(attempts):
        candidate = short_id(F.col(key).cast("string"), attempt, charset, length)
        candidates = pending.withColumn("short_id", candidate)
        free = F.lit(True)
        if known is not None:
            hits = matching(known, candidates, "short_id").withColumn("_taken", F.lit(True))
            candidates = candidates.join(hits, "short_id", "left")
            free = F.col("_taken").isNull()
        judged = candidates.withColumn("_won", free & (F.row_number().over(by_id) == 1))
        judged = stage(judged.drop("_taken"), "ids")
        won = judged.where("_won").drop("_won")
        done.append(won)
        known = won.select("short_id") if known is None else known.unionByName(won.select("short_id"))
        pending = judged.where("not _won").drop("_won", "short_id")
        if pending.isEmpty():
            break
    else:
        done.append(pending.withColumn("short_id", F.lit(None).cast("string")))
    assigned = done[0]
    for part in done[1:]:
        assigned = assigned.unionByName(part)
    return assigned


def shorten_unique(
    requests: DataFrame,
    links: DataFrame | None = None,
    rows_per_task: int = ROWS_PER_TASK,
    index: DataFrame | None = None,
    **id_options,
) -> DataFrame:
    """``requests`` (``req_id, ts, original_url`` and more) with ``short_id, status`` of the outcome.

    201 for the first request of a URL that has no link, 409 with the stored id for all others, also
    when the link belongs to somebody else or is deleted, 500 when no free id was found. Copies of one
    request (same ``req_id`` and ``ts``) get the same outcome; ``new_links`` makes one link of them. ``index`` (``original_url, short_id``)
    is where the store keeps its links by URL, if it has such a table beside ``links``.
    """
    order = arrival(F.col("ts"), F.col("req_id"))
    urls = requests.groupBy("original_url").agg(F.min(order).alias("_arrival"), F.count(F.lit(1)).alias("_n"))
    if links is None:
        resolved = assign_ids(urls, "original_url", "_arrival", **id_options)
    else:
        hits = matching((links if index is None else index).select("original_url", "short_id"), urls, "original_url")
        urls = stage(urls.join(hits, "original_url", "left"), "urls")
        known = urls.where("short_id is not null").withColumn("_arrival", F.lit(None).cast("decimal(38,0)"))
        fresh = urls.where("short_id is null").drop("short_id")
        resolved = assign_ids(fresh, "original_url", "_arrival", links, **id_options).unionByName(known)
    outcome = F.when(F.col("short_id").isNull(), FAILED).when(order == F.col("_arrival"), CREATED)
    return lookup(requests, resolved, ["original_url"], ["req_id"], "left", "_n", rows_per_task).select(
        *requests.columns,
        "short_id",
        outcome.otherwise(CONFLICT).cast("int").alias("status"),
    )


def shorten_append(requests: DataFrame, links: DataFrame | None = None, **id_options) -> DataFrame:
    """Outcome of each request when repeated URLs are allowed: 201, or 500 when no free id was found."""
    order = arrival(F.col("ts"), F.col("req_id"))
    rows = requests.withColumn("_arrival", order)
    return (
        assign_ids(rows, "req_id", "_arrival", links, **id_options)
        .withColumn("status", F.when(F.col("short_id").isNull(), FAILED).otherwise(CREATED).cast("int"))
        .drop("_arrival")
    )


def new_links(outcomes: DataFrame) -> DataFrame:
    """The links that the 201 outcomes add to the table, one per id however often a log repeats the request."""
    made = outcomes.where(F.col("status") == CREATED).select("short_id", "original_url", "user_id", "ts")
    return made.dropDuplicates(["short_id"]).select(
        "short_id",
        "original_url",
        "user_id",
        F.lit(False).alias("is_deleted"),
        F.col("ts").alias("created_at"),
        F.col("ts").alias("updated_at"),
    )


def assign_link_ids(df: DataFrame, order: list[Column], start: int = 0) -> DataFrame:
    """Add the surrogate key ``link_id``: ``start`` + 1, 2, 3 … in ``order``."""
    numbered = number_rows(df, order, "link_id")
    return numbered.withColumn("link_id", F.col("link_id") + F.lit(start).cast("bigint"))
