"""Resolving ids, finding links by URL and listing a user's links."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from linkweave.constants import (
    BAD_REQUEST,
    FOLLOWED,
    GONE,
    NO_CONTENT,
    NOT_FOUND,
    OK,
    UNAUTHORIZED,
)
from linkweave.functions.text import deleted_flag, join_path
from linkweave.operators.ranking import number_rows
from linkweave.operators.skew import ROWS_PER_TASK, lookup
from linkweave.session import stage


def _newest_first(links: DataFrame) -> list[Column]:
    """By time, then by surrogate key where the table has one; the id makes the order total."""
    keys = [c for c in ("created_at", "link_id") if c in links.columns]
    return [*(F.desc(c) for c in keys), F.asc("short_id")]


def resolve(
    clicks: DataFrame, links: DataFrame, salt_by: Sequence[str] = ("req_id",), rows_per_task: int = ROWS_PER_TASK
) -> DataFrame:
    """Outcome of each click: 307 with ``location``, 400 empty id, 404 unknown, 410 deleted.

    The clicks of a hot id are spread by their ``salt_by`` columns. ``links`` has each id once.
    """
    known = links.select(
        "short_id",
        F.col("original_url").alias("_url"),
        deleted_flag(F.col("is_deleted")).alias("_deleted"),
    )
    status = (
        F.when(F.coalesce(F.col("short_id"), F.lit("")) == "", BAD_REQUEST)
        .when(F.col("_deleted").isNull(), NOT_FOUND)
        .when(F.col("_deleted"), GONE)
        .otherwise(FOLLOWED)
    )
    return (
        lookup(clicks, known, ["short_id"], salt_by, rows_per_task=rows_per_task)
        .withColumn("status", status.cast("int"))
        .withColumn("location", F.when(F.col("status") == FOLLOWED, F.col("_url")))
        .drop("_url", "_deleted")
    )


def find_by_original(
    requests: DataFrame, index: DataFrame, salt_by: Sequence[str] = ("req_id",), rows_per_task: int = ROWS_PER_TASK
) -> DataFrame:
    """Add the ``short_id`` stored for each ``original_url``, deleted or not; null when unknown."""
    known = index.select("original_url", "short_id")
    return lookup(requests, known, ["original_url"], salt_by, rows_per_task=rows_per_task)


def live_links(links: DataFrame) -> DataFrame:
    return links.where(~deleted_flag(F.col("is_deleted")))


def by_user(links: DataFrame, user_id: str) -> DataFrame:
    """Live links of one user."""
    return live_links(links.where(F.col("user_id") == user_id))


def scan_links(links: DataFrame) -> DataFrame:
    """All links, deleted ones too, newest first."""
    return links.orderBy(*_newest_first(links))


def order_by_created(links: DataFrame) -> DataFrame:
    """Add ``pos``: the place of each live link in its owner's list, newest first."""
    return number_rows(live_links(links), _newest_first(links), "pos", ["user_id"])


def point_lookup(links: DataFrame, column: str, value: str) -> DataFrame:
    """The one link with this unique key."""
    return links.where(F.col(column) == value).limit(1)


def user_urls(users: DataFrame, links: DataFrame, base: str) -> DataFrame:
    """Answer to each user's list request, one row per listed link: ``user_id, status, pos,
    short_url, original_url``.

    200 rows come newest first by ``pos``; a user without live links has one 204 row, an empty user
    one 401 row. Rows, not one array per user: an owner may hold a large share of all links.
    """
    asking = users.select("user_id").distinct()
    named = asking.where(F.coalesce(F.col("user_id"), F.lit("")) != "")
    named = stage(named, "named")  # as a stored table a hot user's links can be split at run time
    listed = (
        order_by_created(lookup(links, named, ["user_id"], ["short_id"], how="left_semi"))
        .select(
            "user_id",
            F.lit(OK).alias("status"),
            "pos",
            join_path(base, F.col("short_id")).alias("short_url"),
            "original_url",
        )
    )
    nothing = F.lit(None).cast("string")
    empty = named.join(live_links(links).select("user_id").distinct(), "user_id", "left_anti").select(
        "user_id", F.lit(NO_CONTENT).alias("status")
    )
    refused = asking.where(F.coalesce(F.col("user_id"), F.lit("")) == "").select(
        "user_id", F.lit(UNAUTHORIZED).alias("status")
    )
    bare = empty.unionByName(refused).select(
        "user_id",
        "status",
        F.lit(None).cast("bigint").alias("pos"),
        nothing.alias("short_url"),
        nothing.alias("original_url"),
    )
    return listed.unionByName(bare)


def user_has_links(users: DataFrame, links: DataFrame) -> DataFrame:
    """``user_id, n_links, status``: 204 for a user with no live link, else 200."""
    counts = live_links(links).groupBy("user_id").agg(F.count("short_id").alias("_n"))
    return (
        users.select("user_id")
        .distinct()
        .join(counts, "user_id", "left")
        .select(
            "user_id",
            F.coalesce(F.col("_n"), F.lit(0)).cast("bigint").alias("n_links"),
            F.when(F.col("_n") > 0, OK).otherwise(NO_CONTENT).cast("int").alias("status"),
        )
    )
