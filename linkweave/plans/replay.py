"""Replay of whole request logs in ``unique`` mode, without going through it row by row."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from linkweave.constants import (
    ACCEPTED,
    BAD_REQUEST,
    CONFLICT,
    CREATED,
    FAILED,
    FOLLOWED,
    GONE,
    NO_CONTENT,
    NOT_FOUND,
    OK,
)
from linkweave.operators.batches import accepted_items, decide_batches
from linkweave.operators.deletes import clean_deletes, delete_times
from linkweave.operators.ranking import running_total
from linkweave.operators.responses import JSON, TEXT, valid_shorten
from linkweave.operators.shorten import arrival, assign_ids, shorten_unique
from linkweave.operators.skew import ROWS_PER_TASK, lookup
from linkweave.session import stage

FOLLOW, LIST, DELETE, BATCH = "follow", "list", "delete", "batch"
LIST_URI = "/api/user/urls"
BATCH_URI = "/api/shorten/batch"


def replay(log: DataFrame, rows_per_task: int = ROWS_PER_TASK, **id_options) -> DataFrame:
    """Outcome of each request: ``req_id, method, uri, status``.

    ``log`` has ``req_id, ts, user_id, kind, url, short_id, ids``. A link exists from its first
    shorten request on and is live until the first delete by its owner after that. Requests act in
    the order of time and id; each then compares its own time with those two.
    """
    return _replayed(log, *_shortens(log, rows_per_task, id_options), rows_per_task)


def replay_batches(log: DataFrame, rows_per_task: int = ROWS_PER_TASK, **id_options) -> DataFrame:
    """Outcome of each request of a log that also has batches: rows of kind ``batch`` with ``items``, an array of
    ``correlation_id, original_url``.

    Single requests and batches are decided in one order of time and id. A single request always claims its URL; a batch is
    saved only if it wins all of its URLs. So only batches can depend on each other's fate: a batch with a URL that some
    single request asked for earlier is refused at once, the others are decided in rounds (``decide_batches``), and then each
    URL belongs to the earliest of its single requests and the one saved batch that may hold it. Follows, lists and deletes see the links of
    both. A batch with no item, or with a blank URL or correlation id, is a 400 and claims nothing; a refused one is a 500.

    A batch request is known by its time and id: rows with both the same are copies, each with the same outcome. A null
    ``items`` is an empty batch. If ids run out, all of a batch fails and the single requests of its URLs with it.
    """
    return _replayed(log, *_saves(log, rows_per_task, id_options), rows_per_task)


def _replayed(log: DataFrame, shortened: DataFrame, created: DataFrame, rows_per_task: int) -> DataFrame:
    removals = log.where(F.col("kind") == DELETE)
    deleted = delete_times(created, clean_deletes(removals), rows_per_task)
    lives = stage(created.join(deleted, "short_id", "left"), "lives")
    removed = _outcome(
        removals, "DELETE", F.lit(LIST_URI), F.when(F.size("ids") > 0, ACCEPTED).otherwise(BAD_REQUEST)
    )
    return (
        shortened.unionByName(_follows(log, lives, rows_per_task)).unionByName(removed).unionByName(_lists(log, lives))
    )


def _outcome(rows: DataFrame, method: str, uri: Column, status: Column) -> DataFrame:
    return rows.select("req_id", F.lit(method).alias("method"), uri.alias("uri"), status.cast("int").alias("status"))


def _shortens(log: DataFrame, rows_per_task: int, id_options: dict) -> tuple[DataFrame, DataFrame]:
    """Outcomes of the shorten requests, and the links with their time of creation."""
    asked = valid_shorten(
        log.where(F.col("kind").isin(TEXT, JSON)).select("req_id", "ts", "user_id", "kind", "url")
    )
    valid = asked.where("valid").select("req_id", "ts", "user_id", "kind", "original_url")
    outcomes = stage(shorten_unique(valid, rows_per_task=rows_per_task, **id_options), "outcomes")
    uri = F.when(F.col("kind") == TEXT, "/").otherwise("/api/shorten")
    refused = _outcome(asked.where("not valid"), "POST", uri, F.lit(BAD_REQUEST))
    created = outcomes.where(F.col("status") == CREATED).select(
        "short_id", "user_id", arrival(F.col("ts"), F.col("req_id")).alias("_created")
    )
    return _outcome(outcomes, "POST", uri, F.col("status")).unionByName(refused), created


def _saves(log: DataFrame, rows_per_task: int, id_options: dict) -> tuple[DataFrame, DataFrame]:
    """Outcomes of the shorten requests and batches, and the links of both with their time of creation."""
    at = arrival(F.col("ts"), F.col("req_id"))
    asked = valid_shorten(log.where(F.col("kind").isin(TEXT, JSON)).select("req_id", at.alias("_at"), "user_id", "kind", "url"))
    singles = stage(asked.where("valid").select("req_id", "_at", "user_id", "kind", "original_url"), "singles")
    posted = stage(log.where(F.col("kind") == BATCH).select("req_id", at.alias("batch_id"), "user_id", "items"), "posted")
    rows = posted.dropDuplicates(["batch_id"]).select("batch_id", "user_id", F.posexplode("items").alias("pos", "item"))
    items = stage(accepted_items(rows.select("batch_id", "user_id", "pos", "item.correlation_id", "item.original_url"), rows_per_task), "items")

    claims = singles.groupBy("original_url").agg(F.min("_at").alias("claimed"))
    verdicts = stage(decide_batches(items.select("batch_id", "original_url"), None, rows_per_task, stage(claims, "claims")), "verdicts")
    saved = items.join(verdicts.where("accepted"), "batch_id", "left_semi").select("original_url", F.col("batch_id").alias("_at"), "user_id")
    by_url = singles.select("original_url", "_at", "user_id").unionByName(saved).groupBy("original_url").agg(
        F.min("_at").alias("_arrival"), F.min_by("user_id", "_at").alias("user_id"), F.count(F.lit(1)).alias("_n")
    )
    links = stage(assign_ids(by_url, "original_url", "_arrival", **id_options), "links")
    lost = links.where("short_id is null")
    if not lost.isEmpty():  # a batch that did not get all its ids has none of its links
        failed = verdicts.where("accepted").join(lost.select(F.col("_arrival").alias("batch_id")), "batch_id", "left_semi")
        failed = stage(failed.select(F.col("batch_id").alias("_arrival"), F.lit(True).alias("_failed")), "failed")
        links = links.join(failed, "_arrival", "left").withColumn("short_id", F.when(F.col("_failed").isNull(), F.col("short_id"))).drop("_failed")
        verdicts = verdicts.join(failed.select(F.col("_arrival").alias("batch_id"), "_failed"), "batch_id", "left")
        verdicts = verdicts.select("batch_id", (F.col("accepted") & F.col("_failed").isNull()).alias("accepted"))

    found = lookup(singles, links.select("original_url", "short_id", "_arrival", "_n"), ["original_url"], ["req_id"], "left", "_n", rows_per_task)
    status = F.when(F.col("short_id").isNull(), FAILED).when(F.col("_at") == F.col("_arrival"), CREATED).otherwise(CONFLICT)
    uri = F.when(F.col("kind") == TEXT, "/").otherwise("/api/shorten")
    outcome = F.when(F.col("accepted").isNull(), BAD_REQUEST).when(F.col("accepted"), CREATED).otherwise(FAILED)
    outcomes = (
        _outcome(found, "POST", uri, status)
        .unionByName(_outcome(asked.where("not valid"), "POST", uri, F.lit(BAD_REQUEST)))
        .unionByName(_outcome(posted.join(verdicts, "batch_id", "left"), "POST", F.lit(BATCH_URI), outcome))
    )
    created = links.where("short_id is not null").select("short_id", "user_id", F.col("_arrival").alias("_created"))
    return outcomes, created


def _follows(log: DataFrame, lives: DataFrame, rows_per_task: int) -> DataFrame:
    clicks = log.where(F.col("kind") == FOLLOW).select(
        "req_id", "short_id", arrival(F.col("ts"), F.col("req_id")).alias("_at")
    )
    status = (
        F.when(F.coalesce(F.col("short_id"), F.lit("")) == "", BAD_REQUEST)
        .when(F.col("_created").isNull() | (F.col("_created") > F.col("_at")), NOT_FOUND)
        .when(F.col("_deleted") < F.col("_at"), GONE)
        .otherwise(FOLLOWED)
    )
    seen = lookup(clicks, lives.drop("user_id"), ["short_id"], ["req_id"], rows_per_task=rows_per_task)
    return _outcome(seen, "GET", F.concat(F.lit("/"), F.coalesce(F.col("short_id"), F.lit(""))), status)


def _lists(log: DataFrame, lives: DataFrame) -> DataFrame:
    """200 or 204 of each list request, from the running number of the user's live links."""
    no_id = F.lit(None).cast("bigint")
    moves = lives.select(
        "user_id",
        "short_id",
        F.explode(
            F.array(
                F.struct(F.col("_created").alias("_at"), F.lit(1).alias("_step")),
                F.struct(F.col("_deleted").alias("_at"), F.lit(-1).alias("_step")),
            )
        ).alias("_move"),
    )
    moves = moves.select("user_id", "short_id", "_move.*", no_id.alias("req_id")).where("_at is not null")
    asks = log.where(F.col("kind") == LIST).select(
        "user_id",
        F.lit("").alias("short_id"),
        arrival(F.col("ts"), F.col("req_id")).alias("_at"),
        F.lit(0).alias("_step"),
        "req_id",
    )
    counted = running_total(
        moves.unionByName(asks), "_step", [F.col("_at"), F.col("short_id")], "_live", ["user_id"]
    )
    status = F.when(F.col("_live") > 0, OK).otherwise(NO_CONTENT)
    return _outcome(counted.where("req_id is not null"), "GET", F.lit(LIST_URI), status)
